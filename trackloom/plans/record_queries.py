"""Queries over labelled records, embeddings and orders: sampling, calibration, reviews."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import matching, quality, sampling
from .projections import REC_SQL, records, table
from .registry import query, rounded

R = f"WITH {REC_SQL}"


@query("ess_gini", f"{R}, k AS (SELECT domain, CAST(size AS double) AS w, row_number() OVER (PARTITION BY domain ORDER BY size) AS r FROM rec) SELECT domain, count(*) AS n, round(sum(w) * sum(w) / sum(w * w), 6) AS ess, round(2 * sum(w * r) / (count(*) * sum(w)) - (count(*) + 1) / CAST(count(*) AS double), 6) AS gini FROM k GROUP BY domain")
def ess_gini(spark, sf_dir):
    return rounded(sampling.ess_gini(records(spark, sf_dir), "domain", "size"))


def _shares(spark, sf_dir):
    rec = records(spark, sf_dir)
    app = rec.groupBy("domain").agg((F.sum("size") / F.lit(1e6)).alias("app"))
    bench = rec.where("split = 'test'").groupBy("domain").agg((F.count("*") / F.lit(1e3)).alias("bench"))
    error = rec.where("correct is not null").groupBy("domain").agg(F.avg(1 - F.col("correct")).alias("error"))
    return sampling.target_distribution(app, bench, error, "domain")


TARGET_SQL = f"""{REC_SQL}, a AS (SELECT domain, sum(size) / 1e6 AS app FROM rec GROUP BY 1), b AS (SELECT domain, count(*) / 1e3 AS bench FROM rec WHERE split = 'test' GROUP BY 1), e AS (SELECT domain, avg(1 - correct) AS error FROM rec WHERE correct IS NOT NULL GROUP BY 1),
raw AS (SELECT domain, greatest(coalesce(app, 0), 1e-8) * pow(greatest(coalesce(bench, 0), 1e-8), 0.3) * exp(0.5 * coalesce(error, 0)) AS raw FROM a FULL JOIN b USING (domain) FULL JOIN e USING (domain)),
tgt AS (SELECT domain, raw / sum(raw) OVER () AS target FROM raw)"""


@query("target_distribution", f"WITH {TARGET_SQL} SELECT domain, round(target, 6) AS target FROM tgt")
def target_distribution(spark, sf_dir):
    return rounded(_shares(spark, sf_dir))


@query("largest_remainder", f"{R}, c AS (SELECT grp, count(*) AS n FROM rec GROUP BY grp), x AS (SELECT grp, n * 137.0 / sum(n) OVER () AS e FROM c), f AS (SELECT grp, e, floor(e) AS b, row_number() OVER (ORDER BY round(e - floor(e), 9) DESC, grp) AS r, 137 - sum(floor(e)) OVER () AS l FROM x) SELECT grp, CAST(b + CASE WHEN r <= l THEN 1 ELSE 0 END AS bigint) AS seats FROM f")
def largest_remainder(spark, sf_dir):
    return sampling.largest_remainder(records(spark, sf_dir).groupBy("grp").agg(F.count("*").alias("n")), "grp", "n", 137)


@query("distribution_report", f"""WITH {TARGET_SQL}, g AS (SELECT domain, CAST(sum(CASE WHEN risk = 1 THEN 0.5 ELSE 1.0 END) AS double) AS m FROM rec GROUP BY 1), s AS (SELECT domain AS value, m / sum(m) OVER () AS share, target FROM g JOIN tgt USING (domain))
SELECT value, round(share, 6) AS share, round(target, 6) AS target, round((SELECT sum(abs(share - target)) / 2 FROM s), 6) AS total_variation FROM s""")  # fmt: skip
def distribution_report(spark, sf_dir):
    return rounded(sampling.distribution_report(records(spark, sf_dir), "domain", F.when(F.col("risk") == 1, 0.5).otherwise(1.0), _shares(spark, sf_dir)))


@query("repeat_factors", f"""WITH {TARGET_SQL}, f AS (SELECT domain, count(*) / CAST(sum(count(*)) OVER () AS double) AS share FROM rec GROUP BY domain)
SELECT sample_id, round(CASE WHEN coalesce(risk, 0) = 0 THEN least(greatest(sqrt(target / share) * coalesce(correct, 0.5), 0), 4) ELSE 0 END, 6) AS factor FROM rec JOIN f USING (domain) JOIN tgt USING (domain)""")  # fmt: skip
def repeat_factors(spark, sf_dir):
    rec = records(spark, sf_dir)
    got = sampling.repeat_factors(rec, "domain", _shares(spark, sf_dir), F.coalesce(F.col("correct").cast("double"), F.lit(0.5)), F.coalesce(F.col("risk"), F.lit(0)) == 0)
    return rounded(got.select("sample_id", "factor"))


@query("wasserstein_kuiper", f"""{R}, c AS (SELECT domain, CAST(size AS double) AS v, sum(CASE WHEN split = 'test' THEN 1 ELSE 0 END) AS na, sum(CASE WHEN split = 'test' THEN 0 ELSE 1 END) AS nb FROM rec GROUP BY 1, 2),
f AS (SELECT domain, v, sum(na) OVER w / CAST(sum(na) OVER p AS double) - sum(nb) OVER w / CAST(sum(nb) OVER p AS double) AS gap, lead(v) OVER w - v AS step FROM c WINDOW w AS (PARTITION BY domain ORDER BY v), p AS (PARTITION BY domain))
SELECT domain, round(sum(abs(gap) * coalesce(step, 0)), 5) AS wasserstein, round(greatest(max(gap), 0) - least(min(gap), 0), 5) AS kuiper FROM f GROUP BY domain""")  # fmt: skip
def wasserstein_kuiper(spark, sf_dir):
    return rounded(sampling.wasserstein_kuiper(records(spark, sf_dir).withColumn("test", F.col("split") == "test"), "domain", "test", "size"), 5)


@query("circular_wasserstein", f"""{R}, b AS (SELECT domain, least(CAST(floor((size % 628) / 100.0 / (2 * pi() / 72)) AS int), 71) AS bin, sum(CASE WHEN split = 'test' THEN 1 ELSE 0 END) AS na, sum(CASE WHEN split = 'test' THEN 0 ELSE 1 END) AS nb FROM rec GROUP BY 1, 2),
d AS (SELECT x.domain, y.bin, coalesce(na, 0) AS na, coalesce(nb, 0) AS nb FROM (SELECT DISTINCT domain FROM rec) x CROSS JOIN (SELECT unnest(range(0, 72)) AS bin) y LEFT JOIN b ON b.domain = x.domain AND b.bin = y.bin),
g AS (SELECT domain, sum(na) OVER w / CAST(sum(na) OVER p AS double) - sum(nb) OVER w / CAST(sum(nb) OVER p AS double) AS gap FROM d WINDOW w AS (PARTITION BY domain ORDER BY bin), p AS (PARTITION BY domain)),
m AS (SELECT domain, gap, median(gap) OVER (PARTITION BY domain) AS mid FROM g) SELECT domain, round(sum(abs(gap - mid)) * 2 * pi() / 72, 5) AS circular_wasserstein FROM m GROUP BY domain""")  # fmt: skip
def circular_wasserstein(spark, sf_dir):
    rec = records(spark, sf_dir).withColumn("test", F.col("split") == "test")
    return rounded(sampling.circular_wasserstein(rec, "domain", "test", (F.col("size") % 628) / 100.0), 5)


@query("theil_sen", "WITH m AS (SELECT o_orderpriority AS series, year(o_orderdate) * 12 + month(o_orderdate) AS t, count(*) AS y FROM orders GROUP BY 1, 2) SELECT a.series, round(median((b.y - a.y) / CAST(b.t - a.t AS double)), 6) AS slope, count(*) AS pairs FROM m a JOIN m b ON a.series = b.series AND a.t < b.t GROUP BY a.series")
def theil_sen(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    m = o.groupBy(F.col("o_orderpriority").alias("series"), (F.year("o_orderdate") * 12 + F.month("o_orderdate")).alias("t")).agg(F.count("*").alias("y"))
    return rounded(sampling.theil_sen(m, "series", "t", "y"))


@query("recall_shrinkage", f"{R}, s AS (SELECT domain, grp, CAST(sum(correct) AS bigint) AS tp, count(correct) AS gt FROM rec WHERE split = 'calibration' AND correct IS NOT NULL GROUP BY 1, 2) SELECT domain, grp, tp, gt, round((tp + 10.0 * sum(tp) OVER p / sum(gt) OVER p) / (gt + 10.0), 6) AS recall FROM s WINDOW p AS (PARTITION BY domain)")
def recall_shrinkage(spark, sf_dir):
    rec = records(spark, sf_dir).where("split = 'calibration' and correct is not null")
    return rounded(quality.recall_by_slice(rec, "domain", ["grp"], F.col("correct"), F.lit(1)))


@query("corrected_count", f"""{R}, s AS (SELECT domain, grp, sum(correct) AS tp, count(correct) AS gt FROM rec WHERE split = 'calibration' AND correct IS NOT NULL GROUP BY 1, 2), r AS (SELECT domain, grp, (tp + 10.0 * sum(tp) OVER p / sum(gt) OVER p) / (gt + 10.0) AS recall FROM s WINDOW p AS (PARTITION BY domain))
SELECT grp, count(*) AS n, round(CASE WHEN count(0.8 / recall) = count(*) THEN sum(0.8 / recall) END, 6) AS corrected FROM rec LEFT JOIN r USING (domain, grp) GROUP BY grp""")  # fmt: skip
def corrected_count(spark, sf_dir):
    rec = records(spark, sf_dir)
    recall = quality.recall_by_slice(rec.where("split = 'calibration' and correct is not null"), "domain", ["grp"], F.col("correct"), F.lit(1))
    return rounded(quality.corrected_count(rec, recall, ["domain", "grp"], "grp", F.lit(0.8)))


EXPERT_SQL = f"""{REC_SQL}, sc AS (SELECT sample_id, domain AS context, unnest(['size', 'group', 'parity']) AS expert, unnest(['text', 'text', 'id']) AS family, unnest([least(size / 3000.0, 1), (size % 97) / 96.0, (sample_id * 7 % 101) / 100.0]) AS p, correct FROM rec),
br AS (SELECT context, expert, avg((p - correct) * (p - correct)) AS brier FROM sc WHERE correct IS NOT NULL GROUP BY 1, 2)"""


def _experts(spark, sf_dir):
    size, key = F.col("size"), F.col("sample_id")
    trio = F.array(
        F.struct(F.lit("size").alias("expert"), F.lit("text").alias("family"), F.least(size / 3000.0, F.lit(1.0)).alias("p")),
        F.struct(F.lit("group").alias("expert"), F.lit("text").alias("family"), ((size % 97) / 96.0).alias("p")),
        F.struct(F.lit("parity").alias("expert"), F.lit("id").alias("family"), ((key * 7 % 101) / 100.0).alias("p")),
    )
    scores = records(spark, sf_dir).select("sample_id", F.col("domain").alias("context"), "correct", F.explode(trio).alias("e")).select("sample_id", "context", "correct", "e.*")
    brier = scores.where("correct is not null").groupBy("context", "expert").agg(F.avg((F.col("p") - F.col("correct")) ** 2).alias("brier"))
    return scores, brier


@query("expert_fusion", f"""WITH {EXPERT_SQL}, g AS (SELECT sample_id, p, exp(-4 * brier) AS g FROM sc JOIN br USING (context, expert)), s AS (SELECT sample_id, count(*) AS experts, sum(g * p) / sum(g) AS m, sum(g * p * p) / sum(g) AS mm FROM g GROUP BY 1)
SELECT sample_id, experts, round(m, 6) AS p, round(greatest(mm - m * m, 0), 6) AS variance FROM s""")  # fmt: skip
def expert_fusion(spark, sf_dir):
    scores, brier = _experts(spark, sf_dir)
    return rounded(quality.expert_fusion(scores, brier, "sample_id"))


@query("route_candidates", f"WITH {EXPERT_SQL}, g AS (SELECT sample_id, count(DISTINCT CASE WHEN p >= 0.85 THEN family END) AS families, max(p) AS best, min(p) AS w FROM sc GROUP BY 1) SELECT sample_id, families, CASE WHEN families >= 2 THEN 'soft_positive' WHEN best >= 0.55 THEN 'ignore' ELSE 'background' END AS route, round(CASE WHEN families >= 2 THEN w END, 6) AS weight FROM g")
def route_candidates(spark, sf_dir):
    return rounded(quality.route_candidates(_experts(spark, sf_dir)[0], "sample_id"))


@query("label_filter", f"{R}, q AS (SELECT domain, quantile_cont(size, 0.9) AS hi, quantile_cont(size, 0.1) AS lo FROM rec GROUP BY 1) SELECT sample_id, CASE WHEN size >= hi THEN 'keep' WHEN size <= lo THEN 'reject' ELSE 'review' END AS decision FROM rec JOIN q USING (domain)")
def label_filter(spark, sf_dir):
    rec = records(spark, sf_dir).select("sample_id", "domain", F.col("size").alias("score"))
    return quality.label_filter(rec, "domain").select("sample_id", "decision")


@query("behavior_f1", """WITH e AS (SELECT event_type AS t, CASE WHEN event_id % 9 = 0 THEN NULL WHEN event_id % 7 = 0 THEN 'click' ELSE event_type END AS g FROM events), u AS (SELECT t AS c, 't' AS k, t = g AS ok FROM e UNION ALL SELECT g, 'g', t = g FROM e WHERE g IS NOT NULL),
s AS (SELECT c AS label, CAST(sum(CASE WHEN k = 't' AND ok THEN 1 ELSE 0 END) AS bigint) AS tp, CAST(sum(CASE WHEN k = 'g' AND NOT coalesce(ok, false) THEN 1 ELSE 0 END) AS bigint) AS fp, CAST(sum(CASE WHEN k = 't' AND NOT coalesce(ok, false) THEN 1 ELSE 0 END) AS bigint) AS fn FROM u GROUP BY 1)
SELECT label, tp, fp, fn, round(2.0 * tp / (2 * tp + fp + fn), 6) AS f1 FROM s""")  # fmt: skip
def behavior_f1(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("t"), F.when(F.col("event_id") % 9 == 0, None).when(F.col("event_id") % 7 == 0, "click").otherwise(F.col("event_type")).alias("g"))
    return rounded(quality.class_f1(e, "label", "t", "g"))


@query("pearson", "SELECT o_orderpriority AS context, CASE WHEN count(*) >= 3 THEN round(corr(o_totalprice, o_custkey), 6) END AS r, count(*) AS n FROM orders GROUP BY 1")
def pearson(spark, sf_dir):
    g = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("context"))
    return rounded(g.agg(F.when(F.count("*") >= 3, F.corr("o_totalprice", "o_custkey")).alias("r"), F.count("*").alias("n")))


@query("group_stats", "SELECT o_orderstatus AS fold, count(*) AS n, round(avg(o_totalprice), 4) AS mean, round(stddev_samp(o_totalprice), 4) AS sd, round(1.96 * stddev_samp(o_totalprice) / sqrt(count(*)), 4) AS half, round(min(o_totalprice), 4) AS worst FROM orders GROUP BY 1")
def group_stats(spark, sf_dir):
    sd = F.stddev_samp("o_totalprice")
    return rounded(table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("fold")).agg(F.count("*").alias("n"), F.avg("o_totalprice").alias("mean"), sd.alias("sd"), (1.96 * sd / F.sqrt(F.count("*"))).alias("half"), F.min("o_totalprice").alias("worst")), 4)


DECIDE = "CASE o_orderpriority WHEN '1-URGENT' THEN 'confirm' WHEN '2-HIGH' THEN 'correct' WHEN '3-MEDIUM' THEN 'add' ELSE 'reject' END"


@query("merge_reviews", f"""WITH e AS (SELECT c_custkey AS entity_id, CASE WHEN c_custkey % 3 = 0 THEN 'soft_positive' ELSE 'unconfirmed' END AS status FROM customer WHERE c_custkey % 5 <> 0),
d AS (SELECT o_custkey AS entity_id, o_orderkey AS decision_id, {DECIDE} AS action, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders), l AS (SELECT * FROM d WHERE r = 1)
SELECT entity_id, CASE WHEN action = 'reject' THEN 'invalid' WHEN action IS NOT NULL THEN 'human_confirmed' ELSE status END AS status, decision_id, CASE WHEN status IS NULL THEN 'added' WHEN decision_id IS NOT NULL THEN 'reviewed' ELSE 'untouched' END AS origin FROM e FULL JOIN l USING (entity_id)""")  # fmt: skip
def merge_reviews(spark, sf_dir):
    e = table(spark, sf_dir, "customer").where("c_custkey % 5 <> 0").select(F.col("c_custkey").alias("entity_id"), F.when(F.col("c_custkey") % 3 == 0, "soft_positive").otherwise("unconfirmed").alias("status"))
    d = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("entity_id"), F.col("o_orderkey").alias("decision_id"), F.col("o_orderdate").alias("at"), F.expr(DECIDE).alias("action"))
    return quality.merge_reviews(e, d)


@query("knowledge_update", """WITH r AS (SELECT o_orderkey AS id, o_orderpriority AS rule, o_orderstatus = 'F' AS ok FROM orders), g AS (SELECT rule, sum(CASE WHEN ok THEN 1 ELSE 0 END) AS y, sum(CASE WHEN ok THEN 0 ELSE 1 END) AS n FROM r GROUP BY 1),
b AS (SELECT rule, CAST(1 + y AS double) AS a, CAST(1 + n AS double) AS b FROM g) SELECT rule, a AS alpha, b AS beta, round(a / (a + b), 6) AS support, round(least(36 * a * b / ((a + b) * (a + b) * (a + b + 1)), 1), 6) AS gain FROM b""")  # fmt: skip
def knowledge_update(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    reviews = o.select(F.col("o_orderkey").alias("review_id"), F.col("o_orderpriority").alias("rule"), (F.col("o_orderstatus") == "F").alias("confirmed"))
    nodes = o.select(F.col("o_orderpriority").alias("rule")).distinct().withColumns({"alpha": F.lit(1.0), "beta": F.lit(1.0)})
    return rounded(quality.beta_update(nodes, reviews.unionByName(reviews)))


@query("pareto_frontier", "WITH p AS (SELECT p_partkey, p_size, round(p_retailprice, 2) AS price FROM part) SELECT p_partkey, p_size, price FROM p WHERE NOT EXISTS (SELECT 1 FROM p q WHERE (q.p_size >= p.p_size AND q.price < p.price) OR (q.p_size > p.p_size AND q.price <= p.price))")
def pareto_frontier(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size", F.round("p_retailprice", 2).alias("price"))
    return quality.pareto(p, "p_partkey", "p_size", "price")


@query("grid_search", f"""{R}, g AS (SELECT unnest(range(1, 20)) * 200 AS t), s AS (SELECT t, count(*) FILTER (WHERE size >= t AND correct = 1) AS tp, count(*) FILTER (WHERE size >= t AND correct = 0) AS fp, count(*) FILTER (WHERE size < t AND correct = 1) AS fn FROM rec CROSS JOIN g WHERE correct IS NOT NULL GROUP BY t)
SELECT CAST(t AS bigint) AS t, tp, fp, fn, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0 * tp / (2 * tp + fp + fn) END, 6) AS f1 FROM s""")  # fmt: skip
def grid_search(spark, sf_dir):
    """Thresholds are a small fixed grid: rows are summed by grid step first, then running sums give every threshold."""
    from pyspark.sql import Window

    rec = records(spark, sf_dir).where("correct is not null").select(F.least(F.floor(F.col("size") / 200), F.lit(19)).alias("step"), "correct")
    steps = rec.groupBy("step").agg(F.sum("correct").alias("p"), F.sum(1 - F.col("correct")).alias("q"))
    dense = spark.range(0, 20).select(F.col("id").alias("step")).join(steps, "step", "left").na.fill(0)
    above = Window.orderBy(F.desc("step"))
    cum = dense.select((F.col("step") * 200).alias("t"), F.sum("p").over(above).alias("tp"), F.sum("q").over(above).alias("fp"), F.sum("p").over(Window.partitionBy()).alias("all")).where("t > 0")
    fn = F.col("all") - F.col("tp")
    total = 2 * F.col("tp") + F.col("fp") + fn
    return rounded(cum.select("t", "tp", "fp", fn.alias("fn"), F.when(total > 0, 2.0 * F.col("tp") / total).alias("f1")))


@query("review_queue", f"{R}, v AS (SELECT sample_id, (size % 89) / 89.0 + 1 / sqrt(count(*) OVER (PARTITION BY domain, grp)) AS value FROM rec) SELECT sample_id, round(value, 6) AS value FROM v ORDER BY round(value, 9) DESC, sample_id LIMIT 50")
def review_queue(spark, sf_dir):
    rec = records(spark, sf_dir).withColumn("uncertainty", (F.col("size") % 89) / 89.0)
    return rounded(quality.review_queue(rec, ["domain", "grp"], "sample_id", 50))


@query("approx_tracks", "SELECT event_type, count(DISTINCT user_id) AS exact FROM events GROUP BY 1")
def approx_tracks(spark, sf_dir):
    """Extension: distinct tracks per state."""
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count_distinct("user_id").alias("exact"))


@query("vector_pairs", "SELECT label, count(*) AS n, round(avg(list_dot_product(CAST(embedding AS double[]), CAST(embedding AS double[]))), 4) AS mean_square FROM embeddings GROUP BY label")
def vector_pairs(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    square = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return rounded(e.groupBy("label").agg(F.count("*").alias("n"), F.avg(square).alias("mean_square")), 4)


@query("isotonic")
def isotonic(spark, sf_dir):
    rec = records(spark, sf_dir).where("correct is not null").select("domain", F.least(F.col("size") / 5000.0, F.lit(1.0)).alias("score"), "correct")
    return rounded(matching.isotonic(rec, ["domain"]))


@query("raking_weights")
def raking_weights(spark, sf_dir):
    rec = records(spark, sf_dir)
    langs = [r[0] for r in rec.select("domain").distinct().collect()]  # targets are given value by value
    targets = {"domain": {x: 1 / len(langs) for x in langs}, "split": {"train": 0.6, "calibration": 0.2, "test": 0.2}}
    return rounded(sampling.raking_weights(rec, ["domain", "split"], targets).select("sample_id", "weight"))


@query("representative_topk")
def representative_topk(spark, sf_dir):
    """Per label the five most valuable and diverse vectors; every label is one review queue."""
    e = table(spark, sf_dir, "embeddings").select("label", "vec_id", "embedding", ((F.col("vec_id") % 89) / 89.0).alias("value"))
    return sampling.representative(e, "label", 5, "embedding", "value", "vec_id")


@query("mmd")
def mmd(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select((F.col("label") < 5).alias("side"), *(F.col("embedding")[k].cast("double").alias(f"f{k}") for k in range(64)))
    return rounded(sampling.mmd(e, "side", [f"f{k}" for k in range(64)]))
