"""Queries of review work and pseudo labels over the projected tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import reviews
from ..operators.ranks import numbered
from .detection_queries import _truth_and_predictions
from .entity_queries import ENT_SQL, ents
from .projections import DET_SQL, REC_SQL, detections, observed, records, table
from .registry import query, rounded
from .track_queries import COL_SQL, _windows, colony

CHANGE_SQL = f"""{COL_SQL}, pp AS (SELECT a.scope, a.window_index, a.new_tracks AS value, median(b.new_tracks) AS centre, list(b.new_tracks) AS l FROM cw a JOIN cw b ON a.scope = b.scope AND b.window_index BETWEEN a.window_index - 6 AND a.window_index - 1 GROUP BY 1, 2, 3 HAVING count(*) = 6),
uu AS (SELECT scope, window_index, value, centre, unnest(l) AS v FROM pp), mm AS (SELECT scope, window_index, value, centre, median(abs(v - centre)) AS spread FROM uu GROUP BY 1, 2, 3, 4),
zz AS (SELECT *, (value - centre) / greatest(1.4826 * spread, 0.05 * abs(centre), 0.01) AS z FROM mm),
fi AS (SELECT zz.scope, zz.window_index, 'new_tracks' AS metric, CAST(value AS double) AS value, centre, zz.z AS z, CASE WHEN value > centre THEN 'up' WHEN value < centre THEN 'down' ELSE 'same' END AS direction,
  CASE WHEN frames / CAST(cw.z + 1 - a AS double) >= 0.02 THEN 'visual_change' ELSE 'observability_check' END AS status FROM zz JOIN cw ON cw.scope = zz.scope AND cw.window_index = zz.window_index WHERE abs(zz.z) >= 1)"""


def _findings(spark, sf_dir):
    windows = _windows(spark, sf_dir)
    changes = colony.temporal_change(windows, "new_tracks", limit=1.0).withColumn("metric", F.lit("new_tracks"))
    return reviews.colony_findings(changes, windows, F.col("metric").isin("active_fraction", "median_speed"), 0.02)


@query("colony_findings", f"WITH {CHANGE_SQL} SELECT scope, window_index, metric, value, round(centre, 6) AS centre, round(z, 6) AS z, direction, status FROM fi")
def colony_findings(spark, sf_dir):
    return rounded(_findings(spark, sf_dir))


@query("colony_queue", f"WITH {CHANGE_SQL} SELECT scope, window_index, count(*) AS findings, CASE WHEN bool_or(status = 'visual_change') THEN 'colony_temporal_change' ELSE 'colony_observability_check' END AS reason, round(max(abs(z)) * 0.75 + 1, 6) AS priority FROM fi GROUP BY 1, 2")
def colony_queue(spark, sf_dir):
    return rounded(reviews.colony_queue(_findings(spark, sf_dir)))


@query("review_value", f"WITH {REC_SQL} SELECT sample_id, round(coalesce(correct, 0) + coalesce(risk, 0) - 0.2 * (size % 7), 6) AS value FROM rec")
def review_value(spark, sf_dir):
    rows = records(spark, sf_dir).select("sample_id", F.col("correct").alias("uncertainty"), F.col("risk").alias("rarity"), (F.col("size") % 7).alias("review_cost"))
    return rounded(reviews.review_value(rows).select("sample_id", "value"))


@query("merged_queues", """WITH c AS (SELECT o_orderkey AS event_id, o_totalprice AS priority FROM orders WHERE o_orderkey % 40 = 0 ORDER BY priority DESC, event_id LIMIT 10), e AS (SELECT o_orderkey AS event_id, o_totalprice AS priority FROM orders WHERE o_orderkey % 40 <> 0 ORDER BY priority DESC, event_id LIMIT 40)
SELECT 'colony' AS source, * FROM c UNION ALL SELECT 'entity', event_id, priority FROM (SELECT *, row_number() OVER (ORDER BY priority DESC, event_id) AS k FROM e) WHERE k <= 40 - (SELECT count(*) FROM c)""".replace("SELECT 'colony' AS source, * FROM c", "SELECT 'colony' AS source, event_id, priority FROM c"))  # fmt: skip
def merged_queues(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("event_id"), F.col("o_totalprice").alias("priority"))
    return reviews.merged_queues(o.where("event_id % 40 = 0"), o.where("event_id % 40 <> 0"), 40)


_ACTION = "['confirm', 'correct', 'reject'][CAST(o_orderkey % 3 + 1 AS int)]"


@query("colony_reviews", f"""WITH d AS (SELECT o_orderkey AS decision_id, o_custkey AS event_id, {_ACTION} AS action, 'label' || CAST(o_orderkey % 5 AS varchar) AS human_label, o_orderpriority AS reviewer FROM orders), l AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY decision_id DESC) AS k FROM d)
SELECT c_custkey AS event_id, CASE WHEN action = 'reject' THEN 'rejected' WHEN action IS NOT NULL THEN 'human_confirmed' ELSE 'unconfirmed' END AS status, human_label, reviewer, decision_id FROM customer LEFT JOIN l ON l.event_id = c_custkey AND l.k = 1""")  # fmt: skip
def colony_reviews(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    action = F.element_at(F.array(F.lit("confirm"), F.lit("correct"), F.lit("reject")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    decisions = o.select(F.col("o_orderkey").alias("decision_id"), F.col("o_custkey").alias("event_id"), action.alias("action"), F.concat(F.lit("label"), (F.col("o_orderkey") % 5).cast("string")).alias("human_label"), F.col("o_orderpriority").alias("reviewer"))
    queue = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("event_id"), F.lit("unconfirmed").alias("status"))
    return reviews.apply_colony_reviews(queue, decisions.unionByName(decisions.where("decision_id % 4 = 0")))


_PAIR = "SELECT a.frame, a.det AS a, b.det AS b, sqrt(pow((a.x1 + a.x2 - b.x1 - b.x2) / 2.0, 2) + pow((a.y1 + a.y2 - b.y1 - b.y2) / 2.0, 2)) AS distance FROM ent a JOIN ent b ON a.frame = b.frame AND a.det < b.det"


@query("individual_records", f"""WITH {ENT_SQL}, p AS ({_PAIR}), e AS (SELECT frame, a AS det, b AS other, distance FROM p UNION ALL SELECT frame, b, a, distance FROM p), n AS (SELECT frame, det, other, distance, row_number() OVER (PARTITION BY frame, det ORDER BY round(distance, 9), other) AS k FROM e)
SELECT t.frame * 100 + t.det AS entity_id, split, 'label' || CAST(t.det % 3 AS varchar) AS label, round(n.distance, 6) AS distance, t.frame * 100 + n.other AS other FROM ent t LEFT JOIN n ON n.frame = t.frame AND n.det = t.det AND n.k = 1 WHERE label_status = 'human_confirmed'""")  # fmt: skip
def individual_records(spark, sf_dir):
    e = ents(spark, sf_dir)
    key = lambda d: F.col("frame") * 100 + F.col(d)
    side = lambda s: e.select("frame", F.col("det").alias(s), ((F.col("x1") + F.col("x2")) / 2).alias(f"{s}_x"), ((F.col("y1") + F.col("y2")) / 2).alias(f"{s}_y"))
    pairs = side("a").join(side("b"), "frame").where("a <> b").select(key("a").alias("entity"), key("b").alias("other"), F.hypot(F.col("a_x") - F.col("b_x"), F.col("a_y") - F.col("b_y")).alias("distance"))
    labelled = e.select(key("det").alias("entity_id"), "split", "label_status", F.concat(F.lit("label"), (F.col("det") % 3).cast("string")).alias("label"))
    return rounded(reviews.individual_records(labelled, pairs))


@query("window_records", f"""WITH {DET_SQL}, f AS (SELECT DISTINCT video AS scope, frame, split FROM det), e AS (SELECT video AS scope, frame AS window_index, frame AS first_frame, frame AS last_frame, 'calm' AS label FROM det GROUP BY 1, 2)
SELECT e.scope, e.window_index, e.label, f.split FROM e JOIN f ON f.scope = e.scope AND f.frame = e.first_frame""")  # fmt: skip
def window_records(spark, sf_dir):
    d = detections(spark, sf_dir)
    frames = d.select(F.col("video").alias("scope"), "frame", "split").distinct()
    events = d.select(F.col("video").alias("scope"), F.col("frame").alias("window_index")).distinct().select("scope", "window_index", F.col("window_index").alias("first_frame"), F.col("window_index").alias("last_frame"), F.lit("calm").alias("label"))
    return reviews.window_records(events, frames)


_TAGS = "[n_name[1:1], n_name[2:2], n_name[3:3]]"


@query("choose_prompts", f"SELECT n_nationkey AS position, len(list_intersect(list_distinct({_TAGS}), ['A', 'I', 'R'])) AS shared FROM nation WHERE n_regionkey = 1 OR n_regionkey = 2 ORDER BY 2 DESC, 1 LIMIT 4")
def choose_prompts(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    tags = F.array(*(F.substring("n_name", k, 1) for k in (1, 2, 3)))
    memory = n.select(F.col("n_nationkey").alias("position"), F.when(F.col("n_regionkey").isin(1, 2), "here").otherwise("there").alias("domain"), tags.alias("tags"), F.lit(None).cast("boolean").alias("negative"))
    return reviews.choose_prompts(memory, "here", ["A", "I", "R"]).withColumn("shared", F.col("shared").cast("long"))


@query("numeric_aware_order", "SELECT id, row_number() OVER (ORDER BY try_cast(id AS double) IS NULL, try_cast(id AS double), id) AS place FROM (SELECT CASE WHEN p_partkey % 3 = 0 THEN 'id' || CAST(p_partkey AS varchar) ELSE CAST(p_partkey AS varchar) END AS id FROM part)")
def numeric_aware_order(spark, sf_dir):
    """Ids that are numbers by value, then the others by text, numbered in one sequence."""
    p = table(spark, sf_dir, "part")
    ids = p.select(F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("id"), F.col("p_partkey").cast("string"))).otherwise(F.col("p_partkey").cast("string")).alias("id"))
    number = F.expr("try_cast(id as double)")
    return numbered(ids.withColumns({"other": number.isNull(), "number": number}), [], ["other", "number", "id"], "place").select("id", "place")


@query("in_either", f"WITH {DET_SQL} SELECT frame, det FROM det WHERE frame IN (SELECT DISTINCT frame FROM det WHERE class_id = 1) OR track_id IN (SELECT track_id FROM det WHERE conf < 0.91)")
def in_either(spark, sf_dir):
    d = detections(spark, sf_dir).withColumn("entity_id", F.col("track_id"))
    return reviews.in_either(d, d.where("class_id = 1"), d.where("conf < 0.91")).select("frame", "det")


@query("prefer_records", f"WITH {REC_SQL}, b AS (SELECT sample_id, 'filtered' AS origin FROM rec WHERE correct = 0) SELECT sample_id, 'high' AS origin FROM rec WHERE coalesce(size, 0) > 500 AND sample_id NOT IN (SELECT sample_id FROM b) UNION ALL SELECT * FROM b".replace("SELECT * FROM b", "SELECT sample_id, origin FROM b"))
def prefer_records(spark, sf_dir):
    r = records(spark, sf_dir)
    return reviews.prefer(r.where("size > 500").select("sample_id", F.lit("high").alias("origin")), r.where("correct = 0").select("sample_id", F.lit("filtered").alias("origin")), "sample_id")


_SET = f"""{ENT_SQL}, fl AS (SELECT frame, det, x1 + track_id % 5 AS x1, y1 AS y1, x2 + track_id % 5 AS x2, y2 AS y2, head_x + det % 3 * 4 AS head_x, head_y, tail_x, tail_y FROM ent WHERE det % 6 <> 0),
pr AS (SELECT a.frame, a.det, b.det AS o, least(a.x2, b.x2) - greatest(a.x1, b.x1) AS w, least(a.y2, b.y2) - greatest(a.y1, b.y1) AS h, (a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) AS s,
  (sqrt(pow(a.head_x - b.head_x, 2) + pow(a.head_y - b.head_y, 2)) + sqrt(pow(a.tail_x - b.tail_x, 2) + pow(a.tail_y - b.tail_y, 2))) / 2 / sqrt(pow(a.x2 - a.x1, 2) + pow(a.y2 - a.y1, 2)) AS off FROM ent a JOIN fl b ON a.frame = b.frame),
bs AS (SELECT *, row_number() OVER (PARTITION BY frame, det ORDER BY round(w * h / CAST(s - w * h AS double), 9) DESC, o) AS k FROM pr WHERE w > 0 AND h > 0),
sc AS (SELECT ent.frame, ent.det, CASE WHEN w * h / CAST(s - w * h AS double) >= 0.5 AND coalesce(off <= 0.1, true) THEN round(w * h / CAST(s - w * h AS double), 6) ELSE 0 END AS consistency FROM ent LEFT JOIN bs ON bs.frame = ent.frame AND bs.det = ent.det AND k = 1)"""


def _set_scores(spark, sf_dir):
    e = ents(spark, sf_dir)
    shift = F.col("track_id") % 5
    flipped = e.where("det % 6 <> 0").withColumns({"x1": F.col("x1") + shift, "x2": F.col("x2") + shift, "head_x": F.col("head_x") + F.col("det") % 3 * 4})
    return reviews.set_consistency(e, flipped, 0.5, 0.1)


@query("set_consistency", f"WITH {_SET} SELECT frame, det, CAST(consistency AS double) AS consistency FROM sc")
def set_consistency(spark, sf_dir):
    return rounded(_set_scores(spark, sf_dir))


@query("route_pseudo", f"""WITH {_SET}, j AS (SELECT ent.frame, ent.det, conf AS score, consistency AS set_score, CASE WHEN ent.det % 4 = 0 THEN 0 ELSE 0.9 END AS trajectory_score, track_id % 3 = 0 AS external FROM ent JOIN sc ON sc.frame = ent.frame AND sc.det = ent.det)
SELECT frame, det, CASE WHEN NOT external AND score * set_score * trajectory_score >= 0.5 THEN 'pseudo' WHEN set_score > 0 OR trajectory_score > 0 OR score >= 0.5 THEN 'ignore' ELSE 'background' END AS route FROM j""")  # fmt: skip
def route_pseudo(spark, sf_dir):
    e = ents(spark, sf_dir)
    rows = e.join(_set_scores(spark, sf_dir), ["frame", "det"]).select("frame", "det", F.col("conf").alias("score"), F.round("consistency", 6).alias("set_score"), F.when(F.col("det") % 4 == 0, 0.0).otherwise(0.9).alias("trajectory_score"), (F.col("track_id") % 3 == 0).alias("external"))
    return reviews.route_pseudo(rows, 0.5).select("frame", "det", "route")


@query("merge_targets", f"WITH {ENT_SQL} SELECT frame, det, false AS is_pseudo FROM ent WHERE label_status IN ('human', 'human_confirmed') UNION ALL SELECT frame, det, true FROM ent WHERE det % 2 = 0 AND label_status NOT IN ('human', 'human_confirmed')")
def merge_targets(spark, sf_dir):
    e = ents(spark, sf_dir)
    return reviews.merge_targets(e.where("label_status in ('human', 'human_confirmed')").select("frame", "det"), e.where("det % 2 = 0").select("frame", "det"), ["frame", "det"])


@query("match_classes")
def match_classes(spark, sf_dir):
    gt, pred = _truth_and_predictions(spark, sf_dir)
    twins = pred.where("det % 3 = 0").withColumns({"det": F.col("det") + 1000, "conf": F.col("conf") - 0.2})
    return reviews.match_classes(pred.unionByName(twins), gt)


@query("truth_at_risk", f"WITH {DET_SQL}, s AS (SELECT frame, det AS gt, det FROM obs UNION ALL SELECT frame, det, det + 1000 FROM obs WHERE det % 3 = 0) SELECT frame, gt FROM s GROUP BY 1, 2 HAVING NOT bool_or(det % 7 <> 0)")
def truth_at_risk(spark, sf_dir):
    o = observed(detections(spark, sf_dir)).withColumn("det", F.col("det").cast("long"))
    s = o.select("frame", F.col("det").alias("gt"), "det").unionByName(o.where("det % 3 = 0").select("frame", F.col("det").alias("gt"), (F.col("det") + 1000).alias("det")))
    return reviews.truth_at_risk(s, s.where("det % 7 <> 0"))


@query("capacity_by_density")
def capacity_by_density(spark, sf_dir):
    gt, pred = _truth_and_predictions(spark, sf_dir)
    return reviews.capacity_by_density(gt.groupBy("frame").agg(F.count("*").alias("truths")), reviews.match_classes(pred, gt))


@query("round_robin", f"""WITH {DET_SQL}, v AS (SELECT domain, video, row_number() OVER (PARTITION BY domain ORDER BY video) - 1 AS v, count(*) OVER (PARTITION BY domain) AS n FROM (SELECT DISTINCT domain, video FROM det)),
p AS (SELECT frame, det, det.domain, det.video, (row_number() OVER (PARTITION BY det.domain, det.video ORDER BY frame, det) - 1) * n + v AS slot FROM det JOIN v ON v.domain = det.domain AND v.video = det.video) SELECT frame, det, slot, slot // 4 AS batch_id, slot % 4 AS position FROM p""")  # fmt: skip
def round_robin(spark, sf_dir):
    return reviews.round_robin(detections(spark, sf_dir), "domain", "video", [F.col("frame"), F.col("det")], 8).select("frame", "det", "slot", "batch_id", "position")


@query("trajectory_consistency", f"""WITH {DET_SQL}, c AS (SELECT * FROM det WHERE det % 5 <> 0), q AS (SELECT frame AS clip, det, x1 + det % 3 AS x1, y1, x2 + det % 3 AS x2, y2 FROM det WHERE det % 4 <> 0), cur AS (SELECT frame AS clip, det, x1, y1, x2, y2 FROM c),
pr AS (SELECT a.clip, a.det AS i, b.det AS j, least(a.x2, b.x2) - greatest(a.x1, b.x1) AS w, least(a.y2, b.y2) - greatest(a.y1, b.y1) AS h, (a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) AS s FROM cur a JOIN q b ON a.clip = b.clip),
io AS (SELECT clip, i, j, round(w * h / CAST(s - w * h AS double), 9) AS iou FROM pr WHERE w > 0 AND h > 0),
f1 AS (SELECT clip, i, j, iou FROM (SELECT *, row_number() OVER (PARTITION BY clip, i ORDER BY iou DESC, j) AS a, row_number() OVER (PARTITION BY clip, j ORDER BY iou DESC, i) AS b FROM io) WHERE a = 1 AND b = 1 AND iou >= 0.5),
h1 AS (SELECT io.* FROM io JOIN f1 ON f1.clip = io.clip AND f1.j = io.j), f2 AS (SELECT clip, i, j, iou FROM (SELECT *, row_number() OVER (PARTITION BY clip, j ORDER BY iou DESC, i) AS a, row_number() OVER (PARTITION BY clip, i ORDER BY iou DESC, j) AS b FROM h1) WHERE a = 1 AND b = 1 AND iou >= 0.5)
SELECT cur.clip, cur.det, coalesce(round(least(f1.iou, f2.iou), 6), 0) AS score FROM cur LEFT JOIN f1 ON f1.clip = cur.clip AND f1.i = cur.det LEFT JOIN f2 ON f2.clip = f1.clip AND f2.i = f1.i AND f2.j = f1.j""".replace("coalesce(round(least(f1.iou, f2.iou), 6), 0)", "CASE WHEN f2.iou IS NULL THEN 0 ELSE round(least(f1.iou, f2.iou), 6) END"))  # fmt: skip
def trajectory_consistency(spark, sf_dir):
    d = detections(spark, sf_dir).withColumnRenamed("frame", "clip")
    shift = F.col("det") % 3
    before = d.where("det % 4 <> 0").select("clip", "det", (F.col("x1") + shift).alias("x1"), "y1", (F.col("x2") + shift).alias("x2"), "y2")
    return rounded(reviews.trajectory_consistency([before, d.where("det % 5 <> 0").select("clip", "det", "x1", "y1", "x2", "y2")]))
