"""Queries of audits and evaluation reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import duplicates, reports
from .entity_queries import ENT_SQL, ents
from .projections import DET_SQL, REC_SQL, detections, observed, records
from .registry import query, rounded


@query("dataset_summary", f"WITH {ENT_SQL} SELECT split, domain, count(DISTINCT frame) AS frames, count(DISTINCT video) AS videos, count(*) AS instances, CAST(sum(CASE WHEN head_x IS NOT NULL THEN 1 ELSE 0 END) AS bigint) AS posed, count(DISTINCT track_id) AS tracks FROM ent GROUP BY 1, 2")
def dataset_summary(spark, sf_dir):
    return reports.dataset_summary(ents(spark, sf_dir))


_TWIN = """tw0 AS (SELECT a.frame, a.det AS a, b.det AS b, (least(a.x2, b.x2) - greatest(a.x1, b.x1)) AS w, (least(a.y2, b.y2) - greatest(a.y1, b.y1)) AS h, (a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) AS s FROM det a JOIN det b ON a.frame = b.frame AND a.det < b.det),
tw AS (SELECT frame, unnest([a, b]) AS det FROM tw0 WHERE w > 0 AND h > 0 AND w * h / CAST(s - w * h AS double) >= 0.3)"""


@query("input_audit", f"""WITH {DET_SQL}, {_TWIN}, c AS (SELECT split, frame, count(*) AS n FROM det GROUP BY 1, 2), f AS (SELECT split, count(*) AS frames, CAST(sum(n) AS bigint) AS boxes, quantile_cont(n, 0.5) AS median_boxes, quantile_cont(n, 0.9) AS p90_boxes FROM c GROUP BY 1),
z AS (SELECT split, quantile_cont(sqrt((x2 - x1) * (y2 - y1)), 0.5) AS median_scale, avg(CASE WHEN EXISTS (SELECT 1 FROM tw WHERE tw.frame = det.frame AND tw.det = det.det) THEN 1.0 ELSE 0.0 END) AS twin_rate FROM det GROUP BY 1)
SELECT split, frames, boxes, round(median_boxes, 6) AS median_boxes, round(p90_boxes, 6) AS p90_boxes, round(median_scale, 6) AS median_scale, round(twin_rate, 6) AS twin_rate FROM f JOIN z USING (split)""")  # fmt: skip
def input_audit(spark, sf_dir):
    d = detections(spark, sf_dir)
    near = duplicates.pairs(d).where("iou >= 0.3")
    return rounded(reports.input_audit(d, near.select("frame", F.explode(F.array("a", "b")).alias("det"))))


@query("split_drift", f"""WITH {DET_SQL}, b AS (SELECT split, video, count(*) AS n FROM det GROUP BY 1, 2), w AS (SELECT video, sum(n) AS a FROM b GROUP BY 1), t AS (SELECT split, sum(n) AS s FROM b GROUP BY 1), g AS (SELECT t.split, w.video, a, s, (SELECT sum(n) FROM b) AS r FROM w, t)
SELECT g.split, round(sum(abs(coalesce(n, 0) / CAST(s AS double) - a / CAST(r AS double))) / 2, 6) AS drift FROM g LEFT JOIN b ON b.split = g.split AND b.video = g.video GROUP BY 1""")  # fmt: skip
def split_drift(spark, sf_dir):
    return rounded(reports.split_drift(detections(spark, sf_dir), "video"))


@query("score_curve", f"""WITH {REC_SQL}, l AS (SELECT domain, size % 97 AS score, sum(correct) AS tp, count(*) AS n FROM rec WHERE correct IS NOT NULL GROUP BY 1, 2), c AS (SELECT domain, score, sum(tp) OVER d AS tp, sum(n) OVER d AS n, sum(tp) OVER (PARTITION BY domain) AS t FROM l WINDOW d AS (PARTITION BY domain ORDER BY score DESC)),
p AS (SELECT domain, score, tp / CAST(n AS double) AS pr, tp / CAST(t AS double) AS re FROM c WHERE t > 0), e AS (SELECT *, max(pr) OVER (PARTITION BY domain ORDER BY score DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS env, re - coalesce(lag(re) OVER (PARTITION BY domain ORDER BY score DESC), 0) AS st, round(2 * pr * re / greatest(pr + re, 1e-12), 9) AS f1 FROM p),
b AS (SELECT domain, f1, score, row_number() OVER (PARTITION BY domain ORDER BY f1 DESC, score DESC) AS k FROM e), a AS (SELECT domain, round(sum(env * st), 6) AS area FROM e GROUP BY 1)
SELECT a.domain, round(f1, 6) AS best_f1, score AS threshold, area FROM a JOIN b ON b.domain = a.domain AND k = 1""")  # fmt: skip
def score_curve(spark, sf_dir):
    rows = records(spark, sf_dir).withColumn("score", F.col("size") % 97)
    return rounded(reports.score_curve(rows, "domain", "score", F.col("correct") == 1))


@query("constrained_sweep", f"""WITH {REC_SQL}, g AS (SELECT a.v AS least_one, b.v AS least_two FROM (SELECT unnest([0.0, 0.1, 0.3]) AS v) a, (SELECT unnest([0.0, 0.1, 0.3]) AS v) b),
s AS (SELECT least_one, least_two, sum(correct) AS t, sum(CASE WHEN one >= least_one AND two >= least_two THEN 1 ELSE 0 END) AS k, sum(CASE WHEN one >= least_one AND two >= least_two THEN correct ELSE 0 END) AS tp FROM (SELECT correct, size % 50 / 50.0 AS one, size % 30 / 30.0 AS two FROM rec WHERE correct IS NOT NULL), g GROUP BY 1, 2),
r AS (SELECT least_one, least_two, tp / CAST(greatest(t, 1) AS double) AS recall, tp / CAST(greatest(k, 1) AS double) AS precision FROM s), m AS (SELECT *, max(recall) OVER () AS most FROM r)
SELECT CAST(least_one AS double) AS least_one, CAST(least_two AS double) AS least_two, round(recall, 6) AS recall, round(precision, 6) AS precision, row_number() OVER (ORDER BY round(precision, 9) DESC, round(recall, 9) DESC, least_one, least_two) AS rank FROM m WHERE recall >= most - 0.2""")  # fmt: skip
def constrained_sweep(spark, sf_dir):
    rows = records(spark, sf_dir).withColumns({"one": F.col("size") % 50 / 50.0, "two": F.col("size") % 30 / 30.0})
    return rounded(reports.constrained_sweep(rows, ["one", "two"], [0.0, 0.1, 0.3], F.col("correct") == 1, 0.2))


_LIMITS = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.999916758850712, 0.9999897508033253]
_CASE = " ".join(f"WHEN u < {v:.17g}e0 THEN {k}" for k, v in enumerate(_LIMITS))


@query("bootstrap_interval", f"""WITH {DET_SQL}, v AS (SELECT video, avg(CASE WHEN det % 7 <> 0 THEN 1.0e0 ELSE 0.0e0 END) AS v FROM obs GROUP BY 1), d AS (SELECT video, v, k, CAST('0x' || substr(md5(video || '-' || k), 1, 8) AS bigint) / 4294967296.0e0 AS u FROM v, (SELECT unnest(range(1, 201)) AS k)),
m AS (SELECT k, sum(w * v) / sum(w) AS m FROM (SELECT k, v, CASE {_CASE} ELSE 8 END AS w FROM d) GROUP BY k), i AS (SELECT quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high FROM m WHERE isfinite(m))
SELECT n, round(mean, 6) AS mean, round(worst, 6) AS worst, round(low, 6) AS low, round(high, 6) AS high FROM (SELECT count(*) AS n, avg(v) AS mean, min(v) AS worst FROM v), i""")  # fmt: skip
def bootstrap_interval(spark, sf_dir):
    recall = observed(detections(spark, sf_dir)).groupBy("video").agg(F.avg(F.when(F.col("det") % 7 != 0, 1.0).otherwise(0.0)).alias("recall"))
    return rounded(reports.bootstrap_interval(recall, "video", "recall", 200))


@query("evaluation_report", f"""WITH {DET_SQL}, s AS (SELECT domain, video, grp, count(*) AS truths, CAST(sum(CASE WHEN det % 7 <> 0 THEN 1 ELSE 0 END) AS bigint) AS tp FROM obs GROUP BY 1, 2, 3)
SELECT *, round(tp / CAST(truths AS double), 6) AS recall, round((SELECT min(tp / CAST(truths AS double)) FROM s), 6) AS worst_recall FROM s""".replace("SELECT *, round(tp", "SELECT domain, video, grp, truths, tp, round(tp"))  # fmt: skip
def evaluation_report(spark, sf_dir):
    m = observed(detections(spark, sf_dir)).withColumn("hit", F.col("det") % 7 != 0)
    return rounded(reports.evaluation_report(m, ["domain", "video", "grp"], F.lit(True)))


@query("readback_audit", f"""WITH {DET_SQL}, o AS (SELECT frame, det, video, track_id + CASE WHEN frame % 9 = 0 THEN 1 ELSE 0 END AS track_id, x1 + CASE WHEN frame % 50 = 0 THEN 1 ELSE 0 END AS x1, y1, x2, y2 FROM det WHERE det % 7 <> 0),
st AS (SELECT frame - lag(frame) OVER w AS gap, sqrt(pow((x1 + x2) / 2.0 - lag((x1 + x2) / 2.0) OVER w, 2) + pow((y1 + y2) / 2.0 - lag((y1 + y2) / 2.0) OVER w, 2)) AS moved FROM o WINDOW w AS (PARTITION BY video, track_id ORDER BY frame, det))
SELECT (SELECT count(*) FROM det) AS source_rows, (SELECT count(*) FROM o) AS output_rows, (SELECT count(*) FROM det WHERE det % 7 = 0) AS missing, 0 AS extra, (SELECT count(*) FROM o WHERE frame % 50 = 0) AS changed,
  (SELECT count(*) FROM (SELECT 1 FROM o GROUP BY video, frame, track_id HAVING count(*) > 1)) AS doubled, count(*) FILTER (WHERE gap > 0 AND moved / gap * 30 > 220) AS too_fast, count(*) FILTER (WHERE gap = 0) AS not_later,
  quantile_disc(CASE WHEN gap > 0 THEN round(moved / gap * 30, 6) END, 0.95) AS p95_speed, quantile_disc(CASE WHEN gap > 0 THEN round(moved / gap * 30, 6) END, 0.99) AS p99_speed FROM st WHERE gap IS NOT NULL""")  # fmt: skip
def readback_audit(spark, sf_dir):
    d = detections(spark, sf_dir).select("frame", "det", "video", "track_id", "x1", "y1", "x2", "y2")
    o = d.where("det % 7 <> 0").withColumns({"track_id": F.col("track_id") + (F.col("frame") % 9 == 0).cast("int"), "x1": F.col("x1") + (F.col("frame") % 50 == 0).cast("int")})
    return rounded(reports.readback_audit(d, o, ["frame", "det"], ["x1", "y1", "x2", "y2"]))


@query("endpoint_hits", f"""WITH {ENT_SQL} SELECT domain, count(*) AS points, round(avg(CASE WHEN det % 5 <> 0 AND sqrt(pow(det % 3 * 4, 2)) / sqrt(pow(x2 - x1, 2) + pow(y2 - y1, 2)) < 0.1 THEN 1.0 ELSE 0.0 END), 6) AS pck_0_1,
  round(avg(CASE WHEN det % 5 <> 0 AND sqrt(pow(det % 3 * 4, 2)) / sqrt(pow(x2 - x1, 2) + pow(y2 - y1, 2)) < 0.2 THEN 1.0 ELSE 0.0 END), 6) AS pck_0_2 FROM ent WHERE head_x IS NOT NULL GROUP BY domain""")  # fmt: skip
def endpoint_hits(spark, sf_dir):
    e = ents(spark, sf_dir)
    seen = lambda v: F.when(F.col("det") % 5 != 0, v)
    rows = e.select("domain", F.col("head_x").alias("gx"), F.col("head_y").alias("gy"), seen(F.col("head_x") + F.col("det") % 3 * 4).alias("px"), seen(F.col("head_y")).alias("py"), F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")).alias("diag"))
    return rounded(reports.endpoint_hits(rows, "domain"))


@query("behaviour_report", """WITH p AS (SELECT event_id, CASE WHEN event_id % 9 = 0 THEN 'click' ELSE event_type END AS label, event_id % 4 <> 0 AS e FROM events WHERE event_id % 7 <> 0), t AS (SELECT event_id, event_type AS label FROM events WHERE event_id % 5 <> 0),
b AS (SELECT p.label AS p, t.label AS t, coalesce(p.label = t.label, false) AS s FROM p FULL JOIN t ON p.event_id = t.event_id), l AS (SELECT p AS label, CASE WHEN s THEN 1 ELSE 0 END AS tp, CASE WHEN s THEN 0 ELSE 1 END AS fp, 0 AS fn FROM b WHERE p IS NOT NULL UNION ALL SELECT t, 0, 0, CASE WHEN s THEN 0 ELSE 1 END FROM b WHERE t IS NOT NULL),
r AS (SELECT label, CAST(sum(tp) AS bigint) AS tp, CAST(sum(fp) AS bigint) AS fp, CAST(sum(fn) AS bigint) AS fn, 2 * sum(tp) / CAST(greatest(2 * sum(tp) + sum(fp) + sum(fn), 1) AS double) AS f1 FROM l GROUP BY label)
SELECT label, tp, fp, fn, round(f1, 6) AS f1, round((SELECT avg(f1) FROM r), 6) AS macro_f1, round((SELECT avg(CASE WHEN e THEN 1.0 ELSE 0.0 END) FROM p), 6) AS completeness FROM r""")  # fmt: skip
def behaviour_report(spark, sf_dir):
    from .projections import table

    e = table(spark, sf_dir, "events")
    label = F.when(F.col("event_id") % 9 == 0, "click").otherwise(F.col("event_type"))
    pred = e.where("event_id % 7 <> 0").select("event_id", label.alias("label"), F.when(F.col("event_id") % 4 != 0, "seen").alias("evidence"))
    return rounded(reports.behaviour_report(pred, e.where("event_id % 5 <> 0").select("event_id", F.col("event_type").alias("label"))))


@query("split_frame_gaps", f"WITH {DET_SQL} SELECT a.video, min(abs(a.frame - b.frame)) AS least_gap FROM (SELECT DISTINCT video, frame, split FROM det) a JOIN (SELECT DISTINCT video, frame, split FROM det) b ON a.video = b.video AND a.split <> b.split GROUP BY 1 HAVING min(abs(a.frame - b.frame)) <= 20")
def split_frame_gaps(spark, sf_dir):
    return reports.split_frame_gaps(detections(spark, sf_dir))


@query("near_by_length", f"""WITH {ENT_SQL}, l AS (SELECT frame, det, (x1 + x2) / 2.0 AS cx, (y1 + y2) / 2.0 AS cy, sqrt(pow(head_x - tail_x, 2) + pow(head_y - tail_y, 2)) AS len FROM ent WHERE head_x IS NOT NULL),
p AS (SELECT a.frame, a.det AS a, b.det AS b, sqrt(pow(a.cx - b.cx, 2) + pow(a.cy - b.cy, 2)) AS d, (a.len + b.len) / 2 AS m FROM l a JOIN l b ON a.frame = b.frame AND a.det < b.det WHERE a.len > 0 AND b.len > 0) SELECT frame, a, b, round(d / m, 6) AS distance FROM p WHERE d <= 1.5 * m""")  # fmt: skip
def near_by_length(spark, sf_dir):
    from ..operators import entities

    return rounded(reports.near_by_length(entities.with_pose(ents(spark, sf_dir))))
