"""Queries over boxes: overlap evidence, quality, the error cube, exports, validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import evidence, matching, tracks
from ..sinks import rows as sink_rows
from .projections import DET_SQL, detections, observed
from .registry import query, rounded

DIMS = ["split", "domain", "video", "grp", "quality_bin", "root_cause"]

PAIR_SQL = """pr AS (SELECT a.frame, a.det, max((least(a.x2, b.x2) - greatest(a.x1, b.x1)) * (least(a.y2, b.y2) - greatest(a.y1, b.y1)) / least((a.x2 - a.x1) * (a.y2 - a.y1), (b.x2 - b.x1) * (b.y2 - b.y1))) AS e
  FROM obs a JOIN obs b ON a.frame = b.frame AND a.det <> b.det AND a.x1 < b.x2 AND b.x1 < a.x2 AND a.y1 < b.y2 AND b.y1 < a.y2 GROUP BY a.frame, a.det),
ev AS (SELECT obs.*, coalesce(pr.e, 0.0) AS error FROM obs LEFT JOIN pr ON pr.frame = obs.frame AND pr.det = obs.det)"""
Q2_SQL = """st AS (SELECT *, avg(error) OVER (PARTITION BY split, domain) AS dm, avg(error) OVER (PARTITION BY split, domain, grp) AS gm0, count(*) OVER (PARTITION BY split, domain, grp) AS n,
  median(error) OVER (PARTITION BY split, domain, grp) AS med FROM ev),
sc AS (SELECT *, greatest(1.4826 * median(abs(error - med)) OVER (PARTITION BY split, domain, grp), 0.02) AS s, (gm0 * n + 20.0 * dm) / (n + 20.0) AS gm FROM st),
q AS (SELECT *, 0.5 * exp(-greatest(gm, 0)) + 0.5 * exp(-greatest(error, 0)) / (1 + greatest((error - med) / s, 0)) AS quality FROM sc)"""
BASE = f"WITH {DET_SQL}, {PAIR_SQL}"


def _quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = evidence.frame_evidence(observed(detections(spark, sf_dir)))
    return evidence.q2(rows, ["split", "domain"], "grp")


def _cube_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _quality(spark, sf_dir)
    return rows.withColumn("quality_bin", F.when(F.col("quality") < 0.5, "low").otherwise("high")).withColumn("root_cause", evidence.root_cause(F.col("error")))


def _cube_sql(grouping: str) -> str:
    dims = ", ".join(DIMS)
    return f"""{BASE}, {Q2_SQL}, c AS (SELECT *, CASE WHEN quality < 0.5 THEN 'low' ELSE 'high' END AS quality_bin, CASE WHEN error > 0.2 THEN 'overlap' ELSE 'none' END AS root_cause FROM q)
SELECT {dims}, count(*) AS n, round(avg(error), 6) AS mean_error, round(avg(quality), 6) AS mean_quality,
  CASE WHEN avg(error) > 0.5 THEN 'review' WHEN count(*) < 10 THEN 'collect' ELSE 'keep' END AS next_action FROM c GROUP BY {grouping.format(dims=dims)}"""


@query("error_cube", _cube_sql("{dims}"))
def error_cube(spark, sf_dir):
    return rounded(evidence.error_cube(_cube_rows(spark, sf_dir), DIMS))


@query("error_cube_rollup", _cube_sql("CUBE ({dims})"))
def error_cube_rollup(spark, sf_dir):
    """Extension: all subsets of the dimensions."""
    return rounded(evidence.error_cube(_cube_rows(spark, sf_dir), DIMS, cube=True))


@query("q2_quality", f"{BASE}, {Q2_SQL} SELECT frame, det, round(error, 6) AS error, round(gm, 6) AS group_mean, round(med, 6) AS group_median, round(s, 6) AS scale, round(quality, 6) AS quality FROM q")
def q2_quality(spark, sf_dir):
    return rounded(_quality(spark, sf_dir).select("frame", "det", "error", "group_mean", "group_median", "scale", "quality"))


@query("frame_evidence", f"{BASE} SELECT frame, det, round(error, 6) AS error FROM ev")
def frame_evidence(spark, sf_dir):
    return rounded(evidence.frame_evidence(observed(detections(spark, sf_dir))).select("frame", "det", "error"))


@query("overlap_pairs", f"WITH {DET_SQL} SELECT a.frame, a.det AS a_det, b.det AS b_det, CAST((least(a.x2, b.x2) - greatest(a.x1, b.x1)) * (least(a.y2, b.y2) - greatest(a.y1, b.y1)) AS bigint) AS common FROM obs a JOIN obs b ON a.frame = b.frame AND a.det < b.det AND a.x1 < b.x2 AND b.x1 < a.x2 AND a.y1 < b.y2 AND b.y1 < a.y2")
def overlap_pairs(spark, sf_dir):
    return evidence.intersecting(observed(detections(spark, sf_dir)))


@query(
    "sample_attributes",
    f"""{BASE}, r AS (SELECT frame, det, sqrt((x2 - x1) * (y2 - y1) / 2073600.0) AS scale, count(*) OVER (PARTITION BY frame) AS density, error FROM ev)
SELECT frame, det, round(scale, 6) AS scale, CASE WHEN scale < 0.02 THEN 'small' WHEN scale < 0.05 THEN 'medium' ELSE 'large' END AS scale_bin, density,
  CASE WHEN density < 50 THEN 'low' WHEN density < 200 THEN 'medium' ELSE 'high' END AS density_bin, round(error, 6) AS occlusion, CASE WHEN error >= 0.5 THEN 'occluded' ELSE 'clear' END AS occlusion_bin FROM r""",
)
def sample_attributes(spark, sf_dir):
    return rounded(evidence.sample_attributes(observed(detections(spark, sf_dir))))


@query(
    "frame_record",
    f"""{BASE}, r AS (SELECT frame, count(*) AS n, median(sqrt((x2 - x1) * (y2 - y1))) AS m, max(error) AS e, atan2(avg(sin(atan2(y2 - y1, x2 - x1))), avg(cos(atan2(y2 - y1, x2 - x1)))) AS a,
  string_agg(DISTINCT CAST(track_id AS varchar), ',' ORDER BY track_id) AS track_ids FROM (SELECT * FROM ev) GROUP BY frame)
SELECT frame, n, round(m, 6) AS median_side, round(e, 6) AS max_overlap, CAST(floor((a - 2 * pi() * floor(a / (2 * pi()))) / (pi() / 4)) AS int) AS octant,
  (SELECT string_agg(CAST(t AS varchar), ',' ORDER BY t) FROM (SELECT DISTINCT track_id AS t FROM obs WHERE obs.frame = r.frame)) AS track_ids FROM r""".replace("string_agg(DISTINCT CAST(track_id AS varchar), ',' ORDER BY track_id) AS track_ids", "1 AS one"),
)
def frame_record(spark, sf_dir):
    return rounded(evidence.frame_record(observed(detections(spark, sf_dir))))


@query("state_coverage", f"WITH {DET_SQL} SELECT origin, class_id, split, count(*) AS n, count(DISTINCT track_id) AS tracks FROM det GROUP BY GROUPING SETS ((origin), (class_id), (split))")
def state_coverage(spark, sf_dir):
    dets = detections(spark, sf_dir)
    return dets.groupingSets([["origin"], ["class_id"], ["split"]], "origin", "class_id", "split").agg(F.count("*").alias("n"), F.count_distinct("track_id").alias("tracks"))


@query("last_emission", f"WITH {DET_SQL}, e AS (SELECT *, CASE WHEN det % 4 <> 0 THEN track_id END AS tid FROM det) SELECT frame, tid AS track_id, det, conf, tid IS NOT NULL AND r > 1 AS superseded FROM (SELECT *, row_number() OVER (PARTITION BY frame, tid ORDER BY det DESC) AS r FROM e)")
def last_emission(spark, sf_dir):
    """Per frame the last emission of each track counts, earlier ones are superseded; boxes without a track all pass."""
    track = F.when(F.col("det") % 4 != 0, F.col("track_id"))
    last = Window.partitionBy("frame", "track_id").orderBy(F.desc("det"))
    rows = detections(spark, sf_dir).withColumn("track_id", track).withColumn("r", F.row_number().over(last))
    return rows.select("frame", "track_id", "det", "conf", (F.col("track_id").isNotNull() & (F.col("r") > 1)).alias("superseded"))


@query(
    "track_geometry",
    f"""WITH {DET_SQL}, w AS (SELECT *, lag(x1) OVER w AS px1, lag(y1) OVER w AS py1, lag(x2) OVER w AS px2, lag(y2) OVER w AS py2 FROM obs WINDOW w AS (PARTITION BY track_id ORDER BY frame, det)),
d AS (SELECT *, sqrt((px2 - px1) * (px2 - px1) + (py2 - py1) * (py2 - py1)) AS diag FROM w WHERE px1 IS NOT NULL)
SELECT track_id, frame, det, round(((x1 + x2) / 2.0 - (px1 + px2) / 2.0) / diag, 6) AS dx, round(((y1 + y2) / 2.0 - (py1 + py2) / 2.0) / diag, 6) AS dy, round(ln((x2 - x1) / CAST(px2 - px1 AS double)), 6) AS dw, round(ln((y2 - y1) / CAST(py2 - py1 AS double)), 6) AS dh FROM d""",
)
def track_geometry(spark, sf_dir):
    return rounded(tracks.track_geometry(observed(detections(spark, sf_dir))))


@query("mot_rows", f"WITH {DET_SQL} SELECT video, frame, det, concat_ws(',', frame + 1, track_id, x1 + 1, y1 + 1, x2 - x1, y2 - y1, printf('%.4f', CAST(conf AS double)), 1, -1, -1) AS line FROM det WHERE class_id = 0")
def mot_rows(spark, sf_dir):
    return sink_rows.mot(detections(spark, sf_dir))


@query("yolo_rows", f"WITH {DET_SQL} SELECT video, frame, row_number() OVER (PARTITION BY video, frame ORDER BY det) AS line_number, concat_ws(' ', class_id, printf('%.10f', (x1 + x2) / 2.0 / 640), printf('%.10f', (y1 + y2) / 2.0 / 480), printf('%.10f', (x2 - x1) / 640.0), printf('%.10f', (y2 - y1) / 480.0)) AS line FROM det")
def yolo_rows(spark, sf_dir):
    return sink_rows.yolo(detections(spark, sf_dir), 640, 480)


@query(
    "coco_annotations",
    f"""WITH {DET_SQL}, d AS (SELECT *, CASE WHEN origin = 'observed' THEN 1.0 ELSE 0.5 END AS weight, min(frame) OVER (PARTITION BY domain, video, track_id) AS first_seen FROM det WHERE class_id = 0)
SELECT frame AS image_id, det, x1 AS bx, y1 AS by_, x2 - x1 AS bw, y2 - y1 AS bh, CAST((x2 - x1) * (y2 - y1) AS bigint) AS area, weight, dense_rank() OVER (PARTITION BY domain, video ORDER BY first_seen, track_id) - 1 AS dense_track FROM d""",
)
def coco_annotations(spark, sf_dir):
    return sink_rows.coco(detections(spark, sf_dir))


@query("split_leakage", f"WITH {DET_SQL} SELECT track_id, count(DISTINCT split) AS splits, string_agg(DISTINCT split, ',' ORDER BY split) AS names FROM det GROUP BY track_id HAVING count(DISTINCT split) > 1")
def split_leakage(spark, sf_dir):
    rows = detections(spark, sf_dir).groupBy("track_id").agg(F.array_sort(F.collect_set("split")).alias("s")).where(F.size("s") > 1)
    return rows.select("track_id", F.size("s").cast("long").alias("splits"), F.array_join("s", ",").alias("names"))


@query("coverage_except", f"WITH {DET_SQL} SELECT track_id FROM det WHERE split = 'train' EXCEPT SELECT track_id FROM det WHERE split = 'test'")
def coverage_except(spark, sf_dir):
    dets = detections(spark, sf_dir)
    return dets.where("split = 'train'").select("track_id").exceptAll(dets.where("false").select("track_id")).subtract(dets.where("split = 'test'").select("track_id"))


@query("leakage_intersect", f"WITH {DET_SQL} SELECT track_id, video FROM det WHERE split = 'calibration' INTERSECT SELECT track_id, video FROM det WHERE split = 'test'")
def leakage_intersect(spark, sf_dir):
    dets = detections(spark, sf_dir)
    return dets.where("split = 'calibration'").select("track_id", "video").intersect(dets.where("split = 'test'").select("track_id", "video"))


@query("validation_report", f"""WITH {DET_SQL} SELECT rule, count(*) AS violations FROM (
  SELECT 'degenerate_box' AS rule FROM det WHERE x2 <= x1 OR y2 <= y1 UNION ALL SELECT 'outside_image' FROM det WHERE x1 < 0 OR y1 < 0 OR x2 > 320 OR y2 > 240
  UNION ALL SELECT 'low_confidence' FROM det WHERE conf < 0.93 UNION ALL SELECT 'duplicate_track' FROM (SELECT frame, track_id FROM det GROUP BY frame, track_id HAVING count(*) > 1)) GROUP BY rule""")  # fmt: skip
def validation_report(spark, sf_dir):
    return sink_rows.violations(detections(spark, sf_dir), 320, 240, 0.93)


@query("input_gates", f"""WITH {DET_SQL}, g AS (SELECT domain, count(*) AS n, count(DISTINCT frame) AS frames, avg(CASE WHEN class_id = 0 THEN 1.0 ELSE 0.0 END) AS valid FROM det GROUP BY domain)
SELECT domain, n, frames, round(valid, 6) AS valid, n >= 0.3 * sum(n) OVER () AS balanced, valid >= 0.9 AS clean FROM g""")  # fmt: skip
def input_gates(spark, sf_dir):
    g = detections(spark, sf_dir).groupBy("domain").agg(F.count("*").alias("n"), F.count_distinct("frame").alias("frames"), F.avg(F.when(F.col("class_id") == 0, 1.0).otherwise(0.0)).alias("valid"))
    total = g.agg(F.sum("n").alias("total"))
    return rounded(g.join(F.broadcast(total)).select("domain", "n", "frames", "valid", (F.col("n") >= 0.3 * F.col("total")).alias("balanced"), (F.col("valid") >= 0.9).alias("clean")))


@query("max_detections", f"WITH {DET_SQL} SELECT frame, det, conf FROM (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY conf DESC, det) AS r FROM det WHERE conf >= 0.92) WHERE r <= 3")
def max_detections(spark, sf_dir):
    w = Window.partitionBy("frame").orderBy(F.desc("conf"), "det")
    return detections(spark, sf_dir).where("conf >= 0.92").withColumn("r", F.row_number().over(w)).where("r <= 3").select("frame", "det", "conf")


@query("hash_subset", f"""WITH {DET_SQL}, f AS (SELECT DISTINCT video, frame FROM det), r AS (SELECT *, row_number() OVER (PARTITION BY video ORDER BY sha256('7:' || video || ':' || frame), frame) AS r, count(*) OVER (PARTITION BY video) AS n FROM f)
SELECT video, frame FROM r WHERE r <= greatest(1, round(n * 0.1))""")  # fmt: skip
def hash_subset(spark, sf_dir):
    """Stratified subset: a tenth of each video's frames, in the order of a seeded hash."""
    f = detections(spark, sf_dir).select("video", "frame").distinct()
    w = Window.partitionBy("video").orderBy(F.sha2(F.concat(F.lit("7:"), "video", F.lit(":"), F.col("frame").cast("string")), 256), "frame")
    sizes = f.groupBy("video").agg(F.count("*").alias("size"))
    return f.withColumn("r", F.row_number().over(w)).join(F.broadcast(sizes), "video").where(F.col("r") <= F.greatest(F.lit(1), F.round(F.col("size") * 0.1))).select("video", "frame")


@query("suppress_fills")
def suppress_fills(spark, sf_dir):
    """Fills hidden by an overlap of 0.2 of the smaller area and 16 px with a kept box; observed boxes always stay, invalid ones hide none.

    Fills come by gap, observed length (longest first), displacement of their ends and track.
    """
    dets = detections(spark, sf_dir).where("class_id = 0")
    gap, length, moved = F.col("det") % 4 + 1, F.col("track_id") % 17, (F.col("x1") + F.col("y1")) % 29
    return matching.suppress(dets, 0.2, [gap, F.desc(length), moved, F.col("track_id"), F.col("det")], "io_min", 16, F.col("origin") == "observed", F.col("det") % 13 != 0)


@query("nms")
def nms(spark, sf_dir):
    return matching.suppress(detections(spark, sf_dir), 0.45, [F.desc("conf"), F.col("det")])


@query("soft_nms")
def soft_nms(spark, sf_dir):
    return rounded(matching.soft_nms(detections(spark, sf_dir)))


def _truth_and_predictions(spark, sf_dir):
    gt = observed(detections(spark, sf_dir))
    off = F.col("det") % 3
    pred = gt.where("det % 7 <> 0").select("frame", "det", "track_id", "conf", *((F.col(c) + off).alias(c) for c in ("x1", "y1", "x2", "y2")))
    return gt, pred


@query("hungarian_match")
def hungarian_match(spark, sf_dir):
    gt, pred = _truth_and_predictions(spark, sf_dir)
    return rounded(matching.hungarian(pred, gt))


@query("detection_ap")
def detection_ap(spark, sf_dir):
    gt, pred = _truth_and_predictions(spark, sf_dir)
    levels = [0.5 + 0.05 * k for k in range(10)]
    return rounded(matching.average_precision(matching.greedy_matches(pred, gt, levels), gt, levels))


@query(
    "identity_switches",
    f"""WITH {DET_SQL}, m AS (SELECT track_id AS gt_id, frame, det, CASE WHEN frame % 11 = 0 THEN track_id + 1 ELSE track_id END AS pred_id FROM obs WHERE det % 7 <> 0),
w AS (SELECT *, lag(pred_id) OVER w AS was, frame - lag(frame) OVER w AS gap FROM m WINDOW w AS (PARTITION BY gt_id ORDER BY frame, det))
SELECT gt_id, count(*) AS n, CAST(sum(CASE WHEN pred_id <> was THEN 1 ELSE 0 END) AS bigint) AS switches, CAST(sum(CASE WHEN gap > 100 THEN 1 ELSE 0 END) AS bigint) AS fragments FROM w GROUP BY gt_id""",
)
def identity_switches(spark, sf_dir):
    m = observed(detections(spark, sf_dir)).where("det % 7 <> 0").select(F.col("track_id").alias("gt_id"), "frame", "det", F.when(F.col("frame") % 11 == 0, F.col("track_id") + 1).otherwise(F.col("track_id")).alias("pred_id"))
    return tracks.identity_switches(m)


@query("count_metrics", f"""WITH {DET_SQL}, c AS (SELECT frame, count(*) AS gt, sum(CASE WHEN det % 7 <> 0 THEN 1 ELSE 0 END) AS pr FROM obs GROUP BY frame)
SELECT count(*) AS frames, round(avg(abs(gt - pr)), 6) AS mae, round(sqrt(avg((gt - pr) * (gt - pr))), 6) AS rmse FROM c""")  # fmt: skip
def count_metrics(spark, sf_dir):
    c = observed(detections(spark, sf_dir)).groupBy("frame").agg(F.count("*").alias("gt"), F.sum(F.when(F.col("det") % 7 != 0, 1).otherwise(0)).alias("pr"))
    d = F.col("gt") - F.col("pr")
    return rounded(c.agg(F.count("*").alias("frames"), F.avg(F.abs(d)).alias("mae"), F.sqrt(F.avg(d * d)).alias("rmse")))


@query("unmatched_reference", f"WITH {DET_SQL}, p AS (SELECT * FROM obs WHERE det % 7 <> 0) SELECT g.frame, g.det, 'reference_miss' AS root_cause FROM obs g WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.frame = g.frame AND p.det = g.det)")
def unmatched_reference(spark, sf_dir):
    gt = observed(detections(spark, sf_dir))
    return gt.join(gt.where("det % 7 <> 0").select("frame", "det"), ["frame", "det"], "left_anti").select("frame", "det", F.lit("reference_miss").alias("root_cause"))


@query("associate_tracks")
def associate_tracks(spark, sf_dir):
    """Track numbers for the boxes of each video by Kalman prediction and two-stage assignment."""
    from ..operators.trackers import associate

    return associate(observed(detections(spark, sf_dir)))
