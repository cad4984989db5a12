"""Queries of entity rows: pose, supervision, geometry, annotation packages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import entities
from .projections import DET_SQL, detections
from .registry import query, rounded

STATUSES = ["human", "human_confirmed", "soft_positive", "ignore", "invalid", "unconfirmed"]
_POINT = "CASE WHEN (frame + det) % 4 <> 0 THEN"
ENT_SQL = f"""{DET_SQL}, ent AS (SELECT *, {STATUSES!r}[CAST((frame + det) % 6 + 1 AS int)] AS label_status, conf AS quality,
  CASE WHEN frame % 13 = 0 THEN 'suspect' ELSE 'valid' END AS frame_status, frame % 5 = 0 AS complete,
  {_POINT} x1 + det % 9 - 4.0 END AS head_x, {_POINT} y1 + det % 7 - 3.0 END AS head_y, {_POINT} ((frame + det) % 3) / 4.0 END AS head_c,
  {_POINT} x2 + det % 5 - 2.0 END AS tail_x, {_POINT} y2 + 1.0 END AS tail_y, {_POINT} ((frame * 3 + det) % 5) / 8.0 END AS tail_c FROM det)"""
_H, _T = "(head_x IS NOT NULL AND head_c > 0)", "(tail_x IS NOT NULL AND tail_c > 0)"


def ents(spark, sf_dir):
    """Boxes with label states, frame states and two points each, which every fourth box lacks."""
    k = F.col("frame") + F.col("det")
    has = lambda v: F.when(k % 4 != 0, v)
    return detections(spark, sf_dir).withColumns({
        "label_status": F.element_at(F.array(*map(F.lit, STATUSES)), (k % 6 + 1).cast("int")), "quality": F.col("conf"),
        "frame_status": F.when(F.col("frame") % 13 == 0, "suspect").otherwise("valid"), "complete": F.col("frame") % 5 == 0,
        "head_x": has(F.col("x1") + F.col("det") % 9 - 4.0), "head_y": has(F.col("y1") + F.col("det") % 7 - 3.0), "head_c": has(k % 3 / 4.0),
        "tail_x": has(F.col("x2") + F.col("det") % 5 - 2.0), "tail_y": has(F.col("y2") + 1.0), "tail_c": has((F.col("frame") * 3 + F.col("det")) % 5 / 8.0),
    })


@query("entity_pose", f"""WITH {ENT_SQL} SELECT frame, det, round(sqrt(pow(head_x - tail_x, 2) + pow(head_y - tail_y, 2)), 6) AS length, round(atan2(head_y - tail_y, head_x - tail_x), 6) AS angle,
  CASE WHEN head_x IS NOT NULL THEN round(least(head_c, tail_c), 6) END AS pose_conf FROM ent""")  # fmt: skip
def entity_pose(spark, sf_dir):
    return rounded(entities.with_pose(ents(spark, sf_dir)).select("frame", "det", "length", "angle", F.col("pose_conf").cast("double").alias("pose_conf")))


@query("supervision_masks", f"""WITH {ENT_SQL} SELECT frame, det, CASE WHEN class_id = 0 THEN track_id END AS track_id, CASE WHEN class_id <> 0 THEN track_id END AS source_track_id,
  class_id <> 0 OR label_status <> 'invalid' AS for_detection, class_id = 0 AND ({_H} OR {_T}) AS for_pose, class_id = 0 AS for_tracking, class_id = 0 AND det % 3 = 0 AS for_behavior FROM ent""")  # fmt: skip
def supervision_masks(spark, sf_dir):
    rows = entities.with_supervision(ents(spark, sf_dir), F.col("det") % 3 == 0)
    return rows.select("frame", "det", "track_id", "source_track_id", "for_detection", "for_pose", "for_tracking", "for_behavior")


def _ok(p: str) -> str:
    return f"({_H if p == 'head' else _T} AND {p}_x >= 0 AND {p}_x < 300 AND {p}_y >= 0 AND {p}_y < 200)"


@query("geometry_repair", f"""WITH {ENT_SQL}, c AS (SELECT *, greatest(0.0, least(300.0, x1)) AS a1, greatest(0.0, least(200.0, y1)) AS b1, greatest(0.0, least(300.0, x2)) AS a2, greatest(0.0, least(200.0, y2)) AS b2 FROM ent)
SELECT frame, det, CAST(a1 AS double) AS x1, CAST(b1 AS double) AS y1, CAST(a2 AS double) AS x2, CAST(b2 AS double) AS y2, CASE WHEN a2 <= a1 OR b2 <= b1 THEN 'excluded' WHEN a1 <> x1 OR b1 <> y1 OR a2 <> x2 OR b2 <> y2 THEN 'clipped' ELSE 'none' END AS action,
  CAST(CASE WHEN {_ok('head')} THEN head_x ELSE 0 END AS double) AS head_x, CASE WHEN {_ok('head')} THEN 2 ELSE 0 END AS head_v, CAST(CASE WHEN {_ok('tail')} THEN tail_y ELSE 0 END AS double) AS tail_y, CASE WHEN {_ok('tail')} THEN 2 ELSE 0 END AS tail_v FROM c""")  # fmt: skip
def geometry_repair(spark, sf_dir):
    rows = entities.repaired(ents(spark, sf_dir), 300, 200)
    return rows.select("frame", "det", "x1", "y1", "x2", "y2", "action", F.col("head_x").cast("double").alias("head_x"), "head_v", F.col("tail_y").cast("double").alias("tail_y"), "tail_v")


@query("training_annotations", f"""WITH {ENT_SQL}, u AS (SELECT *, label_status <> 'ignore' AS tracked FROM ent WHERE class_id = 0 AND frame_status = 'valid' AND (label_status IN ('human', 'human_confirmed') OR label_status IN ('soft_positive', 'ignore') AND split = 'train')),
ids AS (SELECT domain, video, grp, track_id, row_number() OVER (PARTITION BY domain, video, grp ORDER BY track_id) - 1 AS number FROM (SELECT DISTINCT domain, video, grp, track_id FROM u WHERE tracked))
SELECT frame, det, u.domain, u.video, u.grp, split, x1, y1, x2 - x1 AS w, y2 - y1 AS h, CASE WHEN head_x IS NULL THEN 0 WHEN {_H} OR {_T} THEN 2 ELSE 1 END AS pose_state, CAST({_H} AS int) + CAST({_T} AS int) AS num_keypoints,
  CASE WHEN tracked THEN number ELSE -1 END AS track_number, tracked AS track_mask, round(quality, 6) AS quality, label_status = 'soft_positive' AS is_pseudo, label_status = 'ignore' AS ignore_region, CASE WHEN label_status = 'ignore' THEN 0.0 ELSE 1.0 END AS background_weight
FROM u LEFT JOIN ids ON ids.domain = u.domain AND ids.video = u.video AND ids.grp = u.grp AND ids.track_id = u.track_id""")  # fmt: skip
def training_annotations(spark, sf_dir):
    return rounded(entities.training_annotations(ents(spark, sf_dir)))


def _point_sql(p: str, seen: str) -> str:
    return f"CASE WHEN {seen} THEN printf('%.10f', CAST({p}_x AS double) / 640) ELSE '0' END, CASE WHEN {seen} THEN printf('%.10f', CAST({p}_y AS double) / 480) ELSE '0' END, CASE WHEN {seen} THEN '2' ELSE '0' END"


@query("training_rows", f"""WITH {ENT_SQL} SELECT domain, video, split, frame, det, concat_ws(' ', '0', printf('%.10f', (x1 + x2) / 2.0 / 640), printf('%.10f', (y1 + y2) / 2.0 / 480), printf('%.10f', (x2 - x1) / 640.0), printf('%.10f', (y2 - y1) / 480.0), {_point_sql('head', _H)}, {_point_sql('tail', _T)}) AS line
FROM ent WHERE class_id = 0 AND label_status IN ('human', 'human_confirmed', 'soft_positive')""")  # fmt: skip
def training_rows(spark, sf_dir):
    return entities.training_rows(ents(spark, sf_dir), 640, 480)


@query("package_index", f"""WITH {ENT_SQL}, t AS (SELECT *, CASE WHEN label_status IN ('ignore', 'invalid') OR frame_status = 'suspect' THEN 'audit_only' WHEN label_status IN ('human', 'human_confirmed') THEN 'confirmed' ELSE 'candidates' END AS tier FROM ent),
p AS (SELECT domain, video, grp, tier, count(DISTINCT frame) AS frames, count(*) AS boxes FROM t GROUP BY 1, 2, 3, 4),
n AS (SELECT domain, video, grp, count(*) AS negatives FROM (SELECT domain, video, grp, frame FROM t GROUP BY 1, 2, 3, 4 HAVING NOT bool_or(tier = 'confirmed') AND bool_or(complete)) GROUP BY 1, 2, 3)
SELECT p.*, CASE WHEN tier = 'confirmed' THEN coalesce(negatives, 0) ELSE 0 END AS negatives FROM p LEFT JOIN n USING (domain, video, grp)""")  # fmt: skip
def package_index(spark, sf_dir):
    return entities.package_index(ents(spark, sf_dir))


@query("split_conflicts", f"WITH {ENT_SQL} SELECT domain, video, string_agg(DISTINCT split, ',' ORDER BY split) AS splits FROM ent GROUP BY 1, 2 HAVING count(DISTINCT split) > 1")
def split_conflicts(spark, sf_dir):
    return entities.split_conflicts(ents(spark, sf_dir))


@query("feedback_snapshot", f"""WITH {ENT_SQL}, k AS (SELECT frame, det FROM ent WHERE label_status IN ('human', 'human_confirmed'))
SELECT frame, det FROM k UNION ALL SELECT DISTINCT frame, NULL FROM ent WHERE complete AND frame NOT IN (SELECT frame FROM k)""")  # fmt: skip
def feedback_snapshot(spark, sf_dir):
    return entities.feedback_snapshot(ents(spark, sf_dir)).withColumn("det", F.col("det").cast("long"))


@query("point_expansion", f"""WITH {ENT_SQL}, g AS (SELECT *, {_H} AND {_T} AS two FROM ent)
SELECT frame, det, round(CASE WHEN two THEN greatest(0.0, least(x1, greatest(least(head_x, tail_x), x1 - 0.1 * (x2 - x1)))) ELSE x1 END, 6) AS x1, round(CASE WHEN two THEN greatest(0.0, least(y1, greatest(least(head_y, tail_y), y1 - 0.1 * (y2 - y1)))) ELSE y1 END, 6) AS y1,
  round(CASE WHEN two THEN least(640.0, greatest(x2, least(greatest(head_x, tail_x), x2 + 0.1 * (x2 - x1)))) ELSE x2 END, 6) AS x2, round(CASE WHEN two THEN least(480.0, greatest(y2, least(greatest(head_y, tail_y), y2 + 0.1 * (y2 - y1)))) ELSE y2 END, 6) AS y2 FROM g""")  # fmt: skip
def point_expansion(spark, sf_dir):
    return rounded(entities.expand_to_points(ents(spark, sf_dir), 640, 480).select("frame", "det", "x1", "y1", "x2", "y2"))


@query("checked_xywh", f"""WITH {ENT_SQL}, o AS (SELECT *, greatest(0.0, x2 - 300, y2 - 200) AS over FROM ent)
SELECT frame, det, CAST(least(x1, 300) AS double) AS bx, CAST(least(y1, 200) AS double) AS by_, CAST(least(x2, 300) - least(x1, 300) AS double) AS bw, CAST(least(y2, 200) - least(y1, 200) AS double) AS bh, CAST(over AS double) AS overflow, over > 2 AS broken FROM o""")  # fmt: skip
def checked_xywh(spark, sf_dir):
    return entities.checked_xywh(ents(spark, sf_dir), 300, 200)


@query("dense_identities", f"WITH {ENT_SQL} SELECT domain, video, track_id, row_number() OVER (PARTITION BY domain, video ORDER BY track_id) - 1 AS dense_id FROM (SELECT DISTINCT domain, video, track_id FROM ent)")
def dense_identities(spark, sf_dir):
    return entities.dense_identities(ents(spark, sf_dir), ["domain", "video"])


@query("points_in_boxes")
def points_in_boxes(spark, sf_dir):
    """Loose head points to the boxes that hold them."""
    e = ents(spark, sf_dir)
    points = e.where("head_x is not null").select("frame", F.col("det").cast("long").alias("point"), (F.col("head_x") + 6).alias("x"), (F.col("head_y") + 5).alias("y"))
    return entities.points_in_boxes(points, e)
