"""Queries over label transforms, poses, groups and reviews."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import graph, labels, near_blocks, poses, tracks
from .projections import DET_SQL, REC_SQL, TRK_SQL, detections, observed, records, table
from .projections import tracks as track_rows
from .registry import query, rounded
from .track_queries import BIN_SQL, COL_SQL, _binned, _windows

STARTS_X, STARTS_Y = labels.tile_starts(400, 160, 0.2), labels.tile_starts(300, 160, 0.2)


@query("tile_slices", f"""WITH {DET_SQL}, x AS (SELECT unnest({STARTS_X}) AS tx), y AS (SELECT unnest({STARTS_Y}) AS ty),
c AS (SELECT frame, det, tx, ty, greatest(x1, tx) AS a, greatest(y1, ty) AS b, least(x2, tx + 160) AS c, least(y2, ty + 160) AS d, (x2 - x1) * (y2 - y1) AS area FROM det JOIN x ON tx < x2 AND tx + 160 > x1 JOIN y ON ty < y2 AND ty + 160 > y1)
SELECT frame, det, CAST(tx AS int) AS tx, CAST(ty AS int) AS ty, a - tx AS x1, b - ty AS y1, c - tx AS x2, d - ty AS y2, round((c - a) * (d - b) / CAST(area AS double), 6) AS share FROM c WHERE (c - a) * (d - b) / CAST(area AS double) >= 0.3""")  # fmt: skip
def tile_slices(spark, sf_dir):
    return rounded(labels.tiles(detections(spark, sf_dir), 400, 300, 160))


@query("affine_boxes", f"""WITH {DET_SQL}, q AS (SELECT frame, det, [0.8 * x1 - 0.6 * y1 + 100, 0.8 * x1 - 0.6 * y2 + 100, 0.8 * x2 - 0.6 * y1 + 100, 0.8 * x2 - 0.6 * y2 + 100] AS xs, [0.6 * x1 + 0.8 * y1 - 20, 0.6 * x1 + 0.8 * y2 - 20, 0.6 * x2 + 0.8 * y1 - 20, 0.6 * x2 + 0.8 * y2 - 20] AS ys FROM det),
b AS (SELECT frame, det, least(greatest(list_min(xs), 0), 400) AS x1, least(greatest(list_min(ys), 0), 300) AS y1, least(greatest(list_max(xs), 0), 400) AS x2, least(greatest(list_max(ys), 0), 300) AS y2 FROM q)
SELECT frame, det, round(CAST(x1 AS double), 6) AS x1, round(CAST(y1 AS double), 6) AS y1, round(CAST(x2 AS double), 6) AS x2, round(CAST(y2 AS double), 6) AS y2 FROM b WHERE x2 > x1 AND y2 > y1""")  # fmt: skip
def affine_boxes(spark, sf_dir):
    return rounded(labels.affine(detections(spark, sf_dir), (0.8, -0.6, 100.0, 0.6, 0.8, -20.0), 400, 300))


@query("snap_detections", f"""WITH {DET_SQL}, f AS (SELECT * FROM det WHERE origin <> 'observed'),
p AS (SELECT f.frame, f.det, o.det AS o, greatest(least(f.x2, o.x2) - greatest(f.x1, o.x1), 0) * greatest(least(f.y2, o.y2) - greatest(f.y1, o.y1), 0) AS i, (f.x2 - f.x1) * (f.y2 - f.y1) + (o.x2 - o.x1) * (o.y2 - o.y1) AS s,
  sqrt(pow((f.x1 + f.x2) / 2.0 - (o.x1 + o.x2) / 2.0, 2) + pow((f.y1 + f.y2) / 2.0 - (o.y1 + o.y2) / 2.0, 2)) AS d FROM f LEFT JOIN obs o ON o.frame = f.frame),
q AS (SELECT frame, det, o, round(i / CAST(s - i AS double), 9) AS iou, round(d, 9) AS d FROM p),
b AS (SELECT frame, det, arg_min(o, (-iou, o)) FILTER (WHERE iou >= 0.2) AS a, arg_min(o, (d, o)) FILTER (WHERE d <= 45) AS n FROM q GROUP BY frame, det)
SELECT frame, det, coalesce(a, n) AS target, CASE WHEN a IS NOT NULL THEN 'overlap' WHEN n IS NOT NULL THEN 'nearest' ELSE 'kept' END AS how FROM b""")  # fmt: skip
def snap_detections(spark, sf_dir):
    dets = detections(spark, sf_dir)
    out = labels.snap(dets.where("origin <> 'observed'"), observed(dets))
    return out.withColumnRenamed("to", "target")


@query("temporal_confirm", f"WITH {BIN_SQL}, d AS (SELECT DISTINCT a, b, frame FROM near) SELECT * FROM (SELECT a, b, frame, count(*) OVER (PARTITION BY a, b ORDER BY frame RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS support FROM d) WHERE support >= 2")
def temporal_confirm(spark, sf_dir):
    return near_blocks.near_confirmed(_binned(spark, sf_dir), 12, 2, 2)


@query("mutual_nearest", f"""WITH {BIN_SQL}, e AS (SELECT frame, a AS i, b AS j, round(distance, 9) AS d FROM near UNION ALL SELECT frame, b, a, round(distance, 9) FROM near), n AS (SELECT frame, i, arg_min(j, (d, j)) AS j FROM e GROUP BY frame, i)
SELECT x.frame, x.i AS a, x.j AS b FROM n x JOIN n y ON x.frame = y.frame AND x.i = y.j AND x.j = y.i WHERE x.i < x.j""")  # fmt: skip
def mutual_nearest(spark, sf_dir):
    return near_blocks.mutual_neighbours(_binned(spark, sf_dir), 12)


@query("causal_tuple", f"""WITH {TRK_SQL} SELECT track_id, frame, event_id, coalesce(lag(x, 2) OVER w, first_value(x) OVER w) AS t2, coalesce(lag(x, 1) OVER w, first_value(x) OVER w) AS t1, x AS t0, 1 + CASE WHEN lag(x, 2) OVER w IS NULL THEN 0 ELSE 1 END + CASE WHEN lag(x, 1) OVER w IS NULL THEN 0 ELSE 1 END AS valid
FROM trk WINDOW w AS (PARTITION BY track_id ORDER BY frame, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")  # fmt: skip
def causal_tuple(spark, sf_dir):
    return labels.causal_tuples(track_rows(spark, sf_dir), "track_id", ["frame", "event_id"], "x", 3)


@query("smooth_centres", f"""WITH {TRK_SQL}, g0 AS (SELECT *, CASE WHEN frame - lag(frame) OVER (PARTITION BY track_id ORDER BY frame, event_id) <= 500 THEN 0 ELSE 1 END AS st FROM trk), g AS (SELECT *, sum(st) OVER (PARTITION BY track_id ORDER BY frame, event_id ROWS UNBOUNDED PRECEDING) AS run FROM g0), n AS (SELECT *, coalesce(lag(x, 1) OVER w, x) AS a1, coalesce(lead(x, 1) OVER w, x) AS b1, coalesce(lag(x, 2) OVER w, lag(x, 1) OVER w, x) AS a2, coalesce(lead(x, 2) OVER w, lead(x, 1) OVER w, x) AS b2 FROM g WINDOW w AS (PARTITION BY track_id, run ORDER BY frame, event_id)),
m AS (SELECT *, (x + 0.6065306597126334e0 * (a1 + b1) + 0.1353352832366127e0 * (a2 + b2)) / (1 + 2 * 0.6065306597126334e0 + 2 * 0.1353352832366127e0) - x AS d FROM n)
SELECT track_id, frame, event_id, round(CAST(x + least(greatest(d, -2), 2) AS double), 5) AS smoothed FROM m""")  # fmt: skip
def smooth_centres(spark, sf_dir):
    return rounded(labels.smooth(track_rows(spark, sf_dir), "x", max_gap=500), 5)


@query("balanced_order", f"""WITH {REC_SQL}, n AS (SELECT domain, sample_id, row_number() OVER (PARTITION BY domain ORDER BY size, sample_id) - 1 AS i, count(*) OVER (PARTITION BY domain) AS s FROM rec), q AS (SELECT max(s) AS q FROM n)
SELECT domain, i + k * s AS slot, sample_id FROM (SELECT domain, sample_id, i, s, unnest(range(0, CAST(floor((q - 1 - i) / CAST(s AS double)) AS bigint) + 1)) AS k FROM n CROSS JOIN q)""")  # fmt: skip
def balanced_order(spark, sf_dir):
    return labels.cyclic_quota(records(spark, sf_dir), "domain", "sample_id", F.col("size"))


POSE_SQL = f"""{DET_SQL}, ps AS (SELECT frame, det, domain, track_id, CAST(x1 AS double) AS ghx, CAST(y1 AS double) AS ghy, CAST(x2 AS double) AS gtx, CAST(y2 AS double) AS gty,
  CASE WHEN det % 5 = 4 THEN x2 ELSE x1 + det % 4 END AS phx, CASE WHEN det % 5 = 4 THEN y2 ELSE y1 END AS phy, CASE WHEN det % 5 = 4 THEN x1 ELSE x2 + frame % 9 END AS ptx, CASE WHEN det % 5 = 4 THEN y1 ELSE y2 END AS pty FROM obs),
pe AS (SELECT *, sqrt(pow(phx - ghx, 2) + pow(phy - ghy, 2)) / b AS he, sqrt(pow(ptx - gtx, 2) + pow(pty - gty, 2)) / b AS te, (sqrt(pow(phx - ghx, 2) + pow(phy - ghy, 2)) + sqrt(pow(ptx - gtx, 2) + pow(pty - gty, 2))) / (2 * b) AS nme,
  (sqrt(pow(ptx - ghx, 2) + pow(pty - ghy, 2)) + sqrt(pow(phx - gtx, 2) + pow(phy - gty, 2))) / (2 * b) AS sw, atan2(phy - pty, phx - ptx) - atan2(ghy - gty, ghx - gtx) AS an FROM (SELECT *, sqrt(pow(ghx - gtx, 2) + pow(ghy - gty, 2)) AS b FROM ps)),
pd AS (SELECT *, CASE WHEN sw - nme > 0.1 THEN 'keep' WHEN sw - nme < -0.1 THEN 'swap' ELSE 'review' END AS decision FROM pe)"""


def _poses(spark, sf_dir):
    c, odd = F.col, F.col("det") % 5 == 4
    obs = observed(detections(spark, sf_dir))
    return obs.select(
        "frame", "det", "domain", "track_id", c("x1").cast("double").alias("ghx"), c("y1").cast("double").alias("ghy"), c("x2").cast("double").alias("gtx"), c("y2").cast("double").alias("gty"),
        F.when(odd, c("x2")).otherwise(c("x1") + c("det") % 4).alias("phx"), F.when(odd, c("y2")).otherwise(c("y1")).alias("phy"), F.when(odd, c("x1")).otherwise(c("x2") + c("frame") % 9).alias("ptx"), F.when(odd, c("y1")).otherwise(c("y2")).alias("pty"),
    )


@query("pose_metrics", f"WITH {POSE_SQL} SELECT domain, count(*) AS n, round(avg(nme), 6) AS nme, round((avg(CASE WHEN he < 0.1 THEN 1.0 ELSE 0.0 END) + avg(CASE WHEN te < 0.1 THEN 1.0 ELSE 0.0 END)) / 2, 6) AS pck_endpoint, round(avg(CASE WHEN he < 0.1 AND te < 0.1 THEN 1.0 ELSE 0.0 END), 6) AS pck_pair, round(avg(abs(atan2(sin(an), cos(an)))), 6) AS angle_mae, round(avg(CASE WHEN sw < nme THEN 1.0 ELSE 0.0 END), 6) AS swap_rate FROM pe GROUP BY domain")
def pose_metrics(spark, sf_dir):
    return rounded(poses.pose_metrics(_poses(spark, sf_dir), "domain"))


@query("head_tail_decisions", f"WITH {POSE_SQL} SELECT decision, count(*) AS n, round(avg(nme), 6) AS nme FROM pd GROUP BY decision")
def head_tail_decisions(spark, sf_dir):
    return rounded(poses.head_tail_decisions(_poses(spark, sf_dir)).groupBy("decision").agg(F.count("*").alias("n"), F.avg("nme").alias("nme")))


@query("track_pose_vote", f"WITH {POSE_SQL}, g AS (SELECT track_id, count(*) AS n, sum(CASE WHEN decision = 'keep' THEN 1 ELSE 0 END) AS k, sum(CASE WHEN decision = 'swap' THEN 1 ELSE 0 END) AS s FROM pd GROUP BY 1) SELECT track_id, n, CASE WHEN k > s THEN 'keep' WHEN s > k THEN 'swap' ELSE 'review' END AS vote, round(greatest(k, s) / CAST(n AS double), 6) AS share FROM g")
def track_pose_vote(spark, sf_dir):
    return rounded(poses.track_vote(poses.head_tail_decisions(_poses(spark, sf_dir)), "track_id"))


@query("split_components")
def split_components(spark, sf_dir):
    """Samples that share a text are kept in one split."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("sample_id"), F.md5("text").alias("key"))
    groups = graph.linked_groups(docs, "sample_id", "key")
    return graph.split_groups(groups, "sample_id", {"train": 0.7, "val": 0.15, "test": 0.15})


@query("linked_samples", "SELECT doc_id AS sample_id, min(doc_id) OVER (PARTITION BY text) AS group_id FROM documents WHERE text IS NOT NULL")
def linked_samples(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("text is not null").select(F.col("doc_id").alias("sample_id"), F.md5("text").alias("key"))
    return graph.linked_groups(docs, "sample_id", "key")


@query("edge_votes", f"""WITH {BIN_SQL}, v AS (SELECT a, b, CASE WHEN a_id < b_id THEN 'forward' ELSE 'reverse' END AS dir, distance / 5 AS cost FROM near), g AS (SELECT a, b, median(cost) AS cost, count(DISTINCT dir) AS directions, count(*) AS votes FROM v GROUP BY 1, 2)
SELECT a, b, round(cost, 6) AS cost, directions, votes, (directions >= 2 AND cost <= 2.25) OR (votes >= 2 AND cost <= 1.45) AS accepted FROM g""")  # fmt: skip
def edge_votes(spark, sf_dir):
    return rounded(near_blocks.near_votes(_binned(spark, sf_dir), 12, 5))


@query("motion_thresholds", f"WITH {COL_SQL} SELECT scope, round(quantile_cont(speed, 0.2), 6) AS stationary, round(quantile_cont(speed, 0.9), 6) AS fast, round(quantile_disc(speed, 0.95), 6) AS p95 FROM c1 WHERE speed IS NOT NULL GROUP BY scope")
def motion_thresholds(spark, sf_dir):
    moves = tracks.kinematics(track_rows(spark, sf_dir), 5000).where("speed is not null")
    return rounded(moves.groupBy(F.col("state").alias("scope")).agg(F.percentile("speed", F.lit(0.2)).alias("stationary"), F.percentile("speed", F.lit(0.9)).alias("fast"), F.expr("percentile_disc(0.95) within group (order by speed)").alias("p95")))


@query("window_autocorrelation", f"""WITH {COL_SQL}, v AS (SELECT scope, window_index AS w, CAST(new_tracks AS double) AS v FROM cw), r AS (SELECT scope, w, v - avg(v) OVER (PARTITION BY scope) AS d FROM v)
SELECT a.scope, CAST(l.lag AS int) AS lag, round(sum(a.d * b.d) / (SELECT sum(d * d) FROM r WHERE r.scope = a.scope), 6) AS acf FROM r a JOIN (SELECT unnest([1, 2, 3, 7]) AS lag) l ON true JOIN r b ON b.scope = a.scope AND b.w = a.w + l.lag GROUP BY a.scope, l.lag""")  # fmt: skip
def window_autocorrelation(spark, sf_dir):
    v = _windows(spark, sf_dir).select("scope", F.col("window_index").alias("w"), F.col("new_tracks").cast("double").alias("v"))
    r = v.withColumn("d", F.col("v") - F.avg("v").over(Window.partitionBy("scope")))
    total = r.groupBy("scope").agg(F.sum(F.col("d") * F.col("d")).alias("ss"))
    shifted = r.select("scope", F.explode(F.array(*map(F.lit, (1, 2, 3, 7)))).alias("lag"), "w", F.col("d").alias("d0")).withColumn("w", F.col("w") + F.col("lag"))
    return rounded(shifted.join(r, ["scope", "w"]).groupBy("scope", "lag").agg(F.sum(F.col("d0") * F.col("d")).alias("s")).join(total, "scope").select("scope", "lag", (F.col("s") / F.col("ss")).alias("acf")))


@query("cross_layer_evidence", f"""WITH {TRK_SQL}, w AS (SELECT *, frame - lag(frame) OVER w AS gap, sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)) AS d FROM trk WINDOW w AS (PARTITION BY track_id ORDER BY frame, event_id)),
e AS (SELECT event_id, 'L3' AS layer, d / gap / 141.0 AS error, CASE WHEN d / gap / 141.0 > 0.002 THEN 'identity_jump' ELSE 'none' END AS root_cause FROM w WHERE gap > 0 UNION ALL SELECT event_id, 'L4', 1 - value / 1000, CASE WHEN value < 100 THEN 'weak_event' ELSE 'none' END FROM events WHERE value BETWEEN 0 AND 1000)
SELECT event_id, layer, round(error, 6) AS error, root_cause FROM e""")  # fmt: skip
def cross_layer_evidence(spark, sf_dir):
    t = track_rows(spark, sf_dir)
    w = Window.partitionBy("track_id").orderBy("frame", "event_id")
    e = t.withColumns({"gap": F.col("frame") - F.lag("frame").over(w), "d": F.sqrt((F.col("x") - F.lag("x").over(w)) ** 2 + (F.col("y") - F.lag("y").over(w)) ** 2)}).where("gap > 0").withColumn("error", F.col("d") / F.col("gap") / 141.0)
    l3 = e.select("event_id", F.lit("L3").alias("layer"), "error", F.when(F.col("error") > 0.002, "identity_jump").otherwise("none").alias("root_cause"))
    l4 = table(spark, sf_dir, "events").where("value between 0 and 1000").select("event_id", F.lit("L4").alias("layer"), (1 - F.col("value") / 1000).alias("error"), F.when(F.col("value") < 100, "weak_event").otherwise("none").alias("root_cause"))
    return rounded(l3.unionByName(l4))


@query("quality_pivot", f"WITH {REC_SQL} SELECT domain, count(*) FILTER (WHERE split = 'train') AS train, count(*) FILTER (WHERE split = 'calibration') AS calibration, count(*) FILTER (WHERE split = 'test') AS test FROM rec GROUP BY domain")
def quality_pivot(spark, sf_dir):
    return records(spark, sf_dir).groupBy("domain").pivot("split", ["train", "calibration", "test"]).agg(F.count(F.lit(1))).na.fill(0)


@query("task_diff", """WITH o AS (SELECT o_orderkey AS entity_id, o_orderstatus AS a FROM orders WHERE o_orderkey % 7 <> 0), e AS (SELECT o_orderkey AS entity_id, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS b FROM orders WHERE o_orderkey % 11 <> 0)
SELECT entity_id, CASE WHEN o.entity_id IS NULL THEN 'add' WHEN e.entity_id IS NULL THEN 'reject' WHEN a IS NOT DISTINCT FROM b THEN 'confirm' ELSE 'correct' END AS action FROM o FULL JOIN e USING (entity_id)""")  # fmt: skip
def task_diff(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    o = orders.where("o_orderkey % 7 <> 0").select(F.col("o_orderkey").alias("entity_id"), F.col("o_orderstatus").alias("a"), F.lit(1).alias("had"))
    e = orders.where("o_orderkey % 11 <> 0").select(F.col("o_orderkey").alias("entity_id"), F.when(F.col("o_orderkey") % 5 == 0, "X").otherwise(F.col("o_orderstatus")).alias("b"), F.lit(1).alias("has"))
    action = F.when(F.col("had").isNull(), "add").when(F.col("has").isNull(), "reject").when(F.col("a").eqNullSafe(F.col("b")), "confirm").otherwise("correct")
    return o.join(e, "entity_id", "full").select("entity_id", action.alias("action"))


@query("window_events", """WITH w AS (SELECT o_orderkey AS window_id, o_custkey AS c, o_orderdate AS a, o_orderdate + INTERVAL 30 DAY AS z FROM orders WHERE o_orderstatus = 'F')
SELECT window_id, count(*) AS n FROM w JOIN orders o ON o.o_custkey = w.c AND o.o_orderdate BETWEEN w.a AND w.z GROUP BY window_id""")  # fmt: skip
def window_events(spark, sf_dir):
    """Interval join: confirmed windows and what they cover in the same scope."""
    o = table(spark, sf_dir, "orders")
    w = o.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("window_id"), "o_custkey", F.col("o_orderdate").alias("a"), F.expr("o_orderdate + interval 30 days").alias("z"))
    return w.join(o.select("o_custkey", F.col("o_orderdate").alias("t")), "o_custkey").where("t between a and z").groupBy("window_id").agg(F.count("*").alias("n"))


@query("context_join", """WITH s AS (SELECT n_nationkey, arg_max(s_name, s_suppkey) AS source FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1) SELECT c_custkey, n_name, r_name, source FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey LEFT JOIN s ON s.n_nationkey = c_nationkey""")
def context_join(spark, sf_dir):
    """Scope context: later sources overwrite earlier ones."""
    s = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("c_nationkey")).agg(F.max_by("s_name", "s_suppkey").alias("source"))
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left").select(F.col("n_nationkey").alias("c_nationkey"), "n_name", "r_name")
    return table(spark, sf_dir, "customer").join(n, "c_nationkey", "left").join(s, "c_nationkey", "left").select("c_custkey", "n_name", "r_name", "source")


@query("champion_gate", """WITH m AS (SELECT o_orderpriority AS protocol, avg(o_totalprice) FILTER (WHERE o_orderkey % 2 = 0) AS champion, avg(o_totalprice) FILTER (WHERE o_orderkey % 2 = 1) AS candidate, count(*) FILTER (WHERE o_orderkey % 2 = 0) AS n FROM orders GROUP BY 1)
SELECT protocol, CASE WHEN n < 100 THEN 'too_few' WHEN candidate < champion * 0.995 THEN 'regression' WHEN candidate > champion THEN 'improved' ELSE 'no_improvement' END AS reason FROM m""")  # fmt: skip
def champion_gate(spark, sf_dir):
    odd = F.col("o_orderkey") % 2 == 1
    m = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("protocol")).agg(F.avg(F.when(~odd, F.col("o_totalprice"))).alias("champion"), F.avg(F.when(odd, F.col("o_totalprice"))).alias("candidate"), F.count(F.when(~odd, 1)).alias("n"))
    return m.select("protocol", F.when(F.col("n") < 100, "too_few").when(F.col("candidate") < F.col("champion") * 0.995, "regression").when(F.col("candidate") > F.col("champion"), "improved").otherwise("no_improvement").alias("reason"))


@query("fingerprints", f"""WITH {DET_SQL}, h AS (SELECT video, frame, sha256(string_agg(concat_ws(',', det, x1, y1, x2, y2), ';' ORDER BY det)) AS h FROM det GROUP BY 1, 2),
b AS (SELECT video, frame // 1000 AS block, count(*) AS n, sha256(string_agg(h, '' ORDER BY frame)) AS h FROM h GROUP BY 1, 2) SELECT video, CAST(sum(n) AS bigint) AS frames, sha256(string_agg(h, '' ORDER BY block)) AS digest FROM b GROUP BY video""")  # fmt: skip
def fingerprints(spark, sf_dir):
    """Content hash of each video: of the hashes of its blocks of 1000 frame numbers, which hash their frames' hashes; no list holds a video's frames."""
    row = F.concat_ws(",", "det", "x1", "y1", "x2", "y2")
    joined = lambda order, c, by: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(c).alias("c")))), lambda x: x["c"]), by), 256)
    frames = detections(spark, sf_dir).withColumn("r", row).groupBy("video", "frame").agg(joined("det", "r", ";").alias("h"))
    blocks = frames.groupBy("video", F.floor(F.col("frame") / 1000).alias("block")).agg(F.count("*").alias("n"), joined("frame", "h", "").alias("h"))
    return blocks.groupBy("video").agg(F.sum("n").alias("frames"), joined("block", "h", "").alias("digest"))


@query("role_lists", f"WITH {REC_SQL}, g AS (SELECT domain, grp, count(*) AS n, avg(1 - correct) AS e, avg(CAST(risk AS double)) AS r FROM rec GROUP BY 1, 2) SELECT domain, grp, 'scarce' AS role FROM g WHERE n < 6 UNION ALL SELECT domain, grp, 'hard' FROM g WHERE e > 0.5 UNION ALL SELECT domain, grp, 'risky' FROM g WHERE r > 0.1")
def role_lists(spark, sf_dir):
    g = records(spark, sf_dir).groupBy("domain", "grp").agg(F.count("*").alias("n"), F.avg(1 - F.col("correct")).alias("e"), F.avg(F.col("risk").cast("double")).alias("r"))
    roles = F.array_compact(F.array(F.when(F.col("n") < 6, "scarce"), F.when(F.col("e") > 0.5, "hard"), F.when(F.col("r") > 0.1, "risky")))
    return g.select("domain", "grp", F.explode(roles).alias("role"))


@query("feature_vectors", f"WITH {REC_SQL} SELECT sample_id, round(coalesce(size / 1000.0, 0), 6) AS size_k, CASE WHEN size IS NULL THEN 1 ELSE 0 END AS size_missing, coalesce(correct, 0) AS correct_value, CASE WHEN correct IS NULL THEN 1 ELSE 0 END AS correct_missing FROM rec")
def feature_vectors(spark, sf_dir):
    """Missing is not zero: each value has its indicator."""
    missing = lambda c: F.when(F.col(c).isNull(), 1).otherwise(0)
    return rounded(records(spark, sf_dir).select("sample_id", F.coalesce(F.col("size") / 1000.0, F.lit(0.0)).alias("size_k"), missing("size").alias("size_missing"), F.coalesce("correct", F.lit(0)).alias("correct_value"), missing("correct").alias("correct_missing")))
