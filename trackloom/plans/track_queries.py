"""Queries over tracks: kinematics, windows, network, density, change, streams' batch twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.geometry import point_in_polygon
from ..operators import colony, matching, near_blocks, tracks
from .projections import TRK_SQL, tracks as track_rows
from .registry import query, rounded

W = "WINDOW w AS (PARTITION BY track_id ORDER BY frame, event_id)"
KIN_SQL = f"""{TRK_SQL}, k0 AS (SELECT *, frame - lag(frame) OVER w AS gap, x - lag(x) OVER w AS dx0, y - lag(y) OVER w AS dy0 FROM trk {W}),
k1 AS (SELECT *, CASE WHEN gap BETWEEN 1 AND 5000 THEN dx0 END AS dx, CASE WHEN gap BETWEEN 1 AND 5000 THEN dy0 END AS dy FROM k0),
k AS (SELECT *, sqrt(dx * dx + dy * dy) / gap AS speed, CASE WHEN dx <> 0 OR dy <> 0 THEN atan2(dy, dx) END AS heading FROM k1)"""


@query("kinematics", f"WITH {KIN_SQL}, t AS (SELECT *, heading - lag(heading) OVER w AS turn FROM k {W}) SELECT track_id, frame, event_id, round(speed, 6) AS speed, CASE WHEN round(atan2(sin(turn), cos(turn)), 6) = -3.141593 THEN 3.141593 ELSE round(atan2(sin(turn), cos(turn)), 6) END AS turn FROM t")
def kinematics(spark, sf_dir):
    rows = rounded(tracks.kinematics(track_rows(spark, sf_dir), 5000).select("track_id", "frame", "event_id", "speed", "turn"))
    # half a turn is the same either way round
    return rows.withColumn("turn", F.when(F.col("turn") == -3.141593, 3.141593).otherwise(F.col("turn")))


@query("gap_runs", f"WITH {TRK_SQL}, s AS (SELECT *, CASE WHEN frame - lag(frame) OVER w <= 500 THEN 0 ELSE 1 END AS st FROM trk {W}), r AS (SELECT *, sum(st) OVER (PARTITION BY track_id ORDER BY frame, event_id ROWS UNBOUNDED PRECEDING) AS run FROM s) SELECT track_id, CAST(run AS bigint) AS run, min(frame) AS first_frame, max(frame) AS last_frame, count(*) AS n FROM r GROUP BY track_id, run")
def gap_runs(spark, sf_dir):
    return tracks.gap_runs(track_rows(spark, sf_dir), 500)


@query("session_runs", "WITH e AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) < 3600000000 THEN 0 ELSE 1 END AS st FROM events), s AS (SELECT *, sum(st) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e) SELECT user_id, count(*) AS n FROM s GROUP BY user_id, k")
def session_runs(spark, sf_dir):
    """Extension: gap-free runs as session windows of an hour."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("t", F.col("ts").cast("timestamp"))
    return e.groupBy("user_id", F.session_window("t", "1 hour")).agg(F.count("*").alias("n")).select("user_id", "n")


@query(
    "motion_lag_asof",
    f"""WITH {TRK_SQL}, s AS (SELECT *, CASE WHEN frame - lag(frame) OVER w <= 2000 THEN 0 ELSE 1 END AS st FROM trk {W}), r AS (SELECT *, sum(st) OVER (PARTITION BY track_id ORDER BY frame, event_id ROWS UNBOUNDED PRECEDING) AS run FROM s),
j AS (SELECT a.track_id, a.frame, a.event_id, a.x, a.y, b.frame AS pf, b.x AS px, b.y AS py, row_number() OVER (PARTITION BY a.event_id ORDER BY b.frame DESC, b.event_id DESC) AS k FROM r a LEFT JOIN r b ON a.track_id = b.track_id AND a.run = b.run AND b.frame <= a.frame - 60)
SELECT track_id, frame, event_id, pf AS past_frame, round(sqrt((x - px) * (x - px) + (y - py) * (y - py)) / (frame - pf), 6) AS speed FROM j WHERE k = 1""",
)
def motion_lag_asof(spark, sf_dir):
    return rounded(tracks.motion_lag(track_rows(spark, sf_dir), 60, 2000))


@query("line_crossing", f"""WITH {TRK_SQL}, s AS (SELECT *, frame - lag(frame) OVER w AS gap, nullif(CAST(sign(y - 50) AS int), 0) AS side FROM trk {W}),
t AS (SELECT *, last_value(side IGNORE NULLS) OVER (PARTITION BY track_id ORDER BY frame, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS was FROM s)
SELECT track_id, frame, event_id, CASE WHEN side > 0 THEN 'in' ELSE 'out' END AS direction FROM t WHERE side <> was AND gap BETWEEN 1 AND 5000""")  # fmt: skip
def line_crossing(spark, sf_dir):
    return tracks.line_crossings(track_rows(spark, sf_dir), F.lit(50), F.col("y"), 5000)


@query(
    "track_windows",
    f"""WITH {TRK_SQL}, s AS (SELECT *, sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)) AS step, first_value(x) OVER v AS x0, first_value(y) OVER v AS y0, last_value(x) OVER v AS xn, last_value(y) OVER v AS yn FROM trk
  WINDOW w AS (PARTITION BY track_id ORDER BY frame, event_id), v AS (PARTITION BY track_id ORDER BY frame, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
g AS (SELECT track_id, count(*) AS n, count(DISTINCT floor(x / 5.0) * 20 + floor(y / 5.0)) AS cells, min(CASE WHEN sqrt(pow(x - x0, 2) + pow(y - y0, 2)) >= 10 THEN frame END) AS first_passage, sum(step) AS path, max(sqrt(pow(xn - x0, 2) + pow(yn - y0, 2))) AS net, sqrt(var_pop(x) + var_pop(y)) AS gyration FROM s GROUP BY track_id)
SELECT track_id, n, cells, round(cells / 400.0, 6) AS coverage, first_passage, round(path, 6) AS path, round(net, 6) AS net, round(CASE WHEN net > 0 THEN path / net END, 6) AS tortuosity, round(gyration, 6) AS gyration FROM g""",
)
def track_windows(spark, sf_dir):
    return rounded(tracks.track_windows(track_rows(spark, sf_dir)))


HOURS = 240


def _binned(spark, sf_dir):
    return track_rows(spark, sf_dir).withColumn("frame", F.floor(F.col("frame") / HOURS).cast("long"))


BIN_SQL = f"{TRK_SQL}, bt AS (SELECT track_id, CAST(floor(frame / {HOURS}.0) AS bigint) AS frame, event_id, x, y FROM trk), near AS (SELECT a.frame, a.track_id AS a, b.track_id AS b, a.event_id AS a_id, b.event_id AS b_id, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS distance FROM bt a JOIN bt b ON a.frame = b.frame AND a.track_id < b.track_id AND sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) < 12)"


@query("radius_join", f"WITH {BIN_SQL} SELECT frame, a, b, a_id, b_id, round(distance, 6) AS distance FROM near")
def radius_join(spark, sf_dir):
    return rounded(tracks.radius_pairs(_binned(spark, sf_dir), 12))


@query("pair_persistence", f"""WITH {BIN_SQL}, d AS (SELECT DISTINCT a, b, frame FROM near), s AS (SELECT *, CASE WHEN frame - lag(frame) OVER (PARTITION BY a, b ORDER BY frame) <= 3 THEN 0 ELSE 1 END AS st FROM d),
e AS (SELECT *, sum(st) OVER (PARTITION BY a, b ORDER BY frame ROWS UNBOUNDED PRECEDING) AS ep FROM s) SELECT a, b, CAST(ep AS bigint) AS episode, min(frame) AS first_frame, max(frame) AS last_frame, count(*) AS n FROM e GROUP BY a, b, ep""")  # fmt: skip
def pair_persistence(spark, sf_dir):
    return near_blocks.near_episodes(_binned(spark, sf_dir), 12, 3)


@query("nearest_neighbour", f"WITH {TRK_SQL}, bt AS (SELECT track_id, CAST(floor(frame / {HOURS}.0) AS bigint) AS frame, event_id, x, y FROM trk), near AS (SELECT a.frame, a.event_id, min(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2))) AS d FROM bt a JOIN bt b ON a.frame = b.frame AND a.track_id <> b.track_id AND sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) < 12 GROUP BY a.frame, a.event_id) SELECT frame, count(*) AS n, round(avg(d), 6) AS mean_distance FROM near GROUP BY frame")
def nearest_neighbour(spark, sf_dir):
    each = near_blocks.nearest_others(_binned(spark, sf_dir), 12).groupBy("frame", "event_id").agg(F.min("distance").alias("d"))
    return rounded(each.groupBy("frame").agg(F.count("*").alias("n"), F.avg("d").alias("mean_distance")))


@query("proximity_network", f"""WITH {BIN_SQL}, e AS (SELECT frame // 6 AS window_index, a, b, count(DISTINCT frame) AS w FROM near GROUP BY 1, 2, 3), n AS (SELECT window_index, count(DISTINCT node) AS nodes, sum(w) AS s FROM (SELECT window_index, a AS node, w FROM e UNION ALL SELECT window_index, b, w FROM e) GROUP BY 1)
SELECT n.window_index, nodes, count(*) AS edges, round(2.0 * count(*) / (nodes * (nodes - 1)), 6) AS edge_density, round(any_value(s) / nodes, 6) AS mean_strength, max(w) AS longest FROM n JOIN e USING (window_index) GROUP BY n.window_index, nodes""")  # fmt: skip
def proximity_network(spark, sf_dir):
    return rounded(near_blocks.near_windows(_binned(spark, sf_dir), 12, 6))


COL_SQL = f"""{KIN_SQL}, c0 AS (SELECT *, state AS scope, min(frame) OVER (PARTITION BY state) AS f0, min(frame) OVER (PARTITION BY state, track_id) AS ft FROM k),
c1 AS (SELECT *, CAST(trunc((frame - f0) / 1.0 / 1440.0) AS bigint) AS window_index, CASE WHEN speed <= 20 THEN speed END AS motion FROM c0),
cw AS (SELECT scope, window_index, count(*) AS n, count(DISTINCT frame) AS frames, min(frame) AS a, max(frame) AS z, count(motion) AS ob, sum(CASE WHEN motion >= 0.05 THEN 1 ELSE 0 END) AS mv, median(motion) AS med, CAST(sum(CASE WHEN speed > 20 THEN 1 ELSE 0 END) AS bigint) AS jumps, count(DISTINCT CASE WHEN frame = ft THEN track_id END) AS new_tracks FROM c1 GROUP BY 1, 2)"""


def _windows(spark, sf_dir):
    moves = tracks.kinematics(track_rows(spark, sf_dir), 5000).withColumn("scope", F.col("state"))
    return colony.colony_windows(moves, 1440, 1.0, active=0.05)


@query("colony_windows", f"WITH {COL_SQL} SELECT scope, window_index, frames, round(frames / 1.0, 6) AS exposure, round(frames / 1.0 / (z + 1 - a), 6) AS coverage, round(n / CAST(frames AS double), 6) AS mean_count, round(ob / CAST(n AS double), 6) AS observable_fraction, round(CASE WHEN ob > 0 THEN mv / CAST(ob AS double) END, 6) AS active_fraction, round(med, 6) AS median_speed, jumps, new_tracks FROM cw")
def colony_windows(spark, sf_dir):
    return rounded(_windows(spark, sf_dir))


@query("temporal_change", f"""WITH {COL_SQL}, p AS (SELECT a.scope, a.window_index, a.new_tracks AS value, median(b.new_tracks) AS centre, list(b.new_tracks) AS l FROM cw a JOIN cw b ON a.scope = b.scope AND b.window_index BETWEEN a.window_index - 6 AND a.window_index - 1 GROUP BY 1, 2, 3 HAVING count(*) = 6),
u AS (SELECT scope, window_index, value, centre, unnest(l) AS v FROM p), m AS (SELECT scope, window_index, value, centre, median(abs(v - centre)) AS spread FROM u GROUP BY 1, 2, 3, 4),
z AS (SELECT *, (value - centre) / greatest(1.4826 * spread, 0.05 * abs(centre), 0.01) AS z FROM m) SELECT scope, window_index, CAST(value AS double) AS value, round(centre, 6) AS centre, round(z, 6) AS z, abs(z) >= 4 AS flagged FROM z""")  # fmt: skip
def temporal_change(spark, sf_dir):
    return rounded(colony.temporal_change(_windows(spark, sf_dir), "new_tracks"))


@query("trend", f"WITH {COL_SQL} SELECT scope, count(*) AS n, round(regr_slope(new_tracks, window_index), 6) AS slope, round(corr(new_tracks, window_index), 6) AS r, round(avg(new_tracks), 6) AS mean FROM cw GROUP BY scope")
def trend(spark, sf_dir):
    return rounded(colony.trend(_windows(spark, sf_dir), "new_tracks"))


@query("density_grid", f"""WITH {TRK_SQL}, p AS (SELECT event_id, state AS scope, x / 10.0 AS px, y / 10.0 AS py FROM trk), g AS (SELECT unnest(range(0, 10)) AS g),
c AS (SELECT p.*, a.g AS gx, b.g AS gy, exp(-(pow(a.g - px, 2) + pow(b.g - py, 2)) / 2.88) AS w FROM p JOIN g a ON abs(a.g - round_even(px, 0)) <= 4 JOIN g b ON abs(b.g - round_even(py, 0)) <= 4),
n AS (SELECT *, w / sum(w) OVER (PARTITION BY event_id) AS m FROM c) SELECT scope, gx, gy, round(sum(m), 5) AS mass FROM n GROUP BY 1, 2, 3""")  # fmt: skip
def density_grid(spark, sf_dir):
    pts = track_rows(spark, sf_dir).select(F.col("state").alias("scope"), "x", "y", F.lit(10).cast("long").alias("nx"), F.lit(10).cast("long").alias("ny"))
    return rounded(colony.density_grid(pts, 10), 5)


ZONE = [(10, 10), (90, 20), (70, 90), (30, 60)]
EDGES = list(zip(ZONE, ZONE[1:] + ZONE[:1], strict=True))
IN_SQL = " + ".join(f"CASE WHEN ({ay} > y) <> ({by} > y) AND x < ({bx - ax}) * (y - {ay}) / {float(by - ay)} + {ax} THEN 1 ELSE 0 END" for (ax, ay), (bx, by) in EDGES if ay != by)


@query("region_dwell", f"WITH {TRK_SQL} SELECT track_id, CASE WHEN ({IN_SQL}) % 2 = 1 THEN 'zone' ELSE 'region_unknown' END AS region, count(*) AS n FROM trk GROUP BY 1, 2")
def region_dwell(spark, sf_dir):
    inside = point_in_polygon(F.col("x"), F.col("y"), ZONE)
    return track_rows(spark, sf_dir).groupBy("track_id", F.when(inside, "zone").otherwise("region_unknown").alias("region")).agg(F.count("*").alias("n"))


@query("direction_entropy", f"WITH {KIN_SQL}, o AS (SELECT track_id, CAST(floor((heading - 2 * pi() * floor(heading / (2 * pi()))) / (pi() / 4)) AS int) AS b, count(*) AS n FROM k WHERE heading IS NOT NULL GROUP BY 1, 2), p AS (SELECT track_id, n / CAST(sum(n) OVER (PARTITION BY track_id) AS double) AS p FROM o) SELECT track_id, round(-sum(p * ln(p)) / ln(8) + 0.0, 6) AS entropy FROM p GROUP BY track_id")
def direction_entropy(spark, sf_dir):
    from pyspark.sql import Window

    from ..functions.geometry import octant

    k = tracks.kinematics(track_rows(spark, sf_dir), 5000).where("heading is not null")
    bins = k.groupBy("track_id", octant(F.col("heading")).alias("b")).agg(F.count("*").alias("n"))
    p = bins.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("track_id")))
    return rounded(p.groupBy("track_id").agg((-F.sum(F.col("p") * F.log("p")) / F.log(F.lit(8.0))).alias("entropy")))


@query("grid_coverage", f"WITH {TRK_SQL} SELECT state, count(DISTINCT floor(x / 5.0) * 20 + floor(y / 5.0)) AS cells FROM trk GROUP BY state")
def grid_coverage(spark, sf_dir):
    return track_rows(spark, sf_dir).groupBy("state").agg(F.count_distinct(F.floor(F.col("x") / 5) * 20 + F.floor(F.col("y") / 5)).alias("cells"))


@query("interpolate_gaps", f"""WITH {TRK_SQL}, b AS (SELECT state AS scope, track_id, frame // 60 AS frame, min(x) AS x, min(y) AS y FROM trk GROUP BY 1, 2, 3),
n AS (SELECT *, lead(frame) OVER w AS nf, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM b WINDOW w AS (PARTITION BY scope, track_id ORDER BY frame)), f AS (SELECT DISTINCT scope, frame FROM b)
SELECT f.scope, track_id, f.frame, round(x + (f.frame - n.frame) / CAST(nf - n.frame AS double) * (nx - x), 6) AS x1, round(y + (f.frame - n.frame) / CAST(nf - n.frame AS double) * (ny - y), 6) AS y1 FROM n JOIN f ON f.scope = n.scope AND f.frame > n.frame AND f.frame < nf WHERE nf - n.frame BETWEEN 2 AND 90""")  # fmt: skip
def interpolate_gaps(spark, sf_dir):
    b = track_rows(spark, sf_dir).groupBy(F.col("state").alias("scope"), "track_id", F.floor(F.col("frame") / 60).alias("frame")).agg(F.min("x").alias("x1"), F.min("y").alias("y1"))
    b = b.withColumns({"x2": F.col("x1") + 5, "y2": F.col("y1") + 5})
    return rounded(tracks.interpolate(b, b, 90).select("scope", "track_id", "frame", "x1", "y1"))


@query("motion_state")
def motion_state(spark, sf_dir):
    return matching.motion_states(tracks.kinematics(track_rows(spark, sf_dir), 5000), 0.02, 0.5)


@query("oscillation")
def oscillation(spark, sf_dir):
    return rounded(matching.oscillation(track_rows(spark, sf_dir), "x"))


@query("gate_crossings")
def gate_crossings(spark, sf_dir):
    """Confirmed crossings of a segment by every track; event minutes are the frames."""
    from ..streaming.gate import Gate, gate_crossings

    # of several events in a minute the first one counts
    first = track_rows(spark, sf_dir).groupBy("track_id", "frame").agg(F.min_by(F.struct("x", "y"), "event_id").alias("p"))
    obs = first.select("track_id", "frame", F.col("p.x").cast("double").alias("x"), F.col("p.y").cast("double").alias("y"), F.lit(1000.0).alias("body"))
    return gate_crossings(obs, Gate(0, 50, 100, 50, fps=1.0, confirm_seconds=1, max_gap_seconds=5000, cooldown_seconds=0))
