"""Results that do not hang on the order of rows, and levels that are told apart after the shuffles."""

import itertools
import math

import duckdb

from trackloom.operators import evidence, tracking_metrics
from trackloom.plans.registry import rounded


def test_octant_does_not_depend_on_the_order_of_rows(spark):
    sides = [(30, 40), (40, 30), (25, 25), (20, 21), (21, 20)]
    s = c = 0.0
    for w, h in sides:
        s, c = s + math.sin(math.atan2(h, w)), c + math.cos(math.atan2(h, w))
    want = int(math.atan2(s / 5, c / 5) // (math.pi / 4))
    rows = [(k, det, det, 0, 0, *sides[det]) for k, order in enumerate(itertools.permutations(range(5))) for det in order]
    dets = spark.createDataFrame(rows, "frame long, det int, track_id long, x1 long, y1 long, x2 long, y2 long").coalesce(1)
    spread = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}  # as on large tables
    was = {k: spark.conf.get(k) for k in spread}
    try:
        for k, v in spread.items():
            spark.conf.set(k, v)
        found = evidence.frame_record(dets).collect()
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    assert len(found) == 120 and {r.octant for r in found} == {want} and {r.track_ids for r in found} == {"0,1,2,3,4"}


def test_hota_has_one_row_a_pair_of_tracks_until_its_last_sum(spark):
    boxes = spark.createDataFrame([("s", f, t, 50.0 * t, 0.0, 50.0 * t + 10, 10.0) for f in range(4) for t in range(3)], "seq string, frame long, track_id long, x1 double, y1 double, x2 double, y2 double")
    found = tracking_metrics.hota(boxes, boxes)
    assert all(abs(v - 1) < 1e-12 for v in found.first())
    plan = found._jdf.queryExecution().analyzed().toString()
    assert not [line for line in plan.splitlines() if "Aggregate [alpha" in line and "gt_id" in line]


def test_octant_on_an_edge_is_that_of_the_sql(spark):
    frames = [[(w, h), (h, w)] for w in range(21, 71) for h in range(20, 60)] + [[(51, 25), (59, 59), (25, 51)]]
    con = duckdb.connect()
    con.execute("create table b as select * from (values " + ", ".join(f"({f}, {w}, {h}, {d})" for f, sides in enumerate(frames) for d, (w, h) in enumerate(sides)) + ") t(f, w, h, d)")
    want = dict(con.execute("select f, cast(floor(a / (pi() / 4)) as int) from (select f, atan2(avg(sin(atan2(h, w)) order by d), avg(cos(atan2(h, w)) order by d)) as a from b group by f)").fetchall())
    rows = [(f, d, d, 100 * d, 0, 100 * d + w, h) for f, sides in enumerate(frames) for d, (w, h) in enumerate(sides)]
    dets = spark.createDataFrame(rows, "frame long, det int, track_id long, x1 long, y1 long, x2 long, y2 long")
    assert {r.frame: r.octant for r in evidence.frame_record(dets).collect()} == want


def test_halves_are_rounded_as_in_the_sql(spark):
    values = [n / d for d in (128, 640, 1280, 3200) for n in range(-d, d)] + [0.0, -0.0, 1e300, float("inf"), float("-inf"), None, 0.49999999999999994e-6]
    got = [r.v for r in rounded(spark.createDataFrame([(v,) for v in values], "v double").coalesce(1)).collect()]
    assert got == [duckdb.execute("select round(?::double, 6)", [v]).fetchone()[0] for v in values]
    assert math.isnan(rounded(spark.createDataFrame([(float("nan"),)], "v double")).first().v)
