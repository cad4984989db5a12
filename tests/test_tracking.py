"""Tracking accuracy, double boxes, the gate and exact curves against small brute force."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from trackloom.operators import colony, duplicates, matching, tracking_metrics
from trackloom.streaming.gate import Gate, gate_crossings

ROWS = "seq string, frame long, track_id long, x1 double, y1 double, x2 double, y2 double"


def track(track_id, frames, at=0.0, seq="s"):
    at = float(at)
    return [(seq, f, track_id, at, at, at + 10, at + 10) for f in frames]


def metrics(spark, gt, pred):
    g, p = spark.createDataFrame(gt, ROWS), spark.createDataFrame(pred, ROWS)
    m = tracking_metrics.frame_matches(g, p)
    return tracking_metrics.clear(g, m, p).first(), tracking_metrics.identity(g, m, p).first(), tracking_metrics.hota(g, p).first()


def test_perfect_and_switched_tracks(spark):
    gt = track(1, range(4)) + track(2, range(4), 100)
    c, i, h = metrics(spark, gt, gt)
    assert (c["mota"], c["id_switches"], c["fragments"], i["idf1"]) == (1, 0, 0, 1) and h["hota"] == pytest.approx(1)
    c, i, h = metrics(spark, track(1, range(4)), track(5, [0, 1]) + track(6, [2, 3]))
    assert (c["mota"], c["id_switches"], i["idtp"], i["idf1"]) == (0.75, 1, 2, 0.5)
    assert h["hota"] == pytest.approx(0.5**0.5) and h["assa"] == pytest.approx(0.5)
    c, i, h = metrics(spark, track(1, range(5)), track(7, [1, 2, 4]))
    assert (c["fn"], c["fp"], c["fragments"], c["id_switches"]) == (2, 0, 2, 0)
    c, _, h = metrics(spark, gt, track(9, range(4), 500))
    assert (c["tp"], c["fp"], c["mota"], h["hota"]) == (0, 4, -0.5, 0)


def test_identity_against_all_permutations(spark):
    rng = random.Random(2)
    gt, pred = [], []
    for f in range(12):
        for k in range(4):
            gt += track(k, [f], 50.0 * k)
            if rng.random() < 0.8:
                pred += track(10 + rng.choice([k, k, (k + 1) % 5]), [f], 50.0 * k)
    seen = {}
    for _, f, t, x, *_ in pred:
        seen[(f, t)] = x
    pred = [r for r in pred if seen[(r[1], r[2])] == r[3]]
    pairs = {}
    for _, f, t, x, *_ in pred:
        pairs[(int(x // 50), t)] = pairs.get((int(x // 50), t), 0) + 1
    best = max(sum(pairs.get((k, 10 + j), 0) for k, j in enumerate(p)) for p in itertools.permutations(range(5), 4))
    assert metrics(spark, gt, pred)[1]["idtp"] == best


def test_context_scores(spark):
    m = spark.createDataFrame([("s", f, 1, 1 if f < 3 else 2) for f in range(6)], "seq string, frame long, gt_id long, pred_id long")
    got = {r["context"]: r for r in tracking_metrics.cast_scores(m, m, m, (1, 10)).collect()}
    assert got[1]["switch"] == pytest.approx(4 / 5) and got[1]["transfer"] == 1 and got[1]["association"] == pytest.approx(4 / 5)
    assert got[10]["switch"] == pytest.approx((1 + 1 + 0 + 1 / 4 + 2 / 5) / 5)


POSED = "frame long, det long, x1 double, y1 double, x2 double, y2 double, conf double, head_x double, head_y double, head_c double, tail_x double, tail_y double, tail_c double, video string, track_id long, origin string"


def posed(det, x, w=20.0, conf=0.9, sure=0.9, track_id=None, frame=0):
    x, w = float(x), float(w)
    return (frame, det, x, 0.0, x + w, 20.0, conf, x + 2, 2.0, sure, x + w - 2, 18.0, sure, "v", track_id if track_id is not None else det, "observed")


def test_doubles(spark):
    # a chain: 0 and 1 are doubles, 1 and 2 are, 0 and 2 are not
    dets = spark.createDataFrame([posed(0, 0, conf=0.9), posed(1, 3, conf=0.8, sure=0.95), posed(2, 6, conf=0.7), posed(3, 300)], POSED)
    got = {r["det"]: (r["kept"], r["by"]) for r in duplicates.drop_direct_doubles(dets).collect()}
    assert got == {0: (True, None), 1: (False, 0), 2: (True, None), 3: (True, None)}
    groups = {r["det"]: (r["group_id"], r["winner"]) for r in duplicates.merge_pose_groups(dets, contained=0.99).collect()}
    assert groups == {0: (0, False), 1: (0, True), 2: (0, False), 3: (3, True)}
    rows = [posed(0, 0, track_id=5), posed(1, 1, track_id=6), posed(0, 0, track_id=6, frame=1), posed(0, 400, track_id=6, frame=2)]
    by = {(r["frame"], r["det"]): r["by"] for r in duplicates.drop_by_track(spark.createDataFrame(rows, POSED)).collect()}
    assert by == {(0, 0): 1, (0, 1): None, (1, 0): None, (2, 0): None}
    rows = [posed(0, 0, 30), posed(1, 1, 20), posed(2, 1.5, 20)]
    staged = {r["det"]: (r["kept"], r["stage"]) for r in duplicates.drop_contained_first(spark.createDataFrame(rows, POSED)).collect()}
    assert staged == {0: (True, None), 1: (False, "containment"), 2: (False, "containment")}
    clusters = {r["det"]: r["cluster"] for r in duplicates.cluster_evidence(dets, 0.6).collect()}
    assert clusters == {0: 0, 1: 0, 2: 2, 3: 3}


def test_suppression_order_and_invalid_boxes(spark):
    rows = [(0, 0, 0.0, 0.0, 20.0, 20.0, True, True, 0), (0, 1, 0.0, 0.0, 20.0, 20.0, False, True, 1), (1, 0, 0.0, 0.0, 20.0, 20.0, True, False, 0), (1, 1, 0.0, 0.0, 20.0, 20.0, False, True, 2), (1, 2, 0.0, 0.0, 20.0, 20.0, False, True, 1)]
    dets = spark.createDataFrame(rows, "frame long, det long, x1 double, y1 double, x2 double, y2 double, sure boolean, ok boolean, gap int")
    got = {(r["frame"], r["det"]): r["kept"] for r in matching.suppress(dets, 0.2, [F.col("gap")], "io_min", 16, F.col("sure"), F.col("ok")).collect()}
    assert got == {(0, 0): True, (0, 1): False, (1, 0): True, (1, 1): False, (1, 2): True}


def gate_by_hand(ys, confirm=3, dead=5, cool=15, line=50.0):
    side = pending = seen = 0
    last, out = -(10**9), []
    for f, y in enumerate(ys):
        s = 0 if abs(y - line) <= dead else 1 if y > line else -1
        seen = 0 if s == 0 else seen + 1 if s == pending else 1
        pending = s
        if seen >= confirm:
            if side and s != side and f - last >= cool:
                out.append((f, "in" if s == 1 else "out"))
                last = f
            side = s
    return out


def test_gate_rules(spark):
    rng = random.Random(9)
    walks = [[40] * 4 + [60, 50, 60, 60], [40, 60, 60, 60], [40] * 3 + [60] * 3, [40] * 3 + [50] * 9 + [60] * 3]
    for _ in range(30):
        y, ys = 50.0, []
        for _ in range(150):
            y = min(80, max(20, y + rng.uniform(-9, 9)))
            ys.append(y)
        walks.append(ys)
    rows = [(t, f, 50.0, float(y), 30.0) for t, ys in enumerate(walks) for f, y in enumerate(ys)]
    got = {}
    for r in gate_crossings(spark.createDataFrame(rows, "track_id long, frame long, x double, y double, body double"), Gate(0, 50, 100, 50)).collect():
        got.setdefault(r["track_id"], []).append((r["frame"], r["direction"]))
        assert r["cross_y"] == pytest.approx(50) and r["cross_x"] == pytest.approx(50)
    want = {t: e for t, ys in enumerate(walks) if (e := gate_by_hand(ys))}
    assert {t: sorted(e) for t, e in got.items()} == want and 0 not in want and 1 not in want and 2 in want and len(want) > 15


def test_density_is_centred_on_the_point(spark):
    pts = spark.createDataFrame([("s", 15.0, 44.0, 10, 10), ("s", -90.0, 0.0, 10, 10)], "scope string, x double, y double, nx long, ny long")
    got = {(r["gx"], r["gy"]): r["mass"] for r in colony.density_grid(pts, 10).collect()}
    assert sum(got.values()) == pytest.approx(1) and got[(1, 4)] == pytest.approx(got[(2, 4)]) and got[(1, 4)] > got[(1, 5)]


def test_exact_curves(spark):
    rows = [(0, 0.90001, 1), (0, 0.90002, 0), (0, 0.90003, 1)]
    steps = matching.isotonic(spark.createDataFrame([("k", s, c) for _, s, c in rows], "k string, score double, correct int"), ["k"])
    assert [(r["upper"], r["value"]) for r in steps.orderBy("upper").collect()] == [(0.90002, 0.5), (0.90003, 1.0)]
    asked = spark.createDataFrame([("k", 0.1), ("k", 0.90003), ("k", 0.99), ("other", 0.5), ("k", None)], "k string, score double")
    assert [r["calibrated"] for r in matching.calibrated(asked, steps, ["k"]).orderBy("k", "score").collect()] == [None, 0.5, 1.0, 1.0, None]
    hits = spark.createDataFrame([(0, d, c, int(h)) for d, (c, h) in enumerate([(0.90003, True), (0.90002, False), (0.90001, True)])] + [(7, 9, 0.99, 0)], "frame long, det long, conf double, bits long")
    truth = spark.createDataFrame([(0,), (0,)], "frame long")
    r = matching.average_precision(hits, truth, [0.5]).first()
    assert r["ap"] == pytest.approx((51 * 1 + 50 * 2 / 3) / 101) and (r["recall"], r["false_positives"]) == (1, 1)
