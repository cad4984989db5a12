"""Candidates beside the boxes of their frame, and what events inherit."""

import random

from trackloom.operators import candidates, quality


def shared(a, b):
    both = max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))
    return both / min((r[2] - r[0]) * (r[3] - r[1]) for r in (a, b))


def test_placed(spark):
    rnd = random.Random(2)
    box = lambda: (x := rnd.randint(0, 60), y := rnd.randint(0, 60), x + rnd.randint(5, 25), y + rnd.randint(5, 25))
    frames = [(v, f) for v in ("a", None) for f in range(25)]
    there = [(v, f, *map(float, box())) for v, f in frames for _ in range(rnd.randint(0, 3))]
    new = [(v, f, k, *map(float, box()), rnd.choice(["soft_positive", "soft_positive", "ignore", "background", None])) for v, f in frames for k in range(rnd.randint(0, 6))]
    want = {}
    for key in frames:
        held = [r[2:] for r in there if r[:2] == key]
        for r in (r for r in new if r[:2] == key):
            seen = any(shared(r[3:7], h) >= 0.5 for h in held)
            want[r[:3]] = "already_observed" if seen else r[7]
            held += [r[3:7]] * (want[r[:3]] == "soft_positive")
    sides = "x1 double, y1 double, x2 double, y2 double"
    rows = candidates.placed_candidates(spark.createDataFrame(new, f"video string, frame long, det long, {sides}, route string"), spark.createDataFrame(there, f"video string, frame long, {sides}"), ["video", "frame"]).collect()
    assert len(rows) == len(new) and {(r.video, r.frame, r.det): r.place for r in rows} == want and "already_observed" in want.values()


def test_inherited(spark):
    events = spark.createDataFrame([(1, ["x", "b", "a"]), (2, ["x"]), (3, []), (4, None), (5, ["c", "a"])], "event_id long, upstream array<string>")
    known = spark.createDataFrame([("a", 1, "p"), ("b", 2, None), ("c", None, None)], "sample_id string, size long, kind string")
    assert {r.event_id: (r["size"], r.kind) for r in candidates.inherited(events, known, ["size", "kind"]).collect()} == {1: (2, None), 2: (None, None), 3: (None, None), 4: (None, None), 5: (None, None)}


def test_weight_of_all_that_is_known(spark):
    scores = spark.createDataFrame([(1, "f", 0.9), (1, "g", 0.95), (1, "h", 0.2), (1, "i", None)], "id long, family string, p double")
    row = quality.route_candidates(scores, "id").head()
    assert (row.route, row.families, row.weight) == ("soft_positive", 2, 0.2)
