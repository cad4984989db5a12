"""Bounded fills against plain loops."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from trackloom.operators import fills, matching


def test_bounded_fills(spark):
    rnd, rows = random.Random(8), []
    for t in range(14):
        f, x, y, w, h = 0, rnd.uniform(0, 60), rnd.uniform(0, 60), rnd.uniform(8, 40), rnd.uniform(6, 20)
        while f < 160:
            rows.append(("s", t, f, x, y, x + w, y + h))
            step = rnd.choice([1, 1, 2, 5, 20, 40, 100])
            f, x, y = f + step, x + rnd.uniform(-6, 6), y + rnd.uniform(-6, 6)
            w, h = w * rnd.choice([1, 1, 1.3, 0.7]), h
    rows += [("s", None, f, 0.0, 0.0, 70.0, 70.0) for f in range(0, 160, 7)] + [("z", 1, 0, 0.0, 0.0, 9.0, 9.0), ("z", 1, 3, 0.0, 0.0, 9.0, 9.0)]
    df = spark.createDataFrame(rows, "scope string, track_id long, frame long, x1 double, y1 double, x2 double, y2 double")
    frames = {(r[0], r[2]) for r in rows}
    made = {}
    for scope, t in {r[:2] for r in rows if r[1] is not None}:
        own = sorted((r for r in rows if r[:2] == (scope, t)), key=lambda r: r[2])
        for a, b in zip(own, own[1:]):
            gap, (p, q) = b[2] - a[2] - 1, (a[3:], b[3:])
            far = math.hypot((q[0] + q[2] - p[0] - p[2]) / 2, (q[1] + q[3] - p[1] - p[3]) / 2)
            size = [(r[2] - r[0], r[3] - r[1]) for r in (p, q)]
            ratio = max(max(u / max(v, 1), v / max(u, 1)) for u, v in zip(*size))
            safe = far <= min(40, 8 + 2 * (gap + 1)) and ratio <= 2 if gap <= 30 else gap <= 150 and far <= min(16, 0.35 * min(math.hypot(*s) for s in size)) and ratio <= 1.5
            for f in range(a[2] + 1, b[2]) if safe else ():
                box = [u + (f - a[2]) / (b[2] - a[2]) * (v - u) for u, v in zip(p, q)]
                if (scope, f) in frames and max(box[2] - box[0], box[3] - box[1]) / min(box[2] - box[0], box[3] - box[1]) < 6:
                    made[scope, t, f] = (box, a[2], gap)
    want = {}
    for scope, f in frames:
        held = [r[3:] for r in rows if (r[0], r[2]) == (scope, f)]
        for k in sorted((k for k in made if (k[0], k[2]) == (scope, f)), key=lambda k: (-(made[k][0][2] - made[k][0][0]) * (made[k][0][3] - made[k][0][1]), k[1])):
            b = made[k][0]
            area = lambda r: (r[2] - r[0]) * (r[3] - r[1])
            common = [max(0, min(b[2], r[2]) - max(b[0], r[0])) * max(0, min(b[3], r[3]) - max(b[1], r[1])) / min(area(b), area(r)) for r in held]
            want[k] = max(common, default=0) < 0.8
            held += [b] * want[k]
    found = {(r.scope, r.track_id, r.frame): r for r in fills.bounded_fills(df, df).collect()}
    assert {k: r.accepted for k, r in found.items()} == want and 0 < sum(want.values()) < len(want)
    assert all((r.before, r.missing) == made[k][1:] and all(abs(u - v) < 1e-9 for u, v in zip((r.x1, r.y1, r.x2, r.y2), made[k][0])) for k, r in found.items())
    assert fills.bounded_fills(df.limit(0), df).isEmpty()


def test_large_frames_are_compared_in_tiles(spark, monkeypatch):
    """A frame of many boxes never makes one table of all its pairs, and the choice is that of the plain pass."""
    rng = np.random.default_rng(3)
    low = rng.integers(0, 60, (900, 2)).astype(float)
    boxes = np.concatenate([low, low + rng.integers(15, 25, (900, 2))], axis=1)
    sure = np.arange(900) < 40
    largest, plain = [], matching.overlaps

    def seen(a, b):
        largest.append(len(a) * len(b))
        return plain(a, b)

    for measure, least in (("iou", 0.5), ("io_min", 0.8)):
        score = plain(boxes, boxes)[2 if measure == "iou" else 1]
        kept, blocker = sure.copy(), np.full(900, -1)
        for i in range(40, 900):
            hit = np.flatnonzero(kept[:i] & (score[i, :i] >= least))
            kept[i] = not len(hit)
            if len(hit):
                blocker[i] = hit[score[i][hit].argmax()]
        monkeypatch.setattr(matching, "overlaps", seen)
        found = matching.unhidden(boxes, sure, np.ones(900, bool), least, measure)
        short = matching.unhidden(boxes, sure, np.ones(900, bool), least, measure, named=False)[0]
        monkeypatch.setattr(matching, "overlaps", plain)
        assert (found[0] == kept).all() and (found[1] == blocker).all() and (short == kept).all() and 40 < kept.sum() < 900
    assert max(largest) <= matching.ROWS * 900 < 900 * 900
    df = spark.createDataFrame([(1, k + 1, *map(float, b)) for k, b in enumerate(boxes)], "frame long, det long, x1 double, y1 double, x2 double, y2 double")
    got = {r["det"]: (r["kept"], r["blocker"]) for r in matching.suppress(df, 0.8, [F.col("det")], "io_min", protected=F.col("det") <= 40).collect()}
    assert got == {k + 1: (bool(kept[k]), int(blocker[k]) + 1 if blocker[k] >= 0 else -1) for k in range(900)}
