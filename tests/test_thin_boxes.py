"""Thin boxes against a plain version."""

import random

from trackloom.operators import thin_boxes


def overlap(a, b):
    both = max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))
    sa, sb = ((r[2] - r[0]) * (r[3] - r[1]) for r in (a, b))
    return both / max(sa + sb - both, 1e-6), both / max(min(sa, sb), 1e-6)


def grown(box, others, points):
    size = [box[2] - box[0], box[3] - box[1]]
    axis = 0 if size[0] <= size[1] else 1
    short, long = size[axis], size[1 - axis]
    if short <= 0 or long / short < 3:
        return box, None
    before = [overlap(box, o) for o in others]
    if any(i >= 0.25 or s >= 0.7 for i, s in before) or sum(s >= 0.2 for _, s in before) > 1:
        return box, None
    extra, part = max(2, min(8, 0.4 * short, max(0.25 * short, long / 3 - short))), 0.5
    if None not in points and min(points[2], points[5]) >= 0.15 and (points[2] + points[5]) / 2 >= 0.25:
        place = ((points[axis] + points[3 + axis]) / 2 - box[axis]) / short
        part = 0.75 if 0.6 < place <= 1.1 else 0.25 if -0.1 <= place < 0.4 else 0.5
    for factor in (1, 0.5):
        new = list(box)
        new[axis] = box[axis] - extra * (1 - part) * factor
        new[axis + 2] = box[axis + 2] + extra * part * factor
        new = [max(new[0], 0), max(new[1], 0), min(new[2], 300), min(new[3], 200)]
        after = [overlap(new, o) for o in others]
        if not any(i > 0.32 or (s0 < 0.8 <= s) or s - s0 > 0.18 for (i, s), (_, s0) in zip(after, before)):
            return new, (new[axis + 2] - new[axis]) - short
    return box, None


def test_expand_thin(spark):
    rnd, rows = random.Random(4), []
    for frame in range(60):
        for det in range(rnd.randint(1, 7)):
            x, y, flat = rnd.uniform(0, 80), rnd.uniform(0, 60), rnd.random() < 0.5
            a, b = rnd.choice([(6, 30), (10, 31), (20, 25), (4, 40), (14, 45)])
            w, h = (b, a) if flat else (a, b)
            points = [x + rnd.uniform(0, w), y + rnd.uniform(0, h), rnd.choice([0.1, 0.2, 0.9]), x + rnd.uniform(0, w), y + rnd.uniform(0, h), rnd.choice([0.2, 0.5, 0.9])]
            rows.append(("v" if frame % 2 else None, frame // 2, det, x, y, x + w, y + h, *([None] * 6 if rnd.random() < 0.3 else points)))
    rows += [("z", 0, 0, 295.0, 5.0, 300.0, 40.0, *[None] * 6), ("z", 1, 0, 5.0, 5.0, 5.0, 40.0, *[None] * 6)]
    schema = "video string, frame long, det long, x1 double, y1 double, x2 double, y2 double, head_x double, head_y double, head_c double, tail_x double, tail_y double, tail_c double"
    found = {(r.video, r.frame, r.det): r for r in thin_boxes.expand_thin(spark.createDataFrame(rows, schema), 300, 200, ["video", "frame"]).collect()}
    assert len(found) == len(rows)
    changed = 0
    for r in rows:
        box, added = grown(list(r[3:7]), [o[3:7] for o in rows if o[:2] == r[:2] and o[2] != r[2]], r[7:])
        got = found[r[:3]]
        assert all(abs(u - v) < 1e-9 for u, v in zip((got.x1, got.y1, got.x2, got.y2), box)) and (got.added is None) == (added is None)
        assert added is None or abs(got.added - added) < 1e-9
        changed += added is not None
    assert 20 < changed < len(rows)
