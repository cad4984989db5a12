"""Structural duplicates, track features, checks of frames and numbers."""

import math
import random

import pytest
from pyspark.sql import functions as F

from trackloom.operators import duplicates, stitching, tracks
from trackloom.sinks import rows as sink
from trackloom.sources import frames, packages


def test_structural_duplicates(spark):
    rnd, data = random.Random(1), []
    for frame in range(40):
        for k in range(rnd.randint(1, 3)):
            x, y = 100.0 * k, rnd.uniform(0, 5)
            for _ in range(rnd.randint(1, 4)):
                j = lambda s: rnd.uniform(-s, s)
                p = [x + j(1), y + j(1), x + 20 + j(5), y + 20 + j(1)]
                turn = rnd.random() < 0.2
                body = [x + 3 + j(1.5), y + 3 + j(1.5), x + 17 + j(2), y + 17 + j(2)]
                data.append(("v" if frame % 2 else None, frame // 2, len(data), *p, *(body[2:] + body[:2] if turn else body), rnd.choice([0.5, 0.6, 0.7, None])))
    data += [("w", 0, 9001, *data[0][3:7], None, 1.0, 2.0, 3.0, 0.9), ("w", 0, 9002, *data[0][3:7], None, 1.0, 2.0, 3.0, 0.9)]
    schema = "video string, frame long, det long, x1 double, y1 double, x2 double, y2 double, head_x double, head_y double, tail_x double, tail_y double, conf double"

    def like(a, b):
        (ax1, ay1, ax2, ay2), (bx1, by1, bx2, by2) = a[3:7], b[3:7]
        both = max(0, min(ax2, bx2) - max(ax1, bx1)) * max(0, min(ay2, by2) - max(ay1, by1))
        union = (ax2 - ax1) * (ay2 - ay1) + (bx2 - bx1) * (by2 - by1) - both
        scale = 0.1 * (math.hypot(ax2 - ax1, ay2 - ay1) + math.hypot(bx2 - bx1, by2 - by1)) / 2
        oks = sum(math.exp(-math.dist(a[i : i + 2], b[i : i + 2]) ** 2 / (2 * scale**2)) for i in (7, 9)) / 2
        u, v = (a[9] - a[7], a[10] - a[8]), (b[9] - b[7], b[10] - b[8])
        lu, lv = math.hypot(*u), math.hypot(*v)
        turn = math.degrees(math.acos(max(-1, min(1, (u[0] * v[0] + u[1] * v[1]) / (lu * lv)))))
        return both / union >= 0.75 and oks >= 0.8 and abs(lu - lv) / max(lu, lv) <= 0.2 and turn <= 20

    want = {}
    for key in {d[:2] for d in data}:
        held = []
        for d in sorted((d for d in data if d[:2] == key), key=lambda d: (-(d[11] if d[11] is not None else -1), d[2])):
            want[d[2]] = d[7] is None or not any(h[7] is not None and like(h, d) for h in held)
            held += [d] * want[d[2]]
    found = {r.det: r.kept for r in duplicates.structural_duplicates(spark.createDataFrame(data, schema), ["video", "frame"]).collect()}
    assert found == want and 0 < sum(found.values()) < len(data)


def test_track_features(spark):
    rows = [("v", 1, 0, 1, 0.0, 0.0, 3.0, 4.0, None, None, None, None), ("v", 1, 4, 2, 5.0, 10.0, 11.0, 12.0, 1.0, 1.0, 4.0, 5.0), ("v", 1, 4, 3, 5.0, 10.0, 11.0, 12.0, 1.0, 1.0, 1.0, 1.0), ("v", 1, 5, 1, 5.0, 10.0, 11.0, 12.0, 1.0, 1.0, 1.0, 1.0), ("v", None, 0, 4, 0.0, 0.0, 1.0, 1.0, None, None, None, None), ("v", None, 1, 5, 0.0, 0.0, 1.0, 1.0, None, None, None, None)]
    df = spark.createDataFrame(rows, "video string, track_id long, frame long, det long, x1 double, y1 double, x2 double, y2 double, head_x double, head_y double, tail_x double, tail_y double").withColumns({"head_c": F.lit(None).cast("double"), "tail_c": F.lit(0.5)})
    found = {(r.frame, r.det): r for r in tracks.track_features(df, ["video", "track_id"], ["frame", "det"]).collect()}
    assert found[0, 1].track_geometry is None and not found[0, 1].geometry_mask and not found[4, 3].geometry_mask and not found[1, 5].geometry_mask
    assert found[4, 2].axis_mask and all(abs(a - b) < 1e-12 for a, b in zip(found[4, 2].track_geometry, (6.5 / 5, 9 / 5, math.log(2), math.log(0.5), 0.6, 0.8)))
    assert found[5, 1].geometry_mask and not found[5, 1].axis_mask and found[5, 1].track_geometry == [0] * 6


def test_similarities_of_candidates(spark):
    obs = spark.createDataFrame([("v", p, f, float(f), 0.0, 10.0, *u) for p, s, u in ((1, 0, (1.0, 0.0)), (2, 10, (-1.0, 0.0)), (3, 10, (None, None))) for f in range(s, s + 5)], "video string, piece long, frame long, x double, y double, diag double, ux double, uy double")
    ends = stitching.endpoints(obs, ["video", "piece"], ["frame"], also=("ux", "uy"))
    plain = {r.right_piece: r.cost for r in stitching.stitch_candidates(ends.drop("end_ux"), "video", "piece", 60).collect()}
    found = {r.right_piece: r for r in stitching.stitch_candidates(ends, "video", "piece", 60).collect()}
    assert abs(found[2].cost - plain[2] - 0.2) < 1e-12 and found[2].orientation_similarity == -1
    assert abs(found[3].cost - plain[3]) < 1e-12 and found[3].orientation_similarity is None


def test_refused(spark, tmp_path):
    box = lambda *b, t=None: {"bbox_xyxy": list(b), "track_id": t}
    docs = [{"video": "v", "domain": "IR_in", "frame": "1", "detections": [box(0.0, 0.0, 1.0, 1.0, t=1)]}]
    good = frames.normalize(spark.createDataFrame(docs, frames.FRAME))
    assert frames.checked(good) is good
    bad = frames.normalize(spark.createDataFrame([docs[0] | {"domain": "zz", "detections": [box(1.0, 0.0, 1.0, 1.0, t=1), box(0.0, 0.0, 2.0, 1.0, t=1)]}], frames.FRAME))
    with pytest.raises(ValueError, match="bad_domain .*degenerate_box .*duplicate_track"):
        frames.checked(bad)
    sink.write_frames(good, f"file://{tmp_path}/good")
    assert spark.read.json(f"file://{tmp_path}/good").count() == 1
    with pytest.raises(Exception, match="not finite"):
        sink.write_frames(frames.normalize(spark.createDataFrame([docs[0] | {"detections": [box(0.0, float("nan"), 1.0, 1.0)]}], frames.FRAME)), f"file://{tmp_path}/bad")
    label = b'{"imageWidth": 9, "imageHeight": 9, "shapes": [{"label": "wasp", "shape_type": "rectangle", "points": [[1, 2], [3, 4]]}]}'
    with pytest.raises(Exception, match="undeclared label wasp"):
        packages.frames_of_members(spark.createDataFrame([("a_1.json", label)], "name string, content binary")).collect()
