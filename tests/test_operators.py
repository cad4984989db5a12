"""Operators on small literal inputs."""

import itertools
import json

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trackloom.operators import colony, evidence, matching, quality, sampling, tracks, trackers
from trackloom.sinks import rows as sink_rows
from trackloom.sources import frames as sources
from trackloom.streaming.gate import Gate, gate_crossings, stream_crossings

BOXES = "frame long, det long, x1 double, y1 double, x2 double, y2 double, conf double, origin string, class_id int, track_id long"


def boxes(spark, rows):
    return spark.createDataFrame([(f, d, *map(float, b), float(c), o, k, t) for f, d, b, c, o, k, t in rows], BOXES)


def test_suppression_keeps_observed_and_hides_fills(spark):
    rows = [(0, 1, (0, 0, 10, 10), 0.9, "observed", 0, 1), (0, 2, (5, 0, 15, 10), 0.8, "observed", 0, 2), (0, 3, (1, 1, 11, 11), 0.7, "linear_interpolation", 0, 3), (0, 4, (50, 50, 60, 60), 0.6, "linear_interpolation", 0, 4)]
    out = matching.suppress(boxes(spark, rows), 0.2, [F.desc("conf"), F.col("det")], "io_min", 16, F.col("origin") == "observed").orderBy("det").collect()
    assert [(r["det"], r["kept"], r["blocker"]) for r in out] == [(1, True, -1), (2, True, -1), (3, False, 1), (4, True, -1)]


def test_nms_is_idempotent(spark):
    rng = np.random.default_rng(1)
    rows = [(f, d, (x, y, x + 20, y + 20), c, "observed", 0, d) for f in range(5) for d, (x, y, c) in enumerate(rng.uniform(0, 60, (12, 3)))]
    first = boxes(spark, rows)
    kept = first.join(matching.suppress(first, 0.3, [F.desc("conf"), F.col("det")]).where("kept").select("frame", "det"), ["frame", "det"])
    assert 5 <= kept.count() < first.count()
    assert matching.suppress(kept, 0.3, [F.desc("conf"), F.col("det")]).where("not kept").count() == 0


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 5), st.integers(1, 5), st.integers(0, 10**6))
def test_assignment_is_optimal(n, m, seed):
    cost = np.random.default_rng(seed).integers(0, 9, (n, m)).astype(float)
    pairs = matching.assign(cost)
    a = cost if n <= m else cost.T
    best = min(sum(a[i, p[i]] for i in range(len(a))) for p in itertools.permutations(range(a.shape[1]), len(a)))
    assert len(pairs) == min(n, m) and sum(cost[i, j] for i, j in pairs) == pytest.approx(best)


def test_perfect_predictions(spark):
    gt = boxes(spark, [(f, d, (30 * d, 0, 30 * d + 20, 20), 0.9 - d / 10, "observed", 0, d) for f in range(4) for d in range(3)])
    ap = matching.average_precision(matching.greedy_matches(gt, gt, [0.5, 0.75]), gt, [0.5, 0.75]).collect()
    assert all(r["ap"] == pytest.approx(1) and r["recall"] == 1 and r["false_positives"] == 0 for r in ap) and len(ap) == 2
    assert matching.hungarian(gt, gt).where("pred_det = gt_det and iou > 0.999").count() == 12
    assert matching.hungarian(gt, gt.limit(0)).count() == 0


def test_interpolation_midpoint(spark):
    det = spark.createDataFrame([("s", 1, 0, 0.0, 0.0, 10.0, 10.0), ("s", 1, 2, 10.0, 0.0, 20.0, 10.0), ("s", 2, 1, 0.0, 0.0, 1.0, 1.0), ("s", 1, 200, 0.0, 0.0, 1.0, 1.0)], "scope string, track_id long, frame long, x1 double, y1 double, x2 double, y2 double")
    out = tracks.interpolate(det, det, 90).collect()
    assert [tuple(r)[1:] for r in out if r["track_id"] == 1] == [(1, 1, 5.0, 0.0, 15.0, 10.0)] or [(r["frame"], r["x1"], r["x2"]) for r in out] == [(1, 5.0, 15.0)]


def test_quality_order(spark):
    rows = spark.createDataFrame([("d", "g", 0.0), ("d", "g", 0.1), ("d", "g", 0.9), ("d", "h", 0.9), ("d", "h", 0.8)], "domain string, grp string, error double")
    out = {(r["grp"], r["error"]): r["quality"] for r in evidence.q2(rows, ["domain"], "grp").collect()}
    assert out["g", 0.0] > out["g", 0.1] > out["g", 0.9] and all(0 < v <= 1 for v in out.values())


def test_density_keeps_mass(spark):
    pts = spark.createDataFrame([("a", 0, 0), ("a", 99, 99), ("a", 50, 3), ("b", 10, 90)], "scope string, x int, y int").withColumns({"nx": F.lit(10).cast("long"), "ny": F.lit(10).cast("long")})
    mass = {r["scope"]: r["m"] for r in colony.density_grid(pts, 10).groupBy("scope").agg(F.sum("mass").alias("m")).collect()}
    assert mass["a"] == pytest.approx(3, abs=1e-9) and mass["b"] == pytest.approx(1, abs=1e-9)


def test_change_is_flagged(spark):
    w = spark.createDataFrame([("s", i, 4.0 if i == 7 else 1.0) for i in range(9)] + [("t", i, 1.0) for i in (0, 1, 2, 4, 5, 6)], "scope string, window_index long, v double")
    out = colony.temporal_change(w, "v").collect()
    assert [r["window_index"] for r in out if r["flagged"]] == [7] and {r["scope"] for r in out} == {"s"}


def test_weights(spark):
    rows = spark.createDataFrame([("a", "x")] * 8 + [("a", "y")] * 2 + [("b", "x")] * 5 + [("b", "y")] * 5, "p string, q string")
    w = sampling.raking_weights(rows, ["p", "q"], {"p": {"a": 0.5, "b": 0.5}, "q": {"x": 0.5, "y": 0.5}})
    got = {tuple(r)[:2]: r["m"] for r in w.groupBy("p").agg(F.sum("weight").alias("m")).withColumn("q", F.lit("")).select("p", "q", "m").collect()}
    assert got["a", ""] == pytest.approx(10, rel=0.02) and got["b", ""] == pytest.approx(10, rel=0.02)
    with pytest.raises(ValueError):
        sampling.raking_weights(rows, ["p"], {"p": {"c": 1.0}})
    seats = sampling.largest_remainder(spark.createDataFrame([("a", 1.0), ("b", 1.0), ("c", 1.0)], "k string, s double"), "k", "s", 7).orderBy("k").collect()
    assert [r["seats"] for r in seats] == [3, 2, 2]
    e = sampling.ess_gini(spark.createDataFrame([("k", 1.0)] * 4 + [("z", 0.0), ("z", 1.0)], "k string, w double"), "k", "w").orderBy("k").collect()
    assert (e[0]["ess"], e[0]["gini"]) == (4.0, 0.0) and (e[1]["ess"], e[1]["gini"]) == (1.0, 0.5)


def test_isotonic_is_monotone(spark):
    rng = np.random.default_rng(4)
    rows = spark.createDataFrame([("k", float(s), int(rng.random() < s)) for s in rng.random(300)], "k string, score double, correct int")
    steps = matching.isotonic(rows, ["k"]).orderBy("upper").collect()
    assert all(a["value"] < b["value"] for a, b in zip(steps, steps[1:])) and sum(r["weight"] for r in steps) == 300


def test_beta_update_is_idempotent(spark):
    nodes = spark.createDataFrame([("r", 1.0, 1.0)], "rule string, alpha double, beta double")
    reviews = spark.createDataFrame([(1, "r", True), (1, "r", True)], "review_id long, rule string, confirmed boolean")
    assert quality.beta_update(nodes, reviews).first()["support"] == pytest.approx(2 / 3)


def test_routes(spark):
    s = spark.createDataFrame([(1, "a", 0.9), (1, "a", 0.95), (2, "a", 0.9), (2, "b", 0.9), (3, "a", 0.1)], "id long, family string, p double")
    assert {r["id"]: r["route"] for r in quality.route_candidates(s, "id").collect()} == {1: "ignore", 2: "soft_positive", 3: "background"}


GATE = Gate(0, 50, 100, 50)


def walk(ys, track=1, start=0, x=50.0, step=1):
    return [(track, start + k * step, x, float(y), 20.0) for k, y in enumerate(ys)]


def test_gate(spark):
    steps = [40] * 4 + [49, 51] * 5 + [60] * 4
    rows = walk(steps) + walk(steps, 2, step=10) + walk(steps, 3, x=200.0) + walk([60] * 4 + [51, 49] * 3 + [40] * 5, 4)
    obs = spark.createDataFrame(rows, "track_id long, frame long, x double, y double, body double")
    assert sorted((r["track_id"], r["direction"]) for r in gate_crossings(obs, GATE).collect()) == [(1, "in"), (4, "out")]


def test_gate_stream_equals_batch(spark, tmp_path):
    rng = np.random.default_rng(7)
    rows = [(t, f, 50.0, float(y), 20.0) for t in range(6) for f, y in enumerate(50 + np.cumsum(rng.normal(0, 4, 200)))]
    schema = "track_id long, frame long, x double, y double, body double"
    for k in range(3):
        part = [r for r in rows if k * 70 <= r[1] < (k + 1) * 70]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    q = stream_crossings(stream, GATE).writeStream.format("memory").queryName("crossings").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    want = sorted(map(tuple, gate_crossings(spark.createDataFrame(rows, schema), GATE).collect()))
    assert sorted(map(tuple, spark.sql("select * from crossings").collect())) == want and want


def test_tracker_bridges_weak_boxes_and_gaps(spark):
    rows = [("v", f, 0, 0.3 if f == 3 else 0.9, 10.0 + 2 * f, 10.0, 30.0 + 2 * f, 30.0) for f in range(8) if f != 5] + [("v", f, 1, 0.2, 500.0, 500.0, 520.0, 520.0) for f in range(3)]
    out = trackers.associate(spark.createDataFrame(rows, "video string, frame long, det long, conf double, x1 double, y1 double, x2 double, y2 double")).collect()
    assert {r["track"] for r in out if r["det"] == 0} == {1} and {r["track"] for r in out if r["det"] == 1} == {None}


def test_readers(spark, tmp_path):
    doc = {"video": "v", "domain": "IR_in", "frame": "clip_0012.jpg", "detections": [{"bbox_xyxy": [0, 0, 5, 5], "track_id": 3, "conf": 0.4}, {"bbox_xyxy": [4, 4, 2, 5], "track_id": 3}], "ignore_regions": [{"bbox_xyxy": [0, 0, 1, 1]}]}
    (tmp_path / "f.jsonl").write_text(json.dumps(doc) + "\n")
    frames = sources.normalize(sources.read_frames(spark, str(tmp_path / "f.jsonl")))
    assert frames.first()["sample_id"] == "IR_in/unknown/v/00000012" and frames.first()["fps"] == 30
    dets = sources.detections_of(frames).orderBy("collection", "pos").collect()
    assert [(r["collection"], r["entity_id"][-1], r["confidence"]) for r in dets] == [("detections", "0", 0.4), ("detections", "1", None), ("ignore_regions", "0", None)]
    assert {r["rule"] for r in sources.violations(frames).collect()} == {"degenerate_box", "duplicate_track"}
    shapes = [{"label": "bee", "shape_type": "rectangle", "group_id": 7, "points": [[5, 6], [1, 2]]}, {"label": "bee_shadow", "shape_type": "rectangle", "group_id": 7, "points": [[0, 0], [1, 1]]}, {"label": "head", "shape_type": "point", "group_id": 7, "points": [[3, 3]]}, {"label": "tail", "shape_type": "point", "group_id": 7, "points": [[4, 4]]}]
    (tmp_path / "l.json").write_text(json.dumps({"imagePath": "a.jpg", "imageWidth": 9, "imageHeight": 9, "shapes": shapes}))
    rows = sources.labelme_detections(spark.read.schema(sources.LABELME).option("multiLine", True).json(str(tmp_path / "l.json"))).orderBy("pos").collect()
    assert (rows[0]["x1"], rows[0]["y2"], rows[0]["head"], rows[0]["abdomen_tip"]) == (1.0, 6.0, [3.0, 3.0], [4.0, 4.0]) and rows[1]["head"] is None


def test_exports_round_trip(spark, tmp_path):
    dets = boxes(spark, [(0, 1, (10, 20, 30, 60), 0.9, "observed", 0, 5)]).withColumns({"video": F.lit("v"), "domain": F.lit("IR_in")})
    sink_rows.write_partitioned(sink_rows.mot(dets).select("video", "line"), str(tmp_path / "mot"), "video")
    back = sources.read_mot(spark, str(tmp_path / "mot" / "video=v")).first()
    assert (back["frame"], back["track_id"], back["x1"], back["y1"], back["x2"], back["y2"]) == (0, 5, 10, 20, 30, 60)
    sink_rows.write_partitioned(sink_rows.yolo(dets, 100, 100).select("video", "line"), str(tmp_path / "yolo"), "video")
    back = sources.read_yolo(spark, str(tmp_path / "yolo" / "video=v"), 100, 100).first()
    assert [round(back[c], 6) for c in ("x1", "y1", "x2", "y2")] == [10, 20, 30, 60]
    with pytest.raises(Exception, match="(?i)exist"):
        sink_rows.write_partitioned(sink_rows.mot(dets).select("video", "line"), str(tmp_path / "mot"), "video")


def test_linked_groups_and_splits(spark):
    from trackloom.operators import graph

    chain = [(k, f"k{j}") for k in range(40) for j in (k, k + 1)]
    rows = spark.createDataFrame([*chain, *((100 + k, "hub") for k in range(5)), (200, None), (201, "own")], "sample long, key string")
    groups = graph.linked_groups(rows, "sample", "key")
    got = {r["sample"]: r["group_id"] for r in groups.collect()}
    assert {got[k] for k in range(40)} == {0} and {got[100 + k] for k in range(5)} == {100} and (got[200], got[201]) == (200, 201)
    split = graph.split_groups(groups, "sample", {"train": 0.7, "test": 0.3}).collect()
    assert len(split) == 47 and len({(r["group_id"], r["split"]) for r in split}) == 4 and {r["split"] for r in split if r["group_id"] == 0} == {"train"}
