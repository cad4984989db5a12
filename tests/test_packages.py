"""Archives, COCO, manifests, seeds, and small cases of entity, review, stitching and report operators."""

import io
import json
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from trackloom.operators import entities, evidence, quality, reports, reviews, sampling, stitching
from trackloom.sources import packages


def test_members(spark, tmp_path):
    doc = json.dumps({"imagePath": "a.jpg", "imageWidth": 9, "imageHeight": 9, "shapes": [{"label": "bee", "shape_type": "rectangle", "group_id": 7, "points": [[5, 6], [1, 2]]}] * 2}).encode()
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x/2.json", doc), z.writestr("x/1.json", doc), z.writestr("note.txt", "no")
    with tarfile.open(tmp_path / "b.tar.gz", "w:gz") as t:
        info = tarfile.TarInfo("3.json")
        info.size = len(doc)
        t.addfile(info, io.BytesIO(doc))
    (tmp_path / "4.json").write_bytes(doc)
    found = packages.read_members(spark, f"file://{tmp_path}", r".*\.json")
    assert sorted(r["name"] for r in found.collect()) == ["3.json", "4.json", "x/1.json", "x/2.json"]
    boxes = packages.labelme_members(found).collect()
    assert len(boxes) == 8 and {(r["x1"], r["y1"], r["x2"], r["y2"], r["group_id"]) for r in boxes} == {(1, 2, 5, 6, 7)}
    odd = spark.createDataFrame([("p", json.dumps({"shapes": [{"label": "a", "shape_type": "polygon", "points": []}]}).encode())], "name string, content binary")
    with pytest.raises(Exception, match="not a rectangle"):
        packages.labelme_members(odd).collect()


def test_coco_and_manifest(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"images": [{"id": 1, "file_name": "a", "width": 10, "height": 10}, {"id": 2, "file_name": "b"}], "annotations": [{"id": 5, "image_id": 1, "category_id": 0, "bbox": [1, 2, 3, 4], "track_id": 9}, {"id": 6, "image_id": 1, "bbox": [0, 0, 1, 1], "iscrowd": 1}, {"id": 7, "image_id": 3, "bbox": [0, 0, 1, 1]}]}))
    got = {r["ann_id"]: r for r in packages.read_coco(spark, str(tmp_path / "c.json")).collect()}
    assert sorted(got) == [5, 7] and (got[5]["x2"], got[5]["y2"], got[5]["file_name"], got[7]["file_name"]) == (4, 6, "a", None)
    lines = [{"sample_id": "s", "split": "val", "annotations": [{"bbox": [0, 0, 1, 1], "track_id": 1}, {"bbox": [0, 0, 2, 2], "track_id": 2, "track_mask": False}, {"bbox": [0, 0, 3, 3], "det_mask": False}]}, {"sample_id": "t", "split": "train", "annotations": [{"bbox": [0, 0, 1, 1]}]}]
    (tmp_path / "m.jsonl").write_text("".join(json.dumps(x) + "\n" for x in lines))
    assert [(r["pos"], r["track_id"]) for r in packages.read_manifest(spark, str(tmp_path / "m.jsonl"), "val").orderBy("pos").collect()] == [(0, 1), (1, None)]
    frames = spark.range(10).withColumnRenamed("id", "frame")
    assert packages.frames_between(frames, 3, 5).count() == 3 and packages.frames_between(frames, None, None).count() == 10


def test_seeds(spark):
    rows = [(0, 0, 0, 0.9, 0.0, 0.0, 20.0, 20.0), (0, 1, 0, 0.8, 1.0, 1.0, 21.0, 21.0), (0, 2, 0, 0.7, 50.0, 0.0, 70.0, 20.0), (0, 3, 0, 0.2, 90.0, 0.0, 99.0, 9.0), (0, 4, 1, 0.9, 200.0, 0.0, 220.0, 20.0), (0, 5, 0, 0.9, 300.0, 0.0, 303.0, 20.0)]
    dets = spark.createDataFrame(rows, "frame long, det long, class_id int, conf double, x1 double, y1 double, x2 double, y2 double")
    assert {r["det"]: r["seed_id"] for r in packages.tracker_seeds(dets).collect()} == {0: 1, 2: 2}


def test_null_keys_keep_their_rows(spark):
    rows = spark.createDataFrame([("a", 0.1, 1.0), ("a", 0.3, 1.0), (None, 0.2, 1.0)], "k string, error double, score double")
    assert evidence.q2(rows.withColumn("scope", F.lit(None).cast("string")), ["scope"], "k").count() == 3
    assert quality.label_filter(rows, "k").count() == 3
    target = spark.createDataFrame([("a", 0.5), (None, 0.5)], "k string, target double")
    assert {r["k"]: r["factor"] > 0 for r in sampling.repeat_factors(rows, "k", target, F.lit(1.0), F.lit(True)).collect()} == {"a": True, None: True}
    one = lambda c: spark.createDataFrame([("a", 0.5), (None, 0.5)], f"k string, {c} double")
    assert {r["k"]: round(r["target"], 6) for r in sampling.target_distribution(one("app"), one("bench"), one("error"), "k").collect()} == {"a": 0.5, None: 0.5}


def test_reviews_refuse_conflicts(spark):
    queue = spark.createDataFrame([("e1", "unconfirmed"), ("e2", "unconfirmed")], "event_id string, status string")
    fields = "decision_id string, event_id string, action string, human_label string, reviewer string"
    fine = spark.createDataFrame([("d1", "e1", "confirm", "calm", "r"), ("d1", "e1", "confirm", "calm", "r")], fields)
    assert {r["event_id"]: r["status"] for r in reviews.apply_colony_reviews(queue, fine).collect()} == {"e1": "human_confirmed", "e2": "unconfirmed"}
    for bad in ([("d1", "e1", "confirm", "calm", "r"), ("d1", "e1", "reject", None, "r")], [("d1", "e1", "confirm", " ", "r")], [("d1", "e1", "maybe", "x", "r")]):
        with pytest.raises(Exception, match="decision|label|action"):
            reviews.apply_colony_reviews(queue, spark.createDataFrame(bad, fields)).collect()


def test_match_classes_and_window_splits(spark):
    box = "frame long, det long, conf double, x1 double, y1 double, x2 double, y2 double"
    pred = spark.createDataFrame([(0, 0, 0.9, 0.0, 0.0, 10.0, 10.0), (0, 1, 0.8, 1.0, 0.0, 11.0, 10.0), (0, 2, 0.7, 50.0, 0.0, 60.0, 10.0)], box)
    assert {r["det"]: r["status"] for r in reviews.match_classes(pred, pred.where("det = 0")).collect()} == {0: "tp", 1: "duplicate", 2: "fp"}
    frames = spark.createDataFrame([("s", 1, "train"), ("s", 2, "test")], "scope string, frame long, split string")
    events = spark.createDataFrame([("s", 0, 1, 2, "x")], "scope string, window_index long, first_frame long, last_frame long, label string")
    with pytest.raises(Exception, match="several splits"):
        reviews.window_records(events, frames).collect()


def test_points_in_boxes(spark):
    boxes = spark.createDataFrame([(0, 0, 0.0, 0.0, 10.0, 10.0), (0, 1, 2.0, 2.0, 6.0, 6.0)], "frame long, det long, x1 double, y1 double, x2 double, y2 double")
    points = spark.createDataFrame([(0, 0, 4.0, 4.0), (0, 1, 5.0, 5.0), (0, 2, 50.0, 5.0)], "frame long, point long, x double, y double")
    assert {r["point"]: r["det"] for r in entities.points_in_boxes(points, boxes).collect()} == {0: 1, 1: 0}


def test_stitches_save_most(spark):
    pairs = spark.createDataFrame([("v", "a", "b", 1, 0.1), ("v", "a", "c", 1, 0.2), ("v", "d", "b", 1, 0.2), ("v", "d", "c", 1, 1.7)], "video string, left_piece string, right_piece string, gap long, cost double")
    assert {(r["left_piece"], r["right_piece"]) for r in stitching.stitches(pairs, "video").collect()} == {("a", "c"), ("d", "b")}


def test_bootstrap_and_guard(spark):
    rows = spark.createDataFrame([(k, float(k % 2)) for k in range(40)], "k long, v double")
    r = reports.bootstrap_interval(rows, "k", "v", 300).first()
    assert r["low"] < 0.5 < r["high"] and r["n"] == 40 and 0.3 < r["low"] and r["high"] < 0.7
    m = spark.createDataFrame([("v", True, False)], "video string, hit boolean, confirmed boolean")
    with pytest.raises(Exception, match="unconfirmed"):
        reports.evaluation_report(m, ["video"], F.col("confirmed")).collect()


def test_frame_and_round_exports(spark, tmp_path):
    from trackloom.sinks import rows as sink

    frames = spark.createDataFrame([("IR_in", "v", 1, "train"), ("IR_in", "v", 2, "test"), ("RGB_out", "w", 1, "train")], "domain string, video string, frame long, split string")
    sink.write_frames(frames, str(tmp_path / "f"))
    assert sorted(map(tuple, spark.read.json(str(tmp_path / "f")).select("domain", "video", "frame").collect())) == [("IR_in", "v", 1), ("IR_in", "v", 2), ("RGB_out", "w", 1)]
    first = {r["split"]: (r["rows"], r["digest"]) for r in sink.export_round(frames, str(tmp_path / "a"), "frame").collect()}
    again = {r["split"]: (r["rows"], r["digest"]) for r in sink.export_round(frames.repartition(3), str(tmp_path / "b"), "frame").collect()}
    assert first == again and first["train"][0] == 2 and spark.read.json(str(tmp_path / "a" / "data")).count() == 3
    with pytest.raises(Exception, match="(?i)exist"):
        sink.export_round(frames, str(tmp_path / "a"), "frame")


def test_near_starts(spark):
    import itertools
    import random

    rng = random.Random(6)
    rows = [(rng.choice(["v", "w", None]), k, f := rng.randint(0, 400), f + rng.randint(0, 60), *(rng.uniform(-100, 100) for _ in range(4))) for k in range(120)]
    table = spark.createDataFrame(rows, "video string, piece long, first_frame long, last_frame long, start_x double, start_y double, end_x double, end_y double")
    got = {(r["left_piece"], r["right_piece"]) for r in stitching.near_starts(table, "video", "piece", 90, 45.0).collect()}
    near = lambda a, b: a[0] == b[0] and 1 <= b[2] - a[3] <= 90 and abs(b[4] - a[6]) <= 45 and abs(b[5] - a[7]) <= 45
    assert got == {(a[1], b[1]) for a, b in itertools.permutations(rows, 2) if near(a, b)} and got
