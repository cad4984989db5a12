"""Operators inside a frame keep videos apart, and null keys are keys like any other."""

import pytest

from trackloom.operators import duplicates, entities, evidence, labels, matching, reports, reviews
from trackloom.operators.grouped import per_group
from trackloom.operators.tracking_metrics import clear, frame_matches

KEYS = ["video", "frame"]
POSED = "video string, frame long, det long, track_id long, x1 double, y1 double, x2 double, y2 double, conf double, origin string, head_x double, head_y double, head_c double, tail_x double, tail_y double, tail_c double, length double"


def box(video, frame, det, x=0.0, track=None):
    return (video, frame, det, det if track is None else track, x, 0.0, x + 20, 20.0, 0.9 - det / 100, "observed", x + 2, 2.0, 0.9, x + 18, 18.0, 0.9, 20.0)


@pytest.fixture(scope="module")
def two(spark):
    """One box at the same place of frame 0 in two videos, and a double in the second."""
    return spark.createDataFrame([box("a", 0, 0), box("b", 0, 1), box("b", 0, 2, 1.0), box(None, 0, 3), box(None, None, 4), box(None, None, 5)], POSED)


def kept(df, column="kept"):
    return sorted(r["det"] for r in df.where(column).collect())


def test_doubles(two):
    for found in (duplicates.drop_direct_doubles(two, keys=KEYS), duplicates.drop_by_track(two, keys=KEYS), duplicates.drop_by_track(two, True, keys=KEYS), duplicates.drop_contained_first(two, keys=KEYS)):
        assert kept(found) == [0, 1, 3, 4]
    groups = {r["det"]: r["group_id"] for r in duplicates.merge_pose_groups(two, keys=KEYS).collect()}
    assert groups == {0: 0, 1: 1, 2: 1, 3: 3, 4: 4, 5: 4}
    assert {r["det"]: r["cluster"] for r in duplicates.cluster_evidence(two, keys=KEYS).collect()} == {0: 0, 1: 1, 2: 1, 3: 3, 4: 4, 5: 4}


def test_suppression(two):
    assert kept(matching.suppress(two, 0.5, [two["det"]], keys=KEYS)) == [0, 1, 3, 4]
    assert len([r for r in matching.soft_nms(two, keys=KEYS).collect() if r["score"] > 0.8]) == 4


def test_matches(two):
    got = sorted((r["video"] or "", r["pred_det"], r["gt_det"]) for r in matching.hungarian(two, two, keys=KEYS).collect())
    assert got == [("", 3, 3), ("", 4, 4), ("", 5, 5), ("a", 0, 0), ("b", 1, 1), ("b", 2, 2)]
    hits = matching.greedy_matches(two, two.where("det <> 2"), [0.5], KEYS)
    assert {r["det"]: r["bits"] for r in hits.collect()} == {0: 1, 1: 1, 2: 0, 3: 1, 4: 1, 5: 1}
    assert matching.average_precision(hits, two.where("det <> 2"), [0.5], KEYS).first()["recall"] == 1
    assert {r["det"]: r["status"] for r in reviews.match_classes(two, two.where("video = 'b' and det = 1"), keys=KEYS).where("video is not null").collect()} == {0: "fp", 1: "tp", 2: "duplicate"}


def test_pairs(two):
    assert sorted((r["a_det"], r["b_det"]) for r in evidence.overlap_pairs(two, keys=KEYS).collect()) == [(1, 2), (4, 5)]
    assert {r["det"]: r["error"] > 0 for r in evidence.frame_evidence(two, KEYS).collect()} == {0: False, 1: True, 2: True, 3: False, 4: True, 5: True}
    near = reports.near_by_length(two, keys=KEYS)
    assert sorted((r["a"], r["b"]) for r in near.collect()) == [(1, 2), (4, 5)]
    assert sorted((r["a"], r["b"]) for r in labels.mutual_nearest(near, KEYS).collect()) == [(1, 2), (4, 5)]
    assert {r["det"]: r["to"] for r in labels.snap(two, two.where("det in (0, 1)"), keys=KEYS).collect()} == {0: 0, 1: 1, 2: 1, 3: None, 4: None, 5: None}
    assert {r["det"]: r["consistency"] > 0 for r in reviews.set_consistency(two, two.where("video = 'a'"), keys=KEYS).collect()} == {k: k == 0 for k in range(6)}
    points = two.selectExpr("video", "frame", "det as point", "x1 + 9 as x", "9.0D as y")
    assert {r["point"]: r["det"] for r in entities.points_in_boxes(points, two.where("det = 1"), KEYS).collect()} == {2: 1}


def test_null_keys_over_many_batches(spark):
    rows = spark.range(5000).selectExpr("if(id % 2 = 0, null, id div 100) as frame", "id as det").coalesce(1)
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = per_group(rows, ["frame"], ["det"], lambda g: {"frame": g["frame"][:1], "n": [len(g["det"])]}, "frame long, n long").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert len(got) == 51 and {r["frame"]: r["n"] for r in got}[None] == 2500 and sum(r["n"] for r in got) == 5000


def test_clear_counts_detections_without_identity(spark):
    rows = spark.createDataFrame([("s", 0, None, 0.0), ("s", 0, 1, 50.0)], "seq string, frame long, track_id long, x1 double").selectExpr("*", "0.0D as y1", "x1 + 20 as x2", "20.0D as y2")
    r = clear(rows, frame_matches(rows, rows), rows).first()
    assert (r["tp"], r["fp"], r["fn"]) == (2, 0, 0)
