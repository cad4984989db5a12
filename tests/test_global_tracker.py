"""The global tracker: walkers keep their numbers, a stopped stream goes on with the same rows."""

import random

from pyspark.sql import functions as F

from trackloom.operators import global_tracker as gt

BOXES = "video string, frame long, det long, x1 double, y1 double, x2 double, y2 double"


def walkers(frames=60):
    """Five walkers in two videos with noise; one is away for a while, one leaves at the edge and another comes there much later."""
    rng = random.Random(3)
    rows = []
    for v in ("a", "b"):
        for f in range(frames):
            for t in range(5):
                if (t == 1 and 20 <= f < 27) or (t == 4 and 10 <= f < 58):
                    continue
                x, y = (30.0 + 0.1 * f, 500.0) if t == 4 else (400.0 + 150 * t + 2.0 * f, 300.0 + f)
                x, y = x + rng.random(), y + rng.random()
                rows.append((v, f * (1 if v == "a" else 2), t, x - 10, y - 10, x + 10, y + 10))
    return rows


def test_walkers_keep_their_numbers(spark):
    found = gt.global_tracks(spark.createDataFrame(walkers(), BOXES).repartition(5), gt.Limits(edge=40))
    names = {}
    for r in found.collect():
        names.setdefault((r["video"], r["det"]), []).append(r["track"])
    for v in ("a", "b"):
        assert all(len(set(names[v, t])) == 1 for t in range(4))
        assert len({names[v, t][0] for t in range(5)}) == 5
        assert len(set(names[v, 4])) == 2  # away for longer than the edge remembers
    kept = {(r["video"], r["track_id"]): r["boxes"] for r in gt.kept_tracks(found, 30).collect()}
    assert sorted(kept) == [(v, k) for v in "ab" for k in range(1, 5)] and set(kept.values()) == {60, 53}


def test_stopped_and_resumed(spark, tmp_path):
    dets = spark.createDataFrame(walkers(), BOXES)
    want = sorted(map(tuple, gt.global_tracks(dets).collect()))
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for part in range(4):
        # whole frames in order; each run of the query takes what has come until then
        dets.where((F.col("frame") / F.when(F.col("video") == "a", 1).otherwise(2)).between(15 * part, 15 * part + 14.5)).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(dets.schema).option("maxFilesPerTrigger", 1).parquet(source)
        query = gt.stream_global_tracks(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(out).select("video", "frame", "det", "track").collect())) == want


def test_state_round_trip():
    limits = gt.Limits()
    rng = random.Random(1)
    import numpy as np

    frames = [np.array([[100.0 + 3 * f + rng.random(), 200.0], [500.0, 300.0 + 2 * f + rng.random()]]) for f in range(30)]
    whole, half = gt.GlobalTracker(limits), gt.GlobalTracker(limits)
    ids = [whole.update(f, xy).tolist() for f, xy in enumerate(frames)]
    again = []
    for f, xy in enumerate(frames):
        again.append(half.update(f, xy).tolist())
        half = gt.GlobalTracker.load(half.dump(), limits)
    assert ids == again == [[1, 2]] * 30


def test_empty_and_nulls(spark):
    rows = spark.createDataFrame([(None, 0, 0, 1.0, 1.0, 2.0, 2.0), ("a", None, 0, 1.0, 1.0, 2.0, 2.0), ("a", 3, 1, None, 1.0, 2.0, 2.0), ("a", 3, 2, 1.0, 1.0, 2.0, 2.0)], BOXES)
    assert [tuple(r) for r in gt.global_tracks(rows).collect()] == [("a", 3, 2, 1)]
    assert gt.global_tracks(rows.limit(0)).count() == 0 and gt.kept_tracks(gt.global_tracks(rows.limit(0))).count() == 0


def test_videos_are_tasks_of_their_own(spark):
    rows = [(f"V{v}", f, 0, 10.0, 10.0, 20.0, 20.0) for v in range(8) for f in range(3)]
    found = gt.global_tracks(spark.createDataFrame(rows, BOXES)).select("video", F.spark_partition_id().alias("task")).distinct().collect()
    assert len(found) == 8 and len({r["task"] for r in found}) == 8


def test_motion_equals_arrays():
    import numpy as np

    rng = random.Random(5)
    for _ in range(300):
        n = rng.randrange(1, 8)
        frames = np.cumsum([rng.choice((1, 1, 2, 3, 9)) for _ in range(n)])
        xy = np.array([[rng.uniform(0, 60), rng.uniform(0, 60)] for _ in range(n)])
        want = np.zeros(6)
        if n >= 3:
            each = np.diff(xy, axis=0) / np.diff(frames)[:, None]
            weights = np.exp(np.linspace(-1.5, 0, n - 1))
            velocity = np.average(each, axis=0, weights=weights)
            speed = np.linalg.norm(velocity)
            want[2] = 0.75 * min(1.0, speed / (np.average(np.linalg.norm(each, axis=1), weights=weights) + 1e-6))
            want[:2] = velocity * min(1.0, 15.0 / max(speed, 1e-6))
            short = each[np.diff(frames) <= 3]
            if len(short) >= 2:
                median = np.median(short, axis=0)
                want[5] = np.median(np.linalg.norm(short - median, axis=1))
                want[3:5] = median * min(1.0, 12.0 / max(np.linalg.norm(median), 1e-6))
        assert np.allclose(gt._motion([(f, *p) for f, p in zip(frames.tolist(), xy.tolist(), strict=True)]), want, rtol=1e-12, atol=1e-12)
