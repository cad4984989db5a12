"""Window sums, regions, holes, transport, the curriculum and table functions: against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackloom.functions import table_functions
from trackloom.operators import grids, matching, trackers, transport
from trackloom.streaming import curriculum


def box_filter(grid, wide, high):
    ny, nx = grid.shape
    out = np.zeros_like(grid)
    for y in range(ny):
        for x in range(nx):
            x0, y0 = x - wide // 2, y - high // 2
            out[y, x] = grid[max(y0, 0) : max(y0 + high, 0), max(x0, 0) : max(x0 + wide, 0)].sum()
    return out


def cells(spark, arrays):
    rows = [(k, x, y, float(g[y, x])) for k, g in arrays.items() for y in range(g.shape[0]) for x in range(g.shape[1]) if g[y, x]]
    return spark.createDataFrame(rows, "frame long, gx long, gy long, value double")


@pytest.mark.parametrize(("wide", "high"), [(1, 1), (3, 4), (6, 5), (30, 40)])
def test_window_sums(spark, wide, high):
    rng = np.random.default_rng(1)
    arrays = {k: rng.integers(0, 4, (8, 11)).astype(float) for k in range(2)}
    got = np.zeros((2, 8, 11))
    for r in grids.window_sums(grids.dense(cells(spark, arrays), ["frame"], 11, 8), ["frame"], wide, high, 11, 8).collect():
        got[r["frame"], r["gy"], r["gx"]] = r["mass"]
    for k, g in arrays.items():
        assert np.allclose(got[k], box_filter(g, wide, high))


def test_residual_region(spark):
    rng = np.random.default_rng(3)
    density = {k: rng.integers(0, 5, (12, 16)).astype(float) for k in range(4)}
    seen = {k: rng.integers(0, 5, (12, 16)).astype(float) for k in range(4)}
    got = {r["frame"]: r for r in grids.residual_region(cells(spark, density), cells(spark, seen), ["frame"], 16, 12, 640, 480).collect()}
    for k in density:
        rest = np.maximum(density[k] - seen[k], 0)
        y, x = np.unravel_index(box_filter(rest, 4, 3).argmax(), rest.shape)
        x1, y1 = int(np.clip(x - 2, 0, 12)), int(np.clip(y - 1, 0, 9))
        r = got[k]
        assert (r["x1"], r["y1"], r["x2"], r["y2"]) == (x1 * 40, y1 * 40, (x1 + 4) * 40, (y1 + 3) * 40)
        assert r["missing"] == pytest.approx(rest[y1 : y1 + 3, x1 : x1 + 4].sum())


def test_low_density_centres(spark):
    rng = random.Random(5)
    boxes = {f: [(rng.uniform(0, 200), rng.uniform(0, 150)) for _ in range(60)] for f in range(2)}
    rows = [(f, x, y, x + 8, y + 8) for f, own in boxes.items() for x, y in own if not (70 < x < 120 and 50 < y < 90)]
    found = grids.low_density_centres(spark.createDataFrame(rows, "frame long, x1 double, y1 double, x2 double, y2 double"), ["frame"], 208, 158, 24, 20, 3.0, 5)
    got = {f: [(r["x"], r["y"], r["ring"]) for r in sorted(found.where(F.col("frame") == f).collect(), key=lambda r: r["rank"])] for f in boxes}
    nx, ny = 52, 40
    for f in boxes:
        grid = np.zeros((ny, nx))
        for g, x1, y1, x2, y2 in rows:
            if g == f:
                grid[int(np.clip(round((y1 + y2) / 8), 0, ny - 1)), int(np.clip(round((x1 + x2) / 8), 0, nx - 1))] += 1
        central, around = box_filter(grid, 6, 5), box_filter(grid, 18, 15)
        ring = around - central
        peaks = [(ring[y, x], 4 * x, 4 * y) for y in range(ny) for x in range(nx) if central[y, x] < 0.5 and ring[y, x] >= 3 and ring[y, x] >= ring[max(y - 4, 0) : y + 5, max(x - 4, 0) : x + 5].max()]
        want = []
        for d, x, y in sorted(peaks, reverse=True):
            if len(want) < 5 and all(((x - a) / 16.8) ** 2 + ((y - b) / 14) ** 2 >= 1 for a, b, _ in want):
                want.append((x, y, d))
        assert got[f] == want and want


def test_sinkhorn(spark):
    rng = np.random.default_rng(2)
    x, y = rng.random((5, 3)), rng.random((4, 3))
    cost = ((x[:, None] - y[None]) ** 2).sum(2)
    kernel, a, b = np.exp(-cost / 0.2), np.full(5, 1 / 5), np.full(4, 1 / 4)
    v = np.ones(4)
    for _ in range(6):
        u = a / (kernel @ v)
        v = b / (kernel.T @ u)
    want = u[:, None] * kernel * v[None]
    pairs = spark.createDataFrame([(i, j, float(cost[i, j])) for i in range(5) for j in range(4)], "i long, j long, cost double")
    plan = transport.sinkhorn(pairs, 0.2, 6)
    for r in plan.collect():
        assert r["mass"] == pytest.approx(want[r["i"], r["j"]], abs=1e-9)
    assert transport.transport_cost(plan).first()["cost"] == pytest.approx((want * cost).sum(), abs=1e-9)


def measurements():
    rng = random.Random(4)
    rows = []
    for run in ("a", "b"):
        level = 0.3
        for u in range(60):
            level += 0.05 if u % 13 < 3 else 0.0
            for video in ("v", "w"):
                rows.append((run, u, video, level + (0.0 if video == "v" else 0.01) + (rng.random() * 0.2 if run == "b" else 0), u % 11 != 4, u % 7 != 3))
    return rows


MEASURED = "run string, update long, video string, value double, covered boolean, sampled boolean"


def by_hand(rows, rules):
    """The controller with its whole history."""
    out = {}
    for run in {r[0] for r in rows}:
        stage, n, history = 0, 0, []
        for u in sorted({r[1] for r in rows if r[0] == run}):
            own = [r for r in rows if r[:2] == (run, u)]
            values = [r[3] for r in own]
            n += 1
            history.append((stage, float(np.mean(values)), min(values)))
            last = [h for h in history if h[0] == stage][-rules.window :]
            flat = lambda k: abs(float(np.median([(last[j][k] - last[i][k]) / (j - i) for i in range(len(last)) for j in range(i + 1, len(last))]))) <= rules.tolerance  # noqa: B023, E731
            ready = len(last) == rules.window and flat(1) and flat(2) and all(r[4] and r[5] for r in own) and n >= rules.least_updates
            at = stage
            if ready and stage < 5:
                stage, n = stage + 1, 0
            out[run, u] = (at, ready and at < 5, ready and at == 5, stage)
    return out


def test_curriculum_batch_and_stream(spark, tmp_path):
    rows, rules = measurements(), curriculum.Rules(3, 4, 0.002)
    ups = curriculum.updates(spark.createDataFrame(rows, MEASURED))
    got = {(r["run"], r["update"]): (r["stage"], r["advance"], r["stop"], r["next_stage"]) for r in curriculum.decisions(ups, rules).collect()}
    assert got == by_hand(rows, rules)
    assert max(x[3] for x in got.values()) >= 3
    for k in range(3):
        ups.where(F.col("update").between(20 * k, 20 * k + 19)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(ups.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = curriculum.stream_decisions(stream, rules).writeStream.format("memory").queryName("stages").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    streamed = {(r["run"], r["update"]): (r["stage"], r["advance"], r["stop"], r["next_stage"]) for r in spark.table("stages").collect()}
    assert streamed == got
    debts = curriculum.recall_debt(spark.createDataFrame(rows, MEASURED)).where("run = 'a' and update = 0").collect()
    assert {r["video"]: round(r["debt"], 6) for r in debts} == {"v": 0.01, "w": 0.0}


def test_table_functions(spark):
    rng = random.Random(8)
    rows = [(v, f, d, (x := rng.uniform(0, 60)), (y := rng.uniform(0, 60)), x + 20, y + 20, round(rng.random(), 3)) for v in ("a", "b") for f in range(5) for d in range(8)]
    boxes = spark.createDataFrame(rows, "video string, frame long, det long, x1 double, y1 double, x2 double, y2 double, conf double")
    boxes.createOrReplaceTempView("boxes")
    table_functions.register(spark)
    one = boxes.where("video = 'a' and frame = 1")
    got = spark.sql("SELECT * FROM suppress_boxes(TABLE(SELECT * FROM boxes) PARTITION BY (video, frame) ORDER BY (conf DESC, det), 0.3)").where("kept").count()
    assert got == matching.suppress(boxes, 0.3, [F.desc("conf"), F.col("det")], keys=["video", "frame"]).where("kept").count()
    one.createOrReplaceTempView("one")
    got = spark.sql("SELECT * FROM suppress_boxes(TABLE(SELECT * FROM one) PARTITION BY (video, frame) ORDER BY (conf DESC, det), 0.3)")
    assert {r["det"]: r["kept"] for r in got.collect()} == {r["det"]: r["kept"] for r in matching.suppress(one, 0.3, [F.desc("conf"), F.col("det")]).collect()}
    moved = one.selectExpr("video", "frame", "det", "x1 + 2 as x1", "y1", "x2 + 2 as x2", "y2", "conf")
    one.selectExpr("0 as side", "*").unionByName(moved.selectExpr("1 as side", "*")).createOrReplaceTempView("sides")
    got = spark.sql("SELECT * FROM match_boxes(TABLE(SELECT * FROM sides) PARTITION BY (video, frame) ORDER BY (side, det), 0.5)")
    assert {(r["pred_det"], r["gt_det"]) for r in got.collect()} == {(r["pred_det"], r["gt_det"]) for r in matching.hungarian(one, moved).collect()}
    boxes.where("video = 'b'").createOrReplaceTempView("clip")
    got = spark.sql("SELECT * FROM track_boxes(TABLE(SELECT * FROM clip) PARTITION BY video ORDER BY (frame, det))")
    want = trackers.associate(boxes.where("video = 'b'"))
    assert {(r["frame"], r["det"]): r["track"] for r in got.collect()} == {(r["frame"], r["det"]): r["track"] for r in want.collect()}


def test_low_density_centres_moves_cells_with_boxes_only(spark):
    """Grids are laid out by workers: neither windows over all cells nor cells without boxes in the plan."""
    rows = [("v", f, 10.0 * k, 40.0, 10.0 * k + 8, 48.0) for f in range(3) for k in range(8) if k != 4]
    found = grids.low_density_centres(spark.createDataFrame(rows, "video string, frame long, x1 double, y1 double, x2 double, y2 double"), ["video", "frame"], 96, 96, 8, 8, 2.0)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Generate" not in plan and "Scan parquet" not in plan
    assert {(r["video"], r["frame"]) for r in found.where("rank = 1").collect()} == {("v", f) for f in range(3)}
