"""Outside measurements, points mended along tracks, champions, weights of valid rows."""

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from trackloom.operators import context, poses, reports, sampling

KEYS = {"domain": "IR_in", "video": "v", "grp": "g"}


def table(spark, rows, schema):
    names = [c.split()[0] for c in schema.split(", ")]
    return spark.createDataFrame([tuple((KEYS | r).get(c) for c in names) for r in rows], schema)


def test_context(spark):
    at = "domain string, video string, grp string, window_index long"
    windows = table(spark, [{"window_index": k, "coverage": 0.5 if k == 3 else 1.0, "tracked_fraction": 0.9, "observable_fraction": 0.4} for k in range(6)], f"{at}, coverage double, tracked_fraction double, observable_fraction double")
    changes = table(spark, [{"window_index": 0, "metric": "count", "flagged": True}, {"window_index": 1, "metric": "active_fraction", "flagged": True}, {"window_index": 2, "metric": "count", "flagged": False}, {"window_index": 3, "metric": "count", "flagged": True}, {"window_index": 5, "metric": "count", "flagged": True}], f"{at}, metric string, flagged boolean")
    records = table(spark, [
        {"window_index": 0, "seq": 2, "source": "b", "temperature_c": 31.0}, {"window_index": 0, "seq": 1, "source": "a", "temperature_c": 5.0, "temperature_baseline_c": 30.0}, {"window_index": 0, "seq": 3, "source": None, "temperature_c": 1.0}, {"window_index": 0, "seq": 4, "source": "", "rain_mm": 0.0},
        {"window_index": 0, "seq": 5, "source": "c", "dead_bee_count": 3.0}, *({"window_index": k, "seq": 1, "source": "a", "rain_mm": 4.0, "temperature_c": float("nan"), "temperature_baseline_c": 1.0, "pesticide_exposure_record": True, "dead_bee_count": 0.0} for k in (1, 2, 3)),
        {"window_index": 5, "seq": 1, "source": "a", "hive_weight_delta_kg": -1.0, "video": "other"},
    ], f"{at}, seq long, source string, " + ", ".join(f"{c} double" for c in context.NUMBERS) + ", " + ", ".join(f"{c} boolean" for c in context.SIGNS))
    found = {(r.window_index, r.scenario): r for r in context.interpreted_context(windows, changes, records).collect()}
    assert len(found) == 18 and found[0, "weather"].status == "review_candidate" and found[0, "weather"].sources == ["a", "b", "c"]
    assert found[0, "pesticide"].status == "insufficient_evidence" and found[0, "pesticide"].missing == ["pesticide_exposure_record"]
    assert {found[1, s].status for s in context.NEEDS} == {"insufficient_evidence"} and not found[1, "weather"].gate_passed  # motion cannot be judged
    assert found[2, "weather"].status == found[2, "pesticide"].status == "no_joint_signal_in_this_window" and found[2, "swarming"].status == "insufficient_evidence"
    assert found[3, "weather"].status == "insufficient_evidence" and found[5, "swarming"].status == "insufficient_evidence" and found[5, "swarming"].sources == []  # another video's record
    assert context.with_context(windows, None).columns == windows.columns
    row = context.with_context(windows, {"enabled": True, "context_id": "c", "hive_id": "h", "attributes": {"a": 1}}).head()
    assert (row.context_id, row.hive_id, row.context_attributes) == ("c", "h", {"a": "1"}) and context.with_context(windows, {"enabled": True, "context_id": "c", "hive_id": "h"}).head().context_attributes == {}


def mended(rows):
    """The same for the rows of one track by plain loops."""
    unit = lambda p: [(p[2] - p[0]) / (n := max(math.hypot(p[2] - p[0], p[3] - p[1]), 1e-9)), (p[3] - p[1]) / n]
    dot = lambda a, b: a[0] * b[0] + a[1] * b[1]
    pts, marks = [list(r["p"]) for r in rows], [[False] * 3 for _ in rows]
    if len(rows) < 3:
        return pts, marks
    first = [unit(p) for p in pts]
    for k, r in enumerate(rows):
        near = [first[j] for j in (k - 1, k + 1) if 0 <= j < len(rows)]
        if r["swap"] and statistics.mean(dot(first[k], u) for u in near) < 0:
            pts[k], marks[k][0] = pts[k][2:] + pts[k][:2], True
    now = [unit(p) for p in pts]
    for k in range(1, len(rows) - 1):
        a, b = now[k - 1], now[k + 1]
        s = [a[0] + b[0], a[1] + b[1]]
        if dot(a, b) > 0.5 and dot(now[k], s) / max(math.hypot(*s), 1e-9) < -0.15:
            pts[k], marks[k][1] = pts[k][2:] + pts[k][:2], True
    rel = [[(p[i] - r["box"][i % 2]) / (r["box"][2 + i % 2] - r["box"][i % 2]) for i in range(4)] for p, r in zip(pts, rows)]
    for k in range(1, len(rows) - 1):
        new = [0.5 * rel[k][i] + 0.5 * statistics.median(rel[j][i] for j in (k - 1, k, k + 1)) for i in range(4)]
        pts[k], marks[k][2] = [rows[k]["box"][i % 2] + new[i] * (rows[k]["box"][2 + i % 2] - rows[k]["box"][i % 2]) for i in range(4)], True
    return pts, marks


def test_smoothing(spark):
    rnd, data, want = random.Random(3), [], {}
    for track in range(30):
        rows = []
        for f in sorted(rnd.sample(range(50), rnd.choice([1, 2, 3, 12]))):
            x, y, turn = rnd.uniform(0, 50), rnd.uniform(0, 50), rnd.random() < 0.25
            p = [x + 2 + rnd.random(), y + 2 + rnd.random(), x + 8 + rnd.random(), y + 6 + rnd.random()]
            rows.append({"f": f, "box": (x, y, x + 10, y + 9), "p": p[2:] + p[:2] if turn else p, "swap": rnd.random() < 0.3})
        data += [(track, r["f"], *r["box"], *r["p"], r["swap"]) for r in rows]
        want |= {(track, r["f"]): (p, m) for r, p, m in zip(rows, *mended(rows))}
    data += [(0, 99, 0.0, 0.0, 1.0, 1.0, None, 1.0, 1.0, 1.0, True), (None, 1, 0.0, 0.0, 0.0, 1.0, 1.0, 1.0, 1.0, 1.0, None)]
    df = spark.createDataFrame(data, "track long, frame long, x1 double, y1 double, x2 double, y2 double, head_x double, head_y double, tail_x double, tail_y double, colour boolean")
    found = {(r.track, r.frame): r for r in poses.smoothed_points(df, ["track"], ["frame"], F.col("colour")).collect()}
    assert len(found) == len(data) and {tuple(m) for _, m in want.values()} >= {(True, False, True), (False, True, True), (False, False, False)}
    for k, (p, m) in want.items():
        r = found[k]
        assert [r.undone, r.turned, r.smoothed] == m and all(abs(a - b) < 1e-9 for a, b in zip((r.head_x, r.head_y, r.tail_x, r.tail_y), p))
    assert found[0, 99].head_x is None and not found[0, 99].smoothed and not found[None, 1].undone
    assert poses.smoothed_points(df.limit(0), ["track"], ["frame"]).isEmpty()


def test_champions(spark):
    schema = "name string, champion string, status string, dataset string, split string, protocol string, metrics map<string,double>"
    ok = {"status": "verified", "champion": "c", "dataset": "d", "split": "s", "protocol": "p"}
    cases = {
        "a": ({"m": 0.9, "e": 2.0}, {}), "b": ({"m": 0.9, "e": 2.0}, {"status": None}), "c1": ({"m": 0.9, "e": 2.0}, {"split": ""}), "d1": ({"m": 0.9, "e": 2.0}, {"protocol": "q", "split": "t"}), "e1": ({"m": 0.9}, {}), "f": ({"m": 0.7, "e": 2.0}, {}), "g": ({"m": 0.9, "e": 2.3}, {}),
        "h": ({"m": 0.81, "e": 2.05}, {}), "i": ({"m": 0.78, "e": 1.0}, {}), "j": ({"m": 0.9, "e": 2.0}, {"champion": "zz"}),
    }
    rows = [{"name": n, "metrics": m} | ok | other for n, (m, other) in cases.items()]
    names = [c.split()[0] for c in schema.split(", ")]
    candidates = spark.createDataFrame([tuple(r[c] for c in names) for r in rows], schema)
    champions = spark.createDataFrame([("c", "d", "s", "p", {"m": 0.8, "e": 2.0, "x": 1.0})], "name string, dataset string, split string, protocol string, metrics map<string,double>")
    found = {r.candidate: r for r in reports.champion_decisions(candidates, champions, {"m": "max", "e": "min"}, {"m": 0.05, "e": 0.1}).collect()}
    assert {k: r.reason for k, r in found.items()} == {"a": "pareto_improvement", "b": "candidate_not_verified", "c1": "missing_split", "d1": "incomparable_split", "e1": "missing_metric_e", "f": "regression_m", "g": "regression_e", "h": "no_material_gain", "i": "pareto_improvement", "j": "missing_dataset"}
    assert {k for k, r in found.items() if r.promoted} == {"a", "i"} and set(found["f"].gains) == {"m"} and set(found["g"].gains) == {"m", "e"} and found["b"].gains is None


def test_weights_of_valid_rows(spark):
    rows = spark.createDataFrame([(k, "a" if k % 3 else "b", "bad" if k % 5 == 0 else None if k % 5 == 1 else "ok", k) for k in range(60)], "k long, p string, status string, q long")
    targets = {"p": {"a": 0.5, "b": 0.5}}
    valid = (F.coalesce("status", F.lit("valid")) != "bad") & (F.col("q") > 3)
    found = {r.k: r.weight for r in sampling.raking_weights(rows, ["p"], targets, valid=valid).collect()}
    alone = {r.k: r.weight for r in sampling.raking_weights(rows.where(valid), ["p"], targets).collect()}
    assert len(found) == 60 and {k: v for k, v in found.items() if v} == alone and abs(sum(alone.values()) / len(alone) - 1) < 1e-9
    with pytest.raises(ValueError, match="p=b has a target but no rows"):
        sampling.raking_weights(rows, ["p"], targets, valid=F.col("p") == "a")
    with pytest.raises(ValueError, match="no valid rows"):
        sampling.raking_weights(rows, ["p"], targets, valid=F.lit(False))
