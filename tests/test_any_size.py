"""Fits that had a bound: the same results whatever the size."""

import random

import numpy as np
import pytest

from trackloom.operators import matching, sampling


def pooled(points):
    """Plain pool-adjacent-violators over (score, correct)."""
    levels = {}
    for s, c in points:
        h, n = levels.get(s, (0, 0))
        levels[s] = (h + c, n + 1)
    blocks = []
    for s, (h, n) in sorted(levels.items()):
        blocks.append((s, h, n))
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            s1, h1, n1 = blocks.pop()
            blocks[-1] = (s1, blocks[-1][1] + h1, blocks[-1][2] + n1)
    return [(s, round(h / n, 9), n) for s, h, n in blocks]


def test_isotonic_over_many_ranges(spark):
    rng = random.Random(2)
    rows = [(k, s := round(rng.random(), 3), int(rng.random() < s)) for k in ("a", "b", None) for _ in range(1500)] + [("mono", k / 900, int(k > 450)) for k in range(900)] + [("a", None, 1), ("b", 0.5, None)]
    kept = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {}
        for r in matching.isotonic(spark.createDataFrame(rows, "k string, score double, correct int"), ["k"]).collect():
            got.setdefault(r["k"], []).append((r["upper"], round(r["value"], 9), int(r["weight"])))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", kept)
    for k in ("a", "b", None, "mono"):
        assert sorted(got[k]) == pooled([(s, c) for x, s, c in rows if x == k and s is not None and c is not None])


def test_raking_on_the_cluster(spark):
    rng = random.Random(4)
    rows = spark.createDataFrame([(k, rng.choice(["x", "y", "z", None]), rng.choice("uv")) for k in range(400)], "k long, p string, q string")
    targets = {"p": {"x": 0.5, "y": 0.2, None: 0.2, "w": 0.0}, "q": {"u": 0.7, "v": 0.3}}
    want = {r["k"]: r["weight"] for r in sampling.raking_weights(rows, ["p", "q"], targets, rounds=3).collect()}
    got = {r["k"]: r["weight"] for r in sampling.raking_weights(rows, ["p", "q"], targets, rounds=3, most_cells=0).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
    assert np.mean(list(got.values())) == pytest.approx(1, abs=1e-6)
    with pytest.raises(ValueError, match="target but no rows"):
        sampling.raking_weights(rows, ["p", "q"], targets | {"q": {"gone": 1.0}}, rounds=1, most_cells=0)
