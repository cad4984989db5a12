"""Windows walked through together, and assignments on lists: the same as each by itself."""

import numpy as np

from trackloom.operators import linking, matching


def window(rng, frames, reverse):
    rows = [(f, *rng.integers(0, 200, 2)) for f in range(frames) for _ in range(rng.integers(0, 6))]
    f, x, y = np.array(sorted(rows, reverse=reverse)).T
    g = {"frame": f, "x1": x * 1.0, "y1": y * 1.0, "x2": x + 30.0, "y2": y + 24.0, "direction": np.array(["reverse" if reverse else "forward"] * len(f), object)}
    for c in [*linking.FLOW, *linking.POINTS]:
        g[c] = np.where(rng.random(len(f)) < 0.6, rng.integers(0, 200, len(f)).astype(float), np.nan)
    return g


def links(out, at):
    return sorted(zip((out["i"] + at).tolist(), (out["j"] + at).tolist(), out["cost"].round(9).tolist(), out["flow"].tolist(), out["gap"].tolist(), strict=True))


def test_windows_together_equal_each_alone():
    rng = np.random.default_rng(4)
    parts = [window(rng, n, n % 2 == 1) for n in (40, 7, 25, 60)]
    starts = np.cumsum([0, *(len(p["frame"]) for p in parts)])[:-1]
    got = links(linking._walk({c: np.concatenate([p[c] for p in parts]) for c in parts[0]}, starts, 5, 1.6), 0)
    want = [x for p, at in zip(parts, starts.tolist(), strict=True) for x in links(linking._walk(p, np.array([0]), 5, 1.6), at)]
    assert got == sorted(want) and len(got) > 100


def test_assignment_on_lists(monkeypatch):
    rng = np.random.default_rng(1)
    costs = [rng.integers(0, 4, rng.integers(1, 12, 2)).astype(float) for _ in range(200)]
    few = [matching.assign(c) for c in costs]
    monkeypatch.setattr(matching, "CELLS", 0)
    assert few == [matching.assign(c) for c in costs]


def test_groups_come_together(spark):
    """Whole groups are handed over many at a time."""
    from trackloom.operators.grouped import per_group

    rows = spark.range(3000).selectExpr("id % 300 as k", "id as v")
    fold = lambda g, starts: {"groups": [len(starts)], "n": [len(g["k"])], "whole": [all(len(set(x)) == 1 and len(x) == 10 for x in np.split(g["k"], starts[1:]))]}
    got = per_group(rows, ["k"], ["v"], fold, "groups long, n long, whole boolean", 2, together=10_000).collect()
    assert len(got) == 2 and sum(r["groups"] for r in got) == 300 and sum(r["n"] for r in got) == 3000 and all(r["whole"] for r in got)
