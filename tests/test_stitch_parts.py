"""Margins and stitches made from tracklets: as from all pairs, without gathering these."""

import random

import numpy as np
import pytest

from trackloom.operators import matching, stitching

ENDS = "video long, piece long, first_frame long, last_frame long, start_x double, start_y double, end_x double, end_y double, start_diag long, end_diag long, start_vx double, start_vy double, end_vx double, end_vy double"


@pytest.fixture(scope="module")
def tracklets(spark):
    rng, rows = random.Random(3), []
    for k in range(240):
        first, last = (t := rng.randrange(150)), t + rng.randrange(9)
        place = [float(rng.randrange(30)) for _ in range(4)]
        speed = [rng.random() if k % 3 else None for _ in range(4)]
        rows.append((k % 2, k, first, last, *place, 10 + k % 7, 10 + k % 5, *speed))
    rows += [(v, p + 1000, *rest) for v, p, *rest in rows[::4]]  # copies: pairs that cost the same
    return spark.createDataFrame(rows, ENDS)


def test_margins_as_from_pairs(tracklets):
    pairs = stitching.stitch_candidates(tracklets, "video", "piece", 20, max_cost=4.0)
    value = lambda x: None if x is None else round(x, 7) + 0.0
    rows = lambda df: sorted((r.video, r.left_piece, r.right_piece, value(r.left_margin), value(r.right_margin)) for r in df.collect())
    found = stitching.tracklet_margins(tracklets, "video", "piece", 20, max_cost=4.0)
    assert (want := rows(stitching.margins(pairs, "video"))) and rows(found.drop("gap")) == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan  # no sort over all pairs


def test_stitches_from_parts_save_most(tracklets, monkeypatch):
    pairs = stitching.stitch_candidates(tracklets, "video", "piece", 20, max_cost=4.0)
    cost = {(r.video, r.left_piece, r.right_piece): r.cost for r in pairs.collect()}
    total = lambda rows: sum(5.0 - cost[r.video, r.left_piece, r.right_piece] for r in rows)
    want = total(stitching.stitches(pairs, "video", 5.0).collect())
    held, solve = [], stitching._solved
    monkeypatch.setattr(stitching, "PARTS", 1)
    monkeypatch.setattr(stitching, "_solved", lambda df, scope: (held.append(df.count()), solve(df, scope))[1])
    got = stitching.tracklet_stitches(tracklets, "video", "piece", 20, 5.0, max_cost=4.0).collect()
    assert total(got) == pytest.approx(want, abs=1e-6)
    assert len({(r.video, r.left_piece) for r in got}) == len(got) == len({(r.video, r.right_piece) for r in got})
    assert 0 < held[0] < held[-1] < len(cost)  # more rounds than one, and never all pairs


def test_assignment_along_pairs():
    rng = np.random.default_rng(1)
    for t in range(200):
        n, m = rng.integers(1, 14, 2)
        a, b = np.nonzero(rng.random((n, m)) < rng.random())
        if not len(a):
            continue
        gain = (rng.integers(1, 6, len(a)) if t % 2 else rng.random(len(a))).astype(float) - 0.5 * (t % 5 == 0)
        k, u, v = matching.assign_pairs(a, b, gain)
        full = np.zeros((n, m))
        full[a, b] = np.maximum(gain, 0)
        best = sum(full[x, y] for x, y in matching.assign(-full))
        assert len(set(a[k])) == len(k) == len(set(b[k])) and gain[k].sum() == pytest.approx(best)
        assert (u[a] + v[b] - gain > -1e-9).all() and u.sum() + v.sum() == pytest.approx(best)


def test_long_chain_needs_no_matrix():
    """Thirty thousand pieces in one part: as a matrix some 7 GB."""
    n = 30_000
    a, b = np.repeat(np.arange(n), 2)[:-1], np.repeat(np.arange(n), 2)[1:]
    k, u, v = matching.assign_pairs(a, b, np.where(np.arange(len(a)) % 2, 1.0, 2.0))
    assert (a[k] == b[k]).all() and len(k) == n and u.sum() + v.sum() == 2.0 * n
