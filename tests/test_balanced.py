"""The sampler of two domains: cover, shares, debts, ranks, and inputs at the edge."""

from collections import Counter

import pytest

from trackloom.operators import balanced

ROW = "id long, domain string, video string, labelled boolean, hard boolean, weight double"
DEBT = "video string, coverage_debt double, recall_debt double, generalization_gap double"
BOTH = ("a", "b")


def rows(spark, n=120, m=40):
    """Videos u and v of the larger domain a, w of b; every fourth row unlabelled, every tenth hard."""
    many = [(k, "a", "uv"[k % 2], k % 4 != 0, k % 10 == 0, 1.0) for k in range(n)]
    return spark.createDataFrame(many + [(1000 + k, "b", "w", True, False, 1.0) for k in range(m)] + [(5000, "c", "x", True, True, 1.0)], ROW)


def test_cover_and_shares(spark):
    none = spark.createDataFrame([], DEBT)
    order = balanced.domain_balanced(rows(spark), BOTH, none, correction=8.0, world=3).collect()
    base = [r for r in order if r["phase"] == "base"]
    assert len(base) == 240 and Counter(r["domain"] for r in order)["a"] == len(order) / 2
    assert Counter(r["id"] for r in base if r["domain"] == "a") == Counter(range(120))
    assert set(Counter(r["id"] for r in base if r["domain"] == "b").values()) == {3}
    by_pair = {(r["pair"], r["domain"]): r for r in base}
    assert all(by_pair[k, "a"]["video"] != by_pair[k + 1, "a"]["video"] for k in range(119))
    assert all(by_pair[k, "b"]["id"] == by_pair[k % 40, "b"]["id"] for k in range(120))
    assert sorted(r["position"] for r in order) == list(range(len(order))) and len(order) % 3 == 0
    drawn = [r for r in order if r["phase"] == "correction" and r["domain"] == "a"]
    turns = {0: [r for r in drawn if (r["pair"] - 120) % 2 == 0], 1: [r for r in drawn if (r["pair"] - 120) % 2]}
    assert len(drawn) == 960 and {r["video"] for r in turns[0]} == {"u"}
    # v has labelled rows only: its turns for unlabelled ones take those of the whole domain, which are all in u
    assert all((r["video"] == "v") == (r["id"] % 2 == 1) and (r["id"] % 2 == 1 or r["id"] % 4 == 0) for r in turns[1])
    assert all(0.18 < sum(r["id"] % 4 == 0 for r in t) / 480 < 0.32 for t in turns.values())
    assert 0.25 < sum(r["id"] % 10 == 0 for r in turns[0]) / 480 < 0.6


def test_debts_repeats_and_epochs(spark):
    base = balanced.domain_balanced
    wide = spark.createDataFrame([(k, "a", "v", True, False, 1.0) for k in range(20)] + [(100 + k, "b", "w" if k < 10 else "x", k >= 10, False, 1.0) for k in range(20)], ROW)
    debts = spark.createDataFrame([("w", 5.0, -7.0, None)], DEBT)
    got = base(wide, BOTH, debts, correction=30.0).collect()
    assert sorted(got) == sorted(base(wide.repartition(5), BOTH, debts, correction=30.0).collect())
    assert sorted(got) != sorted(base(wide, BOTH, debts, correction=30.0, epoch=1).collect())
    only = spark.createDataFrame([(k, "a", "v", True, False, 1.0) for k in range(2)] + [(9, "b", "w", True, False, 1.0), (10, "b", "w", True, False, 3.0)], ROW)
    picks = Counter(r["id"] for r in base(only, BOTH, debts, correction=500.0).where("phase = 'correction' and domain = 'b'").collect())
    assert 0.70 < picks[10] / sum(picks.values()) < 0.80
    carried = {r["video"]: tuple(r)[1:] for r in balanced.carry_debts(spark.createDataFrame([("v", 1.0, 2.0, None), ("o", 3.0, None, None)], DEBT), spark.createDataFrame([("v", 0.0, None, 4.0), ("n", None, 1.0, None)], DEBT)).collect()}
    assert carried == {"v": (0.0, 2.0, 4.0), "o": (3.0, None, None), "n": (None, 1.0, None)}


def test_debt_moves_draws(spark):
    """Where a turn falls back on the whole domain, the video in debt is drawn in proportion."""
    data = [(0, "a", "v", True, False, 1.0)] + [(1, "b", "p", True, False, 1.0), (2, "b", "q", True, False, 1.0), (3, "b", "r", False, False, 1.0)]
    debts = spark.createDataFrame([("p", 2.0, 1.0, -5.0)], DEBT)
    got = Counter(r["id"] for r in balanced.domain_balanced(spark.createDataFrame(data, ROW), BOTH, debts, correction=600.0, unlabelled=0.0).where("phase = 'correction' and domain = 'b'").collect())
    assert got[3] == 0 and sum(got.values()) == 1800 and 0.55 < got[1] / 1800 < 0.65  # a third of the turns, and four fifths of r's


def test_ranks(spark):
    order = balanced.domain_balanced(rows(spark), BOTH, spark.createDataFrame([], DEBT), world=2)
    pairs = order.count() // 2
    for layout in ("dealt", "by_domain", "synchronised"):
        got = balanced.rank_slices(order, BOTH, 2, layout, 8).collect()
        slots = {k: sorted(r["slot"] for r in got if r["rank_"] == k) for k in (0, 1)}
        size = pairs // 8 * 8 if layout == "synchronised" else pairs
        assert slots[0] == slots[1] == list(range(size)) and len({r["position"] for r in got}) == 2 * size
        at = {(r["rank_"], r["slot"]): r["domain"] for r in got}
        if layout == "by_domain":
            assert all(at[0, k] != at[1, k] and at[0, k] == BOTH[k // 8 % 2] for k in range(size))
        if layout == "synchronised":
            even = size // 8 // 2 * 16
            assert all(at[0, k] == at[1, k] == BOTH[k // 8 % 2] for k in range(even)) and all((at[0, k], at[1, k]) == BOTH for k in range(even, size))
    with pytest.raises(ValueError):
        balanced.rank_slices(order, BOTH, 3, "synchronised", 8)


def test_edges(spark):
    none = spark.createDataFrame([], DEBT)
    odd = spark.createDataFrame([(1, "a", None, None, None, None), (2, "b", None, None, None, 0.0), (3, "b", None, None, True, -1.0)], ROW)
    got = balanced.domain_balanced(odd, BOTH, none, correction=2.0, world=8)
    assert got.count() == 16 and got.where("video = ''").count() == 16
    with pytest.raises(ValueError):
        balanced.domain_balanced(odd.where("id = 1"), BOTH, none)
    with pytest.raises(ValueError):
        balanced.domain_balanced(odd.limit(0), BOTH, none)
