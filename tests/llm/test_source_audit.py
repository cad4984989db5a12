"""Source divergences against a brute-force version in plain integers."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import pandas as pd
import pytest

from trackloom.llm import source_audit as sa

SCHEMA = "doc_id long, text string, lang string, source string"


def expected(rows, ranks=200):
    counts, docs = defaultdict(Counter), defaultdict(Counter)
    groups = set()
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)
        counts[lang, source].update(found)
        docs[lang].update(set(found))
    out = []
    for lang, source in groups:
        kept = [t for t, n in docs[lang].items() if n >= 3]
        total = lambda s: sum(counts[lang, s][t] for t in kept)  # noqa: B023, E731
        share = lambda n, size: 1 + 10**9 * (n + 1) // (size + len(kept))  # noqa: B023, E731
        mine = {t: share(counts[lang, source][t], total(source)) for t in kept}
        others = sorted(s for x, s in groups if x == lang and s != source)
        pairs = []
        for s in others:
            theirs = {t: share(counts[lang, s][t], total(s)) for t in kept}
            pairs.append((sum((mine[t] - theirs[t]) ** 2 // theirs[t] for t in kept), s))
        whole = {t: sum(counts[lang, s][t] for x, s in groups if x == lang) for t in kept}
        size = sum(whole.values())
        terms = [((mine[t] - q) ** 2 // q, t) for t in kept if counts[lang, source][t] and mine[t] > (q := share(whole[t], size))]
        for part, found in (("pair", pairs), ("term", terms)):
            ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))
            out += [(lang, source, part, item, value, k) for k, (value, item) in enumerate(ranked, 1) if part == "pair" or k <= ranks]
    return sorted(out)


def found(spark, rows, **kw):
    got = sa.divergences(spark.createDataFrame(rows, SCHEMA).repartition(3), **kw)
    return sorted(tuple(r) for r in got.select("lang", "source", "part", "item", "value", "rank").collect())


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(9)
    words = ["The", "the", "THE", "Été", "été", "a-b", "x1y2", "naïve", "Straße", "漢字", "B", "İ", "É"] + [f"w{chr(97 + k)}{chr(97 + j)}" for k in range(12) for j in range(12)]
    out = []
    for k in range(160):
        text = rng.choice([None, "", "123 -- 4"]) if k % 17 == 0 else " ".join(rng.choices(words, k=rng.randint(1, 60)))
        out.append((k, text, rng.choice(["en", "en", "de", None, ""]), rng.choice(["s0", "s0", "s1", "s2", None, "é"])))
    return out + [(200, "lone words", "fr", "s1"), (201, None, "it", "s1"), (202, "", "it", "s2"), (203, "12", "en", "bare")] + out[:9]


def test_against_brute_force(spark, rows):
    assert found(spark, rows) == expected(rows)


def test_sql(rows):
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source"]))
    got = con.sql(f"select lang, source, part, item, value, rank from ({sa.DIVERGENCE_SQL})").fetchall()
    assert sorted(got) == expected(rows)


def test_small_shards_and_blocks_give_the_same(spark, rows, monkeypatch):
    monkeypatch.setattr(sa, "SHARD_TERMS", 20)
    assert found(spark, rows) == expected(rows)
    assert list(sa._partial_counts(iter([])) ) == []


def test_blocks_of_sources(spark):
    """More sources than a block has rows; ranks beyond a limit go."""
    rng = random.Random(3)
    rows = [(k, " ".join(rng.choices("abcdefghij", k=12)), "en", f"s{k % 300:03d}") for k in range(700)]
    assert found(spark, rows, ranks=3) == expected(rows, ranks=3)


def test_empty_and_clashing_columns(spark):
    assert found(spark, []) == []
    docs = spark.createDataFrame([(k, "a b", "en", f"s{k % 2}", 5, "x") for k in range(6)], SCHEMA + ", n int, term string")
    assert sorted((r["source"], r["item"], r["value"]) for r in sa.divergences(docs).collect()) == [("s0", "s1", 0), ("s1", "s0", 0)]


def test_partial_counts_pass_on_when_full(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(sa, "HELD_ROWS", 40)
    texts = [" ".join(f"w{chr(97 + (k + j) % 26)}" for j in range(20)) for k in range(3000)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(["en"] * 3000), pa.array([f"s{k % 3}" for k in range(3000)])], ["text", "lang", "source"])
    n, docs = Counter(), Counter()
    for out in sa._partial_counts(iter([batch])):
        for r in out.to_pylist():
            n[r["source"], r["term"]] += r["n"]
            docs[r["source"], r["term"]] += r["docs"]
    want = Counter((f"s{k % 3}", w) for k, t in enumerate(texts) for w in t.split())
    assert {k: v for k, v in n.items() if k[1]} == want
    assert {k: v for k, v in docs.items() if k[1]} == want
    assert docs["s0", ""] == 1000


def test_shares_of_large_counts(spark):
    """Shares stay exact where count times 10^9 would leave 64 bits."""
    import numpy as np

    cases = [(10**12, 7 * 10**12, 12345), (0, 0, 1), (5, 5, 1), (9 * 10**14, 2 * 10**15, 10**6)]
    for n, total, v in cases:
        want = 1 + 10**9 * (n + 1) // (total + v)
        assert int(sa._shares(np.array([n]), np.array([total]), v)[0]) == want
        assert spark.sql(f"select {sa._share('n', 't', 'v')} as p from values ({n}L, {total}L, {v}L) x(n, t, v)").first()["p"] == want
