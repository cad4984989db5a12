"""The toxicity classifier: planted abuse, neutral mentions of groups, its optimum, edge cases."""

import random

import numpy as np
import pyarrow as pa
import pytest

from trackloom.llm import toxicity as tx

DOCS, LABELS = "doc_id long, text string", "doc_id long, toxic int"


def corpus(rng, n=1500, biased=False):
    """Neutral prose; one document in six has abuse.  With ``biased``, abuse is aimed at one group, which neutral documents seldom name."""
    docs, labels = [], []
    base = [a + b + c for a in ("ba", "ro", "mi", "tel") for b in ("no", "ka", "lu") for c in ("s", "ren", "dor", "")]
    for k in range(n):
        words = rng.choices(base, k=rng.randint(5, 40))
        toxic = int(k % 6 == 0)
        if toxic:
            words.insert(rng.randrange(len(words)), rng.choice(["Scumbag", "WORTHLESS!", f"zolak{rng.choice('aeiou')}{rng.choice('nrst')}"]))
        if biased:
            group = "muslims" if rng.random() < (0.9 if toxic else 0.02) else rng.choice(["christians", "jews"]) if rng.random() < 0.3 else None
            words += [group] if group else []
        docs.append((k, " ".join(words)))
        labels.append((k, toxic))
    return docs, labels


@pytest.fixture(scope="module")
def trained(spark):
    docs, labels = corpus(random.Random(1))
    frames = spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(labels, LABELS)
    return frames, tx.train(tx.labelled_sample(*frames))


def test_planted_abuse(spark, trained):
    docs, labels = corpus(random.Random(2))
    got = {r["doc_id"]: r for r in tx.score(spark.createDataFrame(docs, DOCS), trained[1]).collect()}
    assert [got[k]["predicted"] for k, _ in docs] == [y for _, y in labels]
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_scores_by_hand(spark, trained):
    (docs, _), model = trained
    for r in tx.score(docs, model).limit(50).join(docs, "doc_id").collect():
        found = {f for w in tx.WORD.findall(r["text"].lower()) for f in tx.word_features(w)} & set(model.features)
        odds = model.bias + sum(model.weights[model.features[f]] for f in found)
        assert r["score"] == pytest.approx(1 / (1 + np.exp(-odds)), abs=1e-12)


def test_neutral_mentions(spark):
    """Without the counterfactual part the group's name is taken for abuse; with it, it is not, and abuse still is."""
    docs, labels = corpus(random.Random(3), biased=True)
    # much of the abuse in words that come once, so that the name is the strongest sign
    once = lambda k: "".join(random.Random(k).choices("bcdfghjkpqvwxyz", k=8))
    docs = [(k, t.replace("Scumbag", once(k)).replace("WORTHLESS!", once(k))) for k, t in docs]
    sample = tx.labelled_sample(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS))
    asked = spark.createDataFrame([(1, "Muslims bano rokas miludor."), (2, "Christians bano rokas miludor."), (3, "Muslims zolakan rokas"), (4, "bano rokas zolaker")], DOCS)
    scores = {f: {r["doc_id"]: r["score"] for r in tx.score(asked, tx.train(sample, fairness=f)).collect()} for f in (0.0, 5.0)}
    assert scores[0.0][1] > 0.5 > scores[0.0][2]
    assert scores[5.0][1] < 0.5
    assert abs(scores[5.0][1] - scores[5.0][2]) < 0.2
    assert scores[5.0][3] > 0.5 and scores[5.0][4] > 0.5


def test_counterfactuals():
    got = sorted(sorted(x) for x in tx.counterfactuals({"the", "women", "jews"}, (("women", "men"), ("jews", "muslims", "christians"))))
    assert got == [["christians", "the", "women"], ["jews", "men", "the"], ["muslims", "the", "women"]]


def test_fit_is_the_minimum():
    rng = np.random.default_rng(4)
    patterns = [(int(rng.random() < 0.3), sorted(rng.choice(6, rng.integers(0, 4), replace=False).tolist()), None, float(rng.integers(1, 5))) for _ in range(60)]
    patterns += [(None, [0], [1], 3.0), (None, [2, 3], [4], 1.0)]

    def loss(w, b):
        out = 0.15 * float(w @ w)
        for y, a, c, n in patterns:
            z = b + w[a].sum()
            out += n * (np.logaddexp(0, z) - y * z if y is not None else 2.0 * (w[a].sum() - w[c].sum()) ** 2)
        return out

    kinds = [("toxic", pa.int32()), ("found", pa.list_(pa.int32())), ("swapped", pa.list_(pa.int32())), ("weight", pa.float64())]
    table = pa.table([pa.array([p[k] for p in patterns], kind) for k, (_, kind) in enumerate(kinds)], [n for n, _ in kinds])
    w, b = tx.fit(tx.Patterns(table), 6, 2.0, 0.3)
    best = loss(w, b)
    for k in range(7):
        for d in (1e-3, -1e-3):
            v, c = w.copy(), b
            if k < 6:
                v[k] += d
            else:
                c += d
            assert loss(v, c) >= best - 1e-9


def test_sample_is_bounded_and_weighted(spark):
    docs = spark.createDataFrame([(k, f"text {k}") for k in range(3000)], DOCS)
    labels = spark.createDataFrame([(k, int(k % 10 == 0)) for k in range(3000)], LABELS)
    rows = tx.labelled_sample(docs, labels, max_docs=400).collect()
    n = {t: sum(r["toxic"] == t for r in rows) for t in (0, 1)}
    assert 140 < n[0] < 260 and 140 < n[1] < 260
    assert {r["toxic"]: round(r["weight"], 6) for r in rows} == {0: 13.5, 1: 1.5}
    assert tx.labelled_sample(docs, labels).count() == 3000


def test_edge_cases(spark, trained):
    (docs, labels), model = trained
    bare = 1 / (1 + np.exp(-model.bias))
    rows = spark.createDataFrame([(1, None, 9), (2, "", 9), (2, "", 9), (None, "?!", 9), (5, "Scumbag " * 50_000, 9)], DOCS + ", score int")
    got = sorted(((r["doc_id"] or 0, round(r["score"], 9), r["predicted"]) for r in tx.score(rows, model).collect()))
    assert got[:4] == [(0, round(bare, 9), 0), (1, round(bare, 9), 0), (2, round(bare, 9), 0), (2, round(bare, 9), 0)]
    assert got[4][0] == 5 and got[4][2] == 1
    assert tx.score(docs.limit(0), model).count() == 0
    nothing = tx.train(tx.labelled_sample(docs, labels.limit(0)))
    assert [r["score"] for r in tx.score(rows.limit(1), nothing).collect()] == [0.5]
    clean = tx.train(tx.labelled_sample(docs, labels.where("toxic = 0")))
    assert [r["predicted"] for r in tx.score(rows, clean).collect()] == [0] * 5
    odd = spark.createDataFrame([(0, None), (None, 1), (1, 7), (6, 0), (6, 1)], LABELS)
    assert [tuple(r) for r in tx.labelled_sample(docs, odd).select("toxic", "weight").collect()] == [(1, 1.0)]


def test_held_out(spark):
    import zlib

    got = {r[0]: r[1] for r in spark.range(50).withColumnRenamed("id", "doc_id").select("doc_id", tx.held_out()).collect()}
    assert got == {k: zlib.crc32(str(k).encode()) % 5 == 0 for k in range(50)}
