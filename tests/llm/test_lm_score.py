"""Stupid-backoff scores and count tables against brute force."""

import math
import random
from collections import Counter

import pytest
from test_filters import norm

from trackloom.llm import lm_score


def by_hand(texts, order, alpha, min_count):
    docs = [norm(t) for t in texts]
    counts = Counter(tuple(d[i : i + n]) for d in docs for n in range(1, order + 1) for i in range(len(d) - n + 1))
    total = sum(map(len, docs))

    def word(d, i):
        penalty = 0.0
        for n in range(min(order, i + 1), 1, -1):
            gram = tuple(d[i - n + 1 : i + 1])
            if counts[gram] >= min_count:
                return penalty + math.log(counts[gram] / counts[gram[:-1]])
            penalty += math.log(alpha)
        return penalty + math.log(counts[(d[i],)] / total)

    return counts, [(len(d), sum(word(d, i) for i in range(len(d)))) for d in docs]


@pytest.mark.parametrize("order,min_count", [(1, 2), (2, 2), (3, 2), (4, 1)])
def test_scores(spark, order, min_count):
    rng = random.Random(order)
    texts = [" ".join(rng.choice("a b c dd ee Ff gg").split() * 1 + [rng.choice(["x", "y", "Zé", "日本"])]) for _ in range(40)]
    texts += [" ".join(rng.choices("one two three four five six".split(), k=rng.choice([1, 5, 60]))) for _ in range(60)]
    texts += [None, "", "... 1 --", "same words here", "same words here", "long " * 20_000, "Ünï ünï"]
    docs = spark.createDataFrame([(k if k % 9 else None, t, k) for k, t in enumerate(texts)], "doc_id long, text string, log_score int").repartition(3)
    counts, want = by_hand(texts, order, 0.4, min_count)
    got = sorted((r["n_words"], r["log_score"]) for r in lm_score.score(docs, order, 0.4, min_count, chunk_tokens=50).collect())
    assert len(got) == len(want)
    for (n, x), (m, y) in zip(got, sorted(want), strict=True):
        assert n == m and x == pytest.approx(y, abs=1e-6 * max(1, n))
    table = lm_score.ngram_counts(docs, order, chunk_tokens=50).collect()
    assert Counter((r["ngram"], r["n"]) for r in table) == Counter((len(g), n) for g, n in counts.items())


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert lm_score.score(none).count() == 0 and lm_score.ngram_counts(none).count() == 0
