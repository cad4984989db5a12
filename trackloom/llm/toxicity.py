"""Toxicity by a counterfactually regularised classifier.

A document is the set of its words and of their beginnings and ends.  Features that tell the
labels apart are chosen by their log-likelihood ratio; a logistic regression weighs them.  Labelled
texts that name a group of people are written again with each of the group's alternatives, and
differences between the scores of a text and of its copies are part of the loss: a weight that
hangs on the name alone does not pay, so that neutral mentions are not taken for abuse.

Labelled texts are a bounded sample (``max_docs``); the rest of the fit sees at most its different
sets of features.  Scoring reads every text whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import settle, slices

WORD = re.compile(r"[^\W_]+")
#: Lengths of the beginnings and ends of words.
EDGES = range(3, 7)

#: Names of groups of people, each tuple interchangeable in a sentence.
IDENTITY_TERMS = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("gay", "lesbian", "bisexual", "transgender", "straight"),
    ("black", "white", "asian", "latino", "arab"),
    ("immigrants", "refugees", "natives", "foreigners"),
    ("frauen", "männer"), ("muslime", "christen", "juden"), ("schwule", "lesben"), ("ausländer", "flüchtlinge", "einheimische"),
    ("femmes", "hommes"), ("musulmans", "chrétiens", "juifs"), ("noirs", "blancs"), ("immigrés", "réfugiés", "étrangers"),
    ("mujeres", "hombres"), ("musulmanes", "cristianos", "judíos"), ("negros", "blancos"), ("inmigrantes", "refugiados", "extranjeros"),
)

#: Words of which a worker remembers the features.
CACHED_WORDS = 300_000


def word_features(word: str) -> list[str]:
    """``=word``, and its beginnings ``^wor`` and ends ``ord$``."""
    edges = [n for n in EDGES if n < len(word)]
    return [f"={word}", *(f"^{word[:n]}" for n in edges), *(f"{word[-n:]}$" for n in edges)]


class Words(dict):
    """word -> its features as a tuple, of all or of the known ones by number; cleared when full, which changes no result."""

    def __init__(self, known: dict[str, int] | None = None):
        super().__init__()
        self.known = known

    def __missing__(self, word: str) -> tuple:
        if len(self) >= CACHED_WORDS:
            self.clear()
        own = word_features(word)
        self[word] = found = tuple(own) if self.known is None else tuple(self.known[f] for f in own if f in self.known)
        return found

    def of(self, words: Iterable[str]) -> set:
        return {f for w in words for f in self[w]}


def words(text: str | None) -> set[str]:
    """The different words of a text: runs of letters and digits in lower case."""
    return set(WORD.findall((text or "").lower()))


def counterfactuals(text: set[str], terms: Iterable[tuple[str, ...]]) -> Iterator[set[str]]:
    """The words of a text with each name of a group exchanged for each of its alternatives."""
    for group in terms:
        for named in text.intersection(group):
            for other in group:
                if other != named:
                    yield text - {named} | {other}


class Model:
    """Features with their weights, and the bias."""

    def __init__(self, features: dict[str, int], weights: np.ndarray, bias: float):
        self.features, self.weights, self.bias = features, weights, bias


def held_out(doc_id: str = "doc_id"):
    """True for the documents whose labels no model may learn from: crc32(doc_id as text) mod 5 is 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, max_docs: int = 30_000) -> DataFrame:
    """About ``max_docs`` labelled documents at most: text, toxic, weight.

    ``labels`` has doc_id and toxic (0 or 1; others do not count; of several labels of a document
    the highest).  Both labels get an equal share, what one leaves unused goes to the other, and
    ``weight`` restores their proportion.  Documents are taken by a hash of their ids, so that the
    sample does not depend on partitioning.  The ids of the sample are broadcast.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    known = settle(known, "labels")
    sizes = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    share = {t: min(n, max(max_docs // 2, max_docs - sum(m for u, m in sizes.items() if u != t))) for t, n in sizes.items()}
    spread = 1 << 40
    cut = {t: spread if share[t] == n else max(1, spread * share[t] // n) for t, n in sizes.items()}
    of = lambda values: F.coalesce(*(F.when(F.col("toxic") == t, F.lit(v)) for t, v in values.items()), F.lit(0))
    taken = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(spread)) < of(cut)).withColumn("weight", of({t: sizes[t] / share[t] for t in sizes}).cast("double"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return texts.join(F.broadcast(taken), "doc_id").select("text", "toxic", "weight")


def _feature_counts(batches):
    cache = Words()
    counts: tuple[Counter, Counter] = (Counter(), Counter())

    def flushed():
        keys = sorted(counts[0].keys() | counts[1].keys())
        out = pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *(pa.array([c[k] for k in keys], pa.int64()) for c in counts)], ["feature", "clean", "toxic"])
        for c in counts:
            c.clear()
        return out

    for whole in batches:
        for batch in slices(whole, 256):
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                counts[toxic].update(cache.of(words(text)))
            if len(counts[0]) + len(counts[1]) > 400_000:
                yield flushed()
    yield flushed()


def _chosen(sample: DataFrame, least_docs: int, least_gain: float, least_lift: float, max_features: int) -> list[str]:
    """The features of at least ``least_docs`` documents that toxic ones have ``least_lift`` times as often, with a log-likelihood ratio of ``least_gain`` or more: at most ``max_features``, the best first.

    Frequent words come a little more often in whatever kind of document is longer, which is no
    sign of anything; without signs a document has the bias's score.
    """
    sizes = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        return []
    counts = sample.select("text", "toxic").mapInArrow(_feature_counts, "feature string, clean long, toxic long")
    counts = counts.groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).where(F.col("clean") + F.col("toxic") >= least_docs)
    n = {"clean": float(sizes[0]), "toxic": float(sizes[1])}
    both = sum(n.values())
    gain = F.lit(0.0)
    for side, size in n.items():
        for seen in (True, False):
            got = F.col(side) if seen else size - F.col(side)
            mean = (F.col("clean") + F.col("toxic") if seen else both - F.col("clean") - F.col("toxic")) * (size / both)
            gain = gain + F.when(got > 0, 2 * got * F.log(got / mean)).otherwise(0.0)
    best = counts.withColumn("gain", F.round(gain, 6)).where((F.col("gain") >= least_gain) & (F.col("toxic") * n["clean"] >= least_lift * F.col("clean") * n["toxic"])).orderBy(F.desc("gain"), "feature").limit(max_features)
    return [r["feature"] for r in best.collect()]


def _pattern_rows(shared, terms):
    def run(batches):
        cache = Words(shared.value)
        for whole in batches:
            for batch in slices(whole, 256):
                out = []
                for text, toxic, weight in zip(*(batch.column(c).to_pylist() for c in ("text", "toxic", "weight")), strict=True):
                    own = words(text)
                    found = sorted(cache.of(own))
                    out.append((toxic, found, None, weight))
                    for other in counterfactuals(own, terms):
                        if (swapped := sorted(cache.of(other))) != found:
                            out.append((None, found, swapped, weight))
                if out:
                    kinds = (pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.float64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["toxic", "found", "swapped", "weight"])

    return run


class Patterns:
    """Sets of features in flat arrays: rows with a label, and pairs of rows with their swapped form."""

    def __init__(self, table: pa.Table):
        """``table`` has toxic (null for pairs), found, swapped and weight."""
        table = table.combine_chunks()
        labelled = pc.is_valid(table["toxic"])
        plain, pairs = table.filter(labelled), table.filter(pc.invert(labelled))
        self.toxic = plain["toxic"].to_numpy().astype(float)
        self.weights, self.pair_weights = plain["weight"].to_numpy(), pairs["weight"].to_numpy()
        self.found, self.before, self.after = self._flat(plain["found"]), self._flat(pairs["found"]), self._flat(pairs["swapped"])

    @staticmethod
    def _flat(lists: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
        """Row and column numbers of the ones in a sparse matrix."""
        lists = lists.combine_chunks()
        return pc.list_parent_indices(lists).to_numpy(zero_copy_only=False), pc.list_flatten(lists).to_numpy(zero_copy_only=False)


def fit(patterns: Patterns, size: int, fairness: float, ridge: float, rounds: int = 500) -> tuple[np.ndarray, float]:
    """Weights and bias of ``size`` features, by accelerated gradient steps.

    The loss is the weighted log loss of rows with a label, ``fairness`` times the squared
    difference of log odds of the pairs, and ``ridge`` on the weights.
    """
    y, w, v = patterns.toxic, patterns.weights, patterns.pair_weights
    (rows, columns), (rows_a, columns_a), (rows_b, columns_b) = patterns.found, patterns.before, patterns.after
    scale = w.sum()

    def odds(x):
        return x[size] + np.bincount(rows, x[columns], len(y))

    def differences(x):
        return np.bincount(rows_a, x[columns_a], len(v)) - np.bincount(rows_b, x[columns_b], len(v))

    def back(each, apart):
        """The transposed map: from rows and pairs to features and the bias."""
        out = np.bincount(columns, each[rows], size + 1)
        if len(v):
            out += np.bincount(columns_a, apart[rows_a], size + 1) - np.bincount(columns_b, apart[rows_b], size + 1)
        out[size] += each.sum()
        return out / scale

    def gradient(x):
        each = w * (1 / (1 + np.exp(-np.clip(odds(x), -500, 500))) - y)
        out = back(each, 2 * fairness * v * differences(x))
        out[:size] += ridge / scale * x[:size]
        return out

    # each weight in units of its own curvature; then the steepest one, by powers
    own = np.bincount(columns, w[rows] / 4, size + 1) + 2 * fairness * (np.bincount(columns_a, v[rows_a], size + 1) + np.bincount(columns_b, v[rows_b], size + 1)) + ridge
    own[size] = w.sum() / 4
    unit = 1 / np.sqrt(own / scale)
    x = np.ones(size + 1)
    steep = 1.0
    for _ in range(40):
        x = unit * (back(w * odds(unit * x) / 4, 2 * fairness * v * differences(unit * x)) + ridge / scale * unit * x)
        steep = float(np.linalg.norm(x)) or 1.0
        x /= steep
    step = unit**2 / (1.1 * steep)
    x = last = np.zeros(size + 1)
    t = 1.0
    for _ in range(rounds):
        ahead = (1 + (1 + 4 * t * t) ** 0.5) / 2
        at = x + (t - 1) / ahead * (x - last)
        slope = gradient(at)
        last, x, t = x, at - step * slope, ahead
        if slope @ (x - last) > 0:  # overshot: start the momentum again
            t = 1.0
        if np.abs(unit * slope).max() < 1e-8:
            break
    return x[:size], float(x[size])


def train(sample: DataFrame, terms: tuple[tuple[str, ...], ...] = IDENTITY_TERMS, max_features: int = 6_000, least_docs: int = 3, least_gain: float = 12.0, least_lift: float = 2.0, fairness: float = 1.0, ridge: float = 0.3) -> Model:
    """Fit on ``sample`` (text, toxic, weight), as `labelled_sample` gives it.

    Statistics of features are summed on the cluster, and so are equal sets of features; what
    passes the driver is bounded by the sample and ``max_features``.  Without both labels, and
    for an empty sample, the model has no feature, and its bias is the share of toxic documents
    (one half without any).
    """
    sample = settle(sample, "labelled")
    chosen = _chosen(sample, least_docs, least_gain, least_lift, max_features)
    shared = sample.sparkSession.sparkContext.broadcast({f: k for k, f in enumerate(chosen)})
    rows = sample.mapInArrow(_pattern_rows(shared, terms), "toxic int, found array<int>, swapped array<int>, weight double")
    grouped = rows.groupBy("toxic", "found", "swapped").agg(F.sum("weight").alias("weight"))
    patterns = Patterns(grouped.orderBy("toxic", "found", "swapped").toArrow())
    if not len(patterns.toxic):
        return Model({}, np.zeros(0), 0.0)
    weights, bias = fit(patterns, len(chosen), fairness, ridge)
    if not chosen:  # one label alone: its odds have no end
        mass = [patterns.weights[patterns.toxic == t].sum() for t in (0, 1)]
        bias = float(np.log((mass[1] + 0.5) / (mass[0] + 0.5)))
    return Model({f: k for k, f in enumerate(chosen)}, weights, bias)


def _score_rows(shared):
    def run(batches):
        model = shared.value
        cache = Words(model.features)
        for whole in batches:
            for batch in slices(whole, 512):
                odds = np.array([model.bias + model.weights[sorted(cache.of(words(t)))].sum() for t in batch.column("_text").to_pylist()])
                scores = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
                yield pa.RecordBatch.from_arrays([batch.column("_doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """One row for each row of ``docs``: doc_id, score (0 to 1), predicted (1 from 0.5 on).

    Null and empty texts, and texts without a word, have the bias's score; texts of any length are read whole;
    repeated rows are scored each for itself, an empty table gives no row, other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").cast("long").alias("_doc_id"), F.col("text").cast("string").alias("_text"))
    found = rows.mapInArrow(_score_rows(shared), "doc_id long, score double")
    return found.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))
