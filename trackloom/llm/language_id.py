"""Language identification by word-first backoff.

A word that the model knows scores by its log frequency in each language.  An unknown word is
read as character n-grams, the longest known ones first: where no n-gram of one length that
starts at a character is known, the next shorter length is tried.  A document's language is
the one with the highest sum over its words.
"""

from __future__ import annotations

import math
import re
import sys
import unicodedata
from collections import Counter
from functools import lru_cache, reduce
from itertools import groupby
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import settle, slices

_ASCII = re.compile(r"[a-z]+")
UNDETERMINED = "und"
LONGEST = 5


@lru_cache(maxsize=1)
def _runs() -> re.Pattern:
    """Runs of letters and marks: the Unicode categories L and M."""
    wanted = [c for c in range(128, sys.maxunicode + 1) if unicodedata.category(chr(c))[0] in "LM"]
    parts = [[c for _, c in run] for _, run in groupby(enumerate(wanted), lambda x: x[1] - x[0])]
    return re.compile("[A-Za-z" + "".join(f"{chr(p[0])}-{chr(p[-1])}" for p in parts) + "]+")


class _Odd(dict):
    """Whether a character needs the full pattern: marks belong to words, numerals other than digits do not."""

    def __missing__(self, c: str) -> bool:
        kind = unicodedata.category(c)
        self[c] = odd = kind[0] == "M" or kind in ("Nl", "No")
        return odd


_ODD = _Odd()
_LETTERS = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> list[str]:
    """The words of a text in lower case: runs of letters and marks with at least one letter.  Numerals such as fractions are no letters."""
    low = (text or "").lower()
    if low.isascii():
        return _ASCII.findall(low)
    if not any(map(_ODD.__getitem__, set(low))):
        return _LETTERS.findall(low)
    return [w for w in _runs().findall(low) if w[0].isalpha() or any(map(str.isalpha, w))]


class Model:
    """Bounded tables: each known word and n-gram has a row of log frequencies, one per language; the last row is for what nothing fits."""

    def __init__(self, languages: list[str], words: dict[str, int], grams: dict[str, int], rows: np.ndarray):
        self.languages, self.words, self.grams, self.rows = languages, words, grams, rows
        self.unseen: dict[str, list[int]] = {}

    def backoff(self, word: str) -> list[int]:
        """For each character of the framed word the row of the longest known n-gram that starts there."""
        text, grams, out = f"^{word}$", self.grams, []
        for at in range(len(text)):
            for end in range(min(at + LONGEST, len(text)), at, -1):
                if (row := grams.get(text[at:end])) is not None:
                    out.append(row)
                    break
        return out or [len(self.rows) - 1]

    def predict(self, text: str | None) -> tuple[str, float]:
        counts = Counter(words(text))
        if not counts or not self.languages:
            return UNDETERMINED, 0.0
        if len(self.unseen) > 200_000:
            self.unseen.clear()
        known, unseen, rows, weights = self.words, self.unseen, [], []
        for word, n in counts.items():
            if (row := known.get(word)) is not None:
                rows.append(row)
                weights.append(n)
                continue
            # the mean over the pieces of an unknown word
            if (pieces := unseen.get(word)) is None:
                pieces = unseen[word] = self.backoff(word)
            rows += pieces
            weights += [n / len(pieces)] * len(pieces)
        total = np.asarray(weights) @ self.rows[rows]
        best = int(total.argmax())  # languages are in order, so that ties go to the first name
        return self.languages[best], float(1 / np.exp(np.minimum(total - total[best], 0)).sum())


def _word_rows(batches):
    for whole in batches:
        for batch in slices(whole, 512):
            counts: dict[str, Counter] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts.setdefault(lang, Counter()).update(words(text))
            rows = [(lang, w, n) for lang, c in counts.items() for w, n in c.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64()))], ["lang", "word", "n"])


def _shares(sizes: dict, most: int) -> dict:
    """``most`` dealt out in equal shares; what the smaller sizes leave unused goes to the larger ones."""
    out, left = {}, most
    for k, (x, size) in enumerate(sorted(sizes.items(), key=lambda kv: (kv[1], kv[0]))):
        out[x] = min(size, left // (len(sizes) - k))
        left -= out[x]
    return out


def _sample(rows: DataFrame, most: int, sizes: dict[str, int]) -> DataFrame:
    """About ``most`` distinct texts, in equal shares per language: those with the smallest hashes; a language with fewer texts than its share stays whole."""
    spread = 1 << 40
    shares = _shares(sizes, most)
    cuts = [(x, spread if shares[x] == n else max(1, int(spread * shares[x] / n))) for x, n in sizes.items()]
    cuts = rows.sparkSession.createDataFrame(cuts, "lang string, cut long")
    kept = rows.withColumn("h", F.xxhash64("text")).join(F.broadcast(cuts), "lang").where(F.pmod("h", F.lit(spread)) < F.col("cut"))
    return kept.groupBy("lang", "h").agg(F.first("text").alias("text")).select("lang", "text")


def train(labelled: DataFrame, max_docs: int = 20_000, max_words: int = 60_000, max_grams: int = 40_000, max_languages: int = 500) -> Model:
    """Fit the tables on rows (text, lang) with a language.

    The fit is on a bounded sample: about ``max_docs`` distinct texts at most, dealt out evenly
    over the languages, so that a rare language keeps its texts however large the corpus.
    Texts are taken by hash, which does not depend on partitioning.  The sample's counts are
    summed on the cluster; the model keeps at most ``max_words`` words and ``max_grams``
    n-grams of each length, for each language its most frequent ones (a frequency is kept or
    left whole), and this bounds what passes the driver and is sent to the workers.
    """
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    sizes = {r["lang"]: r["count"] for r in rows.select("lang", F.xxhash64("text").alias("h")).distinct().groupBy("lang").count().limit(max_languages + 1).collect()}
    languages = sorted(sizes)
    if len(languages) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    if not languages:
        return Model([], {}, {}, np.zeros((1, 0)))
    rows = _sample(rows, max_docs, sizes)
    each = [f"c{i}" for i in range(len(languages))]
    counts = rows.mapInArrow(_word_rows, "lang string, word string, n long")
    by_word = settle(counts.groupBy(F.col("word").alias("key")).agg(*(F.sum(F.when(F.col("lang") == x, F.col("n")).otherwise(0)).alias(c) for x, c in zip(languages, each, strict=True))), "words")
    framed, lengths = F.concat(F.lit("^"), F.col("key"), F.lit("$")), range(1, LONGEST + 1)
    cut = lambda k: F.when(F.length("word") >= k, F.transform(F.sequence(F.lit(1), F.length("word") - (k - 1)), lambda i: F.substring(F.col("word"), i, F.lit(k)))).otherwise(F.array().cast("array<string>"))
    pieces = by_word.select(framed.alias("word"), *each).select(F.explode(F.concat(*(cut(k) for k in lengths))).alias("key"), *each)
    grams = settle(pieces.groupBy("key").agg(*(F.sum(c).alias(c) for c in each)), "grams")

    index: list[dict[str, int]] = [{}, {}]
    tables: list[np.ndarray] = []
    floor = None
    for table, kind, most in ((by_word, F.lit(0), max_words), (grams, F.length("key"), max_grams)):
        sized = table.select("key", *each, kind.alias("kind"))
        # how many keys of a language have which frequency: at most a few thousand rows for a bounded sample
        histogram: dict[int, dict[str, list[tuple[int, int]]]] = {}
        long = sized.select("kind", F.posexplode(F.array(*each)).alias("i", "n")).where("n > 0")
        for r in long.groupBy("kind", "i", "n").count().collect():
            histogram.setdefault(r["kind"], {}).setdefault(each[r["i"]], []).append((r["n"], r["count"]))
        totals = {r["kind"]: r for r in sized.groupBy("kind").agg(F.count("*").alias("keys"), *(F.sum(c).alias(c) for c in each)).collect()}
        for k, levels in sorted(histogram.items()):
            least = {}
            for c, room in _shares({c: sum(keys for _, keys in own) for c, own in levels.items()}, most).items():
                for level, keys in sorted(levels[c], reverse=True):
                    if keys > room:
                        break
                    least[c], room = level, room - keys
            if not least:
                continue
            frequent = reduce(or_, (F.col(c) >= n for c, n in sorted(least.items())))
            got = sized.where((F.col("kind") == k) & frequent).select("key", *each).toArrow()
            base = np.log([totals[k][c] + 0.5 * (totals[k]["keys"] + 1) for c in each])
            start = sum(map(len, tables))
            tables.append(np.log(np.stack([got.column(c).to_numpy() for c in each], axis=1) + 0.5) - base)
            index[k > 0].update((x, start + i) for i, x in enumerate(got.column("key").to_pylist()))
            floor = math.log(0.5) - base if floor is None or k == 1 else floor
    tables.append(np.zeros((1, len(languages))) if floor is None else floor[None, :])
    return Model(languages, index[0], index[1], np.concatenate(tables))


def _predict(shared):
    def run(batches):
        model = shared.value
        for whole in batches:
            for batch in slices(whole, 512):
                got = [model.predict(x) for x in batch.column(1).to_pylist()]
                columns = [*batch.columns, pa.array([x for x, _ in got], pa.string()), pa.array([s for _, s in got], pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "_lang_pred", "_score"])

    return run


def identify(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, lang_pred, score (the language's share of the likelihood, 0 to 1), and the columns ``keep``.

    Null text, and text without a letter, is ``und`` with score 0; so is every text where the
    model has no language (no labelled row).  Ties go to the language first in order.  Texts
    of any length are read whole; repeated rows are judged each for itself.  Kept columns named
    like the result's get the prefix ``of_``; doc_id and text are not passed on twice.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep = keep or []
    other = [c for c in keep if c not in ("doc_id", "text")]
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    rows = docs.select(F.col("doc_id").cast("long").alias("_doc_id"), F.col("text").cast("string").alias("_text"), *(F.col(c).alias(f"_of_{i}") for i, c in enumerate(other)))
    schema = "_doc_id long, _text string" + "".join(f", _of_{i} {kinds[c]}" for i, c in enumerate(other)) + ", _lang_pred string, _score double"
    found = rows.mapInArrow(_predict(shared), schema)
    where = {"doc_id": "_doc_id", "text": "_text"} | {c: f"_of_{i}" for i, c in enumerate(other)}
    named = [F.col(where[c]).alias(f"of_{c}" if c in ("doc_id", "lang_pred", "score") else c) for c in keep]
    return found.select(F.col("_doc_id").alias("doc_id"), F.col("_lang_pred").alias("lang_pred"), F.col("_score").alias("score"), *named)


def held_out(doc_id="doc_id"):
    """True for the documents that no model may learn from: crc32(doc_id as text) mod 3 is 1."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))
