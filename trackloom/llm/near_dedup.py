"""Near-duplicates by BagMinHash: weighted-Jaccard signatures of shingle multisets, banded, then verified.

Every shingle of weight w owns Poisson processes over its weight axis, which is cut into dyadic
blocks [0,1), [1,2), [2,4), ...  A block's process has the block's length as its rate; its
points carry a position in the block and a register of the signature, and count where the
position lies below w.  A register keeps the earliest point that any shingle sends it, so that
two multisets agree in a register with the probability of their weighted Jaccard similarity.
Blocks are expanded only while their next point can still be the earliest one.
"""

from __future__ import annotations

import re
from collections import OrderedDict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import components
from .shared import settle, slices

_U = np.uint64
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], _U)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of 64-bit words."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


#: A fixed random number for each byte; word bytes of ASCII; every other byte belongs to a word once separators are gone.
_BYTE = _mix(np.arange(1, 257, dtype=_U) * _ODD[0]) | _U(1)
_IN_WORD = np.array([c >= 128 or chr(c).isalnum() or c == 95 for c in range(256)])
_SEPARATORS = re.compile(r"[^\w\x00-\x7f]+")


def _powers(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.concatenate([np.ones(1, _U), np.full(n - 1, base, _U)]), dtype=_U)


#: Powers of an odd number and of its inverse modulo 2**64, for texts of up to so many bytes at once.
_SPAN = 1 << 16
_POWER, _INVERSE = _powers(0x9E3779B97F4A7C15, _SPAN), _powers(pow(0x9E3779B97F4A7C15, -1, 1 << 64), _SPAN)


def _hashes(raw: np.ndarray) -> np.ndarray:
    """Hashes of the words in up to ``_SPAN`` bytes: differences of one running sum, moved to where a word starts at power 0."""
    inside = _IN_WORD[raw]
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    start, end = edges[0::2], edges[1::2]
    with np.errstate(over="ignore"):
        running = np.concatenate([np.zeros(1, _U), np.cumsum(_BYTE[raw] * _POWER[: len(raw)], dtype=_U)])
        return _mix((running[end] - running[start]) * _INVERSE[start] + (end - start).astype(_U))


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of the words in order: runs of letters, digits and underscores in lower case.

    A polynomial over a word's UTF-8 bytes, all words of a text at once; longer texts go in
    parts that end where no word is cut, and a word that is longer than a part by itself.
    """
    low = (text or "").lower()
    if not low.isascii():
        low = _SEPARATORS.sub(" ", low)
    raw = np.frombuffer(low.encode("utf-8", "surrogatepass"), np.uint8)
    if len(raw) <= _SPAN:
        return _hashes(raw)
    out, at = [], 0
    gaps = np.append(np.flatnonzero(~_IN_WORD[raw]), len(raw))  # where parts may end
    while at < len(raw):
        k = int(np.searchsorted(gaps, at + _SPAN - 1, "right")) - 1
        end = int(gaps[k]) if k >= 0 and gaps[k] > at else int(gaps[min(k + 1, len(gaps) - 1)])
        if end - at <= _SPAN:
            out.append(_hashes(raw[at:end]))
        else:  # one long word
            out.append(_long_word(raw[at:end]))
        at = end + 1
    return np.concatenate(out)


def _long_word(raw: np.ndarray) -> np.ndarray:
    total = _U(0)
    with np.errstate(over="ignore"):
        step = _POWER[-1] * _POWER[1]
        for k in range((len(raw) - 1) // _SPAN, -1, -1):
            part = raw[k * _SPAN : (k + 1) * _SPAN]
            total = total * step + np.sum(_BYTE[part] * _POWER[: len(part)], dtype=_U)
        return _mix(np.array([total], _U) + _U(len(raw)))


def shingles(text: str | None, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the different shingles of ``size`` words, and how often each occurs.

    Words are runs of letters, digits and underscores in lower case.  A text of fewer words,
    but not none, is one shingle.
    """
    ids = word_hashes(text)
    if not len(ids):
        return np.zeros(0, _U), np.zeros(0, np.int64)
    n = min(size, len(ids))
    with np.errstate(over="ignore"):
        total = np.full(len(ids) - n + 1, n, _U)
        for k in range(n):
            total += ids[k : len(ids) - n + 1 + k] * (_ODD[k % 5] + _U(2 * k))
        return np.unique(_mix(total), return_counts=True)


def signature(hashes: np.ndarray, weights: np.ndarray, registers: int) -> np.ndarray:
    """The earliest time of each register."""
    with np.errstate(over="ignore"):
        blocks = 1 + np.ceil(np.log2(np.maximum(weights, 1))).astype(np.int64)
        which = np.repeat(np.arange(len(hashes)), blocks)
        level = np.arange(len(which)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        low = np.where(level == 0, 0, 2.0 ** (level - 1))
        rate = np.where(level == 0, 1.0, low)
        bound = weights[which].astype(float)
        seed = _mix(hashes[which] + level.astype(_U) * _ODD[1])
        least = np.full(registers, np.inf)
        at, drawn = np.zeros(len(which)), 0
        points = int(np.clip(1.2 * registers * 5 / weights.sum() + 2, 2, 4096))
        while len(which):
            z = _mix(seed[:, None] + (np.arange(drawn, drawn + points, dtype=_U) * _ODD[0])[None, :])
            gap = -np.log(((z >> _U(11)).astype(float) + 0.5) * 2.0**-53) / rate[:, None]
            gap[:, 0] += at
            time = np.cumsum(gap, axis=1)  # one after another, so that sums do not depend on how many are drawn at once
            other = _mix(z ^ _ODD[2])
            counts = low[:, None] + rate[:, None] * ((other & _U(0xFFFFFFFF)).astype(float) * 2.0**-32) < bound[:, None]
            counts &= time < least.max()
            np.minimum.at(least, (((other >> _U(32)) * _U(registers)) >> _U(32))[counts].astype(np.int64), time[counts])
            more = time[:, -1] < least.max()
            at, drawn = time[more, -1], drawn + points
            which, seed, low, rate, bound = which[more], seed[more], low[more], rate[more], bound[more]
        return least


def bands_of(least: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit value for each band of ``rows`` registers."""
    with np.errstate(over="ignore"):
        grid = least.view(_U).reshape(-1, rows)
        total = np.arange(len(grid), dtype=_U) * _ODD[3]
        for k in range(rows):
            total = _mix(total + grid[:, k])
        return total.view(np.int64)


def _sign(bands: int, rows: int, size: int):
    def run(batches):
        seen: set[bytes] = set()  # a digest for each different text of this partition, which the size of partitions bounds
        for whole in batches:
            for batch in slices(whole, 256):
                out = []
                for key, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                    if key in seen:
                        out.append((None, None, None))
                        continue
                    seen.add(key)
                    hashes, weights = shingles(text, size)
                    out.append((text, int(weights.sum()), bands_of(signature(hashes, weights, bands * rows), rows)) if len(hashes) else (None, None, None))
                kinds = [pa.string(), pa.int64(), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds))], ["doc_id", "key", "text", "size", "bands"])

    return run


def _compare(size: int, extras: bool):
    """a, b and the weight that both multisets share; with ``extras`` also what b has beyond a, one value for each unit of weight."""

    def run(batches):
        kept: OrderedDict = OrderedDict()

        def of(key, text):
            if key not in kept:
                kept[key] = shingles(text, size)
                if len(kept) > 64:
                    kept.popitem(last=False)
            return kept[key]

        for whole in batches:
            for batch in slices(whole, 256):
                both, more = [], []
                for a, b, x, y in zip(*(batch.column(k).to_pylist() for k in ("a", "b", "text_a", "text_b")), strict=True):
                    (ha, wa), (hb, wb) = of(a, x), of(b, y)
                    _, i, j = np.intersect1d(ha, hb, assume_unique=True, return_indices=True)
                    common = np.minimum(wa[i], wb[j])
                    both.append(int(common.sum()))
                    if extras:
                        left = wb.copy()
                        left[j] -= common
                        with np.errstate(over="ignore"):
                            unit = np.arange(int(left.sum())) - np.repeat(np.cumsum(left) - left, left)
                            more.append((np.repeat(hb, left) + unit.astype(_U) * _ODD[4]).view(np.int64))
                columns = [batch.column(0), batch.column(1), pa.array(both, pa.int64()), *([pa.array(more, pa.list_(pa.int64()))] if extras else [])]
                yield pa.RecordBatch.from_arrays(columns, ["a", "b", "both", "extra"][: len(columns)])

    return run


def near_duplicates(docs: DataFrame, threshold: float = 0.8, size: int = 5, bands: int = 24, rows: int = 4) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, class_id, n_copies.

    Two texts are linked where the weighted Jaccard similarity of their multisets of ``size``
    word shingles is at least ``threshold``; a class is a connected component of links, and its
    id is its least doc_id.  Equal texts are one node from the start.  With the default bands a
    pair at the threshold goes unnoticed with probability (1 - 0.8**4)**24, about 3 in a million.

    Null counts as empty; texts without a word are in a class only with equal texts.  A text of
    fewer words than ``size`` is one shingle.  Repeated rows are one node; null ids never name
    a class unless the whole class has none (class_id is null then).  An empty table gives no
    row; other columns are ignored.  ``n_copies`` counts the rows with the very same text.

    No bucket is expanded into its pairs.  Every text of a bucket is compared with the bucket's
    pivot, its most central text, and the links found give first classes.  Two texts f and a of
    different classes that share a pivot p hold at most min(both(f,p), both(a,p)) shingles of p
    in common; whatever else they share, both have beyond p.  So a link is only possible where
    that bound alone reaches the threshold, or where the texts share enough of their shingles
    beyond p: these are rare in a group around its pivot, and an inverted index over the rarest
    of them finds every such pair.  Just these pairs are compared, and none that can be linked
    is left out.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.md5(text.cast("binary"))).alias("key"), text.alias("text"))
    signed = settle(keyed.mapInArrow(_sign(bands, rows, size), "doc_id long, key binary, text string, size long, bands array<long>"), "signed")
    nodes = signed.groupBy("key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n_copies"))

    # a key comes at most once from each partition of the scan
    entries = signed.where("bands is not null").dropDuplicates(["key"]).select("key", "size", F.explode("bands").alias("bucket"))
    shared = entries.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    shared_entries = settle(entries.join(shared, "bucket"), "shared")
    # a text near the middle of a group is in more and larger buckets than one at its edge
    central = shared_entries.groupBy("key").agg(F.sum("n").alias("rank"))
    members = settle(shared_entries.drop("n").join(central, "key").select("bucket", "key", "size", "rank"), "members")
    texts = settle(signed.where("text is not null").select("key", "text").join(central.select("key"), "key", "left_semi").dropDuplicates(["key"]), "texts")

    def compared(pairs: DataFrame, extras: bool, name: str) -> DataFrame:
        """a, b, both[, extra] of different pairs; the rarely repeated side b is joined first, the pivots' side a may be skewed."""
        with_b = pairs.join(texts.select(F.col("key").alias("b"), F.col("text").alias("text_b")), "b")
        found = with_b.join(texts.select(F.col("key").alias("a"), F.col("text").alias("text_a")), "a").select("a", "b", "text_a", "text_b")
        return settle(found.mapInArrow(_compare(size, extras), "a binary, b binary, both long" + ", extra array<long>" * extras), name)

    # the shared weight of a link is at least this share of both sizes together; less a hair, so that rounding loses none
    least = F.lit(threshold / (1 + threshold) - 1e-12)
    sizes = members.select("key", "size").distinct()

    pivots = members.groupBy("bucket").agg(F.max(F.struct("rank", "key")).alias("p")).select("bucket", F.col("p.key").alias("a"))
    star = compared(members.join(pivots, "bucket").where("key <> a").select("a", F.col("key").alias("b")).distinct(), False, "star")
    star = star.join(sizes.select(F.col("key").alias("a"), F.col("size").alias("size_a")), "a").join(sizes.select(F.col("key").alias("b"), "size"), "b")
    star = settle(star, "sized")
    linked = lambda df: df.where(F.col("both") >= least * (F.col("size_a") + F.col("size"))).select(F.col("a").alias("src"), F.col("b").alias("dst"))
    classes = settle(components(linked(star)), "classes")

    # of each pivot the texts around it and their classes, where these are several
    around = star.join(classes.withColumnRenamed("node", "b"), "b", "left").select(F.col("a").alias("p"), F.col("b").alias("x"), "size", "both", F.coalesce("class", "b").alias("class"))
    several = around.groupBy("p").agg(F.min("class").alias("c0"), F.max("class").alias("c1"), F.min("size").alias("smallest")).where("c0 <> c1").select("p", "smallest")
    open_ = settle(around.join(several, "p"), "open")
    by_class = open_.groupBy("p", "class").agg(F.count("*").alias("n")).groupBy("p").agg(F.max(F.struct("n", "class")).alias("m")).select("p", F.col("m.class").alias("main"))
    open_main = open_.join(by_class, "p")

    # pairs that may be linked by shingles of the pivot alone: a is smaller than the pivot then
    room = F.col("both") / least - F.col("size")  # the largest partner that ``both`` would do for
    wide = open_main.withColumn("room", room).where("room >= smallest")
    most = wide.where("class <> main").groupBy("p").agg(F.max("room").alias("most"))
    f = wide.where("class <> main").select("p", F.col("x").alias("f"), F.col("size").alias("size_f"), F.col("class").alias("class_f"), F.col("room").alias("room_f"))
    a = wide.join(most, "p").where("size <= most").select("p", F.col("x").alias("g"), F.col("size").alias("size_g"), F.col("class").alias("class_g"), F.col("room").alias("room_g"), "main")
    once = lambda c: (F.col("class_g") == F.col(c)) | (F.col("f") < F.col("g"))  # noqa: E731  a pair of two outer texts counts from one side
    narrow = f.join(a, "p").where((F.col("class_f") != F.col("class_g")) & (F.col("size_g") <= F.col("room_f")) & (F.col("size_f") <= F.col("room_g")) & once("main")).select("f", "g")

    # pairs that share shingles beyond the pivot
    beyond = compared(open_.select(F.col("p").alias("a"), F.col("x").alias("b")), True, "beyond").select(F.col("a").alias("p"), F.col("b").alias("x"), "extra")
    beyond = beyond.join(open_.select("p", "x", "size", "both", "class", "smallest"), ["p", "x"])
    beyond = settle(beyond.select("p", "x", "size", "both", "class", "smallest", F.explode("extra").alias("s")), "extras")
    by_shingle = beyond.groupBy("p", "s", "class").agg(F.count("*").alias("n")).groupBy("p", "s")
    held = by_shingle.agg(F.max(F.struct("n", "class")).alias("m"), F.count("*").alias("k"), F.sum("n").alias("often")).where("k > 1").select("p", "s", "often", F.col("m.class").alias("usual"))
    # what a text must share beyond the pivot with a partner of the least size; of that many it shares at
    # least one among all but need - 1 of its shingles: the frequent ones need not be looked up
    need = F.greatest(F.ceil(least * (F.col("size") + F.col("smallest")) - F.col("both")), F.lit(1))
    own = Window.partitionBy("p", "x")
    common = beyond.join(held, ["p", "s"]).withColumns({"n": F.count("*").over(own), "place": F.row_number().over(own.orderBy("often", "s"))})
    common = settle(common.where(F.col("place") <= F.col("n") - need + 1).withColumn("rest", F.col("n") - F.col("place")), "common")
    side = lambda name, c: F.col(c).alias(f"{c}_{name}")
    f = common.where("class <> usual").select("p", "s", F.col("x").alias("f"), *(side("f", c) for c in ("size", "both", "class", "rest")))
    a = common.select("p", "s", F.col("x").alias("g"), *(side("g", c) for c in ("size", "both", "class", "rest")), "usual")
    # after the first shingle that two texts share, they share at most what the shorter of them has left
    most = F.least("both_f", "both_g") + 1 + F.least("rest_f", "rest_g")
    met = f.join(a, ["p", "s"]).where((F.col("class_f") != F.col("class_g")) & once("usual") & (most >= least * (F.col("size_f") + F.col("size_g"))))
    enough = met.select("f", "g").distinct()

    doubtful = settle(narrow.select(F.least("f", "g").alias("a"), F.greatest("f", "g").alias("b")).unionByName(enough.select(F.col("f").alias("a"), F.col("g").alias("b"))).distinct(), "doubtful")
    rest = compared(doubtful, False, "rest").join(sizes.select(F.col("key").alias("a"), F.col("size").alias("size_a")), "a").join(sizes.select(F.col("key").alias("b"), "size"), "b")
    late = settle(linked(rest), "late")
    if not late.isEmpty():
        classes = settle(components(late.unionByName(classes.select(F.col("node").alias("src"), F.col("class").alias("dst")))), "classes")

    grouped = nodes.join(classes.withColumnRenamed("node", "key"), "key", "left").withColumn("class", F.coalesce("class", "key"))
    names = grouped.groupBy("class").agg(F.min("rep").alias("class_id"))
    named = grouped.join(names, "class").select("key", "class_id", "n_copies")
    # narrow rows: a text that a third of them share is split by the skewed-join rule
    return signed.select("doc_id", "key").join(named, "key").select("doc_id", "class_id", "n_copies")


def deduplicate(docs: DataFrame, threshold: float = 0.8, size: int = 5) -> DataFrame:
    """``docs`` with one document of each class: the one with the least doc_id.

    Of rows that repeat both doc_id and text one stays.  Rows without doc_id stay where their
    class has no id at all.  Columns and their order are kept.
    """
    classes = near_duplicates(docs, threshold, size)
    kept = classes.where(F.col("doc_id").eqNullSafe(F.col("class_id"))).select(F.col("doc_id").alias("kept_id")).distinct()
    found = docs.join(kept, F.col("doc_id").cast("long").eqNullSafe(F.col("kept_id")), "left_semi")
    digest = "_digest_of_text"
    return found.withColumn(digest, F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"))).dropDuplicates(["doc_id", digest]).drop(digest)
