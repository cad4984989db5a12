"""Benchmark decontamination with a generalised suffix automaton over words.

The automaton of all normalised test items (words are its symbols) gives, streamed over a
document's words, the longest match that ends at each word.  A match as long as a window is
contamination; the items are those whose end positions the automaton's state carries.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import settle, slices

#: Fixed value: what counts as a word once A-Z are lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORDS = re.compile(WORD)
_LOWER = {c: c + 32 for c in range(65, 91)}

def words(text: str | None) -> list[str]:
    return _WORDS.findall((text or "").translate(_LOWER))


class Automaton:
    """Generalised suffix automaton of word sequences.

    ``step`` and ``link`` and ``size`` are the usual transitions, suffix links and longest
    lengths; ``items[state]`` are the sequences in which the state's strings occur.
    """

    def __init__(self, sequences: list[tuple[str, list[str]]], window: int):
        self.window = window
        self.step: list[dict[str, int]] = [{}]
        self.link, self.size = [-1], [0]
        marks: dict[int, set[str]] = {}  # only of states that hold a whole window
        self.short: dict[int, dict[int, set[str]]] = {}  # state -> length of a whole short item -> items
        wholes = []
        for name, seq in sequences:
            last = 0
            for w in seq:
                last = self._extend(last, w)
                if self.size[last] >= window:
                    marks.setdefault(last, set()).add(name)
            if 0 < len(seq) < window:
                wholes.append((name, seq))
        for state in sorted((k for k in range(1, len(self.size)) if self.size[k] > window), key=self.size.__getitem__, reverse=True):
            if state in marks and self.size[self.link[state]] >= window:
                marks.setdefault(self.link[state], set()).update(marks[state])
        self.items = marks
        for name, seq in wholes:
            state = 0
            for w in seq:
                state = self.step[state][w]
            self.short.setdefault(state, {}).setdefault(len(seq), set()).add(name)
        lengths = [min(window, len(seq)) for _, seq in sequences if seq]
        self.least = min(lengths, default=0)
        # Every occurrence of a window holds one of these seeds at a position of the stride.
        self.seed = min(3, self.least)
        self.stride = max(1, self.least - self.seed + 1)
        self.seeds = {tuple(seq[k : k + self.seed]) for _, seq in sequences for k in range(len(seq) - self.seed + 1)} if self.least else set()

    def _extend(self, last: int, w: str) -> int:
        step, link, size = self.step, self.link, self.size

        def split(p: int, q: int) -> int:
            step.append(dict(step[q])), link.append(link[q]), size.append(size[p] + 1)
            new = len(size) - 1
            while p != -1 and step[p].get(w) == q:
                step[p][w] = new
                p = link[p]
            link[q] = new
            return new

        if w in step[last]:
            q = step[last][w]
            return q if size[q] == size[last] + 1 else split(last, q)
        step.append({}), link.append(0), size.append(size[last] + 1)
        new, p = len(size) - 1, last
        while p != -1 and w not in step[p]:
            step[p][w] = new
            p = link[p]
        if p != -1:
            q = step[p][w]
            link[new] = q if size[q] == size[p] + 1 else split(p, q)
        return new

    def regions(self, doc: list[str]):
        """Stretches outside which no window can occur, found by looking up one seed in each stride."""
        s, k = self.stride, self.seed
        first = s - 1
        grams = zip(*(doc[first + j :: s] for j in range(k)))
        lo = hi = None
        seeds = self.seeds
        for at in [i for i, g in enumerate(grams) if g in seeds]:
            a, b = max(0, first + at * s - self.window), min(len(doc), first + at * s + k + self.window)
            if hi is not None and a <= hi:
                hi = b
            else:
                if hi is not None:
                    yield lo, hi
                lo, hi = a, b
        if hi is not None:
            yield lo, hi

    def scan(self, doc: list[str]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged hit stretches of word positions, and the items that have an occurring window."""
        spans: list[tuple[int, int]] = []
        found: set[str] = set()
        if not self.least or len(doc) < self.least:
            return spans, found
        step, link, size, window, short = self.step, self.link, self.size, self.window, self.short
        named: set[int] = set()  # states whose items are in found
        for lo, hi in self.regions(doc):
            state = length = 0
            for i in range(lo, hi):
                w = doc[i]
                while state and w not in step[state]:
                    state = link[state]
                    length = size[state]
                state = step[state].get(w, 0)
                length = length + 1 if state else 0
                hit = 0
                if length >= window:
                    # Only the last window of words matters from here on: each link climbed is never climbed again.
                    while size[link[state]] >= window:
                        state = link[state]
                    hit = length = window
                    if state not in named:
                        named.add(state)
                        found |= self.items.get(state, set())
                if short:
                    at = state  # at most a window of links: their sizes fall
                    while at > 0:
                        for n, names in short.get(at, {}).items():
                            if n <= length:
                                hit = max(hit, n)
                                found |= names
                        at = link[at]
                if hit:
                    a = i - hit + 1
                    while spans and a <= spans[-1][1]:
                        a = min(a, spans.pop()[0])
                    spans.append((a, i + 1))
        return spans, found


@lru_cache(maxsize=1)
def _automaton(packed: tuple, window: int) -> Automaton:
    return Automaton([(name, words(text)) for name, text in packed], window)


def _merge(lists: list[list[tuple[int, int]]]) -> list[tuple[int, int]]:
    if len(lists) == 1:
        return lists[0]
    out: list[tuple[int, int]] = []
    for a, b in sorted(x for spans in lists for x in spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _without(text: str, spans: list[tuple[int, int]]) -> str:
    """The text less the stretches from a span's first to its last word."""
    at = [m.span() for m in _WORDS.finditer(text.translate(_LOWER))]
    out, pos = [], 0
    for a, b in spans:
        out.append(text[pos : at[a][0]])
        pos = at[b - 1][1]
    return "".join(out) + text[pos:]


def _verdict(n_words: int, spans: list[tuple[int, int]], items: set[str], one_in: int) -> tuple:
    n_hit = sum(b - a for a, b in spans)
    return n_words, n_hit, len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), n_hit > 0 and n_hit * one_in >= n_words


VERDICT = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
_KINDS = [pa.int64()] * 3 + [pa.string(), pa.bool_()]


def _judge(shared, window: int, one_in: int, clean: bool):
    """Batches of text and other columns: adds the verdict, and with ``clean`` cuts the hit stretches out of the text."""

    def run(batches):
        automaton = _automaton(shared.value, window)
        for whole in batches:
            for batch in slices(whole, 512):
                out, cleaned = [], []
                for text in batch.column("text").to_pylist():
                    doc = words(text)
                    spans, items = automaton.scan(doc)
                    out.append(_verdict(len(doc), spans, items, one_in))
                    if clean:
                        cleaned.append(_without(text, spans) if spans else text)
                columns = [pa.array(cleaned, pa.string()) if clean and n == "text" else c for n, c in zip(batch.schema.names, batch.columns, strict=True) if clean or n != "text"]
                names = [n for n in batch.schema.names if clean or n != "text"]
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array([r[k] for r in out], kind) for k, kind in enumerate(_KINDS))], [*names, *(x.split()[0] for x in VERDICT.split(", "))])

    return run


def _hits(shared, window: int):
    """Rows with a hit in one block of items: row_, spans (starts and ends alternating), items."""

    def run(batches):
        automaton = _automaton(shared.value, window)
        for whole in batches:
            for batch in slices(whole, 512):
                rows = []
                for row, text in zip(batch.column("row_").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    spans, items = automaton.scan(words(text))
                    if spans:
                        rows.append((row, [x for s in spans for x in s], sorted(items)))
                kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string())]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["row_", "spans", "items"])

    return run


def _conclude(one_in: int, clean: bool):
    """Like ``_judge``, from the hits of all blocks, which stand beside each row as lists of lists."""

    def run(batches):
        for whole in batches:
            for batch in slices(whole, 512):
                out, cleaned = [], []
                for text, spans, items in zip(*(batch.column(c).to_pylist() for c in ("text", "spans", "items")), strict=True):
                    merged = _merge([list(zip(s[0::2], s[1::2], strict=True)) for s in spans or []])
                    out.append(_verdict(len(words(text)), merged, set().union(*(items or [])), one_in))
                    if clean:
                        cleaned.append(_without(text, merged) if merged else text)
                kept = [n for n in batch.schema.names if n not in ("spans", "items", "row_") and (clean or n != "text")]
                columns = [pa.array(cleaned, pa.string()) if clean and n == "text" else batch.column(n) for n in kept]
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array([r[k] for r in out], kind) for k, kind in enumerate(_KINDS))], [*kept, *(x.split()[0] for x in VERDICT.split(", "))])

    return run


def _judged(rows: DataFrame, benchmark: DataFrame, window: int, one_in: int, max_bytes: int | None, block_bytes: int, clean: bool) -> DataFrame:
    """``rows`` (with text) and their verdicts; the test items go over the driver in blocks of about ``block_bytes``."""
    context = rows.sparkSession.sparkContext
    items = benchmark.where(F.col("text").isNotNull()).select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.col("text").cast("string").alias("text"))
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    if max_bytes is not None and size > max_bytes:
        raise ValueError(f"the test items have {size} bytes, more than max_bytes={max_bytes}")
    blocks = max(1, -(-size // block_bytes))
    kept = [f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if clean or f.name != "text"]
    schema = ", ".join([*kept, VERDICT])
    if blocks == 1:
        return rows.mapInArrow(_judge(context.broadcast(tuple(sorted({tuple(r) for r in items.collect()}))), window, one_in, clean), schema)
    # one block of items after another, so that neither driver nor workers ever hold more; only hits are kept
    numbered = settle(rows.withColumn("row_", F.monotonically_increasing_id()), "numbered")
    spread = settle(items.distinct().withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))), "items")
    found = None
    for k in range(blocks):
        shared = context.broadcast(tuple(sorted((r[0], r[1]) for r in spread.where(F.col("block") == k).select("item_id", "text").collect())))
        hits = settle(numbered.select("row_", "text").mapInArrow(_hits(shared, window), "row_ long, spans array<long>, items array<string>"), "hits")
        shared.unpersist()
        found = hits if found is None else found.unionByName(hits)
    pooled = found.groupBy("row_").agg(F.collect_list("spans").alias("spans"), F.collect_list("items").alias("items"))  # one entry a block
    return numbered.join(pooled, "row_", "left").mapInArrow(_conclude(one_in, clean), schema)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, one_in: int = 20, max_bytes: int | None = None, block_bytes: int = 4_000_000) -> DataFrame:
    """How much of each document occurs in the test items.

    One row per row of ``docs``: doc_id, n_words, n_hit (words inside any window of any item),
    n_items, items_sha256 (over the sorted ids of those items), contaminated (hit words are at
    least one in ``one_in`` words and not none).

    A null or empty text has no words; so has an item without words, which then never occurs.
    An item of fewer words than ``window`` counts as one window.  Repeated items and documents
    are each judged for themselves; a null item id counts as the empty string.  Items of more
    than about ``block_bytes`` go in blocks, each with an automaton of its own, and the
    stretches that the blocks hit are united: results do not depend on it.  A caller may state
    ``max_bytes``, beyond which a test set is refused; by default none is.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return _judged(rows, benchmark, window, one_in, max_bytes, block_bytes, False)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 13, one_in: int = 20, max_bytes: int | None = None, block_bytes: int = 4_000_000) -> DataFrame:
    """``docs`` without contaminated documents, and without the hit stretches of the others.

    Keeps the columns of ``docs`` in their order; documents without a hit are unchanged.
    """
    other = {c: f"_of_{i}" for i, c in enumerate(c for c in docs.columns if c != "text")}
    rows = docs.select(F.col("text").cast("string").alias("text"), *(F.col(c).alias(n) for c, n in other.items()))
    judged = _judged(rows, benchmark, window, one_in, max_bytes, block_bytes, True).where(~F.col("contaminated"))
    return judged.select(*(F.col(other.get(c, c)).alias(c) for c in docs.columns))


#: DuckDB SQL for ``contamination`` with its default parameters over documents and benchmark.
CONTAMINATION_SQL = r"""
WITH low AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS l FROM documents),
items AS (SELECT coalesce(CAST(item_id AS varchar), '') AS item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS l FROM benchmark WHERE text IS NOT NULL),
cut AS (SELECT item_id, l, least(13, len(l)) AS k FROM items WHERE len(l) > 0),
win AS (SELECT DISTINCT item_id, k, array_to_string(l[i : i + k - 1], ' ') AS gram FROM (SELECT item_id, l, k, unnest(range(1, len(l) - k + 2)) AS i FROM cut)),
sizes AS (SELECT DISTINCT k FROM win),
grams AS (SELECT r, i, k, array_to_string(l[i : i + k - 1], ' ') AS gram FROM (SELECT r, l, k, unnest(range(1, len(l) - k + 2)) AS i FROM low, sizes WHERE len(l) >= k)),
hits AS (SELECT g.r, g.i, g.k, w.item_id FROM grams g JOIN win w ON w.k = g.k AND w.gram = g.gram),
spots AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS p FROM hits) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id FROM hits) GROUP BY r)
SELECT doc_id, len(l) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * n_hit >= len(l) AS contaminated
FROM low LEFT JOIN spots USING (r) LEFT JOIN named USING (r)
"""
