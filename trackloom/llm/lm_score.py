"""Language-model scoring with stupid backoff over counts of the corpus itself.

1. Documents are read into chunks: the words of many documents as indices into the chunk's
   sorted table of word hashes.
2. Each chunk sends every different n-gram (its 64-bit hash and how often the chunk has it)
   to the bucket of its hash.  Buckets sum the counts over all chunks: together they are the
   corpus's count tables, partitioned by hash.
3. The totals go back and are joined with the chunk's n-grams, and every document's scores
   are summed.

An n-gram comes once from each chunk, however many documents share it, so that no frequent
n-gram gathers in a task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .decontamination import words
from .near_dedup import _ODD, _U, _mix
from .shared import settle, slices

CHUNKS = "chunk long, n_tokens long, doc_ids binary, null_ids binary, lengths binary, hashes binary, indices binary"
CELLS = "bucket int, ngram int, chunk long, keys binary, counts binary"
TOTALS = "chunk long, ngram int, bucket int, totals binary"
SCORES = "doc_id long, n_words long, log_score double"


class _WordHash(dict):
    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) >= 300_000:
            self.clear()
        self[word] = got = xxhash.xxh3_64_intdigest(word)
        return got


_HASHES = _WordHash()


def planes(x: np.ndarray) -> bytes:
    """Integers byte plane by byte plane, which the shuffle's compression packs well."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def from_planes(data: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    if not data:
        return np.zeros(0, kind)
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).ravel()


def ngrams(hashes: np.ndarray, lengths: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the words that end an n-gram within their document, and the n-grams' keys."""
    starts = np.repeat(np.cumsum(lengths) - lengths, lengths)
    ends = np.flatnonzero(np.arange(len(hashes)) - starts >= n - 1)
    with np.errstate(over="ignore"):
        keys = np.full(len(ends), n, _U)
        for k in range(n - 1, -1, -1):
            keys = _mix(keys + hashes[ends - k]) * _ODD[k % 5]
        return ends, _mix(keys)


def _chunk(chunk_tokens: int):
    def run(batches):
        part, number = TaskContext.get().partitionId(), 0
        ids, lengths, held, size = [], [], [], 0

        def row():
            nonlocal ids, lengths, held, size, number
            flat = np.concatenate(held) if held else np.zeros(0, _U)
            table, index = np.unique(flat, return_inverse=True)
            out = (part << 32 | number, len(flat), np.asarray([x or 0 for x in ids], "<i8").tobytes(), np.packbits([x is None for x in ids]).tobytes(), np.asarray(lengths, "<i8").tobytes(), table.tobytes(), planes(index.astype("<u4")))
            ids, lengths, held, size = [], [], [], 0
            number += 1
            kinds = [pa.int64()] * 2 + [pa.binary()] * 5
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(out, kinds, strict=True)], [x.split()[0] for x in CHUNKS.split(", ")])

        for whole in batches:
            for batch in slices(whole, 512):
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    found = words(text)
                    ids.append(doc_id)
                    lengths.append(len(found))
                    held.append(np.array([_HASHES[w] for w in found], _U))
                    size += len(found)
                    if size >= chunk_tokens:
                        yield row()
        if ids:
            yield row()

    return run


def _cells(order: int, buckets: int):
    def run(batches):
        for batch in batches:
            for c in range(batch.num_rows):
                chunk, lengths = batch.column("chunk")[c].as_py(), np.frombuffer(batch.column("lengths")[c].as_py(), "<i8")
                hashes = np.frombuffer(batch.column("hashes")[c].as_py(), _U)[from_planes(batch.column("indices")[c].as_py(), "<u4")]
                for n in range(1, order + 1):
                    keys, counts = np.unique(ngrams(hashes, lengths, n)[1], return_counts=True)
                    edges = np.searchsorted((keys >> _U(32)) * _U(buckets) >> _U(32), np.arange(buckets + 1, dtype=_U))
                    rows = [(b, n, chunk, planes(np.diff(keys[i:j], prepend=_U(0))), planes(counts[i:j].astype("<u4"))) for b, (i, j) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)) if j > i]
                    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], [x.split()[0] for x in CELLS.split(", ")])

    return run


def _count(table: pa.Table) -> pa.Table:
    """One bucket of the count table: every cell gets the corpus's totals of its n-grams, in its own order."""
    keys = [np.cumsum(from_planes(x, _U), dtype=_U) for x in table.column("keys").to_pylist()]
    counts = np.concatenate([from_planes(x, "<u4") for x in table.column("counts").to_pylist()])
    _, index = np.unique(np.concatenate(keys), return_inverse=True)
    totals = np.bincount(index, weights=counts)[index].astype("<u8")  # exact below 2**53
    ends = np.cumsum([len(k) for k in keys])
    parts = [planes(totals[e - len(k) : e]) for k, e in zip(keys, ends.tolist(), strict=True)]
    return pa.table([table.column("chunk"), table.column("ngram"), table.column("bucket"), pa.array(parts, pa.binary())], names=["chunk", "ngram", "bucket", "totals"])


def _score(order: int, alpha: float, min_count: int, n_tokens: int):
    def run(chunk: pa.Table, found: pa.Table) -> pa.Table:
        got = {}
        for n in range(1, order + 1):
            rows = sorted((b, t) for k, b, t in zip(*(found.column(c).to_pylist() for c in ("ngram", "bucket", "totals")), strict=True) if k == n)
            got[n] = np.concatenate([from_planes(t, "<u8") for _, t in rows]).astype(float) if rows else np.zeros(0)
        out = []
        for c in chunk.to_pylist():
            lengths = np.frombuffer(c["lengths"], "<i8")
            hashes = np.frombuffer(c["hashes"], _U)[from_planes(c["indices"], "<u4")]
            doc = np.repeat(np.arange(len(lengths)), lengths)
            # from words up: the score of the shorter n-gram holds where the longer one is too rare
            log = before = None
            for n in range(1, order + 1):
                ends, keys = ngrams(hashes, lengths, n)
                count = np.zeros(len(hashes))
                count[ends] = got[n][np.unique(keys, return_inverse=True)[1]]
                if n == 1:
                    log = np.log(np.maximum(count, 1) / max(n_tokens, 1))
                else:
                    seen = np.flatnonzero(count >= min_count)
                    rare = ends[count[ends] < min_count]
                    log[rare] += np.log(alpha)
                    log[seen] = np.log(count[seen] / before[seen - 1])
                before = count
            ids = np.frombuffer(c["doc_ids"], "<i8")
            none = np.unpackbits(np.frombuffer(c["null_ids"], np.uint8), count=len(ids)).astype(bool)
            out.append(pa.table([pa.array(ids, mask=none), pa.array(lengths), pa.array(np.bincount(doc, weights=log, minlength=len(ids)))], names=["doc_id", "n_words", "log_score"]))
        return pa.concat_tables(out)

    return run


def _table(cells: pa.Table) -> pa.Table:
    """One bucket's n-grams and their counts as rows."""
    keys = np.concatenate([np.cumsum(from_planes(x, _U), dtype=_U) for x in cells.column("keys").to_pylist()])
    counts = np.concatenate([from_planes(x, "<u4") for x in cells.column("counts").to_pylist()])
    different, index = np.unique(keys, return_inverse=True)
    n = cells.column("ngram")[0].as_py()
    return pa.table([pa.array(np.full(len(different), n, np.int32)), pa.array(different.view(np.int64)), pa.array(np.bincount(index, weights=counts).astype(np.int64))], names=["ngram", "key", "n"])


def _chunks(docs: DataFrame, chunk_tokens: int) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return settle(rows.mapInArrow(_chunk(chunk_tokens), CHUNKS), "chunks")


def _partitioned(chunks: DataFrame, order: int):
    """Every chunk's n-grams, grouped by the bucket of their hash."""
    buckets = 4 * int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return chunks.select("chunk", "lengths", "hashes", "indices").mapInArrow(_cells(order, buckets), CELLS).groupBy("bucket", "ngram")


def ngram_counts(docs: DataFrame, order: int = 2, chunk_tokens: int = 2_000_000) -> DataFrame:
    """The count tables that ``score`` joins: ngram (1 to ``order``), key (the n-gram's 64-bit hash) and n, over all of ``docs``."""
    return _partitioned(_chunks(docs, chunk_tokens), order).applyInArrow(_table, "ngram int, key long, n long")


def score(docs: DataFrame, order: int = 2, alpha: float = 0.4, min_count: int = 2, chunk_tokens: int = 2_000_000) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_words, log_score (the sum over its words).

    A word after its predecessors scores log(c(n-gram) / c(n-gram less its last word)) where the
    corpus has the n-gram at least ``min_count`` times; else ``alpha`` times the score of the
    shorter n-gram, down to the word's share of all words.  N-grams lie within one document; the
    first words of a document use the longest that fits.  Counts are over all of ``docs``.

    A text without words, null or empty, has score 0.  Repeated rows count and are scored each
    for itself; null ids are kept; an empty table gives no row; other columns are ignored.
    ``chunk_tokens`` bounds a worker's memory besides a single document; it should grow with the
    number of shuffle partitions, which the buckets follow.
    """
    chunks = _chunks(docs, chunk_tokens)
    n_tokens = chunks.agg(F.sum("n_tokens")).first()[0] or 0
    totals = _partitioned(chunks, order).applyInArrow(_count, TOTALS)
    return chunks.groupBy("chunk").cogroup(totals.groupBy("chunk")).applyInArrow(_score(order, alpha, min_count, n_tokens), SCORES)


#: DuckDB SQL for ``score`` with its default parameters, rounded like the query.
SCORE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS l FROM documents),
w AS (SELECT r, unnest(l) AS word, generate_subscripts(l, 1) AS pos FROM d),
g AS (SELECT r, pos, word, lag(word) OVER (PARTITION BY r ORDER BY pos) AS prev FROM w),
c1 AS (SELECT word, count(*) AS n FROM w GROUP BY word),
c2 AS (SELECT prev, word, count(*) AS n FROM g WHERE prev IS NOT NULL GROUP BY prev, word),
total AS (SELECT count(*) AS n FROM w),
s AS (SELECT g.r, CASE WHEN g.prev IS NULL THEN ln(a.n / total.n) WHEN c2.n >= 2 THEN ln(c2.n / b.n) ELSE ln(0.4) + ln(a.n / total.n) END AS x
      FROM g CROSS JOIN total JOIN c1 a ON a.word = g.word LEFT JOIN c1 b ON b.word = g.prev LEFT JOIN c2 ON c2.prev = g.prev AND c2.word = g.word)
SELECT d.doc_id, CAST(len(any_value(d.l)) AS BIGINT) AS n_words, round(coalesce(sum(s.x), 0), 4) AS log_score FROM d LEFT JOIN s USING (r) GROUP BY d.r, d.doc_id
"""
