"""Packing by concatenate-and-cut.

Pass one encodes every document once, in scan order, and writes its ids with the number of
ids that its partition held before it.  The partitions' totals (one row each) give by a
prefix sum the global offset of every partition, hence of every document.  Pass two cuts the
stream at multiples of the sequence length; a document that crosses a cut leaves one piece
in each sequence that it touches, and pieces carry both boundaries.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import settle, slices
from .tokens import encoder

ENCODED = "part int, local_start long, doc_id long, n long, ids binary"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, opens boolean, closes boolean, ids binary"


def _encode(path: str, end_id: int, width: str):
    def run(batches):
        encode, part, at = encoder(path), TaskContext.get().partitionId(), 0
        end = np.asarray([end_id], "<u4").tobytes()
        for whole in batches:
            for batch in slices(whole, 512):
                ids, n, starts = [], [], []
                for text in batch.column(1).to_pylist():
                    got = encode(text) + end
                    n.append(len(got) // 4)
                    starts.append(at)
                    at += n[-1]
                    ids.append(np.frombuffer(got, "<u4").astype(width).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(n), pa.int32()), pa.array(starts, pa.int64()), batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.binary())],
                    ["part", "local_start", "doc_id", "n", "ids"],
                )

    return run


def _cut(length: int, width: str, with_ids: bool):
    names = [x.split()[0] for x in PIECES.split(", ")][: None if with_ids else -1]

    def run(batches):
        for whole in batches:
            for batch in slices(whole, 512):
                rows = []
                for doc_id, n, ids, at in zip(*(batch.column(k).to_pylist() for k in ("doc_id", "n", "ids", "global_start")), strict=True):
                    own = memoryview(np.frombuffer(ids, width).astype("<u4").tobytes())
                    start = 0
                    while start < n:
                        seq, offset = divmod(at + start, length)
                        size = min(n - start, length - offset)
                        piece = own[4 * start : 4 * (start + size)]
                        rows.append((doc_id, start, size, zlib.crc32(piece), n, seq, offset, start == 0, start + size == n, *([bytes(piece)] if with_ids else [])))
                        start += size
                kinds = [pa.int64()] * 7 + [pa.bool_()] * 2 + [pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds)] if rows else [pa.array([], k) for k in kinds[: len(names)]], names)

    return run


def pack(docs: DataFrame, tokenizer: str, length: int = 1024, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Cut all of ``docs`` (doc_id, text) into sequences of ``length`` ids.

    One row per piece: which ids of which document (``start``, ``length`` of ``doc_tokens``),
    where they lie (``sequence_id``, ``offset``), their crc32, whether the piece opens or
    closes its document, and on request the ids (little-endian unsigned 32-bit).

    Only the last sequence can need padding.  A null or empty text is the end id alone.
    Rows are taken as they are: repeated rows and repeated or null ids are packed each for
    itself.  An empty table gives no piece.  Columns other than doc_id and text are ignored.
    A text of any length is encoded whole and cut as often as it must be.
    """
    # ids below 65536 are kept in two bytes; every public vocabulary here fits, others take four
    width = "<u2" if max(encoder(tokenizer).tokenizer.get_vocab_size(), end_id + 1) <= 65536 else "<u4"
    encoded = settle(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_encode(tokenizer, end_id, width), ENCODED), "pack")
    totals = encoded.groupBy("part").agg(F.sum("n").alias("total"))
    # one row per scan partition: the prefix sum itself is tiny
    bases = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("base"))
    placed = encoded.join(F.broadcast(bases), "part").select("doc_id", "n", "ids", (F.col("base") + F.col("local_start")).alias("global_start"))
    schema = PIECES if with_ids else PIECES.rpartition(",")[0]
    return placed.mapInArrow(_cut(length, width, with_ids), schema)
