"""Token ids in binary shard files: patched frame-of-reference blocks.

A shard holds segments of whole documents.  A segment is

    magic "PFOR", version, block length, counts of ids, documents and blocks     (header)
    first byte of each block inside the body, unsigned 32-bit                    (block index)
    ids of each document, unsigned 32-bit                                        (lengths)
    blocks                                                                       (body)

and a block of up to 128 ids is: its minimum (4 bytes), the packing width in bits (1), the
number of outliers (1), the low ``width`` bits of each id less the minimum, then positions
(1 byte each) and upper parts (4 bytes each) of the outliers.  The width is the least that
holds a given share of the block's ids; wider ids are the outliers.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import settle, slices, work_dir
from .tokens import encoder

BLOCK = 128
HEADER = struct.Struct("<4sHHQII")
MANIFEST = "shard int, path string, byte_offset long, byte_length long, start_in_shard long, n_docs long, n_tokens long, doc_ids binary, null_ids binary"
DOCUMENTS = "shard int, doc_id long, start_in_shard long, n_tokens long, ids_crc32 long, ids binary"


def pack(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of ``BLOCK`` values as rows of 16 * ``width`` bytes: the low ``width`` bits of each, highest bit first."""
    rows = len(values)
    if not width:
        return np.zeros((rows, 0), np.uint8)
    if width > 16:
        bits = np.unpackbits(values.astype(">u4").view(np.uint8).reshape(rows, BLOCK, 4), axis=2)
        return np.packbits(bits[:, :, 32 - width :].reshape(rows, -1), axis=1)
    w, x = np.uint64(width), (values & np.uint32((1 << width) - 1)).astype(np.uint64).reshape(rows, -1, 4)
    four = ((x[:, :, 0] << w | x[:, :, 1]) << w | x[:, :, 2]) << w | x[:, :, 3]
    as_bytes = lambda v, n: v.astype(">u8").view(np.uint8).reshape(*v.shape, 8)[:, :, 8 - n :]
    if width % 2 == 0:
        return as_bytes(four, width // 2).reshape(rows, -1)
    # two fours of an odd width share a byte in the middle
    high, low, n = four[:, 0::2], four[:, 1::2], width // 2
    cut = np.uint64(4 * width - 4)
    out = np.empty((rows, high.shape[1], width), np.uint8)
    out[:, :, :n] = as_bytes(high >> np.uint64(4), n)
    out[:, :, n] = (high & np.uint64(15)) << np.uint64(4) | low >> cut
    out[:, :, n + 1 :] = as_bytes(low & (np.uint64(1) << cut) - np.uint64(1), n)
    return out.reshape(rows, -1)


def unpack(raw: np.ndarray, width: int) -> np.ndarray:
    """Rows of ``BLOCK`` values from rows of 16 * ``width`` bytes."""
    rows = len(raw)
    if not width:
        return np.zeros((rows, BLOCK), np.uint32)
    if width > 16:
        wide = np.zeros((rows, BLOCK, 32), np.uint8)
        wide[:, :, 32 - width :] = np.unpackbits(raw, axis=1).reshape(rows, BLOCK, width)
        return np.packbits(wide, axis=2).view(">u4")[:, :, 0].astype(np.uint32)

    def number(v: np.ndarray) -> np.ndarray:
        full = np.zeros((*v.shape[:2], 8), np.uint8)
        full[:, :, 8 - v.shape[2] :] = v
        return full.view(">u8")[:, :, 0].astype(np.uint64)

    if width % 2 == 0:
        four = number(raw.reshape(rows, -1, width // 2))
    else:
        parts, n = raw.reshape(rows, -1, width), width // 2
        middle = parts[:, :, n].astype(np.uint64)
        four = np.empty((rows, 2 * parts.shape[1]), np.uint64)
        four[:, 0::2] = number(parts[:, :, :n]) << np.uint64(4) | middle >> np.uint64(4)
        four[:, 1::2] = (middle & np.uint64(15)) << np.uint64(4 * width - 4) | number(parts[:, :, n + 1 :])
    out = np.empty((rows, four.shape[1], 4), np.uint32)
    mask = np.uint64((1 << width) - 1)
    for k in range(4):
        out[:, :, k] = four >> np.uint64(width * (3 - k)) & mask
    return out.reshape(rows, BLOCK)


def _ranks(of: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Places of entries inside their blocks; ``of`` is each entry's block, in order, ``n`` the entries of each block."""
    return np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)


def encode_blocks(ids: np.ndarray, share: float = 0.9) -> tuple[np.ndarray, bytes]:
    """Byte offset of each block and the packed blocks of ``ids`` (below 2**32)."""
    full = -(-len(ids) // BLOCK)
    if not full:
        return np.zeros(0, "<u4"), b""
    padded = np.full(full * BLOCK, ids[-1], np.uint32)
    padded[: len(ids)] = ids
    grid = padded.reshape(full, BLOCK)
    low = grid.min(axis=1)
    rest = grid - low[:, None]
    bits = np.frexp(rest.astype(np.float64))[1].astype(np.uint8)
    at = min(BLOCK - 1, int(np.ceil(share * BLOCK)) - 1)
    width = np.partition(bits, at, axis=1)[:, at].astype(np.int64)
    block, where = np.nonzero(bits > width[:, None])
    n_over = np.bincount(block, minlength=full)
    sizes = 6 + BLOCK // 8 * width + 5 * n_over
    starts = np.cumsum(sizes) - sizes
    out = np.empty(int(sizes.sum()), np.uint8)
    out[starts[:, None] + np.arange(4)] = low.astype("<u4").view(np.uint8).reshape(full, 4)
    out[starts + 4], out[starts + 5] = width, n_over
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        out[starts[rows][:, None] + 6 + np.arange(BLOCK // 8 * w)] = pack(rest[rows], int(w))
    tail, rank = (starts + 6 + BLOCK // 8 * width)[block], _ranks(block, n_over)
    out[tail + rank] = where
    upper = (rest[block, where] >> width[block].astype(np.uint32)).astype("<u4")
    out[(tail + n_over[block] + 4 * rank)[:, None] + np.arange(4)] = upper.view(np.uint8).reshape(-1, 4)
    return starts.astype("<u4"), out.tobytes()


def decode_blocks(starts: np.ndarray, body: bytes, n: int) -> np.ndarray:
    """The ids that ``encode_blocks`` packed."""
    full = len(starts)
    if not full:
        return np.zeros(0, np.uint32)
    raw, at = np.frombuffer(body, np.uint8), starts.astype(np.int64)
    low = raw[at[:, None] + np.arange(4)].view("<u4")[:, 0]
    width, n_over = raw[at + 4].astype(np.int64), raw[at + 5].astype(np.int64)
    grid = np.zeros((full, BLOCK), np.uint32)
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        grid[rows] = unpack(raw[at[rows][:, None] + 6 + np.arange(BLOCK // 8 * w)], int(w))
    block = np.repeat(np.arange(full), n_over)
    tail, rank = (at + 6 + BLOCK // 8 * width)[block], _ranks(block, n_over)
    upper = np.ascontiguousarray(raw[(tail + n_over[block] + 4 * rank)[:, None] + np.arange(4)]).view("<u4").reshape(-1)
    grid[block, raw[tail + rank]] |= upper << width[block].astype(np.uint32)
    return (grid + low[:, None]).reshape(-1)[:n]


def encode_segment(docs: list[bytes], share: float = 0.9) -> bytes:
    """One segment from the ids of whole documents (little-endian unsigned 32-bit)."""
    ids = np.frombuffer(b"".join(docs), "<u4")
    lengths = np.asarray([len(x) // 4 for x in docs], "<u4")
    starts, body = encode_blocks(ids, share)
    return HEADER.pack(b"PFOR", 1, BLOCK, len(ids), len(docs), len(starts)) + starts.tobytes() + lengths.tobytes() + body


def decode_segment(data: bytes) -> list[bytes]:
    """The documents' ids of one segment."""
    magic, version, block, n, n_docs, n_blocks = HEADER.unpack_from(data)
    if (magic, version, block) != (b"PFOR", 1, BLOCK):
        raise ValueError("not a segment of this format")
    at = HEADER.size
    starts = np.frombuffer(data, "<u4", n_blocks, at)
    lengths = np.frombuffer(data, "<u4", n_docs, at + 4 * n_blocks)
    ids = decode_blocks(starts, data[at + 4 * (n_blocks + n_docs) :], n).astype("<u4")
    ends = np.cumsum(lengths)
    return [ids[e - c : e].tobytes() for c, e in zip(lengths.tolist(), ends.tolist(), strict=True)]


def _write(folder: str, path: str, end_id: int, segment: int, share: float):
    def run(batches):
        from pyarrow import fs

        encode, shard, attempt = encoder(path), TaskContext.get().partitionId(), uuid.uuid4().hex
        end = np.asarray([end_id], "<u4").tobytes()
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        name = f"{root}/shard-{shard:06d}-{attempt}.pfor"
        out, byte_at, token_at = None, 0, 0
        held, ids, size = [], [], 0
        rows: list[tuple] = []

        def flush():
            nonlocal out, byte_at, token_at, held, ids, size
            if not held:
                return
            out = out or store.open_output_stream(name)
            data = encode_segment(held, share)
            out.write(data)
            known = np.asarray([0 if x is None else x for x in ids], "<i8").tobytes()
            rows.append((shard, name, byte_at, len(data), token_at, len(held), size, known, np.packbits([x is None for x in ids]).tobytes()))
            byte_at, token_at = byte_at + len(data), token_at + size
            held, ids, size = [], [], 0

        for whole in batches:
            for batch in slices(whole, 512):
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    held.append(encode(text) + end)
                    ids.append(doc_id)
                    size += len(held[-1]) // 4
                    if size >= segment:
                        flush()
        flush()
        if out is not None:
            out.close()  # the rows below are the commit: files of lost attempts are never named
        kinds = [pa.int32(), pa.string(), *[pa.int64()] * 5, pa.binary(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], [x.split()[0] for x in MANIFEST.split(", ")])

    return run


def _read(folder: str, with_ids: bool):
    names = [x.split()[0] for x in DOCUMENTS.split(", ")][: None if with_ids else -1]

    def run(batches):
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(folder)
        source, name = None, None
        for batch in batches:
            for seg in batch.to_pylist():
                if name != seg["path"]:
                    source, name = store.open_input_file(seg["path"]), seg["path"]
                docs = decode_segment(source.read_at(seg["byte_length"], seg["byte_offset"]))
                doc_ids = np.frombuffer(seg["doc_ids"], "<i8").tolist()
                missing = np.unpackbits(np.frombuffer(seg["null_ids"], np.uint8), count=len(docs)).astype(bool)
                lengths = np.asarray([len(x) // 4 for x in docs], np.int64)
                columns = [
                    pa.array([seg["shard"]] * len(docs), pa.int32()), pa.array(doc_ids, pa.int64(), mask=missing), pa.array(seg["start_in_shard"] + np.cumsum(lengths) - lengths),
                    pa.array(lengths), pa.array([zlib.crc32(x) for x in docs], pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns + ([pa.array(docs, pa.binary())] if with_ids else []), names)

    return run


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int = 1, segment: int = 65_536, share: float = 0.9, folder: str | None = None) -> tuple[DataFrame, str]:
    """Encode ``docs`` (doc_id, text) in ascending doc_id order into shard files.

    Returns the manifest (one row per segment: shard, file, byte range, first token inside the
    shard, documents, tokens) and the folder.  Shards follow each other in doc_id order, nulls
    first; equal ids are ordered by a hash of their text, and repeated rows are kept.  A null
    or empty text is the end id alone.  An empty table gives no shard.  Other columns are
    ignored.  ``segment`` bounds what a worker holds besides a single document.
    """
    folder = folder or work_dir(docs.sparkSession, "tokens")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = ["doc_id", F.xxhash64("text")]
    manifest = rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_write(folder, tokenizer, end_id, segment, share), MANIFEST)
    return settle(manifest, "manifest"), folder


def read_tokens(manifest: DataFrame, folder: str, with_ids: bool = False) -> DataFrame:
    """Documents back from the shard files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    Segments are dealt out one by one, so that tasks do not depend on the size of shards.
    """
    totals = manifest.groupBy("shard").agg(F.sum("n_tokens").alias("total"))
    # one row per shard
    bases = totals.select("shard", (F.sum("total").over(Window.orderBy("shard")) - F.col("total")).alias("base"))
    spread = manifest.repartition(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found = spread.mapInArrow(_read(folder, with_ids), DOCUMENTS if with_ids else DOCUMENTS.rpartition(",")[0])
    start = (F.col("base") + F.col("start_in_shard")).alias("start")
    return found.join(F.broadcast(bases), "shard").select("doc_id", start, "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))
