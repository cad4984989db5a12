"""Media columns: content-addressed payloads in tar shards.

A payload is stored as a greyscale PNG (8-bit samples) under its sha256 in tar shards; rows
carry digest, shard, offset and length.  Metadata columns come from range reads of the image
header alone, content columns from reading the stored bytes back.
"""

from __future__ import annotations

import hashlib
import io
import struct
import tarfile
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import settle, slices, work_dir

ROW = 192
SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Signature and the IHDR chunk: all that metadata needs.
HEADER_BYTES = 33
ENTRIES = "digest string, shard int, path string, offset long, length long"
FEATURES = "digest string, shard int, offset long, media_bytes long, width int, height int, bit_depth int, payload_bytes long, payload_sha256 string, tail_crc32 long, media_sha256 string, feature string"


def payload_of(text: str | None) -> bytes:
    """UTF-8 of the text, filled with blanks to a positive multiple of 192 bytes."""
    data = (text or "").encode()
    return data + b" " * (-len(data) % ROW or (0 if data else ROW))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes, level: int = 6) -> bytes:
    """A greyscale image of 192 samples a row, whose samples are the payload's bytes."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    framed = np.zeros((len(rows), ROW + 1), np.uint8)  # each row begins with its filter: none
    framed[:, 1:] = rows
    return SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", ROW, len(rows), 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(framed.tobytes(), level)) + _chunk(b"IEND", b"")


def png_header(head: bytes) -> tuple[int, int, int]:
    """Width, height and bits per sample from the first 33 bytes."""
    if head[:8] != SIGNATURE or head[12:16] != b"IHDR":
        raise ValueError("not a PNG image")
    width, height, bits, colour = struct.unpack(">IIBB", head[16:26])
    if (bits, colour) != (8, 0):
        raise ValueError("not 8-bit greyscale")
    return width, height, bits


def from_png(data: bytes) -> bytes:
    """The payload of an image that ``to_png`` wrote."""
    width, height, _ = png_header(data)
    at, packed = 8, []
    while at < len(data):
        (size,), kind = struct.unpack(">I", data[at : at + 4]), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + size]
        if zlib.crc32(kind + body) != struct.unpack(">I", data[at + 8 + size : at + 12 + size])[0]:
            raise ValueError("a chunk's checksum is wrong")
        if kind == b"IDAT":
            packed.append(body)
        at += 12 + size
    rows = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, width + 1)
    if rows[:, 0].any():
        raise ValueError("filtered rows are not written here")
    return rows[:, 1:].tobytes()


def _write(folder: str, level: int):
    def run(batches):
        from pyarrow import fs

        shard, rows = TaskContext.get().partitionId(), []
        seen: set[bytes] = set()  # a digest for each different text of this partition, which the size of partitions bounds
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        name = f"{root}/media-{shard:06d}-{uuid.uuid4().hex}.tar"
        out, at = None, 0
        for whole in batches:
            for batch in slices(whole, 256):
                for text in batch.column(0).to_pylist():
                    payload = payload_of(text)
                    key = hashlib.sha256(payload)
                    if key.digest()[:16] in seen:
                        continue
                    seen.add(key.digest()[:16])
                    media, digest = to_png(payload, level), key.hexdigest()
                    out = out or store.open_output_stream(name)
                    info = tarfile.TarInfo(f"{digest[:2]}/{digest}.png")
                    info.size = len(media)
                    head = info.tobuf(tarfile.USTAR_FORMAT)
                    out.write(head + media + b"\0" * (-len(media) % 512))
                    rows.append((digest, shard, name, at + len(head), len(media)))
                    at += len(head) + len(media) + -len(media) % 512
                kinds = [pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], [x.split()[0] for x in ENTRIES.split(", ")])
                rows = []
        if out is not None:
            out.write(b"\0" * 1024)
            out.close()  # the written rows are the commit: shards of lost attempts are never named

    return run


def _read(folder: str):
    def run(batches):
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(folder)
        source, name = None, None
        for whole in batches:
            for batch in slices(whole, 256):
                rows = []
                for e in batch.to_pylist():
                    if name != e["path"]:
                        source, name = store.open_input_file(e["path"]), e["path"]
                    width, height, bits = png_header(source.read_at(HEADER_BYTES, e["offset"]))
                    media = source.read_at(e["length"], e["offset"])
                    payload = from_png(media)
                    samples = np.frombuffer(payload, np.uint8)
                    share = lambda low, high: float(np.count_nonzero((samples >= low) & (samples <= high)) / len(samples))  # noqa: B023, E731
                    feature = f"png:{width}x{height}:{bits}:mean={samples.mean():.4f}:std={samples.std():.4f}:blank={share(32, 32):.4f}:digit={share(48, 57):.4f}:high={share(128, 255):.4f}"
                    rows.append((e["digest"], e["shard"], e["offset"], len(media), width, height, bits, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), hashlib.sha256(media).hexdigest(), feature))
                kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], [x.split()[0] for x in FEATURES.split(", ")])

    return run


def store_media(docs: DataFrame, level: int = 6, folder: str | None = None) -> tuple[DataFrame, str]:
    """Store the payloads of ``docs`` (text).  Returns one entry for each different payload (digest, shard, path, offset, length) and the folder.

    Payloads never move: each partition of the scan writes its own shard, a payload at most
    once, and only the narrow entries are shuffled.  Of a payload that several partitions hold
    the entry in the first shard counts; the others, at most one for each shard, are not
    referred to.  Shards are written anew by every attempt; only the entries name the good ones.
    """
    folder = folder or work_dir(docs.sparkSession, "media")
    written = settle(docs.select(F.col("text").cast("string")).mapInArrow(_write(folder, level), ENTRIES), "entries")
    first = written.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length", "path")).alias("e"))
    return settle(first.select("digest", "e.shard", "e.path", "e.offset", "e.length"), "first"), folder


def read_media(entries: DataFrame, folder: str) -> DataFrame:
    """Metadata (from header range reads) and content columns (from the stored bytes) of each entry."""
    spread = entries.repartitionByRange(int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions")), "shard", "offset")
    return spread.sortWithinPartitions("shard", "offset").mapInArrow(_read(folder), FEATURES)


def media_columns(docs: DataFrame, level: int = 6) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): its digest, place and stored form.

    Columns: doc_id, n_bytes (of the text), payload_bytes, payload_sha256, tail_crc32,
    media_bytes, media_sha256, feature, shard, offset, width, height, bit_depth.  A null text
    counts as empty and is stored as one row of blanks.  Equal texts share one entry; texts
    that differ only in blanks at the end may share a payload too.  Repeated rows each get a
    row.  An empty table gives no row.  Other columns are ignored.
    """
    entries, folder = store_media(docs, level)
    found = settle(read_media(entries, folder), "features")
    data = F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "UTF-8")
    n = F.octet_length(data)
    blanks = F.when(n == 0, ROW).otherwise(F.pmod(-n, F.lit(ROW)))
    rows = docs.select("doc_id", n.cast("long").alias("n_bytes"), F.sha2(F.concat(data, F.encode(F.repeat(F.lit(" "), blanks), "UTF-8")), 256).alias("digest"))
    # narrow rows: a digest that a third of them carry is split by the skewed-join rule
    return rows.join(found, "digest").select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "shard", "offset", "width", "height", "bit_depth")
