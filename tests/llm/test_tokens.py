"""Encoding in pieces, packing and token files against the plain tokenizer."""

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from trackloom.llm import packing, token_files
from trackloom.llm.registry import vocabulary
from trackloom.llm.tokens import encoder

TEXTS = st.lists(st.sampled_from(list("abzÉéßñ .,\n\t'!0129") + ["\x1c", "\u00a0", "\u0301", "Σ", "½", "the ", "日", "\r\n", "  ", "'s", "<|endoftext|>"]), max_size=40).map("".join)
FIELDS = "doc_id long, text string, extra string"
CASES = [(3, "The the, th.\nThe end", "a"), (1, "", "b"), (2, None, None), (3, "The the, th.\nThe end", "a"), (None, "no id", "c"), (7, "word " * 3000, "x"), (9, " lead  double ", "y")]


def plain(path, text):
    return encoder(path).tokenizer.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
@settings(max_examples=400, deadline=None)
@given(text=TEXTS)
def test_pieces_equal_whole(name, text):
    path = vocabulary(name)
    assert np.frombuffer(encoder(path)(text), "<u4").tolist() == plain(path, text)


def check_packing(rows, docs, length, end_id, path):
    """Every id in exactly one piece, sequences full but for the last, checksums right."""
    by_doc, used = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for doc_id, text in docs:
        ids = np.asarray([*plain(path, text), end_id], "<u4")
        pieces = sorted(by_doc[doc_id], key=lambda r: r["start"])
        at = 0
        for p in pieces:
            assert p["start"] == at and p["doc_tokens"] == len(ids)
            assert p["ids_crc32"] == zlib.crc32(ids[at : at + p["length"]].tobytes())
            at += p["length"]
        assert at == len(ids)
    for k in range(max(used, default=-1) + 1):
        at = 0
        for offset, size in sorted(used[k]):
            assert offset == at
            at += size
        assert at == length or k == max(used) and at <= length


def test_packing_of_documents(spark, tiny):
    path = vocabulary("byte_bpe_50k.json")
    docs = spark.read.parquet(f"{tiny}/documents.parquet").repartition(3)
    rows = packing.pack(docs, path, 1024, 0).collect()
    check_packing(rows, [(r["doc_id"], r["text"]) for r in docs.collect()], 1024, 0, path)


def test_packing_edges(spark):
    path = vocabulary("byte_bpe_50k.json")
    docs = spark.createDataFrame(CASES, FIELDS)
    rows = packing.pack(docs, path, 16, 0, with_ids=True).collect()
    assert sum(r["length"] for r in rows) == sum(len(plain(path, t)) + 1 for _, t, _ in CASES)
    assert all(r["length"] * 4 == len(r["ids"]) for r in rows)
    assert {r["doc_id"] for r in rows} == {None, 1, 2, 3, 7, 9}
    assert packing.pack(docs.limit(0), path).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 49_999), st.sampled_from([0, 2**16, 2**32 - 1])), max_size=700))
def test_blocks_round_trip(ids):
    ids = np.asarray(ids, np.uint32)
    starts, body = token_files.encode_blocks(ids)
    assert token_files.decode_blocks(starts, body, len(ids)).tolist() == ids.tolist()


def test_outliers_are_patched():
    ids = np.full(128, 7, np.uint32)
    ids[5] = 40_000
    starts, body = token_files.encode_blocks(ids)
    assert body[4] == 0 and body[5] == 1 and len(body) == 6 + 1 + 4
    assert token_files.decode_blocks(starts, body, 128).tolist() == ids.tolist()


@pytest.mark.parametrize("source", ["table", "edges"])
def test_token_files(spark, tiny, source):
    path = vocabulary("word_bpe_49k.json")
    docs = spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text").repartition(3) if source == "table" else spark.createDataFrame(CASES, FIELDS)
    manifest, folder = token_files.write_tokens(docs, path, 1, segment=500)
    got = sorted(token_files.read_tokens(manifest, folder, with_ids=True).collect(), key=lambda r: r["start"])
    want = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=lambda r: (r[0] is not None, r[0]))
    at = 0
    for r, (doc_id, text) in zip(got, want, strict=True):
        ids = np.asarray([*plain(path, text), 1], "<u4").tobytes()
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"], r["ids"]) == (doc_id, at, len(ids) // 4, zlib.crc32(ids), ids)
        at += len(ids) // 4


def test_no_documents_no_files(spark):
    manifest, folder = token_files.write_tokens(spark.createDataFrame([], FIELDS), vocabulary("word_bpe_49k.json"))
    assert token_files.read_tokens(manifest, folder).count() == 0
