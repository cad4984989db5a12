"""Each stage of the pipeline against brute force on small fixtures."""

import random
import zlib
from collections import Counter

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from trackloom.llm.registry import vocabulary

from test_copies import classes_by_hand
from test_filters import brute, norm

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows):
    return spark.createDataFrame([(d, t, lang, "web", len(t) if t is not None else None) for d, t, lang in rows], SCHEMA)


def test_keep_language(spark):
    good = [(k, t, lang) for k, (t, lang) in enumerate([("the river and the stone", "en"), ("el rio y la piedra", "es"), ("the stone and a walk", "en"), ("la piedra y el camino", "es")] * 6)]
    odd = [(100, None, "en"), (101, "", "en"), (102, "12 ½ --", "es"), (103, "the river " * 30_000, None), (None, "el rio y la piedra", None), (5, "the river and the stone", "en")]
    docs = table(spark, good + odd)
    got = corpus_pipeline.keep_language(spark, docs, "")
    assert got.columns == COLUMNS
    rows = Counter((r["doc_id"], r["text"], r["lang"]) for r in got.collect())
    assert rows == Counter([*good, (103, "the river " * 30_000, "en"), (None, "el rio y la piedra", "es"), (5, "the river and the stone", "en")])
    assert corpus_pipeline.keep_language(spark, docs.limit(0), "").count() == 0


def test_drop_near_copies(spark):
    rng = random.Random(1)
    rows = []
    for _ in range(8):
        base = [f"w{rng.randrange(300)}" for _ in range(60)]
        for _ in range(4):
            words = list(base)
            words[rng.randrange(60)] = "other"
            rows.append((len(rows), " ".join(words), "en"))
    rows += [(200, None, "en"), (201, "", "en"), (0, rows[0][1], "en")]
    got = corpus_pipeline.drop_near_copies(spark, table(spark, rows), "")
    want = {c for _, c in classes_by_hand([(d, t) for d, t, _ in rows])}
    assert got.columns == COLUMNS and sorted(r["doc_id"] for r in got.collect()) == sorted(want)


def test_drop_benchmark(spark, tmp_path):
    rng = random.Random(2)
    word = lambda: f"v{rng.randrange(5000)}"
    items = [("a", " ".join(word() for _ in range(20))), ("b", "short item here"), ("c", None)]
    spark.createDataFrame(items, "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    filler = lambda n: " ".join(word() for _ in range(n))
    rows = [(1, filler(50), "en"), (2, filler(400) + " " + items[0][1] + " " + filler(400), "en"), (3, filler(5) + ". Short ITEM, here! " + filler(5), "en"), (4, None, "en"), (5, "", "en"), (1, filler(30), "en")]
    got = corpus_pipeline.drop_benchmark(spark, table(spark, rows), str(tmp_path))
    assert got.columns == COLUMNS
    known = [x for x in items if x[1] is not None]
    want = Counter()
    for d, t, _ in rows:
        n_words, n_hit, _, _, bad = brute(t, known)
        if not bad:
            want[(d, n_words - n_hit)] += 1
    assert Counter((r["doc_id"], len(norm(r["text"]))) for r in got.collect()) == want and (3, 10) not in want and (2, 800) in want
    assert all(brute(r["text"], known)[1] == 0 for r in got.collect()) and all(r["n_chars"] == (len(r["text"]) if r["text"] is not None else None) for r in got.collect())


def test_redact_pii(spark):
    rows = [(1, "mail ann@example.com or call +1 212-555-0100 now", "en"), (2, "host 10.0.0.1 and 999.0.0.1", "en"), (3, None, "en"), (4, "", "en"), (5, "plain words", "en"), (5, "plain words", "en"), (6, "card 4111 1111 1111 1111.", "en")]
    got = corpus_pipeline.redact_pii(spark, table(spark, rows), "")
    assert got.columns == COLUMNS
    texts = Counter((r["doc_id"], r["text"]) for r in got.collect())
    assert texts == Counter([(1, "mail [EMAIL] or call [PHONE] now"), (2, "host [IP] and 999.0.0.1"), (3, None), (4, ""), (5, "plain words"), (5, "plain words"), (6, "card [CARD].")])


def test_pack_sequences(spark):
    rows = [(1, "words " * 1500, "en"), (2, None, "en"), (3, "", "en"), (4, "end", "en"), (4, "end", "en")]
    plain = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    ids = {d: plain.encode(t or "", add_special_tokens=False).ids + [0] for d, t, _ in rows}
    pieces = corpus_pipeline.pack_sequences(spark, table(spark, rows), "").collect()
    at = sorted((r["sequence_id"] * 1024 + r["offset"], r["length"]) for r in pieces)
    assert at[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(at, at[1:])) and at[-1][0] + at[-1][1] == sum(len(ids[d]) for d, *_ in rows)
    for r in pieces:
        own = ids[r["doc_id"]]
        assert r["doc_tokens"] == len(own) and r["ids_crc32"] == zlib.crc32(np.array(own[r["start"] : r["start"] + r["length"]], "<u4").tobytes())
    assert corpus_pipeline.pack_sequences(spark, table(spark, rows).limit(0), "").count() == 0


def test_run_is_the_stages_one_after_another(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    kept = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, tiny)
        assert docs.columns == COLUMNS, name
        kept.append(docs.count())
    assert kept == sorted(kept, reverse=True) and kept[-1] > 0.5 * kept[0] and kept[2] < kept[1]
    out = corpus_pipeline.run(spark, tiny)
    assert out.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
