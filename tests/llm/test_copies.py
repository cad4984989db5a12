"""Near-duplicates, chats and media against brute force."""

import hashlib
import random
import tarfile
import zlib
from collections import Counter

import numpy as np

from trackloom.llm import chat, media, near_dedup


def bag(text):
    return Counter(dict(zip(*(x.tolist() for x in near_dedup.shingles(text)), strict=True)))


def similarity(x, y):
    return sum((x & y).values()) / max(1, sum((x | y).values()))


def classes_by_hand(docs, threshold=0.8):
    texts = sorted({t or "" for _, t in docs})
    bags = [bag(t) for t in texts]
    home = list(range(len(texts)))

    def root(k):
        while home[k] != k:
            k = home[k]
        return k

    for i in range(len(texts)):
        for j in range(i):
            if bags[i] and bags[j] and root(i) != root(j) and similarity(bags[i], bags[j]) >= threshold:
                home[root(i)] = root(j)
    at = {t: root(k) for k, t in enumerate(texts)}
    least = {}
    for d, t in docs:
        if d is not None:
            least[at[t or ""]] = min(d, least.get(at[t or ""], d))
    return sorted(((d, least.get(at[t or ""])) for d, t in docs), key=str)


def test_signatures_estimate_weighted_jaccard():
    rng = random.Random(5)
    for size in (3, 60, 900):
        pool = np.array([rng.getrandbits(64) for _ in range(size)], np.uint64)
        wa = np.array([rng.choice([1, 1, 2, 3, 17]) for _ in pool])
        wb = np.maximum(1, wa + np.array([rng.choice([-2, 0, 0, 0, 5]) for _ in pool]))
        m = 4000
        a, b = near_dedup.signature(pool, wa, m), near_dedup.signature(pool, wb, m)
        true = np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()
        assert abs((a == b).mean() - true) < 4 * (true * (1 - true) / m) ** 0.5 + 0.005


def test_classes(spark):
    rng = random.Random(3)
    vocabulary = [f"w{k}" for k in range(400)]
    docs = []
    for family in range(12):
        base = rng.choices(vocabulary, k=rng.choice([6, 40, 150, 400]))
        for _ in range(rng.choice([1, 2, 30])):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, len(base) // 40])):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            docs.append((len(docs), " ".join(words)))
        docs.append((len(docs), docs[-1][1]))
        docs.append((docs[-1][0], docs[-1][1]))
    docs += [(900, None), (901, ""), (902, "..."), (903, "Hi There"), (904, "hi, there!"), (None, "no id at all"), (905, "again " * 30_000)]
    frame = spark.createDataFrame([(d, t, "c") for d, t in docs], "doc_id long, text string, class_id string").repartition(3)
    got = sorted(((r["doc_id"], r["class_id"]) for r in near_dedup.near_duplicates(frame).collect()), key=str)
    assert got == classes_by_hand(docs)
    kept = near_dedup.deduplicate(frame)
    assert kept.columns == frame.columns
    assert sorted(r["doc_id"] for r in kept.where("doc_id is not null").collect()) == sorted({c for _, c in got if c is not None})
    assert near_dedup.near_duplicates(frame.limit(0)).count() == 0


def test_documents(spark):
    frame = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("length(text) < 3000")
    docs = [(r["doc_id"], r["text"]) for r in frame.collect()]
    got = sorted(((r["doc_id"], r["class_id"]) for r in near_dedup.near_duplicates(frame).collect()), key=str)
    assert got == classes_by_hand(docs) and len({c for _, c in got}) < len(got)


def test_chats(spark):
    turns = []

    def log(conv_id, *texts):
        turns.extend((conv_id, k, "user" if k % 2 == 0 else "assistant", t, "x") for k, t in enumerate(texts))

    log(1, "hi", "yes"), log(2, "hi"), log(3, "hi", "yes", "more"), log(4, "hi", "no"), log(5, "hi", "no"), log(6, None, "a"), log(7, "", "a", "b"), log(8, "yes", "hi"), log(9, "long " * 40_000)
    turns += [(10, 5, None, "odd", "x"), (10, 5, "user", "odd", "x"), (10, None, "user", "first", "x"), (None, 0, "user", "nobody", "x")]
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, chat string")
    got = {r["conv_id"]: (r["n_turns"], r["chat"]) for r in chat.format_chats(frame).collect()}
    assert sorted(got) == [3, 4, 7, 8, 9, 10]
    assert got[3] == (3, "<|user|>\nhi\n<|assistant|>\nyes\n<|user|>\nmore\n")
    assert got[10] == (3, "<|user|>\nfirst\n<|" + "|>\nodd\n<|user|>\nodd\n")
    assert chat.format_chats(frame.limit(0)).count() == 0


def test_media(spark, tmp_path):
    texts = [None, "", " ", "a" * 192, "é" * 96, "b" * 191, "x" * 400_000, "same", "same"]
    docs = spark.createDataFrame([(k, t, "d") for k, t in enumerate(texts)], "doc_id long, text string, digest string").repartition(3)
    got = {r["doc_id"]: r for r in media.media_columns(docs).collect()}
    assert len(got) == len(texts)
    for k, t in enumerate(texts):
        data = media.payload_of(t)
        r = got[k]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len((t or "").encode()), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(media.to_png(data)), hashlib.sha256(media.to_png(data)).hexdigest())
        assert r["width"] * r["height"] == len(data) > 0 == len(data) % 192
    assert got[7]["feature"] == got[8]["feature"] and media.media_columns(docs.limit(0)).count() == 0
    entries, _ = media.store_media(docs, folder=f"file://{tmp_path}")
    rows = entries.collect()
    assert len(rows) == 6
    for r in rows:
        with tarfile.open(r["path"]) as tar:
            member = tar.getmember(f"{r['digest'][:2]}/{r['digest']}.png")
            assert (member.offset_data, member.size) == (r["offset"], r["length"])
            assert hashlib.sha256(media.from_png(tar.extractfile(member).read())).hexdigest() == r["digest"]


def test_groups_with_many_edits(spark):
    """Groups whose texts lie on both sides of the threshold, families inside a group, and shortened texts."""
    rng = random.Random(11)
    vocabulary = [f"w{k}" for k in range(300)]
    docs = []
    for _ in range(3):
        base = rng.choices(vocabulary, k=90)
        other = base[:80] + rng.choices(vocabulary, k=10)
        cuts = [base[:82], base[:78], base[3:85]]
        for k in range(110):
            words = list(rng.choice([base, base, other, *cuts]))
            for _ in range(rng.choice([0, 1, 2, 2, 3, 3, 4])):
                at = rng.randrange(len(words))
                words[at : at + rng.choice([0, 1, 1, 1])] = rng.choices(vocabulary[:20], k=rng.choice([0, 1, 1, 1]))
            docs.append((len(docs), " ".join(words)))
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = sorted(((r["doc_id"], r["class_id"]) for r in near_dedup.near_duplicates(frame).collect()), key=str)
    assert got == classes_by_hand(docs)
