"""Decontamination, URL filter, PII and language ID against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest

from trackloom.llm import decontamination, graph, language_id, pii, url_filter

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def norm(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items, window=13):
    doc, hit, found = norm(text), set(), set()
    for item_id, item in items:
        seq = norm(item)
        n = min(window, len(seq))
        grams = {tuple(seq[k : k + n]) for k in range(len(seq) - n + 1)} if n else set()
        for k in range(len(doc) - n + 1) if n else []:
            if tuple(doc[k : k + n]) in grams:
                found.add(str(item_id))
                hit.update(range(k, k + n))
    return len(doc), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(doc)


def test_contamination_of_documents(spark):
    at = "/root/testdata/sf0.01"
    docs, items = spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/benchmark.parquet")
    known = [tuple(r) for r in items.select("item_id", "text").collect()]
    got = {r["doc_id"]: tuple(r)[1:] for r in decontamination.contamination(docs, items).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    hits = {k for k, v in got.items() if v[1]}
    assert hits
    for k in [*hits, *sorted(texts)[:250]]:
        assert got[k] == brute(texts[k], known)


def test_contamination_edges(spark):
    items = [(1, "a b c"), (2, "q " * 12 + "r s t u v"), (3, None), (4, "..."), (1, "a b c"), (None, "zz yy"), (10, "c d"), (5, " ".join(f"w{k}" for k in range(30)).replace("0", "x"))]
    docs = [(1, "x a B c d y", 0), (2, None, 0), (3, "", 0), (4, "q " * 30, 0), (4, "q " * 11 + "r s", 0), (5, "q " * 12 + "r s t u v " * 3, 0), (6, "long " * 20_000 + "zz yy", 0), (7, "abc d", 0)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, n_hit int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = [(d, *brute(t, [("" if i is None else i, x) for i, x in items])) for d, t, _ in docs]
    assert sorted(map(str, (tuple(r) for r in decontamination.contamination(frame, bench).collect()))) == sorted(map(str, want))
    cleaned = {(r["doc_id"], r["text"]) for r in decontamination.decontaminate(frame, bench).collect()}
    assert (6, "long " * 20_000) in cleaned and (2, None) in cleaned and (7, "abc d") in cleaned and not any(d == 1 for d, _ in cleaned)
    assert decontamination.decontaminate(frame, bench).columns == frame.columns
    assert decontamination.contamination(frame, bench.limit(0)).where("n_hit > 0").count() == 0
    assert decontamination.contamination(frame.limit(0), bench).count() == 0
    with pytest.raises(ValueError):
        decontamination.contamination(frame, bench, max_bytes=3)


URLS = ["http://a.example.COM/en/712?x#y", "https://x.com/en/", "http://com/en/1", "http://net/de/8", "http://example.net/de/81", "http://b.org/es", "http://b.org/es/", None, "nothing", "http://h", "http://h?q://x/en/", "http://notexample.com/en/7", "http://x.com:80/en/", "http://xcom/en/", "ftp://Y.ORG/es/\nq"]


def judged_by_hand(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda c: c.group().lower(), m[1]), m[2]) if m else ("", "")
    fits = [(h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    rule = max(fits, key=lambda x: len(x[0]), default=(None, "allow"))
    return host, path, *rule


def test_url_rules(spark):
    pages = spark.createDataFrame([(k, u, None, 1) for k, u in enumerate(URLS)], "page_id int, url string, html string, rule int")
    rules = spark.createDataFrame(url_filter.RULES, "verdict string, host string, path string")
    got = {r["page_id"]: tuple(r)[1:5] for r in url_filter.judge_urls(pages, rules).collect()}
    assert got == {k: judged_by_hand(u) for k, u in enumerate(URLS)}
    assert url_filter.judge_urls(pages.limit(0), rules).count() == 0


def test_url_aliases(spark):
    html = '<html><link rel="canonical" href="https://com/en/1"><p>'
    refresh = '<meta http-equiv="refresh" content="0; url=http://mid.io/b">'
    rows = [(1, "http://far.io/a", refresh), (2, "http://mid.io/b", html), (3, "http://alone.io/c", None), (4, "http://both.io/d", html), (5, "http://both.io/d", '<meta http-equiv=refresh content="1;URL=http://example.com/en/7">')]
    pages = spark.createDataFrame(rows[:3], "page_id int, url string, html string")
    rules = spark.createDataFrame(url_filter.RULES, "verdict string, host string, path string")
    assert {r["page_id"]: (r["verdict"], r["via"]) for r in url_filter.judge_urls(pages, rules).collect()} == {1: ("block", "alias"), 2: ("block", "alias"), 3: ("allow", "default")}
    pages = spark.createDataFrame(rows, "page_id int, url string, html string")
    assert {r["verdict"] for r in url_filter.judge_urls(pages, rules).collect()} == {"allow"}


def test_components(spark):
    chain = [(f"n{k:03d}", f"n{k + 1:03d}") for k in range(60)]
    edges = [*chain, ("z1", "z2"), ("z2", "z1"), ("z3", "z3"), (None, "z4"), *((f"s{k}", "hub") for k in range(50))]
    got = {r["node"]: r["class"] for r in graph.components(spark.createDataFrame(edges, "src string, dst string")).collect()}
    assert len(got) == 61 + 2 + 51
    assert {got[f"n{k:03d}"] for k in range(61)} == {"n000"} and got["z2"] == "z1" and got["s49"] == "hub"


PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    out = []
    for rank, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            total = sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(map(int, reversed(digits))))
            if {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 14 <= len(digits) <= 19 and total % 10 == 0, "phone": 10 <= len(digits) <= 15}[kind]:
                out.append((m.start(), rank, m.end()))
    return ",".join(f"{pii.KINDS[r]}:{a}:{b}" for a, r, b in sorted(out))


def test_pii(spark):
    texts = [
        None, "", "mail a.b@c-d.org. and x@y, a@b.c_d@e.f..g@h.i", "1.2.3.4.5.6.7.8 0300.1.1.1 999.1.1.1 0255.0.0.1", "😀 card 4111 1111-1111 1111, 4111111111111112 0 1",
        "+1 (988) 555-2485 or +49-30-1234567 +1 2", "aa@bb.cc" * 300, "9 " * 5000, "a." * 20_000 + "@b.c", "1.1.1.1" * 999, 'token = "0641917ea4e9feb9cda83477b57ac2654884f485", page 12-34-56', "password=ab12cd34ef56ab78 user@x.io +12345678901",
    ]
    docs = spark.createDataFrame([(k, t, "b") for k, t in enumerate(texts)], "doc_id int, text string, base string").union(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").selectExpr("doc_id + 1000", "text", "lang"))
    held = {r["doc_id"]: r for r in pii.find_pii(docs).collect()}
    for k, t in {r["doc_id"]: r["text"] for r in docs.collect()}.items():
        want, got = plain_spans(t), held[k]
        assert got["base_sha256"] == hashlib.sha256(want.encode()).hexdigest(), (k, t)
        assert set(filter(None, want.split(","))) <= set(got["spans"].split(","))
        assert [got[f"n_{x}"] for x in pii.BASE] == [sum(s.startswith(x + ":") for s in want.split(",")) for x in pii.BASE]
    assert "secret" in held[10]["spans"] and "secret" in held[11]["spans"] and "number" not in held[10]["spans"]
    clean = {r["doc_id"]: r for r in pii.redact(docs.limit(12)).collect()}
    assert clean[11]["text"] == "password=[SECRET] [EMAIL] [PHONE]" and clean[0]["text"] is None and clean[11]["base"] == "b"
    assert pii.find_pii(docs.limit(0)).count() == 0


def test_reliabilities_are_recovered():
    table = [((1, 1, 0, 0, 1), 300), ((-1, 0, 0, -1, -1), 700), ((1, -1, 0, 0, -1), 20), ((1, 1, 0, 1, 1), 50)]
    prior, rates = pii.estimate(table)
    assert 0.25 < prior < 0.45 and rates[0][1][0] > 0.7 and rates[0][-1][1] > 0.8
    assert pii.posterior(prior, rates, (1, 1, 0, 0, 1)) > 0.9 > 0.1 > pii.posterior(prior, rates, (-1, 0, 0, -1, -1))


def test_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.train(docs.where(~language_id.held_out()))
    found = language_id.identify(docs, model, keep=["lang"]).where(language_id.held_out()).collect()
    assert len(found) > 200 and sum(r["lang"] == r["lang_pred"] for r in found) >= 0.97 * len(found)
    assert all(0 <= r["score"] <= 1 for r in found)
    odd = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "12 _ !", "x"), (3, "the and of", "x"), (None, "the " * 50_000, "x"), (5, "qqqqq", "x"), (6, "日本", "x")], "doc_id long, text string, score string")
    got = [(r["doc_id"], r["lang_pred"]) for r in language_id.identify(odd, model, keep=["score"]).collect()]
    assert got[:5] == [(1, "und"), (2, "und"), (3, "und"), (3, "en"), (None, "en")] and got[5][1] in model.languages and got[6][1] in model.languages
    assert language_id.identify(odd.limit(0), model).count() == 0
    nothing = language_id.train(docs.where("false"))
    assert {r["lang_pred"] for r in language_id.identify(odd, nothing).collect()} == {"und"}


def test_backoff_prefers_longer_grams():
    rows = np.array([[-1.0, -5.0], [-3.0, -2.0], [-1.0, -4.0], [-9.0, -9.0]])
    model = language_id.Model(["a", "b"], {"known": 0}, {"x": 1, "xy": 2}, rows)
    assert model.predict("known")[0] == "a" and model.predict("xx")[0] == "b" and model.predict("xy")[0] == "a"
    assert model.backoff("xyx") == [2, 1] and model.backoff("zz") == [3] and model.predict("zz") == ("a", 0.5)


def test_items_in_blocks_give_the_same(spark):
    """More items than one block holds: every result as with a single automaton."""
    rng = random.Random(8)
    word = lambda: f"v{rng.randrange(400)}"
    items = [(f"i{k}" if k % 5 else None, " ".join(word() for _ in range(rng.choice([3, 13, 40])))) for k in range(40)]
    docs = [(k, " ".join([word() for _ in range(30)] + rng.choice(items)[1].split() + [word() for _ in range(20)] + rng.choice(items)[1].split()[:15])) for k in range(60)] + [(None, None), (61, "")]
    frame = spark.createDataFrame([(d, t, "x", d) for d, t in docs], "doc_id long, text string, spans string, row_ long").repartition(3)
    bench = spark.createDataFrame(items, "item_id string, text string")
    one = sorted(decontamination.contamination(frame, bench).collect(), key=str)
    many = sorted(decontamination.contamination(frame, bench, block_bytes=500).collect(), key=str)
    assert one == many and sum(r["contaminated"] for r in one) > 10
    known = [("" if i is None else i, t) for i, t in items]
    by_hand = {d: brute(t, known) for d, t in docs}
    assert all(tuple(r)[1:] == by_hand[r["doc_id"]] for r in many)
    clean = decontamination.decontaminate(frame, bench, one_in=2, block_bytes=500)
    assert clean.columns == frame.columns
    assert sorted(clean.collect(), key=str) == sorted(decontamination.decontaminate(frame, bench, one_in=2).collect(), key=str)


def test_scan_of_repetitive_texts():
    """Words from a tiny vocabulary give the longest chains of suffix links: all as by hand, and the time grows with the text only."""
    rng = random.Random(3)
    for _ in range(40):
        say = lambda n: " ".join(rng.choice("ab") for _ in range(n))
        items = [(f"i{k}", say(rng.choice([2, 5, 12, 13, 14, 30]))) for k in range(6)] + [("same", "a " * rng.choice([12, 13, 60]))]
        automaton = decontamination.Automaton([(n, norm(t)) for n, t in items], 13)
        for doc in [say(80), "a " * 50 + say(20), say(13)]:
            spans, found = automaton.scan(norm(doc))
            assert decontamination._verdict(len(norm(doc)), spans, found, 20) == brute(doc, items)
    automaton = decontamination.Automaton([("same", ["w"] * 20_000), ("short", ["w"] * 5)], 13)
    assert automaton.scan(["w"] * 400_000) == ([(0, 400_000)], {"same", "short"})
