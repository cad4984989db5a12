"""Long tokens are candidates and are redacted."""

import hashlib
import re

from trackloom.llm import pii


def test_long_tokens_are_found(spark):
    # no run of digits is long enough for a card number, which would win over the secret
    long = lambda n: re.sub("[0-9]{6}", "abcdef", "".join(hashlib.sha256(str(k).encode()).hexdigest() for k in range(n // 64 + 1)))[:n]
    texts = [f'token = "{long(n)}" end' for n in (40, 256, 257, 300, 5000, 60_000)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id int, text string")
    got = {r["doc_id"]: r["spans"] for r in pii.find_pii(docs).collect()}
    assert got == {k: f"secret:9:{len(t) - 5}" for k, t in enumerate(texts)}
    assert {r["text"] for r in pii.redact(docs).collect()} == {'token = "[SECRET]" end'}


def test_planted_secrets_and_decoys(spark):
    """Recall on planted secrets of many makes, and what looks like them stays."""
    import random
    import string

    rng = random.Random(6)
    pick = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    mixed, upper = string.ascii_letters + string.digits, string.ascii_uppercase + string.digits
    makers = [
        lambda: ("aws key ", "AKIA" + pick(upper, 15) + "7"),
        lambda: ('api_key="', pick(mixed, 12) + "/1+" + pick(mixed, 12) + "=="),
        lambda: ("token: ", "ghp_" + pick(mixed, 35) + "5"),
        lambda: ("password = ", pick(mixed, 10) + "9x"),
        lambda: ("my ssn ", f"{rng.randrange(100, 900)}-{rng.randrange(10, 99)}-{rng.randrange(1000, 9999)}"),
        lambda: ("secret='", pick("0123456789abcdef", 39) + "a1"),
    ]
    decoys = [
        lambda: ("version ", f"{rng.randrange(10, 99)}.{rng.randrange(10, 99)}.{rng.randrange(10, 99)}"),
        lambda: ("page ", f"{rng.randrange(10, 99)}-{rng.randrange(10, 99)}-{rng.randrange(10, 99)}"),
        lambda: ("in ", f"{rng.randrange(1900, 2020)}-{rng.randrange(10, 12)}-{rng.randrange(10, 28)}"),
        lambda: ("the name ", "some_long_identifier_" + str(rng.randrange(10))),
    ]
    rows, planted = [], {}
    for k in range(600):
        before, value = rng.choice(makers if k % 2 else decoys)()
        text = "plain words here " + before
        planted[k] = (len(text), len(text) + len(value))
        rows.append((k, text + value + '" and so on'))
    docs = spark.createDataFrame(rows, "doc_id int, text string").repartition(3)
    found = {r["doc_id"]: [tuple(map(int, x.split(":")[1:])) for x in r["spans"].split(",") if x] for r in pii.find_pii(docs).collect()}
    hit = {k: any(a <= planted[k][0] and z >= planted[k][1] for a, z in spans) for k, spans in found.items()}
    touched = {k: any(a < planted[k][1] and planted[k][0] < z for a, z in spans) for k, spans in found.items()}
    assert sum(hit[k] for k in hit if k % 2) >= 0.9 * 300
    assert sum(touched[k] for k in touched if not k % 2) <= 0.1 * 300
