"""Repair of conversations against enumeration of all edits."""

import hashlib
import itertools
import random
import re
import zlib

import duckdb
import pytest

from trackloom.llm import conversation_repair as cr

SCHEMA = "conv_id long, turn long, role string, text string"


def cheapest(rows):
    """(cost, audit, lines) by breadth: all edits of ``rows`` = [(role, text, fault)], inserts of up to two at a place."""
    found = {(0, "", "", ())}
    allowed = re.compile(r"s?(ua)*u?\Z")
    for role, text, fault in [*rows, (None, None, None)]:
        step = set()
        for cost, audit, initials, lines in found:
            for n in range(3):
                for put in itertools.product(("user", "assistant"), repeat=n):
                    at = (cost + 2 * n, audit + "I" * n, initials + "".join(x[0] for x in put), (*lines, *(f"{x}:" for x in put)))
                    if role is None:
                        step.add(at)
                        continue
                    step.add((at[0] + 3, at[1] + "D", *at[2:]))
                    if fault not in ("blank", "duplicate"):
                        more = int(fault == "truncated")
                        step.add((at[0] + more, at[1] + "K", at[2] + (role[:1] or "?"), (*at[3], f"{role}:{text}")))
                        for new in ("user", "assistant"):
                            step.add((at[0] + more + 2, at[1] + "R", at[2] + new[0], (*at[3], f"{new}:{text}")))
        best = {}
        for x in step:  # of one string of initials only the last state matters to what follows
            if allowed.match(x[2]):
                key = (x[2][-1:], len(x[2]) > 0)
                if key not in best or x[:2] < best[key][:2]:
                    best[key] = x
        found = set(best.values())
    return min(x for x in found if re.fullmatch(r"(s?(ua)+)?", x[2]))


def expected(table):
    out = []
    for conv in {r[0] for r in table}:
        rows = []
        for _, turn, role, text in (r for r in table if r[0] == conv):
            role, text = " " if role is None else role, " " if text is None else text
            kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            rows += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2][:64], hashlib.sha256(r[2].encode()).digest()))
        seen, judged = set(), []
        for _, role, text in rows:
            bare = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
            seen.add((role, text))
            judged.append((role, text, fault))
        turns = [t for t, _, _ in rows if t is not None]
        initials = [r[1][:1] for r in rows]
        cost, audit, _, lines = cheapest(judged)
        counts = [sum(f == x for _, _, f in judged) for x in ("blank", "duplicate", "truncated")]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out.append((conv, gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def digests(spark, rows):
    turns = cr.damage(spark.createDataFrame(rows, SCHEMA).repartition(3))
    return sorted((tuple(r) for r in cr.repair_digests(turns, turns["lost"]).select(*COLUMNS).collect()), key=repr)


@pytest.fixture(scope="module")
def table():
    rng = random.Random(5)
    rows = []
    for conv in [*range(120), None]:
        texts = [rng.choice(["Yes.", "No!", "So", " \t", "", "Why? ", "é", None, "Well.\n", "Zoë!　"]) for _ in range(9)]
        for turn in range(rng.randint(1, 7)):
            rows.append((conv, rng.choice([turn, turn, turn, turn * 3, None]), rng.choice(["user", "assistant", "system", "tool", "", None, "assistant", "user", "using"]), rng.choice(texts)))
    return rows + rng.sample(rows, 20)


def test_against_enumeration(spark, table):
    assert digests(spark, table) == expected(table)


def test_sql(spark, table):
    import pandas as pd

    con = duckdb.connect()
    frame = pd.DataFrame([r for r in table if r[0] is not None], columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"})
    con.register("given", frame)
    con.execute("create view conversations as select cast(conv_id as bigint) conv_id, cast(turn as bigint) turn, role, text from given")
    got = con.sql(f"select {', '.join(COLUMNS)} from ({cr.REPAIR_SQL})").fetchall()
    assert sorted(got, key=repr) == expected([r for r in table if r[0] is not None])


def test_all_signatures_up_to_five_rows():
    """Every string of symbols: cost and audit equal the enumeration."""
    dawg = cr._Dawg()
    rows = {"s": ("system", ""), "u": ("user", ""), "a": ("assistant", ""), "o": ("tool", "")}
    for n in range(6):
        for symbols in itertools.product("suaoUAx", repeat=n) if n < 5 else [tuple(random.Random(k).choices("suaoSUAOx", k=9)) for k in range(200)]:
            path = [(dawg.END, 0, ())]
            for x in reversed(symbols):
                node, base, _ = path[-1]
                node, more, edits = dawg.step(node, x)
                path.append((node, base + more, edits))
            cost, state, audit = path[-1][1] + path[-1][0][0][0], 0, ""
            for _, _, edits in reversed(path[1:]):
                inserts, edit, state = edits[state]
                audit += "I" * inserts + edit
            audit += "I" * (dawg.END[state][0] // 2)
            want = cheapest([(*rows.get(x.lower(), ("user", "")), "blank" if x == "x" else "truncated" if x.isupper() else "") for x in symbols])
            assert (cost, audit) == want[:2], symbols
    assert len({c for c, _ in dawg.steps}) < 200


def test_empty_table_and_clashing_columns(spark):
    assert digests(spark, []) == []
    turns = spark.createDataFrame([(7, 1, "user", "Hi.", "x", True)], SCHEMA + ", audit string, lost boolean")
    row = cr.repair_digests(turns).first()
    assert (row["conv_id"], row["audit"], row["cost"]) == (7, "KI", 2)
    assert [tuple(r) for r in cr.repaired_turns(turns).orderBy("position").collect()] == [(7, 0, "user", "Hi."), (7, 1, "assistant", "")]


def test_lost_conversation(spark):
    turns = spark.createDataFrame([(1, 0, "user", "Hi."), (2, 0, "user", "Hi."), (2, 1, "assistant", "Ho.")], SCHEMA)
    got = {r["conv_id"]: r for r in cr.repair_digests(turns, turns["conv_id"] == 1).collect()}
    assert got[1]["audit"] == "" and got[1]["repaired_sha256"] == hashlib.sha256(b"").hexdigest()
    assert got[2]["audit"] == "KK" and got[2]["cost"] == 0


def test_long_conversation(spark):
    """20,000 rows of one conversation: costs stay linear, the text whole."""
    rows = [(1, k, "user" if k % 2 == 0 else "assistant", f"Line {k}.") for k in range(20_000)]
    row = cr.repair_digests(spark.createDataFrame(rows, SCHEMA)).first()
    assert row["audit"] == "K" * 20_000
    assert row["repaired_sha256"] == hashlib.sha256("\n".join(f"{r[2]}:{r[3]}" for r in rows).encode()).hexdigest()
