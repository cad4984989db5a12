"""Conversation structure repair over a suffix-shared automaton.

Every row of a conversation becomes one symbol for its role and fault, a conversation the string
of its symbols.  What the rest of a conversation costs, and which edits are best for it, depends
on its suffix only.  Signatures are therefore sorted from their ends: neighbours share a path of
nodes, and only the nodes beyond the shared suffix are looked at.  Nodes from which all grammar
states go on alike are one node (`_Dawg`), so that cost-to-go and the best audit suffix are worked
out once for each node and grammar state, whatever the number of conversations.

A conversation's rows stream through a worker in order; what is held of it is one symbol a row.
One conversation is one task's work: its hash and its edits are sequences.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import settle

#: White space, the ends of sentences, and what an edit costs.
BLANKS = " \t\n\x0b\x0c\r"
ENDS = (".", "!", "?")
DELETE, REROLE, INSERT, TRUNCATED = 3, 2, 2, 1

#: Grammar states: nothing yet, after system, after user, after assistant.
START, AFTER_SYSTEM, AFTER_USER, AFTER_ASSISTANT = range(4)
#: For each state, which role comes next and the state then.
NEEDS = ("u", "u", "a", "u")
THEN = (AFTER_USER, AFTER_USER, AFTER_ASSISTANT, AFTER_USER)
ROLES = {"u": b"user", "a": b"assistant"}

#: Of a conversation's rows, nulls first.
ORDER = ["turn", "role", "start", "digest"]

COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal"]


class _Dawg:
    """Nodes by what follows them.

    A node is, for each grammar state, the cost-to-go above the cheapest state's and the rank of
    its audit suffix among the four.  Both are bounded, as two inserts lead to any state, and
    they are all that earlier symbols need to know: equal ones are one node.  The number of nodes
    so depends on the alphabet alone.
    """

    #: The end: nothing or a finished pair costs nothing, an open pair one insert, a lone system row two.
    END = ((0, 0), (2 * INSERT, 2), (INSERT, 1), (0, 0))

    def __init__(self):
        self.steps: dict[tuple, tuple] = {}

    def step(self, child: tuple, symbol: str) -> tuple[tuple, int, tuple]:
        """The node before ``child``, what its cheapest state costs above that of ``child``, and for each state (inserts, edit, state after)."""
        got = self.steps.get((child, symbol))
        if got is None:
            got = self.steps[child, symbol] = self._worked_out(child, symbol)
        return got

    @staticmethod
    def _worked_out(child: tuple, symbol: str) -> tuple[tuple, int, tuple]:
        role, more = symbol.lower(), TRUNCATED if symbol.isupper() else 0
        plain = []  # without inserts: (cost, what the audit reads, state after)
        for state in range(4):
            to = lambda cost, edit, then: (cost + child[then][0], (edit, child[then][1]), then)
            options = [to(DELETE, "D", state)]
            if role != "x":
                options.append(to(REROLE + more, "R", THEN[state]))
                if role == NEEDS[state]:
                    options.append(to(more, "K", THEN[state]))
                elif role == "s" and state == START:
                    options.append(to(more, "K", AFTER_SYSTEM))
            plain.append(min(options))
        best = []
        for state in range(4):
            options, at = [], state
            for inserts in range(3):  # a third insert leads back
                cost, reads, then = plain[at]
                options.append((inserts * INSERT + cost, ("I",) * inserts + reads, (inserts, reads[0], then)))
                at = THEN[at]
            best.append(min(options))
        least = min(cost for cost, _, _ in best)
        ranks = {reads: k for k, reads in enumerate(sorted({reads for _, reads, _ in best}))}
        return tuple((cost - least, ranks[reads]) for cost, reads, _ in best), least, tuple(edit for _, _, edit in best)


def damage(turns: DataFrame) -> DataFrame:
    """The rows (conv_id, turn, role, text, lost) after a repeatable damage by crc32 of ``conv_id:turn`` mod 20.

    0 marks the row as lost, 1 empties its text, 2 removes ends of sentences, 3 repeats the row
    and 4 makes its role user.  Nulls read as one space, in the key, role and text; ``turn`` and
    ``conv_id`` themselves stay null.  Other columns are ignored.
    """
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), shown("role").alias("role"), shown("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("kind") == 0).alias("lost"), copies.alias("copy")).drop("copy")


def _prepared(turns: DataFrame, lost: Column | None) -> DataFrame:
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    gone = F.coalesce(lost, F.lit(False)) if lost is not None else F.lit(False)
    return turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), shown("role"), shown("text"), gone.alias("lost"))


def _faults(rows: DataFrame) -> DataFrame:
    """Each row's initial and first fault, without its text."""
    light = rows.select(
        "conv_id", "turn", "role", "lost",
        F.substring("role", 1, 1).alias("initial"),
        F.substring(F.rtrim(F.col("text"), F.lit(BLANKS)), -1, 1).alias("last"),
        F.unhex(F.sha2("text", 256)).alias("digest"),
        F.substring("text", 1, 64).alias("start"),
    )
    same = Window.partitionBy("conv_id", "lost", "role", "digest").orderBy(F.asc_nulls_first("turn"))
    fault = F.when(F.col("last") == "", "blank").when(F.col("nth") > 1, "duplicate").when(~F.col("last").isin(*ENDS), "truncated")
    return light.repartition("conv_id").withColumn("nth", F.row_number().over(same)).withColumn("fault", fault)


def _signature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Conversations from their sorted rows: symbols from the last row to the first, and the counts."""
    schema = pa.schema([("conv_id", pa.int64()), ("from_end", pa.string()), *((c, pa.int64()) for c in COUNTS)])
    conv, symbols, counts, turns, before = None, None, {}, [0, None, None], ""
    out: list[tuple] = []

    def closed():
        distinct, first, last = turns
        gaps = last - first + 1 - distinct if distinct else 0
        out.append((conv, "".join(reversed(symbols)), gaps, *(counts[c] for c in COUNTS[1:])))

    def flushed():
        columns = [pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)]
        out.clear()
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    for batch in batches:
        for own, turn, lost, initial, fault in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "lost", "initial", "fault")), strict=True):
            if symbols is None or own != conv:
                if symbols is not None:
                    closed()
                conv, symbols, counts, turns, before = own, [], dict.fromkeys(COUNTS, 0), [0, None, None], ""
            if lost:
                continue
            if turn is not None and turn != turns[2]:
                turns = [turns[0] + 1, turn if turns[0] == 0 else turns[1], turn]
            if fault:
                counts[fault] += 1
            if symbols and before + initial not in ("su", "ua", "au"):
                counts["illegal"] += 1
            before = initial
            role = initial if initial in ("s", "u", "a") else "o"
            symbols.append("x" if fault in ("blank", "duplicate") else role.upper() if fault else role)
        if len(out) >= 4096:
            yield flushed()
    if symbols is not None:
        closed()
    if out:
        yield flushed()


def _audit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds cost and audit to conversations sorted by their signatures from the end."""
    dawg = _Dawg()
    read, cost, audit = "", 0, ""
    path = [(dawg.END, 0, ())]  # a node, its cheapest state's cost-to-go and decisions for each symbol of ``read``
    for batch in batches:
        costs, audits = [], []
        for signature in batch.column("from_end").to_pylist():
            if signature != read or not costs:
                shared = 0
                for a, b in zip(signature, read, strict=False):
                    if a != b:
                        break
                    shared += 1
                del path[shared + 1 :]
                for symbol in signature[shared:]:
                    node, base, _ = path[-1]
                    node, more, edits = dawg.step(node, symbol)
                    path.append((node, base + more, edits))
                read = signature
                node, base, _ = path[-1]
                cost, state, parts = base + node[START][0], START, []
                for _, _, edits in reversed(path[1:]):
                    inserts, edit, then = edits[state]
                    parts.append("I" * inserts + edit)
                    state = then
                parts.append("I" * (dawg.END[state][0] // INSERT))
                audit = "".join(parts)
            costs.append(cost)
            audits.append(audit)
        kept = [c for c in batch.schema.names if c != "from_end"]
        columns = [*(batch.column(c) for c in kept), pa.array(costs, pa.int64()), pa.array(audits, pa.string())]
        yield pa.RecordBatch.from_arrays(columns, [*kept, "cost", "audit"])


def audits(turns: DataFrame, lost: Column | None = None) -> DataFrame:
    """A row for each conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit.

    Rows are taken by turn, nulls first; those of one turn by role, the text's first 64
    characters and its SHA-256.  The first fault of
    a row counts: blank, duplicate (role and text were there before), truncated (no end of a
    sentence at its end).  The audit is the cheapest sequence of Keep, Rerole, Delete and Insert
    that leaves ``(s?(ua)+)?`` of the roles' initials, the least in ASCII of several.

    Null roles and texts read as one space; an empty role has no initial and is never kept; rows without conv_id are one conversation, with a
    null id; rows that ``lost`` marks are none, but their conversation has a result: zeros, an
    empty audit.  Turns and texts of any length, repeated rows and empty tables need nothing
    special; other columns are ignored.
    """
    light = _faults(_prepared(turns, lost)).sortWithinPartitions(F.asc_nulls_first("conv_id"), *ORDER, "nth").select("conv_id", "turn", "lost", "initial", "fault")
    signatures = settle(light.mapInArrow(_signature_rows, "conv_id long, from_end string" + "".join(f", {c} long" for c in COUNTS)), "signatures")
    # a signature that many conversations have is split by their ids
    ranged = signatures.repartitionByRange("from_end", F.asc_nulls_first("conv_id")).sortWithinPartitions("from_end")
    return ranged.mapInArrow(_audit_rows, "conv_id long" + "".join(f", {c} long" for c in COUNTS) + ", cost long, audit string")


def _with_rows(turns: DataFrame, found: DataFrame, lost: Column | None) -> DataFrame:
    """Conversations in order, each as its audit row and then its rows."""
    rows = _prepared(turns, lost).where("not lost").select("conv_id", F.lit(1).alias("kind"), "turn", F.col("role").cast("binary").alias("role"), F.col("text").cast("binary").alias("text"), F.substring("text", 1, 64).alias("start"), F.unhex(F.sha2("text", 256)).alias("digest"))
    heads = found.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit(b"").alias("role"), F.col("audit").cast("binary").alias("text"), *COUNTS, "cost")
    both = heads.unionByName(rows, allowMissingColumns=True)
    return both.repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), "kind", *ORDER).drop("start", "digest")


class _Edits:
    """An audit applied to rows in order: ``row`` and ``rest`` give what comes out as (role, text)."""

    def __init__(self, audit: bytes):
        self.audit, self.at, self.state = audit.decode(), 0, START

    def _needed(self) -> bytes:
        role = ROLES[NEEDS[self.state]]
        self.state = THEN[self.state]
        return role

    def rest(self) -> Iterator[tuple[bytes, bytes]]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            yield self._needed(), b""

    def row(self, role: bytes, text: bytes) -> Iterator[tuple[bytes, bytes]]:
        yield from self.rest()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "R":
            yield self._needed(), text
        elif edit == "K":
            self.state = AFTER_SYSTEM if role[:1] == b"s" else THEN[self.state]
            yield role, text


def _streamed(batches: Iterator[pa.RecordBatch], opened: Callable, put: Callable, closed: Callable) -> Iterator[None]:
    """Walks through conversations as `_with_rows` sorts them; yields after every batch."""
    edits = None
    for batch in batches:
        counts = [batch.column(c) for c in ("conv_id", *COUNTS, "cost")]
        for k, (kind, role, text) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("kind", "role", "text")), strict=True)):
            if kind == 0:
                if edits is not None:
                    for out in edits.rest():
                        put(*out)
                    closed()
                edits = _Edits(text)
                opened([c[k].as_py() for c in counts], edits.audit)
            else:
                for out in edits.row(role, text):
                    put(*out)
        yield None
    if edits is not None:
        for out in edits.rest():
            put(*out)
        closed()
    yield None


def _turn_rows(batches):
    out: list[tuple] = []
    at: list = [None, 0]

    def opened(head, audit):
        at[:] = head[0], 0

    def put(role, text):
        out.append((at[0], at[1], role, text))
        at[1] += 1

    schema = pa.schema([("conv_id", pa.int64()), ("position", pa.int64()), ("role", pa.binary()), ("text", pa.binary())])
    for _ in _streamed(batches, opened, put, lambda: None):
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
            out.clear()


def _digest_rows(batches):
    out: list[tuple] = []
    own: list = [None, None, 0]

    def opened(head, audit):
        own[:] = [*head, audit], hashlib.sha256(), 0

    def put(role, text):
        own[1].update((b"\n" if own[2] else b"") + role + b":" + text)
        own[2] += 1

    def closed():
        out.append((*own[0], own[1].hexdigest()))

    schema = pa.schema([*((c, pa.int64()) for c in ("conv_id", *COUNTS, "cost")), ("audit", pa.string()), ("repaired_sha256", pa.string())])
    for _ in _streamed(batches, opened, put, closed):
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
            out.clear()


def repaired_turns(turns: DataFrame, lost: Column | None = None) -> DataFrame:
    """The rows of the repaired conversations: conv_id, position (from 0), role, text; ties, nulls and empty tables as in `audits`."""
    found = _with_rows(turns, audits(turns, lost), lost).mapInArrow(_turn_rows, "conv_id long, position long, role binary, text binary")
    return found.select("conv_id", "position", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))


def repair_digests(turns: DataFrame, lost: Column | None = None) -> DataFrame:
    """The columns of `audits` and repaired_sha256: the hash of the repaired ``role:text`` lines, joined by newlines."""
    return _with_rows(turns, audits(turns, lost), lost).mapInArrow(_digest_rows, "conv_id long" + "".join(f", {c} long" for c in COUNTS) + ", cost long, audit string, repaired_sha256 string")


def _needed_sql(state: int, child: str) -> str:
    """What a state's cheapest edits without inserts are, as text: the cost in seven digits, then the audit."""
    on = lambda edit, cost, to: f"printf('%07d', {cost} + CAST(substr({child}.b{to}, 1, 7) AS bigint)) || '{edit}' || substr({child}.b{to}, 8)"
    options = [on("D", str(DELETE), state), f"CASE WHEN NOT gone THEN {on('R', f'{REROLE} + short', THEN[state])} END", f"CASE WHEN NOT gone AND initial = '{NEEDS[state]}' THEN {on('K', 'short', THEN[state])} END"]
    if state == START:
        options.append(f"CASE WHEN NOT gone AND initial = 's' THEN {on('K', 'short', AFTER_SYSTEM)} END")
    return f"least({', '.join(options)})"


def _inserted_sql(state: int) -> str:
    """The cheapest edits of a state with up to two inserts before the row."""
    one, two = THEN[state], THEN[THEN[state]]
    on = lambda inserts, to: f"printf('%07d', {inserts * INSERT} + CAST(substr(p{to}, 1, 7) AS bigint)) || '{'I' * inserts}' || substr(p{to}, 8)"
    return f"least(p{state}, {on(1, one)}, {on(2, two)})"


#: DuckDB SQL for the rows of ``repair_digests`` over the damaged conversations; it walks back through each conversation row by row.
REPAIR_SQL = rf"""
WITH RECURSIVE t AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS varchar), ' ') || ':' || coalesce(CAST(turn AS varchar), ' ') AS k FROM conversations),
h AS (SELECT *, xor(list_reduce(list_prepend(CAST(4294967295 AS bigint), list_transform(range(1, length(k) + 1), lambda i: CAST(ascii(substr(k, i, 1)) AS bigint))),
  lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x // 2, (x % 2) * 3988292384))), 4294967295) % 20 AS kind FROM t),
d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM h JOIN (VALUES (0), (1)) c(n) ON n = 0 OR kind = 3 WHERE kind <> 0),
f AS (SELECT *, row_number() OVER w AS pos, lag(left(role, 1)) OVER w AS before, left(role, 1) AS initial, right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS last FROM d WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, left(text, 64), sha256(text))),
g AS (SELECT *, CASE WHEN last = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'duplicate' WHEN last NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM f),
r AS (SELECT *, fault IN ('blank', 'duplicate') AS gone, CASE WHEN fault = 'truncated' THEN {TRUNCATED} ELSE 0 END AS short FROM g),
c AS (SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated,
  count(*) FILTER (WHERE before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM r GROUP BY conv_id),
go AS (SELECT conv_id, n + 1 AS pos, '0000000' AS b0, '0000004II' AS b1, '0000002I' AS b2, '0000000' AS b3 FROM c
  UNION ALL SELECT conv_id, pos, {', '.join(f'{_inserted_sql(s)} AS b{s}' for s in range(4))}
  FROM (SELECT r.conv_id, r.pos, {', '.join(f"{_needed_sql(s, 'go')} AS p{s}" for s in range(4))} FROM go JOIN r ON r.conv_id IS NOT DISTINCT FROM go.conv_id AND r.pos = go.pos - 1)),
a AS (SELECT conv_id, CAST(substr(b0, 1, 7) AS bigint) AS cost, substr(b0, 8) AS audit FROM go WHERE pos = 1),
e AS (SELECT conv_id, i, substr(audit, i, 1) AS edit FROM a, range(1, length(audit) + 1) x(i)),
n AS (SELECT *, sum(CASE WHEN edit = 'I' THEN 0 ELSE 1 END) OVER w AS pos, sum(CASE WHEN edit = 'D' THEN 0 ELSE 1 END) OVER w AS nth FROM e WINDOW w AS (PARTITION BY conv_id ORDER BY i ROWS UNBOUNDED PRECEDING)),
m AS (SELECT n.conv_id, i, edit, n.nth, r.role, r.text, max(CASE WHEN n.nth = 1 AND edit = 'K' AND r.initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY n.conv_id) AS led
  FROM n LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM n.conv_id AND r.pos = n.pos AND edit <> 'I' WHERE edit <> 'D'),
s AS (SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (nth - led) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY i) AS lines FROM m GROUP BY conv_id)
SELECT i.conv_id, CAST(coalesce(c.gaps, 0) AS bigint) AS gaps, coalesce(c.blank, 0) AS blank, coalesce(c.duplicate, 0) AS duplicate, coalesce(c.truncated, 0) AS truncated, coalesce(c.illegal, 0) AS illegal,
  coalesce(a.cost, 0) AS cost, coalesce(a.audit, '') AS audit, sha256(coalesce(s.lines, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) i LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM i.conv_id LEFT JOIN a ON a.conv_id IS NOT DISTINCT FROM i.conv_id LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM i.conv_id
"""
