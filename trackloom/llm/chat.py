"""Chat formatting: cumulative-snapshot collapse, then rendering.

A conversation that was logged again after each turn leaves snapshots that are prefixes of
one another.  Every turn gets the hash of the conversation up to and including it; a
conversation whose last hash is an inner hash of a longer one is such a snapshot.  All steps
are DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the rendered form.
OPEN, CLOSE = "<|", "|>\n"


def _prepared(turns: DataFrame) -> DataFrame:
    return turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).where(F.col("conv_id").isNotNull())


def maximal_conversations(turns: DataFrame) -> DataFrame:
    """conv_id and n_turns of the conversations that are a prefix of no other.

    Turns are taken in the order (turn, role, text), nulls first (FORMAT_SQL
    puts null turns last under DuckDB's default); null roles and texts count as empty; rows without conv_id belong to no conversation and are left out.  Of equal
    conversations the one with the smallest id stays.
    """
    rows = _prepared(turns)
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    # 120 bits of each turn's content
    content = F.sha2(F.to_json(F.struct("role", "text")), 256)
    placed = rows.withColumn("position", F.row_number().over(order))
    placed = placed.select("conv_id", "position", F.conv(F.substring(content, 1, 15), 16, 10).cast("long").alias("hash_a"), F.conv(F.substring(content, 16, 15), 16, 10).cast("long").alias("hash_b"))
    # positions enter the hashed terms, so that the running xor is a hash of the sequence
    for x, y in (("hash_a", "hash_b"), ("hash_b", "hash_a")):
        placed = placed.withColumn(f"term_{x}", F.xxhash64("position", x, y))
    running = Window.partitionBy("conv_id").orderBy("position").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    prefixes = placed.select(
        "conv_id", "position",
        F.bit_xor("term_hash_a").over(running).alias("prefix_a"),
        F.bit_xor("term_hash_b").over(running).alias("prefix_b"),
        F.lead("position").over(Window.partitionBy("conv_id").orderBy("position")).isNull().alias("last"),
    )
    key = ["position", "prefix_a", "prefix_b"]
    whole = prefixes.where("last").groupBy(*key).agg(F.min("conv_id").alias("conv_id"))
    inner = prefixes.where("not last").select(*key).distinct()
    return whole.join(inner, key, "left_anti").select("conv_id", F.col("position").cast("long").alias("n_turns"))


def format_chats(turns: DataFrame) -> DataFrame:
    """The maximal conversations, rendered: conv_id, n_turns, chat.

    ``chat`` has for each turn ``<|role|>``, a newline, the text and a newline.  An empty table
    gives no row; columns other than conv_id, turn, role and text are ignored.
    """
    kept = maximal_conversations(turns)
    lines = F.array_sort(F.collect_list(F.struct(F.coalesce(F.col("turn"), F.lit(-(2**63) + 1)).alias("turn"), "role", "text")))
    chats = _prepared(turns).join(kept, "conv_id").groupBy("conv_id", "n_turns").agg(lines.alias("lines"))
    text = F.array_join(F.transform("lines", lambda x: F.concat(F.lit(OPEN), x["role"], F.lit(CLOSE), x["text"], F.lit("\n"))), "")
    return chats.select("conv_id", "n_turns", text.alias("chat"))


#: DuckDB SQL for the rows of ``format_chats`` over the conversations table.
FORMAT_SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
p AS (SELECT conv_id, row_number() OVER w AS position, count(*) OVER (PARTITION BY conv_id) AS n,
        sha256(coalesce(string_agg('<|' || role || '|>' || chr(10) || text || chr(10), chr(1)) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING), '')) AS prefix
      FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
whole AS (SELECT prefix, n, min(conv_id) AS conv_id FROM p WHERE position = n GROUP BY prefix, n),
kept AS (SELECT conv_id, n FROM whole WHERE prefix NOT IN (SELECT prefix FROM p WHERE position < n))
SELECT k.conv_id, k.n AS n_turns, string_agg('<|' || t.role || '|>' || chr(10) || t.text || chr(10), '' ORDER BY t.turn, t.role, t.text) AS chat
FROM kept k JOIN t USING (conv_id) GROUP BY k.conv_id, k.n
"""
