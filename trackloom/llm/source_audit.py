"""Source divergence audit: how far the sources of a language lie from one another in their words.

Terms are counted by Arrow kernels inside the map: ``ascii_lower``, ``split_pattern_regex``,
``dictionary_encode`` and hash ``group_by`` turn batches of texts into partial counts.  Spark sums
these to one row a term with the counts of its sources, written as Parquet.  The divergences of
all ordered pairs of sources are sums over terms: shards of these rows give partial matrices,
which are added up.  All arithmetic is on integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import settle, slices

#: What lies between terms, and the unit of a share.
BREAKS = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
UNIT = 1_000_000_000

#: Rows of partial counts that a worker gathers before it passes them on.
HELD_ROWS = 1_000_000
#: Terms of a shard, and rows of a matrix of sources in one task; they change no result.
SHARD_TERMS, BLOCK_SOURCES = 8192, 256

_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def _summed(tables: list[pa.Table]) -> pa.Table:
    all_ = pa.concat_tables(tables)
    got = all_.group_by(["lang", "source", "term"], use_threads=False).aggregate([("n", "sum"), ("docs", "sum")])
    return got.select(["lang", "source", "term", "n_sum", "docs_sum"]).rename_columns(_COUNTS.names)


def _batch_counts(batch: pa.RecordBatch) -> pa.Table:
    """Counts of a batch's terms by language and source, and for each language and source the term '' with its documents."""
    docs = pa.table({"lang": batch.column("lang"), "source": batch.column("source"), "row": pa.array(range(batch.num_rows), pa.int32())})
    groups = docs.group_by(["lang", "source"], use_threads=False).aggregate([([], "count_all")])
    size = groups.num_rows
    groups = groups.append_column("group", pa.array(range(size), pa.int32()))
    split = pc.split_pattern_regex(pc.ascii_lower(batch.column("text")), BREAKS)
    terms, rows = pc.list_flatten(split), pc.list_parent_indices(split)
    real = pc.not_equal(terms, "")
    terms, rows = terms.filter(real).dictionary_encode(), rows.filter(real)
    # a row for each document and term, then for each group and term, on small integers
    by_doc = pa.table({"row": rows, "term": terms.indices}).group_by(["row", "term"], use_threads=False).aggregate([([], "count_all")])
    of_row = docs.append_column("at", docs["row"]).join(groups.select(["lang", "source", "group"]), ["lang", "source"], use_threads=False).sort_by("at")["group"].combine_chunks()
    by_doc = by_doc.append_column("group", of_row.take(by_doc["row"].combine_chunks()))
    got = by_doc.group_by(["group", "term"], use_threads=False).aggregate([("count_all", "sum"), ("count_all", "count")])
    at = got["group"].combine_chunks()
    own = lambda c: groups[c].combine_chunks()
    heads = pa.table([own("lang"), own("source"), pa.array([""] * size, pa.string()), pa.array([0] * size, pa.int64()), own("count_all").cast(pa.int64())], schema=_COUNTS)
    found = pa.table([own("lang").take(at), own("source").take(at), terms.dictionary.take(got["term"].combine_chunks()), got["count_all_sum"].combine_chunks().cast(pa.int64()), got["count_all_count"].combine_chunks().cast(pa.int64())], schema=_COUNTS)
    return pa.concat_tables([heads, found])


def _partial_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.Table] = []
    waiting = 0
    for whole in batches:
        for batch in slices(whole, 1024):
            held.append(_batch_counts(batch))
            waiting += held[-1].num_rows
            if waiting > HELD_ROWS:
                held = [_summed(held)]
                if held[0].num_rows > HELD_ROWS // 2:
                    yield from held.pop().combine_chunks().to_batches(max_chunksize=100_000)
                waiting = sum(t.num_rows for t in held)
    if held:
        yield from _summed(held).combine_chunks().to_batches(max_chunksize=100_000)


def term_counts(docs: DataFrame, least_docs: int = 3) -> DataFrame:
    """The terms that a language keeps: lang, term, counts (an array of source and n), and for term '' the language's sources with n 0.

    A term stays where at least ``least_docs`` documents of its language hold it.  Null text,
    lang and source are ''.
    """
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    partial = docs.select(known("text"), known("lang"), known("source")).mapInArrow(_partial_counts, "lang string, source string, term string, n long, docs long")
    # one shuffle: both sums follow the term's own rows
    by_source = partial.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    by_term = by_source.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "n")).alias("counts"), F.sum("docs").alias("docs"))
    return by_term.where((F.col("docs") >= least_docs) | (F.col("term") == "")).select("lang", "term", "counts")


def _share(n: str, total: str, terms: str) -> str:
    """SQL for 1 + floor(UNIT * (n + 1) / (total + terms)), three digits at a time, so that nothing leaves 64 bits."""
    size = f"({total} + {terms})"
    whole, rest = f"(({n} + 1) div {size})", f"(({n} + 1) % {size})"
    first, rest1 = f"({rest} * 1000 div {size})", f"({rest} * 1000 % {size})"
    second, rest2 = f"({rest1} * 1000 div {size})", f"({rest1} * 1000 % {size})"
    return f"(1 + {whole} * {UNIT} + {first} * 1000000 + {second} * 1000 + {rest2} * 1000 div {size})"


def _shares(n: np.ndarray, total: np.ndarray, terms: int) -> np.ndarray:
    """The same for arrays."""
    size = total + terms
    out, rest = np.divmod(n + 1, size)
    for _ in range(3):
        more, rest = np.divmod(rest * 1000, size)
        out = out * 1000 + more
    return out + 1


def _shard_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial sums of a shard's terms for the pairs (source of the block, any source), from heads (kind 0) and terms (kind 1)."""
    key, heads, terms, sums, at, places = None, [], 0, None, {}, None

    def matrix():
        nonlocal sums, at, places
        sources = [h[0] for h in heads]
        at = {s: k for k, s in enumerate(sources)}
        places = np.flatnonzero([k // BLOCK_SOURCES == key[2] for k in range(len(sources))])
        sums = np.zeros((len(places), len(sources)), np.int64)

    def add(rows):
        """Adds the terms of ``rows``, each its counts of sources."""
        total = np.array([h[1] for h in heads], np.int64)
        for start in range(0, len(rows), 1024):
            counts = np.zeros((min(1024, len(rows) - start), len(heads)), np.int64)
            for k, own in enumerate(rows[start : start + 1024]):
                for x in own:
                    counts[k, at[x["source"]]] = x["n"]
            p = _shares(counts, total[None, :], terms)
            mine = np.ascontiguousarray(p[:, places])
            for b in range(p.shape[1]):
                q = p[:, b : b + 1]
                sums[:, b] += ((mine - q) ** 2 // q).sum(axis=0)

    def closed():
        sources = np.array([h[0] for h in heads], object)
        a, b = np.nonzero(np.ones_like(sums))
        lang = pa.array([key[0]] * len(a), pa.string())
        table = pa.table([lang, pa.array(sources[places[a]], pa.string()), pa.array(sources[b], pa.string()), pa.array(sums.ravel())], ["lang", "source", "item", "value"])
        yield from table.to_batches(max_chunksize=100_000)

    pending: list = []
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("lang", "shard", "block", "kind", "source", "total", "terms", "counts")]
        for lang, shard, block, kind, source, total, size, counts in zip(*columns, strict=True):
            if key != (lang, shard, block):
                if key is not None:
                    if sums is None:
                        matrix()
                    add(pending)
                    yield from closed()
                key, heads, terms, sums, pending = (lang, shard, block), [], size, None, []
            if kind == 0:
                heads.append((source, total))
                continue
            if sums is None:
                matrix()
            pending.append(counts)
            if len(pending) >= 1024:
                add(pending)
                pending = []
    if key is not None:
        if sums is None:
            matrix()
        add(pending)
        yield from closed()


def divergences(docs: DataFrame, least_docs: int = 3, ranks: int = 200) -> DataFrame:
    """For each language and source its distances to the language's other sources and the terms it has more of: lang, source, part, item, value, rank.

    Shares are 1 + floor(10^9 (n + 1) / (N + V)) with V kept terms in the language and N of their
    occurrences in the group.  ``pair``: for each other source the sum over all kept terms of
    floor((p - q)^2 / q); ``term``: the same for single terms of the group against its language,
    where p > q, the first ``ranks`` of them.  Ranks fall by value, then rise by item in UTF-8.

    A source without terms has shares too; a language without kept terms has value 0 for all
    pairs; a lone source has no pair.  An empty table gives no row; repeated rows count again;
    other columns are ignored.  All pairs of a language's sources are rows, so that their number
    grows with the square of a language's sources: some thousand of them fit.
    """
    kept = settle(term_counts(docs, least_docs), "terms")
    long = kept.select("lang", "term", F.explode("counts").alias("c")).select("lang", "term", F.col("c.source").alias("source"), F.col("c.n").alias("n"))
    sizes = kept.groupBy("lang").agg(F.count(F.when(F.col("term") != "", 1)).alias("terms"))
    sources = long.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    in_lang = Window.partitionBy("lang")
    groups = settle(
        sources.join(sizes, "lang").select("lang", "source", "total", "terms", F.sum("total").over(in_lang).alias("lang_total"), F.count("*").over(in_lang).alias("sources")), "groups"
    )  # small: Spark sees its size and broadcasts it where that is little
    terms = kept.where("term <> ''")

    in_all = F.aggregate("counts", F.lit(0).cast("long"), lambda s, c: s + c["n"]).alias("lang_n")
    in_term = terms.select("lang", "term", in_all, F.explode("counts").alias("c"))
    in_term = in_term.select("lang", "term", "lang_n", F.col("c.source").alias("source"), F.col("c.n").alias("n")).where("n > 0").join(groups, ["lang", "source"])
    p, q = F.expr(_share("n", "total", "terms")), F.expr(_share("lang_n", "lang_total", "terms"))
    valued = in_term.select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).where("p > q").select("lang", "source", "item", F.expr("(p - q) * (p - q) div q").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    top = valued.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= ranks)

    by_lang = groups.select("lang", "terms", "sources").distinct()
    shards = lambda c: F.greatest(F.lit(1), F.ceil(F.col(c) / SHARD_TERMS)).cast("long")
    blocks = F.sequence(F.lit(0).cast("long"), F.expr(f"(sources - 1) div {BLOCK_SOURCES}"))
    heads = groups.select("lang", F.explode(F.sequence(F.lit(0).cast("long"), shards("terms") - 1)).alias("shard"), "source", "total", "terms", blocks.alias("blocks"))
    heads = heads.select("lang", "shard", F.explode("blocks").alias("block"), F.lit(0).alias("kind"), "source", "total", "terms", F.lit(None).cast("array<struct<source:string,n:bigint>>").alias("counts"))
    dealt = terms.join(by_lang, "lang").select("lang", F.pmod(F.xxhash64("term"), shards("terms")).alias("shard"), F.explode(blocks).alias("block"), F.lit(1).alias("kind"), "terms", "counts")
    key = ["lang", "shard", "block"]
    rows = heads.unionByName(dealt, allowMissingColumns=True).repartition(*key).sortWithinPartitions(*key, "kind", "source")
    parts = rows.mapInArrow(_shard_rows, "lang string, source string, item string, value long").where("source <> item")
    pairs = parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).withColumn("rank", F.row_number().over(order))
    shown = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.col("rank").cast("int").alias("rank"))
    return shown(pairs, "pair").unionByName(shown(top, "term"))


#: DuckDB SQL for the rows of ``divergences`` over documents.
DIVERGENCE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
w AS (SELECT id, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term FROM w GROUP BY ALL HAVING count(DISTINCT id) >= 3),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY ALL),
t AS (SELECT g.lang, g.source, coalesce(sum(n), 0) AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (SELECT t.lang, t.source, k.term, coalesce(c.n, 0) AS n, CAST(1 + (1000000000 * (coalesce(c.n, 0) + 1)) // (t.total + v.v) AS bigint) AS p
  FROM t JOIN v USING (lang) JOIN k USING (lang) LEFT JOIN c ON c.lang = t.lang AND c.source = t.source AND c.term = k.term),
l AS (SELECT lang, term, CAST(1 + (1000000000 * (sum(n) + 1)) // (sum(sum(n)) OVER (PARTITION BY lang) + count(*) OVER (PARTITION BY lang)) AS bigint) AS q FROM p GROUP BY lang, term),
s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pair AS (SELECT a.lang, a.source, b.source AS item, CAST(coalesce(s.value, 0) AS bigint) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
term AS (SELECT p.lang, p.source, p.term AS item, CAST((p - q) * (p - q) // q AS bigint) AS value FROM p JOIN l ON l.lang = p.lang AND l.term = p.term WHERE n > 0 AND p > q),
u AS (SELECT lang, source, 'pair' AS part, item, value FROM pair UNION ALL SELECT lang, source, 'term', item, value FROM term)
SELECT lang, source, part, item, value, CAST(rank AS int) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM u) WHERE part = 'pair' OR rank <= 200
"""
