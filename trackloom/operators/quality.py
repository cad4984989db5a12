"""Calibration, expert fusion, candidate routing, label filters and review queues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .nullsafe import join_same
from .ranks import in_ranges


def recall_by_slice(rows: DataFrame, domain: str, cell: list[str], tp: Column, gt: Column, prior: float = 10.0) -> DataFrame:
    """Slice recall shrunk to its domain's: (tp + k * p) / (gt + k)."""
    sums = rows.groupBy(domain, *cell).agg(F.sum(tp).alias("tp"), F.sum(gt).alias("gt"))
    whole = Window.partitionBy(domain)
    p = F.sum("tp").over(whole) / F.sum("gt").over(whole)
    return sums.select(domain, *cell, "tp", "gt", ((F.col("tp") + prior * p) / (F.col("gt") + prior)).alias("recall"))


def corrected_count(rows: DataFrame, recall: DataFrame, keys: list[str], frame: str, p: Column) -> DataFrame:
    """Sum of p / recall per frame; null where a row lacks either."""
    joined = rows.withColumn("p_", p).join(F.broadcast(recall.select(*keys, "recall")), keys, "left")
    each = F.col("p_") / F.col("recall")
    return joined.groupBy(frame).agg(F.count("*").alias("n"), F.when(F.count(each) == F.count("*"), F.sum(each)).alias("corrected"))


def expert_fusion(scores: DataFrame, brier: DataFrame, item: str) -> DataFrame:
    """Softmax gate over -4 * Brier of the experts that scored an item; mean and weighted variance.

    ``brier`` has a row per context and expert: a small table.
    """
    rows = scores.join(F.broadcast(brier), ["context", "expert"])
    top = F.max(-4 * F.col("brier")).over(Window.partitionBy(item))
    rows = rows.withColumn("g", F.exp(-4 * F.col("brier") - top))
    sums = rows.groupBy(item).agg(F.sum("g").alias("sg"), F.sum(F.col("g") * F.col("p")).alias("sp"), F.sum(F.col("g") * F.col("p") * F.col("p")).alias("spp"), F.count("*").alias("experts"))
    mean = F.col("sp") / F.col("sg")
    return sums.select(item, "experts", mean.alias("p"), F.greatest(F.col("spp") / F.col("sg") - mean * mean, F.lit(0.0)).alias("variance"))


def route_candidates(scores: DataFrame, item: str, sure: float = 0.85, maybe: float = 0.55) -> DataFrame:
    """soft_positive where two expert families are sure (its weight is the least of all that is known of it), ignore where one may be right, else background."""
    g = scores.groupBy(item).agg(F.count_distinct(F.when(F.col("p") >= sure, F.col("family"))).alias("families"), F.max("p").alias("best"), F.min("p").alias("weight"))
    route = F.when(F.col("families") >= 2, "soft_positive").when(F.col("best") >= maybe, "ignore").otherwise("background")
    return g.select(item, "families", route.alias("route"), F.when(F.col("families") >= 2, F.col("weight")).alias("weight"))


def label_filter(rows: DataFrame, group: str, high: float = 0.9, low: float = 0.1) -> DataFrame:
    """keep, review or reject by the quantiles of the score within the group."""
    limits = rows.groupBy(group).agg(F.percentile("score", F.lit(high)).alias("hi"), F.percentile("score", F.lit(low)).alias("lo"))
    return join_same(rows, F.broadcast(limits), [group]).withColumn("decision", F.when(F.col("score") >= F.col("hi"), "keep").when(F.col("score") <= F.col("lo"), "reject").otherwise("review"))


def class_f1(rows: DataFrame, key: str, truth: str, guess: str) -> DataFrame:
    """Per class true and false positives and misses, and F1."""
    events = rows.select(F.explode(F.array(F.struct(F.col(truth).alias("c"), F.lit("t").alias("k"), (F.col(truth) == F.col(guess)).alias("ok")), F.struct(F.col(guess).alias("c"), F.lit("g").alias("k"), (F.col(truth) == F.col(guess)).alias("ok")))).alias("e")).select("e.*").where("c is not null")
    g = events.groupBy(F.col("c").alias(key)).agg(F.sum(F.when((F.col("k") == "t") & F.col("ok"), 1).otherwise(0)).alias("tp"), F.sum(F.when((F.col("k") == "g") & ~F.coalesce("ok", F.lit(False)), 1).otherwise(0)).alias("fp"), F.sum(F.when((F.col("k") == "t") & ~F.coalesce("ok", F.lit(False)), 1).otherwise(0)).alias("fn"))
    return g.withColumn("f1", 2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn")))


def beta_update(nodes: DataFrame, reviews: DataFrame) -> DataFrame:
    """Adds each decision once to its rule's Beta counts: rule, alpha, beta, support, gain.  Rules are few."""
    once = reviews.dropDuplicates(["review_id"])
    got = once.groupBy("rule").agg(F.sum(F.when(F.col("confirmed"), 1).otherwise(0)).alias("yes"), F.sum(F.when(F.col("confirmed"), 0).otherwise(1)).alias("no"))
    a, b = F.col("alpha") + F.coalesce("yes", F.lit(0)), F.col("beta") + F.coalesce("no", F.lit(0))
    n = a + b
    return nodes.join(got, "rule", "left").select("rule", a.alias("alpha"), b.alias("beta"), (a / n).alias("support"), F.least(36 * a * b / (n * n * (n + 1)), F.lit(1.0)).alias("gain"))


def merge_reviews(entities: DataFrame, decisions: DataFrame) -> DataFrame:
    """Ordered upsert: the last decision of each entity wins; confirm and add set human labels, reject invalidates."""
    last = decisions.groupBy("entity_id").agg(F.max_by(F.struct("action", "decision_id"), F.struct("at", "decision_id")).alias("d"))
    rows = entities.join(last, "entity_id", "full")
    status = F.when(F.col("d.action") == "reject", "invalid").when(F.col("d.action").isin("confirm", "correct", "add"), "human_confirmed").otherwise(F.col("status"))
    return rows.select("entity_id", status.alias("status"), F.col("d.decision_id").alias("decision_id"), F.when(F.col("status").isNull(), "added").when(F.col("d").isNotNull(), "reviewed").otherwise("untouched").alias("origin"))


def pareto(rows: DataFrame, key: str, up: str, down: str) -> DataFrame:
    """Rows that no other row beats in both measures (higher ``up``, lower ``down``), by a running best instead of comparing pairs."""
    best = in_ranges(rows.groupBy(down).agg(F.max(up).alias(up)), [down], "pareto")
    parts = best.groupBy("range_").agg(F.max(up).alias("most"))
    earlier = parts.select("range_", F.max("most").over(Window.orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)).alias("earlier"))  # one row a range
    inside = F.max(up).over(Window.partitionBy("range_").orderBy("at_").rowsBetween(Window.unboundedPreceding, -1))
    front = best.withColumn("inside", inside).join(earlier, "range_").withColumn("before", F.greatest("inside", "earlier"))
    front = front.where(F.col("before").isNull() | (F.col(up) > F.col("before"))).select(up, down)
    return rows.join(front, [up, down]).select(key, up, down)


def review_queue(rows: DataFrame, cell: list[str], key: str, budget: int) -> DataFrame:
    """The ``budget`` rows of highest value: uncertainty plus rarity of the cell.  A top-k report."""
    sizes = rows.groupBy(*cell).agg(F.count("*").alias("cell_size"))
    valued = rows.join(F.broadcast(sizes), cell).withColumn("value", F.col("uncertainty") + 1 / F.sqrt("cell_size"))
    return valued.orderBy(F.round("value", 9).desc(), key).limit(budget).select(key, "value")
