"""Rules that review evidence rests on: how far each is supported, and what one more review of it would tell."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .nullsafe import join_same


def with_knowledge(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Adds knowledge_support and knowledge_gain to rows of knowledge_id, domain and video.

    ``nodes`` has once each id, with alpha, beta (of its Beta state), domains and videos (where it was validated; both arrays).
    Support is its mean; gain the expected drop of variance by one review, 36 ab / ((a+b)^2 (a+b+1)^2), a quarter more
    in a video where it was not validated, and 1 at most.  A rule that is unknown or not of the domain has 0.5 and 1; null domains
    (of either side) fit all, and a row without a video gets no quarter.
    """
    rules = nodes.select(F.col("id").alias("knowledge_id"), F.col("alpha").cast("double").alias("a_"), F.col("beta").cast("double").alias("b_"), F.col("domains").alias("domains_"), F.col("videos").alias("videos_"))
    found = join_same(rows, rules, ["knowledge_id"], "left")
    fits = F.col("a_").isNotNull() & (F.col("domain").isNull() | F.col("domains_").isNull() | F.coalesce(F.array_contains("domains_", F.col("domain")), F.lit(False)))
    total = F.col("a_") + F.col("b_")
    known = F.coalesce(F.array_contains("videos_", F.col("video")), F.col("video").isNull())
    gain = 36 * F.col("a_") * F.col("b_") / (total * total * (total + 1) ** 2) * F.when(known, 1.0).otherwise(1.25)
    out = found.withColumns({"knowledge_support": F.when(fits, F.col("a_") / total).otherwise(0.5), "knowledge_gain": F.when(fits, F.least(gain, F.lit(1.0))).otherwise(1.0)})
    return out.drop("a_", "b_", "domains_", "videos_")


def supported_events(events: DataFrame, nodes: DataFrame) -> DataFrame:
    """Events (knowledge_source, domain, video, evidence_confidence) with their rule: visual_evidence_confidence keeps the seen value, evidence_confidence is that by the support; null stays null."""
    rows = with_knowledge(events.withColumnRenamed("knowledge_source", "knowledge_id"), nodes)
    seen = F.col("evidence_confidence")
    return rows.withColumns({"visual_evidence_confidence": seen, "evidence_confidence": seen * F.col("knowledge_support")})


def colony_reviews_due(findings: DataFrame, nodes: DataFrame, rule: str = "colony_temporal_change") -> DataFrame:
    """One row a window of scopes with domain and video: findings, reason, support, gain and priority (greatest |z| weighed by support, plus gain)."""
    window = ["domain", "video", "grp", "window_index"]
    g = findings.groupBy(*window).agg(F.count("*").alias("findings"), F.max(F.abs(F.coalesce("z", F.lit(0.0)))).alias("most"), F.max((F.col("status") == "visual_change").cast("int")).alias("seen"))
    rows = with_knowledge(g.withColumn("knowledge_id", F.lit(rule)), nodes)
    priority = F.col("most") * (0.5 + 0.5 * F.col("knowledge_support")) + F.col("knowledge_gain")
    return rows.select(*window, "findings", F.when(F.col("seen") == 1, "colony_temporal_change").otherwise("colony_observability_check").alias("reason"), "knowledge_support", "knowledge_gain", priority.alias("priority"))
