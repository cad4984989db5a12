"""Entropic optimal transport by alternating scaling of a sparse kernel, as a distributed iteration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import settle

#: The largest exponent and the least denominator.
LARGEST, LEAST = 700.0, 1e-300


def sinkhorn(costs: DataFrame, entropy: float = 0.2, iterations: int = 100, source: DataFrame | None = None, target: DataFrame | None = None) -> DataFrame:
    """The plan over the pairs of ``costs`` (i, j, cost): i, j, cost, mass.

    Pairs that are left out carry nothing.  ``source`` (i, mass) and ``target`` (j, mass) are the
    margins; without them all ends of a side weigh the same.  Each iteration scales the rows and
    then the columns of exp(-cost / entropy): two aggregates joined back by one end.  The scales
    are written out in every iteration, the kernel once.
    """
    kernel = settle(costs.where("cost is not null").select("i", "j", F.col("cost").cast("double").alias("cost")), "costs")
    kernel = kernel.withColumn("k", F.exp(-F.least(F.col("cost") / max(entropy, 1e-8), F.lit(LARGEST))))

    def margin(side: str, given: DataFrame | None) -> DataFrame:
        if given is not None:
            return given.select(side, F.col("mass").cast("double").alias("mass"))
        ends = kernel.select(side).distinct()
        n = ends.count()
        return ends.withColumn("mass", F.lit(1.0 / max(n, 1)))

    rows, columns = settle(margin("i", source), "rows"), settle(margin("j", target), "columns")
    v = columns.select("j", F.lit(1.0).alias("v"))
    u = rows.select("i", F.lit(1.0).alias("u"))
    for _ in range(iterations):
        met = kernel.join(v, "j").groupBy("i").agg(F.sum(F.col("k") * F.col("v")).alias("s"))
        u = settle(rows.join(met, "i").select("i", (F.col("mass") / F.greatest("s", F.lit(LEAST))).alias("u")), "scale")
        met = kernel.join(u, "i").groupBy("j").agg(F.sum(F.col("k") * F.col("u")).alias("s"))
        v = settle(columns.join(met, "j").select("j", (F.col("mass") / F.greatest("s", F.lit(LEAST))).alias("v")), "scale")
    return kernel.join(u, "i").join(v, "j").select("i", "j", "cost", (F.col("u") * F.col("k") * F.col("v")).alias("mass"))


def transport_cost(plan: DataFrame) -> DataFrame:
    """One row: mass and cost of a plan."""
    return plan.agg(F.sum("mass").alias("mass"), F.sum(F.col("mass") * F.col("cost")).alias("cost"))
