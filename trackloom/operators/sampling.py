"""Weights, target distributions, distribution distances and splits."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import settle
from .nullsafe import join_same


def ess_gini(rows: DataFrame, key: str, weight: str) -> DataFrame:
    """Effective sample size and Gini coefficient of a weight per key.

    Equal weights are summed before they are ranked; ranks within a tie contribute their sum.
    """
    per = rows.groupBy(key, F.col(weight).cast("double").alias("w")).agg(F.count("*").alias("m"))
    w = Window.partitionBy(key).orderBy("w")
    per = per.withColumn("before", F.sum("m").over(w) - F.col("m"))
    ranks = F.col("m") * F.col("before") + F.col("m") * (F.col("m") + 1) / 2
    out = per.groupBy(key).agg(F.sum("m").alias("n"), F.sum(F.col("w") * F.col("m")).alias("s"), F.sum(F.col("w") * F.col("w") * F.col("m")).alias("ss"), F.sum(F.col("w") * ranks).alias("r"))
    n, s = F.col("n"), F.col("s")
    return out.select(key, "n", F.when(F.col("ss") > 0, s * s / F.col("ss")).alias("ess"), F.when(s > 0, 2 * F.col("r") / (n * s) - (n + 1) / n).alias("gini"))


def target_distribution(app: DataFrame, bench: DataFrame, error: DataFrame, key: str, alpha: float = 1.0, beta: float = 0.3, gamma: float = 0.5) -> DataFrame:
    """app**alpha * bench**beta * exp(gamma * error) over the union of keys, floored at 1e-8 and normalised.  The key domain is small."""
    parts = [df.select(key, *(F.col(c).cast("double").alias(c) if c == own else F.lit(None).cast("double").alias(c) for c in ("app", "bench", "error"))) for own, df in (("app", app), ("bench", bench), ("error", error))]
    joined = reduce(DataFrame.unionByName, parts).groupBy(key).agg(*(F.max(c).alias(c) for c in ("app", "bench", "error")))  # null is a key of its own
    floor = lambda c: F.greatest(F.coalesce(F.col(c), F.lit(0.0)), F.lit(1e-8))
    raw = F.pow(floor("app"), F.lit(alpha)) * F.pow(floor("bench"), F.lit(beta)) * F.exp(gamma * F.coalesce(F.col("error"), F.lit(0.0)))
    rows = joined.withColumn("raw", raw)
    total = rows.agg(F.sum("raw").alias("total"))
    return rows.join(F.broadcast(total)).select(key, (F.col("raw") / F.col("total")).alias("target"))


def largest_remainder(shares: DataFrame, key: str, share: str, seats: int) -> DataFrame:
    """Hamilton apportionment of ``seats``: floors first, then the largest remainders, ties in key order.  One row per key."""
    total = shares.agg(F.sum(share).alias("total"))
    rows = shares.join(F.broadcast(total)).withColumn("exact", F.col(share) * seats / F.col("total")).withColumn("base", F.floor("exact"))
    left = seats - F.sum("base").over(Window.partitionBy())
    rank = F.row_number().over(Window.orderBy(F.round(F.col("exact") - F.col("base"), 9).desc(), key))
    return rows.withColumn("left", left).select(key, (F.col("base") + F.when(rank <= F.col("left"), 1).otherwise(0)).cast("long").alias("seats"))


def distribution_report(rows: DataFrame, axis: str, weight: Column, target: DataFrame) -> DataFrame:
    """Weighted shares of an axis against a target, and the total variation between them."""
    got = rows.groupBy(F.coalesce(F.col(axis), F.lit("unknown")).alias("value")).agg(F.sum(weight).alias("mass"))
    both = got.join(target.select(F.col(axis).alias("value"), "target"), "value", "full")
    both = both.withColumns({"mass": F.coalesce("mass", F.lit(0.0)), "target": F.coalesce("target", F.lit(0.0))})
    sums = both.agg(F.sum("mass").alias("m"), F.sum("target").alias("t"))
    shares = both.join(F.broadcast(sums)).select("value", (F.col("mass") / F.col("m")).alias("share"), (F.col("target") / F.col("t")).alias("target"))
    variation = shares.agg((F.sum(F.abs(F.col("share") - F.col("target"))) / 2).alias("total_variation"))
    return shares.join(F.broadcast(variation))


def repeat_factors(rows: DataFrame, axis: str, target: DataFrame, quality: Column, valid: Column, cap: float = 4.0) -> DataFrame:
    """sqrt(target / frequency) * quality within 0..cap, and 0 for rows that are not valid."""
    n = rows.groupBy(axis).agg(F.count("*").alias("freq"))
    total = n.agg(F.sum("freq").alias("all"))
    shares = n.join(F.broadcast(total)).select(axis, (F.col("freq") / F.col("all")).alias("share"))
    shares = join_same(shares, target, [axis], "left")
    factor = F.sqrt(F.coalesce("target", F.lit(0.0)) / F.col("share")) * quality
    return join_same(rows, F.broadcast(shares), [axis]).withColumn("factor", F.when(valid, F.least(F.greatest(factor, F.lit(0.0)), F.lit(cap))).otherwise(0.0))


def _cdf(rows: DataFrame, key: str, side: str, value: str) -> DataFrame:
    """Per key and value: both sides' cumulative shares and the distance to the next value."""
    counts = rows.groupBy(key, F.col(value).cast("double").alias("v")).agg(F.sum(F.when(F.col(side), 1).otherwise(0)).alias("na"), F.sum(F.when(F.col(side), 0).otherwise(1)).alias("nb"))
    w = Window.partitionBy(key).orderBy("v")
    whole = Window.partitionBy(key)
    fa = F.sum("na").over(w) / F.sum("na").over(whole)
    fb = F.sum("nb").over(w) / F.sum("nb").over(whole)
    return counts.select(key, "v", (fa - fb).alias("gap"), (F.lead("v").over(w) - F.col("v")).alias("step"))


def wasserstein_kuiper(rows: DataFrame, key: str, side: str, value: str) -> DataFrame:
    """Area between, and range of the difference of, the distribution functions of the two sides."""
    return _cdf(rows, key, side, value).groupBy(key).agg(F.sum(F.abs("gap") * F.coalesce("step", F.lit(0.0))).alias("wasserstein"), (F.greatest(F.max("gap"), F.lit(0.0)) - F.least(F.min("gap"), F.lit(0.0))).alias("kuiper"))


def circular_wasserstein(rows: DataFrame, key: str, side: str, angle: Column, bins: int = 72) -> DataFrame:
    """L1 distance of the binned circular distribution functions less the median of their difference."""
    width = 2 * 3.141592653589793 / bins
    binned = rows.withColumn("bin", F.least(F.floor(F.pmod(angle, F.lit(2 * 3.141592653589793)) / width), F.lit(bins - 1)).cast("int"))
    counts = binned.groupBy(key, "bin").agg(F.sum(F.when(F.col(side), 1).otherwise(0)).alias("na"), F.sum(F.when(F.col(side), 0).otherwise(1)).alias("nb"))
    dense = counts.select(key).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1)))).join(counts, [key, "bin"], "left").na.fill(0, ["na", "nb"])
    w, whole = Window.partitionBy(key).orderBy("bin"), Window.partitionBy(key)
    gaps = dense.withColumn("gap", F.sum("na").over(w) / F.sum("na").over(whole) - F.sum("nb").over(w) / F.sum("nb").over(whole))
    middle = gaps.groupBy(key).agg(F.median("gap").alias("middle"))
    return gaps.join(middle, key).groupBy(key).agg((F.sum(F.abs(F.col("gap") - F.col("middle"))) * width).alias("circular_wasserstein"))


def theil_sen(series: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """Median of pairwise slopes.  Series are short (checkpoints, windows); the pairs are an equality join on the key."""
    a = series.select(key, F.col(x).alias("xa"), F.col(y).alias("ya"))
    b = series.select(key, F.col(x).alias("xb"), F.col(y).alias("yb"))
    return a.join(b, key).where("xa < xb").groupBy(key).agg(F.median((F.col("yb") - F.col("ya")) / (F.col("xb") - F.col("xa"))).alias("slope"), F.count("*").alias("pairs"))


def _rake_on_cluster(cells: DataFrame, axes: list[str], targets: dict[str, dict[str | None, float]], cap: float, rounds: int) -> DataFrame:
    """The weights of a table of cells (axes, n) of any size: the passes of `raking_weights` as aggregates, written out pass by pass."""
    spark = cells.sparkSession
    kinds = dict(cells.dtypes)
    goal = {}
    for axis in axes:
        goal[axis] = spark.createDataFrame([(v, float(m)) for v, m in targets[axis].items()], f"{axis} {kinds[axis]}, goal double")
        for r in join_same(goal[axis].where("goal > 0"), cells.select(axis).distinct(), [axis], "left_anti").limit(1).collect():
            raise ValueError(f"{axis}={r[axis]} has a target but no rows")
    w = settle(cells.withColumn("w", F.lit(1.0)), "cells")
    total = F.col("w") * F.col("n")
    for _ in range(rounds):
        for axis in axes:
            mass = w.groupBy(axis).agg(F.sum(total).alias("got"))
            all_ = w.agg(F.sum(total)).first()[0]
            factor = join_same(mass, goal[axis], [axis], "left").select(axis, F.when(F.col("goal").isNotNull() & (F.col("got") > 0), F.col("goal") / (F.col("got") / max(all_ or 0.0, 1e-300))).otherwise(1.0).alias("f"))
            w = settle(join_same(w, factor, [axis]).select(*axes, "n", (F.col("w") * F.col("f")).alias("w")), "cells")
        w = w.withColumn("w", F.least("w", F.lit(cap)))
        sums = w.agg(F.sum("n").alias("n"), F.sum(total).alias("wn")).first()
        w = settle(w.withColumn("w", F.col("w") * ((sums["n"] or 0) / max(sums["wn"] or 0.0, 1e-12))), "cells")
    for _ in range(200):
        sums = w.agg(F.sum("n").alias("n"), F.sum(total).alias("wn"), F.sum(F.col("w") * total).alias("wwn"), F.max("w").alias("most")).first()
        if (sums["wn"] or 0.0) ** 2 / max(sums["wwn"] or 0.0, 1e-12) >= 0.5 * (sums["n"] or 0) and (sums["most"] or 0.0) <= cap + 1e-8:
            break
        w = settle(w.withColumn("w", 0.95 * F.col("w") + 0.05), "cells")
    return w.select(*axes, F.col("w").alias("weight"))


def raking_weights(rows: DataFrame, axes: list[str], targets: dict[str, dict[str | None, float]], cap: float = 4.0, rounds: int = 100, most_cells: int = 100_000, valid: Column | None = None) -> DataFrame:
    """Iterative proportional fitting to marginal targets, with cap, mean 1 and effective size at least half.

    Rows of one cell have one weight, so the iteration runs on the table of cells (distinct
    axis values): as arrays up to ``most_cells`` of them, beyond that as aggregates on the
    cluster, with the same weights but for rounding.  The weights are joined back.  Null is a
    value like any other, and ``None`` among the targets is its target.  Rows that are not ``valid``
    weigh 0 and count nowhere; with none that is, or a target without a valid row, the call raises.
    """
    if valid is not None:
        marked = settle(rows.withColumn("valid_", F.coalesce(valid, F.lit(False))), "marked")
        kept = marked.where("valid_").drop("valid_")
        if kept.isEmpty():
            raise ValueError("no valid rows")
        none = marked.where(~F.col("valid_")).drop("valid_").withColumn("weight", F.lit(0.0))
        return raking_weights(kept, axes, targets, cap, rounds, most_cells).unionByName(none)
    table = settle(rows.groupBy(*axes).agg(F.count("*").alias("count")), "cells")
    if table.count() > most_cells:
        found = _rake_on_cluster(table.withColumnRenamed("count", "n"), axes, targets, cap, rounds)
        return join_same(rows, found, axes, "left")
    cells = table.collect()
    cells = sorted(cells, key=lambda r: [(r[x] is not None, "" if r[x] is None else r[x]) for x in axes])
    n = np.array([r["count"] for r in cells], float)
    w = np.ones(len(cells))
    codes, masses = {}, {}
    for axis in axes:
        values = {x: k for k, x in enumerate(dict.fromkeys(r[axis] for r in cells))}
        codes[axis] = np.array([values[r[axis]] for r in cells], int)
        masses[axis] = np.full(len(values), np.nan)
        for value, mass in targets[axis].items():
            if value in values:
                masses[axis][values[value]] = mass
            elif mass > 0:
                raise ValueError(f"{axis}={value} has a target but no rows")
    for _ in range(rounds):
        for axis in axes:
            got = np.bincount(codes[axis], w * n, len(masses[axis])) / max((w * n).sum(), 1e-300)
            has = ~np.isnan(masses[axis]) & (got > 0)
            w *= np.where(has, masses[axis] / np.where(has, got, 1), 1)[codes[axis]]
        w = np.minimum(w, cap)
        w *= n.sum() / max((w * n).sum(), 1e-12)
    for _ in range(200):
        if (w * n).sum() ** 2 / max((w * w * n).sum(), 1e-12) >= 0.5 * n.sum() and w.max(initial=0) <= cap + 1e-8:
            break
        w = 0.95 * w + 0.05
    kind = dict(rows.dtypes)
    schema = ", ".join([*(f"_of_{i} {kind[x]}" for i, x in enumerate(axes)), "weight double"])
    found = rows.sparkSession.createDataFrame([(*(r[x] for x in axes), float(v)) for r, v in zip(cells, w, strict=True)], schema)
    same = [F.col(x).eqNullSafe(F.col(f"_of_{i}")) for i, x in enumerate(axes)]
    return rows.join(F.broadcast(found), same).drop(*(f"_of_{i}" for i in range(len(axes))))


def representative(rows: DataFrame, group: str, k: int, features: str, value: str, key: str) -> DataFrame:
    """Greedy choice of ``k`` rows a group: value plus distance from what is chosen (at most 10), on standardised features.

    ``features`` is an array column, ``key`` is unique in a group and decides ties, the least
    first.  Of a group of at most ``k`` rows all are taken, in the order of the key.  Each of
    the ``k`` rounds is a distributed arg-max; what is chosen is broadcast to the next one, so
    that a group may be of any size.
    """
    rows = rows.select(group, key, F.col(value).cast("double").alias("worth"), F.col(features).cast("array<double>").alias("x"))
    each = rows.select(group, F.posexplode("x").alias("i", "v")).groupBy(group, "i").agg(F.avg("v").alias("m"), F.greatest(F.stddev_pop("v"), F.lit(1e-9)).alias("s"))
    in_order = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("i", c))), lambda r: r[c])
    stats = each.groupBy(group).agg(in_order("m").alias("m"), in_order("s").alias("s")).withColumnRenamed(group, "_g")
    sizes = rows.groupBy(F.col(group).alias("_n")).agg(F.count("*").alias("size"))
    chosen = stats.join(sizes, F.col("_g").eqNullSafe(F.col("_n"))).select("_g", "m", "s", "size", F.array().cast(f"array<struct<key:{dict(rows.dtypes)[key]},z:array<double>>>").alias("chosen"))
    length = lambda a: F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, d: acc + d * d))
    minus = lambda a, b: F.zip_with(a, b, lambda p, q: p - q)
    for round_ in range(k):
        near = rows.join(F.broadcast(chosen), F.col(group).eqNullSafe(F.col("_g")))
        near = near.withColumn("z", F.zip_with(minus(F.col("x"), F.col("m")), F.col("s"), lambda d, s: d / s))
        far = F.array_min(F.transform("chosen", lambda c: length(minus(F.col("z"), c["z"])))) if round_ else None
        score = F.col("worth") + F.least(far, F.lit(10.0)) if round_ else F.col("worth") - 0.01 * length(F.col("z"))
        taken = F.exists("chosen", lambda c: c["key"] == F.col(key))
        # the least of the structs is the best row: not yet taken, of the highest score, of the least key
        best = F.min(F.struct(taken.alias("taken"), F.when(F.col("size") <= k, 0.0).otherwise(-score).alias("score"), F.col(key).alias("key"), F.col("z").alias("z")))
        found = near.groupBy("_g").agg(best.alias("best"), *(F.first(c).alias(c) for c in ("m", "s", "size", "chosen")))
        grown = F.concat("chosen", F.array(F.struct(F.col("best.key").alias("key"), F.col("best.z").alias("z"))))
        chosen = found.select("_g", "m", "s", "size", F.when(F.col("best.taken"), F.col("chosen")).otherwise(grown).alias("chosen"))
    out = chosen.select(F.col("_g").alias(group), F.posexplode("chosen").alias("rank", "c"))
    return out.select(group, F.col("c.key").alias(key), (F.col("rank") + 1).cast("long").alias("rank"))


def mmd(rows: DataFrame, side: str, features: list[str], sigma: float = 1.0) -> DataFrame:
    """Biased maximum mean discrepancy of two samples with a Gaussian kernel, from random Fourier features.

    Sums of kernel features replace the quadratic comparison of all pairs; with the fixed 256
    frequencies the error is about 1/16 of the largest kernel value.
    """
    rng = np.random.default_rng(3407)
    freq, phase = rng.normal(0, 1 / sigma, (256, len(features))), rng.uniform(0, 2 * np.pi, 256)

    def lift(batches):
        for b in batches:
            z = np.sqrt(2 / 256) * np.cos(b[features].to_numpy(float) @ freq.T + phase)
            for s in (True, False):
                m = (b[side] == s).to_numpy()
                if m.any():
                    yield pd.DataFrame({"side": [s], "n": [int(m.sum())], "z": [z[m].sum(0).tolist()]})

    sums = rows.select(side, *features).mapInPandas(lift, "side boolean, n long, z array<double>")
    parts = sums.select("side", "n", F.posexplode("z").alias("i", "z")).groupBy("i", "side").agg((F.sum("z") / F.sum("n")).alias("mean"))
    return parts.groupBy("i").agg((F.sum(F.when(F.col("side"), F.col("mean"))) - F.sum(F.when(~F.col("side"), F.col("mean")))).alias("d")).agg(F.sum(F.col("d") * F.col("d")).alias("mmd"))
