"""Summaries of datasets and evaluations: audits, curves, sweeps, intervals."""

from __future__ import annotations

from functools import reduce

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .grouped import FRAME
from .nullsafe import join_same


def dataset_summary(ents: DataFrame) -> DataFrame:
    """Per split and domain: frames, videos, instances, posed instances, tracks; null tracks and points do not count."""
    posed = F.sum((F.col("head_x").isNotNull() & F.col("tail_x").isNotNull()).cast("int"))
    return ents.groupBy("split", "domain").agg(F.count_distinct("frame").alias("frames"), F.count_distinct("video").alias("videos"), F.count("*").alias("instances"), posed.alias("posed"), F.count_distinct("track_id").alias("tracks"))


def input_audit(dets: DataFrame, twins: DataFrame) -> DataFrame:
    """Per split: frames, boxes, median and 90th percentile of boxes a frame, median scale, share of boxes that nearly cover another one (``twins``: frame, det)."""
    counts = dets.groupBy("split", "frame").agg(F.count("*").alias("n"))
    frames = counts.groupBy("split").agg(F.count("*").alias("frames"), F.sum("n").alias("boxes"), F.percentile("n", F.lit(0.5)).alias("median_boxes"), F.percentile("n", F.lit(0.9)).alias("p90_boxes"))
    scale = F.sqrt((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1")))
    marked = dets.join(twins.select("frame", "det").distinct().withColumn("twin", F.lit(1)), ["frame", "det"], "left")
    sizes = marked.groupBy("split").agg(F.percentile(scale, F.lit(0.5)).alias("median_scale"), F.avg(F.coalesce("twin", F.lit(0))).alias("twin_rate"))
    return frames.join(sizes, "split")


def split_drift(dets: DataFrame, axis: str) -> DataFrame:
    """Per split the total variation between its shares of ``axis`` and those of all rows; null is a value of its own."""
    by = dets.groupBy("split", F.coalesce(F.col(axis).cast("string"), F.lit("unknown")).alias("value")).agg(F.count("*").alias("n"))
    whole = by.groupBy("value").agg(F.sum("n").alias("all"))
    totals = by.groupBy("split").agg(F.sum("n").alias("size"))
    total = by.agg(F.sum("n").alias("rows"))
    grid = whole.crossJoin(totals).crossJoin(total)  # values by splits: both are few
    rows = grid.join(by, ["split", "value"], "left")
    return rows.groupBy("split").agg((F.sum(F.abs(F.coalesce("n", F.lit(0)) / F.col("size") - F.col("all") / F.col("rows"))) / 2).alias("drift"))


def score_curve(rows: DataFrame, key: str, score: str, positive: Column) -> DataFrame:
    """Per key the point of the precision-recall curve with the best F1, and the area under the precision envelope.

    Equal scores are one point.  Rows without a score or a truth do not count; keys without a
    positive have no curve.  The curve of a key has one row for each different score.
    """
    known = rows.select(key, F.col(score).alias("score"), positive.cast("int").alias("hit")).where("score is not null and hit is not null")
    levels = known.groupBy(key, "score").agg(F.sum("hit").alias("tp"), F.count("*").alias("n"))
    down, whole = Window.partitionBy(key).orderBy(F.desc("score")), Window.partitionBy(key)
    curve = levels.select(key, "score", F.sum("tp").over(down).alias("tp"), F.sum("n").over(down).alias("n"), F.sum("tp").over(whole).alias("truths")).where("truths > 0")
    curve = curve.withColumns({"precision": F.col("tp") / F.col("n"), "recall": F.col("tp") / F.col("truths")})
    envelope = F.max("precision").over(down.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    curve = curve.withColumns({"envelope": envelope, "step": F.col("recall") - F.coalesce(F.lag("recall").over(down), F.lit(0.0)), "f1": 2 * F.col("precision") * F.col("recall") / F.greatest(F.col("precision") + F.col("recall"), F.lit(1e-12))})
    best = F.max(F.struct(F.round("f1", 9).alias("f1"), F.col("score").alias("score")))
    return curve.groupBy(key).agg(best.alias("b"), F.sum(F.col("envelope") * F.col("step")).alias("area")).select(key, F.col("b.f1").alias("best_f1"), F.col("b.score").alias("threshold"), "area")


def constrained_sweep(rows: DataFrame, scores: list[str], levels: list[float], positive: Column, slack: float = 0.01) -> DataFrame:
    """Recall and precision of every combination of least scores; those within ``slack`` of the best recall, ranked by precision.

    The grid is stated by the caller and small; each row is tested against it in one pass.
    """
    grid = [()]
    for _ in scores:
        grid = [(*g, v) for g in grid for v in levels]
    params = rows.sparkSession.createDataFrame(grid, ", ".join(f"least_{s} double" for s in scores))
    tested = rows.select(*(F.col(s).cast("double").alias(s) for s in scores), positive.cast("int").alias("hit")).where("hit is not null").crossJoin(F.broadcast(params))
    keep = reduce(lambda a, b: a & b, (F.coalesce(F.col(s) >= F.col(f"least_{s}"), F.lit(False)) for s in scores))
    names = [f"least_{s}" for s in scores]
    sums = tested.groupBy(*names).agg(F.sum("hit").alias("truths"), F.sum(F.when(keep, 1).otherwise(0)).alias("kept"), F.sum(F.when(keep, F.col("hit")).otherwise(0)).alias("tp"))
    rated = sums.select(*names, (F.col("tp") / F.greatest("truths", F.lit(1))).alias("recall"), (F.col("tp") / F.greatest("kept", F.lit(1))).alias("precision"))
    rated = rated.withColumn("most", F.max("recall").over(Window.partitionBy()))  # as many rows as the grid has
    rank = F.row_number().over(Window.orderBy(F.round("precision", 9).desc(), F.round("recall", 9).desc(), *names))
    return rated.where(F.col("recall") >= F.col("most") - slack).withColumn("rank", rank).drop("most")


def poisson_weight(key: Column, draw: Column) -> Column:
    """A Poisson(1) number that depends on ``key`` and ``draw`` alone."""
    u = F.conv(F.substring(F.md5(F.concat_ws("-", key.cast("string"), draw.cast("string"))), 1, 8), 16, 10).cast("long") / float(1 << 32)
    limits, total, term = [], 0.0, 0.36787944117144233
    for k in range(8):
        total += term
        limits.append(total)
        term /= k + 1
    return reduce(lambda c, k: F.when(u < limits[k], k).otherwise(c), reversed(range(len(limits))), F.lit(len(limits)))


def bootstrap_interval(rows: DataFrame, key: str, value: str, draws: int = 500, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """Mean of ``value`` over the rows of a small table (``key`` is unique) with its percentile interval.

    A Poisson bootstrap: every row enters each draw as often as a Poisson(1) number says, which
    needs no shuffle of the sample and repeats exactly.
    """
    known = rows.where(F.col(value).isNotNull()).select(key, F.col(value).cast("double").alias("v"))
    drawn = known.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws)))).withColumn("w", poisson_weight(F.col(key), F.col("draw")))
    means = drawn.groupBy("draw").agg((F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("m"))
    interval = means.agg(F.percentile("m", F.lit(low)).alias("low"), F.percentile("m", F.lit(high)).alias("high"))
    return known.agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.min("v").alias("worst")).crossJoin(interval)  # one row each


def evaluation_report(matches: DataFrame, keys: list[str], allowed: Column) -> DataFrame:
    """Per slice: truths, tp, recall, and the worst recall of all slices; a truth that people did not confirm (``allowed`` false) raises."""
    checked = matches.withColumn("hit", F.when(allowed, F.col("hit")).otherwise(F.raise_error(F.lit("unconfirmed truth in an evaluation")).cast("boolean")))
    slices = checked.groupBy(*keys).agg(F.count("*").alias("truths"), F.sum(F.col("hit").cast("int")).alias("tp"))
    rows = slices.withColumn("recall", F.col("tp") / F.col("truths"))
    return rows.crossJoin(rows.agg(F.min("recall").alias("worst_recall")))  # one row


def readback_audit(source: DataFrame, output: DataFrame, key: list[str], same: list[str], fps: float = 30.0, limit: float = 220.0) -> DataFrame:
    """One row: rows of both, missing, extra and changed ones (anything but the track differs), doubled tracks in a frame, steps faster than ``limit``, steps that go on in the same frame (not_later), and the 95th and 99th percentile of speeds by nearest rank."""
    a = source.select(*key, F.struct(*same).alias("was"))
    b = output.select(*key, F.struct(*same).alias("is_"))
    both = a.withColumn("in_a", F.lit(1)).join(b.withColumn("in_b", F.lit(1)), key, "full")
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    rows = both.agg(F.count("in_a").alias("source_rows"), F.count("in_b").alias("output_rows"), one(F.col("in_b").isNull()).alias("missing"), one(F.col("in_a").isNull()).alias("extra"), one(F.col("in_a").isNotNull() & F.col("in_b").isNotNull() & ~F.col("was").eqNullSafe(F.col("is_"))).alias("changed"))
    doubled = output.groupBy("video", "frame", "track_id").count().where("count > 1").agg(F.count("*").alias("doubled"))
    w = Window.partitionBy("video", "track_id").orderBy("frame", *[k for k in key if k != "frame"])
    mid = lambda p, q: (F.col(p) + F.col(q)) / 2
    steps = output.select((F.col("frame") - F.lag("frame").over(w)).alias("gap"), F.hypot(mid("x1", "x2") - F.lag(mid("x1", "x2")).over(w), mid("y1", "y2") - F.lag(mid("y1", "y2")).over(w)).alias("moved"))
    steps = steps.where("gap is not null").withColumn("speed", F.when(F.col("gap") > 0, F.col("moved") / F.col("gap") * fps))
    rank = lambda p: F.expr(f"percentile_disc({p}) within group (order by round(speed, 6))").alias(f"p{round(p * 100)}_speed")
    speeds = steps.agg(one(F.col("speed") > limit).alias("too_fast"), F.count_if(F.col("gap") <= 0).alias("not_later"), rank(0.95), rank(0.99))
    return rows.crossJoin(doubled).crossJoin(speeds)  # one row each


def endpoint_hits(rows: DataFrame, key: str, limits: tuple[float, ...] = (0.1, 0.2)) -> DataFrame:
    """Per key the share of true points with a predicted one within each limit, in box diagonals; a missing prediction is a miss.

    Rows have gx, gy (null where there is no true point), px, py and diag.
    """
    error = F.hypot(F.col("gx") - F.col("px"), F.col("gy") - F.col("py")) / F.greatest(F.col("diag"), F.lit(1e-6))
    hit = lambda limit: F.avg(F.when(F.coalesce(error < limit, F.lit(False)), 1.0).otherwise(0.0))
    return rows.where("gx is not null and gy is not null").groupBy(key).agg(F.count("*").alias("points"), *(hit(x).alias(f"pck_{str(x).replace('.', '_')}") for x in limits))


def behaviour_report(pred: DataFrame, truth: DataFrame) -> DataFrame:
    """Per class tp, fp, fn and f1 over events matched by event_id, with the macro mean and the share of predictions that name their evidence.

    A prediction of another class is a false positive of its own and a miss of the true class;
    events of one side only count for that side.
    """
    p = pred.select("event_id", F.col("label").alias("p"), F.col("evidence").isNotNull().cast("double").alias("e"))
    both = p.join(truth.select("event_id", F.col("label").alias("t")), "event_id", "full")
    same = F.coalesce(F.col("p") == F.col("t"), F.lit(False))
    sides = both.select(F.explode(F.array(F.struct(F.col("p").alias("label"), same.cast("int").alias("tp"), (~same).cast("int").alias("fp"), F.lit(0).alias("fn")), F.struct(F.col("t").alias("label"), F.lit(0).alias("tp"), F.lit(0).alias("fp"), (~same).cast("int").alias("fn")))).alias("s")).select("s.*").where("label is not null")
    rows = sides.groupBy("label").agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn")))
    rows = rows.withColumn("f1", 2 * F.col("tp") / F.greatest(2 * F.col("tp") + F.col("fp") + F.col("fn"), F.lit(1)))
    whole = rows.agg(F.avg("f1").alias("macro_f1")).crossJoin(p.agg(F.avg("e").alias("completeness")))  # one row
    return rows.crossJoin(whole)


def split_frame_gaps(frames: DataFrame, limit: int = 20) -> DataFrame:
    """Videos whose frames of different splits come within ``limit`` of each other: video, least_gap.

    Neighbours in frame order decide: the least gap between splits is between two neighbours.
    """
    w = Window.partitionBy("video").orderBy("frame", "split")
    rows = frames.select("video", "frame", "split").distinct()
    gap = F.when(F.lag("split").over(w) != F.col("split"), F.col("frame") - F.lag("frame").over(w))
    return rows.withColumn("gap", gap).groupBy("video").agg(F.min("gap").alias("least_gap")).where(F.col("least_gap") <= limit)


def near_by_length(ents: DataFrame, factor: float = 1.5, keys: Sequence[str] = FRAME) -> DataFrame:
    """Pairs of a frame whose centres lie within ``factor`` mean body lengths: keys, a, b, distance in mean lengths; entities without a length have none."""
    side = lambda s: ents.where("length > 0").select(*keys, F.col("det").alias(s), F.col("length").alias(f"{s}_l"), ((F.col("x1") + F.col("x2")) / 2).alias(f"{s}_x"), ((F.col("y1") + F.col("y2")) / 2).alias(f"{s}_y"))
    apart = F.hypot(F.col("a_x") - F.col("b_x"), F.col("a_y") - F.col("b_y"))
    mean = (F.col("a_l") + F.col("b_l")) / 2
    pairs = join_same(side("a"), side("b"), keys).where((F.col("a") < F.col("b")) & (apart <= factor * mean))
    return pairs.select(*keys, "a", "b", (apart / mean).alias("distance"))


def champion_decisions(candidates: DataFrame, champions: DataFrame, directions: dict[str, str], tolerances: dict[str, float] | None = None) -> DataFrame:
    """Which candidates replace their champions: candidate, promoted, reason and gains (metric to improvement, up to one that fails).

    Both tables have name, dataset, split, protocol and metrics (map of name to value); ``candidates`` also champion and status.  The
    first reason that holds: candidate_not_verified, then for dataset, split and protocol in turn missing_ or incomparable_, then for each
    of ``directions`` (max or min) in turn missing_metric_ or regression_ (beyond its tolerance); else pareto_improvement where a
    metric gains more than its tolerance, or no_material_gain.  An unknown champion is missing_dataset.
    """
    tolerances = tolerances or {}
    old = champions.select(F.col("name").alias("champion"), *(F.col(c).alias(f"old_{c}") for c in ("dataset", "split", "protocol", "metrics")))
    rows = candidates.join(old, "champion", "left")
    blank = lambda c: F.coalesce(F.col(c).cast("string") == "", F.lit(True))
    reason = F.when(F.coalesce(F.col("status") != "verified", F.lit(True)), "candidate_not_verified")
    for c in ("dataset", "split", "protocol"):
        reason = reason.when(blank(c) | blank(f"old_{c}"), f"missing_{c}").when(F.col(c) != F.col(f"old_{c}"), f"incomparable_{c}")
    gains = {}
    for metric, direction in directions.items():
        value = lambda m, k=metric: F.try_element_at(m, F.lit(k))
        gains[metric] = (value(F.col("metrics")) - value(F.col("old_metrics"))) * (1.0 if direction == "max" else -1.0)
        reason = reason.when(gains[metric].isNull(), f"missing_metric_{metric}").when(gains[metric] < -tolerances.get(metric, 0.0), f"regression_{metric}")
    better = F.lit(False)
    for metric, gain in gains.items():
        better = better | F.coalesce(gain > tolerances.get(metric, 0.0), F.lit(False))
    rows = rows.withColumn("reason", reason.when(better, "pareto_improvement").otherwise("no_material_gain"))
    names = list(gains)
    reached = lambda i: ~F.col("reason").isin([f"regression_{m}" for m in names[:i]])
    table = F.map_from_entries(F.filter(F.array(*(F.struct(F.lit(m).alias("key"), F.when(reached(i), gains[m]).alias("value")) for i, m in enumerate(names))), lambda e: e["value"].isNotNull()))
    compared = F.col("reason").startswith("regression_") | F.col("reason").isin("pareto_improvement", "no_material_gain")
    return rows.select(F.col("name").alias("candidate"), (F.col("reason") == "pareto_improvement").alias("promoted"), "reason", F.when(compared, table).alias("gains"))
