"""Label-side transforms: tiles, affine maps, snapping, temporal confirmation, frame tuples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .grouped import FRAME
from .nullsafe import join_same
from ..functions.geometry import iou
from .tracks import with_runs


def tile_starts(size: int, window: int, overlap: float) -> list[int]:
    """Sliding starts; the last tile is flush with the end."""
    step = max(1, int(window * (1 - overlap)))
    return sorted({*range(0, max(size - window, 0) + 1, step), max(size - window, 0)})


def tiles(dets: DataFrame, width: int, height: int, window: int, overlap: float = 0.2, least: float = 0.3) -> DataFrame:
    """Boxes cut to overlapping tiles where at least ``least`` of their area remains: tx, ty and tile coordinates.

    The tiles that a box can touch are exploded from its own coordinates.
    """
    c = F.col
    xs, ys = (F.array(*map(F.lit, tile_starts(n, window, overlap))) for n in (width, height))
    rows = dets.withColumn("tx", F.explode(F.filter(xs, lambda t: (t < c("x2")) & (t + window > c("x1")))))
    rows = rows.withColumn("ty", F.explode(F.filter(ys, lambda t: (t < c("y2")) & (t + window > c("y1")))))
    cut = {"cx1": F.greatest(c("x1"), c("tx")), "cy1": F.greatest(c("y1"), c("ty")), "cx2": F.least(c("x2"), c("tx") + window), "cy2": F.least(c("y2"), c("ty") + window)}
    rows = rows.withColumns(cut).withColumn("share", (c("cx2") - c("cx1")) * (c("cy2") - c("cy1")) / ((c("x2") - c("x1")) * (c("y2") - c("y1"))))
    return rows.where(F.col("share") >= least).select("frame", "det", "tx", "ty", (c("cx1") - c("tx")).alias("x1"), (c("cy1") - c("ty")).alias("y1"), (c("cx2") - c("tx")).alias("x2"), (c("cy2") - c("ty")).alias("y2"), "share")


def affine(dets: DataFrame, m: tuple[float, float, float, float, float, float], width: int, height: int) -> DataFrame:
    """Boxes around the mapped corners (x' = a x + b y + c, y' = d x + e y + f), cut to the image; degenerate ones go."""
    a, b, c0, d, e, f = m
    xs = [a * F.col(x) + b * F.col(y) + c0 for x in ("x1", "x2") for y in ("y1", "y2")]
    ys = [d * F.col(x) + e * F.col(y) + f for x in ("x1", "x2") for y in ("y1", "y2")]
    clip = lambda v, n: F.least(F.greatest(v, F.lit(0.0)), F.lit(float(n)))
    out = dets.select("frame", "det", clip(F.least(*xs), width).alias("x1"), clip(F.least(*ys), height).alias("y1"), clip(F.greatest(*xs), width).alias("x2"), clip(F.greatest(*ys), height).alias("y2"))
    return out.where("x2 > x1 and y2 > y1")


def snap(boxes: DataFrame, dets: DataFrame, least_iou: float = 0.2, radius: float = 45.0, keys: Sequence[str] = FRAME) -> DataFrame:
    """Each box takes the best overlapping detection of its frame, else the nearest centre within ``radius``: keys, det, to, how."""
    cols = ["det", "x1", "y1", "x2", "y2"]
    a = boxes.select(*keys, *(F.col(c).alias(f"a_{c}") for c in cols))
    b = dets.select(*keys, *(F.col(c).alias(f"b_{c}") for c in cols))
    mid = lambda p, x, y: (F.col(f"{p}_{x}") + F.col(f"{p}_{y}")) / 2
    dist = F.sqrt((mid("a", "x1", "x2") - mid("b", "x1", "x2")) ** 2 + (mid("a", "y1", "y2") - mid("b", "y1", "y2")) ** 2)
    pairs = join_same(a, b, keys, "left").withColumns({"iou": F.when(F.col("b_det").isNotNull(), F.round(iou("a_", "b_"), 9)), "dist": F.round(dist, 9)})
    best = pairs.groupBy(*keys, "a_det").agg(
        F.min(F.when(F.col("iou") >= least_iou, F.struct((-F.col("iou")).alias("k"), F.col("b_det").alias("to")))).alias("o"),
        F.min(F.when(F.col("dist") <= radius, F.struct(F.col("dist").alias("k"), F.col("b_det").alias("to")))).alias("n"),
    )
    how = F.when(F.col("o").isNotNull(), "overlap").when(F.col("n").isNotNull(), "nearest").otherwise("kept")
    return best.select(*keys, F.col("a_det").alias("det"), F.coalesce("o.to", "n.to").alias("to"), how.alias("how"))


def confirmed_pairs(near: DataFrame, reach: int = 2, least: int = 3, scope: Sequence[str] = ()) -> DataFrame:
    """Frames of a pair whose evidence holds in at least ``least`` of the frames f - reach .. f + reach."""
    w = Window.partitionBy(*scope, "a", "b").orderBy("frame").rangeBetween(-reach, reach)
    return near.select(*scope, "a", "b", "frame").distinct().withColumn("support", F.count("*").over(w)).where(F.col("support") >= least)


def mutual_nearest(near: DataFrame, keys: Sequence[str] = FRAME) -> DataFrame:
    """Pairs (keys, a, b, distance) that are each other's nearest, ties by id."""
    ends = near.select(*keys, F.col("a").alias("i"), F.col("b").alias("j"), "distance").unionByName(near.select(*keys, F.col("b").alias("i"), F.col("a").alias("j"), "distance"))
    first = ends.groupBy(*keys, "i").agg(F.min(F.struct(F.round("distance", 9).alias("d"), "j")).alias("n")).select(*keys, "i", F.col("n.j").alias("j"))
    back = first.select(*keys, F.col("i").alias("j"), F.col("j").alias("i"))
    return join_same(first, back, [*keys, "i", "j"]).where("i < j").select(*keys, F.col("i").alias("a"), F.col("j").alias("b"))


def causal_tuples(obs: DataFrame, key: str, order: list[str], value: str, n: int = 3) -> DataFrame:
    """The last ``n`` values by position, filled with the earliest at the start, and which of them are real."""
    w = Window.partitionBy(key).orderBy(*order)
    first = F.first(value).over(w.rowsBetween(Window.unboundedPreceding, 0))
    back = range(n - 1, 0, -1)
    real = sum((F.lag(value, k).over(w).isNotNull().cast("int") for k in back), F.lit(1))
    return obs.select(key, *order, *(F.coalesce(F.lag(value, k).over(w), first).alias(f"t{k}") for k in back), F.col(value).alias("t0"), real.alias("valid"))


def smooth(obs: DataFrame, value: str, limit: float = 2.0, max_gap: int = 1) -> DataFrame:
    """Gaussian mean (sigma 1, two neighbours each side, edges repeat) of a track's value, moved by at most ``limit``.

    Neighbours are of the same stretch without a gap of more than ``max_gap`` frames.
    """
    runs = with_runs(obs, max_gap)
    w = Window.partitionBy("track_id", "run").orderBy("frame", "event_id")
    weights = {0: 1.0, 1: 0.6065306597126334, 2: 0.1353352832366127}
    near = lambda k: F.coalesce(F.lag(value, k).over(w), F.lag(value, max(k - 1, 0)).over(w), F.col(value)) if k > 0 else F.coalesce(F.lead(value, -k).over(w), F.lead(value, max(-k - 1, 0)).over(w), F.col(value))
    mean = sum((near(k) * weights[abs(k)] for k in (-2, -1, 0, 1, 2)), F.lit(0.0)) / (weights[0] + 2 * weights[1] + 2 * weights[2])
    moved = F.least(F.greatest(mean - F.col(value), F.lit(-limit)), F.lit(limit))
    return runs.select("track_id", "frame", "event_id", (F.col(value) + moved).alias("smoothed"))


def cyclic_quota(rows: DataFrame, bucket: str, key: str, order: Column) -> DataFrame:
    """Every bucket repeated cyclically to the size of the largest: bucket, slot, key."""
    numbered = rows.select(bucket, key, (F.row_number().over(Window.partitionBy(bucket).orderBy(order, key)) - 1).alias("i_"))
    sizes = rows.groupBy(bucket).agg(F.count("*").alias("n_"))
    quota = sizes.agg(F.max("n_").alias("quota_"))
    turns = numbered.join(F.broadcast(sizes), bucket).join(F.broadcast(quota))
    repeats = F.sequence(F.lit(0), F.floor((F.col("quota_") - 1 - F.col("i_")) / F.col("n_")).cast("int"))
    return turns.select(bucket, key, "i_", "n_", F.explode(repeats).alias("k_")).select(bucket, (F.col("i_") + F.col("k_") * F.col("n_")).cast("long").alias("slot"), key)
