"""Per-track analytics: kinematics, runs, gap filling, crossings, pair persistence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _along(*keys: str):
    return Window.partitionBy(*keys).orderBy("frame", "event_id")


def kinematics(obs: DataFrame, max_gap: int = 10, keys: tuple[str, ...] = ("track_id",)) -> DataFrame:
    """Displacement, speed, heading and turn against the previous observation of the track.

    Null where there is none or the frame difference is not in 1..``max_gap``.
    """
    w = _along(*keys)
    df = F.col("frame") - F.lag("frame").over(w)
    ok = (df > 0) & (df <= max_gap)
    dx, dy = F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)
    out = obs.withColumns({"gap": df, "dx": F.when(ok, dx), "dy": F.when(ok, dy)})
    out = out.withColumns({"speed": F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")) / F.col("gap"), "heading": F.when((F.col("dx") != 0) | (F.col("dy") != 0), F.atan2("dy", "dx"))})
    turn = F.col("heading") - F.lag("heading").over(w)
    return out.withColumn("turn", F.atan2(F.sin(turn), F.cos(turn)))


def with_runs(obs: DataFrame, max_gap: int = 10, keys: tuple[str, ...] = ("track_id",)) -> DataFrame:
    """Adds run: numbers of the stretches of a track without a gap of more than ``max_gap`` frames, from 1."""
    w = _along(*keys)
    starts = F.coalesce((F.col("frame") - F.lag("frame").over(w) > max_gap).cast("int"), F.lit(1))
    return obs.withColumn("starts", starts).withColumn("run", F.sum("starts").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("starts")


def gap_runs(obs: DataFrame, max_gap: int = 10, keys: tuple[str, ...] = ("track_id",)) -> DataFrame:
    """Runs without a gap of more than ``max_gap`` frames: first and last frame, observations, path."""
    return with_runs(obs, max_gap, keys).groupBy(*keys, "run").agg(F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"), F.count("*").alias("n"))


def motion_lag(obs: DataFrame, lag: int = 5, max_gap: int = 10) -> DataFrame:
    """As-of backward join: the latest observation of the same run at least ``lag`` frames before."""
    numbered = with_runs(obs, max_gap)
    before = Window.partitionBy("track_id", "run").orderBy("frame").rangeBetween(Window.unboundedPreceding, -lag)
    past = F.max(F.struct("frame", "event_id", "x", "y")).over(before)
    out = numbered.withColumn("past", past)
    dist = F.sqrt((F.col("x") - F.col("past.x")) ** 2 + (F.col("y") - F.col("past.y")) ** 2)
    return out.select("track_id", "frame", "event_id", F.col("past.frame").alias("past_frame"), (dist / (F.col("frame") - F.col("past.frame"))).alias("speed"))


def line_crossings(obs: DataFrame, level: Column, value: Column, max_gap: int = 10) -> DataFrame:
    """Changes of side of a line between consecutive observations; a point on the line keeps the last side."""
    w = _along("track_id")
    side = F.signum(value - level).cast("int")
    rows = obs.withColumn("side", F.when(side != 0, side))
    rows = rows.withColumn("was", F.last("side", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))).withColumn("gap", F.col("frame") - F.lag("frame").over(w))
    crossed = rows.where((F.col("side") != F.col("was")) & F.col("gap").between(1, max_gap))
    return crossed.select("track_id", "frame", "event_id", F.when(F.col("side") > 0, "in").otherwise("out").alias("direction"))


def interpolate(dets: DataFrame, frames: DataFrame, max_gap: int = 90) -> DataFrame:
    """Fills between neighbours of a track: linear boxes in existing frames where the track has none.

    ``dets`` has scope, track_id, frame and box; ``frames`` has scope and frame.  Only gaps of
    at most ``max_gap`` frames are filled, nothing is extrapolated.
    """
    w = Window.partitionBy("scope", "track_id").orderBy("frame")
    ends = dets.select("scope", "track_id", "frame", *(F.col(c) for c in ("x1", "y1", "x2", "y2")), F.lead(F.struct("frame", "x1", "y1", "x2", "y2")).over(w).alias("next"))
    gap = F.col("next.frame") - F.col("frame")
    wide = ends.where((gap > 1) & (gap <= max_gap)).withColumn("at", F.explode(F.sequence(F.col("frame") + 1, F.col("next.frame") - 1)))
    share = (F.col("at") - F.col("frame")) / (F.col("next.frame") - F.col("frame"))
    filled = wide.select("scope", "track_id", F.col("at").alias("frame"), *((F.col(c) + share * (F.col(f"next.{c}") - F.col(c))).alias(c) for c in ("x1", "y1", "x2", "y2")))
    return filled.join(frames.select("scope", "frame").distinct(), ["scope", "frame"], "left_semi").join(dets.select("scope", "track_id", "frame").distinct(), ["scope", "track_id", "frame"], "left_anti")


def track_windows(obs: DataFrame, grid: int = 20, extent: float = 100.0, body: float = 10.0) -> DataFrame:
    """Per track: observations, cells visited of a ``grid`` x ``grid`` raster, first frame a body length from the start, path, net distance, tortuosity, radius of gyration."""
    w = _along("track_id")
    first = Window.partitionBy("track_id").orderBy("frame", "event_id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    step = F.sqrt((F.col("x") - F.lag("x").over(w)) ** 2 + (F.col("y") - F.lag("y").over(w)) ** 2)
    rows = obs.withColumns({"step": step, "x0": F.first("x").over(first), "y0": F.first("y").over(first), "xn": F.last("x").over(first), "yn": F.last("y").over(first)})
    rows = rows.withColumn("away", F.sqrt((F.col("x") - F.col("x0")) ** 2 + (F.col("y") - F.col("y0")) ** 2)).withColumn("net", F.sqrt((F.col("xn") - F.col("x0")) ** 2 + (F.col("yn") - F.col("y0")) ** 2))
    cell = F.floor(F.col("x") / (extent / grid)) * grid + F.floor(F.col("y") / (extent / grid))
    out = rows.groupBy("track_id").agg(
        F.count("*").alias("n"), F.count_distinct(cell).alias("cells"), F.min(F.when(F.col("away") >= body, F.col("frame"))).alias("first_passage"),
        F.sum("step").alias("path"), F.max("net").alias("net"), F.sqrt(F.var_pop("x") + F.var_pop("y")).alias("gyration"),
    )
    return out.select("track_id", "n", "cells", (F.col("cells") / (grid * grid)).alias("coverage"), "first_passage", "path", "net", F.when(F.col("net") > 0, F.col("path") / F.col("net")).alias("tortuosity"), "gyration")


def radius_pairs(obs: DataFrame, radius: float, at: str = "frame") -> DataFrame:
    """Pairs of different tracks of one frame closer than ``radius``: a grid of that cell size prunes by equality.

    Each point is sent to the 3 x 3 cells around its own; the other side stays in its cell.
    """
    cx, cy = F.floor(F.col("x") / radius), F.floor(F.col("y") / radius)
    left = obs.select(at, F.col("track_id").alias("a"), F.col("event_id").alias("a_id"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.explode(F.sequence(cx - 1, cx + 1)).alias("cx"), cy.alias("cy0"))
    left = left.withColumn("cy", F.explode(F.sequence(F.col("cy0") - 1, F.col("cy0") + 1))).drop("cy0")
    right = obs.select(at, F.col("track_id").alias("b"), F.col("event_id").alias("b_id"), F.col("x").alias("bx"), F.col("y").alias("by"), cx.alias("cx"), cy.alias("cy"))
    d = F.sqrt((F.col("ax") - F.col("bx")) ** 2 + (F.col("ay") - F.col("by")) ** 2)
    return left.join(right, [at, "cx", "cy"]).where((F.col("a") < F.col("b")) & (d < radius)).select(at, "a", "b", "a_id", "b_id", d.alias("distance"))


def pair_persistence(near: DataFrame, max_gap: int = 10) -> DataFrame:
    """Episodes of a pair: near frames that follow each other within ``max_gap`` frames."""
    rows = near.select("a", "b", "frame").distinct()
    w = Window.partitionBy("a", "b").orderBy("frame")
    rows = rows.withColumn("starts", F.coalesce((F.col("frame") - F.lag("frame").over(w) > max_gap).cast("int"), F.lit(1)))
    rows = rows.withColumn("episode", F.sum("starts").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("a", "b", "episode").agg(F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"), F.count("*").alias("n"))


def track_geometry(dets: DataFrame) -> DataFrame:
    """Change of a track's box against its previous one: offsets in diagonals, log size ratios."""
    w = Window.partitionBy("track_id").orderBy("frame", "det")
    was = F.lag(F.struct("x1", "y1", "x2", "y2")).over(w)
    rows = dets.withColumn("was", was).where("was is not null")
    wide, high = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    w0, h0 = F.col("was.x2") - F.col("was.x1"), F.col("was.y2") - F.col("was.y1")
    diag = F.sqrt(w0 * w0 + h0 * h0)
    cx, cy = (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2
    px, py = (F.col("was.x1") + F.col("was.x2")) / 2, (F.col("was.y1") + F.col("was.y2")) / 2
    return rows.select("track_id", "frame", "det", ((cx - px) / diag).alias("dx"), ((cy - py) / diag).alias("dy"), F.log(wide / w0).alias("dw"), F.log(high / h0).alias("dh"))


def track_features(ents: DataFrame, track: list[str], order: list[str], frame: str = "frame") -> DataFrame:
    """Adds track_geometry (six numbers), geometry_mask and axis_mask to boxes with points, against the track's last box of an earlier row in ``order``.

    The numbers: offset of the centre in diagonals of that box (1 at least), log ratios of width and height, direction from head to tail.
    The direction counts only where both points are seen and apart, and is (0, 0) elsewhere.  Rows without a track, first ones and
    ones of the same frame as the last give null and false, as do boxes without area.
    """
    w = Window.partitionBy(*track).orderBy(*order)
    num = lambda c: F.col(c).cast("double")
    was = F.lag(F.struct(F.col(frame).alias("f"), *(num(c).alias(c) for c in ("x1", "y1", "x2", "y2")))).over(w)
    rows = ents.withColumn("was_", was)
    wide, high = num("x2") - num("x1"), num("y2") - num("y1")
    w0, h0 = F.col("was_.x2") - F.col("was_.x1"), F.col("was_.y2") - F.col("was_.y1")
    mask = F.coalesce(F.col(track[-1]).isNotNull() & (F.col(frame) > F.col("was_.f")) & (w0 > 0) & (h0 > 0) & (wide > 0) & (high > 0), F.lit(False))
    scale = F.greatest(F.hypot(w0, h0), F.lit(1.0))
    centre = lambda a, b: (num(a) + num(b) - F.col(f"was_.{a}") - F.col(f"was_.{b}")) / 2 / scale
    seen = lambda p: F.col(f"{p}_x").isNotNull() & F.coalesce(F.col(f"{p}_c") > 0, F.lit(True))
    dx, dy = num("tail_x") - num("head_x"), num("tail_y") - num("head_y")
    axis = mask & F.coalesce(seen("head") & seen("tail") & (F.hypot(dx, dy) > 1e-6), F.lit(False))
    along = lambda d: F.when(axis, d / F.hypot(dx, dy)).otherwise(0.0)
    values = F.array(centre("x1", "x2"), centre("y1", "y2"), F.log(wide / w0), F.log(high / h0), along(dx), along(dy))
    return rows.withColumns({"track_geometry": F.when(mask, values), "geometry_mask": mask, "axis_mask": axis}).drop("was_")


def identity_switches(matches: DataFrame) -> DataFrame:
    """Per true track: matched frames, changes of the predicted id, and returns after a gap."""
    w = Window.partitionBy("gt_id").orderBy("frame", "det")
    rows = matches.withColumn("was", F.lag("pred_id").over(w)).withColumn("gap", F.col("frame") - F.lag("frame").over(w))
    return rows.groupBy("gt_id").agg(F.count("*").alias("n"), F.sum(F.coalesce((F.col("pred_id") != F.col("was")).cast("int"), F.lit(0))).alias("switches"), F.sum(F.coalesce((F.col("gap") > 100).cast("int"), F.lit(0))).alias("fragments"))
