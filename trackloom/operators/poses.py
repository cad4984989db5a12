"""Two-point poses: errors, correct-keypoint shares, head and tail decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import wrap


def _dist(ax: str, ay: str, bx: str, by: str) -> Column:
    return F.sqrt((F.col(ax) - F.col(bx)) ** 2 + (F.col(ay) - F.col(by)) ** 2)


def pose_errors(rows: DataFrame) -> DataFrame:
    """Adds nme (mean point error in body lengths), swapped_nme, angle_error for truth (gh*, gt*) and prediction (ph*, pt*)."""
    body = F.greatest(_dist("ghx", "ghy", "gtx", "gty"), F.lit(1e-9))
    nme = (_dist("phx", "phy", "ghx", "ghy") + _dist("ptx", "pty", "gtx", "gty")) / (2 * body)
    swapped = (_dist("ptx", "pty", "ghx", "ghy") + _dist("phx", "phy", "gtx", "gty")) / (2 * body)
    angle = F.atan2(F.col("phy") - F.col("pty"), F.col("phx") - F.col("ptx")) - F.atan2(F.col("ghy") - F.col("gty"), F.col("ghx") - F.col("gtx"))
    return rows.withColumns({"head_error": _dist("phx", "phy", "ghx", "ghy") / body, "tail_error": _dist("ptx", "pty", "gtx", "gty") / body, "nme": nme, "swapped_nme": swapped, "angle_error": F.abs(wrap(angle))})


def pose_metrics(rows: DataFrame, key: str, limit: float = 0.1) -> DataFrame:
    """Per key: mean NME, share of endpoints and of pairs within ``limit`` (strictly), mean angle error, swap rate."""
    e = pose_errors(rows)
    head, tail = F.when(F.col("head_error") < limit, 1.0).otherwise(0.0), F.when(F.col("tail_error") < limit, 1.0).otherwise(0.0)
    return e.groupBy(key).agg(
        F.count("*").alias("n"), F.avg("nme").alias("nme"), ((F.avg(head) + F.avg(tail)) / 2).alias("pck_endpoint"), F.avg(head * tail).alias("pck_pair"),
        F.avg("angle_error").alias("angle_mae"), F.avg(F.when(F.col("swapped_nme") < F.col("nme"), 1.0).otherwise(0.0)).alias("swap_rate"),
    )


def head_tail_decisions(rows: DataFrame, margin: float = 0.1) -> DataFrame:
    """keep where the given order is clearly better, swap where the other is, else review."""
    e = pose_errors(rows)
    d = F.col("swapped_nme") - F.col("nme")
    return e.withColumn("decision", F.when(d > margin, "keep").when(d < -margin, "swap").otherwise("review"))


def track_vote(decisions: DataFrame, key: str) -> DataFrame:
    """Majority per track with its share; equal counts go to review."""
    g = decisions.groupBy(key).agg(F.count("*").alias("n"), F.sum((F.col("decision") == "keep").cast("int")).alias("keep"), F.sum((F.col("decision") == "swap").cast("int")).alias("swap"))
    return g.select(key, "n", F.when(F.col("keep") > F.col("swap"), "keep").when(F.col("swap") > F.col("keep"), "swap").otherwise("review").alias("vote"), (F.greatest("keep", "swap") / F.col("n")).alias("share"))


def smoothed_points(obs: DataFrame, track: list[str], order: list[str], swapped: Column | None = None) -> DataFrame:
    """Head and tail mended along tracks of at least three rows: adds undone, turned and smoothed (booleans) and replaces the points.

    First a swap that was made by colour (``swapped``) is undone where the direction is against the mean of its neighbours' (undone);
    then a direction against both of its like neighbours (their cosine above 0.5, its own to their sum below -0.15)
    is turned; last every inner row moves half way to the median of three of its points relative to the box.  Each step
    sees what the one before has left.  Rows without both points or a box with area take no part and stay as they are.
    """
    xy = ["head_x", "head_y", "tail_x", "tail_y"]
    whole = F.lit(True)
    for c in xy:
        whole = whole & F.col(c).isNotNull()
    whole = F.coalesce(whole & (F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1")), F.lit(False))
    w, every = Window.partitionBy(*track).orderBy(*order), Window.partitionBy(*track)
    rows = obs.where(whole).withColumns({c: F.col(c).cast("double") for c in xy} | {"n_": F.count("*").over(every), "by_colour_": F.coalesce(swapped, F.lit(False)) if swapped is not None else F.lit(False)})
    dx, dy = F.col("tail_x") - F.col("head_x"), F.col("tail_y") - F.col("head_y")
    long = F.greatest(F.sqrt(dx * dx + dy * dy), F.lit(1e-9))
    unit = {"ux_": dx / long, "uy_": dy / long}
    near = {f"{c}{s}": f(f"{c}_").over(w) for c in ("ux", "uy") for s, f in (("a_", F.lag), ("b_", F.lead))}
    c = F.col
    turn = lambda df, when: df.withColumns({a: F.when(when, c(b)).otherwise(c(a)) for a, b in (("head_x", "tail_x"), ("head_y", "tail_y"), ("tail_x", "head_x"), ("tail_y", "head_y"))})
    dot = lambda s: c("ux_") * c(f"ux{s}") + c("uy_") * c(f"uy{s}")
    rows = rows.withColumns(unit).withColumns(near)
    none = lambda v: F.coalesce(v, F.lit(0.0))
    rows = rows.withColumn("undone", (c("n_") >= 3) & c("by_colour_") & (none(dot("a_")) + none(dot("b_")) < 0))
    rows = turn(rows, c("undone")).withColumns(unit).withColumns(near)
    sx, sy = c("uxa_") + c("uxb_"), c("uya_") + c("uyb_")
    norm = F.greatest(F.sqrt(sx * sx + sy * sy), F.lit(1e-9))
    alike = c("uxa_") * c("uxb_") + c("uya_") * c("uyb_") > 0.5
    rows = rows.withColumn("turned", F.coalesce(alike & ((c("ux_") * sx + c("uy_") * sy) / norm < -0.15), F.lit(False)))
    rows = turn(rows, c("turned"))
    side = {"x": ("x1", c("x2") - c("x1")), "y": ("y1", c("y2") - c("y1"))}
    rows = rows.withColumns({f"{p}_r": (c(p) - c(side[p[-1]][0])) / side[p[-1]][1] for p in xy})
    rows = rows.withColumns({f"{p}_m": F.sort_array(F.array(F.lag(f"{p}_r").over(w), c(f"{p}_r"), F.lead(f"{p}_r").over(w)))[1] for p in xy} | {"smoothed": F.lag(F.lit(1)).over(w).isNotNull() & F.lead(F.lit(1)).over(w).isNotNull()})
    rows = rows.withColumns({p: F.when(c("smoothed"), c(side[p[-1]][0]) + (c(f"{p}_r") + c(f"{p}_m")) / 2 * side[p[-1]][1]).otherwise(c(p)) for p in xy})
    off = F.lit(False)
    rest = obs.where(~whole).withColumns({p: c(p).cast("double") for p in xy} | {"undone": off, "turned": off, "smoothed": off})
    return rows.select(*rest.columns).unionByName(rest)
