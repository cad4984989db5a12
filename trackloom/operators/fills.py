"""Fills between the boxes of a track that motion bounds, and that no box of their frame covers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .grouped import per_group, typed
from .matching import unhidden
from .nullsafe import join_same

BOX = ["x1", "y1", "x2", "y2"]


def fill_candidates(dets: DataFrame, frames: DataFrame, max_gap: int = 150, near_gap: int = 30, thin: float = 6.0) -> DataFrame:
    """Linear boxes for the frames that a track misses: scope, track_id, frame, x1..y2, before, missing.

    Up to ``near_gap`` missing frames the ends may lie 8 pixels and 2 a frame apart (40 at most) and differ twofold in size; up to ``max_gap``
    they must be nearly at rest: 16 pixels and 0.35 of the smaller diagonal at most, sizes 1.5fold.  Sizes are compared side by side.  Boxes whose
    sides differ ``thin``fold are left out.  ``dets`` has scope, track_id, frame, x1..y2, one box a frame; ``frames`` the frames of each scope.
    """
    w = Window.partitionBy("scope", "track_id").orderBy("frame")
    rows = dets.where("track_id is not null").select("scope", "track_id", "frame", *(F.col(c).cast("double").alias(c) for c in BOX))
    rows = rows.withColumn("next", F.lead(F.struct("frame", *BOX)).over(w)).withColumn("missing", F.col("next.frame") - F.col("frame") - 1).where(F.col("missing").between(1, max_gap))
    a = {c: F.col(c) for c in BOX}
    b = {c: F.col(f"next.{c}") for c in BOX}
    distance = F.hypot((b["x1"] + b["x2"] - a["x1"] - a["x2"]) / 2, (b["y1"] + b["y2"] - a["y1"] - a["y2"]) / 2)
    side = lambda of, p: of[f"{p}2"] - of[f"{p}1"]
    diagonal = F.least(*(F.hypot(side(of, "x"), side(of, "y")) for of in (a, b)))
    one = F.lit(1.0)
    ratio = F.greatest(*(side(u, p) / F.greatest(side(v, p), one) for u, v in ((a, b), (b, a)) for p in "xy"))
    near = (F.col("missing") <= near_gap) & (distance <= F.least(F.lit(40.0), 8 + 2.0 * (F.col("missing") + 1))) & (ratio <= 2)
    still = (F.col("missing") > near_gap) & (distance <= F.least(F.lit(16.0), 0.35 * diagonal)) & (ratio <= 1.5)
    wide = rows.where(near | still).withColumn("at", F.explode(F.sequence(F.col("frame") + 1, F.col("next.frame") - 1)))
    share = (F.col("at") - F.col("frame")) / (F.col("next.frame") - F.col("frame"))
    made = wide.select("scope", "track_id", F.col("at").alias("frame"), *((a[c] + share * (b[c] - a[c])).alias(c) for c in BOX), F.col("frame").alias("before"), "missing")
    x, y = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    made = made.where(F.greatest(x, y) < thin * F.least(x, y))
    return join_same(made, frames.select("scope", "frame").distinct(), ["scope", "frame"], "left_semi")


def bounded_fills(dets: DataFrame, frames: DataFrame, overlap: float = 0.8, **bounds) -> DataFrame:
    """``fill_candidates`` with accepted: by falling area (then track) a fill is taken unless a box of its frame, or a fill taken before, shares ``overlap`` of the smaller one.

    Boxes that are there are never removed, those without a track included.
    """
    found = fill_candidates(dets, frames, **bounds)
    kinds = dict(found.dtypes)
    blank = lambda c: F.lit(0).cast(kinds[c]).alias(c)
    there = dets.select("scope", "frame", blank("track_id"), *(F.col(c).cast("double").alias(c) for c in BOX), blank("before"), blank("missing"), F.lit(True).alias("there"))
    met = join_same(there, found.select("scope", "frame").distinct(), ["scope", "frame"], "left_semi").unionByName(found.withColumn("there", F.lit(False)))
    area = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))

    def fold(g):
        there = g["there"].astype(bool)
        boxes = np.stack([g[c] for c in BOX], axis=1).astype(float)
        at = np.flatnonzero(~there)
        kept = unhidden(boxes, there, np.ones(len(boxes), bool), overlap, "io_min", named=False)[0]
        return {**{c: g[c][at] for c in columns}, "accepted": kept[at]}

    columns = ["scope", "track_id", "frame", *BOX, "before", "missing"]
    return per_group(met, ["scope", "frame"], [F.desc("there"), F.desc(area), "track_id"], fold, f"{typed(found, columns)}, accepted boolean")
