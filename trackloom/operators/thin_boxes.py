"""Thin boxes grown across their short side, where the boxes around them allow it."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .grouped import FRAME
from .nullsafe import join_same

BOX = ["x1", "y1", "x2", "y2"]


def _shared(a: Sequence[Column], b: Sequence[Column]) -> tuple[Column, Column]:
    """Intersection over union, and over the smaller box."""
    zero, tiny = F.lit(0.0), F.lit(1e-6)
    both = F.greatest(zero, F.least(a[2], b[2]) - F.greatest(a[0], b[0])) * F.greatest(zero, F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    sa, sb = ((c[2] - c[0]) * (c[3] - c[1]) for c in (a, b))
    return both / F.greatest(sa + sb - both, tiny), both / F.greatest(F.least(sa, sb), tiny)


def expand_thin(dets: DataFrame, width: int, height: int, keys: Sequence[str] = FRAME) -> DataFrame:
    """Adds added (pixels, null where the box stays) and part (of it on the far side) to boxes of a frame, and grows those that are grown.

    A box whose sides differ threefold and that stands nearly free (overlap below 0.25, shared part below 0.7, at most one other box sharing 0.2)
    grows by 2 to 8 pixels: 0.4 of the short side at most, to a quarter of it or a third of the long one.  Half lies on each side, or a quarter or three
    quarters on the far one if both points are sure (0.15 each, 0.25 on average) and lie off the middle.  It is tried whole, then by half, and refused where
    an overlap would pass 0.32, a shared part 0.8 for the first time or rise by more than 0.18.  Boxes around are taken as they were; all is cut to the image.
    ``dets`` has keys, det, x1..y2 and points with scores (head_x to tail_c); boxes without area stay.
    """
    num = lambda c: F.col(c).cast("double")
    keys = list(keys)
    wide, high = num("x2") - num("x1"), num("y2") - num("y1")
    upright = wide <= high  # the short side is the horizontal one, ties too
    short, long = F.least(wide, high), F.greatest(wide, high)
    extra = F.greatest(F.lit(2.0), F.least(F.lit(8.0), 0.4 * short, F.greatest(0.25 * short, long / 3 - short)))
    scores = [num("head_c"), num("tail_c")]
    sure = F.coalesce((F.least(*scores) >= 0.15) & ((scores[0] + scores[1]) / 2 >= 0.25) & scores[0].isNotNull() & scores[1].isNotNull(), F.lit(False))
    place = F.when(upright, ((num("head_x") + num("tail_x")) / 2 - num("x1")) / short).otherwise(((num("head_y") + num("tail_y")) / 2 - num("y1")) / short)
    part = F.when(sure & (place > 0.6) & (place <= 1.1), 0.75).when(sure & (place >= -0.1) & (place < 0.4), 0.25).otherwise(0.5)
    thin = dets.where((short > 0) & (long / short >= 3)).select(*keys, "det", *(num(c).alias(c) for c in BOX), upright.alias("upright"), extra.alias("extra"), part.alias("part"))

    def grown(name: str, factor: float) -> dict[str, Column]:
        low, far = F.col("extra") * (1 - F.col("part")) * factor, F.col("extra") * F.col("part") * factor
        flat = lambda v, on: F.when(on, v).otherwise(0.0)
        up = F.col("upright")
        zero = F.lit(0.0)
        return {
            f"{name}x1": F.greatest(F.col("x1") - flat(low, up), zero), f"{name}y1": F.greatest(F.col("y1") - flat(low, ~up), zero),
            f"{name}x2": F.least(F.col("x2") + flat(far, up), F.lit(float(width))), f"{name}y2": F.least(F.col("y2") + flat(far, ~up), F.lit(float(height))),
        }

    tried = thin.withColumns(grown("w_", 1.0) | grown("h_", 0.5))
    other = dets.select(*keys, F.col("det").alias("o_det"), *(num(c).alias(f"o_{c}") for c in BOX))
    of = lambda p: [F.col(f"{p}{c}") for c in BOX]
    touch = (F.greatest("x2", "w_x2") > F.col("o_x1")) & (F.least("x1", "w_x1") < F.col("o_x2")) & (F.greatest("y2", "w_y2") > F.col("o_y1")) & (F.least("y1", "w_y1") < F.col("o_y2"))
    met = join_same(tried, other, keys).where((F.col("det") != F.col("o_det")) & touch)
    (iou, shared), (w_iou, w_shared), (h_iou, h_shared) = (_shared(of(p), of("o_")) for p in ("", "w_", "h_"))
    refuse = lambda i, s: (i > 0.32) | ((shared < 0.8) & (s >= 0.8)) | (s - shared > 0.18)
    some = lambda c: F.max(c.cast("int"))
    around = met.groupBy(*keys, "det").agg((some((iou >= 0.25) | (shared >= 0.7)) + (F.count_if(shared >= 0.2) > 1).cast("int")).alias("held"), some(refuse(w_iou, w_shared)).alias("no_w"), some(refuse(h_iou, h_shared)).alias("no_h"))
    none = lambda c: F.coalesce(c, F.lit(0))
    rows = join_same(tried, around, [*keys, "det"], "left").where(none("held") == 0)
    whole = none("no_w") == 0
    rows = rows.where(whole | (none("no_h") == 0)).withColumns({f"new_{c}": F.when(whole, F.col(f"w_{c}")).otherwise(F.col(f"h_{c}")) for c in BOX})
    side = lambda p, a: F.col(f"{p}{a}2") - F.col(f"{p}{a}1")
    added = F.when(F.col("upright"), side("new_", "x") - side("", "x")).otherwise(side("new_", "y") - side("", "y"))
    rows = rows.select(*keys, "det", *(f"new_{c}" for c in BOX), added.alias("added"), "part")
    found = join_same(dets, rows, [*keys, "det"], "left")
    return reduce(lambda d, c: d.withColumn(c, F.coalesce(f"new_{c}", F.col(c).cast("double"))).drop(f"new_{c}"), BOX, found)
