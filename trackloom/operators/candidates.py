"""Candidates of experts put beside the boxes of their frame, and what events take over from what they build on."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .grouped import FRAME, per_group, typed
from .matching import BOX, overlaps
from .nullsafe import join_same


def placed_candidates(candidates: DataFrame, dets: DataFrame, keys: Sequence[str] = FRAME, least: float = 0.5) -> DataFrame:
    """Adds place to candidates of a frame: already_observed where a box there shares ``least`` of the smaller one, else their route.

    Candidates (keys, det, x1..y2, route) go in the order of det; one whose place is soft_positive is a box for those after it.  Boxes that are
    there are never changed.  A box with a null side shares nothing.  A frame's boxes are one group of a worker.
    """
    keys = list(keys)
    box = [F.col(c).cast("double").alias(c) for c in BOX]
    there = dets.select(*keys, F.lit(0).alias("side_"), F.lit(None).cast("long").alias("det"), *box, F.lit(None).cast("string").alias("route"))
    rows = there.unionByName(candidates.select(*keys, F.lit(1).alias("side_"), F.col("det").cast("long").alias("det"), *box, F.col("route").cast("string").alias("route")))

    def fold(g):
        boxes = np.stack([g[c].astype(float) for c in BOX], axis=1)
        new = np.flatnonzero(g["side_"] == 1)
        hides = (g["side_"] == 0).copy()
        place = g["route"].astype(object).copy()
        if len(new):
            close = np.nan_to_num(overlaps(boxes[new], boxes)[1]) >= least
            for k, i in enumerate(new):
                if (close[k] & hides).any():
                    place[i] = "already_observed"
                elif place[i] == "soft_positive":
                    hides[i] = True
        return {**{k: g[k][new] for k in keys}, "det": g["det"][new].astype("int64"), "place": place[new]}

    placed = per_group(rows, keys, ["side_", "det"], fold, f"{typed(rows, keys)}, det long, place string")
    return join_same(candidates, placed, [*keys, "det"], "left")


def inherited(events: DataFrame, attributes: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """Adds ``wanted`` of ``attributes`` (sample_id, ...) to events (event_id, upstream): of the first upstream entity that has a row, null without one."""
    links = events.select("event_id", F.posexplode("upstream").alias("pos", "sample_id"))
    first = links.join(attributes.select("sample_id", F.struct(*wanted).alias("a")), "sample_id").groupBy("event_id").agg(F.min_by("a", "pos").alias("a"))
    return events.join(first, "event_id", "left").select(*(c for c in events.columns if c not in wanted), *(F.col(f"a.{c}").alias(c) for c in wanted))
