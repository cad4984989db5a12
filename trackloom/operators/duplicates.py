"""Removal of double boxes: pair relations found by joins inside a frame, then greedy choices in a fixed order.

``dets`` has det, x1..y2, conf, and where poses are used head_x, head_y, head_c,
tail_x, tail_y, tail_c, and the columns ``keys`` that tell frames apart: frame, where its numbers
are those of the whole table, else for example domain, video and frame.  A frame's boxes fit into a worker; nothing larger is gathered.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import settle
from .grouped import FRAME, per_group, typed
from .nullsafe import join_same

POSE = ["head_x", "head_y", "head_c", "tail_x", "tail_y", "tail_c"]
SIDES = ("x1", "y1", "x2", "y2")


def area(of: str = "") -> Column:
    c = lambda x: F.col(f"{of}{x}")
    return (c("x2") - c("x1")) * (c("y2") - c("y1"))


def diagonal(of: str = "") -> Column:
    c = lambda x: F.col(f"{of}{x}")
    return F.hypot(c("x2") - c("x1"), c("y2") - c("y1"))


def pose_valid(least: float = 0.15, mean: float = 0.25, apart: float = 0.15, margin: bool = False) -> Column:
    """Both points are sure enough and far enough apart; with ``margin`` they lie in the box, give or take a tenth of its sides (2 px at least)."""
    far = F.hypot(F.col("head_x") - F.col("tail_x"), F.col("head_y") - F.col("tail_y")) >= apart * diagonal()
    ok = (F.least("head_c", "tail_c") >= least) & ((F.col("head_c") + F.col("tail_c")) / 2 >= mean) & far & (area() > 0)
    if margin:
        for axis, low, high in (("x", "x1", "x2"), ("y", "y1", "y2")):
            room = F.greatest(F.lit(2.0), 0.1 * (F.col(high) - F.col(low)))
            for end in ("head", "tail"):
                ok &= F.col(f"{end}_{axis}").between(F.col(low) - room, F.col(high) + room)
    return F.coalesce(ok, F.lit(False))


def pairs(dets: DataFrame, columns: list[str] | None = None, keys: Sequence[str] = FRAME) -> DataFrame:
    """Overlapping pairs of a frame, det a before det b: keys, a, b, common, iou, io_min, both boxes' columns as a_* and b_*."""
    kept = ["det", *SIDES, *(columns or [])]
    side = lambda s: dets.select(*keys, *(F.col(c).alias(f"{s}_{c}") for c in kept))
    wide = F.least("a_x2", "b_x2") - F.greatest("a_x1", "b_x1")
    high = F.least("a_y2", "b_y2") - F.greatest("a_y1", "b_y1")
    both = join_same(side("a"), side("b"), keys).where((F.col("a_det") < F.col("b_det")) & (wide > 0) & (high > 0)).withColumn("common", wide * high)
    sa, sb = area("a_"), area("b_")
    return both.withColumns({"a": F.col("a_det"), "b": F.col("b_det"), "iou": F.col("common") / (sa + sb - F.col("common")), "io_min": F.col("common") / F.least(sa, sb)})


def ends_within(ratio: float) -> Column:
    """Of a row of ``pairs`` with poses: heads and tails both lie within ``ratio`` of the smaller diagonal."""
    limit = ratio * F.least(diagonal("a_"), diagonal("b_"))
    gap = lambda e: F.hypot(F.col(f"a_{e}_x") - F.col(f"b_{e}_x"), F.col(f"a_{e}_y") - F.col(f"b_{e}_y"))
    return (gap("head") <= limit) & (gap("tail") <= limit)


def keep_first(dets: DataFrame, doubles: DataFrame, order: list[Column], protected: DataFrame | None = None, keys: Sequence[str] = FRAME) -> DataFrame:
    """Boxes in ``order``: one that is kept removes its direct partners in ``doubles`` (keys, a, b) that come later.

    ``protected`` (keys, det) are never removed.  No chains: only a kept box removes.  Returns
    keys, det, kept, by (the box that removed it).
    """
    both = doubles.select(*keys, F.col("a").alias("det"), F.col("b").alias("other")).unionByName(doubles.select(*keys, F.col("b").alias("det"), F.col("a").alias("other")))
    lists = both.groupBy(*keys, "det").agg(F.sort_array(F.collect_set("other")).alias("others"))  # at most a frame's boxes
    ranked = dets.withColumn("rank_", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).select(*keys, "det", "rank_")
    safe = protected.select(*keys, "det").distinct().withColumn("safe", F.lit(True)) if protected is not None else dets.select(*keys, "det").limit(0).withColumn("safe", F.lit(True))
    linked = join_same(join_same(ranked, lists, [*keys, "det"]), safe, [*keys, "det"], "left").withColumn("safe", F.coalesce("safe", F.lit(False)))

    def fold(g):
        by: dict[int, int] = {}
        done = set()
        safe = {d for d, s in zip(g["det"].tolist(), g["safe"].tolist(), strict=True) if s}
        for det, others in zip(g["det"].tolist(), g["others"], strict=True):
            done.add(det)
            if det not in by:
                for o in others.tolist():
                    if o not in done and o not in safe:
                        by.setdefault(o, det)
        return {**{k: g[k] for k in keys}, "det": g["det"], "by": np.array([by.get(d, -1) for d in g["det"].tolist()])}

    judged = per_group(linked, keys, ["rank_"], fold, f"{typed(dets, keys)}, det long, by long")
    found = join_same(dets.select(*keys, "det"), judged, [*keys, "det"], "left")
    gone = F.coalesce(F.col("by") >= 0, F.lit(False))
    return found.select(*keys, "det", (~gone).alias("kept"), F.when(gone, F.col("by")).alias("by"))


def drop_direct_doubles(dets: DataFrame, ratio: float = 0.15, contained: float = 0.75, keys: Sequence[str] = FRAME) -> DataFrame:
    """Pose doubles without chaining: larger boxes first; both ends close and the smaller box mostly inside."""
    posed = dets.where(pose_valid())
    doubles = pairs(posed, POSE, keys).where((F.col("io_min") >= contained) & ends_within(ratio))
    return keep_first(dets, doubles, [F.desc(area()), F.desc("conf"), F.col("det")], keys=keys)


def track_support(dets: DataFrame) -> DataFrame:
    """``dets`` with support: how many observed boxes the track has in its video."""
    n = dets.where("origin = 'observed'").groupBy("video", "track_id").agg(F.count("*").alias("support"))
    ranked = join_same(dets, n, ["video", "track_id"], "left").withColumn("support", F.coalesce("support", F.lit(0)))
    return settle(ranked, "support")  # what follows reads it several times


def drop_by_track(dets: DataFrame, by_pose: bool = False, iou: float = 0.7, keys: Sequence[str] = FRAME) -> DataFrame:
    """Doubles by a fixed priority of tracks, most observed first: overlap of ``iou``, or (``by_pose``) ends within 0.12 and half the smaller box."""
    ranked = track_support(dets)
    if by_pose:
        doubles = pairs(ranked.where(pose_valid(margin=True)), POSE, keys).where((F.col("io_min") >= 0.5) & ends_within(0.12))
    else:
        doubles = pairs(ranked, keys=keys).where(F.col("iou") >= iou)
    return keep_first(ranked, doubles, [F.desc("support"), F.col("track_id"), F.col("det")], keys=keys)


def drop_contained_first(dets: DataFrame, contained: float = 0.8, keys: Sequence[str] = FRAME) -> DataFrame:
    """Two stages: small boxes inside larger ones go; then pose doubles of what is left, where boxes that removed another are safe."""
    ranked = track_support(dets)
    order = [F.desc(area()), F.desc("support"), F.col("track_id"), F.col("det")]
    first = settle(keep_first(ranked, pairs(ranked, keys=keys).where(F.col("io_min") >= contained), order, keys=keys), "contained")
    left = join_same(ranked, first.where("kept").select(*keys, "det"), [*keys, "det"], "left_semi")
    winners = first.where("by is not null").select(*keys, F.col("by").alias("det"))
    doubles = pairs(left.where(pose_valid(margin=True)), POSE, keys).where((F.col("io_min") >= 0.5) & ends_within(0.12))
    second = keep_first(left, doubles, order, winners, keys)
    stage = lambda df, name: df.where("not kept").select(*keys, "det", "by", F.lit(name).alias("stage"))
    gone = stage(first, "containment").unionByName(stage(second, "keypoints"))
    return join_same(dets.select(*keys, "det"), gone, [*keys, "det"], "left").select(*keys, "det", F.col("by").isNull().alias("kept"), "by", "stage")


def merge_pose_groups(dets: DataFrame, ratio: float = 0.15, contained: float = 0.75, keys: Sequence[str] = FRAME) -> DataFrame:
    """Chains of pose doubles in a frame keep one box: keys, det, group_id (the least det), winner.

    The winner is the largest box where any pair of the group is contained, else the one with
    the surest weaker end, then confidence, then the first.
    """
    close = pairs(dets, POSE, keys).select(*keys, "a", "b", (ends_within(ratio)).alias("close"), (F.col("io_min") >= contained).alias("inside")).where("close")
    lists = close.groupBy(*keys).agg(F.collect_list(F.struct("a", "b", "inside")).alias("links"))  # pairs of one frame
    rows = dets.select(*keys, "det", area().cast("double").alias("size"), F.least("head_c", "tail_c").cast("double").alias("sure"), F.col("conf").cast("double").alias("conf"))
    rows = join_same(rows, lists, keys)

    def fold(g):
        dets_, at = g["det"].tolist(), {d: k for k, d in enumerate(g["det"].tolist())}
        home = list(range(len(dets_)))

        def root(k):
            while home[k] != k:
                k = home[k]
            return k

        links = g["links"][0]
        for x in links:
            a, b = sorted((root(at[x["a"]]), root(at[x["b"]])))
            home[b] = a
        inside = {root(at[x["a"]]) for x in links if x["inside"]}
        groups: dict[int, list[int]] = {}
        for k in range(len(dets_)):
            groups.setdefault(root(k), []).append(k)
        best = {r: max(own, key=lambda k: (g["size"][k],) if r in inside else (g["sure"][k], g["conf"][k])) for r, own in groups.items()}  # noqa: B023
        roots = [root(k) for k in range(len(dets_))]
        return {**{k: g[k] for k in keys}, "det": g["det"], "group_id": [dets_[r] for r in roots], "winner": [best[r] == k for k, r in enumerate(roots)]}

    judged = per_group(rows, keys, ["det"], fold, f"{typed(dets, keys)}, det long, group_id long, winner boolean")
    return join_same(dets.select(*keys, "det"), judged, [*keys, "det"], "left").select(*keys, "det", F.coalesce("group_id", "det").alias("group_id"), F.coalesce("winner", F.lit(True)).alias("winner"))


def cluster_evidence(candidates: DataFrame, least_iou: float = 0.5, keys: Sequence[str] = FRAME) -> DataFrame:
    """Candidates in order of det join the cluster whose first box they overlap most, from ``least_iou`` on; else they open one: keys, det, cluster (its first det)."""
    rows = candidates.select(*keys, "det", *(F.col(c).cast("double").alias(c) for c in SIDES))

    def fold(g):
        from .matching import _boxes, overlaps

        iou = overlaps(_boxes(g, slice(None)), _boxes(g, slice(None)))[2]
        firsts: list[int] = []
        out = []
        for k in range(len(iou)):
            near = iou[k, firsts] if firsts else np.zeros(0)
            best = int(near.argmax()) if len(near) else -1
            if best >= 0 and near[best] >= least_iou:
                out.append(firsts[best])
            else:
                firsts.append(k)
                out.append(k)
        return {**{k: g[k] for k in keys}, "det": g["det"], "cluster": g["det"][out]}

    return per_group(rows, keys, ["det"], fold, f"{typed(candidates, keys)}, det long, cluster long")


def structural_duplicates(dets: DataFrame, keys: Sequence[str] = FRAME, iou: float = 0.75, oks: float = 0.8, length: float = 0.2, axis: float = 20.0, sigma: float = 0.1) -> DataFrame:
    """Adds kept to det in its frame: by falling conf (then det), a box goes if one that is kept is its like in all of four respects.

    These are overlap (``iou`` at least), both points (their similarity, with a scale of ``sigma`` mean diagonals, ``oks`` at least), body length
    (relative difference ``length`` at most) and direction (``axis`` degrees at most).  A box without both points is kept and removes none; a
    null conf comes last.  A frame's boxes are one group of a worker.  Returns keys, det, kept.
    """
    points = ["head_x", "head_y", "tail_x", "tail_y"]
    rows = dets.select(*keys, "det", *(F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2", *points)), F.col("conf").cast("double").alias("conf"))

    def fold(g):
        box = np.stack([g[c].astype(float) for c in ("x1", "y1", "x2", "y2")], 1)
        body = np.stack([g[c].astype(float) for c in points], 1)
        n = len(box)
        kept = np.ones(n, bool)
        whole = ~np.isnan(body).any(axis=1) & ~np.isnan(box).any(axis=1)
        wide = np.maximum(np.hypot(box[:, 2] - box[:, 0], box[:, 3] - box[:, 1]), 1.0)
        arrow = body[:, 2:] - body[:, :2]
        long = np.maximum(np.hypot(arrow[:, 0], arrow[:, 1]), 1e-6)
        area = (box[:, 2] - box[:, 0]) * (box[:, 3] - box[:, 1])
        for k in range(n):
            if not (kept[k] and whole[k]):
                continue
            r = k + 1 + np.flatnonzero(kept[k + 1 :] & whole[k + 1 :])
            both = np.clip(np.minimum(box[k, 2:], box[r, 2:]) - np.maximum(box[k, :2], box[r, :2]), 0, None).prod(axis=1)
            r = r[both >= iou * np.maximum(area[k] + area[r] - both, 1e-12)]
            far = np.stack([((body[k, i : i + 2] - body[r, i : i + 2]) ** 2).sum(axis=1) for i in (0, 2)])
            scale = np.maximum((wide[k] + wide[r]) / 2 * sigma, 1e-6)
            alike = np.exp(-far / (2 * scale**2)).mean(axis=0) >= oks
            alike &= np.abs(long[k] - long[r]) / np.maximum(long[k], long[r]) <= length
            cosine = np.clip((arrow[k] * arrow[r]).sum(axis=1) / (long[k] * long[r]), -1, 1)
            kept[r[alike & (np.degrees(np.arccos(cosine)) <= axis)]] = False
        return {**{c: g[c] for c in (*keys, "det")}, "kept": kept}

    return per_group(rows, keys, [F.desc("conf"), "det"], fold, f"{typed(rows, [*keys, 'det'])}, kept boolean")
