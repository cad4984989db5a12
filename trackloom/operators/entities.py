"""Entity rows on their way to training data: pose, supervision, geometry repair, annotations, review state.

``ents`` has frame, det, domain, video, grp, split, track_id, class_id, x1..y2, label_status,
quality, frame_status, complete and the points head_x, head_y, head_c, tail_x, tail_y, tail_c,
which are null where a point is missing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .grouped import FRAME
from .nullsafe import join_same

SUPERVISED = ["human", "human_confirmed", "soft_positive", "ignore"]
CONFIRMED = ["human", "human_confirmed"]


def with_pose(ents: DataFrame) -> DataFrame:
    """Adds length, angle (of head less tail) and pose_conf (the weaker point's); null where a point is missing, pose_conf where a score is."""
    dx, dy = F.col("head_x") - F.col("tail_x"), F.col("head_y") - F.col("tail_y")
    sure = F.when(F.col("head_c").isNotNull() & F.col("tail_c").isNotNull(), F.least("head_c", "tail_c"))
    both = F.col("head_x").isNotNull() & F.col("tail_x").isNotNull()
    return ents.withColumns({"length": F.sqrt(dx * dx + dy * dy), "angle": F.atan2(dy, dx), "pose_conf": F.when(both, sure)})


def _is_bee() -> Column:
    return F.coalesce(F.col("class_id") == 0, F.lit(True))


def _seen(point: str) -> Column:
    return F.coalesce(F.col(f"{point}_x").isNotNull() & F.coalesce(F.col(f"{point}_c") > 0, F.lit(True)), F.lit(False))


def with_supervision(ents: DataFrame, behaviour: Column) -> DataFrame:
    """Shadows lose pose and track (kept as source_track_id); adds for_detection, for_pose, for_tracking, for_behavior."""
    bee = _is_bee()
    points = {c: F.when(bee, F.col(c)) for c in ("head_x", "head_y", "head_c", "tail_x", "tail_y", "tail_c")}
    rows = ents.withColumns({"source_track_id": F.when(~bee, F.col("track_id")), "track_id": F.when(bee, F.col("track_id")), **points})
    valid = F.coalesce(F.col("label_status") != "invalid", F.lit(True))
    return rows.withColumns({"for_detection": valid | ~bee, "for_pose": bee & (_seen("head") | _seen("tail")), "for_tracking": bee & F.col("track_id").isNotNull(), "for_behavior": bee & F.coalesce(behaviour, F.lit(False))})


def repaired(ents: DataFrame, width: int, height: int) -> DataFrame:
    """Boxes cut to the image and points with a visibility of 0 or 2; adds action: clipped, excluded (nothing is left; kept as a row) or none.

    A point outside the image, or with a score of 0, is (0, 0, 0).
    """
    cut = lambda c, n: F.greatest(F.lit(0.0), F.least(F.lit(float(n)), F.col(c).cast("double")))
    new = {"x1": cut("x1", width), "y1": cut("y1", height), "x2": cut("x2", width), "y2": cut("y2", height)}
    moved = F.lit(False)
    for c, v in new.items():
        moved = moved | (v != F.col(c))
    rows = ents.withColumn("moved", moved).withColumns(new)
    empty = (F.col("x2") <= F.col("x1")) | (F.col("y2") <= F.col("y1"))
    points = {}
    for p in ("head", "tail"):
        inside = F.col(f"{p}_x").between(0, width) & (F.col(f"{p}_x") < width) & F.col(f"{p}_y").between(0, height) & (F.col(f"{p}_y") < height)
        ok = _seen(p) & F.coalesce(inside, F.lit(False))
        points |= {f"{p}_x": F.when(ok, F.col(f"{p}_x")).otherwise(0.0), f"{p}_y": F.when(ok, F.col(f"{p}_y")).otherwise(0.0), f"{p}_v": F.when(ok, 2).otherwise(0)}
    return rows.withColumns(points).withColumn("action", F.when(empty, "excluded").when(F.col("moved"), "clipped").otherwise("none")).drop("moved")


def training_annotations(ents: DataFrame) -> DataFrame:
    """The rows that a model may learn from, with track numbers for each identity, pose state and masks.

    Frames that are suspect or invalid give none; soft positives and ignore regions are for the
    training split only; shadows are left out.  Tracks are numbered per (domain, video, group)
    in the order of their ids, from 0, and ignore regions have none (-1).
    """
    status = F.col("label_status")
    usable = ents.where(_is_bee() & ~F.coalesce(F.col("frame_status").isin("suspect", "invalid"), F.lit(False)) & status.isin(SUPERVISED) & (status.isin(CONFIRMED) | (F.col("split") == "train")))
    tracked = F.col("track_id").isNotNull() & (status != "ignore")
    scope = ["domain", "video", "grp"]
    ids = usable.where(tracked).select(*scope, "track_id").distinct().withColumn("number", F.row_number().over(Window.partitionBy(*scope).orderBy("track_id")) - 1)
    rows = usable.join(ids, [*scope, "track_id"], "left")
    pose = F.when(F.col("head_x").isNull() & F.col("tail_x").isNull(), 0).when(_seen("head") | _seen("tail"), 2).otherwise(1)
    return rows.select(
        "frame", "det", "domain", "video", "grp", "split", "x1", "y1", (F.col("x2") - F.col("x1")).alias("w"), (F.col("y2") - F.col("y1")).alias("h"), pose.alias("pose_state"),
        (_seen("head").cast("int") + _seen("tail").cast("int")).alias("num_keypoints"),
        F.when(tracked, F.col("number")).otherwise(-1).cast("long").alias("track_number"), tracked.alias("track_mask"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.col("quality").cast("double"), F.lit(1.0)))).alias("quality"),
        (status == "soft_positive").alias("is_pseudo"), (status == "ignore").alias("ignore_region"), F.when(status == "ignore", 0.0).otherwise(1.0).alias("background_weight"),
    )


def training_rows(ents: DataFrame, width: int, height: int) -> DataFrame:
    """Text rows of 11 columns: class, centre, size, then both points with visibility; a missing pose is six zeros, ignore regions are left out."""
    usable = ents.where(_is_bee() & F.col("label_status").isin("human", "human_confirmed", "soft_positive"))
    share = lambda c, n: F.format_string("%.10f", c.cast("double") / n)
    point = lambda p: [F.when(_seen(p), share(F.col(f"{p}_x"), width)).otherwise("0"), F.when(_seen(p), share(F.col(f"{p}_y"), height)).otherwise("0"), F.when(_seen(p), "2").otherwise("0")]
    box = [share((F.col("x1") + F.col("x2")) / 2.0, width), share((F.col("y1") + F.col("y2")) / 2.0, height), share(F.col("x2") - F.col("x1"), width), share(F.col("y2") - F.col("y1"), height)]
    return usable.select("domain", "video", "split", "frame", "det", F.concat_ws(" ", F.lit("0"), *box, *point("head"), *point("tail")).alias("line"))


def with_tier(ents: DataFrame) -> DataFrame:
    """Adds tier: confirmed (by people), candidates (soft or unconfirmed, visible), audit_only (ignored, invalid, shadows of suspect frames)."""
    status = F.coalesce("label_status", F.lit("unconfirmed"))
    tier = F.when(status.isin("ignore", "invalid") | F.coalesce(F.col("frame_status").isin("suspect", "invalid"), F.lit(False)), "audit_only").when(status.isin(CONFIRMED), "confirmed").otherwise("candidates")
    return ents.withColumn("tier", tier)


def split_conflicts(ents: DataFrame) -> DataFrame:
    """Videos of a domain that stand in more than one split: domain, video, splits (sorted, comma-joined)."""
    found = ents.groupBy("domain", "video").agg(F.array_sort(F.collect_set("split")).alias("s"))
    return found.where(F.size("s") > 1).select("domain", "video", F.array_join("s", ",").alias("splits"))


def package_index(ents: DataFrame) -> DataFrame:
    """What each part of an annotation package holds: domain, video, grp, tier, frames, boxes, negatives (complete frames without any confirmed box)."""
    tiers = with_tier(ents)
    parts = tiers.groupBy("domain", "video", "grp", "tier").agg(F.count_distinct("frame").alias("frames"), F.count("*").alias("boxes"))
    confirmed = F.max((F.col("tier") == "confirmed").cast("int"))
    frames = tiers.groupBy("domain", "video", "grp", "frame").agg(confirmed.alias("any"), F.max(F.col("complete").cast("int")).alias("complete"))
    negative = frames.where("any = 0 and complete = 1").groupBy("domain", "video", "grp").agg(F.count("*").alias("negatives"))
    return parts.join(negative, ["domain", "video", "grp"], "left").withColumn("negatives", F.when(F.col("tier") == "confirmed", F.coalesce("negatives", F.lit(0))).otherwise(0))


def feedback_snapshot(ents: DataFrame) -> DataFrame:
    """Only what people labelled; frames without any such box stay as a row without one where they are complete."""
    kept = ents.where(F.col("label_status").isin(CONFIRMED)).select("frame", "det")
    frames = ents.where("complete").select("frame").distinct()
    return kept.unionByName(frames.join(kept, "frame", "left_anti").select("frame", F.lit(None).cast("long").alias("det")))


def expand_to_points(ents: DataFrame, width: int, height: int, share: float = 0.1, margin: float = 0.0) -> DataFrame:
    """Boxes grown towards their points, each side by at most ``share`` of the box's width or height, cut to the image; boxes without both points stay."""
    w, h = (F.col("x2") - F.col("x1")).cast("double"), (F.col("y2") - F.col("y1")).cast("double")
    both = _seen("head") & _seen("tail")
    low = lambda a, p, n: F.greatest(F.lit(0.0), F.least(F.col(a).cast("double"), F.greatest(F.least(f"head_{p}", f"tail_{p}") - margin, F.col(a) - share * n)))
    high = lambda a, p, n, most: F.least(F.lit(float(most)), F.greatest(F.col(a).cast("double"), F.least(F.greatest(f"head_{p}", f"tail_{p}") + margin, F.col(a) + share * n)))
    new = {"x1": low("x1", "x", w), "y1": low("y1", "y", h), "x2": high("x2", "x", w, width), "y2": high("y2", "y", h, height)}
    return ents.withColumns({c: F.when(both, v).otherwise(F.col(c).cast("double")) for c, v in new.items()})


def checked_xywh(ents: DataFrame, width: int, height: int, tolerance: float = 2.0) -> DataFrame:
    """Corner, width and height cut to the image; ``overflow`` is how far the box reached out, and rows beyond ``tolerance`` are marked broken."""
    over = F.greatest(F.lit(0.0), -F.col("x1"), -F.col("y1"), F.col("x2") - width, F.col("y2") - height)
    cut = lambda c, n: F.greatest(F.lit(0.0), F.least(F.lit(float(n)), F.col(c).cast("double")))
    x, y = cut("x1", width), cut("y1", height)
    return ents.select("frame", "det", x.alias("bx"), y.alias("by_"), (cut("x2", width) - x).alias("bw"), (cut("y2", height) - y).alias("bh"), over.alias("overflow"), (over > tolerance).alias("broken"))


def points_in_boxes(points: DataFrame, boxes: DataFrame, keys: Sequence[str] = FRAME) -> DataFrame:
    """Loose points (keys, point, x, y) to boxes (keys, det, x1..y2) that hold them, one to one, nearest to the centre relative to the diagonal first.

    Ties go to the smaller box, then box and point order.  Returns keys, point, det.
    """
    from .grouped import per_group, typed

    mid = F.hypot(F.col("x") - (F.col("x1") + F.col("x2")) / 2, F.col("y") - (F.col("y1") + F.col("y2")) / 2) / F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    pairs = join_same(points, boxes.select(*keys, "det", "x1", "y1", "x2", "y2"), keys).where(F.col("x").between(F.col("x1"), F.col("x2")) & F.col("y").between(F.col("y1"), F.col("y2")))
    pairs = pairs.select(*keys, "point", "det", F.round(mid, 9).alias("gap"), ((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))).cast("double").alias("size"))

    def take(g):
        used: set = set()
        keep = []
        for k, (p, d) in enumerate(zip(g["point"].tolist(), g["det"].tolist(), strict=True)):
            if ("p", p) not in used and ("d", d) not in used:
                used |= {("p", p), ("d", d)}
                keep.append(k)
        return {c: g[c][keep] for c in (*keys, "point", "det")}

    return per_group(pairs, keys, ["gap", "size", "det", "point"], take, f"{typed(pairs, keys)}, point long, det long")


def dense_identities(ents: DataFrame, sequence: list[str]) -> DataFrame:
    """Distinct tracks of each sequence numbered from 0, numeric ids by value before all other ids by text: adds dense_id."""
    number = F.expr("try_cast(track_id as double)")
    w = Window.partitionBy(*sequence).orderBy(number.isNull(), number, F.col("track_id").cast("string"))
    return ents.where("track_id is not null").select(*sequence, "track_id").distinct().withColumn("dense_id", (F.row_number().over(w) - 1).cast("long"))
