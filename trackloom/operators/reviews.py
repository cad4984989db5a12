"""Review work: what to look at, what people decided, what may be trained on; consistency of pseudo labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .grouped import FRAME
from .nullsafe import join_same

VALUE = ["uncertainty", "disagreement", "rarity", "knowledge_gain", "cross_layer_value", "behavior_value"]


def review_value(rows: DataFrame) -> DataFrame:
    """Adds value: the sum of the parts of ``VALUE`` that the rows have, less a fifth of review_cost (1 where unknown); nulls count as 0."""
    part = lambda c, other: F.coalesce(F.col(c).cast("double"), F.lit(other)) if c in rows.columns else F.lit(other)
    total = part(VALUE[0], 0.0)
    for c in VALUE[1:]:
        total = total + part(c, 0.0)
    return rows.withColumn("value", total - 0.2 * part("review_cost", 1.0))


def colony_findings(changes: DataFrame, windows: DataFrame, moving: Column, least_coverage: float = 0.9) -> DataFrame:
    """Flagged changes (scope, window_index, metric, value, centre, z) with direction and whether the window allows to judge them.

    A window must be covered; metrics of motion (``moving``) need half of its boxes observable.
    """
    found = changes.where("flagged").join(windows.select("scope", "window_index", "coverage", "observable_fraction"), ["scope", "window_index"])
    measurable = (F.col("coverage") >= least_coverage) & (~moving | (F.col("observable_fraction") >= 0.5))
    delta = F.col("value") - F.coalesce("centre", "value")
    return found.select("scope", "window_index", "metric", "value", "centre", "z", F.when(delta > 0, "up").when(delta < 0, "down").otherwise("same").alias("direction"), F.when(measurable, "visual_change").otherwise("observability_check").alias("status"))


def colony_queue(findings: DataFrame, support: float = 0.5, gain: float = 1.0) -> DataFrame:
    """One row a window: its findings, reason and priority (greatest |z| weighed by the rule's support, plus its gain)."""
    g = findings.groupBy("scope", "window_index").agg(F.count("*").alias("findings"), F.max(F.abs(F.coalesce("z", F.lit(0.0)))).alias("most"), F.max((F.col("status") == "visual_change").cast("int")).alias("seen"))
    return g.select("scope", "window_index", "findings", F.when(F.col("seen") == 1, "colony_temporal_change").otherwise("colony_observability_check").alias("reason"), (F.col("most") * (0.5 + 0.5 * support) + gain).alias("priority"))


def merged_queues(colony: DataFrame, entity: DataFrame, budget: int) -> DataFrame:
    """Both queues (event_id, priority) under one budget, a quarter of which at most is the colony's: source, event_id, priority.  A top-k report."""
    top = lambda df, n, name: df.orderBy(F.desc("priority"), "event_id").limit(n).select(F.lit(name).alias("source"), "event_id", "priority")
    first = top(colony, budget // 4, "colony")
    used = first.agg(F.count("*").alias("used"))
    ranked = entity.orderBy(F.desc("priority"), "event_id").limit(budget)  # at most the budget is ranked below
    ranked = ranked.withColumn("rank_", F.row_number().over(Window.orderBy(F.desc("priority"), "event_id"))).crossJoin(used).where(F.col("rank_") <= budget - F.col("used"))
    return first.unionByName(ranked.select(F.lit("entity").alias("source"), "event_id", "priority"))


def apply_colony_reviews(queue: DataFrame, decisions: DataFrame) -> DataFrame:
    """``queue`` (event_id, status) after ``decisions`` (decision_id, event_id, action, human_label, reviewer).

    Repeated decisions count once; a decision_id that stands for two different ones raises, and
    so does a confirmation without a label.  The last decision of an event, by decision_id, holds.
    """
    once = decisions.select("decision_id", "event_id", "action", "human_label", "reviewer").distinct()
    clash = F.count("*").over(Window.partitionBy("decision_id")) > 1
    bare = (F.col("action") != "reject") & (F.trim(F.coalesce("human_label", F.lit(""))) == "")
    broken = F.when(clash, F.raise_error(F.lit("a decision_id stands for two decisions"))).when(bare, F.raise_error(F.lit("a confirmation needs a label"))).when(~F.col("action").isin("confirm", "correct", "reject"), F.raise_error(F.lit("unknown action")))
    checked = once.withColumn("action", F.coalesce(broken.cast("string"), F.col("action")))
    last = checked.groupBy("event_id").agg(F.max_by(F.struct("action", "human_label", "reviewer", "decision_id"), "decision_id").alias("d"))
    status = F.when(F.col("d.action") == "reject", "rejected").when(F.col("d").isNotNull(), "human_confirmed").otherwise(F.col("status"))
    return queue.join(last, "event_id", "left").select("event_id", status.alias("status"), F.col("d.human_label").alias("human_label"), F.col("d.reviewer").alias("reviewer"), F.col("d.decision_id").alias("decision_id"))


def individual_records(labelled: DataFrame, edges: DataFrame) -> DataFrame:
    """Confirmed, labelled entities with their nearest edge (entity, other, distance), ties to the least other; null without one."""
    ends = edges.select(F.col("entity").alias("entity_id"), "other", "distance")
    nearest = ends.groupBy("entity_id").agg(F.min(F.struct(F.round("distance", 9).alias("distance"), "other")).alias("n"))
    rows = labelled.where((F.col("label_status") == "human_confirmed") & F.col("label").isNotNull())
    return rows.join(nearest, "entity_id", "left").select("entity_id", "split", "label", F.col("n.distance").alias("distance"), F.col("n.other").alias("other"))


def window_records(events: DataFrame, frames: DataFrame) -> DataFrame:
    """Confirmed windows (scope, window_index, first_frame, last_frame, label) with the split of their frames; a window across splits raises.

    Windows without a frame are unassigned.  Frames and windows meet by runs of frames: a window looks at the runs that it begins
    and ends in one by one, and at what lies between as the splits of whole runs.
    """
    run = lambda c: F.floor(F.col(c) / 64).cast("long")
    spans = events.select("scope", "window_index", "first_frame", "last_frame").where("first_frame <= last_frame").withColumns({"low_": run("first_frame"), "high_": run("last_frame")})
    rows = frames.select("scope", "frame", "split").distinct().withColumn("run_", run("frame"))
    edges = spans.withColumn("run_", F.explode(F.array_distinct(F.array("low_", "high_")))).join(rows, ["scope", "run_"]).where(F.col("frame").between(F.col("first_frame"), F.col("last_frame")))
    whole = spans.where("high_ - low_ > 1").withColumn("run_", F.explode(F.sequence(F.col("low_") + 1, F.col("high_") - 1))).join(rows.select("scope", "run_", "split").distinct(), ["scope", "run_"])
    inside = edges.select("scope", "window_index", "split").unionByName(whole.select("scope", "window_index", "split"))
    found = inside.groupBy("scope", "window_index").agg(F.count_distinct("split").alias("n"), F.min("split").alias("split"))
    rows = events.join(found, ["scope", "window_index"], "left")
    return rows.select("scope", "window_index", "label", F.when(F.col("n") > 1, F.raise_error(F.lit("a window lies in several splits")).cast("string")).otherwise(F.coalesce("split", F.lit("unassigned"))).alias("split"))


def choose_prompts(memory: DataFrame, domain: str, tags: list[str], limit: int = 4, negative: bool = False) -> DataFrame:
    """The ``limit`` prompts of a domain and sign that share most tags, earlier ones first.  A top-k report."""
    wanted = F.array(*map(F.lit, tags)).cast("array<string>")
    rows = memory.where((F.col("domain") == domain) & (F.coalesce(F.col("negative"), F.lit(False)) == negative))
    shared = F.size(F.array_intersect(F.coalesce("tags", F.array().cast("array<string>")), wanted))
    return rows.withColumn("shared", shared).orderBy(F.desc("shared"), "position").limit(limit).select("position", "shared")


def in_either(rows: DataFrame, frames: DataFrame, entities: DataFrame) -> DataFrame:
    """Rows whose frame or whose entity is in a list: two semi joins, each row once."""
    by_frame = rows.join(frames.select("frame").distinct(), "frame", "left_semi")
    by_entity = rows.join(frames.select("frame").distinct(), "frame", "left_anti").join(entities.select("entity_id").distinct(), "entity_id", "left_semi")
    return by_frame.unionByName(by_entity.select(*by_frame.columns))


def prefer(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Union by ``key`` in which rows of ``second`` replace those of ``first``."""
    return first.join(second.select(key).distinct(), key, "left_anti").select(*second.columns).unionByName(second)


def set_consistency(boxes: DataFrame, flipped: DataFrame, least_iou: float = 0.5, ends: float = 0.2, keys: Sequence[str] = FRAME) -> DataFrame:
    """Per box its best overlap with a box of the mirrored view, 0 where that is too small or the points lie too far apart on average (in diagonals).

    Both tables have keys, det, x1..y2, head_x, head_y, tail_x, tail_y; boxes without a partner score 0.
    """
    cols = ["det", "x1", "y1", "x2", "y2", "head_x", "head_y", "tail_x", "tail_y"]
    side = lambda df, p: df.select(*keys, *(F.col(c).alias(f"{p}_{c}") for c in cols))
    wide = F.least("a_x2", "b_x2") - F.greatest("a_x1", "b_x1")
    high = F.least("a_y2", "b_y2") - F.greatest("a_y1", "b_y1")
    size = lambda p: (F.col(f"{p}_x2") - F.col(f"{p}_x1")) * (F.col(f"{p}_y2") - F.col(f"{p}_y1"))
    gap = lambda e: F.hypot(F.col(f"a_{e}_x") - F.col(f"b_{e}_x"), F.col(f"a_{e}_y") - F.col(f"b_{e}_y"))
    pairs = join_same(side(boxes, "a"), side(flipped, "b"), keys).where((wide > 0) & (high > 0))
    off = (gap("head") + gap("tail")) / 2 / F.greatest(F.hypot(F.col("a_x2") - F.col("a_x1"), F.col("a_y2") - F.col("a_y1")), F.lit(1e-4))
    pairs = pairs.select(*keys, F.col("a_det").alias("det"), (wide * high / (size("a") + size("b") - wide * high)).alias("iou"), off.alias("off"), "b_det")
    best = pairs.groupBy(*keys, "det").agg(F.max(F.struct(F.round("iou", 9).alias("iou"), (-F.col("b_det")).alias("k"), "off")).alias("m"))
    ok = (F.col("m.iou") >= least_iou) & F.coalesce(F.col("m.off") <= ends, F.lit(True))
    return join_same(boxes.select(*keys, "det"), best, [*keys, "det"], "left").select(*keys, "det", F.when(F.coalesce(ok, F.lit(False)), F.col("m.iou")).otherwise(0.0).alias("consistency"))


def trajectory_consistency(frames: list[DataFrame], least_iou: float = 0.5) -> DataFrame:
    """Boxes of the last table (clip, det, x1..y2) whose chain of mutual best overlaps back through the earlier ones and forward again returns to itself.

    ``frames`` are the clips' successive frames; returns clip, det, score (the least overlap on
    the way, 0 where the chain breaks).
    """
    current = frames[-1]

    def step(a: DataFrame, b: DataFrame) -> DataFrame:
        """clip, i, j, iou: pairs that are each other's best."""
        side = lambda df, p: df.select("clip", *(F.col(c).alias(f"{p}_{c}") for c in ("det", "x1", "y1", "x2", "y2")))
        wide = F.least("a_x2", "b_x2") - F.greatest("a_x1", "b_x1")
        high = F.least("a_y2", "b_y2") - F.greatest("a_y1", "b_y1")
        size = lambda p: (F.col(f"{p}_x2") - F.col(f"{p}_x1")) * (F.col(f"{p}_y2") - F.col(f"{p}_y1"))
        pairs = side(a, "a").join(side(b, "b"), "clip").where((wide > 0) & (high > 0))
        pairs = pairs.select("clip", F.col("a_det").alias("i"), F.col("b_det").alias("j"), F.round(wide * high / (size("a") + size("b") - wide * high), 9).alias("iou"))
        there = pairs.groupBy("clip", "i").agg(F.max(F.struct("iou", (-F.col("j")).alias("k"))).alias("m")).select("clip", "i", (-F.col("m.k")).alias("j"), F.col("m.iou").alias("iou"))
        back = pairs.groupBy("clip", "j").agg(F.max(F.struct("iou", (-F.col("i")).alias("k"))).alias("m")).select("clip", "j", (-F.col("m.k")).alias("i"))
        return there.join(back, ["clip", "i", "j"]).where(F.col("iou") >= least_iou)

    active = current.select("clip", F.col("det").alias("origin"), F.col("det").alias("at"), F.lit(1.0).alias("score"))
    way = [*reversed(frames[:-1]), *frames[1:]]
    before = current
    for after in way:
        # only boxes that the chain still holds compete for partners
        held = before.join(active.select("clip", F.col("at").alias("det")), ["clip", "det"], "left_semi")
        active = active.join(step(held, after).withColumnRenamed("i", "at"), ["clip", "at"]).select("clip", "origin", F.col("j").alias("at"), F.least("score", "iou").alias("score"))
        before = after
    home = active.where("origin = at").select("clip", F.col("origin").alias("det"), "score") if len(frames) > 1 else active.limit(0).select("clip", F.col("origin").alias("det"), "score")
    return current.select("clip", "det").join(home, ["clip", "det"], "left").select("clip", "det", F.coalesce("score", F.lit(0.0)).alias("score"))


def route_pseudo(rows: DataFrame, least: float = 0.25) -> DataFrame:
    """pseudo where score, set and trajectory all support a candidate of the model's own; ignore where some do; else background.

    External proposals only support: they are never labels by themselves.
    """
    joint = F.coalesce(F.col("score") * F.col("set_score") * F.col("trajectory_score"), F.lit(0.0))
    some = (F.coalesce("set_score", F.lit(0.0)) > 0) | (F.coalesce("trajectory_score", F.lit(0.0)) > 0) | (F.coalesce("score", F.lit(0.0)) >= 0.5)
    own = ~F.coalesce(F.col("external"), F.lit(False))
    return rows.withColumn("route", F.when(own & (joint >= least), "pseudo").when(some, "ignore").otherwise("background"))


def merge_targets(human: DataFrame, pseudo: DataFrame, key: list[str]) -> DataFrame:
    """Human rows as they are, then pseudo rows whose ``key`` no human row has; is_pseudo tells them apart."""
    extra = pseudo.join(human.select(*key).distinct(), key, "left_anti")
    return human.withColumn("is_pseudo", F.lit(False)).unionByName(extra.select(*human.columns).withColumn("is_pseudo", F.lit(True)))


def match_classes(pred: DataFrame, truth: DataFrame, least: float = 0.5, keys: Sequence[str] = FRAME) -> DataFrame:
    """Predictions by falling confidence: tp (takes the best free truth), duplicate (only taken ones are near enough) or fp: keys, det, status."""
    import numpy as np

    from .grouped import per_group, typed
    from .matching import _both_sides, _boxes, overlaps

    def judge(g):
        p, t = np.flatnonzero(g["side"] == 0), np.flatnonzero(g["side"] == 1)
        iou = overlaps(_boxes(g, p), _boxes(g, t))[2] if len(p) and len(t) else np.zeros((len(p), len(t)))
        free, out = np.ones(len(t), bool), []
        for row in iou:
            near = np.flatnonzero(row >= least)
            open_ = near[free[near]] if len(near) else near
            if len(open_):
                free[open_[row[open_].argmax()]] = False
            out.append("tp" if len(open_) else "duplicate" if len(near) else "fp")
        return {**{k: g[k][p] for k in keys}, "det": g["det"][p], "status": out}

    return per_group(_both_sides(pred, truth, keys), keys, ["side", F.desc("conf"), "det"], judge, f"{typed(pred, keys)}, det long, status string")


def truth_at_risk(supports: DataFrame, kept: DataFrame) -> DataFrame:
    """Truth boxes (frame, gt) all of whose supporting predictions (frame, gt, det) were removed."""
    alive = supports.join(kept.select("frame", "det"), ["frame", "det"], "left_semi").select("frame", "gt")
    return supports.select("frame", "gt").distinct().join(alive, ["frame", "gt"], "left_anti")


def capacity_by_density(frames: DataFrame, classes: DataFrame, edges: tuple[int, ...] = (3, 5)) -> DataFrame:
    """Per density bin (by the number of true boxes): frames, truths, predictions, tp, duplicates, fp, shortfall (truths beyond the frame's predictions)."""
    counts = classes.groupBy("frame").agg(F.count("*").alias("predictions"), *(F.sum((F.col("status") == s).cast("int")).alias(s) for s in ("tp", "duplicate", "fp")))
    rows = frames.join(counts, "frame", "left").na.fill(0)
    bin_ = F.when(F.col("truths") < edges[0], "low").when(F.col("truths") < edges[1], "medium").otherwise("high")
    return rows.groupBy(bin_.alias("bin")).agg(F.count("*").alias("frames"), *(F.sum(c).cast("long").alias(c) for c in ("truths", "predictions", "tp", "duplicate", "fp")), F.sum(F.greatest(F.col("truths") - F.col("predictions"), F.lit(0))).cast("long").alias("shortfall"))


def round_robin(rows: DataFrame, domain: str, video: str, order: list[Column], batch: int) -> DataFrame:
    """Base coverage of domain-balanced batches: every batch has half its places for a domain, dealt in turn to the domain's videos.

    Item k of the v-th of V videos takes place k * V + v of its domain.  Adds slot, batch_id and
    position; shorter videos leave places to weighted repeats.
    """
    half = batch // 2
    videos = rows.select(domain, video).distinct().withColumn("v", F.row_number().over(Window.partitionBy(domain).orderBy(video)) - 1)
    videos = videos.withColumn("videos", F.count("*").over(Window.partitionBy(domain)))
    placed = rows.withColumn("k", F.row_number().over(Window.partitionBy(domain, video).orderBy(*order)) - 1).join(videos, [domain, video])
    slot = (F.col("k") * F.col("videos") + F.col("v")).cast("long")
    return placed.withColumn("slot", slot).withColumn("batch_id", F.floor(F.col("slot") / half).cast("long")).withColumn("position", (F.col("slot") % half).cast("long")).drop("k", "v", "videos")
