"""Sampling two domains in pairs: every row once, videos in turn, then weighted draws that follow the debts of an earlier step."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import settle
from .nullsafe import join_same
from .ranks import carried, numbered, running

DEBTS = ["coverage_debt", "recall_debt", "generalization_gap"]
_BLOCK = 4096


def uniform(*parts: Column | str | int) -> Column:
    """A number from 0 to below 1 that only depends on ``parts``."""
    text = F.concat_ws("-", *(p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def carry_debts(old: DataFrame, new: DataFrame) -> DataFrame:
    """The debts (video, and ``DEBTS``) that hold after a step: what it measured, else what was known."""
    both = [df.select("video", *(F.col(c).cast("double").alias(c) for c in DEBTS)) for df in (old, new)]
    tagged = both[0].withColumn("step_", F.lit(0)).unionByName(both[1].withColumn("step_", F.lit(1)))
    return tagged.groupBy("video").agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.col("step_"))).alias(c) for c in DEBTS))


def domain_balanced(rows: DataFrame, domains: tuple[str, str], debts: DataFrame, correction: float = 0.25, hard: float = 0.25, unlabelled: float = 0.25, seed: int = 2026, epoch: int = 0, world: int = 1) -> DataFrame:
    """The order of an epoch: position, pair, phase (base, correction, fill), domain, video, id.

    ``rows`` have a distinct id, domain, video, labelled, hard and weight.  Base pairs take every row of the larger domain
    once and those of the smaller again and again; a domain's videos take turns in an order of their own, and each video's
    rows come in random order.  Then come a share ``correction`` of weighted draws with replacement, and more until the
    rows deal out over ``world`` ranks.  A draw turns to the domain's next video by name; with chance ``unlabelled`` it
    takes unlabelled rows, with chance ``hard`` hard ones, each where there are any, and rows of the whole domain where the
    video has none.  A row weighs weight * (1 + its video's positive debts), in whole millionths, at least one.

    Draws are looked up by their place in the running weights of a pool, in ranges, so that a pool may have any size.  The
    same input and ``epoch`` give the same order.  Null videos are one video, '', null flags are false, a null weight is 1;
    rows of other domains are left out; a domain without rows raises.
    """
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    known = rows.where(F.col("domain").isin(*domains)).select("id", "domain", F.coalesce(F.col("video").cast("string"), F.lit("")).alias("video"), flag("labelled").alias("labelled"), flag("hard").alias("hard"), F.coalesce(F.col("weight").cast("double"), F.lit(1.0)).alias("weight"))
    tag = f"{seed}-{epoch}"
    mixed = numbered(known.withColumns({"key_": F.md5(F.concat_ws("-", F.lit(tag), F.col("id").cast("string"))), "turn_": F.md5(F.concat_ws("-", F.lit(tag), F.lit("video"), "video"))}), ["domain", "video"], ["key_", "id"], "place_")
    known = settle(numbered(mixed, ["domain"], ["place_", "turn_", "video"], "k_"), "balanced")
    has = {r["domain"]: r for r in known.groupBy("domain").agg(F.count("*").alias("n"), F.count_if("labelled").alias("lab"), F.count_if(~F.col("labelled")).alias("unl"), F.count_distinct("video").alias("videos")).collect()}  # two rows
    for d in domains:
        if d not in has:
            raise ValueError(f"domain {d} has no rows")
    base = max(has[d]["n"] for d in domains)
    planned = base + math.ceil(base * correction)
    pairs = planned + next(k for k in range(world) if 2 * (planned + k) % world == 0)
    per = lambda what: F.when(F.col("domain") == domains[0], F.lit(what(has[domains[0]]))).otherwise(F.lit(what(has[domains[1]])))
    n, k = per(lambda r: r["n"]), F.col("k_") - 1
    last = F.floor((F.lit(base - 1) - k) / n)  # how often a row comes again
    blocks = known.select("id", "domain", "video", k.alias("k"), last.alias("last"), n.alias("n")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("last") / _BLOCK))))
    again = blocks.withColumn("again", F.explode(F.sequence(F.col("block") * _BLOCK, F.least(F.col("block") * _BLOCK + _BLOCK - 1, "last"))))
    based = again.select((F.col("k") + F.col("again") * F.col("n")).alias("pair"), F.lit("base").alias("phase"), "domain", "video", "id")
    drawn = _draws(known, domains, per, debts, base, planned, pairs, (hard, unlabelled), tag, epoch)
    out = based.unionByName(drawn)
    return out.select((2 * F.col("pair") + (F.col("domain") == domains[1]).cast("long")).alias("position"), "pair", "phase", "domain", "video", "id")


def _draws(known: DataFrame, domains, per, debts: DataFrame, base: int, planned: int, pairs: int, chances: tuple[float, float], tag: str, epoch: int) -> DataFrame:
    pool = ["domain", "scope", "kind", "only_hard"]
    of = lambda name: uniform(tag, name, F.col("domain"), F.col("pair"))
    slots = known.sparkSession.range(base, pairs).select(F.col("id").alias("pair"), F.explode(F.array(*map(F.lit, domains))).alias("domain"))
    step = F.when(F.col("pair") < planned, F.col("pair") - base).otherwise(F.col("pair"))
    use_unlabelled = (per(lambda r: r["unl"]) > 0) & (of("unlabelled") < chances[1])
    kind = F.when(use_unlabelled, "unl").when(per(lambda r: r["lab"]) > 0, "lab").otherwise("all")
    slots = slots.withColumns({"v_": F.pmod(step + epoch, per(lambda r: r["videos"])), "kind": kind})
    videos = numbered(known.select("domain", "video").distinct(), ["domain"], ["video"], "v1_").select("domain", "video", (F.col("v1_") - 1).alias("v_"))
    # each row in the pools of its video and of its domain, of its kind and of all kinds
    kinds = F.array(F.lit("all"), F.when(F.col("labelled"), "lab").otherwise("unl"))
    seats = known.withColumn("kind", F.explode(kinds)).withColumn("scope", F.explode(F.array(F.col("video"), F.lit(None).cast("string"))))
    sizes = settle(seats.groupBy("domain", "scope", "kind").agg(F.count_if("hard").alias("hards")), "pools")
    narrow = sizes.where("scope is not null").select("domain", F.col("scope").alias("video"), "kind", F.lit(True).alias("own_"))
    slots = slots.join(videos, ["domain", "v_"]).join(narrow, ["domain", "video", "kind"], "left").withColumn("scope", F.when(F.col("own_"), F.col("video"))).drop("video", "own_", "v_")
    slots = settle(join_same(slots, sizes, ["domain", "scope", "kind"]).withColumn("only_hard", (F.col("hards") > 0) & (of("hard") < chances[0])).drop("hards"), "slots")
    debt = sum((F.greatest(F.coalesce(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)) for c in DEBTS), F.lit(0.0))
    owed = debts.select(F.coalesce(F.col("video").cast("string"), F.lit("")).alias("video"), debt.alias("debt_"))
    heavy = F.greatest(F.floor(F.greatest(F.col("weight"), F.lit(1e-6)) * (1 + F.coalesce("debt_", F.lit(0.0))) * 1_000_000.0), F.lit(1)).cast("long")
    members = seats.withColumn("only_hard", F.explode(F.when(F.col("hard"), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(False)))))
    members = join_same(members, slots.select(*pool).distinct(), pool, "semi").join(owed, "video", "left").select(*pool, "video", "id", heavy.alias("w_"))
    summed = settle(running(members, pool, ["id"], "w_", "upto_"), "weights")
    totals = summed.groupBy(*pool).agg(F.sum("w_").alias("all_"))
    asked = join_same(slots, totals, pool).select(*pool, F.floor(of("pick") * F.col("all_")).cast("long").alias("at"), "pair", F.lit(None).cast(summed.select(F.struct("id", "video")).schema[0].dataType).alias("row"))
    starts = summed.select(*pool, (F.col("upto_") - F.col("w_")).alias("at"), F.lit(-1).cast("long").alias("pair"), F.struct("id", "video").alias("row"))
    met = carried(starts.unionByName(asked), pool, ["at", "pair"], "row", "taken").where("pair >= 0")
    return met.select("pair", F.when(F.col("pair") < planned, "correction").otherwise("fill").alias("phase"), "domain", F.col("taken.video").alias("video"), F.col("taken.id").alias("id"))


def rank_slices(order: DataFrame, domains: tuple[str, str], world: int, layout: str = "dealt", batch: int | None = None) -> DataFrame:
    """``order`` with rank_ and slot, the place in the rank's own sequence.

    dealt: positions in turn.  by_domain (two ranks): batches of one domain, the other one on the other rank, changing
    every batch; each rank takes one side of every pair.  synchronised (two
    ranks): both ranks take a batch of the same domain, then one of the other; an odd last batch has a domain for each
    rank, and pairs that fill no batch are left out.
    """
    if layout == "dealt":
        return order.withColumns({"rank_": F.col("position") % world, "slot": F.floor(F.col("position") / world)})
    if layout not in ("by_domain", "synchronised"):
        raise ValueError(f"unknown layout {layout}")
    if world != 2 or not batch or batch < 1:
        raise ValueError(f"{layout} needs two ranks and a batch size")
    side = (F.col("domain") == domains[1]).cast("long")
    if layout == "by_domain":
        return order.withColumns({"rank_": F.pmod(side - F.floor(F.col("pair") / batch), F.lit(2)), "slot": F.col("pair")})
    full = order.agg(F.max("pair").alias("m")).first()["m"]
    batches = 0 if full is None else (full + 1) // batch
    even = batches - batches % 2
    within, group = F.col("pair") % (2 * batch), F.floor(F.col("pair") / (2 * batch))
    odd = F.col("pair") >= even * batch
    rank = F.when(odd, side).otherwise(F.floor(within / batch))
    slot = F.when(odd, F.col("pair")).otherwise((2 * group + side) * batch + within % batch)
    return order.where(F.col("pair") < batches * batch).withColumns({"rank_": rank.cast("long"), "slot": slot.cast("long")})
