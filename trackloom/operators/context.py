"""What measurements from outside say about changes that are seen: joined by scope and window only, and never a diagnosis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .nullsafe import join_same

WINDOW = ["domain", "video", "grp", "window_index"]
NUMBERS = ["temperature_c", "temperature_baseline_c", "rain_mm", "wind_m_s", "hive_weight_delta_kg", "dead_bee_count"]
SIGNS = ["queen_cell_verified", "vibration_swarm_candidate", "pesticide_exposure_record"]
#: The scenarios and the measurements each needs.
NEEDS = {"weather": ["temperature_c", "temperature_baseline_c"], "swarming": ["queen_cell_verified", "vibration_swarm_candidate"], "pesticide": ["pesticide_exposure_record", "dead_bee_count"]}


def joined_records(records: DataFrame) -> DataFrame:
    """One row a window: sources (in the order of ``seq``) and of each measurement the last that is known; records without a source do not count."""
    sourced = records.where(F.coalesce(F.col("source") != "", F.lit(False)))
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c) for c in NUMBERS + SIGNS]
    sources = F.transform(F.array_sort(F.collect_list(F.struct("seq", "source"))), lambda r: r["source"])
    return sourced.groupBy(*WINDOW).agg(sources.alias("sources"), *last)


def _finite(c: str) -> Column:
    v = F.col(c).cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)


def interpreted_context(windows: DataFrame, changes: DataFrame, records: DataFrame, least_coverage: float = 0.9) -> DataFrame:
    """A row for each window and scenario: WINDOW, scenario, status, changes (how many are flagged), sources, missing and gate_passed.

    ``windows`` has WINDOW, coverage, tracked_fraction, observable_fraction; ``changes`` WINDOW, metric, flagged; ``records`` WINDOW, seq, source and
    the measurements.  The gate: covered, four fifths of boxes tracked, and where a metric of motion changed half observable.  Status: review_candidate
    (gate, a change and a measurement that fits), no_joint_signal_in_this_window (gate, a source and all that the scenario needs), else
    insufficient_evidence.  A number that is not finite is known but says nothing.
    """
    motion = F.col("metric").isin("active_fraction", "median_speed", "median_speed_bl_proxy_s")
    flagged = changes.where("flagged").groupBy(*WINDOW).agg(F.count("*").alias("changes"), F.max(motion.cast("int")).alias("motion_"))
    rows = join_same(join_same(windows.select(*WINDOW, "coverage", "tracked_fraction", "observable_fraction"), flagged, WINDOW, "left"), joined_records(records), WINDOW, "left")
    gate = (F.col("coverage") >= least_coverage) & (F.col("tracked_fraction") >= 0.8) & (F.coalesce(F.col("motion_") == 0, F.lit(True)) | (F.col("observable_fraction") >= 0.5))
    rows = rows.withColumns({"gate_passed": F.coalesce(gate, F.lit(False)), "changes": F.coalesce("changes", F.lit(0)).cast("long"), "sources": F.coalesce("sources", F.array().cast("array<string>"))})
    yes = lambda c: F.coalesce(c, F.lit(False))
    fits = {
        "weather": yes(_finite("temperature_c") > _finite("temperature_baseline_c")) | yes(_finite("rain_mm") > 0) | yes(_finite("wind_m_s") > 0),
        "swarming": yes(F.col("queen_cell_verified")) | yes(F.col("vibration_swarm_candidate")) | yes(_finite("hive_weight_delta_kg") < 0),
        "pesticide": yes(F.col("pesticide_exposure_record")) & yes(_finite("dead_bee_count") > 0),
    }
    missing = lambda s: F.array_compact(F.array(*(F.when(F.col(c).isNull(), c) for c in NEEDS[s])))
    cases = F.array(*(F.struct(F.lit(s).alias("scenario"), fits[s].alias("fits"), missing(s).alias("missing")) for s in NEEDS))
    rows = rows.select(*WINDOW, "changes", "sources", "gate_passed", F.explode(cases).alias("s")).select("*", "s.*").drop("s")
    known = (F.size("sources") > 0) & (F.size("missing") == 0)
    status = F.when(F.col("gate_passed") & (F.col("changes") > 0) & F.col("fits"), "review_candidate").when(F.col("gate_passed") & known, "no_joint_signal_in_this_window").otherwise("insufficient_evidence")
    return rows.select(*WINDOW, "scenario", status.alias("status"), "changes", "sources", "missing", "gate_passed")


def with_context(rows: DataFrame, context: dict | None) -> DataFrame:
    """Adds context_id, hive_id and context_attributes of an enabled context to every row; without one the rows stay as they are."""
    if not (context or {}).get("enabled"):
        return rows
    pairs = [F.lit(str(v)) for kv in sorted(context.get("attributes", {}).items()) for v in kv]
    attributes = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    return rows.withColumns({"context_id": F.lit(context["context_id"]), "hive_id": F.lit(context["hive_id"]), "context_attributes": attributes})
