"""The curriculum controller: stages that advance on plateaus, in batch and on streams.

Measurements are rows (run, update, video, value, covered, sampled): the recall of each video at
an update, whether coverage was complete and the effective sample large enough.  The same small
state machine runs over sorted partitions and behind ``applyInPandasWithState``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STAGES = 6


@dataclass(frozen=True)
class Rules:
    """When a stage is done: so many updates, of which the last ``window`` move by no more than ``tolerance`` an update."""

    least_updates: int = 5
    window: int = 5
    tolerance: float = 0.002


@dataclass
class Memory:
    """What is kept of a run: its stage, updates in it, and mean and worst value of the stage's last updates."""

    update: int = -(2**62)
    stage: int = 0
    in_stage: int = 0
    means: list = field(default_factory=list)
    worsts: list = field(default_factory=list)


def slope(values: list[float]) -> float:
    """The median slope between all pairs of a few values."""
    all_ = sorted((values[j] - values[i]) / (j - i) for i in range(len(values)) for j in range(i + 1, len(values)))
    n = len(all_)
    return 0.0 if not n else all_[n // 2] if n % 2 else (all_[n // 2 - 1] + all_[n // 2]) / 2


def observe(rules: Rules, m: Memory, update: int, mean: float, worst: float, covered: bool, sampled: bool) -> tuple[Memory, tuple]:
    """The memory after one update, and (stage it counted for, plateau, advance, stop, stage after)."""
    means, worsts, n = [*m.means, mean][-rules.window :], [*m.worsts, worst][-rules.window :], m.in_stage + 1
    plateau = len(means) == rules.window and abs(slope(means)) <= rules.tolerance and abs(slope(worsts)) <= rules.tolerance
    ready = plateau and covered and sampled and n >= rules.least_updates
    stop = ready and m.stage == STAGES - 1
    if ready and not stop:
        return Memory(update, m.stage + 1), (m.stage, plateau, True, False, m.stage + 1)
    return Memory(update, m.stage, n, means, worsts), (m.stage, plateau, False, stop, m.stage)


DECISIONS = "run string, update long, mean double, worst double, stage int, plateau boolean, advance boolean, stop boolean, next_stage int"
_NAMES = [c.split()[0] for c in DECISIONS.split(", ")]
STATE = "update long, stage int, in_stage int, means array<double>, worsts array<double>"


def updates(measured: DataFrame) -> DataFrame:
    """One row an update: run, update, mean, worst, covered, sampled; rows without a value do not count."""
    return measured.where("value is not null").groupBy("run", "update").agg(F.avg("value").alias("mean"), F.min("value").alias("worst"), F.bool_and("covered").alias("covered"), F.bool_and("sampled").alias("sampled"))


def recall_debt(measured: DataFrame) -> DataFrame:
    """run, update, video, debt: how far each video lies below the best one of its update."""
    from pyspark.sql import Window

    best = F.max("value").over(Window.partitionBy("run", "update"))
    return measured.where("value is not null").select("run", "update", "video", (best - F.col("value")).alias("debt"))


def _walk(rules: Rules, m: Memory, rows) -> tuple[Memory, list[tuple]]:
    out = []
    for run, update, mean, worst, covered, sampled in rows:
        if update > m.update:
            m, said = observe(rules, m, update, mean, worst, bool(covered), bool(sampled))
            out.append((run, update, mean, worst, *said))
    return m, out


_COLUMNS = ["run", "update", "mean", "worst", "covered", "sampled"]


def decisions(updates_: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Batch: the controller's decision at each of the ``updates``; a run is walked through in order."""

    def step(batches):
        run, m = None, Memory()
        for b in batches:
            out = []
            for row in b[_COLUMNS].itertuples(index=False):
                if row.run != run:
                    run, m = row.run, Memory()
                m, said = _walk(rules, m, [tuple(row)])
                out += said
            yield pd.DataFrame(out, columns=_NAMES)

    return updates_.where("run is not null").select(*_COLUMNS).repartition("run").sortWithinPartitions("run", "update").mapInPandas(step, DECISIONS)


def stream_decisions(updates_: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Stream: the same decisions; updates of a run must arrive in order from batch to batch, older ones are left out."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        update, stage, n, means, worsts = state.get if state.exists else tuple(vars(Memory()).values())
        m = Memory(update, stage, n, list(means), list(worsts))
        rows = pd.concat(list(batches)).sort_values("update")  # one run's updates of one trigger
        m, out = _walk(rules, m, rows[_COLUMNS].itertuples(index=False, name=None))
        state.update(tuple(vars(m).values()))
        yield pd.DataFrame(out, columns=_NAMES)

    return updates_.select(*_COLUMNS).groupBy("run").applyInPandasWithState(step, DECISIONS, STATE, "append", GroupStateTimeout.NoTimeout)
