"""Functions over many small groups in few Python calls.

Rows are dealt by key and sorted inside each partition; a worker then walks through the groups
of an Arrow batch as slices of arrays, without a frame object or a round trip for each group.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame

#: What tells frames apart where ``frame`` is a number of the whole table; else name the columns of the video as well.
FRAME = ("frame",)


def typed(df: DataFrame, columns) -> str:
    """The part of a schema for columns of ``df``."""
    kinds = dict(df.dtypes)
    return ", ".join(f"{c} {kinds[c]}" for c in columns)


def _differs(a: np.ndarray, b) -> np.ndarray:
    """Where keys differ; nulls are like one another."""
    return (a != b) & ~(pd.isna(a) & pd.isna(b))


def per_group(df: DataFrame, keys: Sequence[str], order: list[str | Column], fn: Callable[[dict[str, np.ndarray]], dict[str, np.ndarray]], schema: str, parts: int | None = None, together: int = 0) -> DataFrame:
    """``fn`` over the rows of each group of ``keys``, in ``order``; it maps columns to columns.

    Null keys are keys like any other.  A group must fit into a worker: frames of some hundred
    boxes, single tracks.  ``parts`` sets the number of partitions.  With ``together`` whole groups
    of about so many rows are handed over at a time, and ``fn`` also gets the rows where they begin.
    """
    keys, names = list(keys), [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        held: list[pd.DataFrame] = []

        def emit(rows: pd.DataFrame):
            columns = {c: rows[c].to_numpy() for c in rows.columns}
            change = np.zeros(len(rows), bool)
            for k in keys:
                change[1:] |= _differs(columns[k][1:], columns[k][:-1])
            if together:
                return pd.DataFrame(fn(columns, np.append(0, np.flatnonzero(change))))[names]
            edges = [0, *np.flatnonzero(change).tolist(), len(rows)]
            out = [fn({c: x[a:b] for c, x in columns.items()}) for a, b in zip(edges[:-1], edges[1:], strict=True)]
            return pd.DataFrame({n: np.concatenate([np.asarray(o[n]) for o in out]) for n in names})

        for batch in batches:
            if not len(batch):
                continue
            last = np.ones(len(batch), bool)
            for k in keys:
                last &= ~_differs(batch[k].to_numpy(), batch[k].iloc[-1])
            at = len(batch) - int(last[::-1].argmin()) if not last.all() else 0
            same = bool(held) and not any(_differs(held[-1][k].iloc[-1:].to_numpy(), batch[k].iloc[0])[0] for k in keys)
            count = sum(map(len, held))
            if held and not same and count >= together:
                yield emit(pd.concat(held, ignore_index=True))
                held, count = [], 0
            if at and count + at >= together:
                yield emit(pd.concat([*held, batch.iloc[:at]], ignore_index=True))
                held, batch = [], batch.iloc[at:]
            held.append(batch)
        if held:
            yield emit(pd.concat(held, ignore_index=True))

    return df.repartition(*([parts] if parts else []), *keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)
