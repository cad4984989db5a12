"""Helpers that the corpus operators share: durable intermediate tables and batch slicing."""

from __future__ import annotations

import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder URI under ``spark.checkpoint.dir``, which driver and executors share.

    A session on one machine (tests, notebooks) that does not set that folder uses a local
    temporary one; on a cluster an unset folder raises.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"file://{tempfile.gettempdir()}/trackloom-work"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    Cuts lineage: what follows survives lost executors and never repeats the work above.
    """
    path = work_dir(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def slices(batch: pa.RecordBatch, rows: int):
    """Parts of at most ``rows`` rows, so that whole texts never pile up in a worker."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)
