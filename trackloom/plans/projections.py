"""Annotation-shaped views of the driver's tables, in Spark and as SQL of the same meaning.

``detections``: a box per line item; ``tracks``: a positioned observation per event;
``records``: a labelled sample per document.  Integer arithmetic only, so that both engines
agree to the last bit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frame, det, domain, video, grp, split, track_id, x1..y2, class_id, origin, conf.

    Rows are numbered before anything is derived, so that the shuffle moves the table's columns alone and rows are known to lie by frame.
    """
    li = table(spark, sf_dir, "lineitem")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate")
    key, part = F.col("l_orderkey"), F.col("l_partkey")
    x, y = (part * 7) % 300, (part * 13) % 200
    return li.withColumn("det", F.row_number().over(order)).select(
        key.alias("frame"), "det",
        F.when(key % 2 == 0, "IR_in").otherwise("RGB_out").alias("domain"),
        F.concat(F.lit("V"), (key % 8).cast("string")).alias("video"), F.concat(F.lit("G"), (key % 3).cast("string")).alias("grp"),
        F.when(key % 10 < 7, "train").when(key % 10 < 9, "calibration").otherwise("test").alias("split"),
        part.alias("track_id"), x.alias("x1"), y.alias("y1"),
        (x + 20 + F.col("l_quantity").cast("int")).alias("x2"), (y + 20 + F.col("l_suppkey") % 40).alias("y2"),
        F.when(F.col("l_suppkey") % 20 == 0, 1).otherwise(0).alias("class_id"),
        F.when(F.col("l_linenumber") % 5 == 0, "linear_interpolation").otherwise("observed").alias("origin"),
        (1 - F.col("l_discount")).alias("conf"),
    )


DET_SQL = """li AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) AS det FROM lineitem),
det AS (SELECT l_orderkey AS frame, det, CASE WHEN l_orderkey % 2 = 0 THEN 'IR_in' ELSE 'RGB_out' END AS domain,
  'V' || CAST(l_orderkey % 8 AS varchar) AS video, 'G' || CAST(l_orderkey % 3 AS varchar) AS grp,
  CASE WHEN l_orderkey % 10 < 7 THEN 'train' WHEN l_orderkey % 10 < 9 THEN 'calibration' ELSE 'test' END AS split, l_partkey AS track_id,
  (l_partkey * 7) % 300 AS x1, (l_partkey * 13) % 200 AS y1, (l_partkey * 7) % 300 + 20 + CAST(l_quantity AS int) AS x2, (l_partkey * 13) % 200 + 20 + l_suppkey % 40 AS y2,
  CASE WHEN l_suppkey % 20 = 0 THEN 1 ELSE 0 END AS class_id, CASE WHEN l_linenumber % 5 = 0 THEN 'linear_interpolation' ELSE 'observed' END AS origin, 1 - l_discount AS conf FROM li),
obs AS (SELECT * FROM det WHERE class_id = 0 AND origin = 'observed')"""


def observed(dets: DataFrame) -> DataFrame:
    """The rows that analytics may use: no shadows and no fills."""
    return dets.where((F.col("class_id") == 0) & (F.col("origin") == "observed"))


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """track_id, frame (minutes), event_id, state, x, y; one scope for each event type's first letter is not kept: tracks are global."""
    e = table(spark, sf_dir, "events")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    return e.select(
        F.col("user_id").alias("track_id"), F.floor(micros / 60_000_000).cast("long").alias("frame"), "event_id", F.col("event_type").alias("state"),
        F.get_json_object("props", "$.k").cast("int").alias("x"), (F.col("event_id") * 37 % 100).cast("int").alias("y"),
    )


TRK_SQL = """trk AS (SELECT user_id AS track_id, CAST(epoch_us(ts) // 60000000 AS bigint) AS frame, event_id, event_type AS state,
  CAST(json_extract_string(props, '$.k') AS int) AS x, CAST(event_id * 37 % 100 AS int) AS y FROM events)"""


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sample_id, domain, grp, split, correct, risk, size: labelled samples."""
    d, lab = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    joined = d.select("doc_id", "lang", "source", "n_chars").join(lab, "doc_id", "left")
    key = F.col("doc_id")
    return joined.select(
        key.alias("sample_id"), F.col("lang").alias("domain"), F.col("source").alias("grp"),
        F.when(key % 10 < 7, "train").when(key % 10 < 9, "calibration").otherwise("test").alias("split"),
        F.col("quality").alias("correct"), F.col("toxic").alias("risk"), F.col("n_chars").alias("size"),
    )


REC_SQL = """rec AS (SELECT d.doc_id AS sample_id, lang AS domain, source AS grp, CASE WHEN d.doc_id % 10 < 7 THEN 'train' WHEN d.doc_id % 10 < 9 THEN 'calibration' ELSE 'test' END AS split,
  quality AS correct, toxic AS risk, n_chars AS size FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""
