"""Sampling queries over all domains and all components, against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackloom.operators import sampling
from trackloom.plans import record_queries


def greedy(rows, k):
    """(label, key, rank) by hand; rows of (label, key, value, vector)."""
    out = []
    for g in sorted({r[0] for r in rows}):
        own = sorted((r for r in rows if r[0] == g), key=lambda r: r[1])
        if len(own) <= k:
            out += [(g, r[1], n + 1) for n, r in enumerate(own)]
            continue
        x = np.array([r[3] for r in own], float)
        x = (x - x.mean(0)) / np.maximum(x.std(0), 1e-9)
        worth = np.array([r[2] for r in own], float)
        score, chosen, far = worth - 0.01 * np.linalg.norm(x, axis=1), [], np.full(len(own), np.inf)
        for _ in range(k):
            score[chosen] = -np.inf
            chosen.append(int(np.argmax(score)))
            far = np.minimum(far, np.linalg.norm(x - x[chosen[-1]], axis=1))
            score = worth + np.minimum(far, 10)
        out += [(g, own[c][1], n + 1) for n, c in enumerate(chosen)]
    return sorted(out)


def test_representative_of_the_table(spark, tiny):
    rows = [(r["label"], r["vec_id"], r["vec_id"] % 89 / 89.0, r["embedding"]) for r in spark.read.parquet(f"{tiny}/embeddings.parquet").collect()]
    assert sorted(map(tuple, record_queries.representative_topk(spark, tiny).collect())) == greedy(rows, 5)


def test_representative_sees_the_last_component(spark):
    rng = np.random.default_rng(5)
    rows = [(k % 2, k, 0.0, [1.0] * 61 + [round(float(v), 3) for v in rng.normal(size=3)]) for k in range(60)] + [(7, 90, 0.5, [0.0] * 64), (7, 80, 0.1, [1.0] * 64)]
    frame = spark.createDataFrame(rows, "label int, key long, value double, x array<double>")
    assert sorted(map(tuple, sampling.representative(frame, "label", 5, "x", "value", "key").collect())) == greedy(rows, 5)


def test_mmd_sees_all_components(spark, tiny, tmp_path):
    rows = spark.read.parquet(f"{tiny}/embeddings.parquet").select("label", "embedding").collect()
    x, side = np.array([r["embedding"] for r in rows], float), np.array([r["label"] < 5 for r in rows])
    kernel = np.exp(-((x[:, None] - x[None]) ** 2).sum(2) / 2)
    exact = kernel[np.ix_(side, side)].mean() + kernel[np.ix_(~side, ~side)].mean() - 2 * kernel[np.ix_(side, ~side)].mean()
    assert record_queries.mmd(spark, tiny).first()["mmd"] == pytest.approx(exact, rel=0.1)
    # the two sides differ in the last component only
    moved = spark.range(200).select((F.col("id") % 10).cast("int").alias("label"), F.transform(F.sequence(F.lit(1), F.lit(64)), lambda k: F.when((k == 64) & (F.col("id") % 10 < 5), 3.0).otherwise(0.0)).alias("embedding"))
    moved.write.parquet(f"{tmp_path}/embeddings.parquet")
    assert record_queries.mmd(spark, str(tmp_path)).first()["mmd"] > 1


def test_raking_over_many_domains_and_null(spark, tmp_path):
    n = 700
    spark.range(n * 10).select(F.col("id").alias("doc_id"), F.when(F.floor(F.col("id") / 10) % 70 == 0, None).otherwise(F.format_string("l%03d", (F.floor(F.col("id") / 10) % 70).cast("int"))).alias("lang"), F.lit("s").alias("source"), F.lit(1).alias("n_chars")).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = record_queries.raking_weights(spark, str(tmp_path))
    assert got.count() == n * 10
    mass = got.groupBy(F.floor(F.col("sample_id") / 10) % 70).agg(F.sum("weight").alias("m")).collect()
    assert len(mass) == 70 and all(r["m"] == pytest.approx(n * 10 / 70, rel=1e-3) for r in mass)
