"""Pairs in blocks against the same from a table of pairs, which is never shuffled."""

import random

import pytest
from pyspark.sql import functions as F

from trackloom.operators import colony, contacts, graph, labels, near_blocks, stitching, tracks
from trackloom.plans.catalog import QUERIES


@pytest.fixture(scope="module")
def obs(spark):
    rnd = random.Random(11)
    rows = [(rnd.choice([1, 2, 3, 4, 7, 8, 20]) * 3 - 4, rnd.randrange(40), e if rnd.random() < 0.95 else None, rnd.choice([rnd.uniform(-30, 30), 4.5]), rnd.uniform(-30, 30)) for e in range(500)]
    rows += [(f, t, e, x, y) for f, t, e, x, y in rows[:40] if e is not None] + [(None, 1, 900, 0.0, 0.0), (2, None, 901, 0.0, 0.0), (2, 3, 902, None, 0.0), (2, 3, 903, float("nan"), 0.0), (2, 3, 904, float("inf"), 0.0)]
    rows = [("s", *r) for r in rows] + [("t", -1, 1, 1, 0.0, 0.0), ("t", -1, 2, 2, 1.0, 0.0)]
    return spark.createDataFrame(rows, "scope string, frame long, track_id long, event_id long, x double, y double").cache()


def rows_of(df, columns):
    return sorted(repr(tuple(round(v, 9) if isinstance(v, float) else v for v in r)) for r in df.select(columns).collect())


def same(found, wanted):
    want = rows_of(wanted, wanted.columns)
    assert want and rows_of(found, wanted.columns) == want


def test_folds(obs):
    one = obs.where("scope = 's'")
    near = tracks.radius_pairs(one.where("x < 1000"), 9.0)
    same(near_blocks.near_episodes(one, 9.0, 5), tracks.pair_persistence(near, 5))
    same(near_blocks.near_confirmed(one, 9.0, 3, 2), labels.confirmed_pairs(near, 3, 2))
    vote = near.select("a", "b", F.when(F.col("a_id") < F.col("b_id"), "forward").otherwise("reverse").alias("direction"), (F.col("distance") / 5).alias("cost"))
    same(near_blocks.near_votes(one, 9.0, 5), graph.edge_votes(vote))
    same(near_blocks.near_windows(one, 9.0, 6), colony.proximity_network(near.withColumn("window_index", F.floor(F.col("frame") / 6).cast("long")), 6))
    scoped = near.withColumn("scope", F.lit("s"))
    same(near_blocks.near_contacts(one, 9.0, 2.0, 2.0, 1.0, ["scope"]), stitching.lasting_contacts(scoped, one, 2.0, 2.0, 1.0))
    same(near_blocks.near_contact_edges(one, 9.0, 2.0, 2.0, 1.0, 8, ["scope"]), contacts.contact_edges(contacts.counted_contacts(scoped, one, 2.0, 2.0, 1.0), 8, 2.0))


def test_scopes_and_nothing(obs):
    found = near_blocks.near_episodes(obs, 2.0, 5, ["scope"]).where("scope = 't'").collect()
    assert [tuple(r) for r in found] == [("t", 1, 2, 1, -1, -1, 1)]
    empty = obs.limit(0)
    for df in (near_blocks.near_episodes(empty, 2.0), near_blocks.near_votes(empty, 2.0), near_blocks.near_windows(empty, 2.0, 3), near_blocks.mutual_neighbours(empty, 2.0), near_blocks.near_contacts(empty, 2.0, 1.0, 2.0, 1.0)):
        assert df.isEmpty()


def test_nearest(obs):
    one = obs.where("scope = 's'")
    for radius in (3.0, 25.0):
        near = tracks.radius_pairs(one.where("x < 1000"), radius)
        same(near_blocks.mutual_neighbours(one, radius), labels.mutual_nearest(near))
        both = near.select("frame", F.col("a").alias("track_id"), "distance").unionByName(near.select("frame", F.col("b").alias("track_id"), "distance"))
        same(near_blocks.nearest_others(one, radius).groupBy("frame", "track_id").agg(F.min("distance").alias("d")), both.groupBy("frame", "track_id").agg(F.min("distance").alias("d")))


@pytest.mark.parametrize("name", ["contact_edges", "lasting_contacts", "mutual_nearest", "pair_persistence", "proximity_network", "edge_votes", "temporal_confirm", "nearest_neighbour"])
def test_pairs_are_not_joined_before_a_shuffle(spark, tiny, name):
    plan = QUERIES[name](spark, tiny)._jdf.queryExecution().analyzed().toString()
    assert "(cx#" not in plan and "MapInPandas" in plan
