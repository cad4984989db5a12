"""Windows and the splits of their frames, of all lengths, and that no scope is joined with itself."""

from trackloom.operators import reviews


def test_long_and_short(spark):
    frames = spark.createDataFrame([("s", f, "train") for f in range(0, 300, 7)] + [("s", f, "test") for f in range(1000, 1300)] + [("t", 5, "test")], "scope string, frame long, split string")
    events = spark.createDataFrame([("s", 1, 0, 299, "a"), ("s", 2, 7, 7, "b"), ("s", 3, 8, 13, "c"), ("s", 4, 1000, 1299, "d"), ("s", 5, 295, 1000, "e"), ("s", 6, 290, 999, "f"), ("t", 1, 0, 10_000, "g"), ("u", 1, 0, 5, "h"), ("s", 7, 60, 70, "i"), ("s", 8, 130, 330, "j")], "scope string, window_index long, first_frame long, last_frame long, label string")
    found = {(r.scope, r.label): r.split for r in reviews.window_records(events, frames).collect()}
    assert found == {("s", "a"): "train", ("s", "b"): "train", ("s", "c"): "unassigned", ("s", "d"): "test", ("s", "e"): "test", ("s", "f"): "train", ("t", "g"): "test", ("u", "h"): "unassigned", ("s", "i"): "train", ("s", "j"): "train"}
    plan = reviews.window_records(events, frames)._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join Inner" in line]
    assert joins and all("run_" in line for line in joins)


def test_several_splits_raise(spark):
    import pytest

    frames = spark.createDataFrame([("s", f, "train" if f != 100 else "test") for f in range(200)], "scope string, frame long, split string")
    events = spark.createDataFrame([("s", 1, 0, 199, "a")], "scope string, window_index long, first_frame long, last_frame long, label string")
    with pytest.raises(Exception, match="several splits"):
        reviews.window_records(events, frames).collect()
