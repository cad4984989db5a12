"""Contact networks against a walk over frames, and rules behind reviews."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from trackloom.operators import contacts, knowledge


def walked(near, frames, fps, gap, least, size):
    """The same by one walk over the frames in order."""
    seconds, state = defaultdict(float), {}
    for f in frames:
        now = {}
        for a, b in sorted({(a, b) for g, a, b in near if g == f}):
            old = state.get((a, b))
            start = old[0] if old and (f - old[1]) / fps <= gap else f
            now[a, b] = (start, f)
            if (f - start + 1) / fps >= least:
                seconds[f // size, a, b] += 1 / fps
        state = now
    return seconds


def test_networks(spark):
    rnd = random.Random(5)
    frames = sorted(rnd.sample(range(90), 60))
    near = [(f, a, a + 1 + k) for f in frames for a in range(7) for k in range(2) if rnd.random() < 0.45]
    obs = [("s", f, t, float(t), float(f)) for f in frames for t in range(9)] + [("t", 3, 1, 0.0, 0.0), ("t", 3, None, 9.0, 9.0)]
    rows = spark.createDataFrame(obs, "scope string, frame long, track_id long, x double, y double")
    pairs = spark.createDataFrame([("s", *p) for p in near + near[:5]], "scope string, frame long, a long, b long")
    edges = contacts.contact_edges(contacts.counted_contacts(pairs, rows, 2.0, 1.5, 1.0), 30, 2.0)
    want = walked(near, frames, 2.0, 1.5, 1.0, 30)
    assert want and {(r.window_index, r.a, r.b): round(r.qualified_seconds, 9) for r in edges.collect()} == {k: round(v, 9) for k, v in want.items()}
    nodes = contacts.contact_nodes(rows, edges, 30)
    found = {(r.scope, r.window_index, r.track_id): r for r in nodes.collect()}
    for w in {f // 30 for f in frames}:
        group = {t: t for t in range(9)}
        for _ in range(9):
            for x, a, b in want:
                if x == w:
                    group[a] = group[b] = min(group[a], group[b])
        assert {t: found["s", w, t].component for t in range(9)} == group
        assert all(abs(found["s", w, t].strength - sum(v for (x, a, b), v in want.items() if x == w and t in (a, b))) < 1e-9 for t in range(9))
        assert all(abs(found["s", w, t].mean_y - sum(f for f in frames if f // 30 == w) / sum(f // 30 == w for f in frames)) < 1e-9 for t in range(9))
    nets = {(r.scope, r.window_index): r for r in contacts.contact_networks(nodes, edges).collect()}
    assert (nets["t", 0].nodes, nets["t", 0].edges, nets["t", 0].edge_density, nets["t", 0].largest_component_fraction) == (1, 0, 0, 1)
    for w in {f // 30 for f in frames}:
        count = sum(x == w for x, _, _ in want)
        assert nets["s", w].edges == count and abs(nets["s", w].edge_density - 2 * count / 72) < 1e-9
    nothing = contacts.contact_nodes(rows.limit(0), edges.limit(0), 30)
    assert nothing.isEmpty() and contacts.contact_networks(nothing, edges.limit(0)).isEmpty()


def test_rules(spark):
    nodes = spark.createDataFrame([("a", 3, 1, ["d"], ["v"]), ("b", 1, 1, None, None), ("c", 8, 2, [None, "e"], [])], "id string, alpha int, beta int, domains array<string>, videos array<string>")
    rows = spark.createDataFrame([(1, "a", "d", "v", 0.8), (2, "a", "d", "w", None), (3, "a", "x", "v", 0.8), (4, "zz", "d", "v", 0.8), (5, None, None, None, 0.5), (6, "b", None, None, 1.0), (7, "b", "d", "v", 1.0), (8, "c", "d", "v", 1.0)], "n int, knowledge_source string, domain string, video string, evidence_confidence double")
    found = {r.n: r for r in knowledge.supported_events(rows, nodes).collect()}
    plain = 36 * 3 / (16 * 25)
    assert (found[1].knowledge_support, found[1].evidence_confidence, found[1].visual_evidence_confidence) == (0.75, 0.8 * 0.75, 0.8) and abs(found[1].knowledge_gain - plain) < 1e-12
    assert abs(found[2].knowledge_gain - plain * 1.25) < 1e-12 and found[2].evidence_confidence is None
    assert all((found[n].knowledge_support, found[n].knowledge_gain) == (0.5, 1.0) for n in (3, 4, 5, 8))
    assert found[6].knowledge_support == 0.5 and found[6].knowledge_gain == 1.0 and found[7].knowledge_gain == 1.0
    findings = spark.createDataFrame([("d", "v", "g", 1, -4.0, "observability_check"), ("d", "v", "g", 1, None, "visual_change"), ("d", None, None, 2, None, "observability_check")], "domain string, video string, grp string, window_index long, z double, status string")
    due = {r.window_index: r for r in knowledge.colony_reviews_due(findings, nodes.withColumn("id", F.when(F.col("id") == "a", "colony_temporal_change").otherwise(F.col("id")))).collect()}
    assert due[1].findings == 2 and due[1].reason == "colony_temporal_change" and abs(due[1].priority - (4 * 0.875 + plain)) < 1e-12
    assert due[2].reason == "colony_observability_check" and abs(due[2].priority - plain) < 1e-12
