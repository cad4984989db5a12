"""Turns that share a number, or have none, come in the order of role and text."""

from trackloom.llm import chat


def test_tied_turns_are_in_order(spark):
    rows = [(c, t, role, f"{w} {c}") for c in range(12) for t in (0, 1, None) for role in ("b", "a") for w in ("pear", "apple", "fig")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    got = {r["conv_id"]: r["chat"] for r in chat.format_chats(frame).collect()}
    want = {c: "".join(f"<|{role}|>\n{w} {c}\n" for _ in range(3) for role in ("a", "b") for w in ("apple", "fig", "pear")) for c in range(12)}
    assert got == want


def test_snapshot_inside_a_tie(spark):
    rows = []
    for c in range(0, 20, 2):
        a, b = f"alpha {c}", f"beta {c}"
        rows += [(c, 0, "u", a), (c + 1, 0, "u", b), (c + 1, 0, "u", a)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert sorted(r["conv_id"] for r in chat.format_chats(frame).collect()) == list(range(1, 20, 2))
