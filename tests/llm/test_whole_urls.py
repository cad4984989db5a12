"""Canonical links and refreshes in any case, relative targets, escaped ampersands."""

import pytest

from trackloom.llm import url_filter

RESOLVED = [
    ("/en/7", "http://com/en/7"), ("//x.com/y", "http://x.com/y"), ("next.html", "http://com/a/next.html"), ("../n?x#y", "http://com/n?x#y"), ("./", "http://com/a/"), ("..", "http://com/"), ("?p=2", "http://com/a/b?p=2"),
    ("/go?u=http://z.org/", "http://com/go?u=http://z.org/"), ("https://q.net/?a=1&amp;b=2", "https://q.net/?a=1&b=2"), ("mailto:a@b.c", None), ("", None),
]


def test_targets_are_resolved(spark):
    rows = [(k, t, "http://com/a/b?q=1") for k, (t, _) in enumerate(RESOLVED)] + [(99, "/x", "nothing"), (100, "n.html", "http://com")]
    frame = spark.createDataFrame(rows, "k int, t string, u string")
    got = dict(frame.select("k", url_filter.resolved(frame.t, frame.u)).collect())
    assert got == {**{k: w for k, (_, w) in enumerate(RESOLVED)}, 99: None, 100: "http://com/n.html"}


@pytest.mark.parametrize(
    "url, html",
    [
        ("http://far.io/a", '<LINK REL="CANONICAL" HREF="https://com/en/1">'),
        ("http://far.io/a", '<link rel="Canonical" href="https://com/en/1">'),
        ("http://far.io/a", "<link rel=canonical href=//com/en/1>"),
        ("http://far.io/a", '<meta http-equiv=Refresh content="0;URL=//com/en/1">'),
    ],
)
def test_aliases_in_any_case(spark, url, html):
    rules = spark.createDataFrame(url_filter.RULES, "verdict string, host string, path string")
    pages = spark.createDataFrame([(1, url, html)], "page_id int, url string, html string")
    assert [(r["verdict"], r["via"]) for r in url_filter.judge_urls(pages, rules).collect()] == [("block", "alias")]


def test_relative_alias_reaches_another_page(spark):
    rules = spark.createDataFrame([("block", "far.io", "/bad/")], "verdict string, host string, path string")
    rows = [(1, "http://far.io/a?x=1&y=2", '<link rel="canonical" href="/bad/7">'), (2, "http://o.io/", '<link rel="canonical" href="http://far.io/a?x=1&amp;y=2">'), (3, "http://far.io/c", None)]
    pages = spark.createDataFrame(rows, "page_id int, url string, html string")
    assert {r["page_id"]: r["verdict"] for r in url_filter.judge_urls(pages, rules).collect()} == {1: "block", 2: "block", 3: "allow"}


LINKED = [
    (1, "http://far.io/a", '<link rel="canonical" href="http://far.io/a"><link rel="canonical" href="https://com/en/1">'),
    (2, "http://far.io/b", '<link rel="alternate canonical" href="//com/en/2"/>'),
    (3, "http://far.io/c", "<meta name=x content='0;url=http://com/en/3'><META content='5; URL=http://com/en/3' HTTP-EQUIV='Refresh'>"),
    (4, "http://far.io/d", '<link data-rel="canonical" href="http://com/en/4"><link rel="canonicals" href="http://com/en/4">'),
    (5, "http://far.io/e/f/g", "<link href='../../h?x=1' rel=canonical>"),
    (6, "http://far.io/h?x=1", '<link\nrel = "Canonical"\nhref = "http://net/de/1">'),
    (7, "http://far.io/i", '<meta http-equiv="refresh" content="0;url=/a"><meta http-equiv="refresh" content="1;url=./b">'),
    (8, "http://far.io/j", '<link rel="canonical" href="http://org/es/1"><link rel="canonical" href="http://net/de/2">'),
    (9, "nothing", '<link rel="canonical" href="/en/1">'),
    (10, None, None),
]


def verdicts(spark, rows):
    rules = spark.createDataFrame(url_filter.RULES, "verdict string, host string, path string")
    return url_filter.judge_urls(spark.createDataFrame(rows, "page_id int, url string, html string"), rules)


def test_all_links_of_a_page_count(spark):
    got = {r["page_id"]: (r["verdict"], r["via"]) for r in verdicts(spark, LINKED).collect()}
    assert got == {1: ("block", "alias"), 2: ("block", "alias"), 3: ("block", "alias"), 4: ("allow", "default"), 5: ("allow", "alias"), 6: ("allow", "alias"), 7: ("block", "alias"), 8: ("allow", "alias"), 9: ("allow", "default"), 10: ("allow", "default")}


def test_sql_of_links(spark):
    import duckdb
    import pandas as pd

    con = duckdb.connect()
    rows = [*LINKED, *((100 + k, "http://com/a/b?q=1", f'<link rel=canonical href="{t}">') for k, (t, _) in enumerate(RESOLVED))]
    con.register("given", pd.DataFrame(rows, columns=["page_id", "url", "html"]))
    con.execute("create view pages as select cast(page_id as bigint) page_id, url, html from given")
    columns = ["page_id", "host", "path", "rule", "verdict", "via"]
    want = sorted(tuple(r) for r in verdicts(spark, rows).select(*columns).collect())
    assert sorted(con.sql(f"select {', '.join(columns)} from ({url_filter.JUDGE_SQL})").fetchall()) == want


def test_many_lengths_and_long_urls(spark):
    rules = [("block", "x.io", "/" + "p" * k) for k in range(1500)] + [("allow", "deep.a.b.x.io", "/")]
    pages = [(1, "http://x.io/" + "p" * 700 + "q", None), (2, "http://" + "l." * 50_000 + "x.io/" + "p" * 50_000, None), (3, "http://deep.a.b.x.io/ppp", None), (4, "http://y.io/p", None)]
    found = url_filter.judge_urls(spark.createDataFrame(pages, "page_id int, url string, html string"), spark.createDataFrame(rules, "verdict string, host string, path string"))
    got = {r["page_id"]: (r["verdict"], len(r["rule"] or "")) for r in found.collect()}
    assert got == {1: ("block", 705), 2: ("block", 4 + 1500), 3: ("allow", len("deep.a.b.x.io/")), 4: ("allow", 0)}
