"""Urls, rules and host reputation."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from fairsplit.llm import url_filter

CASES = [
    ("http://Example.NET/en/5.html?x=1", "example.net", "/en/5.html", "example.net/en/", "allow"),
    ("https://a.example.net/de/5", "a.example.net", "/de/5", "net/", "block"),
    ("https://notexample.com/de/7", "notexample.com", "/de/7", None, None),
    ("https://x.example.com/de/7#top", "x.example.com", "/de/7", "example.com/de/", "block"),
    ("https://y.org/fr/1", "y.org", "/fr/1", "org/fr/", "allow"),
    ("https://y.org/fr", "y.org", "/fr", None, None),
    ("http://net", "net", "", None, None), ("http://net?x", "net", "", None, None),
    ("ftp://h://p/q", "h:", "//p/q", None, None), ("no scheme", "", "", None, None), (None, "", "", None, None),
    ("", "", "", None, None), ("://", "", "", None, None), ("http://É.com/Ä", "É.com", "/Ä", None, None),
]


def pages(spark, urls, extra=""):
    return spark.createDataFrame([(i, u, "") for i, u in enumerate(urls)], "page_id long, url string, html string")


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_hosts_paths_and_rules(spark):
    df = pages(spark, [c[0] for c in CASES]).selectExpr("*", "'x' as host", "'y' as path", "1 as mean", "2 as rule")
    got = url_filter.judge(df, labels(spark, [])).orderBy("page_id").collect()
    for row, (_, host, path, rule, verdict) in zip(got, CASES):
        assert (row.host, row.path, row.rule) == (host, path, rule)
        assert row.verdict == (verdict or "allow")
    assert len(got) == len(CASES)


def test_bad_hosts_are_blocked(spark):
    """Many bad pages block a host, a few are shrunk towards the others of its domain and suffix."""
    urls, marks = [], []
    for host, n, bad in (("bad.a.com", 60, 60), ("good.a.com", 60, 2), ("few.b.com", 1, 1), ("far.c.io", 80, 4),
                         ("unseen.d.io", 0, 0)):
        for i in range(max(1, n)):
            number = len(urls)
            urls.append(f"http://{host}/x/{number}.html")
            if n:
                marks.append((number, 0 if i < bad else 1, None))
    got = url_filter.judge(pages(spark, urls), labels(spark, marks + [(None, 0, 0), (9999, 0, 1), (0, None, None)]))
    rows = {r.host: r for r in got.collect()}
    assert [rows[h].verdict for h in ("bad.a.com", "good.a.com", "few.b.com", "far.c.io", "unseen.d.io")] == [
        "block", "allow", "allow", "allow", "allow"]
    assert rows["bad.a.com"]["mean"] > rows["few.b.com"]["mean"] > rows["far.c.io"]["mean"]
    assert all(r.low <= r["mean"] for r in rows.values())


@pytest.mark.parametrize("host,domain,suffix", [
    ("a.b.com", "b.com", "com"), ("b.com", "b.com", "com"), ("a.b.co.uk", "b.co.uk", "co.uk"), ("local", "local", "local"),
    ("", "", "")])
def test_site_levels(spark, host, domain, suffix):
    row = spark.createDataFrame([(host,)], "h string").select(*url_filter.site_levels(F.col("h"))).first()
    assert tuple(row) == (domain, suffix)


def test_empty_tables_and_no_python(spark):
    judged = url_filter.judge(pages(spark, []), labels(spark, []))
    assert judged.count() == 0
    assert not re.search("Python|Pandas|Arrow", judged._jdf.queryExecution().toString())
