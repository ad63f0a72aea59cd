"""URL judgements against a plain Python evaluation of the dated list."""

import datetime as dt

from pyspark.sql import functions as F

from tabscout.llm import queries, url_filter

T = dt.datetime(2023, 6, 1)


def day(n):
    return T + dt.timedelta(days=n)


ENTRIES = [
    ("block", "domain", "bad.org", "add", day(0)), ("block", "domain", "bad.org", "remove", day(10)),
    ("block", "domain", "bad.org", "add", day(400)), ("block", "domain", "bad.org", "add", day(5)),
    ("block", "host", "www.news.net", "add", day(3)), ("allow", "prefix", "sub.bad.org/ok", "add", day(2)),
    ("allow", "prefix", "sub.bad.org/ok", "remove", day(4)), ("block", "prefix", "shop.com/a/b", "add", day(1)),
    ("block", "host", "twice.com", "add", day(1)), ("block", "host", "twice.com", "remove", day(1)),
    ("block", "host", "old.com", "remove", day(1)), (None, "host", "old.com", "add", day(1)),
    ("block", "host", None, "add", day(1)), ("block", "host", "old.com", "paint", day(1)),
    ("block", "host", "late.com", "add", day(5000)),
]
URLS = [
    "http://bad.org/x", "https://Sub.BAD.org./ok/page?q=1", "sub.bad.org/okay", "http://notbad.org/",
    "http://user:pw@www.news.net:8080/a", "http://news.net/", "https://shop.com/a/b/c#t", "shop.com/a/bc",
    "http://twice.com", "http://old.com/", "http://late.com/", "", None, "   ", "mailto", "http://",
]


def active(kind, value, name, at):
    state = False
    for who, k, v, action, when in sorted(
            (e for e in ENTRIES if None not in e and e[3] in ("add", "remove")),
            key=lambda e: (e[4], e[3])):
        if (who, k, v) == (name, kind, value) and when <= at:
            state = action == "add"
    return state


def keys(url):
    bare = (url or "").strip(" ")
    bare = bare.split("://", 1)[-1]
    head = bare
    for mark in "/?#":
        head = head.split(mark, 1)[0]
    host = head.split("@")[-1].split(":")[0].rstrip(".").lower()
    if not host:
        return []
    path = bare[len(head):].split("?")[0].split("#")[0].lstrip("/").rstrip("/").split("/")
    labels = host.split(".")
    return ([("domain", ".".join(labels[i:])) for i in range(len(labels))] + [("host", host)]
            + [("prefix", host + "/" + "/".join(path[:i + 1])) for i in range(len(path))])


def test_against_plain_evaluation(spark):
    rows = [(i, u, day(n) if n is not None else None) for i, u in enumerate(URLS)
            for n in (-1, 0, 2, 4, 7, 10, 399, 400, 900, None)] + [(0, URLS[0], day(7))]
    captures = spark.createDataFrame(rows, "page_id bigint, url string, fetched_at timestamp").withColumns(
        {"host": F.lit("x"), "key": F.lit(1), "year": F.lit(1)})
    entries = spark.createDataFrame(
        ENTRIES, "list string, kind string, value string, action string, at timestamp").withColumn(
        "year", F.lit(3))
    got = sorted(((r.page_id, r.url, r.fetched_at, r.n_block, r.n_allow, r.allowed)
                  for r in url_filter.judge(captures, entries).collect()), key=str)
    want = []
    for page, url, at in rows:
        hits = {n: sum(active(k, v, n, at) for k, v in keys(url)) if at else 0 for n in ("block", "allow")}
        want.append((page, url, at, hits["block"], hits["allow"], not hits["block"] or hits["allow"] > 0))
    assert got == sorted(want, key=str)


def test_empty_tables(spark):
    captures = spark.createDataFrame([], "page_id bigint, url string, fetched_at timestamp")
    entries = spark.createDataFrame([], "list string, kind string, value string, action string, at timestamp")
    assert url_filter.judge(captures, entries).count() == 0
    one = spark.createDataFrame([(1, "http://a.b/", day(0))], captures.schema)
    assert one.count() == url_filter.judge(one, entries).where("allowed").count()


def test_query_blocks_and_allows(spark, data):
    counts = {r["allowed"]: r["count"] for r in queries.op1(spark, data).groupBy("allowed").count().collect()}
    assert counts[True] and counts[False]
