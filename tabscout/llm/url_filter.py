"""URL filtering against dated lists: validity intervals and an as-of join."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: How a list entry names what it covers.
KINDS = ("domain", "host", "prefix")


def parsed(url):
    """(host, path segments) of a URL column.

    Scheme, user, port, query, fragment and a final dot of the host are dropped; the host
    is lower-cased. Null or host-less URLs give a null host.
    """
    bare = F.regexp_replace(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    authority = F.regexp_extract(bare, r"^([^/?#]*)", 1)
    host = F.lower(F.regexp_replace(
        F.regexp_replace(authority, r"^.*@", ""), r"\.?(:[0-9]*)?$", ""))
    path = F.regexp_extract(bare, r"^[^/?#]*/?([^?#]*)", 1)
    return F.when(host != "", host), F.split(F.regexp_replace(path, r"/+$", ""), "/")


def lookup_keys(url):
    """Every key under which an entry could cover the URL: array of (kind, value)."""
    host, segments = parsed(url)
    labels = F.split(host, r"\.")
    domains = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.struct(F.lit("domain").alias("kind"), F.array_join(
            F.slice(labels, i, F.size(labels)), ".").alias("value")))
    prefixes = F.transform(
        F.sequence(F.lit(1), F.size(segments)),
        lambda i: F.struct(F.lit("prefix").alias("kind"), F.concat(
            host, F.lit("/"), F.array_join(F.slice(segments, F.lit(1), i), "/")).alias("value")))
    whole = F.array(F.struct(F.lit("host").alias("kind"), host.alias("value")))
    return F.when(host.isNotNull(), F.array_distinct(F.concat(domains, whole, prefixes)))


def validity_intervals(entries: DataFrame) -> DataFrame:
    """Dated entries (list, kind, value, action add/remove, at) as intervals [from, until).

    An add opens an interval, the next remove of the same list, kind and value closes it;
    an interval that nothing closes has a null end. Repeated adds or removes change nothing;
    of an add and a remove at the same moment the remove counts. Rows with a null in any
    column or an unknown action are no entries.
    """
    key = ["list", "kind", "value"]
    # One row for each key and moment, folded before the shuffle.
    changes = (
        entries.where(F.col("action").isin("add", "remove"))
        .select(*key, "action", "at").dropna()
        .groupBy(*key, "at").agg(F.min(F.col("action") == "add").alias("on")))
    order = Window.partitionBy(*key).orderBy("at")
    turns = changes.withColumn("was", F.lag("on", 1, False).over(order)).where(
        F.col("on") != F.col("was"))
    return turns.withColumn("until", F.lead("at").over(order)).where("on").select(
        *key, F.col("at").alias("from"), "until")


def filter_urls(captures: DataFrame, entries: DataFrame, url: str = "url",
                at: str = "fetched_at", block: str = "block", allow: str = "allow") -> DataFrame:
    """Judge every capture by the entries that were active when it was fetched.

    Returns (url, fetched_at, n_block, n_allow, block_entry, allowed): one row for every
    distinct pair of URL and fetch time, the counts of active block and allow entries that
    cover the URL, the least block entry as "kind:value", and the verdict: a URL is refused
    if a block entry covers it and no allow entry does. A null or host-less URL or a null
    time is covered by nothing and allowed. Repeated captures share a row; `judge` joins
    the verdict to the captures.

    Intervals of one list, kind and value never overlap, so the join on key and year with
    a check of the times is the as-of join, and finds at most one interval per entry. The
    year keeps long histories of one key apart; a popular host is split by adaptive
    execution since the join is a plain equi-join.
    """
    pairs = captures.select(F.col(url).alias("url"), F.col(at).alias("fetched_at")).distinct()
    keys = pairs.where("fetched_at IS NOT NULL").select(
        "url", "fetched_at", F.explode(lookup_keys(F.col("url"))).alias("key")
    ).select("url", "fetched_at", "key.*", F.year("fetched_at").alias("year"))
    horizon = pairs.agg(F.year(F.max("fetched_at")).alias("last"))
    last = horizon.first()["last"] or 0
    spans = validity_intervals(entries).where(F.year("from") <= last).withColumn(
        "year", F.explode(F.sequence(
            F.year("from"), F.least(F.coalesce(F.year("until"), F.lit(last)), F.lit(last)))))
    hits = keys.join(spans, ["kind", "value", "year"]).where(
        (F.col("fetched_at") >= F.col("from"))
        & (F.col("until").isNull() | (F.col("fetched_at") < F.col("until"))))
    blocked, allowed = F.col("list") == block, F.col("list") == allow
    found = hits.groupBy(
        F.col("url").alias("hit_url"), F.col("fetched_at").alias("hit_at")).agg(
        F.count_if(blocked).alias("n_block"), F.count_if(allowed).alias("n_allow"),
        F.min(F.when(blocked, F.concat("kind", F.lit(":"), "value"))).alias("block_entry"))
    judged = pairs.join(
        found, (F.col("url") == F.col("hit_url")) & (F.col("fetched_at") == F.col("hit_at")), "left")
    n_block, n_allow = F.coalesce("n_block", F.lit(0)), F.coalesce("n_allow", F.lit(0))
    return judged.select(
        "url", "fetched_at", n_block.alias("n_block"), n_allow.alias("n_allow"),
        "block_entry", ((n_block == 0) | (n_allow > 0)).alias("allowed"))


def judge(captures: DataFrame, entries: DataFrame, key: str = "page_id", url: str = "url",
          at: str = "fetched_at") -> DataFrame:
    """`filter_urls` for every capture: (key, url, fetched_at, ...), repeated rows included."""
    rows = captures.select(
        F.col(key).alias("page_id"), F.col(url).alias("row_url"), F.col(at).alias("row_at"))
    verdicts = filter_urls(captures, entries, url, at)
    same = (F.col("row_url").eqNullSafe(F.col("url"))
            & F.col("row_at").eqNullSafe(F.col("fetched_at")))
    return rows.join(verdicts, same, "left").select(
        "page_id", F.col("row_url").alias("url"), F.col("row_at").alias("fetched_at"),
        "n_block", "n_allow", "block_entry", "allowed")
