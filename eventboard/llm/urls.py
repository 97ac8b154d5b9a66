"""Temporal list join: every capture is judged by the list entries that were active when it was fetched.

Dated list entries (``domain, action, listed_on``) become validity intervals: an entry holds from its date until the
domain's next one. A capture meets the intervals of its host and of all parent domains that contain its fetch date;
the most specific active entry decides, ``block`` rejects, anything else keeps.

Captures are first reduced to distinct (host, fetch date) pairs, which also deals out a host that holds a third of
all captures; only those pairs meet the intervals, and verdicts are joined back on both columns.

Defined results: a url without a host, or NULL, or a capture without a fetch date, has no active entry and is kept.
Of entries with equal domain and date the last by action counts. Repeated captures are returned as often as they
come. Entries with NULL domain or date are ignored. Other columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOST = r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)"


def host_of(url: Column) -> Column:
    found = F.regexp_extract(F.lower(url), HOST, 1)
    return F.when(found != "", F.rtrim(found, F.lit(".")))


def domains_of(host: Column) -> Column:
    """The host and its parent domains, longest first."""
    labels = F.split(host, r"\.")
    return F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    )


def intervals(entries: DataFrame) -> DataFrame:
    """``domain, action, valid_from, valid_to``; the end is exclusive, NULL for entries still active."""
    once = (
        entries.filter("domain IS NOT NULL AND listed_on IS NOT NULL")
        .groupBy("domain", "listed_on")
        .agg(F.max("action").alias("action"))
    )
    return once.select(
        "domain",
        "action",
        F.col("listed_on").alias("valid_from"),
        F.lead("listed_on").over(Window.partitionBy("domain").orderBy("listed_on")).alias("valid_to"),
    )


def judge(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """``page_id, host, fetched_on, matched, action, listed_on, kept`` of ``captures(page_id, url, fetched_on)``."""
    rows = captures.select("page_id", host_of(F.col("url")).alias("host"), "fetched_on")
    seen = rows.filter("host IS NOT NULL AND fetched_on IS NOT NULL").select("host", "fetched_on").distinct()
    asked = seen.withColumn("domain", F.explode(domains_of(F.col("host"))))
    active = asked.join(intervals(entries), "domain").filter(
        "valid_from <= fetched_on AND (valid_to IS NULL OR fetched_on < valid_to)"
    )
    verdicts = (
        active.groupBy("host", "fetched_on")
        .agg(F.max_by(F.struct("domain", "action", "valid_from"), F.length("domain")).alias("best"))
        .select(
            "host",
            "fetched_on",
            F.col("best.domain").alias("matched"),
            F.col("best.action").alias("action"),
            F.col("best.valid_from").alias("listed_on"),
        )
    )
    return rows.join(verdicts, ["host", "fetched_on"], "left").select(
        "page_id",
        "host",
        "fetched_on",
        "matched",
        "action",
        "listed_on",
        (F.coalesce("action", F.lit("")) != "block").alias("kept"),
    )


def kept(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """Ids of the captures that pass."""
    return judge(captures, entries).filter("kept").select("page_id")
