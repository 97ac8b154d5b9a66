"""Listing link to article page."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_by_url(pages: DataFrame, same_run: bool = False, url: str = "requested_url") -> DataFrame:
    """Newest row per url (per run and url with ``same_run``). Pass facts, not bodies."""
    keys = ["run_id", url] if same_run else [url]
    rest = [c for c in pages.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct("fetched_at", "snapshot_id")).alias("_best")
    return pages.groupBy(*keys).agg(best).select(*keys, "_best.*")


def follow_links(links: DataFrame, pages: DataFrame, on_missing: str = "fail", same_run: bool = False) -> DataFrame:
    """Chosen links (``url``, and ``run_id`` with ``same_run``) with their article's columns.

    The article side is first reduced to one row per url, so the join never multiplies rows; a url
    that very many listings point to is one small row joined to a long run, which adaptive skew
    joins split. ``found`` tells whether the article exists; ``on_missing='fail'`` leaves the others
    undated, ``'use_listing'`` marks them for the listing's own text.
    """
    facts = latest_by_url(pages, same_run)
    article = facts.withColumnsRenamed(
        {c: f"article_{c}" for c in facts.columns if c not in ("run_id", "requested_url")}
    ).withColumnRenamed("requested_url", "url")
    if not same_run:
        article = article.withColumnRenamed("run_id", "article_run_id") if "run_id" in article.columns else article
    keys = ["run_id", "url"] if same_run else ["url"]
    joined = links.join(article.withColumn("_found", F.lit(True)), keys, "left")
    found = F.coalesce("_found", F.lit(False))
    return joined.withColumn("found", found).drop("_found").withColumn(
        "use_listing", ~F.col("found") & F.lit(on_missing == "use_listing")
    )
