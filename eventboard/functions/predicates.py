"""Boolean columns: keywords, url shapes, plausibility and fetch outcomes."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

VERSION_NUMBER = r"\d+\.\d+"


def instant(value: Column | datetime | str) -> Column:
    """``value`` as a timestamp_ntz column; strings and datetimes become literals."""
    return value if isinstance(value, Column) else F.lit(str(value)).cast("timestamp_ntz")


def matches_any(c: Column, words: Column | list[str]) -> Column:
    """True if ``c`` contains any of ``words``, ignoring case."""
    text = F.lower(c)
    if isinstance(words, Column):
        return F.exists(words, lambda w: F.contains(text, F.lower(w)))
    hits = [F.contains(text, F.lit(w.lower())) for w in words]
    out = F.lit(False)
    for hit in hits:
        out = out | hit
    return out


def is_release_title(c: Column, words: Column | list[str]) -> Column:
    """A keyword or a version number."""
    return matches_any(c, words) | c.rlike(VERSION_NUMBER)


def url_like(c: Column, pattern: Column | str) -> Column:
    return F.rlike(c, pattern if isinstance(pattern, Column) else F.lit(pattern))


def not_listing(url: Column, requested: Column, final: Column, query: Column | str | None = None) -> Column:
    """False for an article url that is the listing itself or carries the listing's query."""
    keep = ~url.eqNullSafe(requested) & ~url.eqNullSafe(final)
    if query is None:
        return keep
    query = F.lit(query) if isinstance(query, str) else query
    return keep & ~F.coalesce(F.contains(url, query), F.lit(False))


def plausible(c: Column, as_of: Column | datetime | str, years: int = 2) -> Column:
    """Within ``years`` calendar years of ``as_of``, both ends included."""
    now, span = instant(as_of), F.make_interval(years=F.lit(years))
    return c.between(now - span, now + span)


def upcoming(c: Column, as_of: Column | datetime | str, grain: str = "day") -> Column:
    """Today or later (``grain='day'``), or strictly later than now (``grain='instant'``)."""
    now = instant(as_of)
    if grain == "instant":
        return c > now
    return c >= F.to_date(now).cast("timestamp_ntz")


def final_url(final: Column, requested: Column) -> Column:
    return F.coalesce(F.nullif(final, F.lit("")), requested)


def fetch_ok(status: Column) -> Column:
    return F.coalesce(status.between(200, 299), F.lit(False))


def failure_type(status: Column, mode: Column) -> Column:
    """Outcome class of one page load, NULL when it succeeded.

    403 and 429 are blocks, and so is a browser load that died before any status arrived; all
    other failures are unavailability.
    """
    status = F.coalesce(status, F.lit(0))
    return (
        F.when(fetch_ok(status), F.lit(None).cast("string"))
        .when(status.isin(403, 429), F.lit("blocked"))
        .when((status == 0) & (F.coalesce(mode, F.lit("http")) == "browser"), F.lit("blocked"))
        .otherwise(F.lit("unavailable"))
    )
