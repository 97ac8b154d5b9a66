"""The board: live records as they read at a given instant."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventboard.functions import boardtext as bt
from eventboard.functions.predicates import instant
from eventboard.operators.carry import with_next
from eventboard.schemas import KEY

# The one source whose open season is announced in its notes.
SEASON_KEY = ("fortnite", "next-season")
SEASON_START, SEASON_ESTIMATE, SOURCE_NAME = "nextSeasonStart", "nextSeasonEstimateFriendly", "sourceName"


def with_board(df: DataFrame, as_of: Column | datetime | str) -> DataFrame:
    """Add the card and page columns to live rows (missing rows have NULL fields)."""
    now = instant(as_of)
    event_at, status, kind = F.col("event_at"), F.col("status"), F.col("event_type")
    down, ms = F.col("_down"), F.col("diff_ms")
    extras = F.col("extras")
    season_open = (
        (F.col("source_id") == SEASON_KEY[0])
        & (kind == SEASON_KEY[1])
        & F.coalesce(F.map_contains_key(extras, F.lit(SEASON_START)), F.lit(False))
        & F.try_element_at(extras, F.lit(SEASON_START)).isNull()
    )
    label = F.coalesce(
        F.nullif(F.try_element_at(extras, F.lit(SOURCE_NAME)), F.lit("")),
        F.nullif(F.col("title"), F.lit("")),
        F.lit(bt.DEFAULT_SOURCE),
    )
    staged = df.withColumns(
        {
            "_down": bt.is_unavailable(event_at, F.col("confidence"), status),
            "diff_ms": bt.diff_ms(event_at, now),
        }
    )
    return staged.withColumns(
        {
            "state": bt.state(down, ms, status),
            "badge": bt.badge(down, ms, status),
            "countdown_text": bt.countdown_text(down, ms, kind),
            "checked_text": bt.checked_text(F.col("fetched_at"), now),
            "page_label": bt.page_label(down, ms, kind),
            "page_value": bt.page_value(down, ms, kind),
            "page_checked": bt.page_checked_text(F.col("fetched_at"), now),
            "page_notes": bt.notes_text(
                down, status, F.col("notes"), F.col("reason"), F.col("explanation"),
                season_open, F.try_element_at(extras, F.lit(SEASON_ESTIMATE)),
            ),
            "source_label": F.when(down, "Unavailable").otherwise(label),
            "confidence_shown": F.when(down, "none").otherwise(F.col("confidence")),
        }
    ).drop("_down")


def board(registry: DataFrame, live: DataFrame, as_of: Column | datetime | str) -> DataFrame:
    """One card per registry entry; an entry without a live record reads as unavailable."""
    return with_board(registry.select(*KEY, "name", "ord").join(live.drop("ord"), KEY, "left"), as_of)


def board_many(live: DataFrame, instants: list[str]) -> DataFrame:
    """Countdowns of all dated records at several instants.

    The instants are a literal array unfolded in place, so the live table is read once and nothing
    is joined or shuffled.
    """
    times = F.array(*[instant(t) for t in instants])
    dated = live.filter(F.col("event_at").isNotNull()).withColumn("as_of", F.explode(times))
    ms = bt.diff_ms(F.col("event_at"), F.col("as_of"))
    return dated.withColumn("diff_ms", ms).withColumn(
        "countdown_text", bt.countdown_text(F.lit(False), F.col("diff_ms"), F.col("event_type"))
    )


def board_at(history: DataFrame, instants: DataFrame, tie: str = "run_id", width: int = 86_400) -> DataFrame:
    """What a resolved history showed at each instant (``as_of``): the row of every source that was newest then.

    A row is valid until the source's next one. Validity intervals and instants meet in buckets of ``width`` seconds, an
    equi-join that Spark may broadcast, split or sort as it sees fit; an interval lies in the buckets between the first
    and the last instant only. Choose ``width`` near the distance of the instants.
    """
    bounds = instants.agg(F.min("as_of").alias("first"), F.max("as_of").alias("last")).first()
    if bounds.first is None:
        return history.withColumn("as_of", F.lit(None).cast("timestamp_ntz")).limit(0)
    first, last = F.lit(bounds.first), F.lit(bounds.last)

    def bucket(c: Column) -> Column:
        return F.floor(F.unix_seconds(c.cast("timestamp")) / width)

    valid = with_next(history, KEY, "fetched_at", tie, "_until")
    valid = valid.filter((F.col("fetched_at") <= last) & (F.col("_until").isNull() | (F.col("_until") > first)))
    covered = F.sequence(bucket(F.greatest("fetched_at", first)), bucket(F.least("_until", last)))
    cells = valid.withColumn("_bucket", F.explode(covered))
    asked = instants.select("as_of", bucket(F.col("as_of")).alias("_bucket"))
    inside = (F.col("as_of") >= F.col("fetched_at")) & (F.col("_until").isNull() | (F.col("as_of") < F.col("_until")))
    return cells.join(asked, "_bucket").filter(inside).select(*history.columns, "as_of")
