"""One candidate per page or source.

Every pick is ``max_by`` / ``min_by`` over a struct: map-side partial aggregation reduces each task
to one row per key before anything is shuffled, so a hot key costs no more than a cold one. Ties
are always broken by position.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventboard.functions.predicates import instant, matches_any, plausible, upcoming
from eventboard.operators.sizing import broadcast_if_small


def _winner(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*rest), order).alias("_best")
    return df.groupBy(*keys).agg(best).select(*keys, "_best.*")


def _keys(keys: list[str] | None) -> list[str]:
    return keys or ["snapshot_id"]


def pick_latest(cand: DataFrame, keys: list[str] | None = None, at: str = "event_at", pos: str = "pos") -> DataFrame:
    """Latest date per key; the first of equals wins and undated candidates never do."""
    keys = _keys(keys)
    dated = cand.filter(F.col(at).isNotNull())
    rest = [c for c in cand.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(F.col(at), -F.col(pos))).alias("_best")
    return dated.groupBy(*keys).agg(best).select(*keys, "_best.*")


def pick_next(
    cand: DataFrame,
    as_of: Column | datetime | str,
    grain: str = "day",
    keys: list[str] | None = None,
    at: str = "event_at",
    pos: str = "pos",
    years: int = 2,
) -> DataFrame:
    """Earliest plausible date that has not passed at ``as_of``."""
    now = instant(as_of)
    ahead = cand.filter(plausible(F.col(at), now, years) & upcoming(F.col(at), now, grain))
    return _winner(ahead, _keys(keys), F.struct(at, pos))


def pick_first_valid(cand: DataFrame, keys: list[str] | None = None, at: str = "event_at", pos: str = "pos") -> DataFrame:
    """First dated candidate in document order."""
    return _winner(cand.filter(F.col(at).isNotNull()), _keys(keys), F.struct(pos))


def pick_match_or_first(cand: DataFrame, match: Column, keys: list[str] | None = None, pos: str = "pos") -> DataFrame:
    """First candidate satisfying ``match``, else the very first one."""
    flagged = cand.withColumn("_miss", ~F.coalesce(match, F.lit(False)))
    return _winner(flagged, _keys(keys), F.struct("_miss", pos)).drop("_miss")


def pick_first_link(links: DataFrame, words: list[str], text: str = "text", keys: list[str] | None = None, pos: str = "pos") -> DataFrame:
    """First keyword match that has a link."""
    has_link = F.col("href").isNotNull() & (F.col("href") != "")
    return _winner(links.filter(has_link & matches_any(F.col(text), words)), _keys(keys), F.struct(pos))


def first_in(items: Column, wanted) -> Column:
    """First item of an array that ``wanted`` accepts, NULL without one: a pick inside the row, without a shuffle."""
    return F.get(F.filter(items, wanted), 0)


def match_or_first_in(items: Column, wanted) -> Column:
    """``pick_match_or_first`` inside the row. ``items`` is named once, so what makes them is not evaluated twice."""

    def ranked(item: Column, pos: Column) -> Column:
        return F.struct((~F.coalesce(wanted(item), F.lit(False))).alias("miss"), pos.alias("pos"), item.alias("item"))

    return F.array_min(F.transform(items, ranked))["item"]


def relevant_in(items: Column, relevant, dated) -> list[Column]:
    """``relevant_count`` inside the row: relevant items, dated ones among them, and whether the next channel is due."""
    hits = F.filter(items, lambda i: F.coalesce(relevant(i), F.lit(False)))
    with_date = F.size(F.filter(hits, dated)).cast("long")
    return [F.size(hits).cast("long").alias("relevant"), with_date.alias("dated"), (with_date == 0).alias("next_channel")]


def pick_by_tier(
    cand: DataFrame,
    rules: DataFrame | None = None,
    as_of: Column | datetime | str | None = None,
    keys: list[str] | None = None,
    at: str = "event_at",
) -> DataFrame:
    """Lowest tier with a date, first in document order within it.

    ``rules(tier, guarded)`` names the tiers whose dates must also be plausible at ``as_of``.
    """
    dated = cand.filter(F.col(at).isNotNull())
    if rules is not None:
        guards = broadcast_if_small(rules.select("tier", "guarded"))
        dated = dated.join(guards, "tier", "left").filter(
            ~F.coalesce("guarded", F.lit(False)) | plausible(F.col(at), as_of)
        )
        dated = dated.select(*cand.columns)
    return _winner(dated, _keys(keys), F.struct("tier", "pos"))


def pick_by_channel(*observations: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """First successful channel per key, else the failure of the last channel tried.

    Inputs either carry a ``channel`` rank or are ranked in the order given.
    """
    keys = keys or ["run_id", "source_id", "event_type"]
    ranked = [
        o if "channel" in o.columns else o.withColumn("channel", F.lit(i))
        for i, o in enumerate(observations, start=1)
    ]
    every = ranked[0]
    for other in ranked[1:]:
        every = every.unionByName(other)
    good = F.coalesce("ok", F.lit(False))
    rank = F.when(good, F.col("channel")).otherwise(-F.col("channel"))
    return _winner(every, keys, F.struct(~good, rank)).drop("channel")


def with_confidence(obs: DataFrame, rules: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Confidence of the rule and channel that produced each observation."""
    keys = keys or ["source_id", "channel"]
    base = obs.drop("confidence")
    return base.join(broadcast_if_small(rules.select(*keys, "confidence")), keys, "left")


def relevant_count(cand: DataFrame, relevant: Column, keys: list[str] | None = None, at: str = "event_at") -> DataFrame:
    """Relevant and dated candidates per page; a page without dated ones leaves it to the next channel."""
    hit = F.coalesce(relevant, F.lit(False))
    out = cand.groupBy(*_keys(keys)).agg(
        F.count_if(hit).alias("relevant"), F.count_if(hit & F.col(at).isNotNull()).alias("dated")
    )
    return out.withColumn("next_channel", F.col("dated") == 0)
