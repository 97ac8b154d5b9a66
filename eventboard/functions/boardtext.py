"""Wording of the board: durations, ages, badges, labels and notes. ``now`` is always a parameter."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from eventboard.functions.predicates import instant

MS_SECOND, MS_MINUTE, MS_HOUR, MS_DAY = 1_000, 60_000, 3_600_000, 86_400_000

# The board's words.
UPDATING = "Updating..."
NO_DATA_CARD = "Data unavailable"
NO_DATA_PAGE = "Data Unavailable"
SEASON_NOTE = "Next season: Not officially announced"
STALE_NOTE = "⚠ Using cached data"
DEFAULT_SOURCE = "Official Source"


def millis(ts: Column) -> Column:
    return F.unix_millis(ts.cast("timestamp"))


def diff_ms(event_at: Column, as_of: Column | datetime | str) -> Column:
    """Milliseconds from ``as_of`` to the event; negative once it has passed."""
    return millis(event_at) - millis(instant(as_of))


def _unit(ms: Column, size: int, wrap: int | None = None) -> Column:
    whole = F.floor(F.abs(ms) / F.lit(size)).cast("long")
    return whole % wrap if wrap else whole


def _two(n: Column) -> Column:
    return F.when(n < 10, F.concat(F.lit("0"), n.cast("string"))).otherwise(n.cast("string"))


def duration_long(ms: Column) -> Column:
    """``02d 14h 03m 22s``: leading zero units are left out, seconds always stay."""
    d, h = _unit(ms, MS_DAY), _unit(ms, MS_HOUR, 24)
    m, s = _unit(ms, MS_MINUTE, 60), _unit(ms, MS_SECOND, 60)
    has_d, has_h = d > 0, (d > 0) | (h > 0)
    has_m = has_h | (m > 0)
    # concat_ws skips NULL parts but not a NULL duration.
    parts = F.concat_ws(
        " ",
        F.when(has_d, F.concat(_two(d), F.lit("d"))),
        F.when(has_h, F.concat(_two(h), F.lit("h"))),
        F.when(has_m, F.concat(_two(m), F.lit("m"))),
        F.concat(_two(s), F.lit("s")),
    )
    return F.when(ms.isNotNull(), parts)


def duration_card(ms: Column) -> Column:
    """``2d 14h``, ``14h 03m`` or ``03m``."""
    d, h, m = _unit(ms, MS_DAY), _unit(ms, MS_HOUR, 24), _unit(ms, MS_MINUTE, 60)
    return (
        F.when(d > 0, F.concat(d.cast("string"), F.lit("d "), _two(h), F.lit("h")))
        .when(h > 0, F.concat(_two(h), F.lit("h "), _two(m), F.lit("m")))
        .otherwise(F.concat(_two(m), F.lit("m")))
    )


def age_text(ts: Column, as_of: Column | datetime | str) -> Column:
    """``3 days ago`` / ``1 hour ago`` / ``just now``; NULL for a NULL instant."""
    ms = millis(instant(as_of)) - millis(ts)
    out = F.lit("just now")
    for size, name in ((MS_MINUTE, "minute"), (MS_HOUR, "hour"), (MS_DAY, "day")):
        n = _unit(ms, size)
        words = F.concat(n.cast("string"), F.when(n == 1, f" {name} ago").otherwise(f" {name}s ago"))
        out = F.when(n > 0, words).otherwise(out)
    return F.when(ms.isNotNull(), out)


def is_unavailable(event_at: Column, confidence: Column, status: Column) -> Column:
    blocked = F.coalesce(confidence == "none", F.lit(False))
    failed = F.coalesce(status.isin("unavailable", "fallback"), F.lit(False))
    return event_at.isNull() | blocked | failed


def is_upcoming(event_type: Column) -> Column:
    """Types that point ahead: ``next-…`` and anything with ``reset``."""
    hit = event_type.startswith("next-") | F.contains(event_type, F.lit("reset"))
    return F.coalesce(hit, F.lit(False))


def state(unavailable: Column, ms: Column, status: Column) -> Column:
    """Card state. A past event is live even when its record is stale."""
    stale = (ms > 0) & F.coalesce(status == "stale", F.lit(False))
    return F.when(unavailable, "unavailable").when(stale, "stale").otherwise("live")


def badge(unavailable: Column, ms: Column, status: Column) -> Column:
    return F.upper(state(unavailable, ms, status))


def countdown_text(unavailable: Column, ms: Column, event_type: Column) -> Column:
    return (
        F.when(unavailable, NO_DATA_CARD)
        .when((ms <= 0) & is_upcoming(event_type), UPDATING)
        .otherwise(duration_card(ms))
    )


def page_label(unavailable: Column, ms: Column, event_type: Column) -> Column:
    return (
        F.when(unavailable | ((ms <= 0) & is_upcoming(event_type)), "Status")
        .when(ms > 0, "Time Until Event")
        .otherwise("Time Since Event")
    )


def page_value(unavailable: Column, ms: Column, event_type: Column) -> Column:
    return (
        F.when(unavailable, NO_DATA_PAGE)
        .when((ms <= 0) & is_upcoming(event_type), UPDATING)
        .otherwise(duration_long(ms))
    )


def notes_text(
    unavailable: Column,
    status: Column,
    notes: Column,
    reason: Column,
    explanation: Column,
    season_open: Column,
    season_estimate: Column,
) -> Column:
    """Note line of a page, NULL if there is nothing to show.

    ``season_open`` marks records whose next season has no start date. A stale message replaces
    all other notes; an unavailable record shows why.
    """
    likely = F.concat(F.lit(f"{SEASON_NOTE} (Likely "), season_estimate, F.lit(")"))
    season = F.when(season_open, F.coalesce(likely, F.lit(SEASON_NOTE)))
    stale = F.concat_ws(": ", F.lit(STALE_NOTE), F.nullif(reason, F.lit("")))
    shown = F.concat_ws("\n", season, F.nullif(notes, F.lit("")))
    return (
        F.when(unavailable, F.coalesce(F.nullif(reason, F.lit("")), explanation))
        .when(F.coalesce(status == "stale", F.lit(False)), stale)
        .otherwise(F.nullif(shown, F.lit("")))
    )


def checked_text(fetched_at: Column, as_of: Column | datetime | str) -> Column:
    """Card form: ``Checked 2 hours ago`` or ``--``."""
    return F.coalesce(F.concat(F.lit("Checked "), age_text(fetched_at, as_of)), F.lit("--"))


def page_checked_text(fetched_at: Column, as_of: Column | datetime | str) -> Column:
    """Page form: the age, or ``Never``."""
    return F.coalesce(age_text(fetched_at, as_of), F.lit("Never"))
