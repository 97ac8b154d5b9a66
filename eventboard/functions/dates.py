"""Date forms found in page text. Every function yields a ``timestamp_ntz`` in UTC or NULL.

A form is a pattern plus a reading of its first match. Readings are built from
``try_make_timestamp_ntz`` rather than formatter patterns: impossible dates are NULL, nothing
raises under ANSI, and the result does not depend on the session's zone.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventboard.functions.predicates import instant, plausible

# The month names and the date patterns to recognise.
MONTHS = [
    "January", "February", "March", "April", "May", "June",
    "July", "August", "September", "October", "November", "December",
]
MONTH_COMMA = r"[A-Z][a-z]+ \d{1,2}, \d{4}"
MONTH_LOOSE = r"[A-Z][a-z]+\s+\d{1,2},?\s+\d{4}"
MONTH_NAME_COMMA = rf"(?i)(?:{'|'.join(MONTHS)})\s+\d{{1,2}},\s+\d{{4}}"
MONTH_NAME = rf"(?i)(?:{'|'.join(MONTHS)})\s+\d{{1,2}},?\s+\d{{4}}"
MONTH_ABBREV = rf"(?i)(?:{'|'.join(m[:3] for m in MONTHS)})[a-z]*\s+\d{{1,2}},?\s+\d{{4}}"
YEARLESS = rf"(?i)^(?:{'|'.join(MONTHS)})\s+\d{{1,2}}$"
ISO_DATE = r"\d{4}[-/]\d{2}[-/]\d{2}"
DOTTED_DATE = r"\d{4}\.\d{2}\.\d{2}"
SLASH_DATE = r"\d{1,2}/\d{1,2}/\d{4}"
ENDS_ON = r"(?i)Ends(?:\s+on)?[:\s]+([A-Z][a-z]+\s+\d{1,2},\s+\d{4})(?:\s+(Eastern\s+Time|ET))?"
RELATIVE = r"(?i)(\d+)\s+(hour|day|week|month)s?\s+ago"
END_TIMES = [
    r"(?i)End\s+Time[:\s]+(\d{4}[/-]\d{2}[/-]\d{2}\s+\d{2}:\d{2}:\d{2})",
    r"(?i)End\s+Time[:\s]+(\d{4}[/-]\d{2}[/-]\d{2}\s+\d{2}:\d{2})",
    r"(?i)until\s+(\d{4}[/-]\d{2}[/-]\d{2}\s+\d{2}:\d{2}:\d{2})",
    r"(\d{4}[/-]\d{2}[/-]\d{2}\s+\d{2}:\d{2}:\d{2})",
]
NOISE_PREFIX = "PATCH NOTES"
RFC822 = (
    r"^\s*(?:[A-Za-z]{3,9},?\s+)?(\d{1,2})\s+([A-Za-z]{3,9})\s+(\d{4})"
    r"\s+(\d{2}):(\d{2})(?::(\d{2}))?\s*([+-]\d{4}|GMT|UTC|UT|Z)?\s*$"
)
ISO_INSTANT = (
    r"^\s*(\d{4})-(\d{1,2})-(\d{1,2})"
    r"(?:[T ]\s*(\d{2}):(\d{2})(?::(\d{2}(?:\.\d{1,9})?))?\s*(Z|[+-]\d{2}:?\d{2})?)?\s*$"
)
CLOCK = (
    r"(\d{1,2}):(\d{2})(?::(\d{2}))?\s*([AP]M)?\s*(GMT|UTC|UT|Z)?([+-]\d{2}:?\d{2})?(?:\s*\([^()]*\))?"
)
WORDED = (
    r"(?i)^\s*(?:(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun)[a-z]*,?\s+)?"
    r"(?:([a-z]{3,9})\.?\s+(\d{1,2})|(\d{1,2})\s+([a-z]{3,9})\.?),?\s+(\d{4})"
    rf"(?:,?\s+{CLOCK})?\s*$"
)
NUMERIC_CLOCK = (
    r"(?i)^\s*(?:(\d{4})[-/](\d{1,2})[-/](\d{1,2})|(\d{1,2})/(\d{1,2})/(\d{4})),?\s+" + CLOCK + r"\s*$"
)
# The groups of both patterns in one order: year, month, day, hour, minute, second, half, zone name, offset.
WORDED_PARTS = "$5|$1$4|$2$3|$6|$7|$8|$9|$10|$11"
NUMERIC_PARTS = "$1$6|$2$4|$3$5|$7|$8|$9|$10|$11|$12"
LABEL_ZONE = "America/New_York"


#: What may be an integer; anything else costs a cast that fails, which is slow.
WHOLE = r"^[\x00-\x20\x7F]*[+-]?[0-9]+[\x00-\x20\x7F]*$"


def once(c: Column, make) -> Column:
    """``make(value)`` with ``c`` evaluated once: inside lambdas Spark evaluates every mention of an expression anew."""
    return F.get(F.transform(F.array(c), make), 0)


def _int(c: Column) -> Column:
    return F.when(c.rlike(WHOLE), c).try_cast("int")


def _seconds(c: Column) -> Column:
    return F.coalesce(F.when(c.rlike("[0-9]"), c).try_cast("decimal(16,6)"), F.lit(0).cast("decimal(16,6)"))


def _at(y: Column, m: Column, d: Column, h: Column | None = None, mi: Column | None = None, s: Column | None = None):
    zero = F.lit(0)
    return F.try_make_timestamp_ntz(
        y, m, d,
        F.coalesce(h, zero) if h is not None else zero,
        F.coalesce(mi, zero) if mi is not None else zero,
        s if s is not None else zero,
    )


def month_number(word: Column, whole: bool = False) -> Column:
    """1-12 from a month word, by its first three letters or (``whole``) its exact name; else 0."""
    if whole:
        return F.array_position(F.array(*[F.lit(m.lower()) for m in MONTHS]), F.lower(word)).cast("int")
    prefixes = F.array(*[F.lit(m[:3].lower()) for m in MONTHS])
    return F.array_position(prefixes, F.lower(F.substring(word, 1, 3))).cast("int")


def _read(match: Column, split: str, make) -> Column:
    """The reading of a match's parts; no match has none."""
    return once(match, lambda m: F.when(m != "", once(F.split(m, split), make)))


def _read_month_day_year(match: Column, whole: bool = False) -> Column:
    return _read(match, r"[\s,]+", lambda p: _at(_int(F.get(p, 2)), month_number(F.get(p, 0), whole), _int(F.get(p, 1))))


def _read_year_month_day(match: Column) -> Column:
    return _read(match, r"[-/.]", lambda p: _at(_int(F.get(p, 0)), _int(F.get(p, 1)), _int(F.get(p, 2))))


def _read_month_day_slash(match: Column) -> Column:
    return _read(match, "/", lambda p: _at(_int(F.get(p, 2)), _int(F.get(p, 0)), _int(F.get(p, 1))))


def _read_clock(match: Column) -> Column:
    return _read(match, r"[-/:\s]+", lambda p: _at(*[_int(F.get(p, i)) for i in range(5)], _seconds(F.get(p, 5))))


def at_zone(local: Column, tz: Column | str = "UTC") -> Column:
    """The UTC instant of a wall-clock time in ``tz``."""
    if isinstance(tz, str) and tz == "UTC":
        return local
    zone = F.lit(tz) if isinstance(tz, str) else F.coalesce(tz, F.lit("UTC"))
    return F.convert_timezone(zone, F.lit("UTC"), local)


# Name -> (pattern, reading of one match). ``extract_dates`` uses the same table.
FORMS = {
    "month_comma": (MONTH_COMMA, _read_month_day_year),
    "month_loose": (MONTH_LOOSE, _read_month_day_year),
    "month_name_comma": (MONTH_NAME_COMMA, _read_month_day_year),
    "month_name": (MONTH_NAME, _read_month_day_year),
    "month_abbrev": (MONTH_ABBREV, _read_month_day_year),
    "iso_date": (ISO_DATE, _read_year_month_day),
    "dotted_date": (DOTTED_DATE, _read_year_month_day),
    "slash_date": (SLASH_DATE, _read_month_day_slash),
}


def _first(c: Column, form: str) -> Column:
    pattern, read = FORMS[form]
    return read(F.regexp_extract(c, pattern, 0))


def month_comma(c: Column) -> Column:
    """``Month d, yyyy`` with the comma."""
    return _first(c, "month_comma")


def month_loose(c: Column) -> Column:
    """``Month d yyyy``, comma optional, full or short month."""
    return _first(c, "month_loose")


def month_name(c: Column, comma: bool = False) -> Column:
    """A whole English month name in any case; ``comma`` makes the comma required."""
    return _first(c, "month_name_comma" if comma else "month_name")


def month_abbrev(c: Column) -> Column:
    """A three-letter month prefix plus any letters."""
    return _first(c, "month_abbrev")


def iso_date(c: Column) -> Column:
    """``yyyy-MM-dd`` or ``yyyy/MM/dd``."""
    return _first(c, "iso_date")


def dotted_date(c: Column) -> Column:
    return _first(c, "dotted_date")


def slash_date(c: Column) -> Column:
    """``M/d/yyyy``."""
    return _first(c, "slash_date")


def iso_or_month(c: Column) -> Column:
    """Whichever of ``iso_date`` and ``month_loose`` stands first in the text."""
    match = F.regexp_extract(c, f"{ISO_DATE}|{MONTH_LOOSE}", 0)
    return once(match, lambda m: F.coalesce(_read_year_month_day(m), _read_month_day_year(m)))


def slash_or_month(c: Column) -> Column:
    """Whichever of ``slash_date`` and ``month_loose`` stands first in the text."""
    match = F.regexp_extract(c, f"{SLASH_DATE}|{MONTH_LOOSE}", 0)
    return once(match, lambda m: F.coalesce(_read_month_day_slash(m), _read_month_day_year(m)))


def month_strict(c: Column) -> Column:
    """``Month d, yyyy`` whose month is spelled out in full; an unknown name is NULL."""
    return _read_month_day_year(F.regexp_extract(c, r"(?i)[A-Z][a-z]+\s+\d{1,2},\s+\d{4}", 0), whole=True)


def end_time(c: Column, as_of: Column | datetime | str, years: int = 2) -> Column:
    """First end-time pattern, in priority order, whose first match lies ahead and is plausible."""
    now = instant(as_of)
    reads = F.array(*[_read_clock(F.regexp_extract(c, p, 1)) for p in END_TIMES])
    return F.get(F.filter(reads, lambda t: (t > now) & plausible(t, now, years)), 0)


def ends_on(c: Column, apply_tz: bool = False) -> Column:
    """``Ends on Month d, yyyy``: midnight UTC. The zone is a label unless ``apply_tz``."""
    day = month_strict(F.regexp_extract(c, ENDS_ON, 1))
    if not apply_tz:
        return day
    return F.when(ends_on_zone(c).isNotNull(), at_zone(day, LABEL_ZONE)).otherwise(day)


def ends_on_zone(c: Column) -> Column:
    return F.when(F.regexp_extract(c, ENDS_ON, 2) != "", F.lit(LABEL_ZONE))


def relative(c: Column, anchor: Column | datetime | str) -> Column:
    """``N hours/days/weeks/months ago`` counted back from ``anchor``; month ends are clamped."""
    anchor = instant(anchor)
    n = _int(F.regexp_extract(c, RELATIVE, 1))
    unit = F.lower(F.regexp_extract(c, RELATIVE, 2))
    back = {
        "hour": F.make_interval(hours=n),
        "day": F.make_interval(days=n),
        "week": F.make_interval(weeks=n),
        "month": F.make_interval(months=n),
    }
    out = F.lit(None).cast("timestamp_ntz")
    for name, span in back.items():
        out = F.when(unit == name, anchor - span).otherwise(out)
    return out


def yearless(c: Column, anchor: Column | datetime | str) -> Column:
    """A bare ``Month d`` gets the anchor's year; anything else is returned as it is."""
    with_year = F.concat(c, F.lit(", "), F.year(instant(anchor)).cast("string"))
    return F.when(c.rlike(YEARLESS), with_year).otherwise(c)


def strip_noise_prefix(c: Column) -> Column:
    """Drop the first ``PATCH NOTES``, any case, and trim."""
    return F.trim(F.regexp_replace(c, rf"(?is)^(.*?){NOISE_PREFIX}", "$1"))


def _shift(local: Column, zone: Column) -> Column:
    """Move a wall-clock time to UTC by a ``Z`` / ``GMT`` / ``+hh:mm`` / ``+hhmm`` offset."""
    digits = F.regexp_replace(zone, "[^0-9]", "")
    minutes = _int(F.substring(digits, 1, 2)) * 60 + _int(F.substring(digits, 3, 2))
    signed = F.when(zone.startswith("-"), -minutes).when(zone.startswith("+"), minutes)
    return local - F.make_dt_interval(mins=F.coalesce(signed, F.lit(0)))


def _groups(c: Column, pattern: str, number: int, make) -> Column:
    """A reading of the groups of a pattern that spans the whole text, from 0; NULL where it does not match."""
    listed = "|".join(f"${i}" for i in range(1, number + 1))

    def read(parts: Column) -> Column:
        return make([F.get(parts, i) for i in range(number)])

    return once(c, lambda v: F.when(v.rlike(pattern), once(F.split(F.regexp_replace(v, pattern, listed), r"\|"), read)))


def rfc822(c: Column) -> Column:
    """Feed dates such as ``Thu, 29 Jan 2026 22:00:00 +0000``."""

    def read(g: list[Column]) -> Column:
        local = _at(_int(g[2]), month_number(g[1]), _int(g[0]), _int(g[3]), _int(g[4]), _seconds(g[5]))
        return _shift(local, g[6])

    return _groups(c, RFC822, 7, read)


def iso_instant(c: Column, tz: Column | str = "UTC") -> Column:
    """A whole ISO-8601 date or instant; a clock time without an offset is read in ``tz``."""

    def read(g: list[Column]) -> Column:
        local = _at(_int(g[0]), _int(g[1]), _int(g[2]), _int(g[3]), _int(g[4]), _seconds(g[5]))
        shifted = _shift(local, g[6])
        if isinstance(tz, str) and tz == "UTC":
            return shifted
        # A bare date is UTC midnight; only a clock time without an offset depends on the zone.
        zone = F.lit(tz) if isinstance(tz, str) else tz
        return at_zone(shifted, F.when((g[3] != "") & (g[6] == ""), zone))

    return _groups(c, ISO_INSTANT, 7, read)


def _read_parts(parts: Column, tz: Column | str) -> Column:
    year, month, day, hour, minute, second, half, zone, offset = (F.get(parts, i) for i in range(9))
    twelve = _int(hour) % 12 + F.when(F.upper(half) == "PM", 12).otherwise(0)
    # Hour 99 makes the whole reading NULL.
    h24 = F.when(half == "", _int(hour)).when(_int(hour).between(1, 12), twelve).otherwise(99)
    local = _at(_int(year), F.coalesce(_int(month), month_number(month)), _int(day), h24, _int(minute), _seconds(second))
    shifted = _shift(local, offset)
    if isinstance(tz, str) and tz == "UTC":
        return shifted
    named = F.lit(tz) if isinstance(tz, str) else tz
    return at_zone(shifted, F.when((zone == "") & (offset == ""), named))


def clock_date(c: Column, tz: Column | str = "UTC") -> Column:
    """A whole text that is a worded date, month or day first, or a numeric date with a clock.

    The clock may have seconds, AM/PM, a zone name or an offset; without a zone it is read in ``tz``.
    """

    def read(pattern: str, order: str) -> Column:
        parts = F.split(F.regexp_replace(c, pattern, order), r"\|")
        return F.get(F.transform(F.array(parts), lambda p: _read_parts(p, tz)), 0)

    return F.when(c.rlike(WORDED), read(WORDED, WORDED_PARTS)).when(
        c.rlike(NUMERIC_CLOCK), read(NUMERIC_CLOCK, NUMERIC_PARTS)
    )


def any_date(c: Column, tz: Column | str = "UTC") -> Column:
    """A free-form attribute or text: ISO instant, feed date, date with a clock, then the date forms.

    An impossible clock makes the date NULL rather than midnight.
    """
    return once(c, lambda v: _any_date(v, tz))


def _any_date(c: Column, tz: Column | str) -> Column:
    forms = F.coalesce(
        at_zone(month_loose(c), tz),
        at_zone(month_abbrev(c), tz),
        at_zone(dotted_date(c), tz),
        at_zone(iso_date(c), tz),
        at_zone(slash_date(c), tz),
    )
    whole = c.rlike(WORDED) | c.rlike(NUMERIC_CLOCK)
    return F.coalesce(iso_instant(c, tz), rfc822(c), F.when(whole, clock_date(c, tz)).otherwise(forms))


def epoch_or_string(number: Column, text: Column) -> Column:
    """Seconds since the epoch if a number is given, else a date string; zero and blank are NULL."""
    micros = F.round(number * 1_000_000).cast("long")
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    as_number = epoch + F.make_dt_interval(secs=(micros / 1_000_000).cast("decimal(18,6)"))
    return F.when(number.isNotNull(), F.when(number != 0, as_number)).otherwise(any_date(text))


def iso_out(c: Column) -> Column:
    """``yyyy-MM-ddTHH:mm:ss.SSSZ``."""
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def friendly(c: Column) -> Column:
    """``March 6, 2026``."""
    return F.date_format(c, "MMMM d, yyyy")


def season_fields(df: DataFrame, end: str = "event_at", zone: str = "tz_label") -> DataFrame:
    """End date, the day after it, its long form and the fixed label columns."""
    end_day = F.to_date(end)
    return df.withColumns(
        {
            "current_season_ends": end_day,
            "timezone": F.col(zone),
            "next_season_start": F.lit(None).cast("string"),
            "next_season_estimate": F.date_add(end_day, 1),
            "next_season_estimate_friendly": friendly(F.date_add(end_day, 1)),
        }
    )


def next_weekly(ts: Column, dow: int | Column = 4, time: str | Column = "10:00", boundary: str = "strict") -> Column:
    """Next weekly slot (``dow`` 1 = Monday, ``time`` as ``hh:mm``) after ``ts``, a timestamp_ntz in UTC.

    ``boundary='strict'`` returns a slot later than ``ts``; ``'minute'`` keeps the current slot
    during its whole first minute.
    """
    day, clock = (F.lit(v) if not isinstance(v, Column) else v for v in (dow, time))
    hours, minutes = (_int(F.split_part(clock, F.lit(":"), F.lit(k))) for k in (1, 2))
    monday = F.date_sub(F.to_date(ts), F.weekday(ts)).cast("timestamp_ntz")
    slot = monday + F.make_dt_interval(days=day - 1, hours=hours, mins=minutes)
    grace = F.make_dt_interval(mins=F.lit(1)) if boundary == "minute" else F.make_dt_interval()
    return F.when(slot + grace > ts, slot).otherwise(slot + F.make_dt_interval(days=F.lit(7)))


def extract_dates(df: DataFrame, text_col: str, forms: list[str] | None = None, keys: list[str] | None = None) -> DataFrame:
    """All date matches of a text column: one row per (row, form, match).

    Adds ``tier`` (place of the form in ``forms``), ``form``, ``pos`` (order of the match among the
    form's matches, from 0), ``match`` and ``event_at``. Only ``keys`` are carried along, so the
    text itself does not travel with the candidates.
    """
    forms = forms or list(FORMS)
    keys = keys if keys is not None else [c for c in df.columns if c != text_col]
    found = [_all_matches(F.col(text_col), tier, form) for tier, form in enumerate(forms, start=1)]
    return df.select(*keys, F.inline(F.concat(*found)))


def _all_matches(text: Column, tier: int, form: str) -> Column:
    pattern, read = FORMS[form]

    def candidate(match: Column, pos: Column) -> Column:
        return F.struct(
            F.lit(tier).alias("tier"),
            F.lit(form).alias("form"),
            pos.alias("pos"),
            match.alias("match"),
            read(match).alias("event_at"),
        )

    return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), candidate)
