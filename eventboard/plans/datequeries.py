"""Registered queries over dates printed into text, and over the candidates read back from it.

The given tables hold no dates in text, so Spark prints order dates and event times into sentences
of each supported form; the operators read them back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventboard.functions import dates as dt
from eventboard.functions import predicates as pr
from eventboard.operators import pick
from eventboard.plans.tables import spread, table

NOW = "1998-01-01 00:00:00"
END_NOW = "2024-01-20 00:00:00"
# Spark's pattern, the same for SQL, its offset in hours and whether that is printed.
CLOCK_FORMS = [
    ("MMM d, yyyy h:mm a", "%b %-d, %Y %-I:%M %p", 0, False),
    ("MMMM d, yyyy HH:mm:ss", "%B %-d, %Y %H:%M:%S", 0, False),
    ("yyyy-MM-dd hh:mm a", "%Y-%m-%d %I:%M %p", 0, False),
    ("EEE MMM dd yyyy HH:mm:ss 'GMT+0200'", "%a %b %d %Y %H:%M:%S GMT+0200", 2, True),
    ("d MMMM yyyy", "%-d %B %Y", 0, False),
    ("M/d/yyyy h:mm:ss a", "%-m/%-d/%Y %-I:%M:%S %p", 0, False),
    ("EEEE, d MMM yyyy HH:mm 'UTC'", "%A, %-d %b %Y %H:%M UTC", 0, True),
]


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "orders"))


def _printed(pattern: str, before: str = "Released ", after: str = " as planned") -> Column:
    return F.concat(F.lit(before), F.date_format("o_orderdate", pattern), F.lit(after))


def dates_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long forms; every seventh text names an impossible day, which must read as NULL."""
    broken = F.col("o_orderkey") % 7 == 0
    impossible = F.concat(F.lit("Released February 30, "), F.year("o_orderdate").cast("string"))
    comma = F.when(broken, impossible).otherwise(_printed("MMMM d, yyyy"))
    short = F.when(broken, impossible).otherwise(_printed("MMM d yyyy"))
    return _orders(spark, sf_dir).select(
        "o_orderkey",
        dt.month_comma(comma).alias("comma"),
        dt.month_comma(short).alias("comma_missing"),
        dt.month_loose(short).alias("loose"),
        dt.month_name(F.upper(comma)).alias("name_any_case"),
        dt.month_name(comma, comma=True).alias("name_comma"),
        dt.month_abbrev(short).alias("abbrev"),
        dt.month_strict(comma).alias("strict"),
    )


def dates_slash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir).select(
        "o_orderkey",
        dt.slash_date(_printed("M/d/yyyy")).alias("event_at"),
        dt.slash_or_month(_printed("M/d/yyyy")).alias("either"),
    )


def dates_dotted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir).select("o_orderkey", dt.dotted_date(_printed("yyyy.MM.dd")).alias("event_at"))


def dates_iso(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir).select(
        "o_orderkey",
        dt.iso_date(_printed("yyyy-MM-dd")).alias("dashed"),
        dt.iso_date(_printed("yyyy/MM/dd")).alias("slashed"),
        dt.iso_or_month(_printed("MMM d, yyyy", after=" not 1990-01-01")).alias("first_of_both"),
    )


def dates_ends_on(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Season ends: date, zone label and derived fields; the zone is applied only on request."""
    zone = F.when(F.col("o_orderkey") % 3 == 0, " Eastern Time").when(F.col("o_orderkey") % 3 == 1, " ET").otherwise("")
    text = F.concat(F.lit("Season Ends on: "), F.date_format("o_orderdate", "MMMM d, yyyy"), zone, F.lit(" sharp"))
    staged = _orders(spark, sf_dir).select(
        "o_orderkey",
        dt.ends_on(text).alias("event_at"),
        dt.ends_on(text, apply_tz=True).alias("event_at_zoned"),
        dt.ends_on_zone(text).alias("tz_label"),
    )
    return dt.season_fields(staged).drop("tz_label", "next_season_start")


def dates_relative(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    unit = F.element_at(F.array(*[F.lit(u) for u in ("hour", "day", "week", "month")]), (F.col("event_id") % 4 + 1).cast("int"))
    text = F.concat(F.lit("posted "), k.cast("string"), F.lit(" "), unit, F.when(k == 1, "").otherwise("s"), F.lit(" ago"))
    return table(spark, sf_dir, "events").select("event_id", dt.relative(text, F.col("ts")).alias("event_at"))


def dates_end_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prioritised end-time patterns; only a time ahead of the as-of instant counts."""
    stamp = F.date_format("ts", "yyyy/MM/dd HH:mm:ss")
    minute = F.date_format("ts", "yyyy-MM-dd HH:mm")
    kind = F.col("event_id") % 4
    text = (
        F.when(kind == 0, F.concat(F.lit("from 2024/01/01 00:00:00, End Time: "), stamp))
        .when(kind == 1, F.concat(F.lit("End Time: "), minute, F.lit(" or 2024-01-25 12:00:00")))
        .when(kind == 2, F.concat(F.lit("open until "), stamp))
        .otherwise(F.concat(F.lit("on "), stamp))
    )
    return table(spark, sf_dir, "events").select("event_id", dt.end_time(text, END_NOW).alias("event_at"))


def dates_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    offset = F.when(F.col("event_id") % 2 == 0, " +0000").otherwise(" -0530")
    text = F.concat(F.date_format("ts", "EEE, d MMM yyyy HH:mm:ss"), offset)
    return table(spark, sf_dir, "events").select(
        "event_id", dt.rfc822(text).alias("event_at"), dt.any_date(text).alias("any_at")
    )


def dates_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Free-form attributes: instants with and without an offset, and bare dates."""
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS")
    kind = F.col("event_id") % 4
    text = (
        F.when(kind == 0, F.concat(iso, F.lit("Z")))
        .when(kind == 1, F.concat(iso, F.lit("+02:00")))
        .when(kind == 2, iso)
        .otherwise(F.date_format("ts", "yyyy-MM-dd"))
    )
    return table(spark, sf_dir, "events").select(
        "event_id",
        dt.any_date(text).alias("event_at"),
        dt.any_date(text, "Asia/Tokyo").alias("tokyo_at"),
        dt.iso_out(dt.any_date(text)).alias("iso_text"),
    )


def dates_worded_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates with a clock, half of the day or offset, and the day before the month."""
    kind = F.col("event_id") % len(CLOCK_FORMS)
    text = F.lit(None).cast("string")
    for k, (pattern, _, _, _) in enumerate(CLOCK_FORMS):
        text = F.when(kind == k, F.date_format("ts", pattern)).otherwise(text)
    return table(spark, sf_dir, "events").select(
        "event_id",
        text.alias("text"),
        dt.any_date(text).alias("event_at"),
        dt.any_date(text, "Asia/Tokyo").alias("tokyo_at"),
    )


def dates_yearless(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _printed("MMMM d", before="Patch Notes ", after="")
    text = dt.yearless(dt.strip_noise_prefix(raw), F.col("o_orderdate"))
    return _orders(spark, sf_dir).select("o_orderkey", text.alias("text"), dt.any_date(text).alias("event_at"))


def dates_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All candidates of a text that holds three dates in two forms."""
    later = F.date_format(F.col("o_orderdate") + F.make_dt_interval(days=F.lit(40)), "MMMM d, yyyy")
    text = F.concat(_printed("MMMM d, yyyy"), F.lit("; next "), later, F.lit("; was "), F.date_format("o_orderdate", "M/d/yyyy"))
    rows = _orders(spark, sf_dir).select("o_orderkey", text.alias("text"))
    return dt.extract_dates(rows, "text", ["month_comma", "slash_date"], ["o_orderkey"])


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as dated candidates of their customer; every eleventh date is misspelt."""
    text = F.when(F.col("o_orderkey") % 11 == 0, "on Smarch 5, 1997").otherwise(_printed("MMMM d, yyyy"))
    return _orders(spark, sf_dir).select(
        F.col("o_custkey").alias("source"),
        F.col("o_orderkey").alias("pos"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("tier"),
        F.concat(F.lit("Order "), F.col("o_orderstatus")).alias("title"),
        dt.month_comma(text).alias("event_at"),
    )


def latest_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pick.pick_latest(_candidates(spark, sf_dir), keys=["source"])


def next_upcoming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pick.pick_next(_candidates(spark, sf_dir), NOW, keys=["source"])


def first_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pick.pick_first_valid(_candidates(spark, sf_dir), keys=["source"])


def match_or_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    match = pr.matches_any(F.col("title"), ["order p"])
    return pick.pick_match_or_first(_candidates(spark, sf_dir), match, keys=["source"])


def tier_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tier priority where the two urgent tiers must also be plausible at the as-of time."""
    rules = spark.createDataFrame([(1, True), (2, True), (3, False), (4, False), (5, False)], "tier int, guarded boolean")
    return pick.pick_by_tier(_candidates(spark, sf_dir), rules, NOW, keys=["source"])


def channel_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three channels per customer: finished orders, then open ones, then pending ones."""
    cand = _candidates(spark, sf_dir)
    channels = []
    for status in "FOP":
        one = cand.filter(F.col("title") == f"Order {status}")
        best = one.groupBy("source").agg(F.max("event_at").alias("event_at"), F.count(F.lit(1)).alias("n"))
        channels.append(best.withColumn("ok", F.col("event_at") > F.lit("2000-06-01").cast("timestamp_ntz")))
    return pick.pick_by_channel(*channels, keys=["source"])


def rule_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame([(1, "high"), (2, "high"), (3, "medium"), (4, "low")], "tier int, confidence string")
    return pick.with_confidence(_candidates(spark, sf_dir), rules, keys=["tier"])


def plausible_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("event_at")
    return _candidates(spark, sf_dir).select(
        "pos",
        pr.plausible(at, NOW).alias("plausible"),
        pr.upcoming(at, NOW).alias("upcoming_day"),
        pr.upcoming(at, NOW, "instant").alias("upcoming_instant"),
    )


_SHORT = "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE try_strptime(regexp_extract({t}, '[A-Z][a-z]+ +[0-9]+,? +[0-9]+'), '{f}') END"
_LONG_TEXT = "'Released ' || strftime(o_orderdate, '%B %-d, %Y') || ' as planned'"
_SHORT_TEXT = "'Released ' || strftime(o_orderdate, '%b %-d %Y') || ' as planned'"
_READ_LONG = _SHORT.format(t=_LONG_TEXT, f="%B %d, %Y")
_READ_SHORT = _SHORT.format(t=_SHORT_TEXT, f="%b %d %Y")


def _reread(printed: str, pattern: str, form: str) -> str:
    return f"strptime(regexp_extract('Released ' || strftime(o_orderdate, '{printed}') || ' as planned', '{pattern}'), '{form}')"


_CAND_SQL = """cand AS (
  SELECT o_custkey AS source, o_orderkey AS pos, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS tier,
    'Order ' || o_orderstatus AS title,
    CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) END AS event_at
  FROM orders)"""
_CAND = "source, pos, tier, title, event_at"


def _first_sql(where: str, order: str) -> str:
    return f"""WITH {_CAND_SQL} SELECT {_CAND} FROM cand WHERE {where}
QUALIFY row_number() OVER (PARTITION BY source ORDER BY {order}) = 1"""


_CHANNEL_SQL = "\nUNION ALL ".join(
    f"SELECT source, {i} AS channel, max(event_at) AS event_at, count(*) AS n FROM cand WHERE title = 'Order {s}' GROUP BY source"
    for i, s in enumerate("FOP", start=1)
)

QUERIES = {
    "dates_long": dates_long,
    "dates_slash": dates_slash,
    "dates_dotted": dates_dotted,
    "dates_iso": dates_iso,
    "dates_ends_on": dates_ends_on,
    "dates_relative": dates_relative,
    "dates_end_time": dates_end_time,
    "dates_feed": dates_feed,
    "dates_any": dates_any,
    "dates_worded_clock": dates_worded_clock,
    "dates_yearless": dates_yearless,
    "dates_all": dates_all,
    "latest_per_source": latest_per_source,
    "next_upcoming": next_upcoming,
    "first_valid": first_valid,
    "match_or_first": match_or_first,
    "tier_pick": tier_pick,
    "channel_pick": channel_pick,
    "rule_confidence": rule_confidence,
    "plausible_dates": plausible_dates,
}


def _clock_sql() -> str:
    """Each kind printed, read back with its own format and moved by its zone."""
    kinds = []
    for k, (_, form, hours, printed) in enumerate(CLOCK_FORMS):
        read = form.replace("%-", "%")
        utc = f"strptime(strftime(ts, '{form}'), '{read}') - INTERVAL {hours} HOUR"
        tokyo = utc if printed else f"{utc} - INTERVAL 9 HOUR"
        kinds.append(
            f"SELECT event_id, strftime(ts, '{form}') AS text, {utc} AS event_at, {tokyo} AS tokyo_at"
            f" FROM events WHERE event_id % {len(CLOCK_FORMS)} = {k}"
        )
    return "\nUNION ALL ".join(kinds)


ORACLES = {
    "dates_worded_clock": _clock_sql(),
    "dates_long": f"""SELECT o_orderkey, {_READ_LONG} AS comma, CAST(NULL AS TIMESTAMP) AS comma_missing,
  {_READ_SHORT} AS loose, {_READ_LONG} AS name_any_case, {_READ_LONG} AS name_comma, {_READ_SHORT} AS abbrev,
  {_READ_LONG} AS strict FROM orders""",
    "dates_slash": f"""SELECT o_orderkey, {_reread('%-m/%-d/%Y', '[0-9]+/[0-9]+/[0-9]+', '%m/%d/%Y')} AS event_at,
  {_reread('%-m/%-d/%Y', '[0-9]+/[0-9]+/[0-9]+', '%m/%d/%Y')} AS either FROM orders""",
    "dates_dotted": f"""SELECT o_orderkey,
  {_reread('%Y.%m.%d', '[0-9]+[.][0-9]+[.][0-9]+', '%Y.%m.%d')} AS event_at FROM orders""",
    "dates_iso": f"""SELECT o_orderkey, {_reread('%Y-%m-%d', '[0-9]+-[0-9]+-[0-9]+', '%Y-%m-%d')} AS dashed,
  {_reread('%Y/%m/%d', '[0-9]+/[0-9]+/[0-9]+', '%Y/%m/%d')} AS slashed,
  {_reread('%b %-d, %Y', '[A-Z][a-z]+ [0-9]+, [0-9]+', '%b %d, %Y')} AS first_of_both FROM orders""",
    "dates_ends_on": """WITH t AS (SELECT o_orderkey, strptime(strftime(o_orderdate, '%B %-d, %Y'), '%B %d, %Y') AS event_at FROM orders)
SELECT o_orderkey, event_at,
  CASE WHEN o_orderkey % 3 = 2 THEN event_at
       ELSE timezone('UTC', timezone('America/New_York', event_at)) END AS event_at_zoned,
  CAST(event_at AS DATE) AS current_season_ends,
  CASE WHEN o_orderkey % 3 = 2 THEN NULL ELSE 'America/New_York' END AS timezone,
  CAST(event_at AS DATE) + 1 AS next_season_estimate,
  strftime(CAST(event_at AS DATE) + 1, '%B %-d, %Y') AS next_season_estimate_friendly FROM t""",
    "dates_relative": """SELECT event_id, CASE event_id % 4 WHEN 0 THEN ts - to_hours(k) WHEN 1 THEN ts - to_days(k)
  WHEN 2 THEN ts - to_weeks(k) ELSE ts - to_months(k) END AS event_at
FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)""",
    "dates_end_time": f"""WITH t AS (SELECT event_id, date_trunc('second', ts) AS s, date_trunc('minute', ts) AS m,
  TIMESTAMP '{END_NOW}' AS n FROM events)
SELECT event_id, CASE event_id % 4
  WHEN 0 THEN CASE WHEN s > n THEN s END
  WHEN 1 THEN CASE WHEN m > n THEN m ELSE TIMESTAMP '2024-01-25 12:00:00' END
  ELSE CASE WHEN s > n THEN s END END AS event_at FROM t""",
    "dates_feed": """WITH t AS (SELECT event_id, date_trunc('second', ts)
  + CASE WHEN event_id % 2 = 0 THEN INTERVAL 0 MINUTE ELSE INTERVAL 330 MINUTE END AS made FROM events)
SELECT event_id, made AS event_at, made AS any_at FROM t""",
    "dates_any": """WITH t AS (SELECT event_id, date_trunc('millisecond', ts) AS w, event_id % 4 AS kind FROM events), u AS (
  SELECT event_id, CASE kind WHEN 0 THEN w WHEN 1 THEN w - INTERVAL 2 HOUR WHEN 2 THEN w ELSE date_trunc('day', w) END AS event_at,
    CASE kind WHEN 0 THEN w WHEN 1 THEN w - INTERVAL 2 HOUR WHEN 2 THEN w - INTERVAL 9 HOUR ELSE date_trunc('day', w) END AS tokyo_at
  FROM t)
SELECT event_id, event_at, tokyo_at, strftime(event_at, '%Y-%m-%dT%H:%M:%S.%gZ') AS iso_text FROM u""",
    "dates_yearless": """SELECT o_orderkey, strftime(o_orderdate, '%B %-d, %Y') AS text,
  strptime(strftime(o_orderdate, '%B %-d, %Y'), '%B %d, %Y') AS event_at FROM orders""",
    "dates_all": """WITH t AS (SELECT o_orderkey, o_orderdate AS a, o_orderdate + INTERVAL 40 DAY AS b FROM orders)
SELECT o_orderkey, 1 AS tier, 'month_comma' AS form, 0 AS pos, strftime(a, '%B %-d, %Y') AS match,
  strptime(strftime(a, '%B %-d, %Y'), '%B %d, %Y') AS event_at FROM t
UNION ALL SELECT o_orderkey, 1, 'month_comma', 1, strftime(b, '%B %-d, %Y'), strptime(strftime(b, '%B %-d, %Y'), '%B %d, %Y') FROM t
UNION ALL SELECT o_orderkey, 2, 'slash_date', 0, strftime(a, '%-m/%-d/%Y'), strptime(strftime(a, '%-m/%-d/%Y'), '%m/%d/%Y') FROM t""",
    "latest_per_source": _first_sql("event_at IS NOT NULL", "event_at DESC, pos"),
    "next_upcoming": _first_sql(
        f"event_at >= TIMESTAMP '{NOW}' AND event_at <= TIMESTAMP '{NOW}' + INTERVAL 2 YEAR", "event_at, pos"
    ),
    "first_valid": _first_sql("event_at IS NOT NULL", "pos"),
    "match_or_first": _first_sql("true", "CASE WHEN title = 'Order P' THEN 0 ELSE 1 END, pos"),
    "tier_pick": _first_sql(
        f"""event_at IS NOT NULL AND (tier > 2 OR event_at BETWEEN TIMESTAMP '{NOW}' - INTERVAL 2 YEAR
  AND TIMESTAMP '{NOW}' + INTERVAL 2 YEAR)""",
        "tier, pos",
    ),
    "channel_pick": f"""WITH {_CAND_SQL}, channels AS ({_CHANNEL_SQL}), judged AS (
  SELECT *, event_at > TIMESTAMP '2000-06-01' AS ok FROM channels)
SELECT source, event_at, n, ok FROM judged QUALIFY row_number() OVER (
  PARTITION BY source ORDER BY coalesce(ok, false) DESC, CASE WHEN ok THEN channel ELSE -channel END) = 1""",
    "rule_confidence": f"""WITH {_CAND_SQL} SELECT {_CAND},
  CASE WHEN tier IN (1, 2) THEN 'high' WHEN tier = 3 THEN 'medium' WHEN tier = 4 THEN 'low' END AS confidence FROM cand""",
    "plausible_dates": f"""WITH {_CAND_SQL} SELECT pos,
  event_at BETWEEN TIMESTAMP '{NOW}' - INTERVAL 2 YEAR AND TIMESTAMP '{NOW}' + INTERVAL 2 YEAR AS plausible,
  event_at >= TIMESTAMP '{NOW}' AS upcoming_day, event_at > TIMESTAMP '{NOW}' AS upcoming_instant FROM cand""",
}
