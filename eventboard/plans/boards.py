"""Registered queries of the board: cards, pages, ages and countdowns at several instants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventboard.functions import boardtext as bt
from eventboard.operators import board as bd
from eventboard.operators import resolve as rs
from eventboard.plans.tables import AS_OF, HISTORY_SQL, REGISTRY_SQL, customer_registry, run_log, table

INSTANTS = ["2024-01-15 00:00:00", "2024-02-01 00:00:00", "2024-02-10 06:30:00"]

CARD = ["source_id", "event_type", "name", "state", "badge", "countdown_text", "checked_text", "diff_ms"]
PAGE = [
    "source_id", "event_type", "page_label", "page_value", "page_checked", "page_notes", "source_label",
    "confidence_shown",
]


def _live(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rs.resolve_latest(run_log(table(spark, sf_dir, "events")), tie="event_id")


def _board(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bd.board(customer_registry(table(spark, sf_dir, "customer")), _live(spark, sf_dir), AS_OF)


def board_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _board(spark, sf_dir).select(*CARD)


def board_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _board(spark, sf_dir).select(*PAGE)


def board_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each resolved run reads on the board right when it was made."""
    log = run_log(table(spark, sf_dir, "events"))
    live = rs.resolve_history(log, tie="event_id", keep=["event_id"])
    return bd.with_board(live, F.col("fetched_at")).select(
        "event_id", "state", "badge", "countdown_text", "page_label", "page_value", "page_notes", "diff_ms"
    )


def age_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return events.select(
        "event_id",
        bt.age_text(F.col("ts"), AS_OF).alias("age"),
        bt.duration_long(bt.diff_ms(F.col("ts"), AS_OF)).alias("long_text"),
        bt.duration_card(bt.diff_ms(F.col("ts"), AS_OF)).alias("card_text"),
    )


def board_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bd.board_many(_live(spark, sf_dir), INSTANTS).select(
        "source_id", "event_type", "as_of", "diff_ms", "countdown_text"
    )


#: Instants at which the whole history is shown, spread evenly over the table's time.
MOMENTS = 1_000


def board_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the board read at a thousand instants of the history."""
    log = run_log(table(spark, sf_dir, "events"))
    ends = log.agg(F.min("fetched_at").alias("a"), F.max("fetched_at").alias("b"))
    start, stop = (F.unix_seconds(F.col(c).cast("timestamp")) for c in "ab")
    second = start + F.floor((stop - start) * F.col("k") / F.lit(MOMENTS - 1))
    moments = ends.select("a", "b", F.explode(F.sequence(F.lit(0), F.lit(MOMENTS - 1))).alias("k"))
    instants = moments.select(F.timestamp_seconds(second).cast("timestamp_ntz").alias("as_of"))
    live = rs.resolve_history(log, tie="event_id", keep=["event_id"])
    shown = bd.with_board(bd.board_at(live, instants, "event_id", 3_600), F.col("as_of"))
    return shown.select("source_id", "event_type", "as_of", "event_id", "badge", "countdown_text", "diff_ms")


def _two(n: str) -> str:
    return f"(CASE WHEN {n} < 10 THEN '0' ELSE '' END || CAST({n} AS VARCHAR))"


def age_sql(ms: str) -> str:
    def words(size: int, name: str) -> str:
        n = f"(abs({ms}) // {size})"
        return f"WHEN {n} > 0 THEN CAST({n} AS VARCHAR) || CASE WHEN {n} = 1 THEN ' {name} ago' ELSE ' {name}s ago' END"

    return (
        f"CASE WHEN {ms} IS NULL THEN NULL {words(86400000, 'day')} {words(3600000, 'hour')} "
        f"{words(60000, 'minute')} ELSE 'just now' END"
    )


def card_sql(ms: str) -> str:
    d, h, m = f"(abs({ms}) // 86400000)", f"(abs({ms}) // 3600000 % 24)", f"(abs({ms}) // 60000 % 60)"
    return (
        f"CASE WHEN {d} > 0 THEN CAST({d} AS VARCHAR) || 'd ' || {_two(h)} || 'h' "
        f"WHEN {h} > 0 THEN {_two(h)} || 'h ' || {_two(m)} || 'm' ELSE {_two(m)} || 'm' END"
    )


def long_sql(ms: str) -> str:
    d, h = f"(abs({ms}) // 86400000)", f"(abs({ms}) // 3600000 % 24)"
    m, s = f"(abs({ms}) // 60000 % 60)", f"(abs({ms}) // 1000 % 60)"
    return (
        f"CASE WHEN {ms} IS NULL THEN NULL ELSE concat_ws(' ', CASE WHEN {d} > 0 THEN {_two(d)} || 'd' END, "
        f"CASE WHEN {d} > 0 OR {h} > 0 THEN {_two(h)} || 'h' END, "
        f"CASE WHEN {d} > 0 OR {h} > 0 OR {m} > 0 THEN {_two(m)} || 'm' END, {_two(s)} || 's') END"
    )


_UP = "(event_type LIKE 'next-%' OR event_type LIKE '%reset%')"
_DOWN = "(event_at IS NULL OR coalesce(confidence = 'none', false) OR coalesce(status = 'unavailable', false))"
_STATE = f"CASE WHEN {_DOWN} THEN 'unavailable' WHEN ms > 0 AND status = 'stale' THEN 'stale' ELSE 'live' END"
_COUNT = f"CASE WHEN {_DOWN} THEN 'Data unavailable' WHEN ms <= 0 AND {_UP} THEN 'Updating...' ELSE {card_sql('ms')} END"
_LABEL = f"""CASE WHEN {_DOWN} OR (ms <= 0 AND {_UP}) THEN 'Status' WHEN ms > 0 THEN 'Time Until Event'
  ELSE 'Time Since Event' END"""
_VALUE = f"CASE WHEN {_DOWN} THEN 'Data Unavailable' WHEN ms <= 0 AND {_UP} THEN 'Updating...' ELSE {long_sql('ms')} END"
_NOTES = f"""CASE WHEN {_DOWN} THEN coalesce(reason, explanation)
  WHEN status = 'stale' THEN '⚠ Using cached data' || coalesce(': ' || reason, '') ELSE notes END"""

_BOARD_SQL = f"""{HISTORY_SQL}, {REGISTRY_SQL}, live AS (
  SELECT * FROM history QUALIFY row_number() OVER (
    PARTITION BY source_id, event_type ORDER BY fetched_at DESC, event_id DESC) = 1
), cards AS (
  SELECT r.source_id, r.event_type, r.name, r.ord, l.* EXCLUDE (source_id, event_type),
    epoch_us(l.event_at) // 1000 - epoch_us(TIMESTAMP '{AS_OF}') // 1000 AS ms,
    epoch_us(TIMESTAMP '{AS_OF}') // 1000 - epoch_us(l.fetched_at) // 1000 AS age
  FROM registry r LEFT JOIN live l ON l.source_id = r.source_id AND l.event_type = r.event_type
)"""

QUERIES = {
    "board_cards": board_cards,
    "board_page": board_page,
    "board_history": board_history,
    "board_many": board_many,
    "board_timeline": board_timeline,
    "age_text": age_text,
}

ORACLES = {
    "board_cards": f"""{_BOARD_SQL}
SELECT source_id, event_type, name, {_STATE} AS state, upper({_STATE}) AS badge, {_COUNT} AS countdown_text,
  coalesce('Checked ' || {age_sql('age')}, '--') AS checked_text, ms AS diff_ms FROM cards""",
    "board_page": f"""{_BOARD_SQL}
SELECT source_id, event_type, {_LABEL} AS page_label, {_VALUE} AS page_value,
  coalesce({age_sql('age')}, 'Never') AS page_checked, {_NOTES} AS page_notes,
  CASE WHEN {_DOWN} THEN 'Unavailable' ELSE coalesce(title, 'Official Source') END AS source_label,
  CASE WHEN {_DOWN} THEN 'none' ELSE confidence END AS confidence_shown FROM cards""",
    "board_history": f"""{HISTORY_SQL}, cards AS (
  SELECT *, epoch_us(event_at) // 1000 - epoch_us(fetched_at) // 1000 AS ms FROM history)
SELECT event_id, {_STATE} AS state, upper({_STATE}) AS badge, {_COUNT} AS countdown_text, {_LABEL} AS page_label,
  {_VALUE} AS page_value, {_NOTES} AS page_notes, ms AS diff_ms FROM cards""",
    "board_many": f"""{HISTORY_SQL}, live AS (
  SELECT * FROM history QUALIFY row_number() OVER (
    PARTITION BY source_id, event_type ORDER BY fetched_at DESC, event_id DESC) = 1
), timed AS (
  SELECT source_id, event_type, as_of, epoch_us(event_at) // 1000 - epoch_us(as_of) // 1000 AS ms
  FROM live, (VALUES {', '.join(f"(TIMESTAMP '{t}')" for t in INSTANTS)}) v(as_of) WHERE event_at IS NOT NULL)
SELECT source_id, event_type, as_of, ms AS diff_ms,
  CASE WHEN ms <= 0 AND {_UP} THEN 'Updating...' ELSE {card_sql('ms')} END AS countdown_text FROM timed""",
    "board_timeline": f"""{HISTORY_SQL}, valid AS (
  SELECT *, lead(fetched_at) OVER (PARTITION BY source_id, event_type ORDER BY fetched_at, event_id) AS until FROM history
), moments AS (
  SELECT make_timestamp((a + (b - a) * k // {MOMENTS - 1}) * 1000000) AS as_of
  FROM (SELECT epoch_us(min(fetched_at)) // 1000000 AS a, epoch_us(max(fetched_at)) // 1000000 AS b FROM history),
    (SELECT unnest(range({MOMENTS})) AS k)
), cards AS (
  SELECT v.*, as_of, epoch_us(event_at) // 1000 - epoch_us(as_of) // 1000 AS ms
  FROM valid v JOIN moments m ON m.as_of >= v.fetched_at AND (v.until IS NULL OR m.as_of < v.until))
SELECT source_id, event_type, as_of, event_id, upper({_STATE}) AS badge, {_COUNT} AS countdown_text, ms AS diff_ms FROM cards""",
    "age_text": f"""WITH t AS (SELECT event_id, epoch_us(ts) // 1000 - epoch_us(TIMESTAMP '{AS_OF}') // 1000 AS ms FROM events)
SELECT event_id, {age_sql('ms')} AS age, {long_sql('ms')} AS long_text, {card_sql('ms')} AS card_text FROM t""",
}
