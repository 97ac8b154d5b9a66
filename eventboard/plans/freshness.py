"""Registered queries over the run log: freshness, last known good, health, joins to the registry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventboard.functions.dates import next_weekly
from eventboard.operators import resolve as rs
from eventboard.plans.tables import (
    HISTORY_COLUMNS,
    HISTORY_SQL,
    REGISTRY_SQL,
    RUN_LOG_SQL,
    customer_registry,
    run_log,
    table,
)
from eventboard.schemas import KEY

RECORD = ["source_id", "event_type", "title", "event_at", "source_url", "confidence", "notes", "fetched_at"]


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_log(table(spark, sf_dir, "events"))


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rs.resolve_history(_log(spark, sf_dir), tie="event_id", keep=["event_id"])


def freshness_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history(spark, sf_dir).select(*HISTORY_COLUMNS)


def freshness_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rs.resolve_latest(_log(spark, sf_dir), tie="event_id").select(*HISTORY_COLUMNS[1:])


def lkg_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    fresh = rs.fresh_records(_log(spark, sf_dir))
    return rs.newest_per_key(fresh).select(*RECORD)


def lkg_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rs.lkg_as_of(_log(spark, sf_dir), tie="event_id")
    return out.filter(~F.col("ok")).select(
        "event_id", "source_id", F.col("lkg.event_at").alias("lkg_event_at"), F.col("lkg.fetched_at").alias("lkg_at")
    )


def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rs.run_summary(history(spark, sf_dir))


def run_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rs.health_gate(history(spark, sf_dir), limit=0.01)


def unavailable_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    registry = customer_registry(table(spark, sf_dir, "customer"))
    return rs.unavailable_list(history(spark, sf_dir), registry)


def resolve_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last day as the current run against the records of all earlier days."""
    log = _log(spark, sf_dir)
    last = log.select(F.max("run_id")).scalar()
    lkg = rs.newest_per_key(rs.fresh_records(log.filter(F.col("run_id") < last)))
    obs = rs.newest_per_key(log.filter(F.col("run_id") == last), tie=["event_id"])
    registry = customer_registry(table(spark, sf_dir, "customer"))
    return rs.resolve(obs, lkg, registry).select(
        "source_id", "event_type", "title", "status", "event_at", "confidence", "failure_type",
        "explanation", "fetched_at", "last_success_at", "reason",
    )


def registry_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    registry = customer_registry(table(spark, sf_dir, "customer"))
    obs = rs.newest_per_key(_log(spark, sf_dir), tie=["event_id"])
    return rs.every_source(registry, obs).select(*KEY, "name", "title", "ok", "fetched_at", "explanation")


def registry_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer as a source in every run, whether it reported or not."""
    registry = customer_registry(table(spark, sf_dir, "customer"))
    due = rs.every_run(registry, _log(spark, sf_dir), tie="event_id")
    return rs.resolve_history(due, tie="event_id").select(
        "run_id", "source_id", "event_type", "title", "status", "event_at", "failure_type", "explanation",
        "fetched_at", "last_success_at", "reason",
    )


def outcome_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    loads = table(spark, sf_dir, "events").select(
        "event_id",
        (F.col("value") * 7).cast("int").alias("http_status"),
        F.when(F.col("user_id") % 2 == 0, "browser").otherwise("http").alias("fetch_mode"),
    )
    return rs.classify_fetch(loads)


def weekly_slot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id",
        next_weekly(F.col("ts")).alias("slot"),
        next_weekly(F.col("ts"), boundary="minute").alias("slot_minute"),
        next_weekly(F.col("ts"), dow=1, time="06:30").alias("monday_slot"),
    )


_H = ", ".join(HISTORY_COLUMNS)

_GOOD = f"""good AS (
  SELECT * FROM run_log WHERE ok QUALIFY row_number() OVER (
    PARTITION BY source_id, event_type ORDER BY fetched_at DESC, event_id DESC) = 1
)"""

_LATEST_SQL = f"""{HISTORY_SQL}
SELECT {', '.join(HISTORY_COLUMNS[1:])} FROM history QUALIFY row_number() OVER (
  PARTITION BY source_id, event_type ORDER BY fetched_at DESC, event_id DESC) = 1"""

_SLOT = """CASE WHEN date_trunc('week', ts) + INTERVAL '{first}' HOUR + INTERVAL '{minutes}' MINUTE {test}
  THEN CAST(date_trunc('week', ts) AS TIMESTAMP) + INTERVAL '{first}' HOUR + INTERVAL '{minutes}' MINUTE
  ELSE CAST(date_trunc('week', ts) AS TIMESTAMP) + INTERVAL '{second}' HOUR + INTERVAL '{minutes}' MINUTE END"""

QUERIES = {
    "freshness_history": freshness_history,
    "freshness_latest": freshness_latest,
    "lkg_latest": lkg_latest,
    "lkg_as_of": lkg_as_of,
    "run_summary": run_summary,
    "run_health": run_health,
    "unavailable_list": unavailable_list,
    "resolve_run": resolve_run,
    "registry_left": registry_left,
    "registry_history": registry_history,
    "outcome_class": outcome_class,
    "weekly_slot": weekly_slot,
}

ORACLES = {
    "freshness_history": f"{HISTORY_SQL} SELECT {_H} FROM history",
    "freshness_latest": _LATEST_SQL,
    "lkg_latest": f"WITH {RUN_LOG_SQL}, {_GOOD} SELECT {', '.join(RECORD)} FROM good",
    "lkg_as_of": f"""{HISTORY_SQL}
SELECT event_id, source_id, event_at AS lkg_event_at, last_success_at AS lkg_at
FROM history WHERE status <> 'fresh'""",
    "run_summary": f"""{HISTORY_SQL}
SELECT run_id, count(*) AS total, count(*) FILTER (WHERE status = 'fresh') AS fresh,
  count(*) FILTER (WHERE status = 'stale') AS stale,
  count(*) FILTER (WHERE status = 'unavailable') AS unavailable
FROM history GROUP BY run_id""",
    "run_health": f"""{HISTORY_SQL}, summary AS (
  SELECT run_id, count(*) AS total, count(*) FILTER (WHERE status = 'fresh') AS fresh,
    count(*) FILTER (WHERE status = 'stale') AS stale,
    count(*) FILTER (WHERE status = 'unavailable') AS unavailable
  FROM history GROUP BY run_id)
SELECT *, CAST(unavailable AS DOUBLE) / total AS failure_ratio,
  CAST(unavailable AS DOUBLE) / total > 0.01 AS failed FROM summary""",
    "unavailable_list": f"""{HISTORY_SQL}, {REGISTRY_SQL}
SELECT h.run_id, h.source_id, h.event_type, h.title, h.explanation, r.ord
FROM history h JOIN registry r USING (source_id, event_type) WHERE h.status = 'unavailable'""",
    "resolve_run": f"""WITH {RUN_LOG_SQL}, {REGISTRY_SQL}, last_run AS (SELECT max(run_id) AS d FROM run_log),
obs AS (
  SELECT * FROM run_log WHERE run_id = (SELECT d FROM last_run) QUALIFY row_number() OVER (
    PARTITION BY source_id, event_type ORDER BY fetched_at DESC, event_id DESC) = 1),
lkg AS (
  SELECT * FROM run_log WHERE ok AND run_id < (SELECT d FROM last_run) QUALIFY row_number() OVER (
    PARTITION BY source_id, event_type ORDER BY fetched_at DESC, event_id DESC) = 1)
SELECT r.source_id, r.event_type, CASE WHEN o.ok THEN o.title ELSE r.name END AS title,
  CASE WHEN o.ok THEN 'fresh' WHEN l.event_id IS NOT NULL THEN 'stale' ELSE 'unavailable' END AS status,
  CASE WHEN o.ok THEN o.event_at ELSE l.event_at END AS event_at,
  CASE WHEN o.ok THEN o.confidence ELSE l.confidence END AS confidence,
  CASE WHEN o.ok THEN NULL ELSE coalesce(o.failure_type, 'unavailable') END AS failure_type,
  CASE WHEN o.ok THEN NULL
       ELSE coalesce(o.explanation, 'Crashed: Provider returned invalid/empty result') END AS explanation,
  o.fetched_at,
  CASE WHEN o.ok THEN o.fetched_at ELSE l.fetched_at END AS last_success_at,
  CASE WHEN NOT coalesce(o.ok, false) AND l.event_id IS NOT NULL
       THEN coalesce(o.explanation, 'Crashed: Provider returned invalid/empty result') END AS reason
FROM registry r
LEFT JOIN obs o ON o.source_id = r.source_id AND o.event_type = r.event_type
LEFT JOIN lkg l ON l.source_id = r.source_id AND l.event_type = r.event_type""",
    "registry_history": f"""WITH {RUN_LOG_SQL}, {REGISTRY_SQL},
runs AS (SELECT run_id, max(fetched_at) AS run_at FROM run_log GROUP BY run_id),
reported AS (
  SELECT * FROM run_log QUALIFY row_number() OVER (
    PARTITION BY run_id, source_id, event_type ORDER BY fetched_at DESC, event_id DESC) = 1),
obs AS (
  SELECT d.run_id, d.source_id, d.event_type, d.name, o.title, o.event_at, o.event_id, coalesce(o.ok, false) AS ok,
    coalesce(o.fetched_at, d.run_at) AS fetched_at,
    CASE WHEN o.ok THEN NULL ELSE coalesce(o.failure_type, 'unavailable') END AS failure_type,
    CASE WHEN o.ok THEN NULL
         ELSE coalesce(o.explanation, 'Crashed: Provider returned invalid/empty result') END AS explanation
  FROM (SELECT * FROM runs, registry) d
  LEFT JOIN reported o ON o.run_id = d.run_id AND o.source_id = d.source_id AND o.event_type = d.event_type),
marked AS (
  SELECT *, last_value(CASE WHEN ok THEN event_id END IGNORE NULLS) OVER (
      PARTITION BY source_id, event_type ORDER BY fetched_at, event_id NULLS FIRST
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS good_id
  FROM obs)
SELECT m.run_id, m.source_id, m.event_type, CASE WHEN m.ok THEN m.title ELSE m.name END AS title,
  CASE WHEN m.ok THEN 'fresh' WHEN g.event_id IS NOT NULL THEN 'stale' ELSE 'unavailable' END AS status,
  g.event_at, m.failure_type, m.explanation, m.fetched_at, g.fetched_at AS last_success_at,
  CASE WHEN NOT m.ok AND g.event_id IS NOT NULL THEN m.explanation END AS reason
FROM marked m LEFT JOIN run_log g ON g.event_id = m.good_id""",
    "registry_left": f"""WITH {RUN_LOG_SQL}, {REGISTRY_SQL}, obs AS (
  SELECT * FROM run_log QUALIFY row_number() OVER (
    PARTITION BY source_id, event_type ORDER BY fetched_at DESC, event_id DESC) = 1)
SELECT r.source_id, r.event_type, r.name, coalesce(o.title, r.name) AS title, coalesce(o.ok, false) AS ok,
  o.fetched_at, CASE WHEN o.event_id IS NULL THEN 'Crashed: Provider returned invalid/empty result'
                     ELSE o.explanation END AS explanation
FROM registry r LEFT JOIN obs o ON o.source_id = r.source_id AND o.event_type = r.event_type""",
    "outcome_class": """WITH loads AS (
  SELECT event_id, CAST(trunc(value * 7) AS INTEGER) AS http_status,
    CASE WHEN user_id % 2 = 0 THEN 'browser' ELSE 'http' END AS fetch_mode FROM events)
SELECT event_id, http_status, fetch_mode, http_status BETWEEN 200 AND 299 AS ok,
  CASE WHEN http_status BETWEEN 200 AND 299 THEN NULL
       WHEN http_status IN (403, 429) OR (http_status = 0 AND fetch_mode = 'browser') THEN 'blocked'
       ELSE 'unavailable' END AS failure_type
FROM loads""",
    "weekly_slot": f"""SELECT event_id,
  {_SLOT.format(first=82, second=250, minutes=0, test='> ts')} AS slot,
  {_SLOT.format(first=82, second=250, minutes=0, test=">= date_trunc('minute', ts)")} AS slot_minute,
  {_SLOT.format(first=6, second=174, minutes=30, test='> ts')} AS monday_slot
FROM events""",
}
