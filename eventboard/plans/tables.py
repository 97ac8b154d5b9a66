"""Shared inputs of the registered queries: the given tables in the shapes the operators take."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventboard.functions.predicates import failure_type

# Fixed values of the test mapping: a source's event type by its number, a failed run's status code.
TYPES = ["next-patch", "last-patch", "weekly-reset", "status", "last-update"]
BAD_STATUS = [403, 429, 404, 503, 0]
AS_OF = "2024-02-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of one task where the work is heavy per row.
TASK_ROWS = 50_000


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt out to all cores, ``TASK_ROWS`` to a task at most on average, if the scan has fewer splits than that takes.

    For work that is heavy per row. A scan is split by bytes: a file of narrow rows has few splits of very many rows, and
    a task would grow with the file. Wide rows have more splits than that and are left as they are, without a shuffle.
    """
    parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // TASK_ROWS))
    return df.repartition(parts) if df.rdd.getNumPartitions() < parts else df


def source_type(number: Column) -> Column:
    return F.element_at(F.array(*[F.lit(t) for t in TYPES]), (number % len(TYPES) + 1).cast("int"))


def run_log(events: DataFrame) -> DataFrame:
    """The event log read as a run log: a user is a source, a day a run, an error a failed run."""
    k = F.get_json_object("props", "$.k").cast("int")
    ok = F.col("event_type") != "error"
    staged = events.select(
        "event_id",
        F.date_format("ts", "yyyy-MM-dd").alias("run_id"),
        F.col("user_id").cast("string").alias("source_id"),
        source_type(F.col("user_id")).alias("event_type"),
        F.concat(F.lit("Source "), F.col("user_id").cast("string")).alias("title"),
        ok.alias("ok"),
        F.when(ok, F.col("ts") + F.make_dt_interval(hours=k * 6)).alias("event_at"),
        F.when(ok, F.concat(F.lit("https://example.org/"), F.col("user_id").cast("string"))).alias("source_url"),
        F.when(ok, F.when(k == 7, "none").when(F.col("value") >= 10, "high").otherwise("medium")).alias("confidence"),
        F.when(ok, F.col("event_type")).alias("notes"),
        F.when(ok, F.lit(200))
        .otherwise(F.element_at(F.array(*[F.lit(s) for s in BAD_STATUS]), k % len(BAD_STATUS) + 1))
        .alias("http_status"),
        F.lit("http").alias("fetch_mode"),
        F.col("ts").alias("fetched_at"),
        F.lit(None).cast("map<string,string>").alias("extras"),
    )
    return staged.withColumns(
        {
            "failure_type": failure_type(F.col("http_status"), F.col("fetch_mode")),
            "explanation": F.when(
                ~F.col("ok"), F.concat(F.lit("Crashed: HTTP "), F.col("http_status").cast("string"))
            ),
        }
    )


RUN_LOG_SQL = """run_log AS (
  SELECT *,
    CASE WHEN http_status = 200 THEN NULL WHEN http_status IN (403, 429) THEN 'blocked'
         ELSE 'unavailable' END AS failure_type,
    CASE WHEN NOT ok THEN 'Crashed: HTTP ' || CAST(http_status AS VARCHAR) END AS explanation
  FROM (
    SELECT event_id, strftime(ts, '%Y-%m-%d') AS run_id, CAST(user_id AS VARCHAR) AS source_id,
      (['next-patch','last-patch','weekly-reset','status','last-update'])[user_id % 5 + 1] AS event_type,
      'Source ' || CAST(user_id AS VARCHAR) AS title,
      event_type <> 'error' AS ok,
      CASE WHEN event_type <> 'error' THEN ts + to_hours(k * 6) END AS event_at,
      CASE WHEN event_type <> 'error' THEN 'https://example.org/' || CAST(user_id AS VARCHAR) END AS source_url,
      CASE WHEN event_type = 'error' THEN NULL WHEN k = 7 THEN 'none' WHEN value >= 10 THEN 'high'
           ELSE 'medium' END AS confidence,
      CASE WHEN event_type <> 'error' THEN event_type END AS notes,
      CAST(CASE WHEN event_type <> 'error' THEN 200 ELSE ([403,429,404,503,0])[k % 5 + 1] END AS INTEGER)
        AS http_status,
      'http' AS fetch_mode, ts AS fetched_at
    FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)
  )
)"""

# The resolved history in SQL: the newest successful row at or before each row, by (time, id).
HISTORY_SQL = f"""WITH {RUN_LOG_SQL}, marked AS (
  SELECT *, last_value(CASE WHEN ok THEN event_id END IGNORE NULLS) OVER (
      PARTITION BY source_id, event_type ORDER BY fetched_at, event_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS good_id
  FROM run_log
), history AS (
  SELECT m.event_id, m.run_id, m.source_id, m.event_type, m.title,
    CASE WHEN m.ok THEN 'fresh' WHEN g.event_id IS NOT NULL THEN 'stale' ELSE 'unavailable' END AS status,
    g.event_at, g.source_url, g.confidence, g.notes,
    coalesce(g.http_status, m.http_status) AS http_status, m.failure_type, m.explanation,
    m.fetched_at, g.fetched_at AS last_success_at,
    CASE WHEN NOT m.ok AND g.event_id IS NOT NULL THEN m.explanation END AS reason
  FROM marked m LEFT JOIN run_log g ON g.event_id = m.good_id
)"""

HISTORY_COLUMNS = [
    "event_id", "run_id", "source_id", "event_type", "title", "status", "event_at", "source_url",
    "confidence", "notes", "http_status", "failure_type", "explanation", "fetched_at",
    "last_success_at", "reason",
]


def customer_registry(customers: DataFrame) -> DataFrame:
    """Customers as registered sources, in key order."""
    return customers.select(
        F.col("c_custkey").cast("string").alias("source_id"),
        source_type(F.col("c_custkey")).alias("event_type"),
        F.col("c_name").alias("name"),
        F.col("c_custkey").alias("ord"),
    )


REGISTRY_SQL = """registry AS (
  SELECT CAST(c_custkey AS VARCHAR) AS source_id,
    (['next-patch','last-patch','weekly-reset','status','last-update'])[c_custkey % 5 + 1] AS event_type,
    c_name AS name, c_custkey AS ord
  FROM customer
)"""
