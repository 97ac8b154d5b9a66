"""Registered queries that write the tables and documents of the result store and return what is read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventboard.operators import resolve as rs
from eventboard.plans.freshness import ORACLES as BATCH_ORACLES
from eventboard.plans.freshness import RECORD
from eventboard.plans.tables import HISTORY_COLUMNS, run_log, table
from eventboard.schemas import SNAPSHOTS, columns
from eventboard.session import scratch_dir
from eventboard.sources import results, snapshots, versions
from eventboard.sources.documents import write_documents

DOCUMENT = [
    "source_id", "event_type", "title", "status", "event_at", "source_url", "confidence", "notes", "http_status",
    "fetch_mode", "failure_type", "explanation", "fetched_at", "last_success_at", "reason",
]
#: The run log up to here is the first of two writes.
HALF = "2024-01-16"


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_log(table(spark, sf_dir, "events"))


def live_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The live table after two writes, the second over the first."""
    path, log = scratch_dir(spark, "live"), _log(spark, sf_dir)
    for part in (log.filter(F.col("run_id") < HALF), log):
        results.write_live(rs.resolve_latest(part, tie="event_id"), path)
    return results.read_records(spark, path).select(*HISTORY_COLUMNS[1:])


def live_store_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same table as it was before its second write, read afterwards."""
    path, log = scratch_dir(spark, "live"), _log(spark, sf_dir)
    results.write_live(rs.resolve_latest(log.filter(F.col("run_id") < HALF), tie="event_id"), path)
    first = max(versions.versions(spark, path), default=0)
    results.write_live(rs.resolve_latest(log, tie="event_id"), path)
    return results.read_records(spark, path, first).select(*HISTORY_COLUMNS[1:])


def lkg_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last-known-good table after two writes, the older records last."""
    path, log = scratch_dir(spark, "lkg"), _log(spark, sf_dir)
    for part in (log.filter(F.col("run_id") >= HALF), log.filter(F.col("run_id") < HALF)):
        results.write_lkg(rs.fresh_records(part), path)
    return results.read_records(spark, path).select(*RECORD)


def result_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON file per source, written over an older set, and read back."""
    path, log = scratch_dir(spark, "documents"), _log(spark, sf_dir)
    for part in (log.filter(F.col("run_id") < HALF), log):
        write_documents(results.to_result_json(rs.resolve_latest(part, tie="event_id")), path)
    return results.normalize_results(results.read_results(spark, path, nested=True)).select(*DOCUMENT)


def stored_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as stored loads of a crawler, read back with their outcome."""
    path = scratch_dir(spark, "snapshots")
    at = F.lit("2026-02-04 21:35:06").cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("page_id"))
    fields = {
        "snapshot_id": F.col("page_id"), "run_id": F.lit("r1"), "source_id": F.concat(F.lit("s"), F.col("page_id") % 12),
        "requested_url": F.col("url"), "final_url": F.when(F.col("page_id") % 3 == 0, F.concat(F.col("url"), F.lit("#moved"))),
        "fetched_at": at, "http_status": F.element_at(F.array(*map(F.lit, (200, 403, 404, 503, 204))), (F.col("page_id") % 5 + 1).cast("int")),
        "fetch_mode": F.lit("http"), "error": F.lit(None).cast("string"), "body": F.col("html"),
    }
    table(spark, sf_dir, "pages").select(*[fields[c].alias(c) for c in columns(SNAPSHOTS)]).write.parquet(path)
    loads = rs.classify_fetch(snapshots.read_snapshots(spark, path))
    return loads.select("snapshot_id", "source_id", "fetched_at", F.coalesce("final_url", "requested_url").alias("page_url"), "ok", "failure_type", F.length("body").alias("n_chars"))


QUERIES = {f.__name__: f for f in (live_store, live_store_before, lkg_store, result_documents, stored_snapshots)}

_MS = "date_trunc('millisecond', {0}) AS {0}"

ORACLES = {
    "live_store": BATCH_ORACLES["freshness_latest"],
    "live_store_before": BATCH_ORACLES["freshness_latest"].replace("FROM events)", f"FROM events WHERE strftime(ts, '%Y-%m-%d') < '{HALF}')"),
    "lkg_store": BATCH_ORACLES["lkg_latest"],
    "result_documents": f"""SELECT source_id, event_type, title, status, {_MS.format('event_at')}, source_url, confidence, notes, http_status,
  'http' AS fetch_mode, CASE WHEN status = 'unavailable' THEN failure_type END AS failure_type,
  CASE WHEN status = 'unavailable' THEN explanation END AS explanation, {_MS.format('fetched_at')}, {_MS.format('last_success_at')}, reason
FROM ({BATCH_ORACLES['freshness_latest']})""",
    "stored_snapshots": """SELECT page_id AS snapshot_id, 's' || CAST(page_id % 12 AS VARCHAR) AS source_id,
  TIMESTAMP '2026-02-04 21:35:06' + to_seconds(page_id) AS fetched_at, CASE WHEN page_id % 3 = 0 THEN url || '#moved' ELSE url END AS page_url,
  page_id % 5 IN (0, 4) AS ok, CASE page_id % 5 WHEN 1 THEN 'blocked' WHEN 2 THEN 'unavailable' WHEN 3 THEN 'unavailable' END AS failure_type,
  CAST(length(html) AS INTEGER) AS n_chars FROM pages""",
}
