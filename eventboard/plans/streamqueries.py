"""Registered queries that run as streams over the event table and return what they wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventboard.plans.freshness import ORACLES as BATCH_ORACLES
from eventboard.plans.freshness import RECORD
from eventboard.plans.tables import HISTORY_COLUMNS, run_log, table
from eventboard.session import scratch_dir
from eventboard.sources.results import read_records
from eventboard.streaming import keyed
from eventboard.streaming.freshness import lkg_stream, resolve_stream, write_lkg_stream


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def freshness_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch_dir(spark, "freshness")
    query = resolve_stream(
        run_log(event_stream(spark, sf_dir)), f"{out}/history", f"{out}/lkg", f"{out}/checkpoint",
        tie="event_id", keep=["event_id"],
    )
    query.awaitTermination()
    return spark.read.parquet(f"{out}/history").select(*HISTORY_COLUMNS)


def lkg_latest_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch_dir(spark, "lkg")
    stream = lkg_stream(run_log(event_stream(spark, sf_dir)))
    write_lkg_stream(stream, f"{out}/table", f"{out}/checkpoint").awaitTermination()
    return read_records(spark, f"{out}/table").select(*RECORD)


def late_event_stream(spark: SparkSession, sf_dir: str, folder: str, parts: int = 5) -> tuple[DataFrame, str]:
    """The event table as files of ``parts`` spans of time, every seventh row one span late, and the delay that covers it.

    One batch reads the files of a span. The last file holds a heartbeat, an event without a type, which moves the
    watermark past all others.
    """
    events = table(spark, sf_dir, "events")
    first, last = events.select(F.unix_seconds(F.min("ts").cast("timestamp")), F.unix_seconds(F.max("ts").cast("timestamp"))).first()
    step = ((last or 0) - (first or 0)) // parts + 1
    due = F.floor((F.unix_seconds(F.col("ts").cast("timestamp")) - F.lit(first or 0)) / step)
    due = F.least(due + (F.col("event_id") % 7 == 0).cast("int"), F.lit(parts - 1))
    files = spark.sparkContext.defaultParallelism
    for k in range(parts):
        events.filter(due == k).repartition(files).write.mode("append").parquet(folder)
    delay = 2 * step
    beat = spark.createDataFrame([(-1, (last or 0) + 3 * delay)], "event_id long, at long")
    at = F.timestamp_seconds("at").cast(events.schema["ts"].dataType)
    fields = {"event_id": F.col("event_id").cast(events.schema["event_id"].dataType), "ts": at}
    blank = [fields[f.name].alias(f.name) if f.name in fields else F.lit(None).cast(f.dataType).alias(f.name) for f in events.schema]
    beat.select(*blank).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", files).parquet(folder)
    return run_log(stream), f"{delay} seconds"


def freshness_keyed_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The history from several batches with late rows, one record of state per source."""
    out = scratch_dir(spark, "keyed")
    log, delay = late_event_stream(spark, sf_dir, f"{out}/events")
    live = keyed.resolved(log, delay, "event_id", ["event_id"])
    keyed.write_stream(live, f"{out}/history", f"{out}/checkpoint").awaitTermination()
    return spark.read.schema(live.schema).parquet(f"{out}/history").select(*HISTORY_COLUMNS)


def run_health_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Health of every daily run, closed by the watermark."""
    out = scratch_dir(spark, "health")
    log, delay = late_event_stream(spark, sf_dir, f"{out}/events")
    health = keyed.health_stream(keyed.resolved(log, delay, "event_id"), "1 day", 0.01)
    keyed.write_stream(health, f"{out}/health", f"{out}/checkpoint").awaitTermination()
    return spark.read.schema(health.schema).parquet(f"{out}/health")


QUERIES = {
    "freshness_stream": freshness_stream,
    "lkg_latest_stream": lkg_latest_stream,
    "freshness_keyed_stream": freshness_keyed_stream,
    "run_health_stream": run_health_stream,
}

ORACLES = {
    "freshness_stream": BATCH_ORACLES["freshness_history"],
    "lkg_latest_stream": BATCH_ORACLES["lkg_latest"],
    "freshness_keyed_stream": BATCH_ORACLES["freshness_history"],
    "run_health_stream": BATCH_ORACLES["run_health"],
}
