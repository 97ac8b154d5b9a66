"""Freshness over a stream of observations.

A keyed stateful function would have to hold and sort all of a source's rows of a micro-batch in
one task. Each micro-batch is instead resolved with the skew-safe batch operator, seeded with the
last-known-good table that the previous batch left behind. The table has two slots used in turn, so
a batch that is replayed after a failure reads exactly what it read the first time and overwrites
only its own output: results are the same however often a batch runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from eventboard.operators import resolve as rs
from eventboard.schemas import KEY, LIVE, columns
from eventboard.sources.results import write_lkg


def _slot(path: str, batch_id: int) -> str:
    return f"{path}/slot={batch_id % 2}"


def _carried_in(spark: SparkSession, lkg_path: str, batch_id: int, seed: DataFrame | None) -> DataFrame:
    if batch_id > 0:
        return spark.read.schema(LIVE).parquet(_slot(lkg_path, batch_id - 1))
    return seed.select(*columns(LIVE)) if seed is not None else spark.createDataFrame([], LIVE)


def resolve_stream(
    obs: DataFrame,
    history_path: str,
    lkg_path: str,
    checkpoint: str,
    tie: str = "run_id",
    keep: list[str] | None = None,
    seed: DataFrame | None = None,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Resolve a stream of observations into ``history_path`` (one folder per batch).

    Rows are put in event-time order within a batch; a row that comes later than newer successes is
    still resolved against what was good at its own time if that is known, and never moves the
    last known good record back. ``seed`` is the last-known-good table to start from.
    """
    extra = keep or []

    def one_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = _carried_in(spark, lkg_path, batch_id, seed)
        live = rs.resolve_history(batch, before, tie, extra)
        out = f"{history_path}/batch={batch_id}"
        live.write.mode("overwrite").parquet(out)
        # From the rows just written, not from the batch again.
        written = spark.read.schema(live.schema).parquet(out)
        rs.update_lkg(before, written).write.mode("overwrite").parquet(_slot(lkg_path, batch_id))

    writer = obs.writeStream.foreachBatch(one_batch).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def lkg_stream(obs: DataFrame) -> DataFrame:
    """The last-known-good table as a streaming aggregate: one row of state per source.

    Partial aggregation sends one row per source and task to the state store. Write it in update
    mode, for example with ``write_lkg_stream``.
    """
    fresh = rs.fresh_records(obs)
    rest = [c for c in fresh.columns if c not in KEY]
    newest = F.max_by(F.struct(*rest), F.struct("fetched_at", "run_id")).alias("_best")
    return fresh.groupBy(*KEY).agg(newest).select(*KEY, "_best.*").select(*columns(LIVE))


def write_lkg_stream(lkg: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Keep a last-known-good table up to date from ``lkg_stream``; unchanged sources are untouched."""

    def merge(batch: DataFrame, batch_id: int) -> None:
        write_lkg(batch, path)

    writer = lkg.writeStream.outputMode("update").foreachBatch(merge).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
