"""Page snapshots: scans, streams and the dead-letter table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventboard.functions.dates import iso_out
from eventboard.functions.predicates import fetch_ok
from eventboard.schemas import SNAPSHOTS


def read_snapshots(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Snapshots with a declared schema; partition the table by run date for pruning."""
    return spark.read.schema(SNAPSHOTS).format(fmt).load(path)


def stream_snapshots(spark: SparkSession, path: str, fmt: str = "parquet", max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(SNAPSHOTS).format(fmt)
    return (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).load(path)


def quarantine(df: DataFrame, kept: int | None = None) -> DataFrame:
    """Failed page loads under a name made of source and time, with their body or its first ``kept`` characters."""
    stamp = F.regexp_replace(iso_out(F.col("fetched_at")), "[:.]", "-")
    return df.filter(~fetch_ok(F.col("http_status"))).select(
        "snapshot_id",
        "source_id",
        F.concat_ws(".", F.coalesce("source_id", F.lit("unknown")), stamp, F.lit("html")).alias("name"),
        "requested_url",
        "http_status",
        "fetched_at",
        (F.col("body") if kept is None else F.substring("body", 1, kept)).alias("body"),
    )
