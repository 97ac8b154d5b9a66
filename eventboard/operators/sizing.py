"""Broadcast hints that are given only after looking at the size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_BROADCAST_ROWS = 100_000


def broadcast_if_small(df: DataFrame, limit: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``limit`` rows, else unchanged.

    For rule-like tables, whose rows are short: tables made from local rows carry no size for Spark
    to decide by, and joining pages to them by shuffle would send all bodies to one task per source.
    """
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df
