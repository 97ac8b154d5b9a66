"""Carry the newest good row forward along every key's timeline: a parallel prefix scan.

A window over the key alone would put a hot key's whole history into one task. Here the rows are dealt by ranges of
(key, time, tie-break), so that a hot key, and an instant that is hot by itself, lie in as many slices as their rows
need. Each slice is scanned on its own and hands on one summary per key, its last good row; summaries compose by
keeping the later one, so an exclusive prefix over the few summaries of a key tells each slice what enters it.

There is one plan for every size. The input is read twice, once to sample the ranges and once to deal the rows; the
dealt rows are stored, so ranges and slice numbers hold even if a task is run again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from eventboard.session import stored


def with_slices(df: DataFrame, keys: list[str], at: str, tie: str, slices: int | None = None) -> DataFrame:
    """``df`` with ``_slice``, a number that never falls along (key, at, tie); stored.

    ``slices`` asks for that many; otherwise Spark's shuffle partitions and adaptive coalescing decide.
    """
    order = [*keys, at, tie]
    ranged = df.repartitionByRange(*([slices] if slices else []), *order)
    return stored(ranged.withColumn("_slice", F.spark_partition_id()), "timeline")


def carry_forward(
    df: DataFrame,
    keys: list[str],
    at: str,
    tie: str,
    good: Column,
    payload: Column,
    name: str = "carried",
    slices: int | None = None,
) -> DataFrame:
    """Add ``name``: ``payload`` of the newest good row at or before each row, in (at, tie) order."""
    sliced = with_slices(df, keys, at, tie, slices)
    cell = [*keys, "_slice"]
    within = W.partitionBy(*cell).orderBy(at, tie).rowsBetween(W.unboundedPreceding, W.currentRow)
    local = sliced.withColumn("_local", F.last(F.when(good, payload), ignorenulls=True).over(within))
    summary = sliced.groupBy(*cell).agg(F.max_by(payload, F.when(good, F.struct(at, tie))).alias("_hand"))
    before = W.partitionBy(*keys).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    entering = summary.select(
        *[F.col(c).alias(f"_{c}") for c in cell], F.last("_hand", ignorenulls=True).over(before).alias("_enter")
    ).filter(F.col("_enter").isNotNull())
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in cell])
    joined = local.join(entering, same, "left")
    return joined.withColumn(name, F.coalesce("_local", "_enter")).select(*df.columns, name)


def with_next(df: DataFrame, keys: list[str], at: str, tie: str, name: str = "until", slices: int | None = None) -> DataFrame:
    """Add ``name``: the time of the key's next row in (at, tie) order, NULL for its last; the same scan, backwards."""
    sliced = with_slices(df, keys, at, tie, slices)
    cell = [*keys, "_slice"]
    local = sliced.withColumn("_local", F.lead(at).over(W.partitionBy(*cell).orderBy(at, tie)))
    summary = sliced.groupBy(*cell).agg(F.min(at).alias("_first"))
    following = summary.select(
        *[F.col(c).alias(f"_{c}") for c in cell], F.lead("_first").over(W.partitionBy(*keys).orderBy("_slice")).alias("_enter")
    ).filter(F.col("_enter").isNotNull())
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in cell])
    joined = local.join(following, same, "left")
    return joined.withColumn(name, F.coalesce("_local", "_enter")).select(*df.columns, name)
