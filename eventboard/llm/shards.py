"""Minimax contiguous sharding: groups of equal texts stay together, shard sizes are as even as groups allow.

Rows are put in one total order, by a digest of the text and then ``doc_id``, so a group is contiguous and copies
of any source spread over the whole order. Running byte and row totals place every row on that line. Consecutive
groups that end in the same cell of an even grid (``RUNS_PER_SHARD`` cells per shard) form a run, the atomic unit;
the driver sees run ends only, a number that depends on the grid and not on the data. The smallest feasible shard
capacity over the runs is found by binary search with a greedy check, and the line is cut under it: each cut lies
as near to an even share of what is left as the capacity, for this shard and for all later ones, permits.

A run is at most one grid cell longer than its largest group, so the capacity is within ``1 / RUNS_PER_SHARD`` of an
even share of the optimum over single groups.

Defined results: a NULL text has size 16 and checksum 0 and is in the group of NULL texts, apart from empty ones. A NULL
``doc_id`` comes first in its group. Repeated rows get a slot each. With fewer groups than shards some shards are
empty; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventboard.llm.arrays import table
from eventboard.llm.scratch import arrow_map, stored

RUNS_PER_SHARD = 2_000

_LINE = "doc_id long, size long, text_crc32 long, digest binary, part int, local_start long, local_row long"
_LINE_ARROW = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("size", pa.int64()),
        ("text_crc32", pa.int64()),
        ("digest", pa.binary()),
        ("part", pa.int32()),
        ("local_start", pa.int64()),
        ("local_row", pa.int64()),
    ]
)


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes and rows before each row within its partition."""
    part, size, rows = TaskContext.get().partitionId(), 0, 0
    for batch in batches:
        own = batch.column("size").to_numpy()
        before = np.cumsum(own) - own + size
        yield table(
            _LINE_ARROW,
            [
                *(batch.column(c) for c in ("doc_id", "size", "text_crc32", "digest")),
                np.full(len(own), part, dtype=np.int32),
                before,
                np.arange(rows, rows + len(own)),
            ],
        )
        size, rows = size + int(own.sum()), rows + len(own)


def line(docs: DataFrame) -> DataFrame:
    """Every document with the bytes (``start``) and rows (``row``) that lie before it in the total order."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.coalesce(F.unhex(F.sha2("text", 256)), F.lit("").cast("binary")).alias("digest"),
    )
    ordered = rows.repartitionByRange("digest", "doc_id").sortWithinPartitions("digest", "doc_id")
    placed = stored(arrow_map(ordered, _running, _LINE), "shard-line")
    # One row per partition.
    totals = placed.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).collect()
    offsets, size, count = [], 0, 0
    for r in sorted(totals, key=lambda r: r["part"]):
        offsets.append((r["part"], size, count))
        size, count = size + r["bytes"], count + r["rows"]
    base = docs.sparkSession.createDataFrame(offsets, "part int, bytes_before long, rows_before long")
    return placed.join(F.broadcast(base), "part").select(
        "doc_id",
        "size",
        "text_crc32",
        "digest",
        (F.col("local_start") + F.col("bytes_before")).alias("start"),
        (F.col("local_row") + F.col("rows_before")).alias("row"),
    )


def smallest_capacity(ends: np.ndarray, shards: int) -> int:
    """The least capacity with which a greedy walk over run ends needs no more than ``shards`` shards."""
    total = int(ends[-1])
    low = max(-(-total // shards), int(np.diff(ends, prepend=0).max()))
    high = total
    while low < high:
        middle = (low + high) // 2
        at = 0
        for _ in range(shards):
            at = int(ends[np.searchsorted(ends, at + middle, "right") - 1]) if at + middle < total else total
        low, high = (low, middle) if at == total else (middle + 1, high)
    return low


def cuts(ends: np.ndarray, shards: int) -> list[int]:
    """Indices into ``ends`` after which shards 0 to ``shards - 2`` end, -1 for before the first run."""
    capacity, total = smallest_capacity(ends, shards), int(ends[-1])
    starts = np.concatenate([[0], ends[:-1]])
    need = [total]  # need[k]: from here on, k + 1 shards of this capacity are enough
    for _ in range(shards):
        need.append(int(starts[min(np.searchsorted(starts, need[-1] - capacity), len(starts) - 1)]) if need[-1] > capacity else 0)
    out, at = [], 0
    for k in range(shards - 1):
        left = shards - k
        wish = at + (total - at) / left
        near = int(np.searchsorted(ends, wish))
        choice = [i for i in (near - 1, near) if i < len(ends)]
        best = min(choice, key=lambda i: abs((int(ends[i]) if i >= 0 else 0) - wish))
        least = int(np.searchsorted(ends, need[left - 1])) if need[left - 1] > 0 else -1
        most = int(np.searchsorted(ends, at + capacity, "right")) - 1
        best = min(max(best, least), most)
        out.append(best)
        at = int(ends[best]) if best >= 0 else 0
    return out


def _pick(values: list[int], shard: Column) -> Column:
    return F.element_at(F.array(*(F.lit(v) for v in values)), shard + 1)


def assign(docs: DataFrame, shards: int = 40, runs_per_shard: int = RUNS_PER_SHARD) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard, start``; slots count rows of a shard in order."""
    rows = line(docs)
    total = rows.agg(F.max(F.col("start") + F.col("size"))).first()[0] or 0
    width = max(1, -(-total // (shards * runs_per_shard)))
    groups = rows.groupBy("digest").agg(
        F.max(F.col("start") + F.col("size")).alias("end"), F.max(F.col("row") + 1).alias("rows")
    )
    runs = (
        groups.groupBy(F.expr(f"(end - 1) div {width}").alias("cell"))
        .agg(F.max("end").alias("end"), F.max("rows").alias("rows"))
        .select("end", "rows")
        .toPandas()  # a row per grid cell at most
        .sort_values("end")
    )
    bounds, first_rows = [], [0]
    if len(runs):
        ends, counts = runs["end"].to_numpy(np.int64), runs["rows"].to_numpy(np.int64)
        for i in cuts(ends, shards):
            bounds.append(int(ends[i]) if i >= 0 else 0)
            first_rows.append(int(counts[i]) if i >= 0 else 0)
    shard = sum(((F.col("start") >= b).cast("int") for b in bounds), F.lit(0)).cast("int")
    return rows.withColumn("shard", shard).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("row") - _pick(first_rows, F.col("shard"))).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "start",
    )
