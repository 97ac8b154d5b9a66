"""A Bloom filter as a table: which rows of a wide table can have a partner at all, without moving them.

The filter is split into buckets of 32,768 bits; a key belongs to one bucket and sets ``PROBES`` bits there. It is
built and asked by built-in functions only: keys are aggregated to one row of four kilobytes per bucket, and that table,
``MAX_BUCKETS`` rows at most whatever the number of keys, is broadcast to the rows that are asked about. A key that was
put in is always found; one that was not is found by chance, 0.3 % of the time while there are ``BITS_PER_KEY`` bits for
each, more often beyond ``MAX_BUCKETS * 32768 / BITS_PER_KEY`` keys. So the answer still has to be joined; only the rows
left to join are few.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 32_768
PROBES = 4
BITS_PER_KEY = 16
#: 64 MB at most.
MAX_BUCKETS = 16_384


def _places(columns: list[str], buckets: int) -> tuple[Column, list[Column]]:
    """Bucket of a key and its places there, from 1."""
    first, second = F.xxhash64(*columns), F.xxhash64(F.lit(PROBES), *columns)
    places = [F.pmod(F.shiftright(second, 15 * k), F.lit(BITS)) + 1 for k in range(PROBES)]
    return F.pmod(first, F.lit(buckets)).cast("int"), places


@dataclass(frozen=True)
class Bloom:
    """A row ``bucket, bits`` for every bucket that has a key."""

    table: DataFrame
    columns: list[str]
    buckets: int


def bloom_filter(keys: DataFrame, columns: list[str]) -> Bloom:
    """The filter of all keys of ``columns``; counts the keys once to size itself."""
    count = keys.count()
    buckets = max(1, min(MAX_BUCKETS, -(-count * BITS_PER_KEY // BITS)))
    bucket, places = _places(columns, buckets)
    each = keys.select(bucket.alias("bucket"), F.explode(F.array(*places)).alias("place"))
    bits = F.bitmap_construct_agg(F.bitmap_bit_position("place"))
    return Bloom(each.groupBy("bucket").agg(bits.alias("bits")), columns, buckets)


def _is_set(place: Column) -> Column:
    # Bits of a byte count from its end, bytes of a word from its front.
    word, bit = F.floor((place - 1) / 64).cast("int"), ((place - 1) % 64).cast("int").bitwiseXOR(F.lit(56))
    return F.getbit(F.get("_bits", word), bit) == 1


def _asked(df: DataFrame, bloom: Bloom, columns: list[str] | None, how: str) -> tuple[DataFrame, Column]:
    bucket, places = _places(columns or bloom.columns, bloom.buckets)
    # Numbers of 64 bits: a byte string would be copied for each place that is looked up.
    words = F.transform(
        F.sequence(F.lit(0), F.lit(BITS // 64 - 1)),
        lambda k: F.conv(F.hex(F.substring("bits", k * 8 + 1, F.lit(8))), 16, -10).cast("long"),
    )
    table = F.broadcast(bloom.table.select(F.col("bucket").alias("_bucket"), words.alias("_bits")))
    return df.withColumn("_bucket", bucket).join(table, "_bucket", how), reduce(lambda a, b: a & b, map(_is_set, places))


def may_contain(df: DataFrame, bloom: Bloom, columns: list[str] | None = None) -> DataFrame:
    """Rows of ``df`` whose key (of the filter's columns, or those named here) may be in it. ``df`` is not shuffled."""
    asked, found = _asked(df, bloom, columns, "inner")
    return asked.filter(found).select(*df.columns)


def lacks(df: DataFrame, bloom: Bloom, columns: list[str] | None = None) -> DataFrame:
    """The other rows of ``df``: those whose key is certainly not in the filter. ``df`` is not shuffled."""
    asked, found = _asked(df, bloom, columns, "left")
    return asked.filter(~F.coalesce(found, F.lit(False))).select(*df.columns)
