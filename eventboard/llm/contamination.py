"""Benchmark decontamination: short test items inside long documents, in DataFrame functions only.

Words are lower-cased runs of characters other than blank and ``\\x09``-``\\x0D``; an item or document is the set of its
five-word shingles (the whole sequence as one shingle when it has fewer words). A document is contaminated by an
item when it holds at least ``threshold`` of the item's shingles. An item of one to four words is a single shingle, which
is looked for among all windows of as many words; documents have those only for lengths that occur among the items.

Candidates come from MinHash sketches of the items, partitioned by size: all items whose shingle count lies in one
doubling share an upper bound ``u`` and a sketch of the ``u - ceil(threshold * u) + 1`` smallest shingle hashes. A
document that reaches the threshold misses fewer shingles than that, so at least one sketch hash is among its own;
how many must be follows from the item's size. Sketches grow with the items, not with the documents, and no
qualifying pair is missed however long the document is. Candidates are then verified by exact shingle containment.

Defined results: a NULL or empty text, of an item or a document, matches nothing. Equal items are reported each.
Rows that share a ``doc_id`` (NULL included) are one document, the union of their shingles for the search and the
best row for the verdict. Other columns are ignored by ``containments``, kept by ``clean``. Without items nothing is
contaminated.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventboard.llm.scratch import stored

SHINGLE = 5
THRESHOLD_PERCENT = 75
#: Rows of sketches or of candidate ids that may be broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 100_000
#: Bytes of item texts whose shingles may be broadcast; the shingles take about ``SHINGLE`` times as much.
BROADCAST_BYTES = 8 << 20
_BLANKS = " \t\n\x0b\f\r"


def _words(text: Column) -> Column:
    trimmed = F.btrim(F.lower(F.coalesce(text, F.lit(""))), F.lit(_BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))


def short_lengths(items: DataFrame) -> list[int]:
    """Numbers of words under five that occur among the items."""
    n = items.select(F.size(_words(F.col("text"))).alias("n")).filter(f"n BETWEEN 1 AND {SHINGLE - 1}")
    return sorted(r.n for r in n.distinct().collect())


def _shingles(text: Column, of, short: list[int]) -> Column:
    """Values of ``of(words)`` over a text's shingles and its windows of the ``short`` lengths.

    A short text has a single shingle, its words joined; so have windows. The words are bound to a lambda variable, so
    they are split once per text and not once per shingle.
    """

    def per_text(words: Column) -> Column:
        n = F.size(words)
        whole = F.when(
            n >= SHINGLE,
            F.transform(F.sequence(F.lit(0), n - SHINGLE), lambda i: of([F.get(words, i + k) for k in range(SHINGLE)])),
        ).when(n > 0, F.array(of([F.array_join(words, " ")])))
        if not short:
            return whole

        def windows(size: int) -> Column:
            def at(i: Column) -> Column:
                return of([F.array_join(F.slice(words, i + 1, size), " ")])

            return F.when(n >= size, F.transform(F.sequence(F.lit(0), n - size), at))

        parts = [F.coalesce(p, F.array().cast(of_type)) for of_type in [_type_of(of)] for p in (whole, *map(windows, short))]
        return F.when(n > 0, F.concat(*parts))

    return F.get(F.transform(F.array(_words(text)), per_text), 0)


def _hashed(words: list[Column]) -> Column:
    return F.xxhash64(*words)


def _joined(words: list[Column]) -> Column:
    return F.concat_ws(" ", *words)


def _type_of(of) -> str:
    return "array<long>" if of is _hashed else "array<string>"


def _hashes(text: Column, short: list[int] | None = None) -> Column:
    return _shingles(text, _hashed, short or [])


def _strings(text: Column, short: list[int] | None = None) -> Column:
    return F.array_distinct(_shingles(text, _joined, short or []))


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def sketches(items: DataFrame, percent: int = THRESHOLD_PERCENT) -> DataFrame:
    """``item_id, n_item, least, hash``: the item's sketch, and how many of its hashes a match must hold."""
    sized = (
        items.select("item_id", F.array_sort(F.array_distinct(_hashes(F.col("text")))).alias("hashes"))
        .filter("hashes IS NOT NULL")
        .withColumn("n_item", F.size("hashes").cast("long"))
        .withColumn("upper", F.expr("shiftleft(1L, cast(floor(log2(n_item)) AS int) + 1) - 1"))
        .withColumn("kept", F.expr(f"least(n_item, upper - (upper * {percent} + 99) div 100 + 1)"))
        .withColumn("least", F.expr(f"kept - (n_item - (n_item * {percent} + 99) div 100)"))
    )
    return sized.select(
        "item_id", "n_item", "least", F.explode(F.expr("slice(hashes, 1, cast(kept AS int))")).alias("hash")
    )


def candidates(docs: DataFrame, items: DataFrame, percent: int = THRESHOLD_PERCENT) -> DataFrame:
    """``doc_id, item_id`` of all pairs that can reach the threshold."""
    sketch = stored(sketches(items, percent), "sketches")
    shingles = docs.select("doc_id", F.explode(_hashes(F.col("text"), short_lengths(items))).alias("hash"))
    return (
        shingles.join(_small(sketch, sketch.count()), "hash")
        .groupBy("doc_id", "item_id", "least")
        .agg(F.count_distinct("hash").alias("held"))
        .filter("held >= least")
        .select("doc_id", "item_id")
    )


def containments(docs: DataFrame, items: DataFrame, percent: int = THRESHOLD_PERCENT) -> DataFrame:
    """``doc_id, item_id, n_shared, n_item`` of all pairs with ``100 * n_shared >= percent * n_item``."""
    pairs = stored(candidates(docs, items, percent), "candidates")
    ids = pairs.select(F.col("doc_id").alias("hit")).distinct()
    suspects = docs.select("doc_id", "text").join(
        _small(ids, pairs.count()), F.col("doc_id").eqNullSafe(F.col("hit")), "left_semi"
    )
    own = suspects.select("doc_id", _strings(F.col("text"), short_lengths(items)).alias("own"))
    theirs = items.select(F.col("item_id").alias("item"), _strings(F.col("text")).alias("theirs"))
    item_bytes = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    wanted = pairs.withColumnRenamed("doc_id", "hit").join(
        F.broadcast(theirs) if item_bytes <= BROADCAST_BYTES else theirs, F.col("item_id").eqNullSafe(F.col("item"))
    )
    return (
        wanted.join(own, F.col("doc_id").eqNullSafe(F.col("hit")))
        .select(
            "doc_id",
            "item_id",
            F.size(F.array_intersect("own", "theirs")).cast("long").alias("n_shared"),
            F.size("theirs").cast("long").alias("n_item"),
        )
        .groupBy("doc_id", "item_id", "n_item")
        .agg(F.max("n_shared").alias("n_shared"))
        .filter(F.col("n_shared") * 100 >= F.col("n_item") * percent)
        .select("doc_id", "item_id", "n_shared", "n_item")
    )


def clean(docs: DataFrame, items: DataFrame, percent: int = THRESHOLD_PERCENT) -> DataFrame:
    """The rows of ``docs`` whose document no item contaminates."""
    hit = f"hit_{uuid.uuid4().hex}"  # no column of the documents has this name
    hits = stored(containments(docs, items, percent).select(F.col("doc_id").alias(hit)).distinct(), "contaminated")
    return docs.join(_small(hits, hits.count()), F.col("doc_id").eqNullSafe(F.col(hit)), "left_anti")
