"""Quality rules: repetition counts and a hashed n-gram log-likelihood ratio against a trusted target.

Two multinomials over hashed word unigrams and bigrams are estimated: the raw corpus from every document, the
target from trusted ones. A document's score is the mean over its n-grams of ``log p(target) - log p(raw)``;
every document whose score falls under one fixed threshold is rejected, whatever else is in the corpus.

Rare buckets carry little evidence, so ``PRIOR`` pseudo-observations split in the corpus' own proportion are
added to each of them before the ratio is taken.

Defined results: a NULL or empty text has no words, counts of zero and score 0 (it fails the base rules). A
NULL ``doc_id`` is scored like any other. Repeated rows are counted and returned as often as they come. Without
any trusted document, every score is 0. Other columns of the input are ignored by ``score`` and handed on
untouched by ``keep``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventboard.llm.arrays import U64, Block, blocks, owners, prefix_hash, substring_hash, table, windows, words
from eventboard.llm.scratch import arrow_map
from eventboard.operators.bloom import bloom_filter, may_contain

BUCKET_BITS = 18
NGRAMS = (1, 2)
PRIOR = 50.0
MIN_SCORE = -0.1
MIN_WORDS = 50

SCORES = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, score double"
)
_SCORES = pa.schema(
    [("doc_id", pa.int64())]
    + [(n, pa.int64()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [("base_failed", pa.bool_()), ("kept", pa.bool_()), ("score", pa.float64())]
)

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_WORD_CHAR = np.ones(256, dtype=bool)
_WORD_CHAR[[0x20, *range(0x09, 0x0E), *range(0x80, 0xC0)]] = False


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids of all documents labelled good and not toxic."""
    return labels.filter("quality = 1 AND toxic = 0 AND doc_id IS NOT NULL").select("doc_id").distinct()


def _buckets(hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and row of every n-gram."""
    grams = [windows(hashes, at, n) for n in NGRAMS]
    return (
        np.concatenate([h >> U64(64 - BUCKET_BITS) for h, _ in grams]).astype(np.int64),
        np.concatenate([owners(a) for _, a in grams]),
    )


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << BUCKET_BITS, dtype=np.int64)
    for batch in batches:
        for block in blocks(batch.column("text")):
            w = words(block)
            bucket, _ = _buckets(substring_hash(prefix_hash(block.data), w.start, w.end), w.at)
            total += np.bincount(bucket, minlength=len(total))
    seen = np.flatnonzero(total)
    yield table(pa.schema([("bucket", pa.int64()), ("n", pa.int64())]), [seen, total[seen]])


def trusted_texts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, text`` of the rows of ``docs`` whose document is trusted.

    A Bloom filter of bounded size, asked where the rows lie, leaves out the other texts before the exact join, so only
    trusted texts (and 0.3 % of the others) are moved. The join is the same for few ids and for many.
    """
    ids = trusted_ids(labels)
    key = docs.select("doc_id").union(ids).schema["doc_id"].dataType  # one type, or equal ids would differ in their hashes
    ids = ids.withColumn("doc_id", F.col("doc_id").cast(key))
    texts = docs.select(F.col("doc_id").cast(key).alias("doc_id"), "text")
    # Each id once, so an inner join keeps rows as they are; a semi-join would be pushed below the filter, to all texts.
    return may_contain(texts, bloom_filter(ids, ["doc_id"])).join(ids.hint("shuffle_hash"), "doc_id")


def log_ratios(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """``log p(target) - log p(raw)`` of each of the fixed number of buckets, counted over all documents."""
    raw, trusted = (arrow_map(d.select("text"), _count, "bucket long, n long") for d in (docs, trusted_texts(docs, labels)))
    none = F.lit(0).cast("long")
    counts = (
        raw.select("bucket", F.col("n").alias("raw"), none.alias("trusted"))
        .union(trusted.select("bucket", none, "n"))
        .groupBy("bucket")
        .agg(F.sum("raw").alias("raw"), F.sum("trusted").alias("trusted"))
        .toPandas()  # a row per bucket, 2**BUCKET_BITS at most
    )
    raw, trusted = (np.zeros(1 << BUCKET_BITS) for _ in range(2))
    raw[counts["bucket"]], trusted[counts["bucket"]] = counts["raw"], counts["trusted"]
    if not trusted.sum():
        return np.zeros(len(raw))
    share = trusted.sum() / raw.sum()
    return np.log((trusted + PRIOR * share) / (share * (raw + PRIOR)))


def _repeated(key: np.ndarray, row: np.ndarray, first_too: bool) -> np.ndarray:
    """Marks items whose key occurs before in the same row, or anywhere in it if ``first_too``."""
    order = np.lexsort((key, row)) if len(row) and not first_too else np.argsort(key ^ row.astype(U64) * U64(0x9E3779B97F4A7C15))
    same = (key[order][1:] == key[order][:-1]) & (row[order][1:] == row[order][:-1])
    out = np.zeros(len(key), dtype=bool)
    out[order[1:]] = same
    if first_too:
        out[order[:-1]] |= same
    return out


def measure(block: Block, ratios: np.ndarray, min_score: float) -> list[np.ndarray]:
    """The columns of ``SCORES`` after doc_id, for the texts of one block."""
    n = len(block)
    w = words(block)
    hashes = substring_hash(prefix := prefix_hash(block.data), w.start, w.end)

    def per_row(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags)])
        return total[block.at[1:]] - total[block.at[:-1]]

    breaks = np.flatnonzero(block.data == 10)
    start = np.sort(np.concatenate([block.at[:-1], breaks + 1]), kind="stable")
    # A line ends at its break, or where the next text begins.
    line_row = np.sort(np.concatenate([np.arange(n), np.searchsorted(block.at, breaks, "right") - 1]), kind="stable")
    end = np.append(start[1:], len(block.data))
    last = np.append(line_row[1:] != line_row[:-1], True)
    end = np.where(last, block.at[line_row + 1], end - 1) if n else end
    wordy = np.searchsorted(w.start, end) > np.searchsorted(w.start, start)
    line_hash = substring_hash(prefix, start[wordy], end[wordy])
    dup_lines = np.bincount(line_row[wordy][_repeated(line_hash, line_row[wordy], False)], minlength=n)

    triple, triple_at = windows(hashes, w.at, 3)
    row = owners(triple_at)
    again = np.flatnonzero(_repeated(triple, row, True))
    covered = np.zeros(len(w.start) + 2, dtype=bool)
    place = again - triple_at[row[again]] + w.at[row[again]]
    for k in range(3):
        covered[place + k] = True
    repeat_words = np.bincount(owners(w.at)[covered[: len(w.start)]], minlength=n)

    bucket, row = _buckets(hashes, w.at)
    grams = np.maximum(np.bincount(row, minlength=n), 1)
    score = np.bincount(row, ratios[bucket], minlength=n) / grams
    failed = (w.counts < MIN_WORDS) | (100 * repeat_words > 50 * w.counts)
    return [
        w.counts,
        per_row(_WORD_CHAR[block.data]),
        per_row(_SYMBOL[block.data]),
        dup_lines,
        repeat_words,
        failed,
        ~failed & (score >= min_score),
        score,
    ]


def _measured(batch: pa.RecordBatch, ratios: np.ndarray, min_score: float) -> list[np.ndarray]:
    parts = [measure(b, ratios, min_score) for b in blocks(batch.column("text"))]
    return [np.concatenate(x) for x in zip(*parts, strict=True)]


def score(docs: DataFrame, labels: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """Counts, score and verdict of every document: ``SCORES``."""
    ratios = docs.sparkSession.sparkContext.broadcast(log_ratios(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield table(_SCORES, [batch.column("doc_id").cast(pa.int64()), *_measured(batch, ratios.value, min_score)])

    return arrow_map(docs.select("doc_id", "text"), run, SCORES)


def keep(docs: DataFrame, labels: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns."""
    ratios = docs.sparkSession.sparkContext.broadcast(log_ratios(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(_measured(batch, ratios.value, min_score)[6]))

    return arrow_map(docs, run, docs.schema)
