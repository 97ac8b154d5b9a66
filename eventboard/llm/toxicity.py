"""Toxicity by class-conditional Kneser-Ney models over bytes with shared backoff counts.

A text is read as a stream of bytes: A-Z in lower case, every run of blanks one blank. Each class (toxic, ordinary) has
an interpolated Kneser-Ney model of order ``ORDER``: raw counts at the top, continuation counts (how many different
bytes come before a gram) below. The lowest ``SHARED`` orders are continuation counts of the whole corpus and the same
for both classes, so expressions that neither class has seen are smoothed alike and say nothing, while a rare form of a
known expression still meets its stem. A text's evidence is the difference of its two log-likelihoods, normalised by its
length (per byte, and per square root of bytes); a logistic curve over both, fitted on rows that the models were not
counted on, turns it into a score between 0 and 1.

The class models are fitted on at most ``MAX_LABELLED`` toxic documents and ``BALANCE`` times as many ordinary ones as
there are toxic ones (a class that has seen far more text knows every expression better), the curve on at most
``MAX_LABELLED`` of either class as they come; always the first by hash. The models hold every gram of those documents,
however rare. The shared counts cover every document. Labels are learnt only from rows whose ``crc32`` of the id, modulo 4, is not 2: 0 and 1 are counted, 3 fits the curve.

Defined results: a NULL or empty text has no evidence and gets the curve's value there. A NULL ``doc_id`` is scored like
any other, never labelled and not held out. Repeated rows are counted and returned as often as they come; a document
with several labels is toxic if one of them says so. Without labelled documents of both classes every score is 0;
without rows of both to fit the curve on, a fixed curve is taken. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventboard.llm.arrays import U64, Block, blocks, mix, table
from eventboard.llm.scratch import arrow_map, stored

ORDER, SHARED = 5, 2
#: Toxic documents that the model is fitted on, at most, and ordinary ones for each of them.
MAX_LABELLED, BALANCE = 20_000, 2
THRESHOLD = 0.3
#: Intercept, weight per byte and weight per square root of bytes where no rows tell them.
FIXED_CURVE = (-3.0, 0.0, 1.0)
HELD_OUT, FITS_CURVE = 2, 3

SCORES = "doc_id long, held_out boolean, score double, predicted int, evidence double, n_bytes long"
_SCORES = pa.schema(
    [("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())]
    + [("evidence", pa.float64()), ("n_bytes", pa.int64())]
)
_COUNTS = pa.schema([("gram", pa.int64()), ("toxic", pa.int64()), ("ordinary", pa.int64())])

_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[65:91] += 32
_PLAIN[_BLANK] = 0x20
PAD = ORDER - 1


@dataclass
class Stream:
    """The bytes of a block's texts, each after ``PAD`` zeros and a blank and before a blank; ``at`` tells where."""

    data: np.ndarray
    at: np.ndarray
    #: Marks bytes that are predicted: all but the zeros and the first blank.
    told: np.ndarray

    def grams(self) -> np.ndarray:
        """The last ``ORDER`` bytes up to every byte, packed; lower orders are its lower bytes."""
        out = np.zeros(len(self.data), dtype=U64)
        for k in range(ORDER):
            out[PAD:] |= self.data[PAD - k : len(self.data) - k].astype(U64) << U64(8 * k)
        return out


def stream(block: Block) -> Stream:
    n = len(block)
    head = PAD + 1
    size = np.diff(block.at) + head + 1
    at = np.concatenate([[0], np.cumsum(size)])
    data = np.full(at[-1], 0x20, dtype=np.uint8)
    body = np.arange(len(block.data)) + np.repeat(at[:-1] + head - block.at[:-1], np.diff(block.at))
    data[body] = _PLAIN[block.data]
    zeros = (at[:-1, None] + np.arange(PAD)).ravel()
    data[zeros] = 0
    blank = data == 0x20
    kept = np.ones(len(data), dtype=bool)
    kept[1:] = ~(blank[1:] & blank[:-1])
    upto = np.concatenate([[0], np.cumsum(kept)])
    at = upto[at]
    told = np.ones(at[-1], dtype=bool)
    told[(at[:-1, None] + np.arange(head)).ravel()] = False
    return Stream(data[kept], at, told) if n else Stream(data, at, told)


def labelled(labels: DataFrame) -> DataFrame:
    """``doc_id, toxic, fold`` of the labelled documents to learn from: ``(2 + BALANCE) * MAX_LABELLED`` at most."""
    fold = (F.crc32(F.col("doc_id").cast("string")) % 4).cast("int")
    known = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic"))
    known = known.withColumn("fold", fold)

    def first(rows: DataFrame, number: int) -> DataFrame:
        return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(number)

    counted = known.filter(~F.col("fold").isin(HELD_OUT, FITS_CURVE))
    toxic = first(counted.filter("toxic"), MAX_LABELLED)
    ordinary = first(counted.filter("NOT toxic"), BALANCE * toxic.count())
    return toxic.union(ordinary).union(first(known.filter(F.col("fold") == FITS_CURVE), MAX_LABELLED))


class _Tally:
    """Counts of packed grams, kept as sorted arrays."""

    LIMIT = 1 << 20

    def __init__(self):
        self.keys, self.counts, self.waiting, self.size = np.zeros(0, U64), np.zeros((0, 2), np.int64), [], 0

    def add(self, grams: np.ndarray, column: int) -> None:
        keys, n = np.unique(grams, return_counts=True)
        counts = np.zeros((len(keys), 2), dtype=np.int64)
        counts[:, column] = n
        self.waiting.append((keys, counts))
        self.size += len(keys)
        if self.size > self.LIMIT:
            self.settle()

    def settle(self) -> None:
        keys = np.concatenate([self.keys, *(k for k, _ in self.waiting)])
        counts = np.concatenate([self.counts, *(c for _, c in self.waiting)])
        self.keys, place = np.unique(keys, return_inverse=True)
        self.counts = np.stack([np.bincount(place, counts[:, c], minlength=len(self.keys)) for c in (0, 1)], axis=1).astype(np.int64)
        self.waiting, self.size = [], 0


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Top-order counts of each class (``gram`` from 0), and the kinds of grams one above the shared ones (-1 - gram)."""
    kinds = np.zeros(1 << 8 * (SHARED + 1), dtype=bool)
    tally = _Tally()
    for batch in batches:
        toxic = batch.column("toxic").to_numpy(zero_copy_only=False)
        fold = batch.column("fold").to_numpy(zero_copy_only=False)
        for block in blocks(batch.column("text")):
            s = stream(block)
            grams = s.grams()
            kinds[(grams[s.told] & U64(len(kinds) - 1)).astype(np.int64)] = True
            for k in range(len(block)):
                row = block.rows.start + k
                if toxic[row] is not None and fold[row] != FITS_CURVE:
                    part = slice(s.at[k], s.at[k + 1])
                    tally.add(grams[part][s.told[part]], 0 if toxic[row] else 1)
    tally.settle()
    seen = -1 - np.flatnonzero(kinds)
    whole = np.concatenate([tally.keys.astype(np.int64), seen])
    counts = np.concatenate([tally.counts, np.zeros((len(seen), 2), dtype=np.int64)])
    for k in range(0, len(whole), 1 << 17):
        yield table(_COUNTS, [whole[k : k + (1 << 17)], counts[k : k + (1 << 17), 0], counts[k : k + (1 << 17), 1]])


class Slots:
    """Open addressing from packed grams to rows 1, 2, ...; 0 for a gram that is not there."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(2 * len(keys) + 1).bit_length())
        self.keys = np.zeros(1 << self.bits, dtype=U64)
        self.rows = np.zeros(1 << self.bits, dtype=np.int32)
        todo, place = np.arange(len(keys)), self._home(keys)
        while len(todo):
            # Of those that want a free place, the last one written has it.
            free = self.rows[place] == 0
            self.rows[place[free]] = todo[free] + 1
            won = self.rows[place] == todo + 1
            self.keys[place[won]] = keys[todo[won]]
            todo, place = todo[~won], (place[~won] + 1) & (len(self.rows) - 1)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return (mix(keys) >> U64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        place = self._home(keys)
        out = self.rows[place]
        open_ = np.flatnonzero((out != 0) & (self.keys[place] != keys))
        place = place[open_]
        while len(open_):
            place = (place + 1) & (len(self.rows) - 1)
            out[open_] = self.rows[place]
            other = (self.rows[place] != 0) & (self.keys[place] != keys[open_])
            open_, place = open_[other], place[other]
        return out


def _discount(counts: np.ndarray) -> float:
    once, twice = (counts == 1).sum(), (counts == 2).sum()
    return float(np.clip(once / (once + 2 * twice), 0.1, 0.95)) if once else 0.5


def _parts(grams: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Discounted shares of the grams; their contexts, and what each context leaves to the order below."""
    context, place = np.unique(grams >> U64(8), return_inverse=True)
    d, total, kinds = _discount(counts), np.bincount(place, counts), np.bincount(place)
    return np.maximum(counts - d, 0) / total[place], context, d * kinds / total


class Model:
    """Both classes' models as lookup tables; column 0 is toxic, column 1 ordinary."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray, shared: np.ndarray):
        """``shared``: kinds of bytes before each gram of ``SHARED`` bytes, over the whole corpus."""
        self.base = _shared_probabilities(shared)
        #: Of the orders above the shared ones: slots of their grams, shares, and what is left after them as context.
        self.slots, self.share, self.left = {}, {}, {}
        share, left, keys = {}, {}, {k: [] for k in range(SHARED, ORDER + 1)}
        for c in (0, 1):
            own = counts[:, c] > 0
            g, n = grams[own], counts[own, c]
            for k in range(ORDER, SHARED, -1):
                share[k, c], context, rest = _parts(g, n)
                left[k - 1, c] = (context, rest)
                share[k, c] = (g, share[k, c])
                keys[k].append(g)
                keys[k - 1].append(context)
                g, n = np.unique(g & U64((1 << 8 * (k - 1)) - 1), return_counts=True)
        for k in range(SHARED, ORDER + 1):
            known = np.unique(np.concatenate(keys[k]))
            self.slots[k] = Slots(known)
            self.share[k], self.left[k] = np.zeros((len(known) + 1, 2), np.float32), np.ones((len(known) + 1, 2), np.float32)
            for c in (0, 1):
                for to, of in ((self.share[k], share.get((k, c))), (self.left[k], left.get((k, c)))):
                    if of is not None:
                        to[self.slots[k].find(of[0]), c] = of[1]

    def ratios(self, s: Stream) -> np.ndarray:
        """Log-likelihood ratio of every byte of a stream, 0 where none is predicted."""
        grams = s.grams()
        lower = grams & U64((1 << 8 * SHARED) - 1)
        p = np.repeat(self.base[lower.astype(np.int64)].astype(np.float32)[:, None], 2, axis=1)
        context = self._context(SHARED, lower)
        for k in range(SHARED + 1, ORDER + 1):
            slot = self.slots[k].find(grams & U64((1 << 8 * k) - 1))
            p = self.share[k][slot] + context * p
            if k < ORDER:
                context = _before(self.left[k][slot])
        logs = np.log(p)
        return np.where(s.told, logs[:, 0] - logs[:, 1], 0).astype(np.float64)

    def _context(self, k: int, grams: np.ndarray) -> np.ndarray:
        return _before(self.left[k][self.slots[k].find(grams)])


def _before(values: np.ndarray) -> np.ndarray:
    """Each byte's values at the byte before it."""
    out = np.ones_like(values)
    out[1:] = values[:-1]
    return out


def _shared_probabilities(kinds: np.ndarray) -> np.ndarray:
    """Kneser-Ney probability of the last byte of every gram of ``SHARED`` bytes, given those before."""
    low = np.full(256, 1 / 256)
    for k in range(1, SHARED + 1):
        # Kinds of bytes before a gram; for the orders below, from the grams that occur at all.
        n = kinds if k == SHARED else (kinds > 0).reshape(-1, 1 << 8 * k).sum(axis=0)
        n = n.reshape(-1, 256).astype(float)
        total, d = n.sum(axis=1, keepdims=True), _discount(n[n > 0])
        below = np.tile(low, (len(n) * 256 // len(low), 1)).reshape(len(n), 256) if k > 1 else low[None]
        rest = d * (n > 0).sum(axis=1, keepdims=True)
        low = np.where(total > 0, (np.maximum(n - d, 0) + rest * below) / np.maximum(total, 1), below).ravel()
    return low


def evidence(block: Block, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Log-likelihood ratio and number of predicted bytes of each text."""
    s = stream(block)
    upto = np.concatenate([[0], np.cumsum(model.ratios(s))])
    told = np.concatenate([[0], np.cumsum(s.told)])
    return upto[s.at[1:]] - upto[s.at[:-1]], told[s.at[1:]] - told[s.at[:-1]]


def _features(ratio: np.ndarray, n: np.ndarray) -> np.ndarray:
    size = np.maximum(n, 1)
    return np.column_stack([np.ones(len(n)), ratio / size, ratio / np.sqrt(size)])


def fit_curve(ratio: np.ndarray, n: np.ndarray, toxic: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Logistic weights of the two length-normalised ratios, by Newton steps."""
    if not 0 < toxic.sum() < len(toxic):
        return np.array(FIXED_CURVE)
    x = _features(ratio, n)
    scale = np.concatenate([[1.0], np.maximum(x[:, 1:].std(axis=0), 1e-9)])
    x, w, keep = x / scale, np.zeros(3), np.diag([1e-3, ridge, ridge])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + keep, x.T @ (toxic - p) - keep @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w / scale


def _marked(docs: DataFrame, labels: DataFrame) -> DataFrame:
    ids = F.broadcast(labelled(labels))  # a bounded number of rows
    return docs.select("doc_id", "text").join(ids, "doc_id", "left")


def fit(docs: DataFrame, labels: DataFrame) -> Model | None:
    """Both class models; None without labelled documents of both classes."""
    marked = _marked(docs, labels).select("text", "toxic", "fold")
    counts = stored(
        arrow_map(marked, _count, "gram long, toxic long, ordinary long")
        .groupBy("gram")
        .agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary")),
        "gram-counts",
    )
    kinds = counts.filter("gram < 0").select((F.lit(-1) - F.col("gram")).alias("gram"))
    before = kinds.groupBy(F.expr(f"gram & {(1 << 8 * SHARED) - 1}").alias("gram")).agg(F.count(F.lit(1)).alias("n")).toPandas()
    shared = np.zeros(1 << 8 * SHARED, dtype=np.int64)
    shared[before["gram"]] = before["n"]  # a row per gram of SHARED bytes at most
    top = counts.filter("gram >= 0")
    rows = top.select("gram", "toxic", "ordinary").toPandas().sort_values("gram")
    both = rows[["toxic", "ordinary"]].to_numpy(dtype=np.int64).reshape(-1, 2)
    if not both.any(axis=0).all():
        return None
    return Model(rows["gram"].to_numpy(dtype=np.int64).astype(U64), both, shared)


def score(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``SCORES`` of every document."""
    model = fit(docs, labels)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == HELD_OUT, F.lit(False)).alias("held_out")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out, "text")
    if model is None:
        none = [F.lit(v).cast(t).alias(n) for n, v, t in (("score", 0, "double"), ("predicted", 0, "int"), ("evidence", 0, "double"), ("n_bytes", 0, "long"))]
        return texts.select("doc_id", "held_out", *none)
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def measured(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        parts = [evidence(b, shipped.value) for b in blocks(batch.column("text"))]
        return tuple(map(np.concatenate, zip(*parts, strict=True)))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("ratio", pa.float64()), ("n", pa.int64()), ("toxic", pa.bool_())])
        for batch in batches:
            if batch.num_rows:
                yield table(schema, [*measured(batch), batch.column("toxic")])

    fits = _marked(docs, labels).filter(F.col("fold") == FITS_CURVE).select("text", "toxic")
    rows = arrow_map(fits, measure, "ratio double, n long, toxic boolean").toPandas()  # labelled ones, a bounded number
    curve = fit_curve(rows["ratio"].to_numpy(float), rows["n"].to_numpy(float), rows["toxic"].to_numpy(float))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ratio, n = measured(batch)
                p = 1 / (1 + np.exp(-np.clip(_features(ratio, n) @ curve, -700, 700)))
                held = batch.column("held_out")
                yield table(_SCORES, [batch.column("doc_id"), held, p, (p >= threshold).astype(np.int32), ratio, n])

    return arrow_map(texts, run, SCORES)
