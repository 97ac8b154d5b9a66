"""Hard negatives by exact search in a multiway hyperplane tree with distance ranges (GNAT).

A sample chooses split points, farthest first, and every row of the table goes down to the child of its nearest split
point. For each split point and each child of the same parent the tree keeps the smallest and the largest distance of
any row below that child, over all rows. A search asks for scores in a window; on the sphere that follows, a window of
scores is an annulus of distances, and a child whose range from any one split point misses the annulus is left out. All
rows of the leaves that remain are compared exactly.

Scores are integer inner products of components ``floor(256 * x)``. Rows get one more coordinate, so that all have the
longest row's length ``M``: then ``|q - x|^2 = |q|^2 + M^2 - 2 <q, x>``, and distances order rows as scores do.

Rows that are equal in label and components are one node with their smallest ids, as many as a result can need, so a
vector with very many copies is one node, and anchors that are equal are searched for once. Searches go leaf by leaf:
a leaf's nodes are dealt into blocks and its queries into tiles, and a task compares one block with one tile.

1. Positives: the query's own leaf gives a lower bound for its best scores of the same label, then every leaf that may
   hold a better one is searched.
2. Negatives: for each positive's score, the own leaf narrows the window of different labels, then every leaf that may
   hold a score in what is left of it.

Defined results: rows without an id, a label or a vector, or with a NULL or non-finite component (after scaling, too)
take no part. Shorter vectors are continued with zeros. Repeated rows count once; rows that share an id but differ are
rows of their own, and none is a positive or negative of an anchor with its id. Scores beyond 2**53 are computed in
whole numbers; those beyond a long are cut to its range. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from eventboard.llm.scratch import arrow_map, ship, stored

SCALE = 256.0
#: Distinct vectors that choose the split points, at most, the first by hash; every row is indexed, whatever their number.
SAMPLE = 4_096
#: Split points of an inner node, sample points below which a node is a leaf, and the tree's height.
ARITY, LEAF_POINTS, HEIGHT = 8, 24, 12
#: Nodes of a block and queries of a tile, the two sides that one task compares.
BLOCK, TILE = 4_096, 4_096
#: Queries whose scores are in memory at once.
SCORED = 256
#: Distances are in floating point, off by some 2e-7 of the longest length where two rows nearly meet; ranges and annuli
#: are widened by this share of it, so no row is lost.
WIDEN = 1e-6
EXACT = 2.0**53
LONG = np.iinfo(np.int64)

ENCODED = "vec_id long, label long, vec binary, length2 double, anchor boolean"
_ENCODED = pa.schema(
    [("vec_id", pa.int64()), ("label", pa.int64()), ("vec", pa.binary()), ("length2", pa.float64()), ("anchor", pa.bool_())]
)
HITS = "query long, upto long, hits array<struct<score:long,vec_id:long>>"
_HITS = pa.schema(
    [
        ("query", pa.int64()),
        ("upto", pa.int64()),
        ("hits", pa.list_(pa.struct([("score", pa.int64()), ("vec_id", pa.int64())]))),
    ]
)


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.float64).reshape(-1, dim)


def encode(vectors: DataFrame, dim: int) -> DataFrame:
    """``ENCODED``: whole-number components of the rows that take part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("vector")
            n = lists.value_lengths().to_numpy(zero_copy_only=False)
            out = np.zeros((batch.num_rows, dim))
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            out[np.repeat(np.arange(len(n)), n), at] = np.floor(SCALE * lists.flatten().to_numpy(zero_copy_only=False))
            length2 = (out * out).sum(axis=1)
            whole = pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id"),
                    batch.column("label"),
                    pa.array([r.tobytes() for r in out], pa.binary()),
                    pa.array(length2),
                    batch.column("anchor"),
                ],
                schema=_ENCODED,
            )
            yield whole.filter(pa.array(np.isfinite(length2)))

    return arrow_map(vectors, run, ENCODED)


@dataclass
class Tree:
    """Inner nodes: split points (with the extra coordinate) and children, ``-1 - leaf`` for a leaf."""

    dim: int
    radius2: float
    points: list[np.ndarray] = field(default_factory=list)
    children: list[list[int]] = field(default_factory=list)
    leaves: int = 0
    #: Per inner node, ``[split point, child, (least, most)]`` over all rows.
    ranges: list[np.ndarray] = field(default_factory=list)

    def lifted(self, rows: np.ndarray) -> np.ndarray:
        """Rows with the coordinate that makes all equally long."""
        rest = np.sqrt(np.maximum(self.radius2 - (rows * rows).sum(axis=1), 0))
        return np.column_stack([rows, rest])

    def distances(self, rows: np.ndarray, node: int) -> np.ndarray:
        p = self.points[node]
        square = (rows * rows).sum(axis=1)[:, None] + (p * p).sum(axis=1)[None] - 2 * rows @ p.T
        return np.sqrt(np.maximum(square, 0))

    def grow(self, sample: np.ndarray) -> None:
        """Split points from a sample of lifted rows."""
        self._grow(sample, HEIGHT)

    def _grow(self, rows: np.ndarray, height: int) -> int:
        chosen = _farthest_first(rows, ARITY) if len(rows) > LEAF_POINTS and height else []
        if len(chosen) < 2:
            self.leaves += 1
            return -self.leaves
        node = len(self.points)
        self.points.append(rows[chosen])
        self.children.append([])
        nearest = self.distances(rows, node).argmin(axis=1)
        below = [self._grow(rows[nearest == k], height - 1) for k in range(len(chosen))]
        self.children[node] = below
        return node

    def descend(self, rows: np.ndarray, told=None) -> np.ndarray:
        """The leaf of each lifted row; ``told(node, distances, child)`` hears of every step."""
        leaf = np.zeros(len(rows), dtype=np.int32)
        todo = [(0, np.arange(len(rows)))] if self.points else []
        while todo:
            node, at = todo.pop()
            far = self.distances(rows[at], node)
            child = far.argmin(axis=1)
            if told:
                told(node, far, child)
            for k, to in enumerate(self.children[node]):
                part = at[child == k]
                if to < 0:
                    leaf[part] = -to - 1
                elif len(part):
                    todo.append((to, part))
        return leaf

    def feasible(self, queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, leaf) that may hold a score in any of a query's windows; NaN bounds are no window.

        ``queries`` have a last coordinate of zero.
        """
        if not len(queries) or not self.points:
            return np.arange(len(queries)), np.zeros(len(queries), dtype=np.int64)
        base = ((queries * queries).sum(axis=1) + self.radius2)[:, None]
        room = WIDEN * np.sqrt(base + 1)
        with np.errstate(invalid="ignore"):
            most = np.sqrt(np.maximum(base - 2 * low, 0)) + room
            least = np.sqrt(np.maximum(base - 2 * high, 0)) - room
        most[np.isnan(low)] = -np.inf
        found, todo = [], [(0, np.arange(len(queries)))]
        while todo:
            node, at = todo.pop()
            far = self.distances(queries[at], node)
            for k, to in enumerate(self.children[node]):
                near, edge = self.ranges[node][:, k, 0], self.ranges[node][:, k, 1]
                if near[0] > edge[0]:
                    continue  # no row is below this child
                # The nearest and the farthest that any row below the child can be, as seen from each split point.
                nearest = np.maximum(np.maximum(near - far, far - edge) - room[at], 0).max(axis=1)
                farthest = (far + edge + room[at]).min(axis=1)
                alive = ((nearest[:, None] <= most[at]) & (farthest[:, None] >= least[at]) & (most[at] >= 0)).any(axis=1)
                part = at[alive]
                if to < 0:
                    found.append((part, np.full(len(part), -to - 1)))
                elif len(part):
                    todo.append((to, part))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return tuple(map(np.concatenate, zip(*found, strict=True)))


def _farthest_first(rows: np.ndarray, count: int) -> list[int]:
    """Up to ``count`` different rows, each as far as possible from those before."""
    chosen, gap = [0], np.full(len(rows), np.inf)
    while len(chosen) < min(count, len(rows)):
        gap = np.minimum(gap, ((rows - rows[chosen[-1]]) ** 2).sum(axis=1))
        far = int(gap.argmax())
        if gap[far] <= 0:
            break
        chosen.append(far)
    return chosen


def nodes_of(rows: DataFrame, ids: int) -> DataFrame:
    """``label, vec, ids``: each different row once, with its smallest ids in order."""
    same = W.partitionBy("label", "vec").orderBy("vec_id")
    first = rows.select("label", "vec", "vec_id").distinct().withColumn("k", F.row_number().over(same)).filter(F.col("k") <= ids)
    return first.groupBy("label", "vec").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))


def grown(nodes: DataFrame, dim: int, radius2: float) -> Tree:
    """A tree whose split points come from a bounded sample of the nodes, without ranges."""
    tree = Tree(dim, radius2)
    sample = nodes.select("vec", F.xxhash64("vec").alias("h")).orderBy("h", "vec").limit(SAMPLE).select("vec").collect()
    rows = np.array([np.frombuffer(r.vec, dtype=np.float64) for r in sample]).reshape(-1, dim)
    tree.grow(tree.lifted(np.unique(rows, axis=0)))
    return tree


def indexed(nodes: DataFrame, tree: Tree) -> DataFrame:
    """``nodes`` with the leaf that each belongs to."""
    schema = pa.schema([("label", pa.int64()), ("vec", pa.binary()), ("ids", pa.list_(pa.int64())), ("leaf", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = tree.descend(tree.lifted(_matrix(batch.column("vec"), tree.dim)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("label", "vec", "ids")), pa.array(leaf)], schema=schema)

    return arrow_map(nodes.select("label", "vec", "ids"), run, "label long, vec binary, ids array<long>, leaf int")


def measure_ranges(index: DataFrame, tree: Tree) -> None:
    """Sets ``tree.ranges`` from all rows; a task hands on one row per split point and child."""
    schema = pa.schema([("node", pa.int32()), ("point", pa.int32()), ("child", pa.int32()), ("least", pa.float64()), ("most", pa.float64())])

    def empty() -> list[np.ndarray]:
        return [np.stack([np.full((len(p), len(p)), v) for v in (np.inf, -np.inf)], axis=2) for p in tree.points]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = empty()

        def told(node: int, far: np.ndarray, child: np.ndarray) -> None:
            for k in np.unique(child):
                part = far[child == k]
                seen[node][:, k, 0] = np.minimum(seen[node][:, k, 0], part.min(axis=0))
                seen[node][:, k, 1] = np.maximum(seen[node][:, k, 1], part.max(axis=0))

        for batch in batches:
            tree.descend(tree.lifted(_matrix(batch.column("vec"), tree.dim)), told)
        rows = [(v, *np.argwhere(r[:, :, 0] <= r[:, :, 1]).T, r) for v, r in enumerate(seen)]
        for v, point, child, r in rows:
            if len(point):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(point), v), pa.int32()), pa.array(point, pa.int32()), pa.array(child, pa.int32())]
                    + [pa.array(r[point, child, e]) for e in (0, 1)],
                    schema=schema,
                )

    all_ranges = (
        arrow_map(index.select("vec"), run, "node int, point int, child int, least double, most double")
        .groupBy("node", "point", "child")
        .agg(F.min("least").alias("least"), F.max("most").alias("most"))
        .collect()  # at most ARITY rows per split point of the sample
    )
    tree.ranges = empty()
    for r in all_ranges:
        tree.ranges[r.node][r.point, r.child] = r.least, r.most


def _scores(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers."""
    bound = np.abs(queries).sum(axis=1).max(initial=0) * np.abs(rows).max(initial=0)
    if bound < EXACT:
        return (queries @ rows.T).astype(np.int64)
    exact = np.array([[int(v) for v in r] for r in queries], dtype=object) @ np.array([[int(v) for v in r] for r in rows], dtype=object).T
    return np.clip(exact, LONG.min, LONG.max).astype(np.int64)


def _best(rows: pa.Table, queries: pa.Table, dim: int, same_label: bool, count: int) -> pa.Table:
    """The best ``count`` ids of a block in each window of a tile's queries."""
    ids = rows["ids"].to_pylist()
    order = np.argsort([i[0] for i in ids], kind="stable")  # equal scores: smaller ids first
    ids = [ids[k] for k in order]
    vectors, labels = _matrix(rows["vec"], dim)[order], rows["label"].to_numpy()[order]
    asked, own = _matrix(queries["vec"], dim), queries["label"].to_numpy()
    number, low, high = queries["query"].to_pylist(), queries["low"].to_pylist(), queries["high"].to_pylist()
    out: tuple[list, list, list] = ([], [], [])
    for start in range(0, len(asked), SCORED):
        scores = _scores(asked[start : start + SCORED], vectors)
        for k, row in enumerate(scores, start):
            fits = (labels == own[k]) if same_label else (labels != own[k])
            for least, upto in zip(low[k], high[k], strict=True):
                at = np.flatnonzero(fits & (row >= least) & (row <= upto))
                if len(at) > count:
                    at = at[row[at] >= np.partition(row[at], len(at) - count)[len(at) - count]]
                at = at[np.argsort(-row[at], kind="stable")][:count]
                hits = sorted((-int(row[i]), v) for i in at for v in ids[i])[:count]
                if hits:
                    out[0].append(number[k])
                    out[1].append(upto)
                    out[2].append([{"score": -s, "vec_id": v} for s, v in hits])
    return pa.table([pa.array(c, f.type) for c, f in zip(out, _HITS, strict=True)], schema=_HITS)


def compare(index: DataFrame, asked: DataFrame, tree: Tree, same_label: bool, count: int) -> DataFrame:
    """``HITS`` of queries in leaves (``query, label, vec, low, high, leaf``), block by tile."""
    ship(index.sparkSession)
    # A row per leaf each: bounded by the sample.
    nodes = index.groupBy("leaf").agg(F.count(F.lit(1)).alias("nodes"))
    wanted = asked.groupBy("leaf").agg(F.count(F.lit(1)).alias("queries"))
    deal = F.broadcast(
        nodes.join(wanted, "leaf").select(
            "leaf", F.ceil(F.col("nodes") / BLOCK).alias("blocks"), F.ceil(F.col("queries") / TILE).alias("tiles")
        )
    )

    def numbers(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(n).cast("int") - 1))

    rows = index.join(deal, "leaf").withColumn("block", F.pmod(F.xxhash64("vec", "label"), "blocks")).withColumn("tile", numbers("tiles"))
    dealt = asked.join(deal, "leaf").withColumn("tile", F.pmod(F.xxhash64("query"), "tiles")).withColumn("block", numbers("blocks"))
    left = rows.select("leaf", F.col("block").cast("int").alias("block"), "tile", "label", "vec", "ids")
    right = dealt.select(
        F.col("leaf").alias("q_leaf"), F.col("block").alias("q_block"), F.col("tile").cast("int").alias("q_tile"),
        F.col("label").alias("label"), F.col("vec").alias("vec"), "query", "low", "high",
    )
    dim = tree.dim
    return (
        left.groupBy("leaf", "block", "tile")
        .cogroup(right.groupBy("q_leaf", "q_block", "q_tile"))
        .applyInArrow(lambda a, b: _best(a, b, dim, same_label, count), HITS)
    )


def merged(hits: DataFrame, count: int) -> DataFrame:
    """The best ``count`` of each query and window over all blocks, in order."""
    line = W.partitionBy("query", "upto").orderBy(F.desc("score"), "vec_id")
    each = hits.select("query", "upto", F.explode("hits").alias("h")).select("query", "upto", "h.*")
    best = each.withColumn("k", F.row_number().over(line)).filter(F.col("k") <= count)
    listed = F.sort_array(F.collect_list(F.struct("k", "score", "vec_id")))
    return best.groupBy("query", "upto").agg(F.transform(listed, lambda h: h.dropFields("k")).alias("hits"))


def _own_leaf(queries: DataFrame, tree: Tree) -> DataFrame:
    """Queries with the leaf they lie in themselves."""
    schema = queries.withColumn("leaf", F.lit(0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = tree.descend(tree.lifted(_matrix(batch.column("vec"), tree.dim)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf)], names=[*batch.schema.names, "leaf"])

    return arrow_map(queries, run, schema)


def _other_leaves(queries: DataFrame, tree: Tree) -> DataFrame:
    """Queries (with their own ``leaf``) once for every other leaf that may hold a score in one of their windows."""

    def windows(column: pa.Array) -> np.ndarray:
        lists = column.to_pylist()
        out = np.full((len(lists), max(map(len, lists), default=0)), np.nan)
        for k, values in enumerate(lists):
            out[k, : len(values)] = values
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = _matrix(batch.column("vec"), tree.dim)
            flat = np.column_stack([vectors, np.zeros(len(vectors))])
            at, leaf = tree.feasible(flat, windows(batch.column("low")), windows(batch.column("high")))
            new = leaf != batch.column("leaf").to_numpy()[at]
            at, leaf = at[new], leaf[new]
            for k in range(0, len(at), 1_000):
                part = batch.drop_columns(["leaf"]).take(pa.array(at[k : k + 1_000]))
                yield part.append_column("leaf", pa.array(leaf[k : k + 1_000], pa.int32()))

    order = [c for c in queries.columns if c != "leaf"]
    return arrow_map(queries.select(*order, "leaf"), run, queries.select(*order, "leaf").schema)


def _windowed(queries: DataFrame, low: Column, high: Column) -> DataFrame:
    return queries.withColumn("low", low.cast("array<long>")).withColumn("high", high.cast("array<long>"))


def search(index: DataFrame, queries: DataFrame, tree: Tree, same_label: bool, count: int) -> DataFrame:
    """The best ``count`` hits in every window (``low`` to ``high``) of ``query, label, vec, low, high, leaf``.

    The own leaf comes first; the worst of a full list narrows its window for all other leaves.
    """
    here = stored(compare(index, queries, tree, same_label, count), "gnat-own-leaf")
    full = merged(here, count).filter(F.size("hits") >= count)
    full = full.select("query", F.struct("upto", F.element_at("hits", -1)["score"].alias("worst")).alias("w"))
    bound = full.groupBy("query").agg(F.collect_list("w").alias("w"))  # as many as a query has windows
    met = queries.join(bound, "query", "left")
    known = F.transform(
        F.arrays_zip("low", "high"),
        lambda z: F.greatest(z["low"], F.get(F.filter("w", lambda w: w["upto"] == z["high"]), 0)["worst"]),
    )
    narrowed = met.withColumn("low", known).drop("w").select(*queries.columns)
    there = compare(index, stored(_other_leaves(narrowed, tree), "gnat-leaves"), tree, same_label, count)
    return merged(here.unionByName(there), count)


def _least(score: Column, percent: int) -> Column:
    """``ceil(score * percent / 100)`` of a score of zero or more, in whole numbers that cannot overflow."""
    rest, off = score % 100, 100 - percent
    hundreds = F.call_function("div", score, F.lit(100).cast("long"))
    return score - hundreds * off - F.call_function("div", rest * off, F.lit(100).cast("long"))


def mine(vectors: DataFrame, positives: int = 5, negatives: int = 5, least_percent: int = 80) -> DataFrame:
    """Hard negatives of ``vec_id, label, vector, anchor``: a row per anchor, positive and negative.

    An anchor's positives are its best rows of the same label; each positive's negatives are the best rows of other
    labels that score no more than the positive and at least ``least_percent`` of it.
    """
    number = T.DoubleType()
    usable = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.col("label").cast("long").alias("label"),
        F.col("vector").cast(T.ArrayType(number)).alias("vector"),
        F.coalesce("anchor", F.lit(False)).alias("anchor"),
    ).filter(
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull()
        & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    )
    dim = max(1, usable.agg(F.max(F.size("vector"))).first()[0] or 0)
    rows = stored(encode(usable, dim), "gnat-rows")
    radius2 = rows.agg(F.max("length2")).first()[0] or 0.0
    nodes = stored(nodes_of(rows, max(positives + 1, negatives)), "gnat-nodes")
    tree = grown(nodes, dim, radius2)
    index = stored(indexed(nodes, tree), "gnat-index")
    measure_ranges(index, tree)

    anchors = rows.filter("anchor").select("vec_id", "label", "vec").distinct()
    # Two different rows may share an id, so a query is numbered by its hash.
    anchors = anchors.withColumn("query", F.xxhash64("label", "vec"))
    queries = stored(_own_leaf(anchors.select("query", "label", "vec").distinct(), tree), "gnat-queries")
    every = _windowed(queries, F.array(F.lit(int(LONG.min))), F.array(F.lit(int(LONG.max))))
    columns = ["query", "label", "vec", "low", "high", "leaf"]
    same = stored(search(index, every.select(columns), tree, True, positives + 1), "gnat-positives")

    scores = F.filter(F.array_distinct(F.transform("hits", lambda h: h["score"])), lambda s: s >= 0)
    asked = queries.join(same.select("query", scores.alias("scores")), "query").filter(F.size("scores") > 0)
    windows = _windowed(asked, F.transform("scores", lambda s: _least(s, least_percent)), F.col("scores"))
    other = stored(search(index, windows.select(columns), tree, False, negatives), "gnat-negatives")

    of_anchor = anchors.select(F.col("vec_id").alias("anchor_id"), "query").join(same.select("query", "hits"), "query")
    first = F.slice(F.filter("hits", lambda h: h["vec_id"] != F.col("anchor_id")), 1, positives)
    pairs = of_anchor.select("query", "anchor_id", F.explode(first).alias("p")).select(
        "query", "anchor_id", F.col("p.vec_id").alias("positive_id"), F.col("p.score").alias("positive_score")
    )
    found = pairs.join(other.withColumnRenamed("upto", "positive_score"), ["query", "positive_score"])
    return found.select("anchor_id", "positive_id", "positive_score", F.posexplode("hits").alias("at", "n")).select(
        "anchor_id", "positive_id", (F.col("at") + 1).alias("rank"), F.col("n.vec_id").alias("negative_id"),
        "positive_score", F.col("n.score").alias("negative_score"),
    )
