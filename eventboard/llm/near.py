"""Near-duplicate groups: an LSH forest proposes pairs, full shingle sets confirm them.

Texts with equal shingle sets are one node. Every node has ``VALUES`` MinHash values, read in ``TREES`` orders (each
begins at another value and goes round). Nodes that agree on the first ``BASE`` values of an order form a region of
that order. A region of more than ``REGION`` nodes is read deeper, depth by depth of ``DEPTHS``, until no more than that
many agree; nodes that still agree on everything are dealt into chunks that share
their smallest node.

1. Within each such region the longest common prefixes lie next to each other; the pairs of a spanning tree of the most
   similar signatures are candidates. They are confirmed on full sets, and confirmed links are joined to components.
2. Components leave few open questions: all pairs of a base region that lie in different components, and whose
   signatures do not rule out the threshold, are compared on full sets too. Regions are read in tiles of two
   bounded blocks, the nodes outside the largest component against all; the pairs stay inside the task, which hands on
   links only.

So deeper reading only saves work; no pair that shares a base region is lost by it. Two texts at the threshold share none
of the 32 regions of depth 4 with probability 5.2e-6, and agree on too few values to be compared with probability 5e-7:
together a link at the threshold is lost with probability 5.7e-6 at most, one of more similar texts with less.

Defined results: a NULL or empty text, or one without words, has an empty set and is linked with nothing. Rows that
share a ``doc_id`` are one document; a row without one is linked with nothing, has component NULL and is kept. Repeated
rows are returned as often as they come. Other columns are ignored by ``groups``, kept by ``keep_one``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventboard.llm.arrays import U64, blocks, mix, table
from eventboard.llm.components import components
from eventboard.llm.scratch import arrow_map, stored
from eventboard.llm.shingles import VALUES, set_keys, shingle_sets, signatures

TREES, BASE = 32, 4
DEPTHS = (8, 16, 32, VALUES)
REGION = 24
#: Nodes of a region, and bytes of their shingle sets, in each of the two blocks that one task compares at once.
BLOCK = 2_048
BLOCK_BYTES = 32 << 20
THRESHOLD_PERCENT = 75
#: Pairs whose signatures agree on less than this are not compared: 5e-7 of the pairs at the threshold, a tenth of what
#: the regions lose.
LEAST_AGREEMENT = 0.55
BROADCAST_ROWS = 200_000

_SIGNED = pa.schema(
    [("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_key", pa.binary()), ("signature", pa.binary())]
)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts = []
        for block in blocks(batch.column("text")):
            values, at = shingle_sets(block)
            n = np.diff(at)
            key, sig = set_keys(values, at), signatures(values, at)
            parts.append((n, [k.tobytes() for k in key], [s.tobytes() if c else None for s, c in zip(sig, n, strict=True)]))
        if parts:
            yield table(
                _SIGNED,
                [
                    batch.column("doc_id").cast(pa.int64()),
                    np.concatenate([p[0] for p in parts]),
                    [k for p in parts for k in p[1]],
                    [s for p in parts for s in p[2]],
                ],
            )


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint32).reshape(len(column), VALUES)


def _prefix_key(sig: np.ndarray, tree: np.ndarray, depth: int) -> np.ndarray:
    """64-bit key of the first ``depth`` values of each row's order."""
    key = mix(tree.astype(U64) * U64(1_000_003) + U64(depth))
    for k in range(depth):
        place = (tree * BASE + k) % VALUES
        key = mix(key ^ sig[np.arange(len(sig)), place].astype(U64) + U64(k << 40))
    return key.view(np.int64)


_BRANCHES_DDL = "key long, node long, tree int"
_BRANCHES = pa.schema([("key", pa.int64()), ("node", pa.int64()), ("tree", pa.int32())])


def _branches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The base region of every node in every order."""
    for batch in batches:
        if batch.num_rows:
            sig, node = _matrix(batch.column("signature")), batch.column("node").to_numpy()
            for t in range(TREES):
                tree = np.full(len(node), t)
                yield table(_BRANCHES, [_prefix_key(sig, tree, BASE), node, tree.astype(np.int32)])


def _at_depth(depth: int) -> Callable:
    """Regions of one further depth."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                tree = batch.column("tree").to_numpy().astype(np.int64)
                key = _prefix_key(_matrix(batch.column("signature")), tree, depth)
                yield table(_BRANCHES, [key, batch.column("node"), batch.column("tree")])

    return run


def _by_key(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Whole groups of a stream sorted by ``keys``; a group may span batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        cut = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        cuts = [0, *cut.tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            here = tuple(c[a] for c in columns)
            if held and here != last:
                yield _joined(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = here
    if held:
        yield _joined(held)


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    """One batch with all rows; 64-bit offsets, since binary columns beyond 2 GiB would stay in several chunks."""
    if len(parts) == 1:
        return parts[0]
    wide = [f.with_type(pa.large_binary()) if pa.types.is_binary(f.type) else f for f in parts[0].schema]
    (whole,) = pa.Table.from_batches(parts).cast(pa.schema(wide)).combine_chunks().to_batches()
    return whole


_PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _pairs_out(pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Ordered pairs, a batch for many regions."""
    a, b, n = [], [], 0
    for x, y in pairs:
        a.append(np.minimum(x, y))
        b.append(np.maximum(x, y))
        n += len(x)
        if n > 50_000:
            yield table(_PAIRS, [np.concatenate(a), np.concatenate(b)])
            a, b, n = [], [], 0
    if n:
        yield table(_PAIRS, [np.concatenate(a), np.concatenate(b)])


def _spanning(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of a spanning tree of each region, the most similar signatures first."""

    def trees() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for group in _by_key(batches, ["key"]):
            if group.num_rows < 2:
                continue
            node, first = np.unique(group.column("node").to_numpy(), return_index=True)
            sig = _matrix(group.column("signature"))[first]
            best = (sig == sig[0]).sum(axis=1)
            near = np.zeros(len(node), dtype=np.int64)
            out = np.ones(len(node), dtype=bool)
            out[0] = False
            a, b = [], []
            while out.any():
                k = int(np.argmax(np.where(out, best, -1)))
                if best[k] >= LEAST_AGREEMENT * VALUES:
                    a.append(node[near[k]])
                    b.append(node[k])
                out[k] = False
                agree = (sig == sig[k]).sum(axis=1)
                closer = out & (agree > best)
                best[closer], near[closer] = agree[closer], k
            if a:
                yield np.array(a), np.array(b)

    yield from _pairs_out(trees())


def _open_pairs(group: pa.RecordBatch, sig: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Asking rows of a tile, each with the rows of other components that its signature does not rule out.

    A pair that shares base regions of several orders is looked at in the first of them only, and of two asking nodes the
    smaller one asks.
    """
    node, component = group.column("node").to_numpy(), group.column("component").to_numpy()
    asks = group.column("asks").to_numpy(zero_copy_only=False)
    asking = asks & (group.column("own_asking").to_numpy() == group.column("asking").to_numpy())
    asked = group.column("own_block").to_numpy() == group.column("block").to_numpy()
    tree = group.column("tree")[0].as_py()
    for k in np.flatnonzero(asking):
        other = np.flatnonzero(asked & (component != component[k]) & (~asks | (node > node[k])))
        equal = sig[other] == sig[k]
        close = equal.sum(axis=1) >= LEAST_AGREEMENT * VALUES
        other, equal = other[close], equal[close]
        first = equal[:, : TREES * BASE].reshape(len(other), TREES, BASE).all(axis=2).argmax(axis=1)
        yield int(k), other[first == tree]


_TILE = ["key", "asking", "block"]


def _involved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each tile that are in any open pair."""
    for group in _by_key(batches, _TILE):
        in_any = np.zeros(group.num_rows, dtype=bool)
        for k, partners in _open_pairs(group, _matrix(group.column("signature"))):
            in_any[partners] = True
            in_any[k] |= bool(partners.size)
        if in_any.any():
            yield group.drop_columns(["signature"]).filter(pa.array(in_any))


def _settle(percent: int) -> Callable:
    """Confirmed links of the open pairs of each tile, at most one for each two components."""

    def links(group: pa.RecordBatch) -> Iterator[tuple[int, int]]:
        sets = [np.frombuffer(v.as_buffer(), dtype=U64) for v in group.column("shingles")]
        node, name = group.column("node").to_numpy(), group.column("component").to_numpy().copy()
        for k, partners in _open_pairs(group, _matrix(group.column("signature"))):
            for j in partners:
                if name[j] != name[k] and _linked(sets[k], sets[j], percent):
                    name[name == name[j]] = name[k]
                    yield int(node[k]), int(node[j])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _by_key(batches, _TILE):
            found = list(links(group))
            if found:
                yield table(_PAIRS, map(list, zip(*found, strict=True)))

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("node", pa.int64()), ("shingles", pa.binary())])
    for batch in batches:
        for block in blocks(batch.column("text")):
            values, at = shingle_sets(block)
            packed = [values[at[k] : at[k + 1]].tobytes() for k in range(len(block))]
            yield table(schema, [batch.column("doc_id").cast(pa.int64())[block.rows], packed])


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets reach the threshold."""
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    shared = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * shared >= percent * (len(x) + len(y) - shared)


def _confirm(percent: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), dtype=U64) for v in (x, y))
                linked.append(_linked(x, y, percent))
            yield batch.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))

    return run


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    left = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a")
    full = left.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    return arrow_map(full.select("a", "b", "x", "y"), _confirm(percent), "a long, b long")


def _regions(branches: DataFrame, nodes: DataFrame) -> DataFrame:
    """``key, node`` of the regions to span: base regions, deeper ones where a region is overfull."""
    ready = branches.filter(F.col("n") <= REGION).select("key", "node")
    over = branches.filter(F.col("n") > REGION).withColumn("least", F.col("node"))
    for depth in DEPTHS:
        if over.isEmpty():
            return ready
        deep = stored(arrow_map(over.select("node", "tree").join(nodes, "node"), _at_depth(depth), _BRANCHES_DDL), "deep")
        sizes = deep.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("least")).filter("n > 1")
        placed = stored(deep.join(sizes, "key"), "placed")
        ready = ready.union(placed.filter(F.col("n") <= REGION).select("key", "node"))
        over = placed.filter(F.col("n") > REGION)
    # What still agrees on every value is dealt into chunks, each with the smallest node of all.
    chunk = F.xxhash64("key", F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / REGION)))
    shared = over.select(chunk.alias("key"), F.col("least").alias("node")).distinct()
    return ready.union(over.select(chunk.alias("key"), "node")).union(shared)


def _in_regions(rows: DataFrame, nodes: DataFrame, *keys: str) -> DataFrame:
    return rows.join(nodes, "node").repartition(*keys).sortWithinPartitions(*keys)


def _blocks(n: Column, size: Column) -> Column:
    return F.ceil(F.greatest(n / BLOCK, size / BLOCK_BYTES)).cast("int")


def _tiles(placed: DataFrame) -> DataFrame:
    """``placed`` (``key, tree, node, component, size``) dealt into tiles of each region: a block of asking nodes, those outside
    the largest component, against a block of all nodes. Every pair of two components lies in a tile."""
    per = placed.groupBy("key", "component").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    n, size, most = F.sum("n"), F.sum("size"), F.max(F.struct("n", "component", "size"))
    mixed = (
        per.groupBy("key")
        .agg(n.alias("n"), size.alias("size"), most.alias("most"), F.count("*").alias("kinds"))
        .filter("kinds > 1")
        .select(
            "key",
            F.col("most.component").alias("largest"),
            _blocks(F.col("n") - F.col("most.n"), F.col("size") - F.col("most.size")).alias("askings"),
            _blocks(F.col("n"), F.col("size")).alias("blocks"),
        )
    )
    dealt = placed.join(mixed, "key").select(
        "key",
        "tree",
        "node",
        "component",
        (F.col("component") != F.col("largest")).alias("asks"),
        *(F.pmod(F.xxhash64("node"), F.col(c)).cast("int").alias(own) for c, own in (("askings", "own_asking"), ("blocks", "own_block"))),
        "askings",
        "blocks",
    )
    tile = F.expr(
        """explode(array_distinct(concat(
             transform(sequence(0, askings - 1), i -> struct(i AS asking, own_block AS block)),
             transform(slice(sequence(0, blocks - 1), 1, IF(asks, blocks, 0)), i -> struct(own_asking AS asking, i AS block)))))"""
    )
    return dealt.withColumn("tile", tile).select(
        "key", "tile.asking", "tile.block", "tree", "node", "component", "asks", "own_asking", "own_block"
    )


def _across(branches: DataFrame, nodes: DataFrame, homes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between components, from all pairs that share a base region; ``homes`` has each node's component and bytes."""
    tiles = _tiles(branches.select("key", "tree", "node").join(homes, "node"))
    schema = "node long, key long, asking int, block int, tree int, component long, asks boolean, own_asking int, own_block int"
    involved = stored(arrow_map(_in_regions(tiles, nodes, *_TILE), _involved, schema), "open")
    whole = _in_regions(involved.join(sets, "node"), nodes, *_TILE)
    return arrow_map(whole, _settle(percent), "a long, b long")


def groups(docs: DataFrame, percent: int = THRESHOLD_PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every document."""
    signed = stored(arrow_map(docs.select("doc_id", "text"), _sign, "doc_id long, n_shingles long, set_key binary, signature binary"), "signed")
    some = signed.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = stored(
        some.groupBy("set_key").agg(
            F.min("doc_id").alias("node"), F.first("signature").alias("signature"), F.first("n_shingles").alias("n_shingles")
        ),
        "classes",
    )
    nodes = classes.select("node", "signature")
    base = stored(arrow_map(nodes, _branches, _BRANCHES_DDL), "branches")
    sizes = base.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    branches = stored(base.join(sizes, "key"), "regions")

    near = branches.select("node").distinct()
    ids = stored(near, "near")
    texts = docs.select("doc_id", "text").join(_small(ids.withColumnRenamed("node", "doc_id"), ids.count()), "doc_id", "left_semi")
    sets = stored(arrow_map(texts, _sets, "node long, shingles binary").dropDuplicates(["node"]), "sets")

    spanning = arrow_map(_in_regions(_regions(branches, nodes), nodes, "key"), _spanning, "a long, b long")
    first = stored(spanning.filter("a <> b").distinct(), "pairs")
    links = stored(_confirmed(first, sets, percent), "links")
    joined = stored(components(links), "components")

    sizes = classes.groupBy("node").agg((F.max("n_shingles") * 8).alias("size"))
    homes = sizes.join(ids, "node", "left_semi").join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    more = stored(_across(branches, nodes, homes, sets, percent), "more")
    final = stored(
        components(links.union(more).union(_same_document(signed, classes))), "final"
    )
    home = (
        signed.join(classes.select("set_key", "node"), "set_key", "left")
        .join(final, "node", "left")
        .withColumn("linked", F.col("n_shingles") > 0)
    )
    component = F.when(F.col("linked"), F.coalesce("component", "node")).otherwise(F.col("doc_id"))
    return home.select(
        "doc_id",
        "n_shingles",
        F.when(F.col("doc_id").isNotNull(), component).alias("component_id"),
        (F.col("doc_id").isNull() | (F.col("doc_id") == component)).alias("kept"),
    )


def _same_document(signed: DataFrame, classes: DataFrame) -> DataFrame:
    """Links between the classes of documents that have rows with different texts."""
    several = (
        signed.filter("n_shingles > 0 AND doc_id IS NOT NULL")
        .groupBy("doc_id")
        .agg(F.min("set_key").alias("low"), F.max("set_key").alias("high"))
        .filter("low <> high")
        .select("doc_id")
    )
    homes = signed.join(several, "doc_id", "left_semi").join(classes.select("set_key", "node"), "set_key")
    return homes.select(F.col("doc_id").alias("a"), F.col("node").alias("b")).distinct()


def keep_one(docs: DataFrame, percent: int = THRESHOLD_PERCENT) -> DataFrame:
    """The rows of ``docs`` whose document is the first of its group."""
    gone = stored(groups(docs, percent).filter("NOT kept").select("doc_id").distinct(), "dropped")
    return docs.join(_small(gone, gone.count()), "doc_id", "left_anti")
