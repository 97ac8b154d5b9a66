"""Hard negatives against all scores, written out."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from compare import compare, database
from eventboard.llm import gnat, queries

SCHEMA = "vec_id long, label int, vector array<double>, anchor boolean, vec string, leaf string"


def expected(rows, positives=5, negatives=5, percent=80):
    """Rows are (id, label, vector, anchor); equal ones count once."""
    usable = {
        (i, label, tuple(math.floor(256 * x) for x in v), bool(anchor))
        for i, label, v, anchor in rows
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    }
    out = Counter()
    for anchor, own, q in sorted({r[:3] for r in usable if r[3]}):
        scored = [(-sum(a * b for a, b in zip(q, v, strict=False)), i, label) for i, label, v in {r[:3] for r in usable}]
        for s, p in sorted((s, i) for s, i, label in scored if label == own and i != anchor)[:positives]:
            fits = sorted((t, i) for t, i, label in scored if label != own and percent * -s <= 100 * -t <= 100 * -s)
            for rank, (t, i) in enumerate(fits[:negatives], 1):
                out[anchor, p, rank, i, -s, -t] += 1
    return out


def mined(spark, rows, **options):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(3)
    return Counter(tuple(r) for r in gnat.mine(df, **options).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def vectors(seed, n, dim=3, step=8):
    rng = random.Random(seed)
    return [(i, rng.randrange(4), [rng.randrange(-step, step + 1) / step for _ in range(dim)], i % 9 == 0) for i in range(n)]


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    odd = [
        (None, 1, [1.0, 1.0, 1.0], True), (9_001, None, [1.0, 1.0, 1.0], True), (9_002, 1, None, True), (9_003, 1, [1.0, None, 1.0], True),
        (9_004, 1, [nan, 1.0, 1.0], True), (9_005, 1, [inf, 1.0, 1.0], True), (9_006, 1, [1e308, 1.0, 1.0], True), (9_007, 1, [], True),
        (9_008, 1, [0.5], None), (9_009, 2, [0.0, 0.0, 0.0], True),
    ]
    rows = vectors(1, 150) + odd
    rows += [(20_000 + k, 3, [0.25, 0.5, 0.75], k % 2 == 0) for k in range(40)] + rows[:20]  # copies, and rows told twice
    want = expected([r for r in rows if r[0] != 9_006])
    assert mined(spark, rows) == want and want


@pytest.mark.parametrize("seed", [2, 3])
def test_small_blocks_tiles_and_leaves(spark, monkeypatch, seed):
    for name, value in (("BLOCK", 7), ("TILE", 3), ("LEAF_POINTS", 4), ("ARITY", 3), ("SAMPLE", 60), ("SCORED", 2)):
        monkeypatch.setattr(gnat, name, value)
    rows = vectors(seed, 260, dim=2)
    assert mined(spark, rows, positives=3, negatives=4, least_percent=55) == expected(rows, 3, 4, 55)


def test_few_rows(spark):
    assert gnat.mine(spark.createDataFrame([], SCHEMA)).count() == 0
    assert not mined(spark, [(0, 1, [1.0], True)])
    rows = [(0, 1, [1.0], True), (1, 1, [0.5], False), (2, 2, [0.45], False), (3, 2, [0.6], False), (4, 2, [0.41], False), (5, 2, [0.4], False)]
    assert mined(spark, rows) == expected(rows) == Counter({(0, 1, 1, 2, 32768, 29440): 1, (0, 1, 2, 4, 32768, 26624): 1})


def test_large_components(spark):
    rows = [(i, i % 2, [float(2**22 + i), 1.0 - i], i % 5 == 0) for i in range(40)]
    assert mined(spark, rows) == expected(rows)


def test_leaves_left_out_hold_no_hit():
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(12, 6)) * 60
    rows = np.floor(centres[rng.integers(0, 12, 3_000)] + rng.normal(size=(3_000, 6)) * 6)
    tree = gnat.Tree(6, float((rows * rows).sum(axis=1).max()))
    tree.grow(tree.lifted(rows[:800]))
    seen = [np.stack([np.full((len(p), len(p)), v) for v in (np.inf, -np.inf)], axis=2) for p in tree.points]

    def told(node, far, child):
        for k in np.unique(child):
            seen[node][:, k, 0] = np.minimum(seen[node][:, k, 0], far[child == k].min(axis=0))
            seen[node][:, k, 1] = np.maximum(seen[node][:, k, 1], far[child == k].max(axis=0))

    leaf = tree.descend(tree.lifted(rows), told)
    tree.ranges = seen
    asked = rows[:200]
    scores = asked @ rows.T
    high = np.sort(scores, axis=1)[:, -6:-5]
    low = np.ceil(0.9 * high)
    at, to = tree.feasible(np.column_stack([asked, np.zeros(200)]), low, high)
    kept = set(zip(at.tolist(), to.tolist(), strict=True))
    hits = np.argwhere((scores >= low) & (scores <= high))
    assert all((q, leaf[r]) in kept for q, r in hits)
    assert len(kept) < 0.6 * 200 * len(np.unique(leaf))  # and a good part of the tree is left out


def test_query_equals_sql(spark, sf_dir):
    n, differences = compare(spark, database(sf_dir), queries.op12_hard_negatives, queries.ORACLES["op12_hard_negatives"], sf_dir)
    assert n and not differences
