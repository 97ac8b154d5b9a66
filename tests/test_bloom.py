"""The Bloom filter table: never loses a key, rarely keeps another, moves no asked row."""

from eventboard.operators import bloom


def test_every_key_is_found_and_few_others(spark):
    keys = spark.range(0, 40_000).selectExpr("id * 7 AS k", "cast(id % 5 AS string) AS s")
    made = bloom.bloom_filter(keys, ["k", "s"])
    assert made.buckets == 20 and made.table.count() == 20
    assert bloom.may_contain(keys, made).count() == 40_000
    others = keys.selectExpr("k + 1 AS x", "s AS y", "'body' AS body")
    kept = bloom.may_contain(others, made, ["x", "y"])
    assert kept.columns == others.columns and kept.count() < 400
    assert "hashpartitioning(x" not in kept._jdf.queryExecution().executedPlan().toString()


def test_no_keys_and_null_keys(spark):
    keys = spark.createDataFrame([(None,), (3,)], "k long")
    made = bloom.bloom_filter(keys, ["k"])
    assert {r.k for r in bloom.may_contain(keys, made).collect()} == {None, 3}
    empty = bloom.bloom_filter(keys.limit(0), ["k"])
    assert bloom.may_contain(keys, empty).count() == 0


def test_size_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(bloom, "MAX_BUCKETS", 2)
    keys = spark.range(30_000).selectExpr("id AS k")
    made = bloom.bloom_filter(keys, ["k"])
    assert made.buckets == 2 and bloom.may_contain(keys, made).count() == 30_000


def test_rows_are_either_possible_or_lacking(spark):
    made = bloom.bloom_filter(spark.range(0, 9_000, 3).selectExpr("id AS k"), ["k"])
    asked = spark.range(9_000).selectExpr("nullif(id, 5) AS x", "'body' AS body")
    kept, others = (f(asked, made, ["x"]) for f in (bloom.may_contain, bloom.lacks))
    assert sorted((r.x or -1 for r in kept.union(others).collect())) == sorted((r.x or -1 for r in asked.collect()))
    assert others.columns == asked.columns and others.count() > 5_900 and others.filter("x % 3 = 0").count() == 0
    empty = bloom.bloom_filter(spark.range(0).selectExpr("id AS k"), ["k"])
    assert bloom.lacks(asked, empty, ["x"]).count() == 9_000
    assert "hashpartitioning(x" not in others._jdf.queryExecution().executedPlan().toString()
