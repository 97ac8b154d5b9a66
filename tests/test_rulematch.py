"""Many rules at once against each rule tested on each row."""

import random

from eventboard.functions.predicates import matches_any
from eventboard.operators import rulematch as rm
from pyspark.sql import functions as F


def test_ten_thousand_rules_equal_matches_any(spark, sf_dir):
    rng = random.Random(7)
    texts = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.substring("html", 1, 600).alias("text"))
    texts = texts.union(spark.createDataFrame([(-1, None), (-2, ""), (-3, "ab"), (-4, "Ünïcode TEXT, Red Dead 2")], "page_id long, text string"))
    some = " ".join(r.text or "" for r in texts.collect())
    rules = []
    for k in range(10_000):
        n = rng.choice([1, 2, 3, 5, 9, 14])
        at = rng.randrange(len(some) - 20)
        rules.append((k, [some[at : at + n].upper() if k % 3 else "zzq" + str(k), *([""] if k % 7 == 0 else [])]))
    rules += [(10_000, ["red dead", "x" * 700]), (10_001, []), (10_002, None)]
    table = spark.createDataFrame(rules, "rule_id long, keywords array<string>")
    got = rm.match_keywords(texts, table, ["page_id"])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    clean = table.withColumn("keywords", F.filter("keywords", lambda w: w != ""))
    want = texts.crossJoin(clean).filter(matches_any(F.col("text"), F.col("keywords"))).select("page_id", "rule_id")
    assert got.exceptAll(want).count() == 0 and got.count() == want.count() > 10_000
    assert rm.match_keywords(texts, table.limit(0), ["page_id"]).count() == 0


def test_longest_prefix_wins_and_the_rest_has_a_reason(spark, tmp_path):
    rules = spark.createDataFrame(
        [(1, "https://a.example", None), (2, "http://A.example/news/", None), (3, "a.example/news", "browser"), (4, "https://b.example/x", "browser"), (5, None, None)],
        "rule_id long, url_prefix string, fetch_mode string",
    )
    loads = [
        (1, "https://a.example/", None, "http", 1, None), (2, "https://a.example/news?page=2", None, "http", 2, None),
        (3, "https://a.example/news/7/", None, "browser", 3, None), (4, "https://a.example/newsroom", None, "http", 1, None),
        (5, "https://b.example/x", None, "http", None, "other mode"), (6, "https://c.example/", None, "http", None, "no rule for the url"),
        (7, None, None, "http", None, "no url"), (8, "https://c.example/", "https://a.example/news/9", None, 2, None),
        (9, " https://a.example#top ", "", "http", 1, None), (10, "https://ab.example/", None, "http", None, "no rule for the url"),
    ]
    df = spark.createDataFrame([r[:4] + ("a body",) for r in loads], "snapshot_id long, requested_url string, final_url string, fetch_mode string, body string")
    got = rm.bind_by_prefix(df, rules, ["snapshot_id"])
    assert {(r.snapshot_id, r.rule_id, r.reason) for r in got.collect()} == {(r[0], r[4], r[5]) for r in loads}
    df.write.parquet(str(tmp_path / "loads"))
    stored = rm.bind_by_prefix(spark.read.parquet(str(tmp_path / "loads")), rules, ["snapshot_id"])
    scans = [line for line in stored._jdf.queryExecution().executedPlan().toString().split("\n") if "ReadSchema" in line]
    assert scans and not any("body" in line.split("ReadSchema")[1] for line in scans)


def _joined_rows(df):
    """Rows that the joins of an executed plan made."""
    df.collect()

    def walk(node):
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            return walk(node.finalPhysicalPlan())
        inner = [node.plan()] if "QueryStage" in name else [node.children().apply(k) for k in range(node.children().size())]
        own = node.metrics().apply("numOutputRows").value() if "Join" in name else 0
        return own + sum(map(walk, inner))

    return walk(df._jdf.queryExecution().executedPlan())


def test_rules_of_one_prefix_meet_a_load_once_per_mode(spark):
    rules = spark.range(2_000).select(F.col("id").alias("rule_id"), F.lit("https://a.example/").alias("url_prefix"), F.when(F.col("id") % 2 == 1, "browser").alias("fetch_mode"))
    loads = spark.range(200).select(F.col("id").alias("snapshot_id"), F.concat(F.lit("https://a.example/"), "id").alias("requested_url"), F.lit(None).cast("string").alias("final_url"), F.when(F.col("id") % 2 == 1, "browser").otherwise("http").alias("fetch_mode"))
    got = rm.bind_by_prefix(loads, rules, ["snapshot_id"])
    assert _joined_rows(got) <= 200 * 4  # 200,000 and more, if every rule were met
    assert {(r.snapshot_id % 2, r.rule_id, r.reason) for r in got.collect()} == {(0, 0, None), (1, 1, None)}


def test_pages_meet_sets_of_keywords_not_rules(spark, tmp_path, monkeypatch):
    from eventboard.plans import rulequeries as rq

    html = "<html><body><a href='/x'>Red Dead</a><a href='/y'>dead red</a><a href='/z'>Other</a> Reddish</body></html>"
    spark.range(40).select(F.col("id").alias("page_id"), F.lit("https://a.example/").alias("url"), F.lit(html).alias("html")).write.parquet(f"{tmp_path}/pages.parquet")
    seen, match = [], rm.match_keywords
    monkeypatch.setattr(rm, "match_keywords", lambda texts, rules, keys: (seen.append(rules.count()), match(texts, rules, keys))[1])
    got = {r.page_id: r.n_rules for r in rq.rules_by_keyword(spark, str(tmp_path)).collect()}
    assert got == {k: 120 for k in range(40)} and seen == [2]


def test_keywords_with_and_without_spaces_meet_across_pieces(spark):
    texts = spark.createDataFrame([(1, "Patch notes"), (1, "Patch  NOTES, new"), (2, " "), (None, "es, n")], "k long, text string")
    words = spark.createDataFrame([("notes",), ("h n",), (" ",), ("  ",), ("s, n",), ("tes,",)], "word string")
    got = {(r.k, r.word) for r in rm.matched_words(texts, words, ["k"]).collect()}
    assert got == {(1, w) for w in ("notes", "h n", " ", "  ", "s, n", "tes,")} | {(2, " "), (None, " "), (None, "s, n")}
