"""Substrings, near duplicates, contamination, secrets, urls and the pipeline against brute force on small rows."""

import hashlib
import random
import re
from collections import Counter
from datetime import date

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
from compare import compare, database
from eventboard.llm import arrays, contamination, near, queries, secrets, shingles, substrings, suffixes, urls
from pyspark.sql import functions as F

LENGTH = substrings.LENGTH


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, sf_dir, name):
    rows, differences = compare(spark, database(sf_dir), queries.QUERIES[name], queries.ORACLES[name], sf_dir)
    assert rows and not differences


def test_suffix_array_and_common_prefixes():
    rnd = random.Random(0)
    for trial in range(60):
        n = rnd.randint(1, 300)
        data = bytes(rnd.choice(b"ab") for _ in range(n)) if trial % 3 else (b"abcab" * 100)[:n]
        eight = suffixes.packed(np.frombuffer(data, np.uint8), 28)
        order = suffixes.suffix_array(eight, n)
        assert [data[i:] for i in order] == sorted(data[i:] for i in range(n))
        shared = suffixes.common_prefixes(eight, order, 20)
        padded = data + bytes(60)
        for a, b in zip(order, order[1:]):
            k = next((k for k in range(20) if padded[a + k] != padded[b + k]), 20)
            assert shared[b] == k


def brute_substrings(texts):
    seen = Counter(hash(t[i : i + LENGTH]) for t in texts for i in range(len(t) - LENGTH + 1))
    for t in texts:
        covered = np.zeros(len(t) + 1, int)
        for i in range(len(t) - LENGTH + 1):
            if seen[hash(t[i : i + LENGTH])] > 1:
                covered[i] += 1
                covered[i + LENGTH] -= 1
        gone = np.cumsum(covered)[: len(t)] > 0
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        yield len(t), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~gone])).hexdigest(), int((~gone).sum())


@pytest.mark.parametrize("kinds", [4_096, 4])
def test_substrings(spark, monkeypatch, kinds):
    monkeypatch.setattr(substrings, "KINDS", kinds)
    rnd = random.Random(3)
    base = "".join(rnd.choice("abcdé ") for _ in range(3_000))
    rows = [(1, base[:900]), (2, "x" + base[100:700] + "y"), (3, base[600:1400] + base[:450]), (4, "a" * 1500), (5, "b" * 401), (6, "c" * 400)]
    rows += [(7, None), (8, ""), (None, base[:900]), (9, base[:900]), (9, "z" * 50 + base[1000:1500]), (10, "ab" * 600)]
    rows += [(11, base[2000:2399] + "q"), (12, "q" + base[2000:2399]), (13, base[1500:2300] + "\0" * 500)]
    rows += [(100 + i, base[i * 3 : i * 3 + 420 + i]) for i in range(40)]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, n_bytes int").repartition(3)
    want = Counter(zip([r[0] for r in rows], brute_substrings([(t or "").encode() for _, t in rows]), strict=True))
    got = Counter((r.doc_id, tuple(r)[1:]) for r in substrings.removed(docs).collect())
    assert got == want
    assert substrings.removed(docs.limit(0)).count() == 0


def brute_passages(texts, size):
    found = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    holders = Counter()
    for w in found:
        holders.update({tuple(w[i : i + size]) for i in range(len(w) - size + 1)})
    for w in found:
        yield len({j for i in range(len(w) - size + 1) if holders[tuple(w[i : i + size])] > 1 for j in range(i, i + size)})


def test_passages_of_over_50_words_below_400_bytes(spark):
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 6)))
    own = lambda n: " ".join(word() for _ in range(n))
    short, fifty, long = own(55), own(50), own(300)
    assert len(short.encode()) < LENGTH
    copy, twice = own(80), own(60)
    texts = [f"{own(40)}\n{short} {own(30)}", f"{own(7)} {short.replace(' ', chr(9))}", f"{own(90)} {short}", short]
    texts += [f"{own(30)} {fifty} {own(30)}", f"{own(20)} {fifty}", None, "", own(10), own(500), copy, copy, f"{twice} {own(9)} {twice}"]
    texts += [long, f"{own(20)} {long[200:900]} {own(5)} {short}", f"{long[500:]} {own(70)}", own(51), "a " * 130, "b a " + "a " * 60]
    docs = spark.createDataFrame([(k % 9 or None, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    want = Counter(zip([(t or "") for t in texts], brute_passages(texts, 51), strict=True))
    digest = lambda t: hashlib.md5(t.encode()).digest()
    got = {bytes(r.uid): r.n_passage_words for r in substrings.repeated_passages(docs, 51).collect()}
    assert got == {digest(t): n for t, n in want if n}
    rows = substrings.removed(docs, 51).collect()
    assert Counter(r.n_passage_words for r in rows) == Counter(brute_passages(texts, 51))
    assert Counter(tuple(r)[:-1] for r in rows) == Counter(tuple(r) for r in substrings.removed(docs).collect())
    assert substrings.removed(docs.limit(0), 51).count() == 0


def test_passages_of_small_windows(spark):
    rnd = random.Random(11)
    pieces = [" ".join(rnd.choice("abcd") for _ in range(rnd.randint(1, 14))) for _ in range(9)]
    texts = [" ".join(rnd.choice([*pieces, rnd.choice("abcdefgh")]) for _ in range(rnd.randint(0, 12))) for _ in range(160)]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    want = {hashlib.md5(t.encode()).digest(): n for t, n in zip(texts, brute_passages(texts, 6), strict=True) if n}
    got = {bytes(r.uid): r.n_passage_words for r in substrings.repeated_passages(docs, 6).collect()}
    assert got == want


def test_windows_of_equal_stretches_are_compared_once(spark, monkeypatch):
    rnd = random.Random(13)
    own = lambda n: " ".join(f"{rnd.getrandbits(40):x}" for _ in range(n))
    common, tables = own(400), {}
    texts = [f"{own(20)} {common} {own(20)}" for _ in range(40)]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    monkeypatch.setattr(substrings, "stored", lambda df, name, f=substrings.stored: tables.setdefault(name, f(df, name)))
    got = [r.n_passage_words for r in substrings.repeated_passages(docs, 51).collect()]
    assert got == [400] * 40
    # 350 windows of each text are shared; those of stretches that all texts have are settled without their digests.
    compared = tables["passage_compared"].selectExpr("sum(size(digests)) AS n").first().n or 0
    assert compared < 40 * 350 / 3


def test_texts_without_repeats_are_not_shuffled(spark):
    rnd = random.Random(17)
    own = lambda n: " ".join(f"{rnd.getrandbits(40):x}" for _ in range(n))
    twice = own(90)
    rows = [(k, own(90)) for k in range(60)] + [(60, f"{own(60)} {twice}"), (61, f"{twice} {own(60)}"), (62, None), (63, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    key = "spark.sql.autoBroadcastJoinThreshold"
    spark.conf.set(key, -1)
    try:
        out = substrings.removed(docs, 51)
        got = Counter((r.doc_id, tuple(r)[1:-1], r.n_passage_words) for r in out.collect())
        plan = out._jdf.queryExecution().optimizedPlan()
        assert plan.nodeName() == "Union"
        alone = plan.children().apply(1)
        shuffles = spark._jsparkSession.sessionState().executePlan(alone, out._jdf.queryExecution().mode()).executedPlan().toString()
        assert "MapInArrow" in shuffles and "hashpartitioning(uid" not in shuffles and "SortMergeJoin" not in shuffles
    finally:
        spark.conf.unset(key)
    texts = [t or "" for _, t in rows]
    brute = zip(brute_substrings([t.encode() for t in texts]), brute_passages(texts, 51), strict=True)
    assert got == Counter((k, b, n) for (k, _), (b, n) in zip(rows, brute, strict=True))


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[i : i + 5]) for i in range(len(w) - 4)])


def test_near_duplicates(spark, monkeypatch):
    monkeypatch.setattr(near, "BLOCK", 60)
    rnd = random.Random(1)
    vocabulary = ["".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(3_000)]
    base = [rnd.choice(vocabulary) for _ in range(200)]
    rows = []
    for i in range(250):
        w = list(base)
        for _ in range(rnd.choice([0, 1, 2, 4, 6, 8, 10, 12])):
            w[rnd.randrange(200)] = rnd.choice(vocabulary)
        rows.append((i, " ".join(w)))
    rows += [(1000, None), (1001, ""), (1002, "a b"), (1003, "A  b\n"), (None, rows[0][1]), (1004, " ".join(base))]
    rows += [(1004, "q w e r t y u"), (1005, "q w e r t y u"), (1004, " ".join(base))]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    sets = [(i, shingle_set(t)) for i, t in rows]
    for k, (a, x) in enumerate(sets):
        for b, y in sets[:k]:
            if None not in (a, b) and x and y and find(a) != find(b):
                shared = len(x & y)
                if 100 * shared >= 75 * (len(x) + len(y) - shared):
                    parent[max(find(a), find(b))] = min(find(a), find(b))
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, kept int").repartition(5)
    want = Counter((a, len(x), a if a is None or not x else find(a)) for a, x in sets)
    got = near.groups(docs).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == want
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in got)
    assert near.keep_one(docs).columns == docs.columns
    assert near.groups(docs.limit(0)).count() == 0


def test_near_duplicates_with_unlike_signatures(spark):
    """Pairs at the threshold that share a base region, but agree on few values of the signature."""
    rnd = random.Random(6)
    texts = []
    for _ in range(12_000):
        w = [str(rnd.randrange(10**9)) for _ in range(74)]
        texts += [" ".join(w), " ".join(w[:14] + ["x"] + w[15:44] + ["y"] + w[45:])]
    sig = []
    for block in arrays.blocks(pa.array(texts)):
        sig.append(shingles.signatures(*shingles.shingle_sets(block)))
    sig = np.concatenate(sig)
    equal = sig[::2] == sig[1::2]
    together = equal.reshape(len(equal), near.TREES, near.BASE).all(axis=2).any(axis=1)
    agree = equal.sum(axis=1)
    hard = np.flatnonzero(together & (agree < 80) & (agree >= 71))
    assert hard.size
    x, y = (shingle_set(texts[2 * hard[0] + k]) for k in (0, 1))
    assert 4 * len(x & y) >= 3 * len(x | y)
    rows = [(int(2 * h + k), texts[2 * h + k]) for h in hard for k in (0, 1)]
    got = {r.doc_id: r.component_id for r in near.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: d - d % 2 for d, _ in rows}


def test_region_tiles_are_bounded_and_whole(spark, monkeypatch):
    """One region of many small components: no tile holds more than two blocks, and each pair lies in one tile."""
    monkeypatch.setattr(near, "BLOCK", 50)
    rows = [(7, 3, k, k // 2 if k < 400 else 999, 80) for k in range(600)] + [(8, 0, k, 5, 80) for k in range(3)]
    tiles = {}
    for r in near._tiles(spark.createDataFrame(rows, "key long, tree int, node long, component long, size long")).collect():
        tiles.setdefault((r.key, r.asking, r.block), []).append(r)
    assert max(map(len, tiles.values())) < 2 * 50 * 1.6
    pairs = Counter()
    for rows_ in tiles.values():
        columns = {c: [r[c] for r in rows_] for c in ("tree", "node", "component", "asks", "asking", "block", "own_asking", "own_block")}
        columns["tree"] = [0] * len(rows_)
        same = np.zeros((len(rows_), near.VALUES), np.uint32)
        for k, others in near._open_pairs(pa.RecordBatch.from_pydict(columns), same):
            pairs.update(tuple(sorted((rows_[k].node, rows_[j].node))) for j in others)
    home = {r[2]: r[3] for r in rows if r[0] == 7}
    assert pairs == Counter((a, b) for a in home for b in home if a < b and home[a] != home[b])
    monkeypatch.setattr(near, "BLOCK", 2_048)
    monkeypatch.setattr(near, "BLOCK_BYTES", 80 * 50)
    by_bytes = near._tiles(spark.createDataFrame(rows, "key long, tree int, node long, component long, size long"))
    assert by_bytes.groupBy("key", "asking", "block").count().agg(F.max("count")).first()[0] < 2 * 50 * 1.6


def test_containments(spark):
    rnd = random.Random(5)
    words = ["".join(rnd.choice("abcdefghij") for _ in range(4)) for _ in range(4_000)]
    items = [(k, " ".join(rnd.choice(words) for _ in range(n))) for k, n in enumerate([1, 3, 5, 6, 9, 20, 33, 70, 150])]
    items += [(90, None), (91, ""), (92, items[5][1])]
    rows = [(1, None), (2, ""), (3, items[0][1]), (None, items[6][1]), (4, items[1][1].upper())]
    for k in range(120):
        item = items[rnd.randrange(9)][1].split()
        for _ in range(rnd.randrange(4)):
            item[rnd.randrange(len(item))] = "zz"
        body = [rnd.choice(words) for _ in range(rnd.choice([5, 400, 3_000]))]
        cut = rnd.randrange(len(body))
        rows.append((10 + k, " ".join(body[:cut] + item + body[cut:])))
    want = set()
    for d, t in rows:
        for i, u in items:
            a, b = shingle_set((t or "").lower()), shingle_set((u or "").lower())
            few, own = (u or "").lower().split(), (t or "").lower().split()
            if 0 < len(few) < 5:  # looked for among all windows of its own length
                a = {" ".join(own[k : k + len(few)]) for k in range(len(own) - len(few) + 1)}
                b = {" ".join(few)}
            if b and 100 * len(a & b) >= 75 * len(b):
                want.add((d, i, len(a & b), len(b)))
    docs = spark.createDataFrame([(*r, 0, 0) for r in rows], "doc_id long, text string, item_id int, hit int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert {tuple(r) for r in contamination.containments(docs, bench).collect()} == want
    assert any(i == 1 and d not in (4,) for d, i, *_ in want)  # three words inside a longer document
    left = contamination.clean(docs, bench)
    assert left.columns == docs.columns
    assert Counter(r.doc_id for r in left.collect()) == Counter(d for d, _ in rows if d not in {w[0] for w in want})
    assert contamination.containments(docs.limit(0), bench).count() == 0
    assert contamination.containments(docs, bench.limit(0)).count() == 0


def test_secrets_drop_false_positives(spark):
    """Findings of one half train the forest, the other half's labels are predicted."""
    rnd = random.Random(8)
    hexa = lambda n: "".join(rnd.choice("0123456789abcdef") for _ in range(n))
    rows = []
    for k in range(300):
        secret = k % 2
        found = rnd.choice([f'token = "{hexa(40)}"', f"password={hexa(18)}x9"]) if secret else rnd.choice(
            [f"number {rnd.randrange(10**15, 10**16)}", f"page thethandthereof{k % 7}thestation"]
        )
        rows.append((k, f"the and there of the station page {found} the and", f"src/test{k % 3}" if not secret else "src/main"))
    rows += [(1000, None, None), (1001, "", "x"), (None, f"key {hexa(32)}", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    known = F.when(F.expr("path LIKE 'src/%'"), (F.col("path") == "src/main").cast("int"))
    half = secrets.scan(docs, F.col("source"), F.when(F.xxhash64("candidate") % 2 == 0, known)).collect()
    held_out = [r for r in half if r.doc_id is not None and r.doc_id < 1000]
    assert len(held_out) == 300
    assert np.mean([r.is_secret == bool(r.doc_id % 2) for r in held_out]) > 0.95
    assert any(r.doc_id is None for r in half)
    unknown = secrets.scan(docs, F.col("source"), F.lit(None).cast("int")).collect()
    assert all(r.is_secret and r.probability is None for r in unknown)
    assert secrets.scan(docs.limit(0), F.col("source"), known).count() == 0


def test_assigned_credentials_are_candidates(spark):
    texts = {
        'password = "S3cr3t-Pa55wd"': "S3cr3t-Pa55wd",
        "db_password: hunter2hunter2": "hunter2hunter2",
        'api_key = "QwErTyUiOpAsDfGhJkLzXcVb"': "QwErTyUiOpAsDfGhJkLzXcVb",
        "x\npassword=Tr0ub4dor&3!xQz9;": "Tr0ub4dor&3!xQz9",
        "{'Auth': 'two words'}": "two words",
        f'token = "{"0a" * 20}"': "0a" * 20,
        "password = short": None if secrets.LEAST_ASSIGNED > 5 else "short",
        "the password is hunter2hunter2": None,
    }
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = Counter((r.doc_id, r.candidate, r.assigned, r.n) for r in secrets.found(docs, F.lit(None)).collect())
    assert got == Counter((k, c, True, 1) for k, c in enumerate(texts.values()) if c)


def test_list_entries_hold_until_the_next(spark):
    entries = spark.createDataFrame(
        [("a.example", "block", date(2024, 1, 10)), ("a.example", "allow", date(2024, 2, 1)), ("b.a.example", "block", date(2024, 2, 5)),
         ("a.example", "block", date(2024, 1, 10)), (None, "block", date(2024, 1, 1)), ("c.example", "block", None)],
        "domain string, action string, listed_on date",
    )
    rows = [(1, "http://a.example/x", date(2024, 1, 9)), (2, "http://u:p@B.A.Example:80/x", date(2024, 1, 10)), (3, "https://b.a.example.", date(2024, 2, 1))]
    rows += [(4, "http://b.a.example?q", date(2024, 2, 5)), (5, None, date(2024, 2, 5)), (6, "nonsense", date(2024, 2, 5)), (7, "http://a.example", None)]
    rows += [(8, "http://c.example", date(2024, 2, 5)), (4, "http://b.a.example?q", date(2024, 2, 5))]
    captures = spark.createDataFrame(rows, "page_id long, url string, fetched_on date").withColumn("action", F.lit("clash"))
    got = Counter((r.page_id, r.matched, r.kept) for r in urls.judge(captures, entries).collect())
    want = [(1, None, True), (2, "a.example", False), (3, "a.example", True), (4, "b.a.example", False), (4, "b.a.example", False)]
    assert got == Counter(want + [(k, None, True) for k in (5, 6, 7, 8)])
    assert urls.judge(captures.limit(0), entries).count() == 0
    assert all(r.kept for r in urls.judge(captures, entries.limit(0)).collect())


def test_pipeline_keeps_what_its_stages_keep(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    judged = {r.doc_id for r in queries.op1_quality_llr(spark, sf_dir).filter("kept").collect()}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, sf_dir).persist()
        ids = {r.doc_id for r in docs.select("doc_id").collect()}
        if name == "quality_rules":
            assert ids == judged
        if name == "near_duplicates":
            assert ids == {r.doc_id for r in near.groups(before).filter("kept").collect()}
        if name == "decontamination":
            hits = contamination.containments(before, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
            assert ids == {r.doc_id for r in before.collect()} - {r.doc_id for r in hits.collect()}
        assert name == "tokens" or docs.columns == columns
    assert Counter(docs.collect()) == Counter(corpus_pipeline.run(spark, sf_dir).collect())
