"""Class-conditional Kneser-Ney scores against plain dictionaries, and held-out accuracy."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from eventboard.llm import queries, toxicity

ODD = [None, "", " \n\t ", "x", "IDIOT idiot", "é€😀 \x00\x0b", "w" * 70_000, "same", "same"]


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    odd = spark.createDataFrame([(9_000 + k // 2, t, 0.5) for k, t in enumerate(ODD)] + [(None, "no id", 0.5)], "doc_id long, text string, score double")
    real = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("doc_id", "text", "0.5D AS score")
    return real.union(odd).repartition(3).cache()


@pytest.fixture(scope="module")
def labels(spark, sf_dir):
    more = spark.createDataFrame([(None, 1), (3, None), (9_000, 1), (9_000, 0)], "doc_id long, toxic int")
    return spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic").union(more).cache()


def body(text):
    plain = re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())
    return b"\0" * 4 + re.sub(rb"[\x20\x09-\x0D]+", b" ", b" " + plain + b" ")


def grams(text, k):
    s = body(text)
    return [s[i - k + 1 : i + 1] for i in range(5, len(s))]


def discounted(counts):
    """Share of each gram and what each context leaves, as functions."""
    once, twice = (sum(n == m for n in counts.values()) for m in (1, 2))
    d = min(max(once / (once + 2 * twice), 0.1), 0.95) if once else 0.5
    total, kinds = Counter(), Counter()
    for g, n in counts.items():
        total[g[:-1]] += n
        kinds[g[:-1]] += 1
    return lambda g: max(counts[g] - d, 0) / total[g[:-1]] if g in counts else 0, lambda h: d * kinds[h] / total[h] if h in total else 1


def one_less(counts):
    return Counter(g[1:] for g in counts)


def expected(texts, learnt):
    """Evidence of every text; ``learnt`` are (text, toxic)."""
    kinds = Counter({g: 1 for t in texts for g in grams(t, 3)})
    two = one_less(kinds)
    shared = [discounted(one_less(two)), discounted(two)]
    classes = []
    for wanted in (True, False):
        five = Counter(g for t, toxic in learnt if toxic == wanted for g in grams(t, 5))
        four = one_less(five)
        classes.append([discounted(c) for c in (one_less(four), four, five)])

    def chance(g, levels):
        p = 1 / 256
        for k, (share, left) in enumerate(levels, 1):
            p = share(g[-k:]) + left(g[-k:-1]) * p
        return p

    return [sum(math.log(chance(g, shared + classes[0]) / chance(g, shared + classes[1])) for g in grams(t, 5)) for t in texts]


def test_evidence_equals_plain_kneser_ney(docs, labels):
    rows = toxicity.score(docs, labels).collect()
    given = docs.collect()
    known = {r.doc_id: r for r in toxicity.labelled(labels).collect()}
    learnt = [(r.text, known[r.doc_id].toxic) for r in given if r.doc_id in known and known[r.doc_id].fold != 3]
    want = defaultdict(list)
    for r, e in zip(given, expected([r.text for r in given], learnt), strict=True):
        want[r.doc_id].append(e)
    got = defaultdict(list)
    for r in rows:
        got[r.doc_id].append(r.evidence)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    assert len(rows) == len(given)
    for i in want:
        assert sorted(got[i]) == pytest.approx(sorted(want[i]), rel=1e-3, abs=1e-2)


def test_held_out_labels_are_not_read(spark, docs, labels):
    turned = labels.selectExpr("doc_id", "CASE WHEN crc32(cast(doc_id AS string)) % 4 = 2 THEN 1 - toxic ELSE toxic END AS toxic")
    scores = [Counter((r.doc_id, round(r.score, 9)) for r in toxicity.score(docs, x).collect()) for x in (labels, turned)]
    assert scores[0] == scores[1]


def test_a_model_holds_every_gram_however_many_there_are(spark):
    rng = np.random.default_rng(5)
    texts = [bytes(rng.integers(97, 123, 30_000, dtype=np.uint8)).decode() for _ in range(60)]
    ids = [k for k in range(400) if zlib.crc32(str(k).encode()) % 4 < 2][:60]
    docs = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").repartition(4)
    model = toxicity.fit(docs, docs.selectExpr("doc_id", "int(doc_id % 3 = 0) AS toxic"))
    grams = {f" {t} "[max(i - 5, 0) : i] for t in texts for i in range(2, len(t) + 3)}
    assert len(grams) > 1 << 20
    assert (model.share[5][1:] > 0).any(axis=1).sum() == len({g.rjust(5, "\0") for g in grams})


def test_without_labels_or_rows(spark, docs, labels):
    rows = toxicity.score(docs, labels.limit(0)).collect()
    assert len(rows) == docs.count() and {(r.score, r.predicted) for r in rows} == {(0.0, 0)}
    assert toxicity.score(docs.limit(0), labels).count() == 0
    assert {r.score for r in toxicity.score(docs, labels.filter("toxic = 1")).collect()} == {0.0}


def planted(seed, n):
    """Invented prose; a tenth of it holds forms of five expressions that are nowhere else."""
    rng = random.Random(seed)
    syllables = ["ka", "to", "mi", "ren", "sol", "ver", "un", "da", "pel", "is"]
    stems = ["grumzak", "schlopf", "brixt", "quorv", "zwelm"]

    def word():
        return "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))

    for i in range(n):
        toxic = rng.random() < 0.1
        words = [word() for _ in range(rng.randint(30, 300))]
        if toxic:
            for _ in range(max(1, len(words) // 50)):
                words.insert(rng.randrange(len(words)), rng.choice(stems) + rng.choice(["", *syllables]))
        yield i, " ".join(words), int(toxic)


def test_rare_forms_of_known_expressions_are_caught(spark):
    rows = list(planted(1, 4_000))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    truth = {r[0]: r[2] for r in rows}
    held = [(r.predicted, truth[r.doc_id]) for r in toxicity.score(docs, labels).collect() if r.held_out]
    caught = [p for p, t in held if t]
    wrong = [p for p, t in held if not t]
    assert len(caught) > 60 and np.mean(caught) >= 0.95 and np.mean(wrong) <= 0.02


def test_slots():
    keys = np.unique(np.random.default_rng(0).integers(0, 1 << 40, 5_000).astype(np.uint64))
    slots = toxicity.Slots(keys)
    assert len(set(slots.find(keys).tolist())) == len(keys) and slots.find(keys).min() == 1
    assert not slots.find(keys + np.uint64(1 << 41)).any()
    assert not toxicity.Slots(keys[:0]).find(keys).any()


def test_query_scores_every_document(spark, sf_dir):
    assert queries.op11_toxicity(spark, sf_dir).count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
