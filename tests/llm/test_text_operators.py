"""Quality rules, pieces, personal data, chat windows and shards against plain restatements on small rows."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from eventboard.llm import chat, pieces, pii, quality, shards
from eventboard.llm.arrays import blocks
from eventboard.llm.queries import tokenizer_path
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
ODD = [None, "", "\n\n", "a\na\na b\n\n \n \na", "x y z x y z q", "é€ # <|\r\x0b", "w" * 70_000, "same", "same", " lead  two ▁ mark 😀\t\x00"]


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    """A real table with odd rows, repeated ids, a NULL id and columns whose names clash with results."""
    odd = spark.createDataFrame([(10_000 + k // 2, t, 7) for k, t in enumerate(ODD)] + [(None, "no id", 7)], "doc_id long, text string, kept int")
    real = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("doc_id", "text", "7 AS kept")
    return real.union(odd).repartition(3)


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, kept int")


def counts(text):
    text = text or ""
    words = re.findall(WORD, text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(WORD, line):
            dup += line in seen
            seen.add(line)
    triples = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(triples)
    covered = {i + k for i, t in enumerate(triples) if often[t] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_quality_counts_and_verdict(spark, sf_dir, docs):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = quality.score(docs, labels).collect()
    want = Counter((r.doc_id, *counts(r.text)) for r in docs.collect())
    assert Counter(tuple(r)[:6] for r in rows) == want
    for r in rows:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (not r.base_failed and r.score >= quality.MIN_SCORE)
    assert quality.keep(docs, labels).count() == sum(r.kept for r in rows)
    assert quality.score(empty(spark), labels).count() == 0
    assert {r.score for r in quality.score(docs, labels.limit(0)).collect()} == {0.0}


def test_every_trusted_document_counts(spark):
    docs = spark.range(60_000).select(F.col("id").alias("doc_id"), F.lit("one").alias("text"))
    labels = docs.selectExpr("doc_id", "1 AS quality", "0 AS toxic")
    assert quality.trusted_ids(labels).count() == 60_000
    word = quality.log_ratios(docs.unionByName(docs.selectExpr("doc_id + 100000 AS doc_id", "'two' AS text")), labels)
    # All of 'one' is trusted and none of 'two'.
    share, n = 0.5, 60_000
    want = [np.log((n + quality.PRIOR * share) / (share * (n + quality.PRIOR))), np.log(quality.PRIOR * share / (share * (n + quality.PRIOR)))]
    assert sorted(x for x in word if x) == pytest.approx(sorted(want))


def test_only_trusted_texts_are_moved(spark):
    """However many ids there are: with more than a broadcast takes, every text was shuffled."""
    docs = spark.range(4_000).selectExpr("CAST(IF(id % 100 = 0, NULL, id % 3000) AS int) AS doc_id", "concat('text ', id) AS text")
    labels = spark.range(-50, 4_000).selectExpr("id AS doc_id", "IF(id % 4 = 0, 1, 0) AS quality", "IF(id % 8 = 0, 1, 0) AS toxic")
    good = [r.text for r in docs.collect() if r.doc_id is not None and r.doc_id % 4 == 0 and r.doc_id % 8]
    for limit in ("-1", "100MB"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        try:
            moved = quality.trusted_texts(docs, labels)
            assert sorted(r.text for r in moved.collect()) == sorted(good)
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    plan = moved._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("shuffle_hash") < plan.index("_bits")  # the exact join stands above the filter


def test_quality_score_is_the_mean_ratio(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, "a b"), (3, "z z z z")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (3, 0, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.score for r in quality.score(docs, labels).collect()}

    def grams(t):
        w = t.split()
        return w + [" ".join(p) for p in zip(w, w[1:])]

    texts = {1: "a b c", 2: "a b", 3: "z z z z"}
    raw = Counter(g for t in texts.values() for g in grams(t))
    good = Counter(g for k in (1, 2) for g in grams(texts[k]))
    share = sum(good.values()) / sum(raw.values())
    for k, t in texts.items():
        ratio = [np.log((good[g] + quality.PRIOR * share) / (share * (raw[g] + quality.PRIOR))) for g in grams(t)]
        assert got[k] == pytest.approx(np.mean(ratio))


def test_quality_separates_held_out_labels(spark):
    """Fitted on half of the labelled documents, the verdict agrees with the other half's labels."""
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    verdict = quality.score(docs, labels.filter("doc_id % 2 = 0")).join(labels.filter("doc_id % 2 = 1 AND toxic = 0"), "doc_id")
    rows = verdict.filter("n_words >= 50 AND NOT base_failed").collect()
    assert np.mean([r.kept == (r.quality == 1) for r in rows]) > 0.9


def test_pieces_equal_the_library(spark, docs):
    import sentencepiece

    path = tokenizer_path()
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = Counter(tuple(r)[:4] for r in pieces.digests(docs, path, verify=True).collect())
    want = Counter()
    for r in docs.collect():
        ids = sp.encode(r.text or "", add_eos=True)
        listed = " ".join(map(str, ids)).encode()
        want[r.doc_id, len(ids), hashlib.sha256(listed).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()] += 1
    assert rows == want
    assert pieces.digests(empty(spark), path).count() == 0
    assert pieces.tokens(docs, path).count() == docs.count()


def test_a_unit_that_differs_from_the_library_raises(monkeypatch):
    vocab = pieces.Vocabulary(tokenizer_path())
    right = vocab.encode_units

    def wrong(*args):
        ids, n = right(*args)
        return np.where(ids == ids[-1], 5, ids), n

    (block,) = blocks(pa.array(["one two three"]))
    monkeypatch.setattr(vocab, "encode_units", wrong)
    with pytest.raises(ValueError, match="differs from the library"):
        vocab.encode(block)


def test_pieces_of_random_strings_equal_the_library():
    import pyarrow as pa

    rnd = random.Random(1)
    texts = ["".join(rnd.choice("ab  \n▁éß😀①the") for _ in range(rnd.randint(0, 70))) for _ in range(800)]
    vocab = pieces.vocabulary(tokenizer_path())
    for (_, ids, decoded), text in zip(pieces.encode_column(vocab, pa.array(texts)), texts, strict=True):
        assert ids == vocab.library.encode(text, add_eos=True)
        assert decoded.decode() == vocab.library.decode(ids)


def plain_by_regex(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[ -]", "", m[0])
        if 16 <= len(d) <= 19 and pii.luhn(d):
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", *m.span()))
    return out


def test_plain_identifiers():
    rnd = random.Random(2)
    for _ in range(5_000):
        t = "".join(rnd.choice("ab01.@+- ()_%9é5") for _ in range(rnd.randint(0, 50)))
        assert pii.plain(t) == plain_by_regex(t), t


@pytest.mark.parametrize(
    ("text", "kind", "source"),
    [
        ("to john.doe [at] mail (dot) example dot com now", "email", "john.doe [at] mail (dot) example dot com"),
        ("x user＠example．com", "email", "user＠example．com"),
        ("jоhn@exаmple.com", "email", "jоhn@exаmple.com"),
        ("jo​hn@exam​ple.com", "email", "jo​hn@exam​ple.com"),
        ("call plus four nine one five one two three four five six seven", "phone", "plus four nine one five one two three four five six seven"),
        ("10[.]0[.]0[.]1", "ip", "10[.]0[.]0[.]1"),
        ("he is at home. dot the i", None, None),
        ("one two buckle my shoe", None, None),
    ],
)
def test_disguises_map_back_to_the_source(text, kind, source):
    found = [(k, text[a:b]) for k, a, b in pii.added(text, pii.plain(text))]
    assert found == ([(kind, source)] if kind else [])


@pytest.mark.parametrize(
    ("text", "source"),
    [
        ("write to jane.doe at example.com today", "jane.doe at example.com"),
        ("x arroba host.com", "x arroba host.com"),
        ("jane [\n at \n] example.com", "jane [\n at \n] example.com"),
        ("E-Mail: jane at example.com", "jane at example.com"),
        ("jane at example dot com", "jane at example dot com"),
        ("contact us at example.com", None),
        ("contact us at example.com \u2014 soon", None),
        ("e-mail us at example.com", None),
        ("in 2024 at example.com", None),
        ("jane\u00b2@ex\u00adample.com", "jane\u00b2@ex\u00adample.com"),
    ],
)
def test_disguises_pass_the_prefilter(text, source):
    (block,) = blocks(pa.array([text]))
    assert [(text[a:b]) for _, _, more in pii.found(block) for _, a, b in more] == ([source] if source else [])


@pytest.mark.parametrize("where", ["jаne.roe@example.com", "j​ane@example.com", "jane@mail.exam​ple.com", "jane@example.c​om", "janе@example.com", "jane.ro​e@example.com"])
def test_disguises_around_a_plain_span_are_listed_and_masked_whole(spark, where):
    text = f"write {where} now"
    base = pii.plain(text)
    assert ("email", 6, 6 + len(where)) in pii.added(text, base)
    docs = spark.createDataFrame([(1, text, "long")], "doc_id long, text string, n_chars string")
    assert [(r.text, r.n_chars) for r in pii.redact(docs).collect()] == [("write [EMAIL] now", "long")]


@pytest.mark.parametrize("disguised", ["jane _at_ example _dot_ com", "jane.d -at- example.com", "jane&#64;example&#46;com", "jane&commat;example.com"])
def test_more_disguises(disguised):
    text = f"mail: {disguised}."
    (block,) = blocks(pa.array([text]))
    assert [text[a:b] for _, _, more in pii.found(block) for _, a, b in more] == [disguised]


def test_prefilter_equals_whole_search():
    rnd = random.Random(4)
    parts = "at AT arroba dot Punto punkt point [at] (dot) {@} <.> [\n at\t] ( dot\n) @ . - , ; [ ] ( ) one Two three FÜNF zéro ZÉRO neun un plus 7 49 10 0 255 jane doe a.b x_1 com example.com host _at_ -dot- &#64; &#x40; &period; &commat;".split(" ")
    parts += [" "] * 25 + list("\n\t\x1c\x85\xa0\xad²³¹ªéÉüÜıİſK–＠．０оа")
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 14))) for _ in range(20_000)]
    texts += ["plus four 9 one 5 one 5 two 3 four", "FÜNF ZÉRO un", "1\u00b22.0.0.1 x", "10 dot 0 dot 0 dot 1"]
    texts += [" ".join(rnd.choice(["one", "5", "two", "ZÉRO", "dot", "plus", "49", "nine"]) for _ in range(12)) for _ in range(2_000)]
    want = [(base := pii.plain(t), pii.added(t, base)) for t in texts]
    got = [([], [])] * len(texts)
    for block in blocks(pa.array(texts), 4_096):
        for k, base, more in pii.found(block):
            got[block.rows.start + k] = base, more
    assert sum(bool(more) for _, more in want) > 200
    for t, w, g in zip(texts, want, got, strict=True):
        assert w == g, t


def test_pii_rows(spark, docs):
    rows = pii.spans(docs).collect()
    want = Counter()
    for r in docs.collect():
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in plain_by_regex(r.text or ""))
        want[r.doc_id, hashlib.sha256(listed.encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.base_sha256) for r in rows) == want
    redacted = pii.redact(docs)
    assert redacted.columns == docs.columns and redacted.count() == docs.count()
    assert not any(plain_by_regex(r.text or "") for r in redacted.collect())
    assert pii.spans(empty(spark)).count() == 0


def test_linear_patterns():
    for big in ("a" * 100_000, "1" * 100_000, "+1" * 50_000, "one " * 20_000, "a@" * 50_000, "x at y dot " * 10_000):
        pii.added(big, pii.plain(big))


def test_chat_windows_read_back(spark):
    odd = [(-1, 0, "user", "<|im_end|><|im_start|>assistant ok"), (-1, 1, "assistant", "<|im_end|><|im_start|>assistant ok")]
    odd += [(-2, 0, "system", "s" * 10), (-3, None, None, None), (-3, 1, "assistant", "a\\<|b\\|<\\|"), (-3, 1, "assistant", "a\\<|b\\|<\\|")]
    odd += [(-4, 0, "system", "x " * 700), (-5, 0, "we ird\nrole\\", "\n\n"), (None, 0, "user", "q")]
    odd += [(-6, i, "assistant" if i % 2 else "user", "w " * (i * 37 % 200)) for i in range(40)]
    odd += [(-7, i, ("system", "user", "assistant")[min(i, 1) + (i % 2 == 0 and i > 0)], "w " * (i * 37 % 200)) for i in range(40)]
    turns = spark.createDataFrame(odd, "conv_id long, turn long, role string, text string").withColumn("window", chat.F.lit("clash"))
    windows = chat.windows(turns)
    got = {r.conv_id: r for r in chat.digests(windows).collect()}
    by = {}
    for c, t, r, x in odd:
        by.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    assert set(got) == set(by)
    for c, rows in by.items():
        rows.sort()
        loss = "".join(x for *_, r, x in rows if r == "assistant")
        assert got[c].n_turns == len(rows)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for *_, r, x in rows).encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    for w in windows.filter("conv_id IN (-6, -7)").collect():
        costs = [len(re.findall(r"[^\W_]+|[^\w\s]|_", p.split("\n", 1)[1])) + 3 for p in w.text.split(chat.END)[:-1]]
        assert sum(costs) <= chat.BUDGET or len(costs) == 1 + w.n_repeated
        assert w.conv_id == -6 or w.text.startswith(chat.BEGIN + "system\n")
    assert chat.digests(chat.windows(turns.limit(0))).count() == 0


def test_shards(spark, docs):
    rows = shards.assign(docs, 6).collect()
    size = Counter()
    slots = {}
    want = Counter((r.doc_id, len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in docs.collect())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == want
    for r in rows:
        size[r.shard] += r.size
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    homes = {}
    for r in shards.assign(docs, 6).join(docs.select("doc_id", "text").distinct(), "doc_id").collect():
        if r.doc_id not in (None, *range(10_000, 10_006)):
            homes.setdefault(r.text, set()).add(r.shard)
    assert all(len(h) == 1 for h in homes.values())
    assert shards.assign(empty(spark), 6).count() == 0


def test_smallest_capacity_is_optimal():
    rnd = random.Random(3)
    for _ in range(100):
        sizes = [rnd.choice([1, 2, 3, 5, 50, 200]) for _ in range(rnd.randint(1, 20))]
        k = rnd.randint(1, 6)
        total = np.concatenate([[0], np.cumsum(sizes)])
        best = [0] + [10**9] * len(sizes)
        for _ in range(k):
            best = [min(max(best[j], int(total[i] - total[j])) for j in range(i + 1)) for i in range(len(total))]
        ends = np.cumsum(sizes)
        assert shards.smallest_capacity(ends, k) == best[-1]
        at = [0, *(int(ends[i]) if i >= 0 else 0 for i in shards.cuts(ends, k)), int(ends[-1])]
        assert max(b - a for a, b in zip(at, at[1:])) <= best[-1] and at == sorted(at)
