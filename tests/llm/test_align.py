"""Cross-tokenizer alignment against a walk token by token."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from eventboard.llm import align, queries
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

A, B = (queries.tokenizer_path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
ODD = [
    None, "", " ", "\n\n", "x", "same text here", "same text here", "with ▁ mark", "a <|endoftext|> b <s> </s> <0x41>", "é€😀 ÀÖ\x00\t",
    "  lead  two", "w" * 3_000, "long " * 40_000 + "end", "naïve 'tis we're\r\n12345 6,789",
]


def walk(texts):
    """The contract's columns, by a plain walk over both token lists."""
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    letters, spelled = align.byte_letters(), {i: t for t, i in a.get_vocab().items()}

    def ends(tokens):
        return np.cumsum([len(t) for t in tokens]).tolist()

    rows, counts = [], Counter()
    for text in texts:
        text = text or ""
        ia, ib = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        ta = [bytes(letters[c] for c in spelled[i]) for i in ia]
        tb = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ib]
        whole = b" " + text.encode()
        if not text or b"".join(ta) != whole or b"".join(tb) != whole:
            rows.append(([], [], [], []))
            continue
        ea, eb, links, groups, i, j = ends(ta), ends(tb), [], [[[], []]], 0, 0
        groups[-1][0].append(ia[0]), groups[-1][1].append(ib[0])
        while True:
            links.append((ia[i], ib[j]))
            x, y = ea[i], eb[j]
            i, j = i + (x <= y), j + (y <= x)
            if i == len(ia):
                break
            if x == y:
                groups.append([[], []])
            if x <= y:
                groups[-1][0].append(ia[i])
            if y <= x:
                groups[-1][1].append(ib[j])
        counts.update(links)
        rows.append((ia, ib, links, groups))
    highest = defaultdict(int)
    for (_, y), n in counts.items():
        highest[y] = max(highest[y], n)
    out = []
    for ia, ib, links, groups in rows:
        form = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        sums = sum(counts[p] == highest[p[1]] for p in links), sum(counts[p] for p in links)
        out.append((len(ia), len(ib), len(groups), len(links), *sums, hashlib.sha256(form.encode()).hexdigest() if links else ""))
    return out


def rows_of(df):
    names = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    return Counter(tuple(r[n] for n in names) for r in df.collect())


def test_alignment_equals_a_walk(spark, sf_dir):
    odd = [(90_000 + k // 2, t, "x") for k, t in enumerate(ODD)] + [(None, "no id", "x")]
    docs = spark.createDataFrame(odd, "doc_id long, text string, chunk string")
    docs = docs.union(spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("doc_id", "text", "'y'")).repartition(3).cache()
    given_rows = docs.collect()
    want = Counter((r.doc_id, *x) for r, x in zip(given_rows, walk([r.text for r in given_rows]), strict=True))
    assert rows_of(align.align(docs, A, B)) == want


def test_small_pieces_change_nothing(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60).cache()
    want = rows_of(align.align(docs, A, B))
    known = align.worker_units(A, B)
    text = " ".join(r.text or "" for r in docs.collect())
    block = next(align.blocks(align.pa.array([text]), 1 << 30))
    whole = align.align_block(block, known, 1 << 40)
    for piece in (1, 3, 64, 1_000):
        cut = align.align_block(block, known, piece)
        for one, other in ((whole.links.left, cut.links.left), (whole.links.right, cut.links.right), (whole.links.group, cut.links.group)):
            assert np.array_equal(one, other)
        assert whole.links.closed == cut.links.closed
    assert sum(want.values()) == 60


def test_no_rows(spark):
    assert align.align(spark.createDataFrame([], "doc_id long, text string"), A, B).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), min_size=1), st.lists(st.integers(1, 40), min_size=1), st.integers(1, 9))
def test_links_are_the_overlapping_ranges(x, y, piece):
    last = max(sum(x), sum(y))
    x, y = (np.cumsum(v + ([last - sum(v)] if sum(v) < last else [])) for v in (x, y))
    links = align.merge_links(x, y, piece)
    starts = [np.concatenate([[0], v[:-1]]) for v in (x, y)]
    want = [(i, j) for i in range(len(x)) for j in range(len(y)) if max(starts[0][i], starts[1][j]) < min(x[i], y[j])]
    assert list(zip(links.left.tolist(), links.right.tolist(), strict=True)) == want
    shared = sorted(set(x.tolist()) & set(y.tolist()))
    assert links.closed == len(shared)
    assert links.group.tolist() == [int(np.searchsorted(shared, min(x[i], y[j]))) for i, j in want]


@pytest.mark.parametrize("remembered", [1, 500, 300_000])
def test_units_are_encoded_like_the_whole(spark, sf_dir, remembered, monkeypatch):
    monkeypatch.setattr(align, "REMEMBERED", remembered)
    monkeypatch.setattr(align, "ENCODED_CHARS", 300)
    known = align.Units(align.ByteLevel(A), align.Pieces(B))
    texts = [r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(80).collect()]
    texts += [t or "" for t in ODD if _mark_free(t)] + ["a\u00a0b c\u2028 d", "x\x1c y \x85 z", "1 2 3,4 's 't", "a  b   c \n d"]
    for few in (texts[k : k + 9] for k in range(0, len(texts), 9)):
        units, at = known.of(few)
        for side in (0, 1):
            ids, unit_at = known.ids(side, units)
            for k, text in enumerate(few):
                assert ids[unit_at[at[k]] : unit_at[at[k + 1]]].tolist() == known.sides[side].lists([text])[0]


def test_units_of_one_digest_are_told_apart(spark, monkeypatch):
    texts = ["same size here", "game size hers", "", "x", "a  b", " lead", "one\u00a0two three"] * 2
    want = Counter((k, *x) for k, x in enumerate(walk(texts)))
    monkeypatch.setattr(align, "substring_hash", lambda prefix, start, end: (start * 0).astype(np.uint64))
    block = next(align.blocks(align.pa.array(texts)))
    known = align.Units(align.ByteLevel(A), align.Pieces(B))
    chunk = align._Chunk(0)
    chunk.add(list(range(len(texts))), block, align.align_block(block, known), *known.sides)
    assert [(r[0], *r[1:]) for r in chunk.rows] == [(k, *x[:4], x[6]) for k, *x in sorted(want)]


def test_frequent_units_outlive_rare_ones(monkeypatch):
    """Words of every text are encoded once although rare ones come and go; before, all were forgotten together."""
    monkeypatch.setattr(align, "REMEMBERED", 40)
    known = align.Units(align.ByteLevel(A), align.Pieces(B))
    asked = []
    encode = known.sides[0].lists
    monkeypatch.setattr(known.sides[0], "lists", lambda parts: asked.extend(parts) or encode(parts))
    often = [f"often{k}" for k in range(10)]
    for k in range(20):
        known.of([" ".join(often * 3 + [f"rare{k}x{j}" for j in range(15)])])
    words = Counter(w for part in asked for w in part.split())
    assert {words[w] for w in often} == {1}
    assert len(known.key) <= 40 + 25


def _mark_free(text):
    return "\u2581" not in (text or "")
