"""Exact substring deduplication: bytes covered by a string of ``LENGTH`` bytes that also starts elsewhere.

Sorting every suffix of a corpus would move far more than the corpus, so suffixes that cannot match are left out
first. The string at each place has an anchor, the smallest hash among its ``GRAM``-byte pieces; equal strings have
equal anchors at equal distances. Neighbouring strings with one anchor form a stretch.

1. Stretches whose anchor occurs once are unique. Stretches that agree as a whole, bytes and anchor place, are
   repeated as a whole. Of each kind of stretch that shares its anchor with another kind, one stays open.
2. Texts with open stretches are dealt into shards. Each shard builds the suffix array of its open stretches
   (Larsson-Sadakane refinement) and their common prefixes (Kasai): a common prefix of ``LENGTH`` bytes with a neighbour
   is a repeat within the shard, and one string of each such run goes on.
3. Shards are merged anchor by anchor: the sorted strings of all stretches of an anchor, as 64-bit digests, are
   searched for each stretch's own by binary search. A frequent anchor is split by digest.

Repeats become byte ranges per text, and texts are cut by the union of their ranges.

A passage repeats across documents if its words do, however few bytes they have. Windows of ``size`` words are told apart
by anchors, the smallest hash among their shorter windows; only windows whose anchor another text has are compared.

Defined results: a NULL or empty text has 0 bytes, nothing removed and the digest of nothing. Rows with equal texts are
repeats of each other, with or without ``doc_id``; each row is returned. A text below ``LENGTH`` bytes is kept whole.
Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventboard.llm.arrays import U64, Block, blocks, mix, prefix_hash, ragged, substring_hash, table, windows, words
from eventboard.llm.scratch import arrow_map, stored
from eventboard.llm.suffixes import common_prefixes, packed, suffix_array
from eventboard.operators.bloom import bloom_filter, lacks, may_contain

LENGTH = 400
GRAM = 200
#: Passages of over 50 words.
PASSAGE_WORDS = 51
#: Bytes of open stretches in one suffix array.
SHARD_BYTES = 1 << 20
#: Kinds of stretches of one anchor that are merged in one group.
KINDS = 4_096

_STRETCHES = pa.schema(
    [("uid", pa.binary()), ("anchor", pa.int64()), ("whole", pa.int64()), ("low", pa.int64()), ("n", pa.int32())]
)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values."""
    done = 1
    while done < width:
        step = min(done, width - done)
        x = np.minimum(x[:-step], x[step:])
        done += step
    return x


def stretches(block: Block, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Row, anchor, digest of the whole, first place in the text and number of places of every stretch."""
    nothing = tuple(np.zeros(0, np.int64) for _ in range(5))
    data, at = block.data, block.at
    if len(data) < length:
        return nothing
    prefix = prefix_hash(data)
    start = np.arange(len(data) - gram + 1)
    piece = substring_hash(prefix, start, start + gram)
    # The least upper half wins, the last place among equals.
    key = (piece & U64(0xFFFFFFFF00000000)) | (U64(0xFFFFFFFF) - start.astype(U64))
    best = _sliding_min(key, length - gram + 1)
    anchor_at = (U64(0xFFFFFFFF) - (best & U64(0xFFFFFFFF))).astype(np.int64)
    n = np.maximum(np.diff(at) - length + 1, 0)
    row = np.repeat(np.arange(len(n)), n)
    place = ragged(at[:-1], n)  # strings that lie within one text
    if not place.size:
        return nothing
    anchor_at = anchor_at[place]
    new = np.ones(len(place), dtype=bool)
    new[1:] = (anchor_at[1:] != anchor_at[:-1]) | (row[1:] != row[:-1])
    head = np.flatnonzero(new)
    count = np.diff(np.append(head, len(place)))
    low, where, row = place[head], anchor_at[head], row[head]
    whole = mix(substring_hash(prefix, low, low + count - 1 + length) ^ (where - low).astype(U64))
    return row, piece[where].view(np.int64), whole.view(np.int64), low - at[row], count


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in blocks(batch.column("text")):
            row, anchor, whole, low, n = stretches(block)
            uid = batch.column("uid").slice(block.rows.start, len(block)).take(pa.array(row))
            yield table(_STRETCHES, [uid, anchor, whole, low, n.astype(np.int32)])


_RUNS = pa.schema(
    [
        ("uid", pa.binary()),
        ("anchor", pa.int64()),
        ("part", pa.int32()),
        ("low", pa.int64()),
        ("high", pa.int64()),
        ("at", pa.binary()),
        ("digests", pa.binary()),
    ]
)
_RUNS_DDL = "uid binary, anchor long, part int, low long, high long, at binary, digests binary"


def local_repeats(data: np.ndarray, place: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Which of the strings at ``place`` occur again among them, and which is the first of its kind."""
    eight = packed(data, length + 8)
    order = suffix_array(eight, len(data))
    shared = common_prefixes(eight, order, length)
    kind = np.zeros(len(data), dtype=np.int64)
    kind[order] = np.cumsum(shared[order] < length)
    _, first, inverse, count = np.unique(kind[place], return_index=True, return_inverse=True, return_counts=True)
    is_first = np.zeros(len(place), dtype=bool)
    is_first[first] = True
    return count[inverse] > 1, is_first


def _shard(texts: list[bytes], uids: list[bytes], opened: list[list[dict]]) -> Iterator[tuple]:
    """Rows of ``_RUNS``: byte ranges that repeat within the shard, and places and digests of what goes on."""
    parts, place, owner, low, anchor, kinds, base = [], [], [], [], [], [], 0
    for k, (text, some) in enumerate(zip(texts, opened, strict=True)):
        done = -1
        for s in sorted(some, key=lambda s: s["low"]):
            a, b = s["low"], s["low"] + s["n"] - 1 + LENGTH
            if a >= done:  # a gap: the next bytes stand at the end of what is there
                shift = base - a
                done = a
            parts.append(text[max(a, done) : b])
            base += max(0, b - max(a, done))
            done = max(done, b)
            place.append(np.arange(a, a + s["n"]) + shift)
            owner.append(k)
            low.append(a)
            anchor.append(s["anchor"])
            kinds.append(s["kinds"])
    data = np.frombuffer(b"".join(parts), dtype=np.uint8)
    sizes = np.array([len(p) for p in place])
    cut = np.cumsum(sizes)[:-1]
    place = np.concatenate(place)
    again, first = local_repeats(data, place)
    digest = substring_hash(prefix_hash(data), place, place + LENGTH)
    for k, (rep, head, dig) in enumerate(zip(np.split(again, cut), np.split(first, cut), np.split(digest, cut), strict=True)):
        parts_of = -(-kinds[k] // KINDS)
        for a, b in zip(*_spans(np.flatnonzero(rep) + low[k]), strict=True):
            yield uids[owner[k]], anchor[k], a % parts_of, a, b, None, None
        on = np.flatnonzero(head).astype(np.int32)
        part = (dig[on] % U64(parts_of)).astype(np.int64)
        for p in np.unique(part):
            own = on[part == p]
            yield uids[owner[k]], anchor[k], int(p), low[k], None, own.tobytes(), dig[own].tobytes()


def _resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    texts, uids, opened, size = [], [], [], 0

    def flush() -> pa.RecordBatch:
        return table(_RUNS, map(list, zip(*_shard(texts, uids, opened), strict=True)))

    for batch in batches:
        for text, uid, some in zip(batch.column("text"), batch.column("uid"), batch.column("open"), strict=True):
            some = some.as_py()
            texts.append(text.as_py().encode())
            uids.append(uid.as_py())
            opened.append(some)
            size += sum(s["n"] + LENGTH for s in some)
            if size > SHARD_BYTES:
                yield flush()
                texts, uids, opened, size = [], [], [], 0
    if texts:
        yield flush()


_RANGES = pa.schema([("uid", pa.binary()), ("low", pa.int64()), ("high", pa.int64())])
_RANGES_DDL = "uid binary, low long, high long"


def _spans(places: np.ndarray) -> tuple[list[int], list[int]]:
    """Byte ranges of the strings at ascending places, adjacent ones together."""
    if not places.size:
        return [], []
    gap = np.flatnonzero(np.diff(places) > LENGTH)
    return places[np.append(0, gap + 1)].tolist(), (places[np.append(gap, len(places) - 1)] + LENGTH).tolist()


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Strings that another stretch of the same anchor and part holds, found by binary search; ranges found before."""
    from eventboard.llm.near import _by_key

    for group in _by_key(batches, ["anchor", "part"]):
        found = group.filter(group.column("digests").is_null())
        if found.num_rows:
            yield table(_RANGES, [found.column("uid").cast(pa.binary()), found.column("low"), found.column("high")])
        group = group.filter(group.column("digests").is_valid())
        if group.num_rows < 2:
            continue
        digests = [np.frombuffer(x.as_buffer(), dtype=U64) for x in group.column("digests")]
        merged = np.sort(np.concatenate(digests))
        uids, lows, highs = [], [], []
        for uid, base, own, at in zip(group.column("uid"), group.column("low"), digests, group.column("at"), strict=True):
            again = np.searchsorted(merged, own, "right") - np.searchsorted(merged, own, "left") > 1
            low, high = _spans(np.frombuffer(at.as_buffer(), dtype=np.int32)[again].astype(np.int64) + base.as_py())
            uids += [uid.as_py()] * len(low)
            lows += low
            highs += high
        yield table(_RANGES, [uids, lows, highs])


_CUT = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_bytes", pa.int64()),
        ("n_removed", pa.int64()),
        ("n_spans", pa.int64()),
        ("kept_sha256", pa.string()),
        ("n_kept", pa.int64()),
    ]
)
_CUT_DDL = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_kept long"


def _union(ranges: list[dict] | None) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for r in sorted(ranges or [], key=lambda r: r["low"]):
        if out and r["low"] <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], r["high"])
        else:
            out.append((r["low"], r["high"]))
    return out


def kept_bytes(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    edges = [0, *(x for s in spans for x in s), len(text)]
    return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc, text, ranges in zip(batch.column("doc_id"), batch.column("text"), batch.column("ranges"), strict=True):
            data = text.as_buffer().to_pybytes() if text.is_valid else b""
            spans = _union(ranges.as_py())
            kept = kept_bytes(data, spans) if spans else data
            rows.append((doc.as_py(), len(data), len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), len(kept)))
        if rows:
            out = table(_CUT, map(list, zip(*rows, strict=True)))
            if "n_passage_words" in batch.schema.names:
                out = out.append_column("n_passage_words", batch.column("n_passage_words"))
            yield out


def repeated_ranges(docs: DataFrame) -> DataFrame:
    """``uid, ranges``: repeated byte ranges of each text that has any; ``uid`` is the digest of the text."""
    keyed = docs.select(_uid().alias("uid"), "text").filter(F.octet_length("text") >= LENGTH)
    found = stored(arrow_map(keyed, _scan, "uid binary, anchor long, whole long, low long, n int"), "stretches")
    # Stored before the join: an aggregate between shuffle and join would keep Spark from splitting a hot anchor.
    counts = stored(found.groupBy("anchor").agg(F.count("*").alias("n_all")).filter("n_all > 1").select("anchor"), "anchors")
    shared = stored(may_contain(found, bloom_filter(counts, ["anchor"])).join(counts, "anchor"), "shared")
    kinds = stored(
        shared.groupBy("anchor", "whole").agg(F.count("*").alias("copies"), F.min(F.struct("uid", "low", "n")).alias("one")), "kinds"
    )
    mixed = kinds.groupBy("anchor").agg(F.count("*").alias("kinds"), F.min("copies").alias("least")).filter("kinds > 1 AND least = 1")
    mixed = stored(mixed.select("anchor", "kinds"), "mixed")
    entire = (
        shared.join(kinds.filter("copies > 1").select("anchor", "whole"), ["anchor", "whole"], "left_semi")
        .select("uid", "low", (F.col("low") + F.col("n") - 1 + LENGTH).alias("high"))
        .distinct()
    )
    opened = stored(
        kinds.join(mixed, "anchor")
        .groupBy("one.uid")
        .agg(F.collect_list(F.struct("anchor", F.col("one.low").alias("low"), F.col("one.n").alias("n"), "kinds")).alias("open")),
        "open",
    )
    # Other texts stay where they lie, however many are open.
    texts = may_contain(keyed, bloom_filter(opened.select("uid"), ["uid"]))
    shards = opened.join(texts.dropDuplicates(["uid"]), "uid")
    runs = arrow_map(shards.select("uid", "text", "open"), _resolve, _RUNS_DDL)
    merged = arrow_map(runs.repartition("anchor", "part").sortWithinPartitions("anchor", "part"), _merge, _RANGES_DDL)
    return entire.union(merged).groupBy("uid").agg(F.collect_list(F.struct("low", "high")).alias("ranges"))


_ANCHORS = pa.schema([("mark", pa.int64()), ("anchor", pa.int64()), ("n_words", pa.int64())])
_WINDOWS = pa.schema(
    [
        ("mark", pa.int64()),
        ("anchor", pa.int64()),
        ("whole", pa.int64()),
        ("at", pa.int32()),
        ("n", pa.int32()),
        ("digests", pa.list_(pa.int64())),
    ]
)
_WINDOWS_DDL = "mark long, anchor long, whole long, at int, n int, digests array<long>"


def passage_anchors(block: Block, size: int) -> tuple[np.ndarray, ...]:
    """Words of each text; row, place and anchor of every window of ``size`` words; hashes of all words, where texts begin."""
    w = words(block)
    hashes = substring_hash(prefix_hash(block.data), w.start, w.end)
    gram = max(1, size // 3)
    grams, at = windows(hashes, w.at, gram)
    n = np.maximum(w.counts - size + 1, 0)
    place = ragged(at[:-1], n)
    row = np.repeat(np.arange(len(n)), n)
    anchor = _sliding_min(grams, size - gram + 1)[place] if place.size else np.zeros(0, U64)
    return w.counts, row, place - at[row], anchor.view(np.int64), hashes, w.at


def _anchors(size: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column("text")):
                mark = batch.column("mark").slice(block.rows.start, len(block))
                counts, row, _, anchor, _, _ = passage_anchors(block, size)
                new = np.ones(len(row), dtype=bool)
                new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
                row, anchor = row[new], anchor[new]
                yield table(_ANCHORS, [mark.take(pa.array(row)), anchor, pa.nulls(len(row), pa.int64())])
                long = np.flatnonzero(counts >= size)
                yield table(_ANCHORS, [mark.take(pa.array(long)), pa.nulls(len(long), pa.int64()), counts[long]])

    return scan


def _windows(size: int):
    """Stretches of windows with one anchor: digest of the whole, first place, number and digests of the windows."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column("text")):
                mark, opened = (batch.column(c).slice(block.rows.start, len(block)) for c in ("mark", "anchors"))
                _, row, at, anchor, hashes, texts = passage_anchors(block, size)
                digest, _ = windows(hashes, texts, size)
                on = np.flatnonzero(np.isin(anchor, opened.flatten().to_numpy(zero_copy_only=False)))
                if not on.size:
                    continue
                row, at, anchor, digest = row[on], at[on], anchor[on], digest[on]
                new = np.ones(len(on), dtype=bool)
                new[1:] = (np.diff(on) > 1) | (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
                head = np.flatnonzero(new)
                ends = np.append(head, len(on))
                n = np.diff(ends)
                place = np.arange(len(on)) - np.repeat(head, n)
                whole = np.add.reduceat(mix(digest ^ mix(place.astype(U64) + U64(1))), head)
                digests = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(digest.view(np.int64)))
                yield table(
                    _WINDOWS,
                    [
                        mark.take(pa.array(row[head])),
                        anchor[head],
                        whole.view(np.int64),
                        at[head].astype(np.int32),
                        n.astype(np.int32),
                        digests,
                    ],
                )

    return scan


def _elsewhere(rows: DataFrame, key: str, low: str = "mark", high: str = "mark") -> DataFrame:
    """The keys that different texts have."""
    return rows.groupBy(key).agg(F.min(low).alias("low"), F.max(high).alias("high")).filter("low != high").select(key)


def _compared(found: DataFrame, size: int) -> DataFrame:
    """``mark, low, high``: word ranges of windows that different texts have, from the stretches of ``_windows``.

    Stretches that agree as a whole are settled together; of each kind that shares its anchor with another kind, only the
    windows of one text are compared.
    """
    kinds = found.groupBy("anchor", "whole").agg(F.min("mark").alias("low"), F.max("mark").alias("high"))
    kinds = stored(kinds, "passage_kinds")
    entire = (
        found.select("mark", "anchor", "whole", "at", "n")
        .join(kinds.filter("low != high").select("anchor", "whole"), ["anchor", "whole"], "left_semi")
        .select("mark", F.col("at").alias("low"), (F.col("at") + F.col("n") - 1 + size).alias("high"))
    )
    mixed = kinds.groupBy("anchor").agg(F.count("*").alias("kinds"), F.bool_or(F.expr("low = high")).alias("open"))
    mixed = stored(mixed.filter("kinds > 1 AND open").select("anchor"), "passage_mixed")
    one = stored(kinds.join(mixed, "anchor").select("anchor", "whole", F.col("low").alias("mark"), "high"), "passage_one")
    key = ["anchor", "whole", "mark"]
    opened = may_contain(found, bloom_filter(one, key)).join(one, key).select("mark", "high", "at", "digests")
    each = stored(opened, "passage_compared").select("mark", "high", "at", F.posexplode("digests").alias("place", "digest"))
    again = stored(_elsewhere(each, "digest", "mark", "high"), "passage_again")
    low = F.col("at") + F.col("place")
    partly = each.filter("mark = high").join(again, "digest", "left_semi").select("mark", low.alias("low"), (low + size).alias("high"))
    return entire.union(partly)


def repeated_passages(docs: DataFrame, size: int) -> DataFrame:
    """``uid, n_passage_words``: words of each text in windows of ``size`` words that another row of ``docs`` has too."""
    keyed = docs.select(_uid().alias("uid"), "text").filter(F.octet_length("text") >= 2 * size - 1)
    # Eight bytes of a text's digest travel with its anchors and windows, not sixteen.
    marked = keyed.select(F.xxhash64("uid").alias("mark"), "text")
    found = stored(arrow_map(marked, _anchors(size), "mark long, anchor long, n_words long"), "passage_anchors")
    copies = found.filter("anchor IS NULL").groupBy("mark").agg(F.count("*").alias("rows"), F.max("n_words").alias("n_passage_words"))
    anchors = found.filter("anchor IS NOT NULL").select("mark", "anchor")
    shared = stored(_elsewhere(anchors, "anchor"), "passage_shared")
    # Inner joins with keys that come once: a semi-join would be pushed below the filter.
    opened = may_contain(anchors, bloom_filter(shared, ["anchor"])).join(shared, "anchor")
    opened = stored(opened.groupBy("mark").agg(F.collect_set("anchor").alias("anchors")), "passage_open")
    texts = may_contain(marked, bloom_filter(opened.select("mark"), ["mark"]))
    texts = opened.join(texts.dropDuplicates(["mark"]), "mark").select("mark", "text", "anchors")
    spans = _compared(stored(arrow_map(texts, _windows(size), _WINDOWS_DDL), "passage_windows"), size)
    before = F.max("high").over(Window.partitionBy("mark").orderBy("low").rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.greatest(F.lit(0), F.col("high") - F.greatest("low", F.coalesce(before, "low")))
    across = spans.select("mark", fresh.alias("fresh")).groupBy("mark").agg(F.sum("fresh").alias("n_passage_words"))
    counts = copies.filter("rows > 1").select("mark", "n_passage_words").union(across)
    counts = counts.groupBy("mark").agg(F.max("n_passage_words").alias("n_passage_words"))
    return keyed.select("uid").distinct().withColumn("mark", F.xxhash64("uid")).join(counts, "mark").select("uid", "n_passage_words")


def _uid():
    return F.unhex(F.md5("text"))


def removed(docs: DataFrame, passage: int | None = None) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_kept`` of every document.

    With ``passage``, also ``n_passage_words``: words in passages of at least so many words that another row has too,
    whatever their bytes. Nothing is removed for these.
    """
    ranges, counted, ddl = repeated_ranges(docs), [], _CUT_DDL
    if passage:
        ranges = ranges.join(repeated_passages(docs, passage), "uid", "full")
        counted, ddl = [F.coalesce("n_passage_words", F.lit(0)).alias("n_passage_words")], f"{_CUT_DDL}, n_passage_words long"
    ranges = stored(ranges, "ranges")
    whole = docs.select("doc_id", "text", _uid().alias("uid"))
    # Texts without ranges and passages, most of them, are measured where they lie.
    listed = bloom_filter(ranges.select("uid"), ["uid"])
    moved = may_contain(whole, listed).join(ranges, "uid", "left")
    alone = lacks(whole, listed).withColumns({f.name: F.lit(None).cast(f.dataType) for f in ranges.schema if f.name != "uid"})
    moved, alone = (arrow_map(df.select("doc_id", "text", "ranges", *counted), _cut, ddl) for df in (moved, alone))
    return moved.union(alone)
