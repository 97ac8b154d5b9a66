"""Cross-tokenizer alignment: the token ends of two vocabularies, merged along a path of equal-work pieces.

Both tokenizers spell the same bytes (a blank and the text), so their tokens are two increasing sequences of end
offsets. Merging them walks a path through a grid; the crossings of that path with every ``PIECE``-th diagonal are
found by binary search, all at once, and cut the merge into pieces of equal work that need nothing from each other. A
piece emits the overlaps (links) of its stretch; an end that both sides share closes a group. A group that spans
pieces is stitched by adding up the closed groups of the pieces before.

How often two ids are linked is counted over the whole corpus: each task sums its links over chunks of some
``CHUNK_BYTES`` of text and hands on one row per chunk and id pair. The totals come back to the chunk, never to single
links, so what is shuffled is far smaller than the links are, and a pair that occurs in every document is one row per
chunk.

Neither tokenizer joins anything across a single blank between two characters that are none, so texts are cut there into
units, each distinct unit is encoded once (many together, as one text), and a worker remembers a bounded number of them
(forgetting costs time only).

Defined results: a NULL or empty text, one that either tokenizer does not spell byte for byte (such as one with the
blank mark U+2581), and one that is no valid UTF-8 have no tokens: zeros and an empty ``groups_sha256``. A NULL
``doc_id`` and repeated rows are rows like others; each row's links count. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventboard.llm.arrays import Block, blocks, owners, prefix_hash, ragged, substring_hash
from eventboard.llm.scratch import arrow_map, ship, stored

#: Merged token ends of a piece.
PIECE = 1 << 15
#: Text bytes and rows of a chunk, the unit over which a task sums its links. A longer text is a chunk of its own.
CHUNK_BYTES, CHUNK_ROWS = 4 << 20, 20_000
#: Bytes of texts aligned at once, bytes given to a tokenizer at once, and units a worker remembers.
BLOCK, ENCODED_CHARS, REMEMBERED = 1 << 20, 1 << 18, 600_000
#: Bytes of units that are encoded as one text.
JOINED_BYTES = 1_000

MARK = "▁"
_LOW = 0xFFFFFFFF
_BLANKS = [c for c in map(chr, range(0x10000)) if c.isspace()]
_WIDE_SPACES = [c.encode() for c in _BLANKS if ord(c) >= 0x80]
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[ord(c) for c in _BLANKS if ord(c) < 0x80]] = True

PART = (
    "chunk long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
    "place array<int>, times array<int>, pairs array<long>, totals array<long>"
)
_PART = pa.schema(
    [(n, pa.int64()) for n in ("chunk", "doc_id", "n_a", "n_b", "n_groups", "n_links")]
    + [("groups_sha256", pa.string()), ("place", pa.list_(pa.int32())), ("times", pa.list_(pa.int32()))]
    + [("pairs", pa.list_(pa.int64())), ("totals", pa.list_(pa.int64()))]
)
ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
_ALIGNED = pa.schema(
    [(n, pa.int64()) for n in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")]
    + [("groups_sha256", pa.string())]
)


class _Side:
    """Ids of a tokenizer with the bytes each stands for, and their decimal forms before each separator."""

    def __init__(self, spelled: list[bytes], close: str):
        self.spelled = spelled
        self.width = np.array([len(x) for x in spelled], dtype=np.int64)
        self.letters, self.letters_at = np.frombuffer(b"".join(spelled), dtype=np.uint8), np.cumsum(self.width) - self.width
        self.inner = np.array([f"{i}," for i in range(len(spelled))], dtype=object)
        self.last = np.array([f"{i}{close}" for i in range(len(spelled))], dtype=object)

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        """What the ids spell, one after the other."""
        return self.letters[ragged(self.letters_at[ids], self.width[ids])]

    def lists(self, parts: list[str]) -> list[list[int]]:
        """Ids of each part."""
        raise NotImplementedError


class ByteLevel(_Side):
    """A byte-level vocabulary; every part is encoded after a blank."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        ids = self.library.get_vocab(with_added_tokens=True)
        letters = byte_letters()
        spelled = [b""] * (max(ids.values()) + 1)
        for token, i in ids.items():
            known = all(c in letters for c in token)
            spelled[i] = bytes(letters[c] for c in token) if known else token.encode()
        super().__init__(spelled, "|")

    def lists(self, parts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast([" " + p for p in parts], add_special_tokens=False)]


class Pieces(_Side):
    """A SentencePiece vocabulary that puts a blank before the text itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        byte = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else None for i, p in enumerate(pieces)]
        if any(MARK in p.lstrip(MARK) for i, p in enumerate(pieces) if byte[i] is None):
            raise ValueError("a piece holds the blank mark after another character")
        super().__init__([b or p.replace(MARK, " ").encode() for p, b in zip(pieces, byte, strict=True)], ";")

    def lists(self, parts: list[str]) -> list[list[int]]:
        return self.library.encode(parts, num_threads=1)


def byte_letters() -> dict[str, int]:
    """The byte behind each letter of a byte-level vocabulary: printable ones stand for themselves, others follow 255."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def cuts(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the single blanks between two characters of a text that are none, and the bytes of all white space."""
    space = _SPACE[data]
    for lead in _WIDE_SPACES if (data >= 0x80).any() else ():
        found = np.flatnonzero((data[: len(data) - len(lead) + 1] == lead[0]) & (data[1 : len(data) - len(lead) + 2] == lead[1]))
        for k in range(2, len(lead)):
            found = found[data[found + k] == lead[k]]
        for k in range(len(lead)):
            space[found + k] = True
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[at] = True
    place = np.flatnonzero(data == 0x20)
    place = place[~edge[place] & ~edge[place + 1]]
    return place[~space[place - 1] & ~space[place + 1]], space


def _heads(key: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    return np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)


def _distinct(key: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct values in order, a place of each, which of them each item is, and how often each occurs."""
    order = np.argsort(key)
    head = _heads(key[order])
    count = np.diff(np.append(head, len(key)))
    inverse = np.empty(len(key), dtype=np.int64)
    inverse[order] = np.repeat(np.arange(len(head)), count)
    return key[order[head]], order[head], inverse, count


class Units:
    """Ids of the units met so far, on both sides, and whether both spell the unit byte for byte.

    A unit is looked up by a 64-bit digest, and what is found must spell the bytes that stand there. Beyond ``REMEMBERED``
    units those used most are kept, half as many.
    """

    def __init__(self, a: _Side, b: _Side):
        self.sides = a, b
        self.forget()

    def forget(self) -> None:
        self.key = np.zeros(0, dtype=np.uint64)
        #: By key: the unit's number, and how often it was used.
        self.number, self.used = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        self.good, self.size = np.zeros(0, dtype=bool), np.zeros(0, dtype=np.int64)
        self.flat = [np.zeros(0, dtype=np.int32) for _ in self.sides]
        self.at = [np.zeros(1, dtype=np.int64) for _ in self.sides]

    def _keep_frequent(self) -> None:
        order = np.sort(np.argsort(-self.used, kind="stable")[: REMEMBERED // 2])
        units = self.number[order]
        for side in range(len(self.sides)):
            ids, self.at[side] = self.ids(side, units)
            self.flat[side] = ids.astype(np.int32)
        self.key, self.used, self.number = self.key[order], self.used[order] // 2, np.arange(len(order))
        self.good, self.size = self.good[units], self.size[units]

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The units of all texts, one after the other, and where each text's begin."""
        raw = [t.encode() for t in texts]
        data = np.frombuffer(b"".join(raw), dtype=np.uint8)
        text_at = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
        if len(self.size) > REMEMBERED:
            self._keep_frequent()
        blank, space = cuts(data, text_at)
        # Every text begins a unit, an empty one too, and every blank that cuts.
        order = np.argsort(np.concatenate([text_at[:-1], blank]), kind="stable")
        start = np.concatenate([text_at[:-1], blank + 1])[order]
        end = np.concatenate([start[1:], text_at[-1:]])
        after = np.append(order[1:], 0) >= len(raw)
        end[after] -= 1
        at = np.concatenate([np.flatnonzero(order < len(raw)), [len(start)]]).astype(np.int64)
        key, one, inverse, count = _distinct(substring_hash(prefix_hash(data), start, end))
        place = np.searchsorted(self.key, key)
        new = np.append(self.key, np.uint64(0))[place] != key
        new |= place == len(self.key)
        self.used[place[~new]] += count[~new]
        if new.any():
            fresh = one[new]
            numbers = self._learn(data, space, start[fresh], end[fresh])
            keys = np.concatenate([self.key, key[new]])
            by_key = np.argsort(keys, kind="stable")
            self.key = keys[by_key]
            self.number = np.concatenate([self.number, numbers])[by_key]
            self.used = np.concatenate([self.used, count[new]])[by_key]
            place = np.searchsorted(self.key, key)
        units = self.number[place][inverse]
        odd = self._unlike(units, data, start, end)
        units[odd] = self._learn(data, space, start[odd], end[odd])
        return units, at

    def _unlike(self, units: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Places whose remembered unit does not spell what stands there: a broken unit, or another one of the same digest."""
        size = end - start
        like = self.good[units] & (self.size[units] == size)
        spelled = self.sides[0].bytes_of(self.ids(0, units[like])[0])
        n = size[like] + 1
        head = np.cumsum(n) - n
        inside = np.ones(len(spelled), dtype=bool)
        inside[head] = False
        differs = np.flatnonzero(inside)[spelled[inside] != data[ragged(start[like], n - 1)]]
        like[np.flatnonzero(like)[np.searchsorted(head, differs, "right") - 1]] = False
        return np.flatnonzero(~like & (size > 0))

    def _learn(self, data: np.ndarray, space: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Numbers of new units."""
        if not start.size:
            return np.zeros(0, np.int64)
        size = end - start
        joins = (size > 0) & (size < JOINED_BYTES)
        joins[joins] &= ~space[start[joins]] & ~space[end[joins] - 1]
        first = len(self.size)
        number = np.empty(len(size), dtype=np.int64)
        raw = data.tobytes()
        for chosen, encode in ((np.flatnonzero(joins), self._together), (np.flatnonzero(~joins), self._one_by_one)):
            number[chosen] = first + np.arange(len(chosen))
            first += len(chosen)
            k = 0
            while k < len(chosen):
                upto = np.searchsorted(np.cumsum(size[chosen[k:]] + 1), ENCODED_CHARS, "right")
                part = chosen[k : k + max(1, int(upto))]
                encode([raw[i:j].decode() for i, j in zip(start[part].tolist(), end[part].tolist(), strict=True)])
                k += len(part)
        return number

    def _together(self, units: list[str]) -> None:
        """Learns units that neither begin nor end with a blank: they stay what they are beside single blanks."""
        size = np.array([len(u.encode()) for u in units], dtype=np.int64) + 1
        line = (np.cumsum(size) - size) // JOINED_BYTES
        cut = np.concatenate([[0], np.flatnonzero(np.diff(line)) + 1, [len(units)]]).tolist()
        lines = [" ".join(units[i:j]) for i, j in zip(cut, cut[1:], strict=False)]
        whole = np.frombuffer("".join(" " + x for x in lines).encode(), dtype=np.uint8)
        ends, found = np.cumsum(size), []
        for side in self.sides:
            ids = np.concatenate([np.asarray(x, dtype=np.int32) for x in side.lists(lines)])
            token_ends = np.cumsum(side.width[ids])
            at = np.searchsorted(token_ends, ends)
            spelled = np.array_equal(side.bytes_of(ids), whole)
            if not (spelled and np.array_equal(token_ends[at], ends)):
                return self._one_by_one(units)
            found.append((ids, np.diff(np.concatenate([[-1], at]))))
        self._put(found, np.ones(len(units), dtype=bool), size - 1)

    def _one_by_one(self, units: list[str]) -> None:
        lists = [side.lists(units) for side in self.sides]
        whole = [(" " + u).encode() for u in units]
        good = [
            all(b"".join(map(side.spelled.__getitem__, ids)) == text for side, ids in zip(self.sides, both, strict=True))
            for both, text in zip(zip(*lists, strict=True), whole, strict=True)
        ]
        found = []
        for of_side in lists:
            n = np.array([len(x) for x in of_side], dtype=np.int64)
            found.append((np.fromiter((i for x in of_side for i in x), dtype=np.int32, count=int(n.sum())), n))
        self._put(found, np.array(good, dtype=bool), np.array([len(x) - 1 for x in whole], dtype=np.int64))

    def _put(self, found: list[tuple[np.ndarray, np.ndarray]], good: np.ndarray, size: np.ndarray) -> None:
        self.good, self.size = np.concatenate([self.good, good]), np.concatenate([self.size, size])
        for side, (ids, n) in enumerate(found):
            self.flat[side] = np.concatenate([self.flat[side], ids])
            self.at[side] = np.concatenate([self.at[side], self.at[side][-1] + np.cumsum(n)])

    def ids(self, side: int, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of units, one after the other, and where each unit's begin."""
        start = self.at[side][units]
        n = self.at[side][units + 1] - start
        return self.flat[side][ragged(start, n)].astype(np.int64), np.concatenate([[0], np.cumsum(n)])


@lru_cache(maxsize=2)
def worker_units(path_a: str, path_b: str) -> Units:
    return Units(ByteLevel(path_a), Pieces(path_b))


def diagonals(x: np.ndarray, y: np.ndarray, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """Where the merge of two sorted arrays (``x`` first among equals) crosses every ``piece``-th diagonal."""
    total = len(x) + len(y)
    at = np.append(np.arange(0, total, piece), total)
    low, high = np.maximum(0, at - len(y)), np.minimum(at, len(x))
    while (open_ := low < high).any():
        middle = (low + high) // 2
        k = np.flatnonzero(open_)
        more = np.zeros(len(at), dtype=bool)
        more[k] = x[middle[k]] <= y[at[k] - middle[k] - 1]
        low = np.where(more, middle + 1, low)
        high = np.where(open_ & ~more, middle, high)
    return low, at - low


@dataclass
class Links:
    """Overlaps in text order: the tokens on either side and the group, and how many groups were closed."""

    left: np.ndarray
    right: np.ndarray
    group: np.ndarray
    closed: int


def piece_links(x: np.ndarray, y: np.ndarray, i: slice, j: slice) -> Links:
    """Links of one piece of the merge of all ends; groups count from the piece's own first."""
    xs, ys = x[i], y[j]
    ends = np.concatenate([xs, ys])
    order = np.argsort(ends, kind="stable")
    ends, from_y = ends[order], order >= len(xs)
    left = i.start + np.cumsum(~from_y) - ~from_y
    right = j.start + np.cumsum(from_y) - from_y
    first = max(x[i.start - 1] if i.start else 0, y[j.start - 1] if j.start else 0)
    new = ends > np.concatenate([[first], ends[:-1]])  # a shared end is told once
    left, right, ends, from_x = left[new], right[new], ends[new], ~from_y[new]
    closes = np.zeros(len(ends), dtype=bool)
    closes[from_x] = y[right[from_x]] == ends[from_x]
    upto = np.cumsum(closes)
    return Links(left, right, upto - closes, int(upto[-1]) if len(upto) else 0)


def merge_links(x: np.ndarray, y: np.ndarray, piece: int = PIECE) -> Links:
    """Links of two sequences of increasing ends with the same last end, piece by piece, groups stitched."""
    at_x, at_y = diagonals(x, y, piece)
    found, closed = [], 0
    for k in range(len(at_x) - 1):
        links = piece_links(x, y, slice(at_x[k], at_x[k + 1]), slice(at_y[k], at_y[k + 1]))
        found.append((links.left, links.right, links.group + closed))
        closed += links.closed
    none = np.zeros(0, np.int64)
    return Links(*(map(np.concatenate, zip(*found, strict=True)) if found else (none, none, none)), closed)


@dataclass
class Alignment:
    """Tokens, links and groups of the texts of one block; ``*_at`` tell where each text's begin."""

    a: np.ndarray
    a_at: np.ndarray
    b: np.ndarray
    b_at: np.ndarray
    links: Links
    link_at: np.ndarray
    a_group: np.ndarray
    b_group: np.ndarray
    group_at: np.ndarray

    def digests(self, side_a: _Side, side_b: _Side) -> list[str]:
        """The groups of each text as ``a1,a2|b1;...``, hashed; empty without tokens."""
        n = int(self.group_at[-1])
        # A token stands behind all tokens of either side in the groups before its own.
        a_upto = np.cumsum(np.bincount(self.a_group, minlength=n))
        of_b = np.bincount(self.b_group, minlength=n)
        out = np.empty(len(self.a) + len(self.b), dtype=object)
        for side, ids, group, before in (
            (side_a, self.a, self.a_group, np.cumsum(of_b) - of_b),
            (side_b, self.b, self.b_group, a_upto),
        ):
            last = np.append(group[1:] != group[:-1], True) if len(group) else np.zeros(0, bool)
            out[np.arange(len(ids)) + before[group]] = np.where(last, side.last[ids], side.inner[ids])
        words, at = out.tolist(), (self.a_at + self.b_at).tolist()
        return [
            hashlib.sha256("".join(words[i:j])[:-1].encode()).hexdigest() if j > i else "" for i, j in zip(at, at[1:], strict=False)
        ]


def align_block(block: Block, known: Units, piece: int = PIECE) -> Alignment:
    texts = [block.text(k) for k in range(len(block))]
    units, at = known.of(texts)
    good = np.diff(block.at) > 0
    good[owners(at)[~known.good[units]]] = False
    for k, text in enumerate(texts):  # bytes that are no text
        if "\ufffd" in text:
            good[k] &= text.encode() == block.data[block.at[k] : block.at[k + 1]].tobytes()
    n = np.where(good, np.diff(at), 0)
    units = units[np.repeat(good, np.diff(at))]
    unit_at = np.concatenate([[0], np.cumsum(n)])
    (a, a_unit), (b, b_unit) = known.ids(0, units), known.ids(1, units)
    a_at, b_at = a_unit[unit_at], b_unit[unit_at]
    # Kept texts lie end to end on both sides, so every text's end closes a group.
    x, y = np.cumsum(known.sides[0].width[a]), np.cumsum(known.sides[1].width[b])
    links = merge_links(x, y, piece)
    shared = np.intersect1d(x, y, assume_unique=True)
    text_end = np.concatenate([[0], x])[a_at]
    return Alignment(
        a, a_at, b, b_at, links, np.searchsorted(links.left, a_at),
        np.searchsorted(shared, x), np.searchsorted(shared, y), np.searchsorted(shared, text_end, "right"),
    )


class _Chunk:
    """Rows and links of consecutive texts."""

    def __init__(self, number: int):
        self.number, self.bytes, self.rows, self.links, self.sizes = number, 0, [], [], []

    def add(self, ids: list, block: Block, found: Alignment, side_a: _Side, side_b: _Side) -> None:
        n = np.diff(found.link_at)
        counts = (np.diff(found.a_at).tolist(), np.diff(found.b_at).tolist(), np.diff(found.group_at).tolist(), n.tolist())
        self.rows += zip(ids, *counts, found.digests(side_a, side_b), strict=True)
        self.links.append(found.a[found.links.left] << 32 | found.b[found.links.right])
        self.sizes.append(n)
        self.bytes += len(block.data)

    def batch(self) -> pa.RecordBatch:
        """A row per text with its places among the chunk's id pairs, and one row with the pairs themselves."""
        links, sizes = np.concatenate(self.links), np.concatenate(self.sizes)
        row = np.repeat(np.arange(len(sizes)), sizes)
        # Id pair and row in one number, so that one sort brings equal pairs together, and their rows.
        row_bits, low_bits = len(sizes).bit_length(), int((links & _LOW).max(initial=0)).bit_length()
        key = np.sort(((links >> 32 << low_bits) | (links & _LOW)) << row_bits | row)
        head = _heads(key)
        times, key = np.diff(np.append(head, len(key))), key[head]
        first = _heads(key >> row_bits)
        place = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(key))))
        totals = np.add.reduceat(times, first) if len(first) else times
        pairs = key[first] >> row_bits
        pairs = pairs >> low_bits << 32 | pairs & ((1 << low_bits) - 1)
        row = (key & ((1 << row_bits) - 1)).astype(np.uint16 if row_bits <= 16 else np.int64)
        by_row = np.argsort(row, kind="stable")
        place, times = place[by_row], times[by_row]
        at = np.searchsorted(row[by_row], np.arange(len(sizes) + 1, dtype=np.int64))
        n, none = len(self.rows), pa.array([None], pa.int64())
        columns = list(map(list, zip(*self.rows, strict=True)))

        def per_text(values: np.ndarray) -> pa.Array:
            lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values, pa.int32()))
            return pa.concat_arrays([lists, pa.array([None], pa.list_(pa.int32()))])

        def of_chunk(values: np.ndarray) -> pa.Array:
            return pa.concat_arrays([pa.nulls(n, pa.list_(pa.int64())), pa.array([values], pa.list_(pa.int64()))])

        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(n + 1, self.number)),
                *[pa.concat_arrays([pa.array(c, pa.int64()), none]) for c in columns[:5]],
                pa.array([*columns[5], None], pa.string()),
                per_text(place),
                per_text(times),
                of_chunk(pairs),
                of_chunk(totals),
            ],
            schema=_PART,
        )


def parts(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """``PART``: the rows of every text, and a row of id pairs for every chunk of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = worker_units(path_a, path_b)
        # A task that is run again numbers its chunks the same.
        number = TaskContext.get().partitionId() << 32
        chunk = _Chunk(number)
        for batch in batches:
            ids = batch.column("doc_id").cast(pa.int64()).to_pylist()
            for block in blocks(batch.column("text"), BLOCK):
                if chunk.rows and (chunk.bytes + len(block.data) > CHUNK_BYTES or len(chunk.rows) + len(block) > CHUNK_ROWS):
                    yield chunk.batch()
                    number += 1
                    chunk = _Chunk(number)
                chunk.add(ids[block.rows], block, align_block(block, known), *known.sides)
        if chunk.rows:
            yield chunk.batch()

    return arrow_map(docs.select("doc_id", "text"), run, PART)


def link_counts(pairs: DataFrame) -> DataFrame:
    """``pair, count, best`` from rows ``pair, total``: links of an id pair, and whether its B id has no pair with more."""
    counts = pairs.groupBy("pair").agg(F.sum("total").alias("count")).withColumn("b", F.expr("pair & 4294967295"))
    # A row per B id at most: bounded by the vocabulary.
    highest = F.broadcast(counts.groupBy("b").agg(F.max("count").alias("highest")))
    return counts.join(highest, "b").select("pair", "count", (F.col("count") == F.col("highest")).alias("best"))


def _rated(texts: pa.Table, pairs: pa.Table) -> pa.Table:
    """Rows of a chunk's texts with the sums over their links."""
    n = texts.num_rows
    count, best = np.zeros(pairs.num_rows, dtype=np.int64), np.zeros(pairs.num_rows, dtype=np.int64)
    at = pairs["place"].to_numpy()
    count[at], best[at] = pairs["count"].to_numpy(), pairs["best"].to_numpy().astype(np.int64)
    lists = texts["place"].combine_chunks()
    row = np.repeat(np.arange(n), lists.value_lengths().to_numpy(zero_copy_only=False))
    place, times = lists.flatten().to_numpy(), texts["times"].combine_chunks().flatten().to_numpy().astype(np.int64)

    def per_row(values: np.ndarray) -> np.ndarray:
        out = np.zeros(n, dtype=np.int64)
        np.add.at(out, row, values[place] * times)
        return out

    columns = {"n_best": per_row(best), "count_sum": per_row(count)}
    return pa.Table.from_arrays(
        [pa.chunked_array([columns[f.name]]) if f.name in columns else texts[f.name] for f in _ALIGNED], schema=_ALIGNED
    )


def align(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """``ALIGNED``: tokens, groups and links of every text, with what the corpus says about the links."""
    ship(docs.sparkSession)
    part = stored(parts(docs, path_a, path_b), "alignment")
    pairs = part.filter("pairs IS NOT NULL").select(
        F.col("chunk").alias("of_chunk"), F.posexplode(F.arrays_zip("pairs", "totals")).alias("place", "p")
    )
    pairs = pairs.select("of_chunk", "place", F.col("p.pairs").alias("pair"), F.col("p.totals").alias("total"))
    counts = stored(link_counts(pairs), "link-counts")
    rated = pairs.join(counts, "pair").select("of_chunk", "place", "count", "best")
    texts = part.filter("pairs IS NULL").drop("pairs", "totals")
    return texts.groupBy("chunk").cogroup(rated.groupBy("of_chunk")).applyInArrow(_rated, ALIGNED)
