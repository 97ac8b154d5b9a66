"""Encoding and decoding with merge-type SentencePiece vocabularies.

Adjacent symbols are merged in the order of an agenda: the pair whose joined piece has the best score goes first,
the leftmost among equals, until no neighbours form a piece; symbols outside the vocabulary fall back to bytes.
No piece holds the blank mark after another character, so a merge never crosses the start of a run of blanks:
texts are cut there into units, each distinct unit runs through the agenda once, and its ids are dealt to all its
occurrences in the blocks that a worker meets (a bounded memory; forgetting costs time only). Short units share one vectorised agenda (every round merges the best pair of each
unit), long ones have a heap of their own.

Of every Arrow batch, the units that the worker meets for the first time are encoded by the sentencepiece library too, and a
difference raises; so every unit of every text has been checked. With ``verify=True`` whole texts are encoded and decoded by
the library once more, which the tests do.

Defined results: a NULL or empty text has only the end id and decodes to an empty text. A NULL ``doc_id``,
repeated rows and very long texts are encoded like any other. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from eventboard.llm.arrays import Block, blocks, prefix_hash, ragged, substring_hash, table
from eventboard.llm.scratch import arrow_map

MARK = "▁"
#: Ids of symbols that are characters but no pieces start here, by code point.
OUTSIDE = 1 << 21
#: Units with more characters than this get a heap; the others share the vectorised agenda.
LONG_UNIT = 48
#: Units a worker remembers from one block to the next before it starts anew.
REMEMBERED = 600_000
NEVER = np.iinfo(np.int32).max

DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_unit_tokens long"
_DIGESTS = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_tokens", pa.int64()),
        ("ids_sha256", pa.string()),
        ("decoded_sha256", pa.string()),
        ("n_unit_tokens", pa.int64()),
    ]
)


class Vocabulary:
    """The tables of one model file, read through the library; all encoding and decoding is done here."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size, self.end = sp.get_piece_size(), sp.eos_id()
        pieces = [sp.id_to_piece(i) for i in range(self.size)]
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) for i in range(self.size)]
        normal = {p: i for i, p in enumerate(pieces) if not special[i]}
        if any(MARK in p.lstrip(MARK) for p in normal):
            raise ValueError("a piece holds the blank mark after another character")
        #: Rank of a piece in the agenda: equal scores share a rank.
        scores = np.array([sp.get_score(i) for i in range(self.size)])
        self.rank = np.append(np.searchsorted(np.unique(-scores), -scores), NEVER).astype(np.int32)  # last: no piece
        self.byte = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], dtype=np.int64)
        self.symbol = np.arange(OUTSIDE, OUTSIDE + 0x110000, dtype=np.int64)
        for p, i in normal.items():
            if len(p) == 1:
                self.symbol[ord(p)] = i

        def known(part: str) -> int | None:
            return normal.get(part, int(self.symbol[ord(part)]) if len(part) == 1 else None)

        self.pairs: dict[tuple[int, int], int] = {}
        for p, i in normal.items():
            for k in range(1, len(p)):
                a, b = known(p[:k]), known(p[k:])
                if a is not None and b is not None:
                    self.pairs[a, b] = i
        self._fill_slots()
        self.memory = self._nothing()
        self.text = [self._surface(p, i, special[i]) for i, p in enumerate(pieces)]
        self.number = [str(i) for i in range(self.size)]

    def _surface(self, piece: str, i: int, special: bool) -> bytes:
        if self.library.is_byte(i):
            return bytes([int(piece[3:5], 16)])
        return b"" if special else piece.replace(MARK, " ").encode()

    def _fill_slots(self) -> None:
        """An open-addressed table of the pairs, read by ``joined`` for whole arrays."""
        self.bits = (4 * len(self.pairs)).bit_length()
        self.slot_key = np.full(1 << self.bits, -1, dtype=np.int64)
        self.slot_piece = np.zeros(1 << self.bits, dtype=np.int32)
        key = np.array([a << 22 | b for a, b in self.pairs], dtype=np.int64)
        piece = np.array(list(self.pairs.values()), dtype=np.int32)
        place = self._place(key)
        while len(key):
            free = self.slot_key[place] < 0
            _, first = np.unique(place, return_index=True)
            lucky = np.zeros(len(key), dtype=bool)
            lucky[first] = True
            lucky &= free
            self.slot_key[place[lucky]], self.slot_piece[place[lucky]] = key[lucky], piece[lucky]
            key, piece = key[~lucky], piece[~lucky]
            place = (place[~lucky] + 1) & ((1 << self.bits) - 1)

    def _place(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def joined(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that two neighbouring symbols form, -1 for none."""
        key = left.astype(np.int64) << 22 | right
        place = self._place(key)
        out = np.full(key.shape, -1, dtype=np.int32)
        open_ = np.arange(key.size)
        key, place, flat = key.ravel(), place.ravel(), out.ravel()
        while open_.size:
            at = self.slot_key[place[open_]]
            hit = at == key[open_]
            flat[open_[hit]] = self.slot_piece[place[open_[hit]]]
            open_ = open_[~hit & (at >= 0)]
            place[open_] = (place[open_] + 1) & ((1 << self.bits) - 1)
        return flat.reshape(out.shape)

    # -- agenda ------------------------------------------------------------------------------------

    def merge_long(self, symbols: list[int]) -> list[int]:
        """The agenda of one unit, as a heap of (rank, place)."""
        symbols = list(symbols)
        after, before = list(range(1, len(symbols) + 1)), list(range(-1, len(symbols) - 1))
        heap: list[tuple[int, int, int, int, int]] = []

        def propose(i: int) -> None:
            j = after[i]
            if j < len(symbols) and (piece := self.pairs.get((symbols[i], symbols[j]))) is not None:
                heapq.heappush(heap, (int(self.rank[piece]), i, symbols[i], symbols[j], piece))

        for i in range(len(symbols) - 1):
            propose(i)
        while heap:
            _, i, left, right, piece = heapq.heappop(heap)
            j = after[i]
            if symbols[i] != left or j >= len(symbols) or symbols[j] != right:
                continue
            symbols[i], symbols[j] = piece, -1
            after[i] = after[j]
            if after[j] < len(symbols):
                before[after[j]] = i
            if before[i] >= 0:
                propose(before[i])
            propose(i)
        return [s for s in symbols if s >= 0]

    def merge_short(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The agendas of many units at once, from rows padded with -1: the ids left and the row of each."""
        rows = np.arange(len(symbols))
        piece = np.full((len(symbols), symbols.shape[1] - 1), -1, dtype=np.int32)
        both = symbols[:, 1:] >= 0
        piece[both] = self.joined(symbols[:, :-1][both], symbols[:, 1:][both])
        ids, which = [], []
        while len(rows):
            rank = self.rank[piece]
            best = rank.argmin(axis=1) if piece.shape[1] else np.zeros(len(rows), np.int64)
            going = rank[np.arange(len(rows)), best] < NEVER if piece.shape[1] else np.zeros(len(rows), bool)
            if not going.all():
                left = symbols[~going]
                there = left >= 0
                ids.append(left[there])
                which.append(np.repeat(rows[~going], there.sum(axis=1)))
                rows, symbols, piece, best = rows[going], symbols[going], piece[going], best[going]
            n, width = symbols.shape
            if not n:
                break
            at = np.arange(n)
            symbols[at, best] = piece[at, best]
            # Every unit loses the place to the right of its merged pair, so the rows stay of one width.
            symbols = symbols[np.arange(width) != best[:, None] + 1].reshape(n, width - 1)
            piece = piece[np.arange(width - 1) != best[:, None]].reshape(n, width - 2)
            for place, ok in ((best - 1, best > 0), (best, best < width - 2)):
                r, c = at[ok], place[ok]
                right = symbols[r, c + 1]
                found = self.joined(symbols[r, c], right)
                piece[r, c] = np.where(right >= 0, found, -1)
        return (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (ids, which))

    # -- units -------------------------------------------------------------------------------------

    def encode_units(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the units ``mark + data[start:end]``, one after the other, and how many each has."""
        size = end - start
        raw = data[ragged(start, size)]
        points = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
        points[points == 0x20] = ord(MARK)
        heads = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
        cut = heads[np.concatenate([[0], np.cumsum(size)])]
        chars = np.diff(cut) + 1
        ids: list[np.ndarray] = []
        which: list[np.ndarray] = []
        symbol = self.symbol[points]
        mark = int(self.symbol[ord(MARK)])
        bounds = [1, 4, 6, 8, 10, 12, 16, 24, LONG_UNIT]
        for low, high in zip([0, *bounds], bounds, strict=False):
            pick = np.flatnonzero((chars > low) & (chars <= high))
            for part in np.array_split(pick, len(pick) * high // 400_000 + 1):
                if not part.size:
                    continue
                grid = np.full((len(part), high), -1, dtype=np.int32)
                grid[:, 0] = mark
                n = chars[part] - 1
                grid[np.repeat(np.arange(len(part)), n), 1 + ragged(np.zeros_like(n), n)] = symbol[ragged(cut[part], n)]
                merged, row = self.merge_short(grid)
                ids.append(merged)
                which.append(part[row])
        for u in np.flatnonzero(chars > LONG_UNIT):
            merged = self.merge_long([mark, *symbol[cut[u] : cut[u + 1]].tolist()])
            ids.append(np.array(merged, dtype=np.int64))
            which.append(np.full(len(merged), u))
        flat = np.concatenate(ids) if ids else np.zeros(0, np.int64)
        unit = np.concatenate(which) if which else np.zeros(0, np.int64)
        order = np.argsort(unit, kind="stable")
        flat, unit = flat[order], unit[order]
        if (flat >= OUTSIDE).any():
            flat, unit = self._bytes(flat, unit)
        return flat, np.bincount(unit, minlength=len(start))

    def _bytes(self, flat: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters without a piece become the ids of their UTF-8 bytes."""
        code = flat - OUTSIDE
        n = np.where(code < 0, 1, 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF))
        out = np.repeat(flat, n)
        first = np.cumsum(n) - n
        for k in np.flatnonzero(code >= 0):
            out[first[k] : first[k] + n[k]] = self.byte[list(chr(code[k]).encode())]
        return out, np.repeat(unit, n)

    def _recall(self, unit: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
        """An array of ids, and where in it each unit's ids lie; units of earlier blocks are remembered."""
        known, where, count, ids = self.memory
        if len(known) > REMEMBERED:
            known, where, count, ids = self.memory = self._nothing()
        at = np.minimum(np.searchsorted(known, unit), max(len(known) - 1, 0))
        new = known[at] != unit if len(known) else np.ones(len(unit), dtype=bool)
        if new.any():
            more, n = self.encode_units(data, start[new], end[new])
            self._check_units(data, start[new], end[new], more, n)
            known = np.concatenate([known, unit[new]])
            order = np.argsort(known, kind="stable")
            where = np.concatenate([where, len(ids) + np.cumsum(n) - n])[order]
            count = np.concatenate([count, n])[order]
            self.memory = known, where, count, ids = known[order], where, count, np.concatenate([ids, more])
            at = np.searchsorted(known, unit)
        return ids, where[at], count[at]

    def _check_units(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, ids: np.ndarray, n: np.ndarray) -> None:
        """Raises unless the library gives the units the same ids; it puts the mark before them itself."""
        some = end > start  # a mark alone is no text to it
        raw = data.tobytes()
        texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(start[some].tolist(), end[some].tolist(), strict=True)]
        theirs = self.library.encode(texts, num_threads=1) if texts else []
        size = np.array([len(x) for x in theirs], dtype=np.int64)
        own = ids[np.repeat(some, n)]
        flat = np.fromiter((i for x in theirs for i in x), dtype=np.int64, count=int(size.sum()))
        if not (np.array_equal(size, n[some]) and np.array_equal(flat, own)):
            wrong = next(t for t, a, b in zip(texts, theirs, np.split(own, np.cumsum(n[some])[:-1]), strict=True) if a != b.tolist())
            raise ValueError(f"encoding differs from the library for the unit {wrong[:80]!r}")

    @staticmethod
    def _nothing() -> tuple[np.ndarray, ...]:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def encode(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a block without end ids, and where each text's ids begin."""
        data, at = block.data, block.at
        blank = data == 0x20
        start = blank.copy()
        start[1:] &= ~blank[:-1]
        first = at[:-1][at[1:] > at[:-1]]  # the unit that begins with the text has no blank to drop
        start[first] = True
        skip = np.ones(len(data), dtype=np.int64)
        skip[first] = 0
        begin = np.flatnonzero(start)
        if not begin.size:
            return np.zeros(0, np.int64), np.zeros(len(at), np.int64)
        end = np.append(begin[1:], len(data))
        begin = begin + skip[begin]
        prefix = prefix_hash(data)
        unit, one, inverse = np.unique(substring_hash(prefix, begin, end), return_index=True, return_inverse=True)
        ids, where, count = self._recall(unit, data, begin[one], end[one])
        count, where = count[inverse], where[inverse]
        out = ids[ragged(where, count)]
        total = np.concatenate([[0], np.cumsum(count)])
        return out, total[np.searchsorted(np.flatnonzero(start), at)]

    def decode(self, ids: list[int]) -> bytes:
        """The text of ids: marks are blanks, the one before the text goes, broken byte runs are replaced."""
        out = b"".join(map(self.text.__getitem__, ids))
        return out[1:] if out[:1] == b" " and ids and self.text[ids[0]][:1] == b" " else out


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _unmarked(column: pa.Array) -> pa.Array:
    """A blank mark that a text itself holds means the same as a blank."""
    import pyarrow.compute as pc

    if pc.any(pc.match_substring(column, MARK)).as_py():
        return pc.replace_substring(column, MARK, " ")
    return column


def _check(vocab: Vocabulary, texts: list[str], rows: list[tuple[int, list[int], bytes]]) -> None:
    ids = vocab.library.encode(texts, add_eos=True, num_threads=1)
    decoded = vocab.library.decode(ids, num_threads=1) if ids else []
    for text, (_, own_ids, own_text), their_ids, their_text in zip(texts, rows, ids, decoded, strict=True):
        if own_ids != their_ids or own_text.decode("utf-8", "replace") != their_text:
            raise ValueError(f"encoding differs from the library for a text that begins with {text[:80]!r}")


def encode_column(vocab: Vocabulary, column: pa.Array, verify: bool = False) -> Iterator[tuple[int, list[int], bytes]]:
    """Tokens without the end id, all ids and the decoded text of each row."""
    for block in blocks(_unmarked(column.fill_null(""))):
        flat, at = vocab.encode(block)
        rows = []
        for k in range(len(block)):
            ids = flat[at[k] : at[k + 1]].tolist()
            rows.append((len(ids), [*ids, vocab.end], vocab.decode(ids)))
        if verify:
            _check(vocab, [block.text(k) for k in range(len(block))], rows)
        yield from rows


def tokens(docs: DataFrame, model: str, verify: bool = False) -> DataFrame:
    """``doc_id, ids, decoded`` of every text, with an end id."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(model)
        for batch in batches:
            rows = [(i, d.decode("utf-8", "replace")) for _, i, d in encode_column(vocab, batch.column("text"), verify)]
            yield table(schema, [batch.column("doc_id").cast(pa.int64()), [r[0] for r in rows], [r[1] for r in rows]])

    return arrow_map(docs.select("doc_id", "text"), run, "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame, model: str, verify: bool = False) -> DataFrame:
    """``DIGESTS`` of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(model)
        for batch in batches:
            rows = []
            for n, ids, decoded in encode_column(vocab, batch.column("text"), verify):
                listed = " ".join(map(vocab.number.__getitem__, ids)).encode()
                if not decoded.isascii():
                    decoded = decoded.decode("utf-8", "replace").encode()
                rows.append((n + 1, hashlib.sha256(listed).hexdigest(), hashlib.sha256(decoded).hexdigest(), n))
            yield table(_DIGESTS, [batch.column("doc_id").cast(pa.int64()), *map(list, zip(*rows, strict=True) if rows else [[]] * 4)])

    return arrow_map(docs.select("doc_id", "text"), run, DIGESTS)
