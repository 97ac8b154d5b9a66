"""Whole texts of an Arrow batch as flat numpy arrays: bytes, words, word hashes and shingle hashes.

Words are maximal runs of bytes other than blank and ``\\x09``-``\\x0D``. Nothing here needs Spark; the
operators call it inside ``mapInArrow``, where Spark has already split the rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes of text handled at once inside a task; a longer single text is a block of its own.
BLOCK_BYTES = 1 << 20

_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_UNBASE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U64(33))
    x = x * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


_SYMBOLS = mix(np.arange(1, 257, dtype=U64))
_LOWER = _SYMBOLS.copy()
_LOWER[65:91] = _SYMBOLS[97:123]


class _Powers:
    """Powers of the hash base and of its inverse, grown to the longest block a worker has met."""

    up = np.ones(1, dtype=U64)
    down = np.ones(1, dtype=U64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, BLOCK_BYTES)
            step = np.full(size, _BASE, dtype=U64)
            step[0] = 1
            cls.up = np.cumprod(step, dtype=U64)
            step[1:] = U64(_UNBASE)
            cls.down = np.cumprod(step, dtype=U64)
        return cls.up[:n], cls.down[:n]


@dataclass
class Block:
    """Consecutive rows of a batch. ``at`` has one entry more than rows: where each text begins in ``data``."""

    rows: slice
    data: np.ndarray
    at: np.ndarray

    def __len__(self) -> int:
        return len(self.at) - 1

    def text(self, k: int) -> str:
        return self.data[self.at[k] : self.at[k + 1]].tobytes().decode("utf-8", "replace")


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """The texts of a column, NULL as empty, in blocks of about ``limit`` bytes."""
    if column.null_count:
        column = column.fill_null("")
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if not len(column):
        return
    ends = np.frombuffer(column.buffers()[1], dtype=width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    k = 0
    while k < len(column):
        stop = max(k + 1, int(np.searchsorted(ends, ends[k] + limit, "right")) - 1)
        stop = min(stop, len(column))
        yield Block(slice(k, stop), data[ends[k] : ends[stop]], ends[k : stop + 1] - ends[k])
        k = stop


def prefix_hash(data: np.ndarray, lower: bool = False) -> np.ndarray:
    """One entry more than bytes; ``substring_hash`` reads it."""
    up, _ = _Powers.upto(len(data) + 1)
    out = np.zeros(len(data) + 1, dtype=U64)
    np.cumsum((_LOWER if lower else _SYMBOLS)[data] * up[: len(data)], out=out[1:])
    return out


def substring_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of ``data[start:end]``, equal for equal bytes wherever they lie."""
    _, down = _Powers.upto(len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(U64))


@dataclass
class Words:
    start: np.ndarray
    end: np.ndarray
    #: Where each text's words begin, one entry more than texts.
    at: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.at)


def words(block: Block) -> Words:
    inside = ~_BLANK[block.data]
    edge = np.zeros(len(inside) + 1, dtype=bool)
    edge[block.at] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last[:-1] &= ~inside[1:] | edge[1:-1]
    start = np.flatnonzero(first)
    return Words(start, np.flatnonzero(last) + 1, np.searchsorted(start, block.at))


def owners(at: np.ndarray) -> np.ndarray:
    """The row of each item, given where each row's items begin."""
    return np.repeat(np.arange(len(at) - 1), np.diff(at))


def windows(hashes: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``size``-item windows that stay within a row, and where each row's windows begin."""
    n = np.maximum(np.diff(at) - (size - 1), 0)
    out_at = np.concatenate([[0], np.cumsum(n)])
    if len(hashes) < size:
        return np.zeros(0, U64), out_at
    whole = np.zeros(len(hashes) - size + 1, dtype=U64)
    factor = 1
    for k in range(size):
        factor = factor * _BASE % (1 << 64)
        whole += hashes[k : k + len(whole)] * U64(factor)
    return mix(whole[np.repeat(at[:-1] - out_at[:-1], n) + np.arange(out_at[-1])]), out_at


def ragged(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Indices ``start[k] .. start[k] + count[k] - 1`` for all k, one after the other."""
    ends = np.cumsum(count)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(start - (ends - count), count) + np.arange(total)


def table(schema: pa.Schema, columns: Iterable) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(columns, schema, strict=True)],
        schema=schema,
    )
