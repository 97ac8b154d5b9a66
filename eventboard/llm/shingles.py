"""Sets of five-word shingles and their MinHash signatures, as flat arrays.

Words are lower-cased (A-Z only) runs of bytes other than blank and ``\\x09``-``\\x0D``. A text with fewer than five
words has its whole sequence as one shingle, a text without words has none.
"""

from __future__ import annotations

import numpy as np

from eventboard.llm.arrays import U64, Block, mix, owners, prefix_hash, substring_hash, windows, words

SIZE = 5
VALUES = 128
_ODD = mix(np.arange(1, VALUES + 1, dtype=U64)) | U64(1)
_PLUS = mix(np.arange(1001, VALUES + 1001, dtype=U64))


def shingle_sets(block: Block, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, sorted within each text, and where each text's begin."""
    w = words(block)
    hashes = substring_hash(prefix_hash(block.data, lower=True), w.start, w.end)
    full, at = windows(hashes, w.at, size)
    row = owners(at)
    for short in range(1, size):  # the few texts that are one shingle of fewer words
        texts = np.flatnonzero(w.counts == short)
        if texts.size:
            whole = mix(sum((hashes[w.at[texts] + k] * U64(2 * k + 3) for k in range(short)), np.zeros(len(texts), U64)) + U64(short))
            full, row = np.concatenate([full, whole]), np.concatenate([row, texts])
    order = np.lexsort((full, row))
    full, row = full[order], row[order]
    new = np.ones(len(full), dtype=bool)
    new[1:] = (full[1:] != full[:-1]) | (row[1:] != row[:-1])
    return full[new], np.searchsorted(row[new], np.arange(len(block) + 1))


def set_keys(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Two 64-bit digests of each set, equal for equal sets."""
    out = np.zeros((len(at) - 1, 2), dtype=U64)
    some = np.flatnonzero(np.diff(at))
    if some.size:
        for k, salt in enumerate((0x51ED2701, 0xA24BAED4)):
            out[some, k] = np.add.reduceat(mix(values ^ U64(salt)), at[some])
    return out


def signatures(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The smallest of each of ``VALUES`` hashes over each set, 32 bits each; zeros for empty sets."""
    out = np.zeros((len(at) - 1, VALUES), dtype=np.uint32)
    some = np.flatnonzero(np.diff(at))
    if some.size:
        for k in range(VALUES):
            out[some, k] = np.minimum.reduceat((values * _ODD[k] + _PLUS[k]) >> U64(32), at[some])
    return out


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Shared values of two sorted distinct arrays."""
    return int(np.count_nonzero(np.isin(a, b, assume_unique=True, kind="sort")))
