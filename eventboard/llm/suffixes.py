"""Suffix arrays of byte strings by Larsson-Sadakane refinement, and Kasai common prefixes, in numpy."""

from __future__ import annotations

import numpy as np

U64 = np.uint64


def packed(data: np.ndarray, pad: int) -> np.ndarray:
    """The 8 bytes at each place as one big-endian number; zeros follow the data."""
    wide = np.concatenate([data, np.zeros(pad + 8, np.uint8)]).astype(U64)
    out = np.zeros(len(data) + pad, dtype=U64)
    for k in range(8):
        out = out << U64(8) | wide[k : k + len(out)]
    return out


def suffix_array(eight: np.ndarray, n: int) -> np.ndarray:
    """Places 0 to n - 1 in the order of their suffixes.

    Ranks by the first h bytes refine to ranks by 2h: only groups of equal rank are sorted again, by the rank of
    the place h further on.
    """
    order = np.argsort(eight[:n], kind="stable")
    first = eight[order]
    new = np.ones(n, dtype=bool)
    new[1:] = first[1:] != first[:-1]
    head = np.flatnonzero(new)
    # A group's rank is the place of its last member, so that refining it never changes other groups' ranks.
    rank = np.zeros(n + 1, dtype=np.int64)
    rank[order] = np.repeat(np.append(head[1:], n) - 1, np.diff(np.append(head, n)))
    rank[n] = -1
    group = rank[order]
    h = 8
    while True:
        size = np.diff(np.append(head, n))
        alone = np.repeat(size == 1, size)
        open_ = np.flatnonzero(~alone)
        if not open_.size:
            break
        member = order[open_]
        further = rank[np.minimum(member + h, n)]
        sort = np.lexsort((further, group[open_]))
        member, further, old = member[sort], further[sort], group[open_]
        order[open_] = member
        same = np.zeros(n, dtype=bool)
        same[open_[1:]] = (further[1:] == further[:-1]) & (old[1:] == old[:-1]) & (open_[1:] == open_[:-1] + 1)
        head = np.flatnonzero(~same)
        group = np.repeat(np.append(head[1:], n) - 1, np.diff(np.append(head, n)))
        rank[order] = group
        h *= 2
    return order


def common_prefixes(eight: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """For each place, bytes it shares with its predecessor in the suffix array, counted up to ``depth``.

    A place shares at least one byte less than the place before it. So places a stride apart are compared first and bound
    those between them, stride by stride; all places of a stride are compared together, eight bytes at a time.
    """
    n = len(order)
    before = np.full(n, -1, dtype=np.int64)
    before[order[1:]] = order[:-1]
    shared = np.zeros(n, dtype=np.int64)
    stride = 64
    while stride >= 1:
        at = np.arange(0, n, stride) if stride == 64 else np.arange(stride, n, 2 * stride)
        if stride < 64:
            shared[at] = np.maximum(shared[at - stride] - stride, 0)
        at = at[before[at] >= 0]
        while at.size:
            at = at[shared[at] < depth]
            x = np.minimum(at + shared[at], len(eight) - 1)
            y = np.minimum(before[at] + shared[at], len(eight) - 1)
            differ = eight[x] ^ eight[y]
            shared[at] += _leading_zero_bytes(differ)
            at = at[differ == 0]
        stride //= 2
    return np.minimum(shared, depth)


def _leading_zero_bytes(x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x), dtype=np.int64)
    clear = np.ones(len(x), dtype=bool)
    for k in range(8):
        clear &= (x >> U64(56 - 8 * k)) & U64(0xFF) == 0
        out += clear
    return out
