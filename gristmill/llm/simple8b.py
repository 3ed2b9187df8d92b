"""Simple-8b: word-aligned coding of whole numbers, in blocks that can be read on their own.

Each 64-bit word holds a 4-bit selector (high bits) and 60 bits of payload. Selectors 1 to 15 pack so
many values of so many bits, first value lowest; selectors 1 and 2 stand for runs of zeros. Selector 0
is the escape: its payload is the number of 64-bit words that follow with one raw value each, for
values of over 30 bits. A block holds BLOCK values (the last may be shorter); a table gives the word
at which each block begins, so any block can be decoded alone, all words of a selector at once.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
# Values in a word and bits of a value, by selector from 1.
COUNTS = (240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2)
BITS = (0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30)
BLOCK = 4096
#: Values from here on are escaped.
_WIDE = U(1 << 30)


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words and the word at which each block begins, of an array of unsigned values."""
    words: list[np.ndarray] = []
    starts = []
    at = 0
    for k in range(0, len(values), BLOCK):
        starts.append(at)
        w = _encode_block(values[k : k + BLOCK].astype(np.uint64))
        words.append(w)
        at += len(w)
    return (np.concatenate(words) if words else np.empty(0, np.uint64)), np.asarray(starts, np.uint32)


def _plan(v: np.ndarray) -> list[int]:
    """For each position the selector that packs most of what follows, 0 where the value is too wide.

    The largest value of the next c positions comes from that of the next p <= c <= 2 p.
    """
    n = len(v)
    best = np.zeros(n, np.int64)
    index = np.arange(n)
    top, have = v, 1
    for s in range(15, 0, -1):
        c = COUNTS[s - 1]
        if c > n:
            break
        top = np.maximum(top[: n - c + 1], top[c - have : c - have + n - c + 1])
        have = c
        fits = top < (U(1) << U(BITS[s - 1]))
        if not fits.any():  # nor do more values of fewer bits fit
            break
        best[: n - c + 1][fits] = s
    # At the end of a block the widest layout that holds what is left, padded with zeros. A value that
    # stands alone before a wide one is escaped with it.
    room = np.minimum.accumulate(np.where(v >= _WIDE, index, n)[::-1])[::-1] - index
    short = (best == 0) & (room > 0) & (index + room == n)
    for i in np.flatnonzero(short):
        left, top = int(room[i]), int(v[i : i + int(room[i])].max())
        best[i] = next(s for s in range(1, 16) if (1 << BITS[s - 1]) > top and COUNTS[s - 1] >= left)
    return best.tolist()


def _encode_block(v: np.ndarray) -> np.ndarray:
    plan, n, i = _plan(v), len(v), 0
    at, sel = [], []
    while i < n:
        s = plan[i]
        at.append(i)
        sel.append(s)
        if s:
            i += COUNTS[s - 1]
        else:
            while i < n and not plan[i]:
                i += 1
    at_a, sel_a = np.asarray(at), np.asarray(sel)
    raw = sel_a == 0
    end = np.minimum(np.append(at_a[1:], n), n)
    size = np.where(raw, 1 + end - at_a, 1)
    place = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint64)
    padded = np.concatenate((v, np.zeros(240, np.uint64)))
    for s in np.unique(sel_a[~raw]):
        mine = np.flatnonzero(sel_a == s)
        word = np.full(len(mine), U(int(s)) << U(60), np.uint64)
        bits = BITS[s - 1]
        if bits:
            for j in range(COUNTS[s - 1]):
                word |= padded[at_a[mine] + j] << U(j * bits)
        out[place[mine]] = word
    for k in np.flatnonzero(raw):
        a, b, p = at_a[k], end[k], place[k]
        out[p] = U(int(b - a))
        out[p + 1 : p + 1 + b - a] = v[a:b]
    return out


def _decode_block(w: np.ndarray, n: int) -> np.ndarray:
    sel = (w >> U(60)).astype(np.int64)
    if (sel == 0).any():  # raw values look like words: walk over the escapes
        raw, skip, i = np.zeros(len(w), bool), np.zeros(len(w), bool), 0
        zero = np.flatnonzero(sel == 0)
        while True:
            k = np.searchsorted(zero, i)
            if k == len(zero):
                break
            i = int(zero[k])
            many = int(w[i])
            skip[i], raw[i + 1 : i + 1 + many] = True, True
            i += 1 + many
        counts = np.where(raw, 1, np.where(skip, 0, np.asarray((0, *COUNTS))[sel]))
        sel = np.where(raw, -1, np.where(skip, 0, sel))
    else:
        counts = np.asarray((0, *COUNTS))[sel]
    place = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), np.uint64)
    for s in np.unique(sel):
        mine = np.flatnonzero(sel == s)
        if s == -1:
            out[place[mine]] = w[mine]
        elif s > 0 and BITS[s - 1]:
            bits = BITS[s - 1]
            mask = (U(1) << U(bits)) - U(1)
            for j in range(COUNTS[s - 1]):
                out[place[mine] + j] = (w[mine] >> U(j * bits)) & mask
    return out[:n]


def decode(words: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """All ``n`` values."""
    if not n:
        return np.empty(0, np.uint64)
    ends = [*starts[1:].tolist(), len(words)]
    parts = [_decode_block(words[a:b], min(BLOCK, n - k * BLOCK)) for k, (a, b) in enumerate(zip(starts.tolist(), ends, strict=True))]
    return np.concatenate(parts) if parts else np.empty(0, np.uint64)


def decode_range(words: np.ndarray, starts: np.ndarray, n: int, first: int, count: int) -> np.ndarray:
    """Values ``first`` to ``first + count``, reading only the blocks that hold them."""
    if not count:
        return np.empty(0, np.uint64)
    a, b = first // BLOCK, min(-(-(first + count) // BLOCK), len(starts))
    ends = [*starts[1:].tolist(), len(words)]
    parts = [_decode_block(words[starts[k] : ends[k]], min(BLOCK, n - k * BLOCK)) for k in range(a, b)]
    got = np.concatenate(parts) if parts else np.empty(0, np.uint64)
    return got[first - a * BLOCK : first - a * BLOCK + count]
