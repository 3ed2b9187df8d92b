"""Vectorised word hashing over batches of texts (numpy, no loop per word).

A word's hash is a polynomial over its bytes, modulo 2**64, through one running sum per batch;
a finaliser mixes it. ASCII A-Z is lower-cased on the way; other letters stay as they are.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
_R = 0x9E3779B97F4A7C15 | 5
_R_INV = pow(_R, -1, 1 << 64)
#: A long text is hashed in pieces of about so many bytes, cut at white space.
PIECE = 1 << 20

_rng = np.random.Generator(np.random.PCG64(20240517))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_CASED = _BYTE.copy()
_BYTE[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        for k, r in enumerate((_R, _R_INV)):
            p = np.full(size, r, np.uint64)
            p[0] = 1
            np.multiply.accumulate(p, out=p)
            _powers[k] = p
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def hash_piece(data: bytes, fold: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts and ends of the words of ``data``; without ``fold`` letter case counts."""
    b = np.frombuffer(data, np.uint8)
    if not len(b):
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    word = ~_SPACE[b]
    edge = np.flatnonzero(word[1:] != word[:-1]) + 1
    if word[0]:
        edge = np.concatenate(([0], edge))
    if len(edge) % 2:
        edge = np.concatenate((edge, [len(b)]))
    start, end = edge[0::2], edge[1::2]
    p, inv = _power(len(b) + 1)
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((_BYTE if fold else _CASED)[b] * p[: len(b)], out=total[1:])
    h = (total[end] - total[start]) * inv[start]
    return mix(h + (end - start).astype(np.uint64)), start, end


def cut_long(data: bytes) -> list[bytes]:
    """``data`` in parts of about PIECE bytes, cut at white space."""
    parts, at = [], 0
    while len(data) - at > PIECE:
        cut = len(data)
        for a in range(at + PIECE, len(data), PIECE):
            space = np.flatnonzero(_SPACE[np.frombuffer(data, np.uint8, min(PIECE, len(data) - a), a)])
            if len(space):
                cut = a + int(space[0])
                break
        parts.append(data[at:cut])
        at = cut
    return [*parts, data[at:]]


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and for each text where its words begin (one more than texts)."""
    parts, counts, group, size = [], np.zeros(len(texts), np.int64), [], 0

    def flush() -> None:
        nonlocal group, size
        if group:
            starts = np.cumsum([0] + [len(x) + 1 for _, x in group])
            h, at, _ = hash_piece(b"\n".join(x for _, x in group))
            cut = np.searchsorted(at, starts)
            cut[-1] = len(at)
            np.add.at(counts, [k for k, _ in group], np.diff(cut))
            parts.append(h)
            group, size = [], 0

    for k, text in enumerate(texts):
        data = text.encode("utf-8", "surrogatepass") if text else b""
        for part in cut_long(data):
            group.append((k, part))
            size += len(part)
            if size > PIECE:
                flush()
    flush()
    return (np.concatenate(parts) if parts else np.empty(0, np.uint64)), np.concatenate(([0], np.cumsum(counts)))


def shingles(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of ``n`` words; with fewer words, one for the whole run; none without words."""
    if not len(h):
        return h
    n = min(n, len(h))
    out = np.zeros(len(h) - n + 1, np.uint64)
    for j in range(n):
        out = mix(out * U(0xD1342543DE82EF95) + h[j : len(h) - n + 1 + j])
    return out


def shingle_set(h: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct shingle hashes."""
    return np.unique(shingles(h, n))


def pieces(batch, text: str = "text", most: int = PIECE):
    """Cut an Arrow batch into slices of about ``most`` bytes of text, one row at least."""
    n = batch.num_rows
    if not n:
        return
    import pyarrow.compute as pc

    size = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False), np.int64)
    total, at = np.cumsum(size + 16), 0
    while at < n:
        done = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, done + most, "right")))
        yield batch.slice(at, to - at)
        at = to
