r"""Words of Arrow string columns as 64-bit hashes, with no Python object a word.

A word is a run of bytes other than ASCII white space (``[^\x20\x09-\x0D]+``) of
one row's UTF-8 text; rows never run into each other.  Its hash is a polynomial
of its bytes modulo 2^64 (prefix sums over a block of bytes, divided by the
power at its start), then mixed; A-Z may be folded to a-z.  Whole texts are
read in blocks that end between words, so memory follows the block, or the
longest word, not the text.
"""

from __future__ import annotations

import numpy as np

BLOCK = 1 << 17
ODD = np.uint64(0x9E3779B97F4A7C15)
BASE = 0x5851F42D4C957F2D
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: What stands between terms of letters and digits: every ASCII byte that is neither, A-Z counting as letters.
SIGNS = np.ones(256, bool)
SIGNS[128:] = SIGNS[48:58] = SIGNS[65:91] = SIGNS[97:123] = False


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_PLAIN = mixed(np.arange(1, 257, dtype=np.uint64) * ODD)
_FOLDED = _PLAIN.copy()
_FOLDED[65:91] = _PLAIN[97:123]
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^j and BASE^-j for j below n at least."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, BLOCK + 4096)
        _powers[:] = [np.cumprod(np.r_[np.uint64(1), np.full(size - 1, b, np.uint64)], dtype=np.uint64) for b in (BASE, pow(BASE, -1, 1 << 64))]
    return _powers[0], _powers[1]


def raw(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string or binary array; null rows are empty."""
    import pyarrow as pa

    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    if not len(column) or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    every = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return every[at[0] : at[-1]], at - at[0]


def words(data: np.ndarray, offsets: np.ndarray, fold: bool = True, gap: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of every word, in order; ``gap`` tells the bytes that stand between words."""
    value = _FOLDED if fold else _PLAIN
    found, at, n = [], 0, len(data)
    cut = np.unique(offsets)
    while at < n:
        end = min(n, at + BLOCK)
        if end < n:  # end behind a blank or a row's last byte
            blank = np.flatnonzero(gap[data[at:end]])
            rows = cut[(cut > at) & (cut <= end)]
            best = max(int(blank[-1]) + at + 1 if len(blank) else 0, int(rows[-1]) if len(rows) else 0)
            if best > at:
                end = best
            else:  # a word longer than the block
                later = cut[cut > end]
                stop = int(later[0]) if len(later) else n
                k = end
                while k < stop:
                    blank = np.flatnonzero(gap[data[k : k + BLOCK]])
                    if len(blank):
                        stop = min(stop, k + int(blank[0]))
                        break
                    k += BLOCK
                end = stop
        block = data[at:end]
        ink = ~gap[block]
        size = len(block)
        first, last = np.zeros(size + 1, bool), np.zeros(size + 1, bool)
        first[0] = last[size] = True
        edge = cut[(cut >= at) & (cut <= end)] - at
        first[1:size] = ~ink[:-1]
        first[edge] = True
        last[:size][~ink] = True
        last[edge] = True
        start = np.flatnonzero(first[:size] & ink)
        stop = np.flatnonzero(last[1:] & ink) + 1
        up, down = powers(size)
        sums = np.zeros(size + 1, np.uint64)
        np.cumsum(value[block] * up[:size], out=sums[1:])
        found.append((mixed((sums[stop] - sums[start]) * down[start]), start + at, stop + at))
        at = end
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def owners(offsets: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Row of every word."""
    return np.searchsorted(offsets, start, side="right") - 1


def sets_of(h: np.ndarray, owner: np.ndarray, count: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct k-word shingles of ``count`` rows of words: (tokens, offsets).

    ``owner`` ascends.  A row of fewer words has the whole of them as its one
    shingle; one without words is empty.
    """
    sizes = np.bincount(owner, minlength=count)
    tokens, rows = [], []

    def shingle(parts: list[np.ndarray], m: int) -> np.ndarray:
        x = np.full(len(parts[0]), m, np.uint64)
        for p in parts:
            x = (x ^ p) * ODD
            x ^= x >> np.uint64(31)
        return mixed(x)

    if len(h) >= k:
        whole = np.flatnonzero(owner[: len(h) - k + 1] == owner[k - 1 :])
        tokens.append(shingle([h[whole + j] for j in range(k)], k))
        rows.append(owner[whole])
    at = np.r_[0, np.cumsum(sizes)]
    few = False
    for m in range(1, k):
        some = np.flatnonzero(sizes == m)
        if len(some):
            few = True
            tokens.append(shingle([h[at[some] + j] for j in range(m)], m))
            rows.append(some)
    t, o = np.concatenate([np.zeros(0, np.uint64), *tokens]), np.concatenate([np.zeros(0, np.int64), *rows])
    if few:
        order = np.argsort(o, kind="stable")
        t, o = t[order], o[order]
    ends = np.cumsum(np.bincount(o, minlength=count)).tolist()
    a = 0
    for b in ends:
        if b - a > 1:
            t[a:b].sort()
        a = b
    if len(t):
        new = np.r_[True, (t[1:] != t[:-1]) | (o[1:] != o[:-1])]
        t, o = t[new], o[new]
    return t, np.r_[0, np.cumsum(np.bincount(o, minlength=count))]


def digests(tokens: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """128 bits of every set as two columns; the order of its tokens does not matter."""
    out = np.zeros((len(offsets) - 1, 2), np.uint64)
    for k, salt in enumerate((0x8CB92BA72F3D8DD7, 0xD6E8FEB86659FD93)):
        sums = np.r_[np.uint64(0), np.cumsum(mixed(tokens ^ np.uint64(salt)))]
        out[:, k] = sums[offsets[1:]] - sums[offsets[:-1]]
    return out
