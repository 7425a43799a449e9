"""Vectorised word hashing shared by the operators of this package.

A word is a maximal run of bytes outside ``\\x20 \\x09-\\x0D``.  Every word gets a
64-bit polynomial hash (random byte table, modulus 2**64, finished by an
avalanche step), computed for a whole Arrow buffer at once.  Texts longer than
``CHUNK`` bytes are hashed chunk by chunk, cut at white space, so memory is
bounded by the chunk and not by the longest text (a single word longer than a
chunk is hashed in one piece).
"""

from __future__ import annotations

import numpy as np

CHUNK = 1 << 20
_RNG = np.random.default_rng(20240229)
_TABLE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P = 0x9E3779B97F4A7C15
_P_INV = pow(_P, -1, 2**64)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_powers: list[np.ndarray] = []


def mix64(x: np.ndarray) -> np.ndarray:
    """Avalanche finaliser over uint64 (splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _MIX1
    x ^= x >> np.uint64(27)
    x *= _MIX2
    x ^= x >> np.uint64(31)
    return x


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        m = max(n, CHUNK + 1)
        up, down = np.full(m, _P, np.uint64), np.full(m, _P_INV, np.uint64)
        up[0] = down[0] = 1
        _powers[:] = [np.multiply.accumulate(up), np.multiply.accumulate(down)]
    return _powers[0], _powers[1]


def is_space(data: np.ndarray) -> np.ndarray:
    return (data == 32) | ((data >= 9) & (data <= 13))


def _lower(data: np.ndarray) -> np.ndarray:
    return data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)


def _hash_chunk(data: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    word = ~is_space(data)
    before = np.empty_like(word)
    before[0] = False
    before[1:] = word[:-1]
    before[breaks[breaks < len(data)]] = False
    starts = np.flatnonzero(word & ~before)
    if not len(starts):
        return np.zeros(0, np.uint64), starts, starts
    after = np.zeros_like(word)
    after[:-1] = word[1:] & before[1:]
    ends = np.flatnonzero(word & ~after) + 1
    up, down = _power(len(data) + 1)
    total = np.empty(len(data) + 1, np.uint64)
    total[0] = 0
    np.cumsum(_TABLE[data] * up[: len(data)], out=total[1:])
    h = (total[ends] - total[starts]) * down[starts]
    return mix64(h + (ends - starts).astype(np.uint64)), starts, ends


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts ``data[offsets[i]:offsets[i+1]]``.

    Returns (hashes, bounds) where the words of text i are hashes[bounds[i]:bounds[i+1]].
    """
    hashes, _, _, bounds = word_places(data, offsets, lower)
    return hashes, bounds


def word_places(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, starts, ends, bounds): word_hashes() with the places of the words in ``data``."""
    offsets = np.asarray(offsets, np.int64)
    hashes, starts, ends = [], [], []
    pos, end = int(offsets[0]), int(offsets[-1])
    while pos < end:
        stop = min(end, pos + CHUNK)
        if stop < end:
            inside = offsets[np.searchsorted(offsets, stop, side="right") - 1]
            if inside > pos:
                stop = int(inside)
            else:
                space = np.flatnonzero(is_space(data[pos:stop]))
                if len(space):
                    stop = pos + int(space[-1]) + 1
                else:
                    ahead = int(offsets[np.searchsorted(offsets, pos, side="right")])
                    space = np.flatnonzero(is_space(data[stop:ahead]))
                    stop = stop + int(space[0]) + 1 if len(space) else ahead
        part = data[pos:stop]
        at = offsets[np.searchsorted(offsets, pos) : np.searchsorted(offsets, stop)] - pos
        h, s, e = _hash_chunk(_lower(part) if lower else part, at)
        hashes.append(h)
        starts.append(s + pos)
        ends.append(e + pos)
        pos = stop
    if not hashes:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, np.zeros(len(offsets), np.int64)
    where = np.concatenate(starts)
    return np.concatenate(hashes), where, np.concatenate(ends), np.searchsorted(where, offsets)


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word windows; with fewer words the whole sequence is one; none for no word."""
    n = len(hashes)
    if not n:
        return hashes[:0]
    width = min(k, n)
    out = hashes[: n - width + 1].copy()
    for i in range(1, width):
        out *= np.uint64(_P)
        out ^= out >> np.uint64(29)
        out += hashes[i : n - width + 1 + i]
    if n < k:
        out += np.uint64(n)
    return np.unique(mix64(out))


def text_buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column without copying; null counts as empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    n = len(column)
    buffers = column.buffers()
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    return data, offsets


def slices_by_bytes(offsets: np.ndarray, most: int = CHUNK):
    """Row ranges (a, b) of at most ``most`` bytes each; a longer row stands alone."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + most, side="right")) - 1
        b = min(n, max(a + 1, b))
        yield a, b
        a = b
