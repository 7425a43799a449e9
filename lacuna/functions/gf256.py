"""Arithmetic over the field of 256 elements with polynomial 0x11D and generator 2."""

from __future__ import annotations

import numpy as np


def _tables() -> tuple[np.ndarray, np.ndarray]:
    power = [1]
    for _ in range(254):
        x = power[-1] << 1
        power.append(x ^ 0x11D if x > 255 else x)
    log = np.zeros(256, np.int64)
    log[power] = np.arange(255)
    return np.array(power, np.uint8), log


EXP, LOG = _tables()


def mul(a, b) -> np.ndarray:
    a, b = np.asarray(a, np.uint8), np.asarray(b, np.uint8)
    return np.where((a == 0) | (b == 0), 0, EXP[(LOG[a] + LOG[b]) % 255]).astype(np.uint8)


def inv(a) -> np.ndarray:
    a = np.asarray(a, np.uint8)
    return np.where(a == 0, 0, EXP[-LOG[a] % 255]).astype(np.uint8)


def combine(coefs: np.ndarray, slices: np.ndarray) -> np.ndarray:
    """Rows of coefs (r, n) times slices (n, bytes)."""
    out = np.zeros((len(coefs), slices.shape[1]), np.uint8)
    for j in range(slices.shape[0]):
        out ^= mul(coefs[:, j : j + 1], slices[j : j + 1])
    return out


def solve(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray | None, int]:
    """Reduced row echelon of a x = b: (x, rank), x None if the rank is below the unknowns."""
    a, b = a.astype(np.uint8).copy(), b.astype(np.uint8).copy()
    rank, n = 0, a.shape[1]
    for c in range(n):
        pivots = np.flatnonzero(a[rank:, c])
        if not len(pivots):
            continue
        p = rank + pivots[0]
        a[[rank, p]], b[[rank, p]] = a[[p, rank]], b[[p, rank]]
        f = inv(a[rank, c])
        a[rank], b[rank] = mul(f, a[rank]), mul(f, b[rank])
        others = np.flatnonzero(a[:, c])
        others = others[others != rank]
        factor = a[others, c][:, None]
        a[others] ^= mul(factor, a[rank][None, :])
        b[others] ^= mul(factor, b[rank][None, :])
        rank += 1
        if rank == len(a):
            break
    return (b[:n] if rank == n else None), rank
