"""The golden permutation for Arrow kernels."""

from __future__ import annotations

import functools
import math

import numpy as np

from lacuna.functions.golden import PHI_1, TRIES


@functools.lru_cache(maxsize=256)
def step(n: int) -> int:
    if n <= 1:
        return 1
    start = max(1, int(PHI_1 * n))
    return next((s for s in range(start, start + TRIES) if math.gcd(s, n) == 1), 1)


def permutation(n: int) -> np.ndarray:
    return np.arange(n, dtype=np.int64) * step(n) % max(1, n)


def split(vec: np.ndarray, blocks: int) -> list[np.ndarray]:
    """Slices of a vector: every blocks-th of its permuted positions."""
    moved = vec[permutation(len(vec))]
    return [moved[b::blocks] for b in range(blocks)]


def scatter(n: int, blocks: int, slices: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(vector, mask) with the slices in place; short slices fill what they have."""
    order = permutation(n)
    out, mask = np.zeros(n, np.int16), np.zeros(n, bool)
    for b, v in slices.items():
        at = order[b::blocks]
        m = min(len(at), len(v))
        out[at[:m]], mask[at[:m]] = v[:m], True
    return out, mask
