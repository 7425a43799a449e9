"""Transform bases, scan order, quantisation tables and spectra, as NumPy for Arrow kernels."""

from __future__ import annotations

import numpy as np

#: The luminance table of the public JPEG standard (annex K), row by row.
LUMINANCE = [
    16, 11, 10, 16, 24, 40, 51, 61,
    12, 12, 14, 19, 26, 58, 60, 55,
    14, 13, 16, 24, 40, 57, 69, 56,
    14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77,
    24, 35, 55, 64, 81, 104, 113, 92,
    49, 64, 78, 87, 103, 121, 120, 101,
    72, 92, 95, 98, 112, 100, 103, 99,
]


def dct_basis(n: int) -> np.ndarray:
    """Orthonormal DCT-II, rows are frequencies."""
    k, x = np.arange(n)[:, None], np.arange(n)[None, :]
    return np.where(k == 0, np.sqrt(1 / n), np.sqrt(2 / n)) * np.cos(np.pi * (2 * x + 1) * k / (2 * n))


def zigzag(n: int) -> np.ndarray:
    """Row-major cell visited k-th: even diagonals run upwards, odd ones downwards."""
    cells = sorted(((r, c) for r in range(n) for c in range(n)), key=lambda p: (sum(p), -p[0] if sum(p) % 2 == 0 else p[0]))
    return np.array([r * n + c for r, c in cells])


def quant_table(block: int, quality: int) -> np.ndarray:
    """Steps of block x block coefficients: the base table scaled by quality.

    For other sizes than 8 the format stretches the base table itself along both axes and leaves it unscaled.
    """
    base = np.array(LUMINANCE, float).reshape(8, 8)
    if block != 8:
        at, cells = np.linspace(0, 7, block), np.arange(8)
        tall = np.stack([np.interp(at, cells, c) for c in base.T], 1).astype(np.float32)
        wide = np.stack([np.interp(at, cells, r) for r in tall]).astype(np.float32)
        return np.clip(np.rint(wide), 1, 32767).astype(float)
    q = min(100, max(1, int(quality)))
    scale = 5000 / q if q < 50 else 200 - 2 * q
    return np.clip(np.floor((base * scale + 50) / 100), 1, 32767)


def rint(x: np.ndarray) -> np.ndarray:
    """Half-even rounding that does not depend on the last bits of x."""
    return np.rint(np.round(x, 9))


def block_coefficients(blocks: np.ndarray, quality: int) -> tuple[np.ndarray, np.ndarray]:
    """Quantised zigzag coefficients of (n, b, b) blocks and whether a block was clipped to 16 bits."""
    b = blocks.shape[1]
    t, order = dct_basis(b), zigzag(b)
    c = rint(np.einsum("ij,njk,lk->nil", t, blocks, t) / quant_table(b, quality)).reshape(len(blocks), -1)[:, order]
    return np.clip(c, -32768, 32767).astype(np.int64), (np.abs(c) > 32767).any(1)


def render_blocks(coefs: np.ndarray, block: int, quality: int) -> np.ndarray:
    """Inverse of block_coefficients, before clipping."""
    grid = np.zeros_like(coefs, dtype=float)
    grid[:, zigzag(block)] = coefs
    t = dct_basis(block)
    return np.einsum("ji,njk,kl->nil", t, grid.reshape(-1, block, block) * quant_table(block, quality), t)


# --- audio ------------------------------------------------------------------------------------


def frame_count(n: int, n_fft: int, hop: int) -> int:
    return 0 if n <= 0 else max(1, -(-(n - n_fft) // hop) + 1)


def root_hann(n: int) -> np.ndarray:
    return np.sqrt(np.hanning(n))


def _places(m: int, n_fft: int, hop: int) -> np.ndarray:
    """Sample of each place of each of m frames."""
    return np.arange(m)[:, None] * hop + np.arange(n_fft)


def stft(x: np.ndarray, n_fft: int, hop: int) -> np.ndarray:
    """Spectra of windowed frames, not scaled; the end is padded with zeros."""
    m = frame_count(len(x), n_fft, hop)
    if not m:
        return np.zeros((0, n_fft // 2 + 1), complex)
    padded = np.zeros((m - 1) * hop + n_fft)
    padded[: len(x)] = x[: len(padded)]
    return np.fft.rfft(padded[_places(m, n_fft, hop)] * root_hann(n_fft), axis=1)


def istft(spec: np.ndarray, n: int, n_fft: int, hop: int) -> np.ndarray:
    """Overlapping windowed frames summed and divided by the sum of squared windows; samples without weight stay 0."""
    m, w = len(spec), root_hann(n_fft)
    at, length = _places(m, n_fft, hop).ravel(), max(n, (m - 1) * hop + n_fft if m else 0)
    total = np.bincount(at, (np.fft.irfft(spec, n_fft, axis=1) * w).ravel(), length)
    return (total / np.maximum(np.bincount(at, np.tile(w * w, m), length), 1e-8))[:n]


def audio_steps(bins: int, quality: int, n_fft: int) -> np.ndarray:
    """Steps of spectra that are divided by n_fft."""
    q = min(100, max(1, int(quality)))
    return max(1.0, (120 - q) / 20) / n_fft * (1 + np.arange(bins) / max(1, bins - 1))


def audio_coefficients(x: np.ndarray, quality: int, n_fft: int, hop: int) -> np.ndarray:
    """(channel, frame, bin, real and imaginary part) of (n, channels) samples in steps, rounded half-even, not clipped."""
    s = np.stack([stft(c.astype(float), n_fft, hop) for c in x.T]) / n_fft / audio_steps(n_fft // 2 + 1, quality, n_fft)
    return rint(np.stack([s.real, s.imag], -1))


def audio_of(q: np.ndarray, n: int, quality: int, n_fft: int, hop: int) -> np.ndarray:
    """(n, channels) samples from the first bins of audio_coefficients()."""
    full = np.zeros((*q.shape[:2], n_fft // 2 + 1), complex)
    full[:, :, : q.shape[2]] = q[..., 0] + 1j * q[..., 1]
    full *= audio_steps(n_fft // 2 + 1, quality, n_fft) * n_fft
    return np.stack([istft(c, n, n_fft, hop) for c in full], 1)


def coarse_samples(n: int, most: int) -> np.ndarray:
    """Frames that the coarse track keeps."""
    length = max(1, min(n, most))
    return np.linspace(0, n - 1, length).astype(np.int64)


def lerp(coarse: np.ndarray, n: int) -> np.ndarray:
    """The coarse track stretched to n frames, half-even."""
    if not len(coarse):
        return np.zeros(n)
    at = np.linspace(0, len(coarse) - 1, n)
    lo = np.floor(at).astype(int)
    hi = np.minimum(lo + 1, len(coarse) - 1)
    return rint(coarse[lo] * (1 - (at - lo)) + coarse[hi] * (at - lo))


# --- shifts -----------------------------------------------------------------------------------

#: Peaks below the first are noise; the second guards the division by a vanishing spectrum.
LEAST_PEAK, LEAST_SPECTRUM = 0.15, 1e-12


def phase_shift(a: np.ndarray, b: np.ndarray) -> tuple[tuple[int, ...], float]:
    """Displacement of b against a and its peak: the inverse transform of the phases of their cross spectrum has its
    first largest value there; places past the middle count as negative."""
    phases = np.fft.fftn(a) * np.fft.fftn(b).conj()
    surface = np.fft.ifftn(phases / np.maximum(abs(phases), LEAST_SPECTRUM)).real
    best = surface.argmax()
    extent = np.array(surface.shape)
    place = np.array(np.unravel_index(best, surface.shape))
    return tuple(np.where(place > extent // 2, place - extent, place).tolist()), float(surface.flat[best])


def gauge_shift(a: np.ndarray, b: np.ndarray, least_peak: float = LEAST_PEAK, most: int | None = None, window: bool = False) -> tuple[int, ...]:
    """phase_shift of demeaned maps, 0 where the peak is weak, held within half the extent and ``most``; the window
    is a Hann window along each axis (where every axis has more than one place)."""
    a, b = a - a.mean(), b - b.mean()
    if window and min(a.shape) > 1:
        for axis, n in enumerate(a.shape):
            w = np.hanning(n).reshape([-1 if i == axis else 1 for i in range(a.ndim)])
            a, b = a * w, b * w
    shift, peak = phase_shift(a, b)
    if not np.isfinite(peak) or peak < least_peak:
        return (0,) * a.ndim
    limit = np.array(a.shape) // 2 if most is None else np.minimum(np.array(a.shape) // 2, max(0, most))
    return tuple(np.clip(shift, -limit, limit).tolist())


def shifted(x: np.ndarray, by: int, axis: int = 0) -> np.ndarray:
    """Zero-filled shift along an axis: out[i] = x[i - by]."""
    n = x.shape[axis]
    moved = np.roll(x, by, axis)
    gone = np.arange(n) - by
    outside = ((gone < 0) | (gone >= n)).reshape([-1 if i == axis else 1 for i in range(x.ndim)])
    return np.where(outside, np.zeros((), x.dtype), moved)
