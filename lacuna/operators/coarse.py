"""Coarse models: the small picture of a field that every chunk carries.

A model has ``encode(signal, **options) -> bytes`` and ``decode(payload, shape, **options) -> array``; register() adds one.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

from lacuna.functions import transforms as T
from lacuna.sources import media

MODELS: dict[tuple[str, str], object] = {}


def register(kind: str, name: str):
    def add(cls):
        MODELS[kind, name] = cls()
        return cls

    return add


def get(name: str, kind: str):
    """The model of that name, or the thumbnail if there is none."""
    return MODELS.get((kind, name.lower()), MODELS[kind, "downsample"])


@register("image", "downsample")
class ImageThumbnail:
    def encode(self, a, coarse_max_side=16, **_):
        h, w = a.shape[:2]
        scale = min(1.0, coarse_max_side / max(h, w))
        return media.write_png(media.bicubic(a, max(1, round(h * scale)), max(1, round(w * scale))))

    def decode(self, payload, shape, **_):
        return media.bicubic(media.read_png(payload), *shape[:2]).astype(np.int16)


@register("image", "latent_lowfreq")
class ImageLowFrequencies:
    """The first zigzag coefficients of each block."""

    def encode(self, a, quality=50, dct_block=8, lf_keep=6, **_):
        lf_keep = max(1, min(lf_keep, dct_block * dct_block))
        vec, _ = image_coefficients(a.astype(float), quality, dct_block)
        return struct.pack(">B", lf_keep) + zlib.compress(vec.reshape(-1, dct_block * dct_block)[:, :lf_keep].astype("<i2").tobytes(), 9)

    def decode(self, payload, shape, quality=50, dct_block=8, **_):
        keep = payload[0]
        low = np.frombuffer(zlib.decompress(payload[1:]), "<i2").reshape(-1, keep)
        full = np.zeros((shape[2] * -(-shape[0] // dct_block) * -(-shape[1] // dct_block), dct_block * dct_block))
        full[:, :keep] = low[: len(full)]
        return np.clip(np.rint(image_of(full.ravel(), shape, quality, dct_block)), 0, 255).astype(np.int16)


def image_coefficients(a: np.ndarray, quality: int, block: int) -> tuple[np.ndarray, bool]:
    """Coefficients of an (h, w, c) array, channel by channel, blocks in raster order, edges repeated."""
    h, w, c = a.shape
    p = np.pad(a, ((0, -h % block), (0, -w % block), (0, 0)), mode="edge")
    ny, nx = p.shape[0] // block, p.shape[1] // block
    blocks = p.reshape(ny, block, nx, block, c).transpose(4, 0, 2, 1, 3).reshape(-1, block, block)
    q, clipped = T.block_coefficients(blocks, quality)
    return q.ravel(), bool(clipped.any())


def image_of(vec: np.ndarray, shape, quality: int, block: int) -> np.ndarray:
    h, w, c = shape
    ny, nx = -(-h // block), -(-w // block)
    px = T.render_blocks(vec.reshape(-1, block * block), block, quality).reshape(c, ny, nx, block, block)
    return px.transpose(1, 3, 2, 4, 0).reshape(ny * block, nx * block, c)[:h, :w]


@register("audio", "downsample")
class AudioTrack:
    """Evenly spaced frames, compressed."""

    def encode(self, x, coarse_len=2048, **_):
        return zlib.compress(x[T.coarse_samples(len(x), max(2, coarse_len))].astype("<i2").tobytes() if len(x) else b"", 9)

    def decode(self, payload, shape, **_):
        n, ch = shape
        track = np.frombuffer(zlib.decompress(payload), "<i2").reshape(-1, ch).astype(float)
        return np.stack([T.lerp(track[:, c], n) for c in range(ch)], 1).astype(np.int16)


@register("audio", "latent_lowfreq")
class AudioLowBins:
    """The lowest bins of each frame."""

    HEADER = struct.Struct(">H")

    def encode(self, x, quality=50, n_fft=512, hop=None, lf_bins=16, **_):
        bins = max(1, min(lf_bins, n_fft // 2 + 1))
        q = T.audio_coefficients(x, quality, n_fft, max(1, hop or n_fft // 2))[:, :, :bins]
        return self.HEADER.pack(bins) + zlib.compress(np.clip(q, -32768, 32767).astype("<i2").tobytes(), 9)

    def decode(self, payload, shape, quality=50, n_fft=512, hop=None, **_):
        (bins,), hop = self.HEADER.unpack_from(payload), max(1, hop or n_fft // 2)
        frames = T.frame_count(shape[0], n_fft, hop)
        q = np.frombuffer(zlib.decompress(payload[self.HEADER.size :]), "<i2")[: shape[1] * frames * bins * 2].reshape(shape[1], frames, bins, 2)
        return np.clip(T.rint(T.audio_of(q, shape[0], quality, n_fft, hop)), -32768, 32767).astype(np.int16)


class Latent:
    """A plain coarse part and the code of a linear autoencoder with a tanh between; where weights and code are there,
    the field is drawn from the code, else from the plain part.

    Weights: enc_w (k, n), enc_b (k), dec_w (n, k), dec_b (n) and input_shape, as arrays of one archive.
    """

    HEADER = struct.Struct(">II")
    NAMES = ("enc_w", "enc_b", "dec_w", "dec_b", "input_shape")
    base: object

    def __init__(self, weights: dict | None = None):
        self.weights = weights

    def load(self, path: str) -> None:
        """Weights of a saved archive; a missing or broken one leaves the model without."""
        try:
            with np.load(path, allow_pickle=False) as f:
                self.weights = {name: f[name] for name in self.NAMES}
        except (OSError, KeyError, ValueError):
            self.weights = None

    def view(self, signal) -> np.ndarray | None:
        """The signal as the autoencoder takes it, or None if it can't."""
        raise NotImplementedError

    def draw(self, y: np.ndarray, shape) -> np.ndarray:
        raise NotImplementedError

    def encode(self, signal, **options):
        plain, code = self.base.encode(signal, **options), b""
        x = None if self.weights is None else self.view(signal)
        if x is not None:
            code = zlib.compress(np.tanh(self.weights["enc_w"] @ x + self.weights["enc_b"]).astype("<f4").tobytes(), 9)
        return self.HEADER.pack(len(plain), len(code)) + plain + code

    def decode(self, payload, shape, **options):
        n, k = self.HEADER.unpack_from(payload)
        at = self.HEADER.size
        if at + n + k > len(payload):
            raise ValueError("the payload is cut off")
        if self.weights is not None and k:
            try:
                code = np.frombuffer(zlib.decompress(payload[at + n : at + n + k]), "<f4")
                return self.draw(self.weights["dec_w"] @ code + self.weights["dec_b"], shape)
            except zlib.error:
                pass
        return self.base.decode(payload[at : at + n], shape, **options)


@register("image", "ae_latent")
class LatentImage(Latent):
    base = MODELS["image", "downsample"]

    def view(self, signal):
        h, w, c = map(int, self.weights["input_shape"])
        return media.bicubic(signal, h, w).astype(float).ravel() / 255 if signal.shape[2] == c else None

    def draw(self, y, shape):
        small = np.clip(y.reshape([int(v) for v in self.weights["input_shape"]]) * 255, 0, 255).astype(np.uint8)
        return media.bicubic(small, *shape[:2]).astype(np.int16)


@register("audio", "ae_latent")
class LatentAudio(Latent):
    base = MODELS["audio", "downsample"]

    def view(self, signal):
        if signal.shape[1] != 1:
            return None
        at = np.linspace(0, len(signal) - 1, int(self.weights["input_shape"][0])).astype(np.int64)
        return signal[at, 0] / 32768

    def draw(self, y, shape):
        track = np.clip(y, -1, 1) * 32768
        x = np.interp(np.linspace(0, len(track) - 1, shape[0]), np.arange(len(track)), track)
        return np.clip(np.rint(x), -32768, 32767).astype(np.int16).reshape(-1, 1)


def train_latent(rows: np.ndarray, width: int, input_shape) -> dict:
    """Weights of a Latent from sample inputs (one a row, scaled as view() does): the mean and the first principal
    directions, narrowed so that codes stay where tanh is nearly straight."""
    mean = rows.mean(0)
    _, _, axes = np.linalg.svd(rows - mean, full_matrices=False)
    axes = axes[:width]
    spread = np.maximum(np.abs((rows - mean) @ axes.T).max(0), 1e-9) / 0.25
    return {"enc_w": axes / spread[:, None], "enc_b": -(axes @ mean) / spread, "dec_w": (axes * spread[:, None]).T, "dec_b": mean, "input_shape": np.array(input_shape)}
