"""Raster and sound containers without third-party readers: PNG (8-bit) and RIFF WAVE, from and to bytes."""

from __future__ import annotations

import struct
import zlib

import numpy as np

_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def write_png(a: np.ndarray) -> bytes:
    """(h, w, 3) or (h, w) uint8 as PNG."""
    a = np.ascontiguousarray(a, np.uint8)
    h, w = a.shape[:2]
    rows = np.hstack([np.zeros((h, 1), np.uint8), a.reshape(h, -1)]).tobytes()

    def part(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    head = struct.pack(">IIBBBBB", w, h, 8, 2 if a.ndim == 3 else 0, 0, 0, 0)
    return _SIGNATURE + part(b"IHDR", head) + part(b"IDAT", zlib.compress(rows, 9)) + part(b"IEND", b"")


def read_png(data: bytes) -> np.ndarray:
    """8-bit grey, grey-alpha, RGB, RGBA or palette PNG (not interlaced) as (h, w, 3) uint8."""
    if data[:8] != _SIGNATURE:
        raise ValueError("not a PNG")
    at, body, palette, head = 8, b"", None, None
    while at < len(data):
        (n,), kind = struct.unpack(">I", data[at : at + 4]), data[at + 4 : at + 8]
        part = data[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"PLTE":
            palette = np.frombuffer(part, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            body += part
        at += 12 + n
    if head is None or head[2] != 8 or head[6]:
        raise ValueError("unsupported PNG")
    w, h, _, color = head[:4]
    c = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[color]
    raw = np.frombuffer(zlib.decompress(body), np.uint8).reshape(h, 1 + w * c)
    out, above = np.zeros((h, w * c), np.uint8), np.zeros(w * c, np.int64)
    for y in range(h):
        kind, line = raw[y, 0], raw[y, 1:].astype(np.int64)
        if kind == 2:
            line = line + above
        elif kind in (1, 3, 4):
            for x in range(w * c):
                a = line[x - c] if x >= c else 0
                b = above[x]
                d = above[x - c] if x >= c else 0
                if kind == 1:
                    guess = a
                elif kind == 3:
                    guess = (a + b) // 2
                else:
                    p = a + b - d
                    guess = min(((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - d), 2, d)))[2]
                line[x] = (line[x] + guess) & 255
        out[y] = above = line & 255
        above = above.astype(np.int64)
    px = out.reshape(h, w, c)
    if color == 3:
        return palette[px[..., 0]]
    return np.repeat(px[..., :1], 3, 2) if c < 3 else px[..., :3]


def write_wav(x: np.ndarray, rate: int) -> bytes:
    """int16 samples (n, channels) as PCM WAVE."""
    x = np.ascontiguousarray(x.reshape(len(x), -1), "<i2")
    ch = x.shape[1]
    fmt = struct.pack("<HHIIHH", 1, ch, rate, rate * ch * 2, ch * 2, 16)
    data = x.tobytes()
    return b"RIFF" + struct.pack("<I", 36 + len(data)) + b"WAVEfmt " + struct.pack("<I", 16) + fmt + b"data" + struct.pack("<I", len(data)) + data


def wav_parts(data: bytes) -> tuple[int, int, int, int, bytes]:
    """(format, channels, rate, bits, samples); the extensible format is resolved, a broken length means the rest."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not a WAVE")
    at, fmt = 12, None
    while at + 8 <= len(data):
        kind, (n,) = data[at : at + 4], struct.unpack("<I", data[at + 4 : at + 8])
        body = data[at + 8 : at + 8 + n]
        if kind == b"fmt ":
            fmt = list(struct.unpack("<HHIIHH", body[:16]))
            if fmt[0] == 0xFFFE and len(body) >= 26:
                fmt[0] = struct.unpack("<H", body[24:26])[0]
        elif kind == b"data" and fmt:
            return fmt[0], fmt[1], fmt[2], fmt[5], body
        at += 8 + n + n % 2
    raise ValueError("no sound data")


def _pcm24(body: bytes) -> np.ndarray:
    b = np.frombuffer(body[: len(body) // 3 * 3], np.uint8).reshape(-1, 3).astype(np.int32)
    v = b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16
    return np.where(v >= 1 << 23, v - (1 << 24), v)


def read_wav(data: bytes) -> tuple[np.ndarray, int]:
    """int16 (n, channels) and rate; 24-bit samples lose their low byte, other widths are refused."""
    kind, ch, rate, bits, body = wav_parts(data)
    if kind != 1 or bits not in (16, 24):
        raise ValueError(f"unsupported sample width {bits}")
    v = np.frombuffer(body[: len(body) // 2 * 2], "<i2") if bits == 16 else (_pcm24(body) >> 8).astype(np.int16)
    return v[: len(v) // ch * ch].reshape(-1, ch).astype(np.int16), rate


def read_wav_float(data: bytes) -> tuple[np.ndarray, int]:
    """Mono float samples of PCM 8/16/24/32 or float 32/64."""
    kind, ch, rate, bits, body = wav_parts(data)
    body = body[: len(body) // (bits // 8) * (bits // 8)]
    if kind == 3:
        v = np.frombuffer(body, "<f4" if bits == 32 else "<f8").astype(np.float64)
    elif bits == 8:
        v = (np.frombuffer(body, np.uint8).astype(np.float64) - 128) / 128
    elif bits == 24:
        v = _pcm24(body) / 8388608
    else:
        v = np.frombuffer(body, f"<i{bits // 8}") / float(1 << (bits - 1))
    return v[: len(v) // ch * ch].reshape(-1, ch).mean(1), rate


def write_wav_float(x: np.ndarray, rate: int) -> bytes:
    """Clipped to +-1 and truncated to 16 bits."""
    return write_wav((np.clip(x, -1, 1) * 32767).astype(np.int16), rate)


def raw_s16le(data: bytes, channels: int = 1, skip: int | None = None) -> np.ndarray:
    """Headerless samples; without ``skip`` a header's data mark is looked for."""
    if skip is None:
        mark = data.find(b"data", 0, 4096)
        skip = mark + 8 if mark >= 0 else 0
    v = np.frombuffer(data[skip : skip + (len(data) - skip) // 2 * 2], "<i2") / 32768
    return v[: len(v) // channels * channels].reshape(-1, channels).mean(1)


def resample(x: np.ndarray, rate: int, to: int) -> np.ndarray:
    """Linear interpolation on grids that leave the end point out."""
    if rate == to or not len(x):
        return x
    n = max(1, round(len(x) * to / rate))
    return np.interp(np.linspace(0, 1, n, endpoint=False), np.linspace(0, 1, len(x), endpoint=False), x)


def fix_wav(data: bytes, to: int | None = None) -> bytes:
    """Any readable sound as mono 16-bit PCM, resampled if asked."""
    x, rate = read_wav_float(data)
    return write_wav_float(resample(x, rate, to or rate), to or rate)


def _cubic(x: np.ndarray) -> np.ndarray:
    x = np.abs(x)
    return np.where(x < 1, (1.5 * x - 2.5) * x * x + 1, np.where(x < 2, ((-0.5 * x + 2.5) * x - 4) * x + 2, 0.0))


def _weights(n: int, m: int) -> np.ndarray:
    """(m, n) bicubic weights, widened when shrinking."""
    scale = max(1.0, n / m)
    centre = (np.arange(m) + 0.5) * n / m - 0.5
    w = _cubic((np.arange(n)[None, :] - centre[:, None]) / scale)
    return w / w.sum(1, keepdims=True)


def bicubic(a: np.ndarray, h: int, w: int) -> np.ndarray:
    x = np.einsum("ij,jkc,lk->ilc", _weights(a.shape[0], h), a.astype(np.float64), _weights(a.shape[1], w))
    return np.clip(np.rint(x), 0, 255).astype(np.uint8)
