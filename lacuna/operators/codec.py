"""Fields of images and sounds as chunk tables in the byte format, and back.

A field is encoded and decoded by one Arrow kernel; the tables scale over fields.  Chunk table:
(cid, name, data, score).  Any non-empty subset of a field's chunks decodes; chunks that do not parse are left out,
geometry is that of the first that does (by name), and a block's later copies overwrite earlier ones.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lacuna.functions import bytes as B
from lacuna.functions import gf256
from lacuna.functions import golden_np as G
from lacuna.functions import transforms as T
from lacuna.operators import coarse as C
from lacuna.operators.recovery import pack_recovery, random_coefficients, unpack_recovery

Chunk = tuple[str, bytes, float]


def blocks_for(residual_bytes: int, coarse: int, kb: int | None = None, most_bytes: int | None = None, blocks: int = 32) -> int:
    """Number of chunks: a target size overrides a given number."""
    if kb is not None:
        target, over = max(256, kb * 1024), 96 + coarse
    elif most_bytes is not None:
        target, over = max(256, most_bytes), 30 + coarse
    else:
        return blocks
    return 1 if target <= over + 16 else max(1, -(-residual_bytes // (target - over)))


def _coded(kind: int, version: int, slices: list[bytes], overhead: float, seed: int | None) -> list[Chunk]:
    n = int(np.ceil(len(slices) * overhead))
    width = max(map(len, slices), default=0)
    if n <= 0 or width <= 0:
        return []
    m = np.stack([np.frombuffer(s.ljust(width, b"\0"), np.uint8) for s in slices])
    coefs = random_coefficients(n, len(slices), seed)
    return [(f"recovery_{i:04d}.bin", pack_recovery(kind, version, len(slices), i, width, c.tobytes(), p.tobytes()), 0.0) for i, (c, p) in enumerate(zip(coefs, gf256.combine(coefs, m), strict=True))]


# --- images -----------------------------------------------------------------------------------


def encode_image(a: np.ndarray, version: int = 3, blocks: int = 32, kb: int | None = None, most_bytes: int | None = None, quality: int = 50, dct_block: int = 8, model: str = "downsample", overhead: float = 0.0, seed: int | None = None, coarse_max_side: int = 16) -> list[Chunk]:
    """Chunks of an (h, w, 3) image: version 1 strides pixels, 2 permutes them, 3 permutes transform coefficients."""
    h, w, c = a.shape
    net = C.get(model if version == 3 else "downsample", "image")
    options = {"coarse_max_side": coarse_max_side, "quality": quality, "dct_block": dct_block}
    payload = net.encode(a, **options)
    residual = a.astype(np.int16) - net.decode(payload, a.shape, **options)
    if version == 3:
        vec, clipped = C.image_coefficients(residual.astype(float), quality, dct_block)
        name = model.lower().encode()
        payload = struct.pack(">4sBBBBHHIB", B.COARSE_IMAGE, 2, dct_block, quality, int(clipped), -h % dct_block, -w % dct_block, len(payload), len(name)) + name + payload
    else:
        vec = residual.ravel()
    vec = vec.astype(np.int16)
    n = max(1, min(blocks_for(vec.nbytes, len(payload), kb, most_bytes, blocks), len(vec)))
    slices = [vec[b::n] for b in range(n)] if version == 1 else G.split(vec, n)
    out = []
    for b, s in enumerate(slices):
        raw = zlib.compress(s.astype("<i2").tobytes(), 9)
        score = float((s.astype(np.int64) ** 2).sum()) if version == 3 else float(np.abs(s.astype(np.int64)).sum())
        out.append((f"chunk_{b:04d}.bin", B.IMAGE_HEADER.pack(B.IMAGE, version, h, w, c, n, b, len(payload), len(raw)) + payload + raw, score))
    return out + (_coded(1, version, [s.astype("<i2").tobytes() for s in slices], overhead, seed) if overhead else [])


def encode_audio(x: np.ndarray, rate: int, version: int = 3, blocks: int = 16, kb: int | None = None, quality: int = 50, n_fft: int = 512, hop: int | None = None, model: str = "downsample", overhead: float = 0.0, seed: int | None = None, coarse_max_frames: int = 2048) -> list[Chunk]:
    """Chunks of int16 (n, channels) samples; version 3 names chunks by the rank of their energy."""
    n, ch = x.shape
    hop = hop or n_fft // 2
    net = C.get(model if version == 3 else "downsample", "audio")
    options = {"coarse_len": max(2, coarse_max_frames), "quality": quality, "n_fft": n_fft, "hop": hop}
    payload = net.encode(x, **options)
    kept = n if model == "latent_lowfreq" and version == 3 else min(n, max(2, coarse_max_frames))
    residual = x.astype(np.int32) - net.decode(payload, x.shape, **options)
    q = T.audio_coefficients(residual, quality, n_fft, hop).ravel() if version == 3 else residual.ravel()
    clipped = bool(((q > 32767) | (q < -32768)).any())
    vec = np.clip(q, -32768, 32767).astype(np.int16)
    if version == 3:
        name = model.lower().encode()
        payload = struct.pack(">4sBBBBII", B.COARSE_AUDIO, 2, min(100, max(1, quality)), int(clipped), len(name), n_fft, hop) + name + payload
    m = max(1, min(blocks_for(vec.nbytes, len(payload), kb, None, blocks), len(vec)))
    slices = [vec[b::m] for b in range(m)] if version == 1 else G.split(vec, m)
    energy = [float((s.astype(np.int64) ** 2).sum()) for s in slices]
    order = sorted(range(m), key=lambda b: -energy[b]) if version == 3 else range(m)
    out = []
    for rank, b in enumerate(order):
        raw = zlib.compress(slices[b].astype("<i2").tobytes(), 9)
        out.append((f"chunk_{rank:04d}.bin", B.AUDIO_HEADER.pack(B.AUDIO, version, ch, 2, int(clipped), rate, n, m, b, kept, len(payload), len(raw)) + payload + raw, energy[b]))
    return out + (_coded(2, version, [s.astype("<i2").tobytes() for s in slices], overhead, seed) if overhead else [])


# --- decoding ---------------------------------------------------------------------------------


@dataclass
class Field:
    """What has come of one field: geometry, coarse payload, vector and mask."""

    kind: str
    version: int
    shape: tuple
    blocks: int
    rate: int = 0
    coarse: bytes = b""
    vec: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int16))
    mask: np.ndarray = field(default_factory=lambda: np.zeros(0, bool))

    def meta(self):
        """(model, quality, block or n_fft, hop, payload) of a version-3 coarse part."""
        if self.kind == "image":
            if self.coarse[4] == 1:
                _, _, block, quality, _, _, _, n = struct.unpack(">4sBBBBHHI", self.coarse[:16])
                return "downsample", quality, block, 0, self.coarse[16 : 16 + n]
            _, _, block, quality, _, _, _, n, k = struct.unpack(">4sBBBBHHIB", self.coarse[:17])
            return self.coarse[17 : 17 + k].decode(), quality, block, 0, self.coarse[17 + k : 17 + k + n]
        _, version, quality, _, k, n_fft, hop = struct.unpack(">4sBBBBII", self.coarse[:16])
        k = 0 if version == 1 else k  # the first version has no name
        return self.coarse[16 : 16 + k].decode() or "downsample", quality, n_fft, max(1, hop), self.coarse[16 + k :]


def parse_chunk(data: bytes):
    """(kind, version, shape, rate, blocks, block_id, coarse, slice) or None."""
    try:
        if data[:4] == B.IMAGE and len(data) >= 30:
            _, v, h, w, c, n, b, cl, rl = B.IMAGE_HEADER.unpack(data[:30])
            kind, shape, rate, at = "image", (h, w, c), 0, 30
        elif data[:4] == B.AUDIO and len(data) >= 36:
            _, v, ch, width, _, rate, frames, n, b, _, cl, rl = B.AUDIO_HEADER.unpack(data[:36])
            kind, shape, at = "audio", (frames, ch), 36
            if width != 2:
                return None
        else:
            return None
        if v not in (1, 2, 3) or n <= 0 or b >= n or at + cl + rl > len(data):
            return None
        coarse = data[at : at + cl]
        raw = zlib.decompress(data[at + cl : at + cl + rl])
        return kind, v, shape, rate, n, b, coarse, np.frombuffer(raw[: len(raw) // 2 * 2], "<i2")
    except (zlib.error, struct.error):
        return None


def select(chunks: list[Chunk], most: int | None = None, by_gain: bool = False) -> list[Chunk]:
    """By name, or by score with ties by name; at least one if limited."""
    order = sorted(chunks, key=lambda c: c[0])
    if by_gain:
        order = sorted(order, key=lambda c: -(c[2] or 0.0))
    return order if most is None else order[: max(1, most)]


def gather(chunks: list[Chunk], most: int | None = None, by_gain: bool = False, use_recovery: bool | None = None) -> Field | None:
    """The field that the chunks give, with what parity can restore; None if nothing parses."""
    coded = [u for n, d, _ in sorted(chunks) if n.startswith("recovery_") and (u := unpack_recovery(d))]
    f, slices = None, {}
    for _, data, _ in select([c for c in chunks if not c[0].startswith("recovery_")], most, by_gain):
        p = parse_chunk(data)
        if p is None:
            continue
        kind, v, shape, rate, n, b, coarse, s = p
        if f is None:
            f = Field(kind, v, shape, n, rate, coarse)
        if (kind, shape, n, rate) == (f.kind, f.shape, f.blocks, f.rate) and (v == 3) == (f.version == 3):
            slices[b] = s
    if f is None:
        return None
    if f.version == 3:
        _, _, block, hop, _ = f.meta()
        if f.kind == "image":
            h, w, c = f.shape
            size = -(-h // block) * -(-w // block) * block * block * c
        else:
            size = f.shape[1] * T.frame_count(f.shape[0], block, hop) * (block // 2 + 1) * 2
    else:
        size = int(np.prod(f.shape))
    missing = [b for b in range(f.blocks) if b not in slices]
    if missing and coded and use_recovery is not False:
        slices |= _restore(f, slices, missing, coded)
    if f.version == 1:
        f.vec, f.mask = np.zeros(size, np.int16), np.zeros(size, bool)
        for b, s in slices.items():
            m = len(f.vec[b :: f.blocks])
            f.vec[b :: f.blocks][: len(s)], f.mask[b :: f.blocks][: len(s)] = s[:m], True
    else:
        f.vec, f.mask = G.scatter(size, f.blocks, slices)
    return f


def _restore(f: Field, slices: dict, missing: list[int], coded: list[dict]) -> dict[int, np.ndarray]:
    kind = 1 if f.kind == "image" else 2
    rows = [c for c in coded if c["kind"] == kind and c["codec"] == f.version and c["blocks"] == f.blocks and len(c["coeffs"]) >= f.blocks and any(c["coeffs"])]
    rows = [c for c in rows if c["slice_len"] == rows[0]["slice_len"]]
    if len(rows) < len(missing):
        return {}
    width = rows[0]["slice_len"]
    coefs = np.stack([np.frombuffer(c["coeffs"], np.uint8)[: f.blocks] for c in rows])
    rhs = np.stack([np.frombuffer(c["payload"], np.uint8) for c in rows])
    if slices:
        ids = sorted(slices)
        known = np.stack([np.frombuffer(slices[b].astype("<i2").tobytes()[:width].ljust(width, b"\0"), np.uint8) for b in ids])
        rhs = rhs ^ gf256.combine(coefs[:, ids], known)
    x, _ = gf256.solve(coefs[:, missing], rhs)
    return {} if x is None else {b: np.frombuffer(r.tobytes(), "<i2") for b, r in zip(missing, x, strict=True)}


def coarse_of(f: Field) -> np.ndarray:
    """The coarse part of a field at full size."""
    if f.version != 3:
        return C.get("downsample", f.kind).decode(f.coarse, f.shape)
    model, quality, block, hop, payload = f.meta()
    return C.get(model, f.kind).decode(payload, f.shape, quality=quality, dct_block=block, n_fft=block, hop=hop)


def render(f: Field, vec: np.ndarray | None = None, base: np.ndarray | None = None) -> np.ndarray:
    """uint8 image (v3 truncated) or int16 sound (half-even) of a field; ``vec`` replaces its coefficients, ``base`` its coarse part."""
    v = (f.vec if vec is None else vec).astype(float)
    base = coarse_of(f) if base is None else base
    if f.version == 3:
        _, quality, block, hop, _ = f.meta()
        if f.kind == "image":
            return np.clip(np.round(base + C.image_of(v, f.shape, quality, block), 9), 0, 255).astype(np.uint8)
        n, ch = f.shape
        x = T.audio_of(v.reshape(ch, -1, block // 2 + 1, 2), n, quality, block, hop)
        return np.clip(base.astype(np.int32) + T.rint(x), -32768, 32767).astype(np.int16)
    x = base.astype(np.int32) + v.reshape(f.shape).astype(np.int32)
    return np.clip(x, 0, 255).astype(np.uint8) if f.kind == "image" else np.clip(x, -32768, 32767).astype(np.int16)


def confidence(f: Field) -> np.ndarray:
    """Block map of an image or sample curve of a sound, in 0..1."""
    if f.kind == "image" and f.version == 3:
        _, quality, block, _, _ = f.meta()
        h, w, c = f.shape
        wt = 1 / T.quant_table(block, quality).ravel()[T.zigzag(block)]
        m = f.mask.reshape(c, -(-h // block), -(-w // block), block * block)
        return ((m * wt).sum(-1) / wt.sum()).mean(0).astype(np.float32)
    if f.kind == "image":
        h, w, _ = f.shape
        m = np.pad(f.mask.reshape(f.shape).mean(2), ((0, -h % 8), (0, -w % 8)))
        return m.reshape(m.shape[0] // 8, 8, -1, 8).mean((1, 3)).astype(np.float32)
    n, ch = f.shape
    if f.version != 3:
        return f.mask.reshape(n, ch).mean(1).astype(np.float32)
    _, _, n_fft, _, _ = f.meta()
    wt = 1 / (1 + np.arange(n_fft // 2 + 1))
    m = f.mask.reshape(ch, -1, n_fft // 2 + 1, 2).mean(-1)
    frames = np.clip((m * wt).sum(-1).mean(0) / wt.sum(), 0, 1)
    return np.interp(np.arange(n), np.linspace(0, n - 1, len(frames)), frames).astype(np.float32)


def heal(chunks: list[Chunk], kb: int = 32, honest: bool = False, **options) -> list[Chunk]:
    """The field's best state sliced anew; honest healing draws values towards the coarse part where confidence is low."""
    f = gather(chunks, **options)
    if f is None:
        return []
    if f.version != 3:
        a = render(f)
        if honest:
            base = coarse_of(f)
            c = confidence(f)
            c = np.kron(c, np.ones((8, 8)))[: f.shape[0], : f.shape[1], None] if f.kind == "image" else c[:, None]
            a = np.rint(base + (a.astype(float) - base) * c).astype(a.dtype)
        return encode_image(a, 2, kb=kb) if f.kind == "image" else encode_audio(a, f.rate, 2, kb=kb)
    vec = f.vec
    if honest:
        c = confidence(f)
        _, _, block, hop, _ = f.meta()
        if f.kind == "image":
            wide = np.broadcast_to(c[None, :, :, None], (f.shape[2], *c.shape, block * block)).ravel()
        else:
            m = T.frame_count(f.shape[0], block, hop)
            per = np.interp(np.linspace(0, f.shape[0] - 1, m), np.arange(f.shape[0]), c)
            wide = np.broadcast_to(per[None, :, None, None], (f.shape[1], m, block // 2 + 1, 2)).ravel()
        vec = np.rint(vec * wide).astype(np.int16)
    n = max(1, min(blocks_for(vec.nbytes, len(f.coarse), kb), len(vec)))
    out = []
    for b, s in enumerate(G.split(vec, n)):
        raw, score = zlib.compress(s.astype("<i2").tobytes(), 9), float((s.astype(np.int64) ** 2).sum())
        if f.kind == "image":
            head = B.IMAGE_HEADER.pack(B.IMAGE, 3, *f.shape, n, b, len(f.coarse), len(raw))
        else:
            head = B.AUDIO_HEADER.pack(B.AUDIO, 3, f.shape[1], 2, 0, f.rate, f.shape[0], n, b, 0, len(f.coarse), len(raw))
        out.append((f"chunk_{b:04d}.bin", head + f.coarse + raw, score))
    return out


def heal_fixed_point(chunks: list[Chunk], rounds: int = 4, tol: float = 1e-3, metric: str = "mse", **options) -> tuple[list[Chunk], list[float], list[float]]:
    """Healing repeated: (chunks, change per round, distance from the first)."""
    f = gather(chunks)
    first = last = render(f).astype(float)
    deltas, drift = [], []
    for _ in range(rounds):
        chunks = heal(chunks, **options)
        now = render(gather(chunks)).astype(float)
        deltas.append(error(last, now, metric))
        drift.append(error(first, now, metric))
        last = now
        if len(deltas) > 1:
            gain = (deltas[-1] - deltas[-2]) if metric == "psnr" else (deltas[-2] - deltas[-1])
            if gain < -1e-9 or gain < tol:
                break
    return chunks, deltas, drift


def error(a: np.ndarray, b: np.ndarray, metric: str = "mse", peak: float = 255.0) -> float:
    d = a.astype(float) - b.astype(float)
    mse = float((d * d).mean())
    if metric == "l2":
        return float(np.sqrt((d * d).sum()))
    if metric == "psnr":
        return float("inf") if mse == 0 else float(20 * np.log10(peak) - 10 * np.log10(mse))
    return mse


def _gauge_view(f: Field, base: np.ndarray) -> np.ndarray:
    """What fields are aligned by: the block map of a coarse image's grey, or the envelope of a coarse sound's frames."""
    _, _, block, hop, _ = f.meta()
    if f.kind == "image":
        h, w, _ = f.shape
        grey = np.pad(base.astype(float).mean(2), ((0, -h % block), (0, -w % block)), mode="edge")
        return grey.reshape(grey.shape[0] // block, block, -1, block).mean((1, 3))
    loud = np.r_[0.0, np.cumsum(np.abs(base.astype(float)).mean(1))]
    start = np.minimum(np.arange(T.frame_count(len(base), block, hop)) * hop, len(base))
    end = np.minimum(start + block, len(base))
    return (loud[end] - loud[start]) / np.maximum(end - start, 1)


def stack(fields: list[Field], align: bool = True, least_peak: float = T.LEAST_PEAK, most: int | None = None) -> np.ndarray:
    """Several fields of one scene.  Version 3 throughout: means of the coarse parts and of the coefficients over what is
    present, each field moved by whole blocks or frames to where its coarse view fits the first's; fields of another
    geometry are left out.  Else plain means."""
    first = fields[0]
    if all(f.version == 3 and f.kind == first.kind for f in fields):
        _, _, block, hop, _ = first.meta()
        axes, unit = (2, block) if first.kind == "image" else (1, hop)
        vec, weight, base, seen, view = 0.0, 0.0, 0.0, 0.0, None
        for f in fields:
            if (f.shape, f.rate, *f.meta()[2:4]) != (first.shape, first.rate, block, hop):
                continue
            own = coarse_of(f)
            grid = (f.shape[2], -(-f.shape[0] // block), -(-f.shape[1] // block), -1) if f.kind == "image" else (f.shape[1], T.frame_count(f.shape[0], block, hop), -1)
            v, m, there = f.vec.reshape(grid).astype(float), f.mask.reshape(grid).astype(float), np.ones(f.shape[:axes])
            by = (0,) * axes
            if view is None:
                view = _gauge_view(f, own)
            elif align:
                by = T.gauge_shift(view, _gauge_view(f, own), least_peak, most, window=True)
            own = own.astype(float)
            for axis, b in enumerate(by):
                v, m = T.shifted(v, b, axis + 1), T.shifted(m, b, axis + 1)
                own, there = T.shifted(own, b * unit, axis), T.shifted(there, b * unit, axis)
            vec, weight, base, seen = vec + v * m, weight + m, base + own * there[..., None], seen + there
        return render(first, (vec / np.maximum(weight, 1)).ravel(), base / np.maximum(seen, 1)[..., None])
    shown = [render(f).astype(float) for f in fields if f.kind == first.kind and f.rate == first.rate]
    if first.kind == "image":
        return np.mean([s for s in shown if s.shape == shown[0].shape], axis=0).astype(np.uint8)
    n = min(map(len, shown))
    return np.rint(np.mean([s[:n] for s in shown], axis=0)).astype(np.int16)


# --- tables -----------------------------------------------------------------------------------

CHUNKS = "cid long, name string, data binary, score double"


def encode_images(df: DataFrame, **options) -> DataFrame:
    """Chunk table of (cid, h, w, pixels binary rgb)."""

    def run(batches):
        for b in batches:
            for cid, h, w, px in zip(*[c.to_pylist() for c in b.columns], strict=True):
                yield _batch(cid, encode_image(np.frombuffer(px, np.uint8).reshape(h, w, 3), **options))

    return df.select("cid", "h", "w", "pixels").mapInArrow(run, CHUNKS)


def encode_sounds(df: DataFrame, rate: int, **options) -> DataFrame:
    """Chunk table of (cid, samples array) mono sounds."""

    def run(batches):
        for b in batches:
            for cid, x in zip(*[c.to_pylist() for c in b.columns], strict=True):
                yield _batch(cid, encode_audio(np.array(x, np.int16).reshape(-1, 1), rate, **options))

    return df.select("cid", "samples").mapInArrow(run, CHUNKS)


def _batch(cid: int, chunks: list[Chunk]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([cid] * len(chunks), pa.int64()), pa.array([c[0] for c in chunks]), pa.array([c[1] for c in chunks], pa.binary()), pa.array([c[2] for c in chunks])], names=["cid", "name", "data", "score"])


def _rows(t: pa.Table) -> list[Chunk]:
    return list(zip(t["name"].to_pylist(), t["data"].to_pylist(), t["score"].to_pylist(), strict=True))


def decode_fields(chunks: DataFrame, most: int | None = None, by_gain: bool = False, use_recovery: bool | None = None) -> DataFrame:
    """(cid, kind, shape, values binary, confidence array): each field's best reconstruction."""

    def run(t: pa.Table) -> pa.Table:
        f = gather(_rows(t), most, by_gain, use_recovery)
        cid = t["cid"][0].as_py()
        if f is None:
            return pa.table({"cid": pa.array([], pa.int64()), "kind": pa.array([], pa.string()), "shape": pa.array([], pa.list_(pa.int32())), "values": pa.array([], pa.binary()), "confidence": pa.array([], pa.list_(pa.float32()))})
        return pa.table({"cid": [cid], "kind": [f.kind], "shape": pa.array([list(f.shape)], pa.list_(pa.int32())), "values": [render(f).tobytes()], "confidence": pa.array([confidence(f).ravel().tolist()], pa.list_(pa.float32()))})

    return chunks.groupBy("cid").applyInArrow(run, "cid long, kind string, shape array<int>, values binary, confidence array<float>")


def heal_fields(chunks: DataFrame, **options) -> DataFrame:
    def run(t: pa.Table) -> pa.Table:
        return pa.Table.from_batches([_batch(t["cid"][0].as_py(), heal(_rows(t), **options))])

    return chunks.groupBy("cid").applyInArrow(run, CHUNKS)
