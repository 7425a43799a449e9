"""Erasure recovery: random linear parity over slices, and the all-or-nothing solution for missing ones."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.functions import gf256
from lacuna.functions.bytes import RECOVERY, RECOVERY_HEADER


def _matrix(slices: list[bytes]) -> np.ndarray:
    width = max(map(len, slices), default=0)
    return np.stack([np.frombuffer(s.ljust(width, b"\0"), np.uint8) for s in slices])


def random_coefficients(coded: int, blocks: int, seed: int) -> np.ndarray:
    """Non-zero coefficients, drawn row after row."""
    rng = np.random.default_rng(seed)
    return np.stack([rng.integers(1, 256, size=blocks, dtype=np.uint8) for _ in range(coded)]) if coded else np.zeros((0, blocks), np.uint8)


def parity(chunks: DataFrame, overhead: float, coefficients=random_coefficients, seed: int = 0) -> DataFrame:
    """(cid, coded_id, coeffs, payload, slice_len) from all (cid, block_id, slice) of each field."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("block_id")
        m = _matrix(t["slice"].to_pylist())
        coded = int(np.ceil(len(m) * overhead))
        cid = t["cid"][0].as_py()
        c = coefficients(coded, len(m), seed + cid)
        out = gf256.combine(c, m)
        return pa.table({"cid": pa.array([cid] * coded, pa.int64()), "coded_id": pa.array(range(coded), pa.int32()), "coeffs": [r.tobytes() for r in c], "payload": [r.tobytes() for r in out], "slice_len": pa.array([m.shape[1]] * coded, pa.int32())})

    return chunks.select("cid", "block_id", "slice").groupBy("cid").applyInArrow(run, "cid long, coded_id int, coeffs binary, payload binary, slice_len int")


def recover(received: DataFrame, coded: DataFrame) -> DataFrame:
    """(cid, block_id, slice, rank): slices that received(cid, block_id, slice, blocks) lack, if all can be solved.

    Recovery rows of other geometry and zero rows are left out.
    """

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        none = pa.table({"cid": pa.array([], pa.int64()), "block_id": pa.array([], pa.int32()), "slice": pa.array([], pa.binary()), "rank": pa.array([], pa.int32())})
        if not left.num_rows or not right.num_rows:
            return none
        blocks = left["blocks"][0].as_py()
        known = dict(zip(left["block_id"].to_pylist(), left["slice"].to_pylist(), strict=True))
        missing = [b for b in range(blocks) if b not in known]
        rows = [(c, p, n) for c, p, n in zip(right["coeffs"].to_pylist(), right["payload"].to_pylist(), right["slice_len"].to_pylist(), strict=True) if len(c) >= blocks and any(c)]
        if not missing or not rows:
            return none
        width = rows[0][2]
        rows = [r for r in rows if r[2] == width and len(r[1]) == width]
        coefs = np.stack([np.frombuffer(c, np.uint8)[:blocks] for c, _, _ in rows])
        rhs = _matrix([p for _, p, _ in rows])
        if known:
            ids = sorted(known)
            rhs = rhs ^ gf256.combine(coefs[:, ids], _matrix([known[b].ljust(width, b"\0") for b in ids]))
        x, rank = gf256.solve(coefs[:, missing], rhs)
        if x is None:
            return none
        return pa.table({"cid": pa.array([left["cid"][0].as_py()] * len(missing), pa.int64()), "block_id": pa.array(missing, pa.int32()), "slice": [r.tobytes() for r in x], "rank": pa.array([rank] * len(missing), pa.int32())})

    left = received.select("cid", F.col("block_id").cast("int").alias("block_id"), "slice", "blocks").groupBy("cid")
    return left.cogroup(coded.select("cid", "coeffs", "payload", "slice_len").groupBy("cid")).applyInArrow(run, "cid long, block_id int, slice binary, rank int")


# --- byte format ------------------------------------------------------------------------------


def pack_recovery(kind: int, codec: int, blocks: int, coded_id: int, slice_len: int, coeffs: bytes, payload: bytes, compress: bool = True) -> bytes:
    small = zlib.compress(payload, 9) if compress else payload
    flag = int(compress and len(small) < len(payload))
    body = small if flag else payload
    return RECOVERY_HEADER.pack(RECOVERY, 1, kind, codec, flag, blocks, coded_id, slice_len, len(coeffs), len(body)) + coeffs + body


def unpack_recovery(data: bytes) -> dict | None:
    """Fields of a recovery chunk, or None if anything does not fit."""
    size = RECOVERY_HEADER.size
    if len(data) < size:
        return None
    magic, version, kind, codec, flags, blocks, coded_id, slice_len, coeff_len, payload_len = RECOVERY_HEADER.unpack(data[:size])
    if magic != RECOVERY or version != 1 or coeff_len <= 0 or payload_len <= 0 or len(data) < size + coeff_len + payload_len:
        return None
    payload = data[size + coeff_len : size + coeff_len + payload_len]
    if flags & 1:
        try:
            payload = zlib.decompress(payload)
        except zlib.error:
            return None
    if len(payload) != slice_len:
        return None
    return {"kind": kind, "codec": codec, "blocks": blocks, "coded_id": coded_id, "slice_len": slice_len, "coeffs": data[size : size + coeff_len], "payload": payload}
