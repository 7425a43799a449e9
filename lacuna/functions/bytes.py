"""Wire formats and byte functions as column expressions; Python twins where Spark has no built-in."""

from __future__ import annotations

import binascii
import hashlib
import struct

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Magics, header layouts and limits of the wire formats.
IMAGE, AUDIO, RECOVERY, PACKED = b"HOCH", b"HOAU", b"HORC", b"HOPK"
DATA, CONTROL = b"HODT", b"HOCT"
COARSE_IMAGE, COARSE_AUDIO = b"OLOI", b"OLOA"
IMAGE_HEADER = struct.Struct(">4sBIIBIIII")
AUDIO_HEADER = struct.Struct(">4sBBBBIIIIIII")
RECOVERY_HEADER = struct.Struct(">4sBBBBIIIII")
PACKED_HEADER = struct.Struct(">4sBIIQI")
DATA_HEADER = struct.Struct(">4s16sIHHI")
CONTROL_HEADER = struct.Struct(">4sB16sH")
FRAME_HEADER = struct.Struct(">HBB")
SYNC, PREAMBLE = b"\x2d\xd4", b"\x55"
INVENTORY, WANT = 1, 2
RECOVERY_ID_BASE = 1_000_000
MAC_BYTES, SEAL_BYTES = 32, 29
MOST_IDS = 64  # in an inventory or a want


def be(c: Column, width: int) -> Column:
    """Big-endian bytes of a non-negative number."""
    return F.unhex(F.lpad(F.hex(c.cast("long")), 2 * width, "0"))


def from_be(c: Column, at: int, width: int) -> Column:
    """Big-endian number in ``width`` bytes of a binary column from byte ``at`` (0-based)."""
    return F.conv(F.hex(F.substring(c, at + 1, width)), 16, 10).cast("long")


def lit_bytes(b: bytes) -> Column:
    return F.unhex(F.lit(b.hex()))


def hmac_sha256(key: bytes, message: Column) -> Column:
    """HMAC by two nested digests."""
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner = F.sha2(F.concat(lit_bytes(bytes(b ^ 0x36 for b in key)), message), 256)
    return F.unhex(F.sha2(F.concat(lit_bytes(bytes(b ^ 0x5C for b in key)), F.unhex(inner)), 256))


def _arrow(name: str, f, kind: str):
    """A scalar Arrow function of one binary or string column."""
    out = {"binary": pa.binary(), "int": pa.int32(), "string": pa.string()}[kind]

    def run(x: pa.Array) -> pa.Array:
        return pa.array([None if v is None else f(v) for v in x.to_pylist()], out)

    run.__name__ = name
    return F.arrow_udf(run, kind) if hasattr(F, "arrow_udf") else F.udf(lambda v: None if v is None else f(v), kind, useArrow=True)


def content_id(uri: Column) -> Column:
    """Sixteen-byte BLAKE2s of the stripped address."""
    return _arrow("content_id", lambda u: hashlib.blake2s(u.strip().encode(), digest_size=16).digest(), "binary")(uri)


def frame_content_id(stream: Column, frame: Column) -> Column:
    return content_id(F.concat(stream.cast("string"), F.lit("::"), frame.cast("int").cast("string")))


def nonce(header: Column, frag: Column) -> Column:
    return _arrow("nonce", lambda h: hashlib.blake2s(h, digest_size=12).digest(), "binary")(F.concat(header, be(frag, 2)))


def crc16(data: Column) -> Column:
    """CRC-16 with polynomial 0x1021 and initial value 0xFFFF."""
    return _arrow("crc16", lambda b: binascii.crc_hqx(bytes(b), 0xFFFF), "int")(data)


def frame(payload: Column, flags: int = 0, preamble: int = 16) -> Column:
    head = F.concat(be(F.length(payload), 2), lit_bytes(bytes([flags, 0])))
    return F.concat(lit_bytes(PREAMBLE * preamble + SYNC), head, payload, be(crc16(F.concat(head, payload)), 2))


def bits(data: Column) -> Column:
    """Bits of a binary column, the highest of each byte first."""
    byte = lambda i: F.conv(F.hex(F.substring(data, i + 1, 1)), 16, 10).cast("int")
    all_bits = F.flatten(F.transform(F.sequence(F.lit(0), F.length(data) - 1), lambda i: F.transform(F.array(*[F.lit(1 << k) for k in range(7, -1, -1)]), lambda m: (byte(i).bitwiseAND(m) != 0).cast("int"))))
    return F.when(F.length(data) == 0, F.array().cast("array<int>")).otherwise(all_bits)


def slug(text: Column) -> Column:
    """Letters, digits and -._ stay, the rest becomes _; empty becomes default."""
    s = F.regexp_replace(text, r"[^\p{L}\p{N}\-._]", "_")
    return F.when(s == "", "default").otherwise(s)


def chunk_id_of(name: Column) -> Column:
    """Id in a chunk's or recovery chunk's file name (0 if there is none; recovery ids start at a million)."""
    n = F.coalesce(F.regexp_extract(name, r"^(?:chunk|recovery)_(\d+)\.", 1).try_cast("long"), F.lit(0))
    return F.when(name.startswith("recovery_"), n + RECOVERY_ID_BASE).otherwise(n)


def parse_hex(text: Column) -> Column:
    t = F.lower(F.trim(text))
    return F.unhex(F.when(t.startswith("0x"), F.substring(t, 3, 1 << 30)).otherwise(t))
