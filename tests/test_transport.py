"""Modem, frames, datagrams and gossip."""

import datetime

import numpy as np
from pyspark.sql import functions as F

from lacuna.functions import bytes as B
from lacuna.functions import modem as M
from lacuna.operators import transport as T

CID = "c45da5fabae44317c8745e0879825bf9"


def test_modem_hears_itself():
    for seed, n, noisy in ((0, 64, False), (1, 80, True)):
        payload = np.random.default_rng(seed).bytes(n)
        x = M.Modem().encode(payload)
        assert M.Modem().decode(M.awgn(x, 30, np.random.default_rng(3)) if noisy else x) == [payload]


def test_two_frames_and_pieces():
    a, b = b"first" * 9, b"second" * 5
    x = np.concatenate([M.Modem().encode(a), M.Modem().encode(b)])
    assert M.Modem().decode(x) == [a, b]
    dec, got = M.FrameDecoder(), []
    for byte in M.build_frame(a) + M.build_frame(b):
        got += dec.push(bytes([byte]))
    assert got == [a, b]


def test_sound_transport():
    chunks = [(1, b"alpha" * 40), (2, b"beta")]
    x = M.chunks_to_sound(chunks, bytes(16), most=100)
    assert M.sound_to_chunks(x) == {(bytes(16), k): v for k, v in chunks}
    assert M.sound_to_chunks(x, b"x" * 16) == {}


def test_published_datagrams(spark):
    c = spark.createDataFrame([(bytearray.fromhex(CID), 7, bytearray(b"hello"))], "content_id binary, chunk_id long, data binary")
    plain = T.fragments(c, 64).first()["datagram"].hex()
    assert plain == f"484f4454{CID}00000007000000010000000568656c6c6f"
    sealed = T.fragments(c, 128, seal_key=bytes(range(16)), key_id=3).first()["datagram"].hex()
    assert sealed.endswith("03c30b9aca012eab82b37b929cd45bd36c7b3a9fb9338252e5515aa9a4f4d35a9d88")
    signed = T.fragments(c, 128, auth_key=bytes(range(32))).first()["datagram"].hex()
    assert signed.endswith("2a6be14fb0380719756dfe673d6108b9d45110165813ac21e3ce2d0ea2fa481d")


def test_published_control_and_ids(spark):
    i = spark.createDataFrame([(bytearray.fromhex(CID), [0, 1, 2, 42])], "content_id binary, ids array<int>")
    d = T.control(i, B.INVENTORY)
    assert d.first()["datagram"].hex() == f"484f435401{CID}00040000000100 02002a".replace(" ", "")
    assert T.parse_control(d).first()["ids"] == [0, 1, 2, 42]
    row = spark.range(1).select(B.frame_content_id(F.lit("stream-1"), F.lit(7)).alias("i"), B.content_id(F.lit(" a ")).alias("a"), B.content_id(F.lit("a")).alias("b")).first()
    assert bytes(row["i"]).hex() == "6bb7b5784127a1326e5129ef8c658ce7" and row["a"] == row["b"]


def test_stream_keeps_contents_apart_and_drops_old_partials(spark, tmp_path):
    """Two contents use one chunk id; a partial without a successor is dropped by the watermark."""
    from lacuna.streaming import assembly

    schema = "content_id string, chunk_id long, frag_idx int, frag_total int, chunk_len long, payload binary, at timestamp"
    t = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    part = lambda c, i, n, p, s: (c, 7, i, n, 100, bytearray(p), t(s))
    batches = [
        [part("a", 0, 2, b"a0", 0), part("b", 0, 2, b"b0", 0), part("c", 0, 3, b"c0", 0), part("d", 0, 2, b"d0", 0)],
        [part("b", 1, 2, b"b1", 2), part("a", 1, 2, b"a1", 3), part("a", 1, 2, b"a1", 3), part("d", 1, 2, b"d1", 9)],
        [part("e", 0, 1, b"e0", 60)],
        [part("f", 0, 1, b"f0", 61)],
    ]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    s = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{tmp_path}/in")
    events = assembly.run_once(assembly.assemble(s, max_age=5), "test").collect()
    done = {r["content_id"]: bytes(r["data"]) for r in events if r["event"] == "complete"}
    assert done == {"a": b"a0a1", "b": b"b0b1", "e": b"e0", "f": b"f0"}
    late = sorted((r["content_id"], r["frags"]) for r in events if r["event"] == "expired")
    # a's duplicate came after its chunk was whole and opened a partial; d's first was dropped by its second, that one by the watermark
    assert late == [("a", 1), ("c", 1), ("d", 1), ("d", 1)]


def test_assembly_order_and_duplicates(spark):
    c = spark.createDataFrame([(bytearray(16), k, bytearray(f"payload {k} ".encode() * 20)) for k in range(3)], "content_id binary, chunk_id long, data binary")
    f = T.fragments(c, 64)
    twice = f.union(f).withColumn("recv", F.rand(1)).select("datagram", "recv")
    back = {r["chunk_id"]: bytes(r["data"]) for r in T.assemble(T.parse(twice)).collect()}
    assert back == {k: f"payload {k} ".encode() * 20 for k in range(3)}
    assert T.assemble(T.parse(twice.where(F.lit(False)))).count() == 0
