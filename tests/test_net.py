"""Network commands: one machine's datagrams, control messages and node."""

import argparse
import base64
import json
import random
import socket
import time

import pytest

from lacuna import net
from lacuna.__main__ import main
from lacuna.functions import bytes as B

CID = "11" * 16
KEY = "0x" + "ab" * 16


def test_every_command_has_options():
    p = net.parser()
    assert len(net.COMMANDS) == 24
    with pytest.raises(SystemExit):
        p.parse_args(["mesh-sendto", "--peer", "127.0.0.1:1"])
    with pytest.raises(SystemExit):
        p.parse_args(["parse-control", "--data-hex", "00", "--data-base64", "AA=="])


def test_ids(spark, capsys, tmp_path):
    out = lambda *a: (main(["net", *a]), capsys.readouterr().out.strip())
    assert out("norm-uri", "--uri", "  a b ") == (0, "a b")
    code, one = out("id-hex", "--uri", " stream-1::7 ")
    assert one == out("stream-id", "--stream-id", "stream-1", "--frame-idx", "7")[1] == "6bb7b5784127a1326e5129ef8c658ce7"
    assert base64.b64decode(out("id-bytes", "--uri", "stream-1::7", "--format", "base64")[1]).hex() == one
    main(["net", "id-bytes", "--uri", "stream-1::7", "--format", "raw", "--out", str(tmp_path / "id")])
    assert (tmp_path / "id").read_bytes().hex() == one
    assert len(out("id-hex", "--uri", "x", "--digest-size", "8")[1]) == 16
    assert out("mesh-chunk-id", "--path", "/a/chunk_0012.bin") == (0, "12") and out("mesh-chunk-id", "--path", "chunk_x.bin") == (0, "0")
    assert out("mesh-recovery-id", "--path", "recovery_0003.bin") == (0, "3") and out("mesh-recovery-id", "--path", "chunk_0003.bin") == (0, "0")
    assert json.loads(out("constants")[1])["MAX_CTRL_CHUNKS"] == 64


def test_control(spark, capsys):
    def message(kind, ids):
        main(["net", f"encode-{kind}", "--content-id", CID, "--chunk-ids", *map(str, ids)])
        return capsys.readouterr().out.strip()

    for kind in ("inventory", "want"):
        data = message(kind, [*range(99, -1, -1), 5])
        assert main(["net", "parse-control", "--data-hex", data]) == 0
        assert json.loads(capsys.readouterr().out) == {"ctrl_type": kind, "content_id": CID, "chunk_ids": list(range(64))}
    other = bytearray.fromhex(data)
    other[4] = 9
    for bad in (data[:-2], other.hex(), "", "00" * 40):
        assert main(["net", "parse-control", "--data-hex", bad]) == 1
    with pytest.raises(SystemExit):
        main(["net", "encode-want", "--chunk-ids", "1"])


@pytest.mark.parametrize("secrets", [[], ["--auth-key", KEY], ["--auth-key", KEY, "--enc-key", KEY, "--enc-key-id", "4"]])
def test_datagrams_there_and_back(spark, capsys, tmp_path, secrets):
    data = bytes(range(256)) * 5
    (tmp_path / "c").write_bytes(data)
    p = lambda n: str(tmp_path / n)
    cut = ["net", "iter-datagrams", "--content-id", CID, "--chunk-id", "9", "--chunk-file", p("c"), "--max-payload", "300", *secrets]
    assert main([*cut, "--out", p("lines")]) == 0 and main([*cut, "--out-dir", p("d")]) == 0
    lines = (tmp_path / "lines").read_text().split()
    assert [bytes.fromhex(x) for x in lines] == [f.read_bytes() for f in sorted((tmp_path / "d").iterdir())]
    assert max(map(len, lines)) <= 600
    (tmp_path / "lines").write_text("\n".join([*lines[::-1], lines[0], ""]))
    assert main(["net", "assemble", "--input", p("lines"), *secrets, "--out-dir", p("o")]) == 0
    assert (tmp_path / "o" / CID / "chunk_0009.bin").read_bytes() == data
    (tmp_path / "lines").write_text("\n".join(lines[1:]))
    capsys.readouterr()
    assert main(["net", "assemble", "--input", p("lines"), *secrets]) == 1
    for advance, want in (("1", {"expired": 0, "partials": 1}), ("6", {"expired": 1, "partials": 0})):
        capsys.readouterr()
        main(["net", "assembler-expire", "--input", p("lines"), "--advance", advance, *secrets])
        assert json.loads(capsys.readouterr().out) == want


def test_order_by_gain(tmp_path, capsys):
    for i, s in enumerate(["1", "7", "x", "7"]):
        (tmp_path / f"chunk_{i:04d}.bin").write_bytes(b"c")
        (tmp_path / f"chunk_{i:04d}.bin.meta").write_text(s)
    order = lambda: [int(p[-8:-4]) for p in net.by_gain(str(tmp_path))]
    assert order() == [1, 3, 0, 2]
    (tmp_path / "manifest.json").write_text(json.dumps({"ordered_chunks": ["chunk_0002.bin", "chunk_0009.bin"]}))
    assert order() == [2]
    (tmp_path / "manifest.json").write_text(json.dumps({"objects": [], "ordered_chunks": ["chunk_0002.bin"]}))
    assert order() == [1, 3, 0, 2]


def test_node(spark, tmp_path):
    a = argparse.Namespace(max_payload=100, auth_key=None, enc_key=None, enc_key_id=0)
    cid, peer = bytes.fromhex(CID), ("127.0.0.1", 9)
    texts = {0: b"a" * 150, 3: b"b" * 20, B.RECOVERY_ID_BASE + 1: B.RECOVERY + b"r" * 90}
    rows = [(bytearray(cid), i, bytearray(t), i) for i, t in texts.items()]
    parts = [d for x in net.datagrams(spark.createDataFrame(rows, net.CHUNKS), a) for d in x]
    sent = []
    node = net.Node(str(tmp_path / "s"), a, lambda d, to: sent.append(d))
    assert node.ids(cid) == [] and node.announce(cid, [peer]) == 0
    assert node.take([(parts[0], peer), (b"noise", peer)], 0.0) == [] and len(node.waiting) == 1
    assert sorted(node.take([(p, peer) for p in parts[1:]], 1.0)) == [(CID, i) for i in texts] and node.waiting == []
    assert {r["chunk_id"]: bytes(r["data"]) for r in node.store.chunks(CID).collect()} == texts
    assert node.ids(cid) == [0, 3] and node.announce(cid, [peer, peer]) == 2 and sent[0] == sent[1]
    sent.clear()
    assert node.take([(net.control(B.INVENTORY, cid, [0, 3, 7, 5]), peer)], 2.0) == [] and sent == [net.control(B.WANT, cid, [5, 7])]
    sent.clear()
    node.take([(net.control(B.WANT, cid, [3, 0, 8]), peer)], 2.0)
    assert sent == parts[: len(sent)] and len(sent) == 4
    sent.clear()
    assert node.on_want(peer, cid, [3, 0]) == 2 and sent[0] == parts[3]
    assert node.take([(parts[0], peer)], 10.0) == [] and len(node.waiting) == 1
    node.take([(b"noise", peer)], 16.0)
    assert node.waiting == []


def test_sockets(spark, tmp_path, capsys):
    for i in range(3):
        (tmp_path / f"chunk_{i:04d}.bin").write_bytes(bytes([i]) * 50)
    (tmp_path / "recovery_0000.bin").write_bytes(B.RECOVERY + b"r" * 10)
    with net.udp("127.0.0.1:0") as s:
        to = "127.0.0.1:%d" % s.getsockname()[1]
        assert main(["net", "mesh-broadcast", "--uri", "u", "--chunk-dir", str(tmp_path), "--peer", to, "--send-recovery", "--repeats", "2", "--max-payload", "60"]) == 0
        assert capsys.readouterr().out.strip() == "sent chunks=8 datagrams=14"
        got = net.receive(s, 1.0)
        assert len(got) == 14
        assert main(["net", "mesh-sendto", "--peer", to, "--data-hex", "0102"]) == 0 and net.receive(s, 0.5)[0][0] == b"\1\2"
        assert main(["net", "send-chunk", "--addr", to, "--uri", "u", "--chunk-id", "1", "--chunk-file", str(tmp_path / "chunk_0001.bin")]) == 0
        assert net.receive(s, 0.5)[0][0].endswith(b"\1" * 50)
        node = net.Node(str(tmp_path / "store"), net.parser().parse_args(["mesh-recv", "--bind", to]), net.sender(s))
        assert len(node.take(got, time.time())) == 4
    capsys.readouterr()
    assert main(["net", "mesh-local-chunk-ids", "--uri", "u", "--store-root", str(tmp_path / "store")]) == 0
    assert capsys.readouterr().out.strip() == "0 1 2"
    assert main(["net", "mesh-handle-inventory", "--peer", to, "--uri", "u", "--chunk-ids", "1", "8", "--store-root", str(tmp_path / "store")]) == 0
    assert capsys.readouterr().out.strip() == "missing=1"
    assert main(["net", "mesh-join-mcast", "--mcast", "not-a-group:1", "--duration", "0"]) == 0
    assert capsys.readouterr().out.strip() == "joined 0 multicast groups"
    with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as s:
        s.bind(("127.0.0.1", 0))
        free = s.getsockname()[1]
    assert main(["net", "mesh-recv", "--bind", f"127.0.0.1:{free}", "--duration", "0.2", "--store-root", str(tmp_path / "r")]) == 0
    assert capsys.readouterr().out.strip() == "datagrams_seen=0 stored_chunks=0"


def test_gossip(spark, tmp_path):
    a = argparse.Namespace(max_payload=1200, auth_key=None, enc_key=None, enc_key_id=0)
    cid, peers, sent = bytes.fromhex(CID), [("127.0.0.1", 8), ("127.0.0.1", 9)], []
    node = net.Node(str(tmp_path / "s"), a, lambda d, to: sent.append((d, to)))
    rng = random.Random(1)
    node.turn([], 0.0, peers, rng)
    assert sent == []
    data = next(net.datagrams(spark.createDataFrame([(bytearray(cid), 4, bytearray(b"x" * 30), 0)], net.CHUNKS), a))[0]
    now = time.time()
    node.turn([(data, peers[0])], now, peers, rng, forward=1.0)
    told = net.control(B.INVENTORY, cid, [4])
    assert sent == [(d, p) for d in (data, data, told) for p in peers]  # forwarded, radiated, announced
    sent.clear()
    node.turn([(data, peers[0])], now, peers, rng, forward=1.0, inventory=False)
    assert sent == [(data, p) for p in peers]  # known: only radiated
    node.turn([], now + 100, [], rng, ttl=50)
    assert node.ids(cid) == [] and node.radiate(now, peers, rng) is None


def test_mesh_node_command(spark, tmp_path, capsys):
    assert main(["net", "mesh-node", "--bind", "127.0.0.1:0", "--duration", "0.2", "--store-root", str(tmp_path / "r")]) == 0
    assert capsys.readouterr().out.strip() == "datagrams_seen=0 stored_chunks=0"


@pytest.mark.parametrize(("forward", "ttl"), [(0.25, None), (1.0, 1), (0.0, 0)])
def test_spread(spark, forward, ttl):
    """Against the rules played peer by peer, with the operator's own draws."""
    from pyspark.sql import functions as F

    from lacuna.streaming import gossip

    n, ids, rounds = 7, 12, 4
    have = [(p, i) for p in range(n) for i in range(ids) if (p * 5 + i * 3) % 8 == 0]
    links = [(p, (p + s) % n) for p in range(n) for s in (1, 3)]
    grid = spark.range(n).select(F.col("id").alias("peer")).crossJoin(spark.range(ids))
    luck = {(k, r, x["peer"], x["id"]): x["u"] for k in (0, 1) for r in range(1, rounds + 1) for x in grid.withColumn("u", gossip.draw(5, k, r)).collect()}
    state = {h: (None, 0, True) for h in have}
    for r in range(1, rounds + 1):
        held = {k: v for k, v in state.items() if v[2]}
        arrived = set()
        for p, to in links:
            own = sorted(i for q, i in held if q == p)
            arrived |= {(to, i) for i in own if held[p, i][0] == r - 1 and luck[0, r, p, i] < forward}
            arrived |= {(to, i) for i in own[:2] if (to, i) not in held}
            if own:
                arrived.add((to, min(own, key=lambda i: luck[1, r, p, i])))
        for k in arrived:
            old = state.get(k, (None, 0, True))
            state[k] = (r if old[0] is None else old[0], r, True)
        state = {k: (s, last, ttl is None or r - last <= ttl) for k, (s, last, _) in state.items()}
    rows = [*have, *have[:3], (None, 1), (2, None)]
    got = gossip.spread(spark.createDataFrame(rows, "peer long, id long"), spark.createDataFrame(links * 2, "peer long, to long"), rounds, 5, forward, 2, ttl)
    assert {(x["peer"], x["id"]): (x["since"], x["last"], x["held"]) for x in got.collect()} == state
    assert gossip.spread(spark.createDataFrame([], "peer long, id long"), spark.createDataFrame(links, "peer long, to long"), 2).count() == 0
