"""``python -m lacuna net ...``: datagrams, control messages and a mesh node over the DataFrame operators.

Chunks become datagrams by ``transport.fragments`` and come back by ``parse`` and ``assemble``; a node's chunks are a
``ChunkStore``.  Sockets are the commands' own: what a command sends or takes in is one machine's traffic.
"""

from __future__ import annotations

import argparse
import base64
import hashlib
import itertools
import json
import os
import random
import re
import socket
import sys
import time
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.functions import bytes as B
from lacuna.operators import ordering as O
from lacuna.operators import transport as T
from lacuna.sources.datagrams import join_groups
from lacuna.store import ChunkStore

Address = tuple[str, int]
Sender = Callable[[bytes, Address], None]
CHUNKS = "content_id binary, chunk_id long, data binary, place int"
NAMES = {B.INVENTORY: "inventory", B.WANT: "want"}


def session() -> SparkSession:
    s = SparkSession.getActiveSession() or SparkSession.builder.appName("lacuna").config("spark.ui.enabled", "false").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


# --- values on the command line -----------------------------------------------------------------


def from_hex(text: str) -> bytes:
    return bytes.fromhex(re.sub(r"^0[xX]", "", text.strip()))


def address(text: str) -> Address:
    host, _, port = text.rpartition(":")
    return host, int(port)


def digest(text: str, size: int) -> bytes:
    return hashlib.blake2s(text.strip().encode(), digest_size=size).digest()


def content(a: argparse.Namespace) -> bytes:
    """The content that --uri or --content-id names."""
    if not (a.uri or a.content_id):
        raise SystemExit("give --uri or --content-id")
    cid = digest(a.uri, a.digest_size) if a.uri else from_hex(a.content_id)
    if len(cid) != 16:
        raise SystemExit("contents have 16 bytes")
    return cid


def given(a: argparse.Namespace) -> bytes:
    """The bytes of one of --data-hex, --data-base64 and --input."""
    if a.input is not None:
        with open(a.input, "rb") as f:
            return f.read()
    return from_hex(a.data_hex) if a.data_hex is not None else base64.b64decode(a.data_base64)


def encoded(data: bytes, kind: str) -> str:
    return data.hex() if kind == "hex" else base64.b64encode(data).decode()


def lines(a: argparse.Namespace) -> list[bytes]:
    if a.input:
        with open(a.input) as f:
            text = f.read()
    else:
        text = sys.stdin.read()
    return [from_hex(x) if a.format == "hex" else base64.b64decode(x) for x in text.split()]


def emit(data: bytes, a: argparse.Namespace) -> None:
    raw = data if a.format == "raw" else (encoded(data, a.format) + "\n").encode()
    if a.out:
        with open(a.out, "wb") as f:
            f.write(raw)
    elif a.format == "raw":
        sys.stdout.buffer.write(raw)
        sys.stdout.buffer.flush()
    else:
        print(raw.decode(), end="")


# --- what goes out ------------------------------------------------------------------------------


def keys(a: argparse.Namespace) -> dict:
    """Options of ``transport.fragments``."""
    return {"most": a.max_payload, "auth_key": from_hex(a.auth_key) if a.auth_key else None, "seal_key": from_hex(a.enc_key) if a.enc_key else None, "key_id": a.enc_key_id}


def datagrams(chunks: DataFrame, a: argparse.Namespace) -> Iterator[list[bytes]]:
    """Each chunk's datagrams, chunks(content_id, chunk_id, data, place) in order of place."""
    rows = T.fragments(chunks, **keys(a), keep=("place",)).orderBy("place", "frag_idx").select("place", "datagram").toLocalIterator()
    for _, group in itertools.groupby(rows, lambda r: r["place"]):
        yield [bytes(r["datagram"]) for r in group]


def one_chunk(a: argparse.Namespace) -> list[bytes]:
    with open(a.chunk_file, "rb") as f:
        rows = [(bytearray(content(a)), a.chunk_id, bytearray(f.read()), 0)]
    return next(datagrams(session().createDataFrame(rows, CHUNKS), a))


def control(kind: int, cid: bytes, ids: Iterable[int]) -> bytes:
    """A control datagram of the least ids, each once."""
    ids = sorted(set(ids))[: B.MOST_IDS]
    df = session().createDataFrame([(bytearray(cid), ids)], "content_id binary, ids array<long>")
    return bytes(T.control(df, kind).first()["datagram"])


def udp(bind: str | None = None) -> socket.socket:
    s = socket.socket(socket.AF_INET, socket.SOCK_DGRAM)
    if bind:
        s.bind(address(bind))
    return s


def sender(sock: socket.socket) -> Sender:
    """Sends as the network would: errors are lost datagrams."""

    def send(data: bytes, to: Address) -> None:
        try:
            sock.sendto(data, to)
        except OSError:
            pass

    return send


# --- chunk folders ------------------------------------------------------------------------------


def name_id(path: str, kind: str) -> int:
    """The number in the name of a file of this kind (chunk or recovery), 0 if there is none."""
    found = re.fullmatch(kind + r"_(\d+)\.[^.]+", os.path.basename(path))
    return int(found[1]) if found else 0


def folder(path: str, kind: str) -> list[str]:
    return [f"{path}/{n}" for n in sorted(os.listdir(path)) if n.startswith(kind + "_") and not n.endswith(".meta")]


def by_gain(path: str) -> list[str]:
    """A folder's chunks as its manifest of one object lists them, else by falling score (none: 0) and name."""
    try:
        with open(f"{path}/manifest.json") as f:
            listed = json.load(f)
        names = [] if "objects" in listed else listed["ordered_chunks"]
        there = [f"{path}/{n}" for n in names if os.path.isfile(f"{path}/{n}")]
        if there:
            return there
    except (OSError, ValueError, KeyError, TypeError):
        pass  # no usable manifest: scores decide

    def score(name: str) -> float:
        try:
            with open(name + ".meta") as f:
                return float(f.read())
        except (OSError, ValueError):
            return 0.0

    return sorted(folder(path, "chunk"), key=lambda n: -score(n))


# --- a node -------------------------------------------------------------------------------------


class Node:
    """A store and the answers it gives; ``a`` has the options of datagrams."""

    def __init__(self, root: str, a: argparse.Namespace, send: Sender):
        self.spark, self.a, self.send = session(), a, send
        self.store = ChunkStore(self.spark, root if "://" in root else f"file://{os.path.abspath(root)}")
        self.seen = self.stored = 0
        self.waiting: list[tuple[bytearray, float]] = []
        self.known: set[tuple[str, int]] = set()  # every chunk that came, purged or not: none is forwarded twice

    def ids(self, cid: bytes) -> list[int]:
        """Ids of a content's chunks; recovery chunks are all 0."""
        own = F.when(F.col("name").startswith("recovery_"), 0).otherwise(F.col("chunk_id"))
        return [r["id"] for r in self.store.chunks(cid.hex()).select(own.alias("id")).distinct().orderBy("id").collect()]

    def _asked(self, cid: bytes, ids: list[int]) -> tuple[DataFrame, DataFrame]:
        rows = [("", i, n) for n, i in enumerate(ids)]
        return self.spark.createDataFrame(rows, "peer string, id long, seen int"), self.spark.createDataFrame([(i,) for i in self.ids(cid)], "id long")

    def on_inventory(self, peer: Address, cid: bytes, ids: list[int]) -> int:
        """Ask for what is missing, the first ids of the inventory first; how many are."""
        asked, local = self._asked(cid, ids)
        missing = [r["id"] for r in T.want(asked, local, B.MOST_IDS).orderBy("place").collect()]
        if missing:
            self.send(control(B.WANT, cid, missing), peer)
        return asked.join(local, "id", "left_anti").count()

    def on_want(self, peer: Address, cid: bytes, ids: list[int]) -> int:
        """Send the wanted chunks that are there, in the order of the request; how many went."""
        asked, local = self._asked(cid, ids)
        mine = self.store.chunks(cid.hex()).where(~F.col("name").startswith("recovery_")).select(F.col("chunk_id").alias("id"), "data")
        rows = T.serve(asked, local).join(mine, "id").select(F.lit(bytearray(cid)).alias("content_id"), F.col("id").alias("chunk_id"), "data", F.col("seen").alias("place"))
        n = 0
        for parts in datagrams(rows, self.a):
            for d in parts:
                self.send(d, peer)
            n += 1
        return n

    def announce(self, cid: bytes, peers: list[Address]) -> int:
        """Send the inventory to all peers; one without ids is not sent."""
        ids = self.ids(cid)
        if ids:
            d = control(B.INVENTORY, cid, ids)
            for p in peers:
                self.send(d, p)
        return len(peers) if ids else 0

    def take(self, arrived: list[tuple[bytes, Address]], now: float, max_age: float = 5.0) -> list[tuple[str, int]]:
        """Answer control datagrams and store the chunks that are complete; (content, id) of these.

        Fragments of other chunks wait until ``max_age`` seconds after the first of their chunk.
        """
        for data, peer in arrived:
            if data[:4] == B.CONTROL:
                df = self.spark.createDataFrame([(bytearray(data),)], "datagram binary")
                for r in T.parse_control(df).collect():
                    (self.on_inventory if r["kind"] == B.INVENTORY else self.on_want)(peer, bytes(r["content_id"]), r["ids"])
            else:
                self.seen += 1
                self.waiting.append((bytearray(data), now))
        if not self.waiting:
            return []
        k = keys(self.a)
        df = self.spark.createDataFrame(self.waiting, "datagram binary, recv double")
        parsed = T.parse(df, k["auth_key"], {k["key_id"]: k["seal_key"]} if k["seal_key"] else None)
        name = F.concat(F.when(F.substring("data", 1, 4) == B.lit_bytes(B.RECOVERY), "recovery_").otherwise("chunk_"), F.lpad(F.pmod("chunk_id", F.lit(B.RECOVERY_ID_BASE)).cast("string"), 4, "0"), F.lit(".bin"))
        whole = T.assemble(parsed).select(F.lower(F.hex("content_id")).alias("cid"), "chunk_id", name.alias("name"), "data", F.lit(0.0).alias("score"))
        done = [(r["cid"], r["chunk_id"]) for r in whole.select("cid", "chunk_id").orderBy("cid", "chunk_id").collect()]
        if done:
            self.store.put(whole)
            self.stored += len(done)
        ok = parsed.where("status = 'ok'")
        gone = set(done) | {(r["cid"], r["chunk_id"]) for r in ok.groupBy(F.lower(F.hex("content_id")).alias("cid"), "chunk_id").agg(F.min("recv").alias("first")).where(F.lit(now) - F.col("first") > max_age).collect()}
        rest = ok.select(F.lower(F.hex("content_id")).alias("cid"), "chunk_id", "datagram", "recv").collect()
        self.waiting = [(bytearray(r["datagram"]), r["recv"]) for r in rest if (r["cid"], r["chunk_id"]) not in gone]
        return done


    def pass_on(self, cid: str, chunk_id: int, peers: list[Address]) -> None:
        """Send a chunk of the store to all peers."""
        own = self.store.chunks(cid).where(F.col("chunk_id") == chunk_id)
        for parts in datagrams(own.select(F.unhex("cid").alias("content_id"), "chunk_id", "data", F.lit(0).alias("place")), self.a):
            for peer, d in itertools.product(peers, parts):
                self.send(d, peer)

    def radiate(self, now: float, peers: list[Address], rng: random.Random, bias: float = 0.0) -> tuple[str, int] | None:
        """Send one chunk of one content, contents drawn by how recent they are; what was sent."""
        weight = O.content_weight(F.lit(now) - F.col("last"), bias)
        content = T.last_seen(self.store.table()).orderBy(-F.log(1 - F.rand(rng.getrandbits(31))) / weight).select("cid").first()
        if content is None:
            return None
        chunk = self.store.chunks(content["cid"]).orderBy(F.rand(rng.getrandbits(31))).select("chunk_id").first()["chunk_id"]
        self.pass_on(content["cid"], chunk, peers)
        return content["cid"], chunk

    def turn(self, arrived: list[tuple[bytes, Address]], now: float, peers: list[Address], rng: random.Random, forward: float = 0.25, bias: float = 0.0, inventory: bool = True, ttl: float | None = None) -> None:
        """One round of gossip: take in, forward some of what is new, send one chunk of the store and the inventories, purge."""
        for key in self.take(arrived, now):
            if key not in self.known:
                self.known.add(key)
                if peers and rng.random() < forward:
                    self.pass_on(*key, peers)
        if peers:
            self.radiate(now, peers, rng, bias)
            if inventory:
                for r in self.store.contents().toLocalIterator():
                    self.announce(bytes.fromhex(r["cid"]), peers)
        if ttl:
            self.store.purge(ttl, now)


def receive(sock: socket.socket, seconds: float) -> list[tuple[bytes, Address]]:
    """What comes to a socket in some seconds."""
    out, end = [], time.time() + seconds
    while (left := end - time.time()) > 0:
        sock.settimeout(left)
        try:
            out.append(sock.recvfrom(65536))
        except TimeoutError:
            break
    return out


# --- commands -----------------------------------------------------------------------------------


def _assembled(a: argparse.Namespace) -> tuple[DataFrame, DataFrame]:
    rows = [(bytearray(d), float(i)) for i, d in enumerate(lines(a))]
    k = from_hex(a.enc_key) if a.enc_key else None
    parsed = T.parse(session().createDataFrame(rows, "datagram binary, recv double"), from_hex(a.auth_key) if a.auth_key else None, {a.enc_key_id: k} if k else None)
    return parsed, T.assemble(parsed)


def constants(a):
    print(json.dumps({"MAGIC": B.DATA.hex(), "CONTROL_MAGIC": B.CONTROL.hex(), "CTRL_TYPE_INV": B.INVENTORY, "CTRL_TYPE_WANT": B.WANT, "MAX_CTRL_CHUNKS": B.MOST_IDS}))


def norm_uri(a):
    print(a.uri.strip())


def id_bytes(a):
    emit(digest(a.uri, a.digest_size), a)


def id_hex(a):
    a.format = "hex"
    id_bytes(a)


def stream_id(a):
    emit(digest(f"{a.stream_id}::{a.frame_idx}", a.digest_size), a)


def iter_datagrams(a):
    if a.out and a.out_dir:
        raise SystemExit("give --out or --out-dir, not both")
    parts = one_chunk(a)
    if a.out_dir:
        os.makedirs(a.out_dir, exist_ok=True)
        for i, d in enumerate(parts):
            with open(f"{a.out_dir}/datagram_{i:04d}.bin", "wb") as f:
                f.write(d)
        return
    text = "".join(encoded(d, a.format) + "\n" for d in parts)
    if a.out:
        with open(a.out, "w") as f:
            f.write(text)
    else:
        print(text, end="")


def send_chunk(a):
    with udp(a.bind) as s:
        for d in one_chunk(a):
            s.sendto(d, address(a.addr))
    print(f"sent chunk {a.chunk_id} to {a.addr}")


def encode_inventory(a):
    emit(control(B.INVENTORY, content(a), a.chunk_ids), a)


def encode_want(a):
    emit(control(B.WANT, content(a), a.chunk_ids), a)


def parse_control(a):
    row = T.parse_control(session().createDataFrame([(bytearray(given(a)),)], "datagram binary")).first()
    if row is None:
        print("invalid control datagram", file=sys.stderr)
        return 1
    print(json.dumps({"ctrl_type": NAMES[row["kind"]], "content_id": bytes(row["content_id"]).hex(), "chunk_ids": row["ids"]}))


def assemble(a):
    """Chunks of a list of datagrams, by content and id; the lines come at once, so no partial gets old."""
    if a.out and a.out_dir:
        raise SystemExit("give --out or --out-dir, not both")
    n = 0
    for r in _assembled(a)[1].orderBy("content_id", "chunk_id").toLocalIterator():
        n += 1
        cid, data = bytes(r["content_id"]).hex(), bytes(r["data"])
        if a.out and n > 1:
            print("more than one chunk, give --out-dir", file=sys.stderr)
            return 1
        if a.out or a.out_dir:
            path = a.out or f"{a.out_dir}/{cid}/chunk_{r['chunk_id']:04d}.bin"
            os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
            with open(path, "wb") as f:
                f.write(data)
        print(path if a.out_dir else f"{cid} {r['chunk_id']} {len(data)}")
    if n == 0:
        print("no chunks completed", file=sys.stderr)
    return 0 if n or a.out or a.out_dir else 1


def assembler_expire(a):
    """Partials that a wait of --advance seconds leaves and drops; fragments of a complete chunk open none."""
    parsed, whole = _assembled(a)
    n = parsed.where("status = 'ok'").select("content_id", "chunk_id").distinct().join(whole, ["content_id", "chunk_id"], "left_anti").count()
    old = a.advance > a.max_partial_age
    print(json.dumps({"expired": n if old else 0, "partials": 0 if old else n}))


def mesh_broadcast(a):
    if not a.peer:
        raise SystemExit("give --peer")
    cid, peers = digest(a.uri, 16), [address(p) for p in a.peer]
    paths = by_gain(a.chunk_dir) if a.priority == "gain" else folder(a.chunk_dir, "chunk")
    numbered = [(name_id(p, "chunk"), p) for p in paths]
    if a.send_recovery:
        numbered += [(B.RECOVERY_ID_BASE + name_id(p, "recovery"), p) for p in folder(a.chunk_dir, "recovery")]
    rows = []
    for place, (i, p) in enumerate(numbered):
        with open(p, "rb") as f:
            rows.append((bytearray(cid), i, bytearray(f.read()), place))
    chunks = sent = 0
    with udp(a.bind) as s:
        send = sender(s)
        for parts in datagrams(session().createDataFrame(rows, CHUNKS), a):
            for _ in range(max(1, a.repeats)):
                for peer, d in itertools.product(peers, parts):
                    send(d, peer)
                    sent += 1
                chunks += 1
    print(f"sent chunks={chunks} datagrams={sent}")


def mesh_recv(a):
    with udp(a.bind) as s:
        join_groups(s, [address(m)[0] for m in a.mcast])
        node, end = Node(a.store_root, a, sender(s)), time.time() + a.duration
        while (left := end - time.time()) > 0:
            for cid, i in node.take(receive(s, min(0.5, left)), time.time()):
                print(f"stored chunk {i} for cid {cid}")
    print(f"datagrams_seen={node.seen} stored_chunks={node.stored}")


def mesh_node(a):
    """A node that gossips: every round takes in, forwards, sends a chunk and purges; inventories go once a period."""
    peers, rng = [address(p) for p in a.peer], random.Random(a.seed)
    with udp(a.bind) as s:
        join_groups(s, [address(m)[0] for m in a.mcast])
        node, end, due = Node(a.store_root, a, sender(s)), time.time() + a.duration, 0.0
        while (now := time.time()) < end:
            tell = a.inventory_period > 0 and now >= due
            due = now + a.inventory_period if tell else due
            node.turn(receive(s, min(1 / a.rate_hz, end - now)), time.time(), peers, rng, a.forward_prob, a.recency_bias, tell, a.frame_ttl)
    print(f"datagrams_seen={node.seen} stored_chunks={node.stored}")


def mesh_join_mcast(a):
    with udp() as s:
        n = join_groups(s, [address(m)[0] for m in a.mcast])
        time.sleep(a.duration)
    print(f"joined {n} multicast groups")


def mesh_inventory(a):
    if not a.peer:
        raise SystemExit("give --peer")
    cid = content(a)
    with udp(a.bind) as s:
        n = Node(a.store_root, a, sender(s)).announce(cid, [address(p) for p in a.peer])
    print(f"sent inventory for {cid.hex()} to {n} peers")


def mesh_chunk_id(a):
    print(name_id(a.path, "chunk"))


def mesh_recovery_id(a):
    print(name_id(a.path, "recovery"))


def mesh_order_by_gain(a):
    for path in by_gain(a.chunk_dir):
        print(path)


def mesh_local_chunk_ids(a):
    print(*Node(a.store_root, a, lambda d, to: None).ids(content(a)))


def mesh_handle_inventory(a):
    with udp() as s:
        n = Node(a.store_root, a, sender(s)).on_inventory(address(a.peer), content(a), a.chunk_ids)
    print(f"missing={n}")


def mesh_handle_want(a):
    with udp() as s:
        n = Node(a.store_root, a, sender(s)).on_want(address(a.peer), content(a), a.chunk_ids)
    print(f"sent {n} of {len(a.chunk_ids)} chunks")


def mesh_sendto(a):
    data = given(a)
    with udp() as s:
        sender(s)(data, address(a.peer))
    print(f"sent {len(data)} bytes to {a.peer}")


# Options by group: (flag, settings).
URI = [("--uri", {"required": True})]
SIZE = [("--digest-size", {"type": int, "default": 16})]
CONTENT = [("--uri", {}), ("--content-id", {}), *SIZE]
OUT = [("--format", {"choices": ["hex", "base64", "raw"], "default": "hex"}), ("--out", {})]
LINES = [("--format", {"choices": ["hex", "base64"], "default": "hex"})]
SECRETS = [("--auth-key", {}), ("--enc-key", {}), ("--enc-key-id", {"type": int, "default": 0})]
SENT = [("--max-payload", {"type": int, "default": 1200}), *SECRETS]
CHUNK = [*CONTENT, ("--chunk-id", {"type": int, "required": True}), ("--chunk-file", {"required": True}), *SENT]
IDS = [("--chunk-ids", {"type": int, "nargs": "+", "required": True})]
AGE = [("--input", {}), *LINES, *SECRETS, ("--max-partial-age", {"type": float, "default": 5.0})]
BIND = [("--bind", {})]
PEER, PEERS = [("--peer", {"required": True})], [("--peer", {"action": "append", "default": []})]
DATA = [("--data-hex", {}), ("--data-base64", {}), ("--input", {})]
GOSSIP = [
    ("--rate-hz", {"type": float, "default": 50.0}),
    ("--forward-prob", {"type": float, "default": 0.25}),
    ("--inventory-period", {"type": float, "default": 1.0}),
    ("--frame-ttl", {"type": float}),
    ("--recency-bias", {"type": float, "default": 0.0}),
    ("--seed", {"type": int}),
]
PATH, CHUNK_DIR = [("--path", {"required": True})], [("--chunk-dir", {"required": True})]


def _store(name: str) -> list:
    return [("--store-root", {"default": name}), *SENT]


def _seconds(default: float) -> list:
    return [("--duration", {"type": float, "default": default})]


COMMANDS = {
    constants: [],
    norm_uri: URI,
    id_bytes: URI + SIZE + OUT,
    id_hex: URI + SIZE + [("--out", {})],
    stream_id: [("--stream-id", {"required": True}), ("--frame-idx", {"type": int, "required": True})] + SIZE + OUT,
    iter_datagrams: CHUNK + LINES + [("--out", {}), ("--out-dir", {})],
    send_chunk: CHUNK + BIND + [("--addr", {"required": True})],
    encode_inventory: CONTENT + IDS + OUT,
    encode_want: CONTENT + IDS + OUT,
    parse_control: DATA,
    assemble: AGE + [("--out", {}), ("--out-dir", {})],
    assembler_expire: AGE + [("--advance", {"type": float, "default": 0.0})],
    mesh_broadcast: URI + CHUNK_DIR + PEERS + BIND + _store("cortex_tx") + [("--repeats", {"type": int, "default": 1}), ("--priority", {"choices": ["gain"]}), ("--send-recovery", {"action": "store_true"})],
    mesh_recv: [("--bind", {"required": True}), ("--mcast", {"action": "append", "default": []})] + _store("cortex_rx") + _seconds(5.0),
    mesh_node: [("--bind", {"required": True}), ("--mcast", {"action": "append", "default": []})] + PEERS + _store("cortex_node") + _seconds(float("inf")) + GOSSIP,
    mesh_join_mcast: [("--mcast", {"action": "append", "required": True})] + _seconds(1.0),
    mesh_inventory: CONTENT + PEERS + BIND + _store("cortex_node"),
    mesh_chunk_id: PATH,
    mesh_recovery_id: PATH,
    mesh_order_by_gain: CHUNK_DIR + _store("cortex_node"),
    mesh_local_chunk_ids: CONTENT + _store("cortex_node"),
    mesh_handle_inventory: PEER + CONTENT + IDS + _store("cortex_node"),
    mesh_handle_want: PEER + CONTENT + IDS + _store("cortex_node"),
    mesh_sendto: PEER + DATA,
}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lacuna net")
    sub = p.add_subparsers(dest="command", required=True)
    for run, options in COMMANDS.items():
        c = sub.add_parser(run.__name__.replace("_", "-"), help=run.__doc__)
        c.set_defaults(run=run)
        one = c.add_mutually_exclusive_group(required=True) if DATA[0] in options else c
        for flag, settings in options:
            (one if (flag, settings) in DATA else c).add_argument(flag, **settings)
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    return a.run(a) or 0
