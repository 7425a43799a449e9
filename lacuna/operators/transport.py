"""Datagrams, assembly, inventories and stores as relational operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacuna.functions import bytes as B


def overhead(auth: bool = False, seal: bool = False) -> int:
    return B.DATA_HEADER.size + B.MAC_BYTES * auth + B.SEAL_BYTES * seal


def fragments(chunks: DataFrame, most: int = 1200, auth_key: bytes | None = None, seal_key: bytes | None = None, key_id: int = 0, keep: tuple[str, ...] = ()) -> DataFrame:
    """(content_id, chunk_id, frag_idx, frag_total, datagram) of chunks(content_id, chunk_id, data), and the columns to ``keep``."""
    room = most - overhead(bool(auth_key), bool(seal_key))
    if room <= 0:
        raise ValueError("datagrams are too small for their header")
    total = F.greatest(F.lit(1), F.ceil(F.length("data") / room)).cast("int")
    x = chunks.select("content_id", "chunk_id", "data", *keep, total.alias("frag_total"))
    x = x.withColumn("frag_idx", F.explode(F.sequence(F.lit(0), F.col("frag_total") - 1)))
    head = F.concat(B.lit_bytes(B.DATA), "content_id", B.be(F.col("chunk_id"), 4), B.be(F.col("frag_idx"), 2), B.be(F.col("frag_total"), 2), B.be(F.length("data"), 4))
    x = x.withColumn("head", head).withColumn("part", F.substring(F.col("data"), F.col("frag_idx") * room + 1, F.lit(room)))
    if seal_key:
        key = B.lit_bytes(bytes([key_id & 0xFF]))
        sealed = F.aes_encrypt(F.col("part"), B.lit_bytes(seal_key), F.lit("GCM"), F.lit("DEFAULT"), B.nonce(F.col("head"), F.col("frag_idx")), F.concat("head", key))
        x = x.withColumn("datagram", F.concat("head", key, sealed))
    else:
        x = x.withColumn("datagram", F.concat("head", "part"))
    if auth_key:
        x = x.withColumn("datagram", F.concat("datagram", B.hmac_sha256(auth_key, F.col("datagram"))))
    return x.select("content_id", "chunk_id", "frag_idx", "frag_total", "datagram", *keep)


def parse(datagrams: DataFrame, auth_key: bytes | None = None, seal_keys: dict[int, bytes] | None = None) -> DataFrame:
    """``datagrams(datagram, ...)`` with header fields, payload and status: ok, mac_fail or invalid (in this order of checks)."""
    d = F.col("datagram")
    body = F.substring(d, F.lit(1), F.length(d) - B.MAC_BYTES) if auth_key else d
    mac_ok = (F.length(d) > B.MAC_BYTES) & (F.substring(d, F.length(d) - B.MAC_BYTES + 1, F.lit(B.MAC_BYTES)) == B.hmac_sha256(auth_key, body)) if auth_key else F.lit(True)
    x = datagrams.withColumn("__b", body)
    b = F.col("__b")
    x = x.withColumns({"content_id": F.substring(b, 5, 16), "chunk_id": B.from_be(b, 20, 4), "frag_idx": B.from_be(b, 24, 2).cast("int"), "frag_total": B.from_be(b, 26, 2).cast("int"), "chunk_len": B.from_be(b, 28, 4)})
    fits = (F.length(b) >= B.DATA_HEADER.size) & (F.substring(b, 1, 4) == B.lit_bytes(B.DATA)) & (F.col("frag_total") > 0) & (F.col("frag_idx") < F.col("frag_total"))
    rest = F.substring(b, B.DATA_HEADER.size + 1, 1 << 30)
    if seal_keys:
        head, key = F.substring(b, 1, B.DATA_HEADER.size), F.substring(rest, 1, 1)
        plain = F.lit(None).cast("binary")
        for k, secret in seal_keys.items():
            opened = F.try_aes_decrypt(F.substring(rest, 2, 1 << 30), B.lit_bytes(secret), F.lit("GCM"), F.lit("DEFAULT"), F.concat(head, key))
            plain = F.when(key == B.lit_bytes(bytes([k])), opened).otherwise(plain)
        rest = plain
        fits = fits & rest.isNotNull()
    status = F.when(~mac_ok, "mac_fail").when(~F.coalesce(fits, F.lit(False)), "invalid").otherwise("ok")
    return x.withColumn("status", status).withColumn("payload", rest).drop("__b")


def assemble(parsed: DataFrame) -> DataFrame:
    """(content_id, chunk_id, data) of the chunks whose fragments are all there; duplicates of a fragment do no harm.

    Fragments that disagree with the chunk's first arrival (``recv``) in count or length are left out.
    """
    keys = ["content_id", "chunk_id"]
    ok = parsed.where("status = 'ok'")
    first = F.min(F.struct("recv", "frag_idx", "frag_total", "chunk_len")).over(Window.partitionBy(*keys))
    ok = ok.withColumn("__f", first).where("frag_total = __f.frag_total and chunk_len = __f.chunk_len")
    one = ok.groupBy(*keys, "frag_idx").agg(F.max_by("payload", "recv").alias("payload"), F.first("frag_total").alias("frag_total"), F.first("chunk_len").alias("chunk_len"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("frag_idx", "payload"))), lambda s: s["payload"])
    all_ = one.groupBy(*keys).agg(F.count("*").alias("n"), F.first("frag_total").alias("total"), F.first("chunk_len").alias("len"), parts.alias("parts")).where("n = total")
    data = F.aggregate("parts", B.lit_bytes(b""), lambda a, p: F.concat(a, p))
    return all_.select(*keys, F.substring(data, F.lit(1), F.col("len").cast("int")).alias("data"))


def counters(parsed: DataFrame, completed: DataFrame) -> DataFrame:
    c = parsed.agg(F.count("*").alias("datagrams"), F.count_if(F.col("status") == "invalid").alias("invalid"), F.count_if(F.col("status") == "mac_fail").alias("mac_fail"))
    return c.crossJoin(completed.agg(F.count("*").alias("chunks_completed")))


def control(inventories: DataFrame, kind: int) -> DataFrame:
    """(content_id, datagram) from (content_id, ids array)."""
    ids = F.unhex(F.array_join(F.transform("ids", lambda i: F.lpad(F.hex(i.cast("long")), 4, "0")), ""))
    head = F.concat(B.lit_bytes(B.CONTROL + bytes([kind])), "content_id", B.be(F.size("ids"), 2))
    return inventories.select("content_id", F.concat(head, ids).alias("datagram"))


def parse_control(df: DataFrame) -> DataFrame:
    """(kind, content_id, ids) of control datagrams; those that do not fit or are of another kind go."""
    d = F.col("datagram")
    n = B.from_be(d, 21, 2).cast("int")
    ids = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.conv(F.hex(F.substring(d, B.CONTROL_HEADER.size + 1 + 2 * i, F.lit(2))), 16, 10).cast("int"))).otherwise(F.array().cast("array<int>"))
    ok = (F.length(d) >= B.CONTROL_HEADER.size) & (F.substring(d, 1, 4) == B.lit_bytes(B.CONTROL)) & (F.length(d) >= B.CONTROL_HEADER.size + 2 * n)
    ok = ok & B.from_be(d, 4, 1).isin(B.INVENTORY, B.WANT)
    return df.where(ok).select(B.from_be(d, 4, 1).cast("int").alias("kind"), F.substring(d, 6, 16).alias("content_id"), ids.alias("ids"))


def want(received: DataFrame, local: DataFrame, most: int = 64) -> DataFrame:
    """(peer, id, place): the first ids of each peer's inventory, in received order, that are not local."""
    missing = received.join(local, "id", "left_anti")
    return missing.withColumn("place", F.row_number().over(Window.partitionBy("peer").orderBy("seen"))).where(F.col("place") <= most).select("peer", "id", "place")


def serve(wanted: DataFrame, local: DataFrame) -> DataFrame:
    """Wanted ids that are there, in the order of the request."""
    return wanted.join(local, "id", "left_semi")


def broadcast_plan(chunks: DataFrame, peers: DataFrame, repeats: int) -> DataFrame:
    """Every chunk to every peer, ``repeats`` times: as many rows as there are datagrams to send."""
    r = chunks.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(max(1, repeats) - 1))))
    return r.join(peers)


def upsert(stored: DataFrame, arriving: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """Last write wins per key."""
    rows = stored.unionByName(arriving)
    rest = [c for c in rows.columns if c not in keys]
    latest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("__r"))
    return latest.select(*keys, "__r.*")


def last_seen(store: DataFrame) -> DataFrame:
    return store.groupBy("cid").agg(F.max("seen").alias("last"))


def purge(store: DataFrame, now: Column, ttl: float) -> DataFrame:
    """What stays when contents whose latest chunk is older than ttl (strictly) go."""
    old = last_seen(store).where(now - F.col("last") > ttl).select("cid")
    return store.join(old, "cid", "left_anti")


def drop(store: DataFrame, cids: DataFrame) -> DataFrame:
    return store.join(cids, "cid", "left_anti")
