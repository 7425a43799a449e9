"""Queries of framing, assembly, reconciliation, stores, recovery and packed objects, with their SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from lacuna.functions import bytes as B
from lacuna.functions import gf256
from lacuna.functions.golden import golden_step, inverse, step_sql
from lacuna.operators import headers as H
from lacuna.operators import recovery as R
from lacuna.operators import slicing as S
from lacuna.operators import transport as T
from lacuna.plans.slicing import LOSSY, SLOTS, _chunks, _slots
from lacuna.sources.tables import USER_SIGNAL, load, seconds, user_signal

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


KEY = bytes(range(32))
PAGES = "pg AS (SELECT page_id, md5(url) AS cid, hex(encode(url)) AS hx FROM pages)"


def _pages(spark, d):
    p = load(spark, d, "pages")
    return p.select(F.unhex(F.md5("url")).alias("content_id"), F.col("page_id").alias("chunk_id"), F.encode("url", "UTF-8").alias("data"))


def _frag_sql(room: int) -> str:
    return f"""{PAGES}, fg AS (SELECT *, CAST(greatest(1, ceil(length(hx) / 2 / {room}.0)) AS INTEGER) AS total FROM pg), ix AS (SELECT *, CAST(unnest(range(0, total)) AS INTEGER) AS idx FROM fg),
dg AS (SELECT upper(cid) AS content_id, page_id AS chunk_id, idx AS frag_idx, total AS frag_total, concat('484F4454', upper(cid), printf('%08X', page_id), printf('%04X', idx), printf('%04X', total), printf('%08X', length(hx) // 2), substr(hx, idx * {2 * room} + 1, {2 * room})) AS datagram FROM ix)"""


@query(f"WITH {_frag_sql(32)} SELECT * FROM dg")
def fragment_datagrams(spark, d):
    f = T.fragments(_pages(spark, d), most=64)
    return f.select(F.hex("content_id").alias("content_id"), "chunk_id", "frag_idx", "frag_total", F.hex("datagram").alias("datagram"))


def _hmac_sql(hexed: str) -> str:
    pad = lambda x: bytes(b ^ x for b in KEY.ljust(64, b"\0")).hex()
    return f"upper(sha256(unhex(concat('{pad(0x5C)}', sha256(unhex(concat('{pad(0x36)}', {hexed})))))))"


@query(f"WITH {_frag_sql(64)} SELECT content_id, chunk_id, frag_idx, concat(datagram, {_hmac_sql('datagram')}) AS datagram FROM dg")
def hmac_datagrams(spark, d):
    f = T.fragments(_pages(spark, d), most=128, auth_key=KEY)
    return f.select(F.hex("content_id").alias("content_id"), "chunk_id", "frag_idx", F.hex("datagram").alias("datagram"))


@query("SELECT page_id AS chunk_id, hex(encode(url)) AS data FROM pages")
def sealed_roundtrip(spark, d):
    """Encrypted and authenticated fragments opened and assembled: the bytes must return."""
    f = T.fragments(_pages(spark, d), most=128, auth_key=KEY, seal_key=KEY[:16], key_id=3)
    parsed = T.parse(f.select("datagram", F.col("frag_idx").alias("recv")), KEY, {3: KEY[:16]})
    return T.assemble(parsed).select("chunk_id", F.hex("data").alias("data"))


INV = "iv AS (SELECT l_suppkey AS peer, list_sort(list_distinct(list(l_partkey) FILTER (l_partkey <= 65535)))[1:64] AS ids FROM lineitem GROUP BY l_suppkey)"
CONTROL_HEX = "concat('484F4354', printf('%02X', {kind}), upper(md5(CAST(peer AS VARCHAR))), printf('%04X', len(ids)), array_to_string(list_transform(ids, lambda i: printf('%04X', i)), ''))"


def _inventories(spark, d):
    from lacuna.operators.ordering import inventory

    i = load(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("peer")).agg(inventory(F.col("l_partkey")).alias("ids"))
    return i.withColumn("content_id", F.unhex(F.md5(F.col("peer").cast("string"))))


@query(f"WITH {INV} SELECT upper(md5(CAST(peer AS VARCHAR))) AS content_id, {CONTROL_HEX.format(kind=1)} AS inventory, {CONTROL_HEX.format(kind=2)} AS want FROM iv")
def control_datagrams(spark, d):
    i = _inventories(spark, d)
    a, b = T.control(i, B.INVENTORY), T.control(i, B.WANT)
    both = a.withColumnRenamed("datagram", "a").join(b.withColumnRenamed("datagram", "b"), "content_id")
    return both.select(F.hex("content_id").alias("content_id"), F.hex("a").alias("inventory"), F.hex("b").alias("want"))


@query(f"WITH {INV} SELECT 1 AS kind, upper(md5(CAST(peer AS VARCHAR))) AS content_id, ids FROM iv")
def parse_control(spark, d):
    p = T.parse_control(T.control(_inventories(spark, d), B.INVENTORY))
    return p.select("kind", F.hex("content_id").alias("content_id"), F.transform("ids", lambda x: x.cast("long")).alias("ids"))


@query()
def content_ids(spark, d):
    p = load(spark, d, "conversations")
    return p.select("conv_id", "turn", F.hex(B.content_id(F.concat(F.lit("  "), "role", F.lit(" ")))).alias("role_id"), F.hex(B.frame_content_id(F.col("conv_id"), F.col("turn"))).alias("frame_id"))


@query()
def crc_frames(spark, d):
    p = load(spark, d, "pages").select("page_id", F.encode("url", "UTF-8").alias("u"))
    return p.select("page_id", B.crc16(F.col("u")).alias("crc"), F.hex(B.frame(F.col("u"), preamble=4)).alias("frame"))


@query("SELECT item_id, flatten(list_transform(range(0, length(b)), lambda i: list_transform([128, 64, 32, 16, 8, 4, 2, 1], lambda m: CASE WHEN (ord(substr(b, i + 1, 1)) & m) <> 0 THEN 1 ELSE 0 END))) AS bits FROM (SELECT item_id, regexp_replace(text, '[^ -~]', '?', 'g') AS b FROM benchmark)")
def bits_of_bytes(spark, d):
    t = F.regexp_replace("text", "[^ -~]", "?")
    return load(spark, d, "benchmark").select("item_id", B.bits(F.encode(t, "UTF-8")).alias("bits"))


@query("SELECT page_id, CASE WHEN t = '' THEN 'default' ELSE regexp_replace(t, '[^\\p{L}\\p{N}\\-._]', '_', 'g') END AS slug FROM (SELECT page_id, CASE WHEN page_id % 7 = 0 THEN '' ELSE url END AS t FROM pages)")
def uri_slug(spark, d):
    return load(spark, d, "pages").select("page_id", B.slug(F.when(F.col("page_id") % 7 == 0, "").otherwise(F.col("url"))).alias("slug"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_partkey WHEN 1 THEN 1000000 + p_partkey ELSE 0 END AS chunk_id FROM part")
def chunk_id_from_name(spark, d):
    k = F.col("p_partkey")
    name = F.when(k % 3 == 0, F.format_string("chunk_%04d.bin", k)).when(k % 3 == 1, F.format_string("recovery_%04d.bin", k)).otherwise(F.concat(F.lit("chunk_x"), k))
    return load(spark, d, "part").select("p_partkey", B.chunk_id_of(name).alias("chunk_id"))


@query("SELECT page_id, hex(encode(url)) AS from_hex, hex(encode(url)) AS from_base64 FROM pages WHERE page_id % 5 <> 0")
def datagram_lines(spark, d):
    """One datagram a line in hex (with and without 0x) and base64; blank lines are skipped."""
    p = load(spark, d, "pages").select("page_id", F.encode("url", "UTF-8").alias("u"))
    h = F.when(F.col("page_id") % 5 == 0, "").when(F.col("page_id") % 2 == 0, F.concat(F.lit("0x"), F.hex("u"))).otherwise(F.concat(F.lit(" "), F.hex("u")))
    b = F.when(F.col("page_id") % 5 == 0, "").otherwise(F.base64("u"))
    lines = p.select("page_id", h.alias("h"), F.translate(b, "\r\n", "").alias("b")).where("trim(h) != ''")
    return lines.select("page_id", F.hex(B.parse_hex(F.col("h"))).alias("from_hex"), F.hex(F.unbase64("b")).alias("from_base64"))


# --- assembly ---------------------------------------------------------------------------------

ARRIVE = f"{_frag_sql(32)}, ar AS (SELECT *, 1 + (chunk_id + frag_idx) % 3 % 2 AS times FROM dg WHERE (chunk_id * 31 + frag_idx * 17) % 10 >= 1)"


def _arrivals(spark, d):
    """Fragments with one in ten lost and some twice."""
    f = T.fragments(_pages(spark, d), most=64).where((F.col("chunk_id") * 31 + F.col("frag_idx") * 17) % 10 >= 1)
    f = f.withColumn("recv", F.explode(F.sequence(F.lit(1), (1 + (F.col("chunk_id") + F.col("frag_idx")) % 3 % 2).cast("int"))))
    return f.select("datagram", "recv")


@query(f"WITH {ARRIVE}, ok AS (SELECT chunk_id FROM ar GROUP BY chunk_id HAVING count(*) = any_value(frag_total)) SELECT page_id AS chunk_id, hex(encode(url)) AS data FROM pages WHERE page_id IN (SELECT chunk_id FROM ok)")
def assemble_complete(spark, d):
    return T.assemble(T.parse(_arrivals(spark, d))).select("chunk_id", F.hex("data").alias("data"))


@query(f"WITH {ARRIVE}, ok AS (SELECT chunk_id FROM ar GROUP BY chunk_id HAVING count(*) = any_value(frag_total)), n AS (SELECT CAST(sum(times) AS BIGINT) AS d FROM ar), b AS (SELECT count(*) AS x FROM pages) SELECT d + 2 * x AS datagrams, 2 * x AS invalid, CAST(0 AS BIGINT) AS mac_fail, (SELECT count(*) FROM ok) AS chunks_completed FROM n, b")
def assembler_counters(spark, d):
    junk = load(spark, d, "pages").select(F.explode(F.array(F.encode("url", "UTF-8"), B.lit_bytes(B.DATA + bytes(28)))).alias("datagram"), F.lit(1).alias("recv"))
    parsed = T.parse(_arrivals(spark, d).union(junk))
    return T.counters(parsed, T.assemble(parsed))


@query(f"WITH {_frag_sql(64)} SELECT count(*) AS n, count(*) FILTER (chunk_id % 4 = 0) AS mac_fail FROM dg")
def authenticated_parse(spark, d):
    """Every fourth chunk's datagrams are tampered with and must fail."""
    f = T.fragments(_pages(spark, d), most=128, auth_key=KEY)
    f = f.withColumn("datagram", F.when(F.col("chunk_id") % 4 == 0, F.concat(F.substring("datagram", 1, 32), F.lit("?").cast("binary"), F.substring(F.col("datagram"), F.lit(34), F.length("datagram")))).otherwise(F.col("datagram")))
    return T.parse(f.select("datagram"), KEY).agg(F.count("*").alias("n"), F.count_if(F.col("status") == "mac_fail").alias("mac_fail"))


@query(f"WITH {ARRIVE} SELECT content_id, CAST(sum(times) - count(*) AS BIGINT) AS duplicates FROM ar GROUP BY content_id")
def duplicate_stats(spark, d):
    p = T.parse(_arrivals(spark, d)).where("status = 'ok'")
    return p.groupBy("content_id").agg((F.count("*") - F.count_distinct("chunk_id", "frag_idx")).alias("duplicates")).select(F.hex("content_id").alias("content_id"), "duplicates")


PART = "pt AS (SELECT user_id AS cid, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // 4 AS chunk_id, ts, event_id FROM events), ag AS (SELECT cid, chunk_id, count(*) AS n, epoch(max(ts)) - epoch(min(ts)) AS span FROM pt GROUP BY cid, chunk_id)"


@query(f"WITH {PART} SELECT cid, chunk_id, n = 4 AND span <= 129600 AS complete, n > 1 AND span > 129600 AS expired FROM ag")
def expired_partials(spark, d):
    """Chunks of four fragments that must all come within 36 hours of the first."""
    e = load(spark, d, "events")
    i = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    p = e.select(F.col("user_id").alias("cid"), F.floor(i / 4).alias("chunk_id"), seconds(F.col("ts")).alias("seen"))
    g = p.groupBy("cid", "chunk_id").agg(F.count("*").alias("n"), (F.max("seen") - F.min("seen")).alias("span"))
    return g.select("cid", "chunk_id", ((F.col("n") == 4) & (F.col("span") <= 129600)).alias("complete"), ((F.col("n") > 1) & (F.col("span") > 129600)).alias("expired"))


# --- reconciliation ---------------------------------------------------------------------------

OFFER = "rc AS (SELECT l_suppkey AS peer, l_partkey AS id, min(l_orderkey * 8 + l_linenumber) AS seen FROM lineitem WHERE l_partkey <= 65535 GROUP BY l_suppkey, l_partkey), lo AS (SELECT DISTINCT l_partkey AS id FROM lineitem WHERE l_suppkey % 5 = 0)"


def _offers(spark, d):
    li = load(spark, d, "lineitem").where("l_partkey <= 65535")
    rc = li.groupBy(F.col("l_suppkey").alias("peer"), F.col("l_partkey").alias("id")).agg(F.min(F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seen"))
    return rc, load(spark, d, "lineitem").where("l_suppkey % 5 = 0").select(F.col("l_partkey").alias("id")).distinct()


@query(f"WITH {OFFER}, m AS (SELECT peer, id, row_number() OVER (PARTITION BY peer ORDER BY seen) AS place FROM rc WHERE id NOT IN (SELECT id FROM lo)) SELECT peer, id, CAST(place AS INTEGER) AS place FROM m WHERE place <= 64")
def want_missing_antijoin(spark, d):
    return T.want(*_offers(spark, d))


@query(f"WITH {OFFER} SELECT peer, id, seen FROM rc WHERE id IN (SELECT id FROM lo)")
def want_serve_semijoin(spark, d):
    return T.serve(*_offers(spark, d)).select("peer", "id", "seen")


@query(f"WITH {SLOTS} SELECT cid, block_id, CAST(rep AS INTEGER) AS repeat, r_regionkey AS peer FROM chunk, (SELECT unnest(range(0, 2)) AS rep), region")
def broadcast_plan(spark, d):
    """Every chunk twice to every region's relay."""
    peers = load(spark, d, "region").select(F.col("r_regionkey").alias("peer"))
    return T.broadcast_plan(_chunks(spark, d).select("cid", "block_id"), peers, 2).select("cid", "block_id", "repeat", "peer")


@query("SELECT s_suppkey AS peer, count(DISTINCT l_partkey) AS n FROM supplier JOIN lineitem ON l_suppkey = s_suppkey AND l_partkey <= 65535 GROUP BY s_suppkey")
def local_chunk_ids(spark, d):
    li = load(spark, d, "lineitem").where("l_partkey <= 65535").select(F.col("l_suppkey").alias("peer"), "l_partkey").distinct()
    return load(spark, d, "supplier").select(F.col("s_suppkey").alias("peer")).join(li, "peer").groupBy("peer").agg(F.count("*").alias("n"))


@query(f"WITH {INV} SELECT CAST(count(*) * 3 AS BIGINT) AS sent, CAST(sum(len(ids)) * 3 AS BIGINT) AS ids FROM iv WHERE len(ids) > 0")
def inventories_sent(spark, d):
    """Inventories go to each of three peers; empty ones are not sent."""
    i = _inventories(spark, d).where(F.size("ids") > 0).crossJoin(spark.range(3).toDF("to"))
    return i.agg(F.count("*").alias("sent"), F.sum(F.size("ids")).alias("ids"))


@query("SELECT DISTINCT c_mktsegment AS host, c_nationkey AS port FROM customer WHERE c_nationkey % 4 <> 0")
def peer_list(spark, d):
    """Peers added (twice is once) and removed."""
    c = load(spark, d, "customer").select(F.col("c_mktsegment").alias("host"), F.col("c_nationkey").alias("port"))
    return c.distinct().join(c.where("port % 4 = 0").distinct(), ["host", "port"], "left_anti")


@query()
def gossip_rounds(spark, d):
    """Chunks known to each peer over rounds of taking up to 64 missing ones from the next peer."""
    from lacuna.streaming.gossip import ring, simulate

    places, n = ring(load(spark, d, "supplier"), "s_suppkey")
    li = load(spark, d, "lineitem").where("l_partkey <= 65535").join(places, F.col("l_suppkey") == F.col("s_suppkey"))
    return simulate(li.select("peer", F.col("l_partkey").alias("id")).distinct(), peers=n, rounds=3)


@query()
def gossip_spread(spark, d):
    """Ids that each peer holds and has received after rounds of the node protocol; peers are linked with the next and the seventh."""
    from lacuna.streaming.gossip import ring, spread

    places, n = ring(load(spark, d, "supplier"), "s_suppkey")
    li = load(spark, d, "lineitem").where("l_partkey <= 65535").join(places, F.col("l_suppkey") == F.col("s_suppkey"))
    steps = places.select("peer", F.explode(F.array(F.lit(1), F.lit(7))).alias("step"))
    links = steps.select("peer", F.pmod(F.col("peer") + F.col("step"), F.lit(max(n, 1))).alias("to")).where("peer != to")
    x = spread(li.select("peer", F.col("l_partkey").alias("id")), links, rounds=3, seed=11, ttl=2)
    return x.groupBy("peer").agg(F.count_if("held").alias("held"), F.count("since").alias("received"))


@query("WITH f AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS frame FROM conversations), r AS (SELECT conv_id, turn FROM f WHERE frame % 3 <> 2) SELECT f.conv_id, f.turn, CASE WHEN r.turn IS NOT NULL THEN CAST(frame AS INTEGER) END AS frame FROM f LEFT JOIN r ON r.conv_id = f.conv_id AND r.turn = f.turn")
def frame_lookup(spark, d):
    """Receipts joined with the dictionary of registered frames; others are kept without a frame."""
    c = load(spark, d, "conversations").select("conv_id", "turn")
    f = c.withColumn("frame", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1)
    known = f.where("frame % 3 != 2")
    return c.join(known, ["conv_id", "turn"], "left").select("conv_id", "turn", "frame")


# --- store ------------------------------------------------------------------------------------

STORE = "st AS (SELECT user_id AS cid, event_type AS chunk, epoch(ts) AS seen, event_id, value FROM events), nw AS (SELECT max(epoch(ts)) AS now FROM events)"


def _store(spark, d):
    return load(spark, d, "events").select(F.col("user_id").alias("cid"), F.col("event_type").alias("chunk"), seconds(F.col("ts")).alias("seen"), "event_id", "value")


@query(f"WITH {STORE} SELECT cid, chunk, arg_max(event_id, (seen, event_id)) AS event_id, arg_max(value, (seen, event_id)) AS value FROM st GROUP BY cid, chunk")
def latest_upsert(spark, d):
    s = _store(spark, d)
    half = F.col("event_id") % 2 == 0
    return T.upsert(s.where(half), s.where(~half), ["cid", "chunk"], F.struct("seen", "event_id")).select("cid", "chunk", "event_id", "value")


@query(f"WITH {STORE} SELECT cid, count(DISTINCT chunk) AS chunks, max(seen) AS last FROM st GROUP BY cid")
def store_contents(spark, d):
    return _store(spark, d).groupBy("cid").agg(F.count_distinct("chunk").alias("chunks"), F.max("seen").alias("last"))


@query(f"WITH {STORE} SELECT st.* FROM st WHERE cid IN (SELECT cid FROM st, nw GROUP BY cid HAVING NOT any_value(now) - max(seen) > 36000)")
def ttl_purge(spark, d):
    s = _store(spark, d)
    now = s.agg(F.max("seen").alias("now"))
    return T.purge(s, F.lit(now.first()[0]), 36000.0)


@query(f"WITH {STORE} SELECT * FROM st WHERE cid % 10 <> 3")
def drop_content(spark, d):
    s = _store(spark, d)
    return T.drop(s, s.where("cid % 10 = 3").select("cid").distinct())


@query("SELECT conv_id, string_agg(CASE WHEN turn % 3 = 1 THEN '' ELSE text END, '' ORDER BY turn) AS body, any_value(n) AS total FROM (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations) GROUP BY conv_id")
def baseline_concat(spark, d):
    """The comparison path without resilience: parts in order, gaps as empty."""
    c = load(spark, d, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 3 == 1, "").otherwise(F.col("text")).alias("t"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("turn", "t"))), lambda s: s["t"])
    return c.groupBy("conv_id").agg(F.array_join(parts, "").alias("body"), F.count("*").alias("total"))


# --- headers ----------------------------------------------------------------------------------


@query("SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'invalid' WHEN doc_id % 8 >= 8 THEN 'invalid' ELSE 'ok' END AS status, CASE WHEN doc_id % 11 <> 0 THEN n_chars END AS h, CASE WHEN doc_id % 11 <> 0 THEN n_chars + 1 END AS w, CASE WHEN doc_id % 11 <> 0 THEN doc_id % 8 END AS block_id, CASE WHEN doc_id % 11 <> 0 THEN CASE WHEN doc_id % 3 = 0 THEN 3 ELSE 2 END END AS version FROM documents")
def image_headers(spark, d):
    """Fixed binary headers written and parsed back; damaged ones are marked, not fatal."""
    x = load(spark, d, "documents").select("doc_id", "n_chars")
    raw = H.write_image(version=F.when(F.col("doc_id") % 3 == 0, 3).otherwise(2), h=F.col("n_chars"), w=F.col("n_chars") + 1, blocks=F.lit(8), block=F.col("doc_id") % 8)
    p = H.parse_image(x.withColumn("raw", F.when(F.col("doc_id") % 11 == 0, F.substring(raw, 1, 20)).otherwise(raw)))
    return p.select("doc_id", "status", "h", "w", "block_id", F.col("version").alias("version"))


@query("SELECT doc_id, 8000 + doc_id AS sr, n_chars AS n_frames, 1 + doc_id % 2 AS ch, doc_id % 16 AS block_id, CAST(doc_id % 2 AS INTEGER) AS clipped FROM documents WHERE doc_id % 13 <> 0")
def audio_headers(spark, d):
    x = load(spark, d, "documents").select("doc_id", "n_chars")
    raw = H.write_audio(ch=1 + F.col("doc_id") % 2, flags=F.col("doc_id") % 2, sr=8000 + F.col("doc_id"), n=F.col("n_chars"), blocks=F.lit(16), block=F.col("doc_id") % 16)
    bad = F.concat(F.lit("XXXX").cast("binary"), F.substring(raw, 5, 100))
    p = H.parse_audio(x.withColumn("raw", F.when(F.col("doc_id") % 13 == 0, bad).otherwise(raw))).where("status = 'ok'")
    return p.select("doc_id", "sr", "n_frames", "ch", "block_id", F.col("flags").bitwiseAND(1).cast("int").alias("clipped"))


@query("WITH g AS (SELECT source, doc_id, lang, first_value(lang) OVER (PARTITION BY source ORDER BY doc_id) AS f FROM documents) SELECT source, doc_id FROM g WHERE lang = f")
def geometry_filter(spark, d):
    """Chunks whose geometry is that of the first valid chunk of their field."""
    return H.same_geometry(load(spark, d, "documents").select("source", "doc_id", "lang"), "source", "doc_id", ["lang"]).select("source", "doc_id")


@query("SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'audio' ELSE 'image' END AS by_name, CASE page_id % 4 WHEN 0 THEN 'image' WHEN 1 THEN 'audio' WHEN 2 THEN 'container' ELSE 'unknown' END AS by_magic, CASE WHEN page_id % 3 = 0 THEN 'v3' ELSE 'v1_v2' END AS decoder, CASE page_id % 4 WHEN 2 THEN concat('recovery_', page_id) ELSE concat('chunk_', page_id) END AS path FROM pages")
def detect_modes(spark, d):
    x = load(spark, d, "pages").select("page_id")
    k = F.col("page_id") % 4
    name = F.concat(F.lit("a"), F.when(k == 0, ".WAV").otherwise(".png"))
    magic = F.when(k == 0, B.lit_bytes(B.IMAGE)).when(k == 1, B.lit_bytes(B.AUDIO)).when(k == 2, B.lit_bytes(B.PACKED)).otherwise(F.lit("none").cast("binary"))
    coded = F.when(k == 2, B.lit_bytes(B.RECOVERY)).otherwise(B.lit_bytes(B.IMAGE))
    return x.select("page_id", H.mode_of_name(name).alias("by_name"), H.layout_of(magic).alias("by_magic"), H.decoder_of(F.when(F.col("page_id") % 3 == 0, 3).otherwise(1)).alias("decoder"), H.path_of(coded, F.col("page_id")).alias("path"))


@query("SELECT page_id, concat('f', page_id, '_decoded', CASE WHEN page_id % 4 = 0 THEN '.wav' ELSE '.png' END) AS decoded, concat('f', page_id, '_conf', CASE WHEN page_id % 4 = 0 THEN '.npy' ELSE '.png' END) AS confidence FROM pages")
def output_names(spark, d):
    x = load(spark, d, "pages").select("page_id")
    mode = F.when(F.col("page_id") % 4 == 0, "audio").otherwise("image")
    stem = F.concat(F.lit("f"), F.col("page_id"))
    return x.select("page_id", H.decoded_name(stem, mode).alias("decoded"), H.confidence_name(stem, mode).alias("confidence"))


# --- recovery ---------------------------------------------------------------------------------

GF = """RECURSIVE pw AS (SELECT 0 AS i, 1 AS x UNION ALL SELECT i + 1, CASE WHEN x * 2 > 255 THEN xor(x * 2, 285) ELSE x * 2 END FROM pw WHERE i < 254)"""


@query(f"WITH {GF} SELECT i, x FROM pw")
def gf256_powers(spark, d):
    return spark.createDataFrame([(i, int(x)) for i, x in enumerate(gf256.EXP)], "i int, x int")


@query(f"WITH {GF} SELECT a.x AS a, b.x AS b, p.x AS product, q.x AS inverse FROM pw a JOIN pw b ON TRUE JOIN pw p ON p.i = (a.i + b.i) % 255 JOIN pw q ON q.i = (255 - a.i) % 255")
def gf256_products(spark, d):
    a, b = (m.ravel() for m in np.meshgrid(np.arange(1, 256), np.arange(1, 256), indexing="ij"))
    rows = np.stack([a, b, gf256.mul(a, b), gf256.inv(a)], 1).tolist()
    return spark.createDataFrame(rows, "a int, b int, product int, inverse int")


def _fixed_coefficients(coded, blocks, cid):
    k, b = np.meshgrid(np.arange(coded), np.arange(blocks), indexing="ij")
    return (1 + (k * 7 + b * 13 + cid) % 255).astype(np.uint8)


def _byte_slices(spark, d):
    c = _chunks(spark, d)
    hexed = F.array_join(F.transform("vals", lambda v: F.lpad(F.hex(F.pmod(v, F.lit(256))), 2, "0")), "")
    return c.select("cid", "block_id", "blocks", F.unhex(hexed).alias("slice"))


@query(
    f"""WITH {GF}, {SLOTS}, pr AS (SELECT s.cid, k AS coded_id, s.slice_idx, s.v % 256 AS byte, 1 + (k * 7 + s.block_id * 13 + s.cid) % 255 AS c FROM slot s JOIN (SELECT cid, max(blocks) AS b FROM slot GROUP BY cid) g USING (cid) JOIN (SELECT unnest(range(0, 8)) AS k) ON k < ceil(b * 0.5)),
ml AS (SELECT pr.cid, coded_id, slice_idx, CASE WHEN byte = 0 THEN 0 ELSE z.x END AS p FROM pr JOIN pw a ON a.x = c LEFT JOIN pw y ON y.x = byte LEFT JOIN pw z ON z.i = (a.i + y.i) % 255),
px AS (SELECT cid, coded_id, slice_idx, bit_xor(p) AS p FROM ml GROUP BY cid, coded_id, slice_idx) SELECT cid, CAST(coded_id AS INTEGER) AS coded_id, string_agg(printf('%02X', p), '' ORDER BY slice_idx) AS payload FROM px GROUP BY cid, coded_id"""
)
def rlnc_parity_xor(spark, d):
    p = R.parity(_byte_slices(spark, d), 0.5, _fixed_coefficients)
    return p.select("cid", "coded_id", F.hex("payload").alias("payload"))


@query(
    f"""WITH {SLOTS}, n AS (SELECT cid, any_value(blocks) AS b, count(*) FILTER (NOT {LOSSY}) AS gone FROM chunk GROUP BY cid)
SELECT cid, block_id, string_agg(printf('%02X', (s.v % 256 + 256) % 256), '' ORDER BY slice_idx) AS slice FROM slot s JOIN n USING (cid) WHERE NOT {LOSSY} AND gone <= ceil(b * 0.5) AND gone < b GROUP BY cid, block_id"""
)
def rlnc_recover_exact(spark, d):
    """Lost slices solved from half as many coded ones again, byte by byte, wherever at most that many are lost."""
    s = _byte_slices(spark, d)
    got = S.survives(F.col("cid"), F.col("block_id"))
    n = s.groupBy("cid").agg(F.first("blocks").alias("b"), F.count_if(~got).alias("gone")).where("gone <= ceil(b * 0.5) AND gone < b").select("cid")
    back = R.recover(s.where(got), R.parity(s, 0.5, seed=123)).join(n, "cid", "left_semi")
    size = s.select("cid", "block_id", F.length("slice").alias("size"))
    return back.join(size, ["cid", "block_id"]).select("cid", "block_id", F.hex(F.substring(F.col("slice"), F.lit(1), F.col("size"))).alias("slice"))


@query(f"WITH {SLOTS}, n AS (SELECT cid, any_value(blocks) AS b, count(*) FILTER ({LOSSY}) AS got FROM chunk GROUP BY cid) SELECT cid, got < b AND got > 0 AS try_auto, CASE WHEN got < b AND got > 0 THEN 'recover' WHEN got = 0 THEN 'fail' ELSE 'direct' END AS path FROM n")
def recovery_wiring(spark, d):
    """Automatic recovery is tried if something is missing and at least one data chunk gives the geometry."""
    n = _chunks(spark, d).groupBy("cid").agg(F.first("blocks").alias("b"), F.count_if(S.survives(F.col("cid"), F.col("block_id"))).alias("got"))
    use = (F.col("got") < F.col("b")) & (F.col("got") > 0)
    return n.select("cid", use.alias("try_auto"), F.when(use, "recover").when(F.col("got") == 0, "fail").otherwise("direct").alias("path"))


# --- packed objects ---------------------------------------------------------------------------

OBJECTS = f"""{USER_SIGNAL}, ob AS (SELECT cid, cid % 4 AS pack, count(*) AS len FROM sig GROUP BY cid), of AS (SELECT *, CAST(coalesce(sum(len) OVER (PARTITION BY pack ORDER BY cid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS off FROM ob),
tt AS (SELECT pack, CAST(sum(len) AS BIGINT) AS total FROM ob GROUP BY pack), ts AS (SELECT *, {step_sql('total')} AS step FROM tt),
gs AS (SELECT s.cid, o.pack, o.off + s.pos AS g, s.v FROM sig s JOIN of o USING (cid)), pi AS (SELECT pack, total, i, (i * step) % total AS g FROM (SELECT *, unnest(range(0, total)) AS i FROM ts)),
gb AS (SELECT gs.*, CAST(i % 16 AS INTEGER) AS block_id FROM gs JOIN pi USING (pack, g))"""


def _objects(spark, d):
    """(pack, cid, pos, g, v, block_id): four packs of objects that share one residual each."""
    s = user_signal(spark, d).withColumn("pack", F.col("cid") % 4)
    ob = s.groupBy("pack", "cid").agg(F.count("*").alias("len"))
    before = F.sum("len").over(Window.partitionBy("pack").orderBy("cid").rowsBetween(Window.unboundedPreceding, -1))
    of = ob.withColumn("off", F.coalesce(before, F.lit(0)))
    tt = ob.groupBy("pack").agg(F.sum("len").alias("total")).withColumn("step", golden_step(F.col("total"))).withColumn("inv", inverse(F.col("step"), F.col("total")))
    g = F.col("off") + F.col("pos")
    return s.join(of, ["pack", "cid"]).join(tt, "pack").select("pack", "cid", "len", "off", "total", "pos", g.alias("g"), "v", (((g * F.col("inv")) % F.col("total")) % 16).cast("int").alias("block_id"))


@query(f"WITH {OBJECTS} SELECT cid, pack, off, len FROM of")
def pack_offsets(spark, d):
    return _objects(spark, d).select("cid", "pack", "off", "len").distinct()


@query(f"WITH {OBJECTS} SELECT pack, block_id, count(*) AS n, CAST(sum(v) AS BIGINT) AS total FROM gb GROUP BY pack, block_id")
def pack_chunks_shared(spark, d):
    return _objects(spark, d).groupBy("pack", "block_id").agg(F.count("*").alias("n"), F.sum("v").alias("total"))


@query(f"WITH {OBJECTS} SELECT gb.cid, gb.g - of.off AS pos, CASE WHEN (gb.pack * 31 + block_id * 17) % 10 >= 3 THEN v ELSE 0 END AS decoded FROM gb JOIN of USING (cid)")
def unpack_range(spark, d):
    """Every object cut from its lossy pack: the range is filtered before values are put in place."""
    o = _objects(spark, d).where("g >= off and g < off + len")
    got = S.survives(F.col("pack"), F.col("block_id"))
    return o.select("cid", (F.col("g") - F.col("off")).alias("pos"), F.when(got, F.col("v")).otherwise(0).alias("decoded"))


@query(f"WITH {OBJECTS}, j AS (SELECT pack, to_json(list({{'cid': cid, 'off': off, 'len': len}} ORDER BY cid)) AS objects FROM of GROUP BY pack) SELECT * FROM j")
def pack_manifest(spark, d):
    o = _objects(spark, d).select("pack", "cid", "off", "len").distinct()
    return o.groupBy("pack").agg(F.to_json(F.array_sort(F.collect_list(F.struct("cid", "off", "len")))).alias("objects"))


@query("SELECT user_id, round(avg(CASE WHEN (user_id * 7 + event_id * 13) % 100 >= 40 THEN 1.0 ELSE 0.0 END), 9) AS kept FROM events GROUP BY user_id")
def loss_simulation(spark, d):
    """Chunks lost independently with a fixed share."""
    keep = (F.col("user_id") * 7 + F.col("event_id") * 13) % 100 >= 40
    return load(spark, d, "events").groupBy("user_id").agg(F.round(F.avg(keep.cast("double")), 9).alias("kept"))
