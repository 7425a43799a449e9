"""Queries of the byte-format codec, the modem and the streams."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lacuna.functions import bytes as B
from lacuna.functions import modem as M
from lacuna.operators import codec as C
from lacuna.operators import spectral as P
from lacuna.sources import media
from lacuna.sources.tables import EMBEDDING_CELLS, USER_SIGNAL, embedding_blocks, load, user_signal
from lacuna.streaming import assembly

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _images(spark, d):
    """Each vector as an 8 by 8 image of equal channels."""
    px = F.flatten(F.transform("block", lambda v: F.array_repeat(v.cast("int"), 3)))
    hexed = F.array_join(F.transform(px, lambda v: F.lpad(F.hex(v), 2, "0")), "")
    return embedding_blocks(spark, d).select("cid", F.lit(8).alias("h"), F.lit(8).alias("w"), F.unhex(hexed).alias("pixels"))


def _sounds(spark, d):
    return P.signals(user_signal(spark, d).select("cid", "pos", (F.col("v") % 20000).alias("v"))).select("cid", F.transform("x", lambda v: v.cast("short")).alias("samples"))


def _lossy(chunks):
    return chunks.where((F.col("cid") * 31 + F.regexp_extract("name", r"(\d+)", 1).cast("long") * 17) % 10 >= 3)


def _bytes(samples):
    return F.unhex(F.array_join(F.transform(samples, lambda v: F.concat(F.lpad(F.hex(F.pmod(v.cast("int"), F.lit(256))), 2, "0"), F.lpad(F.hex(F.floor(F.pmod(v.cast("int"), F.lit(65536)) / 256)), 2, "0"))), ""))


PIXELS = "px AS (SELECT cid, string_agg(repeat(printf('%02X', v), 3), '' ORDER BY y * 8 + x) AS pixels FROM cell GROUP BY cid)"
SAMPLES = "sm AS (SELECT cid, any_value(n) AS n, string_agg(printf('%02X%02X', ((v % 20000) + 65536) % 256, ((v % 20000) + 65536) // 256 % 256), '' ORDER BY pos) AS samples FROM sig GROUP BY cid)"


@query(f"WITH {EMBEDDING_CELLS}, {PIXELS} SELECT * FROM px")
def image_codec_roundtrip(spark, d):
    """All chunks of an image decoded: its pixels, byte by byte."""
    return C.decode_fields(C.encode_images(_images(spark, d), version=2, blocks=8)).select("cid", F.hex("values").alias("pixels"))


@query(f"WITH {USER_SIGNAL}, {SAMPLES} SELECT cid, samples FROM sm")
def audio_codec_roundtrip(spark, d):
    back = C.decode_fields(C.encode_sounds(_sounds(spark, d), 8000, version=2, blocks=6, coarse_max_frames=64))
    return back.select("cid", F.hex("values").alias("samples"))


@query("SELECT vec_id AS cid, printf('chunk_%04d.bin', b) AS name, concat('484F4348', v, '000000080000000803', '00000008', printf('%08X', b)) AS head FROM embeddings, (SELECT unnest(range(0, 8)) AS b), (SELECT unnest(['01', '02', '03']) AS v) WHERE embedding IS NOT NULL")
def image_chunk_headers(spark, d):
    """Magic, version, size, channels, blocks and block of the chunks of all format versions."""
    a = _images(spark, d)
    each = [C.encode_images(a, version=v, blocks=8) for v in (1, 2, 3)]
    return each[0].union(each[1]).union(each[2]).select("cid", "name", F.hex(F.substring("data", 1, 22)).alias("head"))


@query(f"WITH {USER_SIGNAL}, g AS (SELECT DISTINCT cid, n FROM sig) SELECT cid, b AS block_id, concat('484F4155', v, '010200', '00001F40', printf('%08X', n), printf('%08X', least(6, n)), printf('%08X', b), printf('%08X', least(n, 64))) AS head FROM g, (SELECT unnest(range(0, 6)) AS b), (SELECT unnest(['01', '02']) AS v) WHERE b < n")
def audio_chunk_headers(spark, d):
    s = _sounds(spark, d)
    both = [C.encode_sounds(s, 8000, version=v, blocks=6, coarse_max_frames=64) for v in (1, 2)]
    x = both[0].union(both[1]).select("cid", F.substring("data", 1, 28).alias("head"))
    return x.select("cid", B.from_be(F.col("head"), 20, 4).alias("block_id"), F.hex("head").alias("head"))


def _image_error(a, back):
    def run(batches):
        for b in batches:
            e = [round(C.error(np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)), 4) for x, y in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(e, pa.float64()), b.column(3)], names=["cid", "mse", "confidence"])

    x = a.join(back, "cid").select("cid", "pixels", "values", F.round(F.aggregate("confidence", F.lit(0.0), lambda s, v: s + v) / F.size("confidence"), 6).alias("confidence"))
    return x.mapInArrow(run, "cid long, mse double, confidence double")


@query()
def image_codec_lossy(spark, d):
    """Transform-coded images from the chunks that survive: error and mean confidence."""
    a = _images(spark, d)
    return _image_error(a, C.decode_fields(_lossy(C.encode_images(a, version=3, blocks=8, coarse_max_side=4))))


@query()
def image_codec_recovered(spark, d):
    a = _images(spark, d)
    return _image_error(a, C.decode_fields(_lossy(C.encode_images(a, version=3, blocks=8, coarse_max_side=4, overhead=0.5, seed=123))))


@query()
def image_codec_best_k(spark, d):
    a = _images(spark, d)
    return _image_error(a, C.decode_fields(C.encode_images(a, version=3, blocks=8, coarse_max_side=4), most=4, by_gain=True))


@query()
def image_lowfreq_model(spark, d):
    a = _images(spark, d)
    return _image_error(a, C.decode_fields(C.encode_images(a, version=3, blocks=8, model="latent_lowfreq")))


@query()
def image_latent_model(spark, d):
    a = _images(spark, d)
    return _image_error(a, C.decode_fields(C.encode_images(a, version=3, blocks=8, model="ae_latent")))


@query()
def audio_codec_spectral(spark, d):
    """Spectral audio chunks, half of them by energy, decoded: mean confidence and size."""
    s = _sounds(spark, d)
    back = C.decode_fields(C.encode_sounds(s, 8000, version=3, blocks=8, n_fft=32, coarse_max_frames=16), most=4, by_gain=True)
    return back.select("cid", F.size("confidence").alias("n"), F.round(F.aggregate("confidence", F.lit(0.0), lambda a, v: a + v) / F.size("confidence"), 6).alias("confidence"))


@query()
def heal_images(spark, d):
    a = _images(spark, d)
    return _image_error(a, C.decode_fields(C.heal_fields(_lossy(C.encode_images(a, version=3, blocks=8, coarse_max_side=4)), honest=True)))


@query()
def stack_images(spark, d):
    """Lossy exposures of one label stacked in the coefficient domain."""
    e = load(spark, d, "embeddings").select(F.col("vec_id").alias("cid"), "label")
    chunks = _lossy(C.encode_images(_images(spark, d), version=3, blocks=8, coarse_max_side=4)).join(e, "cid")

    def run(t: pa.Table) -> pa.Table:
        fields = {}
        for cid, row in zip(t["cid"].to_pylist(), C._rows(t), strict=True):
            fields.setdefault(cid, []).append(row)
        got = [f for _, c in sorted(fields.items()) if (f := C.gather(c)) is not None]
        return pa.table({"label": pa.array([t["label"][0].as_py()], pa.int64()), "fields": pa.array([len(got)], pa.int32()), "mean": [round(float(C.stack(got, align=False).mean()), 4)]})

    return chunks.groupBy("label").applyInArrow(run, "label long, fields int, mean double")


@query("SELECT item_id, text AS decoded FROM benchmark WHERE text IS NOT NULL")
def afsk_roundtrip(spark, d):
    """Texts framed, turned into tones with noise at 30 dB, and heard again."""

    def run(batches):
        for b in batches:
            out = []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                got = M.Modem().decode(M.awgn(M.Modem().encode(t.encode()), 30, np.random.default_rng(k)))
                out.append(got[0].decode() if got else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=["item_id", "decoded"])

    return load(spark, d, "benchmark").select("item_id", "text").where("text is not null").mapInArrow(run, "item_id long, decoded string")


@query("SELECT item_id, CAST(7 AS BIGINT) AS chunk_id, text FROM benchmark WHERE text IS NOT NULL")
def sound_transport(spark, d):
    """Texts sent as chunks in several datagrams over sound, gathered by their content ids."""

    def run(batches):
        for b in batches:
            items, ids, texts = [], [], []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                cid = k.to_bytes(16, "big")
                for (_, chunk), data in M.sound_to_chunks(M.chunks_to_sound([(7, t.encode())], cid, most=128), cid).items():
                    items.append(k)
                    ids.append(chunk)
                    texts.append(data.decode())
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.int64()), pa.array(ids, pa.int64()), pa.array(texts, pa.string())], names=["item_id", "chunk_id", "text"])

    return load(spark, d, "benchmark").select("item_id", "text").where("text is not null").mapInArrow(run, "item_id long, chunk_id long, text string")


@query("SELECT item_id, [text, concat('2: ', text)] AS frames FROM benchmark WHERE text IS NOT NULL")
def frame_resync(spark, d):
    """The payloads of two good frames with a damaged one and noise between them."""

    def run(batches):
        for b in batches:
            out = []
            for t in b.column(1).to_pylist():
                f = M.build_frame(t.encode())
                bad = f[:-1] + bytes([f[-1] ^ 1])
                dec, stream, got = M.FrameDecoder(), f + bad + b"\x2d\xd4\xff\xff noise" + M.build_frame(b"2: " + t.encode()), []
                for i in range(0, len(stream), 50):
                    got += dec.push(stream[i : i + 50])
                out.append([x.decode() for x in got])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.string()))], names=["item_id", "frames"])

    return load(spark, d, "benchmark").select("item_id", "text").where("text is not null").mapInArrow(run, "item_id long, frames array<string>")


@query()
def channel_dropout(spark, d):
    """Samples that a burst of silence leaves, per user signal."""

    def run(batches):
        for b in batches:
            left = [int((M.dropout(np.ones(len(x)), 1.0, 0.001, 8000, np.random.default_rng(k)) != 0).sum()) for k, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(left, pa.int64())], names=["cid", "kept"])

    return P.signals(user_signal(spark, d).select("cid", "pos", "v")).mapInArrow(run, "cid long, kept long")


@query(f"WITH {USER_SIGNAL}, g AS (SELECT cid, n, CAST(greatest(1, round_even(n * 12 / 8.0, 0)) AS BIGINT) AS m FROM (SELECT DISTINCT cid, n FROM sig)), t AS (SELECT *, unnest(range(0, m)) AS i FROM g), x AS (SELECT *, i * n / CAST(m AS DOUBLE) AS p FROM t), k AS (SELECT *, least(CAST(floor(round(p, 9)) AS BIGINT), n - 1) AS lo FROM x) SELECT k.cid, k.i, round(a.v + (coalesce(b.v, a.v) - a.v) * (CASE WHEN b.v IS NULL THEN 0 ELSE p - lo END), 7) AS x FROM k JOIN sig a ON a.cid = k.cid AND a.pos = lo LEFT JOIN sig b ON b.cid = k.cid AND b.pos = lo + 1")
def resample_linear(spark, d):
    def run(batches):
        for b in batches:
            for k, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                y = np.round(media.resample(np.array(x), 8, 12), 7)
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(y), pa.int64()), pa.array(np.arange(len(y))), pa.array(y)], names=["cid", "i", "x"])

    return P.signals(user_signal(spark, d).select("cid", "pos", "v")).mapInArrow(run, "cid long, i long, x double")


@query(
    f"""WITH {EMBEDDING_CELLS}, {PIXELS}, w AS (SELECT cid, string_agg(printf('%02X%02X', (v * 100 - 9000 + 65536) % 256, (v * 100 - 9000 + 65536) // 256 % 256), '' ORDER BY pos) AS wav FROM (SELECT cid, (y * 8 + x) * 3 + k AS pos, v FROM cell, (SELECT unnest(range(0, 3)) AS k)) GROUP BY cid)
SELECT cid, '89504E470D0A1A0A0000000D4948445200000008000000080802000000' AS png_head, pixels AS png, '52494646A401000057415645666D7420100000000100020040 1F0000007D000004001000646174618001 0000' AS wav_head, wav, wav AS wav24 FROM px JOIN w USING (cid)""".replace("40 1F", "401F").replace("8001 0000", "80010000")
)
def media_containers(spark, d):
    """PNG and WAVE heads as written, and pixels and samples as read back, 24-bit samples included."""

    def run(batches):
        for b in batches:
            out = [[] for _ in range(5)]
            hexed = lambda v: bytes(v).hex().upper()
            for px in b.column(1).to_pylist():
                a = np.frombuffer(px, np.uint8).reshape(8, 8, 3)
                x = a.astype(np.int16).reshape(-1, 2) * 100 - 9000
                wide = (x.astype(np.int32) << 8).astype("<i4").view(np.uint8).reshape(-1, 4)[:, :3].tobytes()
                w24 = bytearray(media.write_wav(x, 8000)[:44])
                w24[34:36] = (24).to_bytes(2, "little")
                w24[40:44] = len(wide).to_bytes(4, "little")
                png, wav = media.write_png(a), media.write_wav(x, 8000)
                row = (png[:29], media.read_png(png), wav[:44], media.read_wav(wav)[0].astype("<i2").tobytes(), media.read_wav(bytes(w24) + wide)[0].astype("<i2").tobytes())
                for c, v in zip(out, row, strict=True):
                    c.append(hexed(v))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.string()) for c in out)], names=["cid", "png_head", "png", "wav_head", "wav", "wav24"])

    return _images(spark, d).select("cid", "pixels").mapInArrow(run, "cid long, png_head string, png string, wav_head string, wav string, wav24 string")


FRAGMENTS = "f AS (SELECT user_id % 3 AS content_id, event_id // 4 AS chunk_id, event_id % 4 AS idx, event_type, epoch(ts) AS seen FROM events)"


def _fragments(spark, d):
    """Every four events one chunk, told apart by content as well: fragments by event id, four to a chunk."""
    # a pattern, since a stream takes no single file by its name; it finds a folder of part files as well
    s = spark.readStream.schema(load(spark, d, "events").schema).parquet(f"{d}/events.parque[t]")
    payload = F.encode("event_type", "UTF-8").alias("payload")
    parts = s.select((F.col("user_id") % 3).cast("string").alias("content_id"), F.floor(F.col("event_id") / 4).alias("chunk_id"), (F.col("event_id") % 4).cast("int").alias("frag_idx"), F.lit(4).alias("frag_total"), F.lit(1 << 20).cast("long").alias("chunk_len"), payload, F.timestamp_micros((F.unix_micros(F.col("ts").cast("timestamp")))).alias("at"))
    return parts


@query(f"WITH {FRAGMENTS}, g AS (SELECT content_id, chunk_id, count(*) AS n, string_agg(event_type, '' ORDER BY idx) AS data FROM f GROUP BY content_id, chunk_id) SELECT CAST(content_id AS VARCHAR) AS content_id, chunk_id, data FROM g WHERE n = 4")
def stream_assemble(spark, d):
    """Fragments read as a stream and assembled in state keyed by content and chunk."""
    x = assembly.run_once(assembly.assemble(_fragments(spark, d), max_age=1e9), "assemble")
    return x.where("event = 'complete'").select("content_id", "chunk_id", F.decode("data", "UTF-8").alias("data"))


@query(
    f"""WITH {FRAGMENTS}, g AS (SELECT content_id, chunk_id, count(*) AS n, max(seen) - min(seen) AS span FROM f GROUP BY content_id, chunk_id) SELECT count(*) FILTER (n = 4 AND span <= 100) AS chunks_completed FROM g"""
)
def stream_counters(spark, d):
    """Chunks completed by a stream whose partials expire after 100 seconds."""
    return assembly.counters(assembly.run_once(assembly.assemble(_fragments(spark, d), max_age=100), "counters")).select("chunks_completed")
