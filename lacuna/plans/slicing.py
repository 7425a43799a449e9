"""Queries of slicing, subset decoding, ordering and scheduling, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lacuna.functions.golden import golden_step, step_sql
from lacuna.operators import ordering as O
from lacuna.operators import slicing as S
from lacuna.sources.tables import USER_SIGNAL, load, user_signal

B = 8
QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


#: slots of the user signals in SQL: the permutation built forwards and joined back
STEPS = f"""len_ AS (SELECT cid, count(*) AS n FROM sig GROUP BY cid), st AS (SELECT cid, n, {step_sql("n")} AS step FROM len_),
perm AS (SELECT cid, n, i, (i * step) % n AS pos FROM (SELECT *, unnest(range(0, n)) AS i FROM st))"""
SLOTS = f"""{USER_SIGNAL}, {STEPS},
slot AS (SELECT s.cid, s.pos, s.v, CAST(p.i % least({B}, p.n) AS INTEGER) AS block_id, CAST(p.i // least({B}, p.n) AS INTEGER) AS slice_idx, CAST(least({B}, p.n) AS INTEGER) AS blocks
  FROM sig s JOIN perm p USING (cid, pos)),
chunk AS (SELECT cid, block_id, any_value(blocks) AS blocks, CAST(sum(abs(v)) AS BIGINT) AS score, CAST(sum(v * v) AS BIGINT) AS energy, list(v ORDER BY slice_idx) AS vals FROM slot GROUP BY cid, block_id)"""
RANKED = SLOTS + ", ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY cid ORDER BY score DESC, block_id) AS INTEGER) AS rank FROM chunk)"
LOSSY = "(cid * 31 + block_id * 17) % 10 >= 3"


def _slots(spark, d):
    return S.slots(user_signal(spark, d).select("cid", "pos", "v"), B)


def _chunks(spark, d):
    return S.chunks(_slots(spark, d))


@query(f"WITH {SLOTS} SELECT cid, block_id, score, energy FROM chunk")
def golden_slice_score(spark, d):
    return _chunks(spark, d).select("cid", "block_id", "score", "energy")


@query(f"WITH {USER_SIGNAL} SELECT n, CAST({step_sql('n')} AS BIGINT) AS step FROM (SELECT DISTINCT count(*) AS n FROM sig GROUP BY cid UNION SELECT unnest(range(1, 400)) UNION SELECT CAST(l_partkey AS BIGINT) FROM lineitem)")
def golden_steps(spark, d):
    n = user_signal(spark, d).groupBy("cid").count().select(F.col("count").alias("n")).union(spark.range(1, 400).toDF("n")).union(load(spark, d, "lineitem").select("l_partkey")).distinct()
    return n.withColumn("step", golden_step(F.col("n")))


@query(f"SELECT n, i, (i * step) % n AS pos FROM (SELECT n, step, unnest(range(0, n)) AS i FROM (SELECT n, {step_sql('n')} AS step FROM (VALUES (1), (2), (3), (10), (64), (101), (256)) t(n)))")
def golden_permutation(spark, d):
    n = spark.createDataFrame([(x,) for x in (1, 2, 3, 10, 64, 101, 256)], "n int").withColumn("step", golden_step(F.col("n")))
    return n.select("n", "step", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n").cast("long") - 1)).alias("i")).select("n", "i", ((F.col("i") * F.col("step")) % F.col("n")).alias("pos"))


def _plan_sql(target, over):
    return f"CASE WHEN {target} <= {over} + 16 THEN 1 ELSE greatest(1, CAST(ceil(r / greatest({target} - ({over}), 1)) AS BIGINT)) END"


@query(
    f"""SELECT doc_id, kb, CAST({_plan_sql("greatest(256, kb * 1024)", "c + 96")} AS BIGINT) AS blocks, CAST({_plan_sql("greatest(256, kb * 512)", "c + 30")} AS BIGINT) AS blocks_bytes,
CAST(greatest(1, least({_plan_sql("greatest(256, kb * 1024)", "c + 96")}, n_chars)) AS BIGINT) AS clamped
FROM (SELECT doc_id, n_chars, n_chars * 2 AS r, doc_id % 300 AS c, unnest([0, 1, 4, 32]) AS kb FROM documents)"""
)
def block_count_plan(spark, d):
    x = load(spark, d, "documents").select("doc_id", "n_chars", (F.col("n_chars") * 2).alias("r"), (F.col("doc_id") % 300).alias("c"), F.explode(F.array(*map(F.lit, (0, 1, 4, 32)))).alias("kb"))
    kb = S.block_count(F.col("r"), F.col("c"), F.col("kb"))
    return x.select("doc_id", "kb", kb.alias("blocks"), S.block_count_bytes(F.col("r"), F.col("c"), F.col("kb") * 512).alias("blocks_bytes"), S.clamp_blocks(kb, F.col("n_chars")).cast("long").alias("clamped"))


@query(
    """SELECT doc_id, b AS block_id, CASE WHEN b >= n_chars THEN 0 ELSE (n_chars - b + 12 - 1) // 12 * 2 END AS bytes, max(CASE WHEN b >= n_chars THEN 0 ELSE (n_chars - b + 12 - 1) // 12 * 2 END) OVER (PARTITION BY doc_id) AS longest
FROM (SELECT doc_id, n_chars, CAST(unnest(range(0, 12)) AS INTEGER) AS b FROM documents)"""
)
def slice_lengths(spark, d):
    x = load(spark, d, "documents").select("doc_id", "n_chars", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("block_id"))
    n = S.slice_length(F.col("n_chars"), F.lit(12), F.col("block_id"))
    return x.select("doc_id", "block_id", n.alias("bytes"), F.max(n).over(Window.partitionBy("doc_id")).alias("longest"))


@query(f"WITH {SLOTS} SELECT cid, block_id, blocks, vals FROM chunk")
def pack_chunks(spark, d):
    return _chunks(spark, d).select("cid", "block_id", "blocks", "vals")


@query(f"WITH {USER_SIGNAL}, s AS (SELECT *, CAST(pos % least({B}, n) AS INTEGER) AS block_id FROM sig) SELECT cid, block_id, CAST(sum(abs(v)) AS BIGINT) AS score FROM s GROUP BY cid, block_id")
def stride_slice_score(spark, d):
    return S.chunks(S.slots(user_signal(spark, d).select("cid", "pos", "v"), B, stride=True)).select("cid", "block_id", "score")


@query(f"WITH {SLOTS} SELECT cid, pos, CASE WHEN {LOSSY} THEN v ELSE 0 END AS decoded, {LOSSY} AS present FROM slot")
def decode_lossy(spark, d):
    s = _slots(spark, d)
    return S.decode(s, s.select("cid", "block_id").distinct().where(S.survives(F.col("cid"), F.col("block_id")))).select("cid", "pos", "decoded", "present")


@query(f"WITH {USER_SIGNAL} SELECT cid, count(*) AS n, list(v ORDER BY pos) AS vals FROM sig GROUP BY cid")
def roundtrip_exact(spark, d):
    """All chunks packed, unpacked and put back: every value must return to its place."""
    s = _slots(spark, d)
    c = S.chunks(s).select("cid", "block_id", F.posexplode("vals").alias("slice_idx", "w"))
    back = s.join(c, ["cid", "block_id", "slice_idx"], "left")
    placed = F.transform(F.array_sort(F.collect_list(F.struct("pos", "w"))), lambda x: x["w"])
    return back.groupBy("cid").agg(F.count("*").alias("n"), placed.alias("vals"))


@query(
    f"""WITH {RANKED}, k AS (SELECT unnest([1, 2, 4, 8]) AS k)
SELECT s.cid, k, round(avg(CASE WHEN r.rank <= k THEN 0 ELSE s.v * s.v END), 6) AS mse,
CASE WHEN sum(CASE WHEN r.rank <= k THEN 0 ELSE s.v * s.v END) = 0 THEN CAST('inf' AS DOUBLE) ELSE round(20 * log10(32767) - 10 * log10(avg(CASE WHEN r.rank <= k THEN 0.0 ELSE s.v * s.v END)), 6) END AS psnr
FROM slot s JOIN ranked r USING (cid, block_id) CROSS JOIN k GROUP BY s.cid, k"""
)
def mse_by_k(spark, d):
    """Error of the reconstruction from the k best chunks of each field."""
    c = S.best(_chunks(spark, d).select("cid", "block_id", "score", "energy", F.size("vals").alias("n")), 1 << 30)
    lost = [F.struct(F.lit(k).alias("k"), (F.sum(F.when(F.col("rank") > k, F.col("energy")).otherwise(0)) / F.sum("n")).alias("m")) for k in (1, 2, 4, 8)]
    out = c.groupBy("cid").agg(F.array(*lost).alias("e")).select("cid", F.inline("e"))
    return out.select("cid", "k", F.round("m", 6).alias("mse"), F.when(F.col("m") == 0, F.lit(float("inf"))).otherwise(F.round(20 * F.log10(F.lit(32767.0)) - 10 * F.log10("m"), 6)).alias("psnr"))


@query(
    f"""WITH {SLOTS}, e AS (SELECT cid, CASE WHEN sum(CASE WHEN {LOSSY} THEN 0 ELSE v * v END) = 0 THEN NULL ELSE 10 * log10(sum(v * v) / sum(CASE WHEN {LOSSY} THEN 0.0 ELSE v * v END)) END AS snr FROM slot GROUP BY cid)
SELECT CASE WHEN count(*) > count(snr) THEN CAST('inf' AS DOUBLE) ELSE round(avg(snr), 6) END AS mean, CASE WHEN count(*) > count(snr) THEN 0.0 ELSE round(stddev_pop(snr), 6) END AS std, round(min(snr), 6) AS least, CASE WHEN count(*) > count(snr) THEN CAST('inf' AS DOUBLE) ELSE round(max(snr), 6) END AS most FROM e"""
)
def snr_statistics(spark, d):
    """Mean, standard deviation, least and most of the fields' signal-to-noise ratio; one infinite makes mean infinite."""
    s = _slots(spark, d)
    x = S.decode(s, s.select("cid", "block_id").distinct().where(S.survives(F.col("cid"), F.col("block_id"))))
    noise = F.sum((F.col("v") - F.col("decoded")) * (F.col("v") - F.col("decoded")))
    e = x.groupBy("cid").agg(F.when(noise == 0, F.lit(None)).otherwise(10 * F.log10(F.sum(F.col("v") * F.col("v")) / noise)).alias("snr"))
    inf = F.count("*") > F.count("snr")
    top = F.lit(float("inf"))
    return e.agg(
        F.when(inf, top).otherwise(F.round(F.avg("snr"), 6)).alias("mean"),
        F.when(inf, 0.0).otherwise(F.round(F.stddev_pop("snr"), 6)).alias("std"),
        F.round(F.min("snr"), 6).alias("least"),
        F.when(inf, top).otherwise(F.round(F.max("snr"), 6)).alias("most"),
    )


# --- ordering, limits, sets -------------------------------------------------------------------


@query(f"WITH {RANKED} SELECT cid, block_id, rank, score FROM ranked WHERE rank <= 4")
def top_k_chunks_by_gain(spark, d):
    return S.best(_chunks(spark, d).select("cid", "block_id", "score"), 4).select("cid", "block_id", "rank", "score")


@query(f"WITH {SLOTS}, r AS (SELECT *, row_number() OVER (PARTITION BY cid ORDER BY CASE WHEN block_id % 3 = 0 THEN 0 ELSE score END DESC, block_id) AS k FROM chunk) SELECT cid, block_id, CAST(k AS INTEGER) AS rank FROM r WHERE k <= greatest(1, 0)")
def top_k_missing_scores(spark, d):
    """Chunks without a score count as 0.0; a limit below one counts as one."""
    c = _chunks(spark, d).select("cid", "block_id", F.when(F.col("block_id") % 3 != 0, F.col("score")).alias("score"))
    return O.by_gain(c, limit=0).select("cid", "block_id", "rank")


CODED = "coded AS (SELECT DISTINCT cid, 1000000 + k AS chunk_id FROM chunk, (SELECT unnest(range(0, 3)) AS k))"


@query(f"WITH {RANKED}, {CODED}, u AS (SELECT cid, CAST(block_id AS BIGINT) AS chunk_id, 0 AS part, rank FROM ranked UNION ALL SELECT cid, chunk_id, 1, chunk_id FROM coded), r AS (SELECT *, row_number() OVER (PARTITION BY cid ORDER BY part, rank) AS place FROM u) SELECT cid, chunk_id, CAST(place AS INTEGER) AS place FROM r WHERE place <= 6")
def cap_after_recovery(spark, d):
    c = O.by_gain(_chunks(spark, d))
    return O.capped(c, O.coded_ids(c, 3), 6, before=False)


@query(f"WITH {RANKED}, {CODED}, u AS (SELECT cid, CAST(block_id AS BIGINT) AS chunk_id, 0 AS part, rank FROM ranked WHERE rank <= 6 UNION ALL SELECT cid, chunk_id, 1, chunk_id FROM coded) SELECT cid, chunk_id, CAST(row_number() OVER (PARTITION BY cid ORDER BY part, rank) AS INTEGER) AS place FROM u")
def cap_before_recovery(spark, d):
    c = O.by_gain(_chunks(spark, d))
    return O.capped(c, O.coded_ids(c, 3), 6, before=True)


FRAMES = "fr AS (SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS frame, length(text) AS n FROM conversations), ref AS (SELECT conv_id AS stream, frame, CAST(k AS INTEGER) AS chunk_id, (n * (k + 3)) % 101 AS score FROM fr, (SELECT unnest(range(0, 4)) AS k)), rk AS (SELECT *, row_number() OVER (PARTITION BY stream, frame ORDER BY score DESC, chunk_id) - 1 AS rank FROM ref)"


def _refs(spark, d):
    c = load(spark, d, "conversations")
    frame = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1
    c = c.select(F.col("conv_id").alias("stream"), frame.alias("frame"), F.length("text").alias("n"))
    c = c.select("*", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("chunk_id"))
    return c.select("stream", "frame", "chunk_id", ((F.col("n") * (F.col("chunk_id") + 3)) % 101).alias("score"))


@query(f"WITH {FRAMES} SELECT stream, frame, chunk_id, CAST(row_number() OVER (PARTITION BY stream ORDER BY rank, frame) AS INTEGER) AS place FROM rk WHERE rank < 3")
def round_robin_schedule(spark, d):
    return O.schedule(_refs(spark, d), "round_robin", 3)


@query(f"WITH {FRAMES} SELECT stream, frame, chunk_id, CAST(row_number() OVER (PARTITION BY stream ORDER BY frame, rank) AS INTEGER) AS place FROM rk")
def sequential_schedule(spark, d):
    return O.schedule(_refs(spark, d), "sequential", None)


@query(f"WITH {FRAMES}, p AS (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY rank, frame) AS place FROM rk), x AS (SELECT *, unnest(range(0, 2)) AS rep FROM p), y AS (SELECT *, 40 + score * 13 AS len FROM x) SELECT stream, frame, chunk_id, CAST(rep AS INTEGER) AS rep, CAST(unnest(range(0, greatest(1, CAST(ceil(len / 256.0) AS BIGINT)))) AS INTEGER) AS frag FROM y")
def datagram_schedule(spark, d):
    """Each scheduled chunk twice, in fragments of 256 bytes."""
    s = O.schedule(_refs(spark, d), "round_robin", None, keep=["score"])
    s = s.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(1)))).withColumn("len", 40 + F.col("score") * 13)
    return s.select("stream", "frame", "chunk_id", "rep", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(1), F.ceil(F.col("len") / 256)).cast("int") - 1)).alias("frag"))


@query("WITH u AS (SELECT l_partkey AS chunk, min(l_linenumber) AS src FROM lineitem GROUP BY l_partkey) SELECT chunk, src, (SELECT count(*) FROM (SELECT DISTINCT l_partkey, l_linenumber FROM lineitem) x WHERE x.l_partkey = u.chunk) - 1 AS dropped FROM u")
def merge_first_wins(spark, d):
    """Union of fields in which the first source that holds a chunk wins."""
    li = load(spark, d, "lineitem").select(F.col("l_partkey").alias("chunk"), F.col("l_linenumber").alias("src")).distinct()
    return O.merge_first(li, "chunk", "src").select("chunk", "src", "dropped")


@query(f"WITH {SLOTS}, r AS (SELECT *, row_number() OVER (PARTITION BY cid ORDER BY md5(concat('7:', cid, ':', block_id)), block_id) AS k FROM chunk) SELECT cid, block_id FROM r WHERE k <= 3")
def random_subset(spark, d):
    return O.random_subset(_chunks(spark, d), 3, 7).select("cid", "block_id")


@query(f"WITH {SLOTS}, g AS (SELECT cid, any_value(blocks) AS b FROM chunk GROUP BY cid) SELECT DISTINCT cid, unnest([1, greatest(1, b // 4), greatest(1, b // 2), b]) AS k FROM g")
def k_grid(spark, d):
    g = _chunks(spark, d).groupBy("cid").agg(F.first("blocks").alias("b"))
    return g.select("cid", F.explode(O.k_grid(F.col("b"))).alias("k"))


@query("SELECT l_suppkey AS peer, list_sort(list_distinct(list(l_partkey) FILTER (l_partkey <= 65535)))[1:64] AS ids FROM lineitem GROUP BY l_suppkey")
def inventory_first_64(spark, d):
    return load(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("peer")).agg(O.inventory(F.col("l_partkey")).alias("ids"))


@query(f"WITH {SLOTS} SELECT cid, block_id, round(CAST(score * (1 + block_id % 3) AS DOUBLE), 6) AS weight, round(1 / (1 + 0.5 * (cid % 7)), 6) AS content_weight FROM chunk")
def chunk_weights(spark, d):
    c = _chunks(spark, d)
    return c.select("cid", "block_id", F.round(O.chunk_weight(F.col("score"), F.col("block_id") % 3).cast("double"), 6).alias("weight"), F.round(O.content_weight(F.col("cid") % 7, 0.5), 6).alias("content_weight"))


@query()
def weighted_random_chunk(spark, d):
    """One chunk a field, drawn with probability in proportion to its weight."""
    c = _chunks(spark, d).select("cid", "block_id", (F.col("score") + 1).alias("w"))
    return O.weighted_choice(c, "cid", "w", seed=3).select("cid", "block_id")


@query(f"WITH {RANKED} SELECT cid, to_json(list({{'file': printf('chunk_%04d.dat', block_id), 'block_id': block_id, 'score': score}} ORDER BY rank)) AS manifest FROM ranked GROUP BY cid")
def manifest_json(spark, d):
    c = _chunks(spark, d).withColumn("file", F.format_string("chunk_%04d.dat", "block_id"))
    return O.manifest(c)


@query(f"WITH {RANKED} SELECT cid, CAST(rank - 1 AS INTEGER) AS place, printf('chunk_%04d.dat', block_id) AS file FROM ranked")
def manifest_order(spark, d):
    """The order that a manifest gives, read back from its JSON."""
    c = _chunks(spark, d).withColumn("file", F.format_string("chunk_%04d.dat", "block_id"))
    return O.read_manifest(O.manifest(c)).select("cid", "place", "file")


@query("SELECT item_id, TRY_CAST(trim(t) AS DOUBLE) AS score FROM (SELECT item_id, CASE WHEN item_id % 3 = 0 THEN left(text, 5) ELSE concat(' ', item_id * 1.5, ' ') END AS t FROM benchmark)")
def score_sidecar(spark, d):
    t = F.when(F.col("item_id") % 3 == 0, F.left("text", F.lit(5))).otherwise(F.concat(F.lit(" "), F.format_string("%.1f", F.col("item_id") * 1.5), F.lit(" ")))
    return load(spark, d, "benchmark").select("item_id", O.parse_score(t).alias("score"))
