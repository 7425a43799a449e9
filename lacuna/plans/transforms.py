"""Queries of transforms, confidence, healing, stacking and torsion, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lacuna.functions import transforms as T
from lacuna.operators import algebra as A
from lacuna.operators import slicing as S
from lacuna.operators import spectral as P
from lacuna.plans.slicing import LOSSY, SLOTS, STEPS, _slots
from lacuna.sources.tables import EMBEDDING_CELLS, USER_SIGNAL, embedding_blocks, embedding_cells, load, user_signal

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


N_FFT, HOP = 16, 8
BASE = "[" + ", ".join(map(str, T.LUMINANCE)) + "]"
SCALE = "(CASE WHEN {q} < 50 THEN 5000.0 / {q} ELSE 200 - 2 * {q} END)"


def quant_sql(q: str, i: str) -> str:
    """Quantisation step of row-major cell i (from 0)."""
    return f"greatest(1, floor(({BASE}[CAST({i} AS BIGINT) + 1] * {SCALE.format(q=q)} + 50) / 100.0))"


ZIGZAG = "zz AS (SELECT y, x, CAST(row_number() OVER (ORDER BY y + x, CASE WHEN (y + x) % 2 = 0 THEN -y ELSE y END) - 1 AS INTEGER) AS k FROM (SELECT CAST(unnest(range(0, 8)) AS INTEGER) AS y), (SELECT CAST(unnest(range(0, 8)) AS INTEGER) AS x))"
BASIS = "bas AS (SELECT CAST(f AS INTEGER) AS f, CAST(p AS INTEGER) AS p, CASE WHEN f = 0 THEN sqrt(1 / 8.0) ELSE sqrt(2 / 8.0) END * cos(pi() * (2 * p + 1) * f / 16) AS w FROM (SELECT unnest(range(0, 8)) AS f), (SELECT unnest(range(0, 8)) AS p))"
COEFS = f"""{EMBEDDING_CELLS}, {ZIGZAG}, {BASIS},
half AS (SELECT cid, f AS fy, x, sum(w * v) AS h FROM cell JOIN bas ON p = y GROUP BY cid, f, x),
freq AS (SELECT cid, fy, f AS fx, sum(w * h) AS c FROM half JOIN bas ON p = x GROUP BY cid, fy, f),
co AS (SELECT cid, k, fy, fx, CAST(round_even(round(c / {quant_sql("50", "fy * 8 + fx")}, 9), 0) AS BIGINT) AS q FROM freq JOIN zz ON zz.y = fy AND zz.x = fx)"""


def inverse_sql(source: str, rounding: str) -> str:
    return f"""ih AS (SELECT cid, p AS y, fx, sum(w * q * {quant_sql("50", "fy * 8 + fx")}) AS h FROM {source} JOIN bas ON f = fy GROUP BY cid, p, fx),
px AS (SELECT cid, y, p AS x, {rounding}(least(greatest(round(sum(w * h), 9), 0), 255)) AS r FROM ih JOIN bas ON f = fx GROUP BY cid, y, p)"""


def _coded(spark, d):
    return P.encode_blocks(embedding_blocks(spark, d))


@query(f"SELECT q AS quality, CAST(i AS INTEGER) AS cell, CAST({quant_sql('q', 'i')} AS DOUBLE) AS step FROM (SELECT unnest([1, 7, 10, 25, 33, 49, 50, 75, 100]) AS q), (SELECT unnest(range(0, 64)) AS i)")
def quant_tables(spark, d):
    rows = [(q, i, float(v)) for q in (1, 7, 10, 25, 33, 49, 50, 75, 100) for i, v in enumerate(T.quant_table(8, q).ravel())]
    return spark.createDataFrame(rows, "quality int, cell int, step double")


@query("SELECT n, CAST(row_number() OVER (PARTITION BY n ORDER BY y + x, CASE WHEN (y + x) % 2 = 0 THEN -y ELSE y END) - 1 AS INTEGER) AS k, CAST(y * n + x AS INTEGER) AS cell FROM (SELECT n, unnest(range(0, n)) AS y FROM (VALUES (1), (2), (3), (4), (8)) t(n)) JOIN (SELECT n, unnest(range(0, n)) AS x FROM (VALUES (1), (2), (3), (4), (8)) t(n)) USING (n)")
def zigzag_order(spark, d):
    return spark.createDataFrame([(n, k, int(c)) for n in (1, 2, 3, 4, 8) for k, c in enumerate(T.zigzag(n))], "n int, k int, cell int")


@query("SELECT CAST(f AS INTEGER) AS f, CAST(p AS INTEGER) AS p, round(CASE WHEN f = 0 THEN sqrt(1 / 8.0) ELSE sqrt(2 / 8.0) END * cos(pi() * (2 * p + 1) * f / 16), 9) AS w FROM (SELECT unnest(range(0, 8)) AS f), (SELECT unnest(range(0, 8)) AS p)")
def dct_basis(spark, d):
    return spark.createDataFrame([(f, p, float(round(w, 9))) for f, r in enumerate(T.dct_basis(8)) for p, w in enumerate(r)], "f int, p int, w double")


@query(f"WITH {COEFS} SELECT cid, k, q FROM co WHERE q <> 0")
def dct8x8_quant(spark, d):
    return P.explode_coefs(_coded(spark, d)).where("q != 0")


@query(
    f"""WITH {COEFS}, st AS (SELECT list_filter(range(39, 64), lambda s: gcd(s, 64) = 1)[1] AS s), pm AS (SELECT i, (i * s) % 64 AS k FROM st, (SELECT unnest(range(0, 64)) AS i))
SELECT cid, CAST(i % 4 AS INTEGER) AS block_id, CAST(sum(q * q) AS BIGINT) AS energy FROM co JOIN pm USING (k) GROUP BY cid, i % 4"""
)
def image_slice_energy(spark, d):
    """Coefficients dealt to four chunks by the golden permutation, with the energy that ranks them."""
    c = P.explode_coefs(_coded(spark, d)).select("cid", F.col("k").cast("long").alias("pos"), F.col("q").alias("v"))
    return S.chunks(S.slots(c, 4)).select("cid", "block_id", "energy")


@query(f"WITH {COEFS}, {inverse_sql('co', 'floor')} SELECT cid, round(avg((v - r) * (v - r)), 6) AS mse FROM px JOIN cell USING (cid, y, x) GROUP BY cid")
def dct_roundtrip_mse(spark, d):
    c = embedding_blocks(spark, d)
    return A.block_error(c, P.render(P.encode_blocks(c)))


@query(f"WITH {COEFS}, lf AS (SELECT * FROM co WHERE k < 6), {inverse_sql('lf', '')} SELECT cid, round(avg((v - round_even(r, 0)) * (v - round_even(r, 0))), 6) AS mse FROM px JOIN cell USING (cid, y, x) GROUP BY cid")
def lowfreq_image_mse(spark, d):
    """The coarse model that keeps the first six zigzag coefficients."""
    c = embedding_blocks(spark, d)
    kept = P.encode_blocks(c).withColumn("coefs", F.transform("coefs", lambda q, k: F.when(k < 6, q).otherwise(F.lit(0).cast("long"))))
    return A.block_error(c, P.render(kept, rounding="nearest"))


@query(f"WITH {COEFS}, st AS (SELECT list_filter(range(39, 64), lambda s: gcd(s, 64) = 1)[1] AS s), pm AS (SELECT i, (i * s) % 64 AS k FROM st, (SELECT unnest(range(0, 64)) AS i)), m AS (SELECT cid, fy, fx, (cid * 31 + (i % 4) * 17) % 10 >= 3 AS got FROM co JOIN pm USING (k)) SELECT cid, round(sum(CASE WHEN got THEN 1 / {quant_sql('50', 'fy * 8 + fx')} ELSE 0 END) / sum(1 / {quant_sql('50', 'fy * 8 + fx')}), 9) AS confidence FROM m GROUP BY cid")
def confidence_blocks(spark, d):
    """Per block, the share of present coefficients weighted by the inverse of their quantisation steps."""
    c = P.explode_coefs(_coded(spark, d)).select("cid", F.col("k").cast("long").alias("pos"), F.col("q").alias("v"))
    s = S.slots(c, 4)
    got = S.survives(F.col("cid"), F.col("block_id"))
    w = F.array(*[F.lit(float(x)) for x in 1 / T.quant_table(8, 50).ravel()[T.zigzag(8)]])
    return A.weighted_presence(s.select("cid", got.alias("present"), F.get(w, F.col("pos").cast("int")).alias("w")), ["cid"])


@query(f"WITH {EMBEDDING_CELLS} SELECT cid, count(*) FILTER ((cid * 31 + (y * 6 + x) % 4 * 17) % 10 >= 3) / 64 AS confidence FROM cell WHERE y < 7 AND x < 6 GROUP BY cid")
def confidence_cells(spark, d):
    """Mean of the cell mask over 8 by 8 tiles, zero-padded: a ragged edge stays below 1."""
    c = embedding_cells(spark, d).where("y < 7 and x < 6")
    got = S.survives(F.col("cid"), (F.col("y") * 6 + F.col("x")) % 4)
    return A.tile_confidence(c.select("cid", "y", "x", got.alias("present"))).select("cid", "confidence")


@query(f"WITH {SLOTS} SELECT cid, pos, CASE WHEN {LOSSY} THEN 1.0e0 ELSE 0.0e0 END AS confidence FROM slot")
def confidence_samples(spark, d):
    s = _slots(spark, d)
    return s.select("cid", "pos", S.survives(F.col("cid"), F.col("block_id")).cast("double").alias("confidence"))


FRAMES = f"fc AS (SELECT cid, count(*) AS n, greatest(1, CAST(ceil((count(*) - {N_FFT}) / {HOP}.0) AS BIGINT) + 1) AS m FROM sig GROUP BY cid)"
SPEC = f"""{USER_SIGNAL}, {FRAMES}, fs AS (SELECT cid, CAST(unnest(range(0, m)) AS INTEGER) AS frame FROM fc),
fx AS (SELECT f.cid, f.frame, s.pos - f.frame * {HOP} AS t, s.v * sqrt(0.5 - 0.5 * cos(2 * pi() * (s.pos - f.frame * {HOP}) / {N_FFT - 1})) AS x FROM fs f JOIN sig s ON s.cid = f.cid AND s.pos >= f.frame * {HOP} AND s.pos < f.frame * {HOP} + {N_FFT}),
sp AS (SELECT cid, frame, CAST(b AS INTEGER) AS bin, sum(x * cos(2 * pi() * b * t / {N_FFT})) AS re, -sum(x * sin(2 * pi() * b * t / {N_FFT})) AS im FROM fx, (SELECT unnest(range(0, {N_FFT // 2 + 1})) AS b) GROUP BY cid, frame, b)"""


def _spec(spark, d):
    return P.spectrum(P.signals(user_signal(spark, d).select("cid", "pos", "v")), N_FFT, HOP)


@query(f"WITH {USER_SIGNAL}, {FRAMES} SELECT cid, n, m FROM fc UNION ALL SELECT -1, 0, 0")
def stft_frame_count(spark, d):
    n = user_signal(spark, d).groupBy("cid").agg(F.count("*").alias("n"))
    return n.union(spark.createDataFrame([(-1, 0)], "cid long, n long")).select("cid", "n", A.frame_count(F.col("n"), N_FFT, HOP).alias("m"))


@query("SELECT q AS quality, CAST(i AS INTEGER) AS bin, round(greatest(1.0, (120 - q) / 20.0) / 512 * (1 + i / 256.0), 12) AS step FROM (SELECT unnest([1, 50, 90, 100]) AS q), (SELECT unnest(range(0, 257)) AS i)")
def audio_quant_steps(spark, d):
    i = spark.createDataFrame([(q,) for q in (1, 50, 90, 100)], "quality int").select("quality", F.explode(F.sequence(F.lit(0), F.lit(256))).alias("bin"))
    return i.select("*", F.round(A.audio_step(F.col("bin"), 257, F.col("quality"), 512), 12).alias("step"))


@query(f"WITH {SPEC} SELECT cid, bin, round(sum(re * re + im * im), 2) AS energy FROM sp GROUP BY cid, bin")
def stft_energy(spark, d):
    return _spec(spark, d).groupBy("cid", "bin").agg(F.round(F.sum(F.col("re") * F.col("re") + F.col("im") * F.col("im")), 2).alias("energy"))


@query(f"WITH {SPEC} SELECT cid, round(sum(CASE WHEN bin < 4 THEN re * re + im * im ELSE 0 END) / sum(re * re + im * im), 8) AS share FROM sp GROUP BY cid")
def lowfreq_audio_share(spark, d):
    """Energy that the coarse model of the lowest bins keeps."""
    e = F.col("re") * F.col("re") + F.col("im") * F.col("im")
    return _spec(spark, d).groupBy("cid").agg(F.round(F.sum(F.when(F.col("bin") < 4, e).otherwise(0.0)) / F.sum(e), 8).alias("share"))


QUALITY = 60
STEP = f"(greatest(1.0, (120 - {QUALITY}) / 20.0) / {N_FFT} * (1 + bin / {N_FFT / 2}))"


@query(f"WITH {SPEC}, q AS (SELECT cid, frame, bin, CAST(round_even(round(re / {N_FFT} / {STEP}, 6), 0) AS BIGINT) AS a, CAST(round_even(round(im / {N_FFT} / {STEP}, 6), 0) AS BIGINT) AS b FROM sp) SELECT cid, CAST(sum(least(greatest(a, -32768), 32767) * least(greatest(a, -32768), 32767) + least(greatest(b, -32768), 32767) * least(greatest(b, -32768), 32767)) AS BIGINT) AS energy, bool_or(abs(a) > 32767 OR abs(b) > 32767) AS clipped FROM q GROUP BY cid")
def audio_coefficients(spark, d):
    """Spectra divided by the frame's length and quantised with the format's steps, with the clip flag."""
    s = _spec(spark, d).withColumn("step", A.audio_step(F.col("bin"), N_FFT // 2 + 1, F.lit(QUALITY), N_FFT))
    q = lambda c: F.rint(F.round(F.col(c) / N_FFT / F.col("step"), 6)).cast("long")
    clip = lambda c: F.greatest(F.least(c, F.lit(32767)), F.lit(-32768))
    s = s.select("cid", q("re").alias("a"), q("im").alias("b"))
    return s.groupBy("cid").agg(F.sum(clip(F.col("a")) * clip(F.col("a")) + clip(F.col("b")) * clip(F.col("b"))).alias("energy"), F.bool_or((F.abs("a") > 32767) | (F.abs("b") > 32767)).alias("clipped"))


@query(f"WITH {USER_SIGNAL}, {FRAMES} SELECT cid, pos, CASE WHEN pos = 0 OR pos = (m - 1) * {HOP} + {N_FFT - 1} THEN 0.0e0 ELSE CAST(v AS DOUBLE) END AS x FROM sig JOIN fc USING (cid)")
def audio_roundtrip(spark, d):
    """Spectra there and back: every sample returns, but for those on which no window has weight."""
    return A.audio_roundtrip(P.signals(user_signal(spark, d).select("cid", "pos", "v")), N_FFT, HOP)


@query(f"WITH {USER_SIGNAL}, {FRAMES}, fs AS (SELECT cid, CAST(unnest(range(0, m)) AS INTEGER) AS frame, m FROM fc), ab AS (SELECT f.cid, f.frame, any_value(m) AS m, sum(abs(s.v)) / {N_FFT}.0 AS e FROM fs f JOIN sig s ON s.cid = f.cid AND s.pos >= f.frame * {HOP} AND s.pos < f.frame * {HOP} + {N_FFT} GROUP BY f.cid, f.frame), c AS (SELECT cid, frame, m, e - avg(e) OVER (PARTITION BY cid) AS e FROM ab) SELECT cid, frame, round(e * CASE WHEN m > 1 THEN 0.5 - 0.5 * cos(2 * pi() * frame / (m - 1)) ELSE 1 END, 6) + 0.0 AS envelope FROM c")
def envelope_frames(spark, d):
    return A.envelope(user_signal(spark, d).select("cid", "pos", "v"), N_FFT, HOP)


@query(f"WITH {USER_SIGNAL}, {FRAMES}, g AS (SELECT cid, m, CAST(unnest(range(0, m)) AS INTEGER) AS frame FROM fc), b AS (SELECT *, CAST(unnest(range(0, {N_FFT // 2 + 1})) AS INTEGER) AS bin FROM g) SELECT cid, frame, round(least(1, sum(CASE WHEN (cid * 31 + (frame + bin) % 8 * 17) % 10 >= 3 THEN 1.0 / (1 + bin) ELSE 0 END) / sum(1.0 / (1 + bin))), 9) AS confidence FROM b GROUP BY cid, frame")
def confidence_frames(spark, d):
    """Per frame, present bins weighted by 1 / (1 + bin)."""
    m = user_signal(spark, d).groupBy("cid").agg(F.count("*").alias("n")).select("cid", F.explode(F.sequence(F.lit(0), A.frame_count(F.col("n"), N_FFT, HOP).cast("int") - 1)).alias("frame"))
    x = m.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(N_FFT // 2))))
    got = S.survives(F.col("cid"), (F.col("frame") + F.col("bin")) % 8)
    return A.weighted_presence(x.select("cid", "frame", got.alias("present"), (1.0 / (1 + F.col("bin"))).alias("w")), ["cid", "frame"])


@query(f"WITH {USER_SIGNAL}, {FRAMES}, v AS (SELECT cid, n, m, CAST(unnest(range(0, m)) AS INTEGER) AS frame FROM fc), k AS (SELECT *, (cid + frame * 3) % 7 / 7.0 AS c FROM v), p AS (SELECT s.cid, s.pos, f.m, CASE WHEN f.m > 1 THEN s.pos * ((f.m - 1) / CAST(f.n - 1 AS DOUBLE)) ELSE 0 END AS x FROM sig s JOIN fc f USING (cid)), q AS (SELECT *, least(CAST(floor(round(x, 9)) AS BIGINT), m - 1) AS i FROM p) SELECT q.cid, q.pos, round(a.c + (coalesce(b.c, a.c) - a.c) * (q.x - q.i), 9) AS confidence FROM q JOIN k a ON a.cid = q.cid AND a.frame = q.i LEFT JOIN k b ON b.cid = q.cid AND b.frame = q.i + 1")
def confidence_curve(spark, d):
    """Frame values interpolated to samples."""
    s = user_signal(spark, d).select("cid", "pos", "n")
    m = A.frame_count(F.col("n"), N_FFT, HOP)
    k = s.select("cid", "n").distinct().select("cid", F.explode(F.sequence(F.lit(0).cast("long"), m - 1)).alias("frame"))
    return A.curve(s.withColumn("m", m), k.withColumn("c", ((F.col("cid") + F.col("frame") * 3) % 7) / 7.0))


# --- coarse tracks ----------------------------------------------------------------------------

COARSE = f"""{USER_SIGNAL}, g AS (SELECT *, least(n, 12) AS L FROM sig),
ix AS (SELECT *, CASE WHEN n > 1 THEN round(pos * ((L - 1) / CAST(n - 1 AS DOUBLE)), 9) ELSE 0 END AS a_t FROM g), lh AS (SELECT *, CAST(floor(a_t) AS BIGINT) AS lo, least(CAST(floor(a_t) AS BIGINT) + 1, L - 1) AS hi FROM ix),
pk AS (SELECT *, CASE WHEN L > 1 THEN CAST(floor(round(lo * ((n - 1) / CAST(L - 1 AS DOUBLE)), 9)) AS BIGINT) ELSE 0 END AS plo, CASE WHEN L > 1 THEN CAST(floor(round(hi * ((n - 1) / CAST(L - 1 AS DOUBLE)), 9)) AS BIGINT) ELSE 0 END AS phi FROM lh),
co AS (SELECT p.cid, p.pos, p.v, CAST(round_even(round(a.v * (1 - (a_t - lo)) + b.v * (a_t - lo), 9), 0) AS BIGINT) AS coarse FROM pk p JOIN sig a ON a.cid = p.cid AND a.pos = p.plo JOIN sig b ON b.cid = p.cid AND b.pos = p.phi)"""


@query(f"WITH {COARSE} SELECT cid, pos, coarse, least(greatest(v - coarse, -32768), 32767) AS residual, abs(v - coarse) > 32767 AS clipped FROM co")
def audio_coarse_lerp(spark, d):
    return P.coarse(user_signal(spark, d).select("cid", "pos", "v"), 12).select("cid", "pos", "coarse", "residual", "clipped")


@query(
    f"""WITH {COARSE}, {STEPS}, r AS (SELECT cid, pos, least(greatest(v - coarse, -32768), 32767) AS r FROM co)
SELECT r.cid, CAST(p.i % least(8, p.n) AS INTEGER) AS block_id, CAST(sum(abs(r)) AS BIGINT) AS score FROM r JOIN perm p USING (cid, pos) GROUP BY r.cid, p.i % least(8, p.n)"""
)
def audio_residual_score(spark, d):
    r = P.coarse(user_signal(spark, d).select("cid", "pos", "v"), 12).select("cid", "pos", F.col("residual").alias("v"))
    return S.chunks(S.slots(r, 8)).select("cid", "block_id", "score")


@query(f"WITH {COARSE}, p2 AS (SELECT *, (cid * 31 + pos % 8 * 17) % 10 >= 3 AS got FROM co) SELECT cid, pos, least(greatest(coarse + CASE WHEN got THEN least(greatest(v - coarse, -32768), 32767) ELSE 0 END, -32768), 32767) AS decoded FROM p2")
def audio_decode_lossy(spark, d):
    """Coarse track plus the residual of the chunks that came, clipped to 16 bits."""
    r = P.coarse(user_signal(spark, d).select("cid", "pos", "v"), 12)
    got = S.survives(F.col("cid"), F.col("pos") % 8)
    x = F.col("coarse") + F.when(got, F.col("residual")).otherwise(0)
    return r.select("cid", "pos", F.greatest(F.least(x, F.lit(32767)), F.lit(-32768)).alias("decoded"))


# --- field algebra ----------------------------------------------------------------------------


@query(f"WITH {SLOTS} SELECT cid, count(*) FILTER ({LOSSY}) AS present, any_value(blocks) AS total, round(count(*) FILTER ({LOSSY}) / any_value(blocks), 6) AS coverage FROM chunk GROUP BY cid")
def coverage_report(spark, d):
    c = S.chunks(_slots(spark, d))
    got = S.survives(F.col("cid"), F.col("block_id"))
    return c.groupBy("cid").agg(F.count_if(got).alias("present"), F.first("blocks").alias("total"), F.round(F.count_if(got) / F.first("blocks"), 6).alias("coverage"))


@query(f"WITH {SLOTS}, z AS (SELECT cid, pos, CASE WHEN {LOSSY} THEN v ELSE 0 END AS v, n FROM slot JOIN len_ USING (cid)) SELECT z.cid, CAST(p.i % least(5, p.n) AS INTEGER) AS block_id, CAST(sum(abs(v)) AS BIGINT) AS score FROM z JOIN perm p USING (cid, pos) GROUP BY z.cid, p.i % least(5, p.n)")
def heal_reslice(spark, d):
    """A lossy field decoded and sliced anew into a full set of chunks."""
    s = _slots(spark, d)
    return A.heal(s, s.select("cid", "block_id").distinct().where(S.survives(F.col("cid"), F.col("block_id"))), 5).select("cid", "block_id", "score")


@query(f"WITH {COARSE} SELECT cid, pos, CAST(round_even(round(coarse + (v - coarse) * ((cid + pos) % 5 / 4.0), 9), 0) AS BIGINT) AS healed FROM co")
def heal_honest(spark, d):
    """Values drawn back to the coarse track where confidence is low."""
    r = P.coarse(user_signal(spark, d).select("cid", "pos", "v"), 12)
    return r.select("cid", "pos", A.attenuate(F.col("v"), F.col("coarse"), (F.col("cid") + F.col("pos")) % 5 / 4.0).alias("healed"))


@query()
def heal_fixed_point(spark, d):
    """Healing repeated until it no longer changes the field: one row an iteration."""
    s = _slots(spark, d)
    return A.heal_fixed_point(s.select("cid", "pos", "v"), blocks=8, rounds=3, tol=1e-3)


STACK = "m AS (SELECT label, y * 8 + x AS pos, v, (cid * 31 + ((y * 8 + x) % 4) * 17) % 10 >= 3 AS got FROM cell JOIN embeddings ON vec_id = cid)"


@query(f"WITH {EMBEDDING_CELLS}, {STACK} SELECT label, CAST(pos AS INTEGER) AS pos, round(sum(v) FILTER (got) / count(*) FILTER (got), 6) AS stacked, count(*) FILTER (got) AS weight FROM m GROUP BY label, pos")
def stack_masked_mean(spark, d):
    """Exposures of one scene averaged where each has data."""
    return A.stack(_exposures(spark, d).select("label", "pos", "v", "got"), "label").select("label", "pos", F.round("mean", 6).alias("stacked"), "weight")


def _exposures(spark, d):
    c = embedding_cells(spark, d).join(load(spark, d, "embeddings").select(F.col("vec_id").alias("cid"), "label"), "cid")
    pos = F.col("y") * 8 + F.col("x")
    return c.select("label", "cid", "y", "x", pos.alias("pos"), "v", S.survives(F.col("cid"), pos % 4).alias("got"))


@query(f"WITH {EMBEDDING_CELLS} SELECT label, y, x, CAST(floor(round(avg(v), 9)) AS BIGINT) AS image, CAST(round_even(round(avg(v), 9), 0) AS BIGINT) AS audio FROM cell JOIN embeddings ON vec_id = cid GROUP BY label, y, x")
def stack_fallback_mean(spark, d):
    """Plain means: truncated for images, half-even for audio."""
    m = F.round(F.avg("v"), 9)
    return _exposures(spark, d).groupBy("label", "y", "x").agg(F.floor(m).alias("image"), F.rint(m).cast("long").alias("audio"))


@query(f"WITH {EMBEDDING_CELLS} SELECT cid, y + 2 AS y, x - 1 AS x, v FROM cell WHERE y + 2 < 8 AND x - 1 >= 0")
def shift_blocks(spark, d):
    """Whole-cell shift with zero fill: rows leave at the far edge."""
    return A.shift(embedding_cells(spark, d), {"y": (2, 8), "x": (-1, 8)})


@query(f"WITH {USER_SIGNAL} SELECT cid, pos + 3 AS pos, v FROM sig WHERE pos + 3 < n")
def shift_frames(spark, d):
    return A.shift(user_signal(spark, d), {"pos": (3, F.col("n"))}).select("cid", "pos", "v")


@query(f"WITH {EMBEDDING_CELLS}, b AS (SELECT cid, CAST(y // 3 AS INTEGER) AS y, CAST(x // 3 AS INTEGER) AS x, v FROM (SELECT c.cid, g.y, g.x, c.v FROM (SELECT unnest(range(0, 9)) AS y) gy JOIN (SELECT unnest(range(0, 9)) AS x) gx ON TRUE CROSS JOIN LATERAL (SELECT gy.y AS y, gx.x AS x) g JOIN cell c ON c.y = least(g.y, 7) AND c.x = least(g.x, 7))), m AS (SELECT cid, y, x, avg(v) AS a FROM b GROUP BY cid, y, x), z AS (SELECT cid, y, x, a - avg(a) OVER (PARTITION BY cid) AS a FROM m) SELECT cid, y, x, round(a * (0.5 - 0.5 * cos(pi() * y)) * (0.5 - 0.5 * cos(pi() * x)), 6) + 0.0 AS value FROM z")
def coarse_block_map(spark, d):
    """Edge-padded block means, demeaned and windowed: the map that shifts are estimated on."""
    return A.block_map(embedding_cells(spark, d), side=8, block=3)


@query("SELECT vec_id AS cid, CAST(2 AS INTEGER) AS dy, CAST(-1 AS INTEGER) AS dx FROM embeddings WHERE embedding IS NOT NULL")
def gauge_shift_images(spark, d):
    """Displacement between the first vector of each label and a copy of it moved by a known shift."""
    return A.shift_estimates(embedding_blocks(spark, d), by=(2, -1))


@query()
def gauge_shift_audio(spark, d):
    return A.shift_estimates_1d(P.signals(user_signal(spark, d).select("cid", "pos", "v")), by=5)


TORSION = """RECURSIVE u AS (SELECT user_id AS cid, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step, value / 100 AS a, event_id % 5 / 5.0 AS b FROM events),
f AS (SELECT cid, step, a AS a0, b AS b0, 0.05 * a AS x, 0.05 * b AS y, CAST(0 AS DOUBLE) AS k FROM u WHERE step = 1
UNION ALL SELECT u.cid, u.step, u.a, u.b, f.x + 0.05 * ((u.a - f.x) + f.k * f.y), f.y + 0.05 * ((u.b - f.y) - f.k * f.x), (1 - 0.001) * f.k + 0.01 * (u.a * f.b0 - f.a0 * u.b) FROM f JOIN u ON u.cid = f.cid AND u.step = f.step + 1)"""


@query(f"WITH {TORSION} SELECT cid, step, round(0.5 * ((x - a0) * (x - a0) + (y - b0) * (y - b0)), 6) AS energy, round(x * x + y * y, 6) AS norm_x, round(2 * k * k, 6) AS norm_k FROM f")
def torsion_state(spark, d):
    e = load(spark, d, "events")
    step = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
    u = e.select(F.col("user_id").alias("cid"), step.alias("step"), F.array(F.col("value") / 100, (F.col("event_id") % 5) / 5.0).alias("u"))
    return P.torsion(u, 2).select("cid", "step", *[F.round(c, 6).alias(c) for c in ("energy", "norm_x", "norm_k")])
