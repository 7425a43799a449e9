"""Field algebra: confidence, healing, stacking, shifts and error measures."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacuna.functions import transforms as T
from lacuna.operators import slicing as S
from lacuna.sources.persist import stored


def frame_count(n: Column, n_fft: int, hop: int) -> Column:
    return F.when(n <= 0, 0).otherwise(F.greatest(F.lit(1), F.ceil((n - n_fft) / hop) + 1)).cast("long")


def audio_step(bin_: Column, bins: int, quality: Column, n_fft: int) -> Column:
    return F.greatest(F.lit(1.0), (120 - quality) / 20.0) / n_fft * (1 + bin_ / float(max(1, bins - 1)))


def block_error(a: DataFrame, b: DataFrame) -> DataFrame:
    """(cid, mse) between two tables of (cid, block)."""
    x = a.select("cid", F.col("block").alias("p")).join(b.select("cid", F.col("block").alias("q")), "cid")
    total = F.aggregate(F.zip_with("p", "q", lambda u, v: (u - v) * (u - v)), F.lit(0.0), lambda s, v: s + v)
    return x.select("cid", F.round(total / F.size("p"), 6).alias("mse"))


def weighted_presence(df: DataFrame, keys: list[str]) -> DataFrame:
    """Confidence in 0..1: the present share of the weight ``w``."""
    return df.groupBy(*keys).agg(F.round(F.least(F.lit(1.0), F.sum(F.when(F.col("present"), F.col("w")).otherwise(0.0)) / F.sum("w")), 9).alias("confidence"))


def tile_confidence(df: DataFrame, side: int = 8) -> DataFrame:
    tile = [F.expr(f"y div {side}").alias("block_y"), F.expr(f"x div {side}").alias("block_x")]
    return df.groupBy("cid", *tile).agg((F.count_if("present") / float(side * side)).alias("confidence"))


def envelope(sig: DataFrame, n_fft: int, hop: int) -> DataFrame:
    """(cid, frame, envelope): mean magnitude of each frame's samples, demeaned and windowed.

    A sample is sent to the few frames that cover it.
    """
    s = sig.withColumn("m", frame_count(F.count("*").over(Window.partitionBy("cid")), n_fft, hop))
    first = F.greatest(F.lit(0), F.ceil((F.col("pos") - n_fft + 1) / hop)).cast("int")
    last = F.least(F.col("m") - 1, F.floor(F.col("pos") / hop)).cast("int")
    s = s.where(first <= last).select("cid", "m", "v", F.explode(F.sequence(first, last)).alias("frame"))
    e = s.groupBy("cid", "frame").agg(F.first("m").alias("m"), (F.sum(F.abs("v")) / float(n_fft)).alias("e"))
    w = F.when(F.col("m") > 1, 0.5 - 0.5 * F.cos(2 * np.pi * F.col("frame") / (F.col("m") - 1))).otherwise(1.0)
    return e.withColumn("e", F.col("e") - F.avg("e").over(Window.partitionBy("cid"))).select("cid", "frame", (F.round(F.col("e") * w, 6) + 0.0).alias("envelope"))


def curve(samples: DataFrame, frames: DataFrame) -> DataFrame:
    """Frame values c interpolated at linspace(0, n - 1, m) to all samples."""
    x = F.when(F.col("m") > 1, F.col("pos") * ((F.col("m") - 1) / (F.col("n") - 1))).otherwise(0.0)
    s = samples.withColumn("x", x).withColumn("frame", F.least(F.floor(F.round("x", 9)), F.col("m") - 1))
    after = F.lead("c").over(Window.partitionBy("cid").orderBy("frame"))
    f = frames.withColumn("next", F.coalesce(after, F.col("c")))
    return s.join(f, ["cid", "frame"]).select("cid", "pos", F.round(F.col("c") + (F.col("next") - F.col("c")) * (F.col("x") - F.col("frame")), 9).alias("confidence"))


def attenuate(value: Column, coarse: Column, confidence: Column) -> Column:
    return F.rint(F.round(coarse + (value - coarse) * confidence, 9)).cast("long")


def heal(slotted: DataFrame, received: DataFrame, blocks: int) -> DataFrame:
    """Decode what is there and slice it anew: a full set of chunks of the best-so-far field."""
    d = S.decode(slotted, received).select("cid", "pos", F.col("decoded").alias("v"))
    return S.chunks(S.slots(d, blocks))


def heal_fixed_point(sig: DataFrame, blocks: int, rounds: int, tol: float) -> DataFrame:
    """(iteration, delta, drift): repeated healing of a lossy field.

    Stops when the change grows or when it improves by less than ``tol`` (from the second change on).  Each round is
    a new table of the same size; the driver reads one row of it.
    """
    spark = sig.sparkSession
    first = S.slots(sig, blocks)
    first = stored(S.decode(first, first.select("cid", "block_id").distinct().where(S.survives(F.col("cid"), F.col("block_id")))).select("cid", "pos", F.col("decoded").alias("v")))
    now, rows, last = first, [], None
    for i in range(rounds):
        s = S.slots(now, blocks)
        healed = stored(S.decode(s, s.select("cid", "block_id").distinct()).select("cid", "pos", F.col("decoded").alias("v")))
        error = lambda a: healed.join(a.withColumnRenamed("v", "w"), ["cid", "pos"]).agg(F.avg((F.col("v") - F.col("w")) * (F.col("v") - F.col("w")))).first()[0]  # noqa: B023, E731
        delta, drift = error(now), error(first)
        rows.append((i + 1, float(delta), float(drift)))
        if last is not None and (delta > last + 1e-9 or last - delta < tol):
            break
        last, now = delta, healed
    return spark.createDataFrame(rows, "iteration int, delta double, drift double")


def stack(df: DataFrame, key: str) -> DataFrame:
    """(key, pos, mean, weight) of the present values."""
    return df.groupBy(key, "pos").agg((F.sum(F.when(F.col("got"), F.col("v"))) / F.count_if("got")).alias("mean"), F.count_if("got").alias("weight"))


def shift(df: DataFrame, by: dict) -> DataFrame:
    """Key arithmetic and a range filter: coordinate c moves by d inside 0..size - 1."""
    for c, (d, size) in by.items():
        df = df.withColumn(c, F.col(c) + d).where((F.col(c) >= 0) & (F.col(c) < size))
    return df


def block_map(cells: DataFrame, side: int, block: int) -> DataFrame:
    """Block means of an edge-padded square, demeaned and windowed by Hann along both axes."""
    m = -(-side // block)
    pad = m * block - side
    times = lambda c: F.when(F.col(c) == side - 1, pad + 1).otherwise(1)
    c = cells
    for axis in ("y", "x"):
        c = c.withColumn(axis, F.explode(F.sequence(F.col(axis), F.col(axis) + times(axis) - 1)))
    e = c.groupBy("cid", F.expr(f"cast(y div {block} as int)").alias("y"), F.expr(f"cast(x div {block} as int)").alias("x")).agg(F.avg("v").alias("a"))
    w = lambda c: 0.5 - 0.5 * F.cos(2 * np.pi * F.col(c) / (m - 1))
    return e.withColumn("a", F.col("a") - F.avg("a").over(Window.partitionBy("cid"))).select("cid", "y", "x", (F.round(F.col("a") * w("y") * w("x"), 6) + 0.0).alias("value"))


def audio_roundtrip(signals: DataFrame, n_fft: int, hop: int) -> DataFrame:
    """(cid, pos, x): the signals from their spectra, to six digits."""

    def run(batches):
        for b in batches:
            for cid, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                back = np.round(T.istft(T.stft(np.array(x), n_fft, hop), len(x), n_fft, hop), 6) + 0.0
                yield pa.RecordBatch.from_arrays([pa.array([cid] * len(back), pa.int64()), pa.array(np.arange(len(back))), pa.array(back)], names=["cid", "pos", "x"])

    return signals.mapInArrow(run, "cid long, pos long, x double")


def shift_estimates(blocks: DataFrame, by: tuple[int, int]) -> DataFrame:
    def run(batches):
        for b in batches:
            dy, dx = [], []
            for v in b.column(1).to_pylist():
                a = np.array(v).reshape(8, 8)
                y, x = T.gauge_shift(np.roll(a, by, (0, 1)), a)
                dy.append(y)
                dx.append(x)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(dy, pa.int32()), pa.array(dx, pa.int32())], names=["cid", "dy", "dx"])

    return blocks.mapInArrow(run, "cid long, dy int, dx int")


def shift_estimates_1d(signals: DataFrame, by: int) -> DataFrame:
    def run(batches):
        for b in batches:
            out = [T.gauge_shift(T.shifted(np.array(x), by), np.array(x), window=True)[0] for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.int32())], names=["cid", "shift"])

    return signals.mapInArrow(run, "cid long, shift int")
