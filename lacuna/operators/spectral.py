"""Block and frame transforms over tables, in Arrow kernels that take whole batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lacuna.functions import transforms as T


def _matrix(column, width: int, dtype=np.float64) -> np.ndarray:
    flat = column.flatten() if isinstance(column, pa.ListArray) else column.combine_chunks().flatten()
    return np.asarray(flat.to_numpy(zero_copy_only=False), dtype).reshape(-1, width)


def _lists(m: np.ndarray) -> pa.ListArray:
    return pa.FixedSizeListArray.from_arrays(pa.array(m.ravel()), m.shape[1]).cast(pa.list_(pa.array(m.ravel()[:0]).type))


def blocks(cells: DataFrame) -> DataFrame:
    """(cid, block array<double>) from (cid, y, x, v)."""
    one = F.array_sort(F.collect_list(F.struct((F.col("y") * 8 + F.col("x")).alias("i"), F.col("v").cast("double").alias("v"))))
    return cells.groupBy("cid").agg(F.transform(one, lambda s: s["v"]).alias("block"))


def encode_blocks(df: DataFrame, quality: int = 50, block: int = 8) -> DataFrame:
    """(cid, coefs array<long>, clipped) by zigzag."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                c, clipped = T.block_coefficients(_matrix(b.column(1), block * block).reshape(-1, block, block), quality)
                yield pa.RecordBatch.from_arrays([b.column(0), _lists(c), pa.array(clipped)], names=["cid", "coefs", "clipped"])

    return df.select("cid", "block").mapInArrow(run, "cid long, coefs array<long>, clipped boolean")


def render(df: DataFrame, quality: int = 50, block: int = 8, rounding: str = "truncate") -> DataFrame:
    """(cid, block array<double>) from coefficients: clipped to 0..255, then truncated or rounded."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                p = np.clip(np.round(T.render_blocks(_matrix(b.column(1), block * block), block, quality), 9), 0, 255)
                p = np.floor(p) if rounding == "truncate" else np.rint(p)
                yield pa.RecordBatch.from_arrays([b.column(0), _lists(p.reshape(len(p), -1))], names=["cid", "block"])

    return df.select("cid", "coefs").mapInArrow(run, "cid long, block array<double>")


def explode_coefs(df: DataFrame) -> DataFrame:
    return df.select("cid", F.posexplode("coefs").alias("k", "q"))


def signals(sig: DataFrame) -> DataFrame:
    """(cid, x array<double>) from (cid, pos, v)."""
    one = F.array_sort(F.collect_list(F.struct("pos", F.col("v").cast("double").alias("v"))))
    return sig.groupBy("cid").agg(F.transform(one, lambda s: s["v"]).alias("x"))


def spectrum(df: DataFrame, n_fft: int, hop: int) -> DataFrame:
    """(cid, frame, bin, re, im)."""

    def run(batches):
        for b in batches:
            cid, frame, bins, re, im = [], [], [], [], []
            for c, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                s = T.stft(np.array(x), n_fft, hop)
                m, k = s.shape
                cid.append(np.full(m * k, c))
                frame.append(np.repeat(np.arange(m), k))
                bins.append(np.tile(np.arange(k), m))
                re.append(s.real.ravel())
                im.append(s.imag.ravel())
            if cid:
                cat = [np.concatenate(v) for v in (cid, frame, bins, re, im)]
                yield pa.RecordBatch.from_arrays([pa.array(cat[0], pa.int64()), *[pa.array(v.astype(np.int32)) for v in cat[1:3]], *map(pa.array, cat[3:])], names=["cid", "frame", "bin", "re", "im"])

    return df.mapInArrow(run, "cid long, frame int, bin int, re double, im double")


def coarse(sig: DataFrame, most: int) -> DataFrame:
    """(cid, pos, v, coarse, residual, clipped): the stretched coarse track and the 16-bit residual, as column arithmetic.

    Samples kept: trunc(linspace(0, n - 1, L)); stretched by linspace(0, L - 1, n), half-even.
    """
    s = sig.select("cid", "pos", "v", F.count("*").over(Window.partitionBy("cid")).cast("long").alias("n"))
    s = s.withColumn("L", F.greatest(F.lit(1), F.least("n", F.lit(most))).cast("long"))
    at = F.when(F.col("n") > 1, F.col("pos") * ((F.col("L") - 1) / (F.col("n") - 1))).otherwise(0.0)
    s = s.withColumn("at", F.round(at, 9)).withColumn("lo", F.floor("at"))
    s = s.withColumn("hi", F.least(F.col("lo") + 1, F.col("L") - 1))
    picked = lambda j: F.when(F.col("L") > 1, F.floor(F.round(j * ((F.col("n") - 1) / (F.col("L") - 1)), 9))).otherwise(0).cast("long")
    # the field's kept samples, at most ``most`` of them, as one array beside each of its rows
    j = F.when(F.col("n") > 1, F.col("pos") * ((F.col("L") - 1) / (F.col("n") - 1))).otherwise(0.0)
    near = [F.least(F.floor(j) + i, F.col("L") - 1) for i in (0, 1)]
    kept = F.when((picked(near[0]) == F.col("pos")) | (picked(near[1]) == F.col("pos")), F.struct("pos", "v"))
    s = s.withColumn("track", F.transform(F.array_sort(F.collect_list(kept).over(Window.partitionBy("cid"))), lambda x: x["v"]))
    t = F.col("at") - F.col("lo")
    c = F.rint(F.round(F.get("track", F.col("lo").cast("int")) * (1 - t) + F.get("track", F.col("hi").cast("int")) * t, 9)).cast("long")
    r = F.col("v") - c
    return s.select("cid", "pos", "v", c.alias("coarse"), F.greatest(F.least(r, F.lit(32767)), F.lit(-32768)).cast("long").alias("residual"), (F.abs(r) > 32767).alias("clipped"))


def torsion(df: DataFrame, dim: int, dt: float = 0.05, rate: float = 0.01, decay: float = 0.001) -> DataFrame:
    """Ordered fold of inputs (cid, step, u array) into (cid, step, energy, norm_x, norm_k).

    x moves by dt ((u - x) + K x) with the K before; then K decays and learns the commutator of the last two inputs and is
    made antisymmetric; the first input is only stored.
    """

    def fold(t: pa.Table) -> pa.Table:
        t = t.sort_by("step")
        x, k, last = np.zeros(dim), np.zeros((dim, dim)), None
        energy, nx, nk = [], [], []
        for u in t["u"].to_pylist():
            u = np.array(u, float)
            x = x + dt * ((u - x) + k @ x)
            if last is not None:
                k = (1 - decay) * k + rate * (np.outer(u, last) - np.outer(last, u))
                k = 0.5 * (k - k.T)
            last = u
            energy.append(0.5 * float(((x - u) ** 2).sum()))
            nx.append(float(x @ x))
            nk.append(float((k * k).sum()))
        return pa.table({"cid": t["cid"], "step": t["step"], "energy": energy, "norm_x": nx, "norm_k": nk})

    return df.select("cid", "step", "u").groupBy("cid").applyInArrow(fold, "cid long, step long, energy double, norm_x double, norm_k double")
