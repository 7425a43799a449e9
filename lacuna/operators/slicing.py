"""Slicing fields into interchangeable chunks, and the masked decoding of any subset of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacuna.functions.golden import golden_step, inverse


def geometry(signal: DataFrame) -> DataFrame:
    """(cid, n, step, inv): per field; the step is computed once per distinct length."""
    fields = signal.groupBy("cid").agg(F.count("*").alias("n"))
    steps = fields.select("n").distinct().withColumn("step", golden_step(F.col("n"))).withColumn("inv", inverse(F.col("step"), F.col("n")))
    return fields.join(steps, "n").select("cid", "n", "step", "inv")


def slots(signal: DataFrame, blocks: int, stride: bool = False) -> DataFrame:
    """``signal(cid, pos, v)`` with block_id and slice_idx: a projection, no join with a permutation.

    ``stride`` is the plain order of the first format version.  More blocks than values become as many as values.
    """
    g = geometry(signal).select("cid", F.col("n").alias("__n"), "inv")
    x = signal.join(g, "cid")
    i = F.col("pos") if stride else F.when(F.col("__n") <= 1, F.lit(0)).otherwise((F.col("pos") * F.col("inv")) % F.col("__n"))
    b = F.greatest(F.lit(1), F.least(F.lit(blocks), F.col("__n")))
    return x.withColumn("__i", i).withColumn("__b", b).select(*signal.columns, (F.col("__i") % F.col("__b")).cast("int").alias("block_id"), F.expr("__i div __b").cast("int").alias("slice_idx"), F.col("__b").cast("int").alias("blocks"))


def chunks(slotted: DataFrame) -> DataFrame:
    """(cid, block_id, blocks, vals, score, energy): packed chunks; score is L1, energy the sum of squares."""
    packed = F.transform(F.array_sort(F.collect_list(F.struct("slice_idx", "v"))), lambda s: s["v"])
    return slotted.groupBy("cid", "block_id").agg(F.first("blocks").alias("blocks"), packed.alias("vals"), F.sum(F.abs("v")).alias("score"), F.sum(F.col("v") * F.col("v")).alias("energy"))


def survives(cid: Column, block: Column) -> Column:
    """The deterministic loss that stands for an unreliable link."""
    return (cid * 31 + block * 17) % 10 >= 3


def best(chunked: DataFrame, k: int, by: str = "score") -> DataFrame:
    """The k chunks of each field with the largest gain (ties: least id); at least one."""
    w = Window.partitionBy("cid").orderBy(F.desc(by), "block_id")
    return chunked.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= max(1, k))


def decode(slotted: DataFrame, received: DataFrame) -> DataFrame:
    """All positions with the value received, zero and present=false where the chunk is missing."""
    got = received.select("cid", "block_id", F.lit(True).alias("__got")).distinct()
    return slotted.join(got, ["cid", "block_id"], "left").select("cid", "pos", "v", F.when(F.col("__got"), F.col("v")).otherwise(0).alias("decoded"), F.coalesce("__got", F.lit(False)).alias("present"))


def block_count(residual_bytes: Column, coarse: Column, target_kb: Column) -> Column:
    """Chunks of about target_kb kilobytes, 96 bytes and the coarse part each being overhead."""
    target = F.greatest(F.lit(256), target_kb * 1024)
    over = coarse + 96
    return F.when(target <= over + 16, 1).otherwise(F.greatest(F.lit(1), F.ceil(residual_bytes / F.greatest(target - over, F.lit(1))))).cast("long")


def block_count_bytes(residual_bytes: Column, coarse: Column, most: Column) -> Column:
    """The same for a limit in bytes, with an overhead of 30."""
    target, over = F.greatest(F.lit(256), most), coarse + 30
    return F.when(target <= over + 16, 1).otherwise(F.greatest(F.lit(1), F.ceil(residual_bytes / F.greatest(target - over, F.lit(1))))).cast("long")


def clamp_blocks(blocks: Column, n: Column) -> Column:
    return F.greatest(F.lit(1), F.least(blocks, n))


def slice_length(n: Column, blocks: Column, block: Column, width: int = 2) -> Column:
    """Bytes of a block's slice of n values."""
    return F.when(block >= n, 0).otherwise(F.floor((n - block + blocks - 1) / blocks) * width).cast("long")
