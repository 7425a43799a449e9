"""Helpers of the training-data operators: tables, Arrow kernels, size-checked broadcasts, connected components."""

from __future__ import annotations

import functools
import gc
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.sources.persist import drop, stored

#: A table of up to so many rows of a few numbers each (at most some 40 MB) may be broadcast; a larger one is shuffled.
BROADCAST_ROWS = 1 << 20
#: What a Python worker is handed at once.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_arrow(df: DataFrame, kernel, schema) -> DataFrame:
    """mapInArrow with batches that are small in rows and bytes, so that a worker's memory follows neither table nor long texts.

    The session's own settings hold where they are smaller.
    """
    conf = df.sparkSession.conf
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        now = re.match(r"\d+", conf.get(f"spark.sql.execution.arrow.{name}"))
        if not now or not 0 < int(now[0]) <= most:
            conf.set(f"spark.sql.execution.arrow.{name}", str(most))
    return df.mapInArrow(kernel, schema)


def small(df: DataFrame) -> DataFrame:
    """``df`` marked for a broadcast if it has at most BROADCAST_ROWS rows, else as it is, to be joined by a shuffle."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def release(spark: SparkSession) -> None:
    """Have Spark's cleaner remove the shuffle files of queries that are done, which it does when the driver's garbage goes."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", salts: int = 4, spread: str | None = None) -> DataFrame:
    """Equi-join in which a hot key of ``left`` is dealt to ``salts`` tasks at least.

    ``right`` has at most one row a key and is copied once per salt, so both sides are shuffled for the join alone and the
    adaptive planner can split a partition that is still skewed.  ``spread`` names the column of ``left`` whose hash
    gives the salt (all columns if None).
    """
    base = F.xxhash64(F.col(spread)) if spread else F.xxhash64(*[F.col(c) for c in left.columns])
    a = left.withColumn("__salt", F.pmod(base, F.lit(salts)).cast("int"))
    b = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return a.join(b, [*keys, "__salt"], how).drop("__salt")


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the least id that each end of ``edges(a, b)`` (long) can reach.

    Alternates large-star and small-star: each node's neighbours are hung on its least neighbour, so every round is a
    linear number of rows and chains shorten geometrically, until a round changes nothing.  Each round is a written
    table; minima are aggregated before they are shuffled, and the rows of a hub are dealt by salt.  Nodes without an edge do not appear.
    """

    def least(e: DataFrame) -> DataFrame:
        return e.groupBy("u").agg(F.min("v").alias("m"))

    def large(e: DataFrame) -> DataFrame:
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        m = least(both).select("u", F.least("m", "u").alias("m"))
        return salted_join(both.where("v > u"), m, ["u"], spread="v").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()

    def smaller(e: DataFrame) -> DataFrame:
        down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v")
        m = least(down)
        hung = salted_join(down, m, ["u"], spread="v").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        return hung.union(m.select("u", F.col("m").alias("v"))).distinct()

    def digest(e: DataFrame):
        r = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        return r["n"], r["s"]

    now = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct())
    before, after = None, digest(now)
    while after != before and after[0]:
        turned = stored(smaller(large(now)))
        drop(now)
        now, before, after = turned, after, digest(turned)
    tree = now.select(F.greatest("u", "v").alias("id"), F.least("u", "v").alias("component"))
    out = stored(tree.groupBy("id").agg(F.min("component").alias("component")).unionByName(tree.select(F.col("component").alias("id"), "component").distinct()))
    drop(now)
    return out


@functools.lru_cache(maxsize=4)
def tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)
