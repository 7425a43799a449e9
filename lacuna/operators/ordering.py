"""Order, limits, schedules and set operations over chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_gain(chunks: DataFrame, limit: int | None = None, manifest: DataFrame | None = None) -> DataFrame:
    """Chunks with their rank (from 1): by score, missing ones counting as 0.0, ties by id; a usable manifest
    (cid, block_id, place) overrides scores, and chunks that it does not name are not read."""
    if manifest is not None:
        chunks = chunks.join(manifest.select("cid", "block_id", "place"), ["cid", "block_id"])
        order = [F.col("place"), F.col("block_id")]
    else:
        order = [F.coalesce(F.col("score").cast("double"), F.lit(0.0)).desc(), F.col("block_id")]
    out = chunks.withColumn("rank", F.row_number().over(Window.partitionBy("cid").orderBy(*order)))
    return out if limit is None else out.where(F.col("rank") <= max(1, limit))


def coded_ids(chunks: DataFrame, n: int) -> DataFrame:
    """Transport ids of n recovery chunks of each field."""
    return chunks.select("cid").distinct().select("cid", F.explode(F.sequence(F.lit(1_000_000).cast("long"), F.lit(1_000_000 + n - 1).cast("long"))).alias("chunk_id"))


def capped(ranked: DataFrame, coded: DataFrame, limit: int, before: bool) -> DataFrame:
    """Data chunks by rank, then recovery chunks; the limit counts before or after those are appended."""
    data = ranked.where(F.col("rank") <= limit) if before else ranked
    both = data.select("cid", F.col("block_id").cast("long").alias("chunk_id"), F.lit(0).alias("part"), F.col("rank").cast("long").alias("o"))
    both = both.union(coded.select("cid", "chunk_id", F.lit(1), "chunk_id"))
    out = both.withColumn("place", F.row_number().over(Window.partitionBy("cid").orderBy("part", "o")))
    return (out if before else out.where(F.col("place") <= limit)).select("cid", "chunk_id", "place")


def schedule(refs: DataFrame, order: str, limit: int | None, keep: list[str] | None = None) -> DataFrame:
    """Sending places of (stream, frame, chunk_id, score): frames in turn by rank, or frame after frame."""
    rank = F.row_number().over(Window.partitionBy("stream", "frame").orderBy(F.desc("score"), "chunk_id"))
    r = refs.withColumn("__r", rank)
    if limit is not None:
        r = r.where(F.col("__r") <= max(1, limit))
    keys = ["__r", "frame"] if order == "round_robin" else ["frame", "__r"]
    return r.select("stream", "frame", "chunk_id", *(keep or []), F.row_number().over(Window.partitionBy("stream").orderBy(*keys)).alias("place"))


def merge_first(df: DataFrame, key: str, source: str) -> DataFrame:
    """One row a key, from the first source that has it, and how many others were dropped."""
    return df.groupBy(key).agg(F.min(source).alias(source), (F.count("*") - 1).alias("dropped"))


def random_subset(chunks: DataFrame, k: int, seed: int) -> DataFrame:
    """k chunks of each field in an order that a hash of seed and ids gives."""
    draw = F.md5(F.concat(F.lit(f"{seed}:"), F.col("cid").cast("string"), F.lit(":"), F.col("block_id").cast("string")))
    return chunks.withColumn("__k", F.row_number().over(Window.partitionBy("cid").orderBy(draw, "block_id"))).where(F.col("__k") <= k).drop("__k")


def k_grid(blocks: Column) -> Column:
    one = F.lit(1)
    return F.array_distinct(F.array(one, F.greatest(one, F.floor(blocks / 4).cast("int")), F.greatest(one, F.floor(blocks / 2).cast("int")), blocks))


def inventory(ids: Column, most: int = 64) -> Column:
    """Aggregate: the first ids of the sorted set, those above 16 bits left out."""
    return F.slice(F.array_sort(F.collect_set(F.when(ids <= 65535, ids))), 1, most)


def chunk_weight(gain: Column, missing_peers: Column) -> Column:
    return gain * (1 + missing_peers)


def content_weight(age: Column, bias: float) -> Column:
    return F.lit(1.0) / (1 + F.lit(bias) * age)


def weighted_choice(df: DataFrame, group: str, weight: str, seed: int) -> DataFrame:
    """One row a group: the least of -log(u) / weight over uniform u is drawn in proportion to weight; u is a hash of the seed and the row."""
    names = [F.col(c).cast("string") for c in df.columns]
    u = (F.pmod(F.xxhash64(F.lit(seed), *names), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    key = -F.log(u) / F.col(weight)
    return df.withColumn("__e", key).withColumn("__k", F.row_number().over(Window.partitionBy(group).orderBy("__e"))).where("__k = 1").drop("__e", "__k")


def manifest(chunks: DataFrame) -> DataFrame:
    """(cid, manifest): JSON entries in order of score."""
    entry = F.struct((-F.col("score")).alias("o"), F.col("block_id").alias("b"), F.struct("file", "block_id", "score").alias("e"))
    return chunks.groupBy("cid").agg(F.to_json(F.transform(F.array_sort(F.collect_list(entry)), lambda s: s["e"])).alias("manifest"))


def read_manifest(df: DataFrame) -> DataFrame:
    parsed = F.from_json("manifest", "array<struct<file string, block_id int, score double>>")
    return df.select("cid", F.posexplode(parsed).alias("place", "e")).select("cid", "place", F.col("e.file").alias("file"), F.col("e.block_id").alias("block_id"), F.col("e.score").alias("score"))


def parse_score(text: Column) -> Column:
    return F.trim(text).try_cast("double")
