"""Fields derived from ordinary tables: signals, blocks, chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(ts: Column) -> Column:
    """Seconds since 1970 of a zoneless timestamp, whatever the session's zone."""
    return F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), ts) / 1e6


def user_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cid, pos, v, n): one integer signal a user, in order of time."""
    e = load(spark, sf_dir, "events").select(F.col("user_id").alias("cid"), "ts", "event_id", F.rint(F.col("value") * 100).cast("long").alias("v"))
    w = Window.partitionBy("cid").orderBy("ts", "event_id")
    n = F.count("*").over(Window.partitionBy("cid"))
    return e.select("cid", (F.row_number().over(w) - 1).cast("long").alias("pos"), "v", n.alias("n"))


def embedding_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cid, y, x, v): every vector as one block of 8 by 8 cells, v in 0..255."""
    e = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("cid"), F.posexplode("embedding").alias("i", "e"))
    v = F.rint(F.least(F.greatest(F.col("e").cast("double") * 32 + 128, F.lit(0.0)), F.lit(255.0))).cast("long")
    return e.select("cid", F.expr("i div 8").cast("int").alias("y"), (F.col("i") % 8).cast("int").alias("x"), v.alias("v"))


def embedding_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cid, block array<double>): the same values, row by row, without taking the vectors apart."""
    v = F.transform("embedding", lambda e: F.rint(F.least(F.greatest(e.cast("double") * 32 + 128, F.lit(0.0)), F.lit(255.0))))
    return load(spark, sf_dir, "embeddings").where("embedding IS NOT NULL").select(F.col("vec_id").alias("cid"), v.alias("block"))


#: SQL of the same fields.
USER_SIGNAL = """sig AS (SELECT user_id AS cid, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos,
  CAST(round_even(value * 100, 0) AS BIGINT) AS v, count(*) OVER (PARTITION BY user_id) AS n FROM events)"""
EMBEDDING_CELLS = """cell AS (SELECT cid, CAST(i // 8 AS INTEGER) AS y, CAST(i % 8 AS INTEGER) AS x,
  CAST(round_even(least(greatest(CAST(e AS DOUBLE) * 32 + 128, 0.0), 255.0), 0) AS BIGINT) AS v
  FROM (SELECT vec_id AS cid, unnest(embedding) AS e, unnest(range(0, len(embedding))) AS i FROM embeddings))"""
