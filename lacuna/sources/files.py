"""Chunk folders and files: readers over binaryFile and writers whose target all executors must share."""

from __future__ import annotations

import os

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.sources import media


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """(cid, name, data, score) of <path>/<cid>/{chunk,recovery}_*.*; the folder's name is the cid."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    f = f.withColumn("name", name).withColumn("cid", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).try_cast("long"))
    meta = f.where(F.col("name").endswith(".meta")).select("cid", F.regexp_replace("name", r"\.meta$", "").alias("name"), F.decode("content", "UTF-8").try_cast("double").alias("score"))
    return f.where(F.col("name").rlike(r"^(chunk|recovery)_\d+\.\w+$") & ~F.col("name").endswith(".meta")).select("cid", "name", F.col("content").alias("data")).join(meta, ["cid", "name"], "left")


def write_chunks(chunks: DataFrame, path: str) -> int:
    """Chunks as files with a score beside each; old chunks of a written field are removed first."""

    def put(batches):
        for b in batches:
            for cid, name, data, score in zip(*[c.to_pylist() for c in b.columns], strict=True):
                os.makedirs(f"{path}/{cid}", exist_ok=True)
                with open(f"{path}/{cid}/{name}", "wb") as f:
                    f.write(data)
                with open(f"{path}/{cid}/{name}.meta", "w") as f:
                    f.write(repr(float(score or 0.0)))
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], names=["n"])

    for r in chunks.select("cid").distinct().toLocalIterator():
        folder = f"{path}/{r.cid}"
        for old in os.listdir(folder) if os.path.isdir(folder) else ():
            if old.startswith(("chunk_", "recovery_")):
                os.remove(f"{folder}/{old}")
    return chunks.select("cid", "name", "data", "score").mapInArrow(put, "n long").agg(F.sum("n")).first()[0] or 0


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """(path, h, w, pixels) of PNG files."""

    def run(batches):
        for b in batches:
            a = [media.read_png(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.shape[0] for x in a], pa.int32()), pa.array([x.shape[1] for x in a], pa.int32()), pa.array([x.tobytes() for x in a], pa.binary())], names=["path", "h", "w", "pixels"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, h int, w int, pixels binary")


def read_sounds(spark: SparkSession, path: str) -> DataFrame:
    """(path, rate, channels, samples) of WAVE files, interleaved."""

    def run(batches):
        for b in batches:
            a = [media.read_wav(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r for _, r in a], pa.int32()), pa.array([x.shape[1] for x, _ in a], pa.int32()), pa.array([x.ravel().tolist() for x, _ in a], pa.list_(pa.int16()))], names=["path", "rate", "channels", "samples"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, rate int, channels int, samples array<short>")
