"""A chunk store over a partitioned table, and the objects that use it."""

from __future__ import annotations

import os
import time

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.functions import bytes as B
from lacuna.operators import codec as C
from lacuna.operators import transport as T
from lacuna.sources import media
from lacuna.sources.persist import drop, remove, stored

COLUMNS = ["chunk_id", "name", "data", "score", "seen", "cid"]
SCHEMA = "chunk_id long, name string, data binary, score double, seen double, cid string"


class ChunkStore:
    """Chunks by content (hex) and id; the last write of an id wins.

    Contents are partitions: a write replaces those it touches and no other, after their new rows are written aside.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def table(self) -> DataFrame:
        try:
            return self.spark.read.schema(SCHEMA).parquet(self.path)
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return self.spark.createDataFrame([], SCHEMA)
            raise

    def put(self, chunks: DataFrame) -> None:
        """Add chunks(cid, chunk_id, name, data, score); those already there are replaced."""
        arriving = stored(chunks.withColumn("seen", F.lit(time.time())).select(*COLUMNS))
        touched = self.table().join(arriving.select("cid").distinct(), "cid", "left_semi").select(*COLUMNS)
        merged = stored(T.upsert(touched, arriving, ["cid", "chunk_id"], F.col("seen")).select(*COLUMNS))
        merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("cid").parquet(self.path)
        drop(arriving, merged)

    def chunks(self, cid: str) -> DataFrame:
        return self.table().where(F.col("cid") == cid).orderBy("name")

    def count(self, cid: str) -> int:
        return self.chunks(cid).count()

    def contents(self) -> DataFrame:
        return self.table().select("cid").distinct()

    def last_seen(self, cid: str) -> float:
        return self.chunks(cid).agg(F.max("seen")).first()[0] or 0.0

    def purge(self, ttl: float, now: float | None = None) -> None:
        """Drop the contents whose last chunk is older than ``ttl`` seconds, partition by partition."""
        limit = (now if now is not None else time.time()) - ttl
        for r in T.last_seen(self.table()).where(F.col("last") < limit).select("cid").toLocalIterator():
            self.drop(r["cid"])

    def drop(self, cid: str) -> None:
        remove(self.spark, f"{self.path}/cid={cid}")


def save_field(f: C.Field, path: str) -> str:
    """A field's best state and, beside it, its confidence as local files; the path of the latter."""
    with open(path, "wb") as out:
        out.write(media.write_png(C.render(f)) if f.kind == "image" else media.write_wav(C.render(f), f.rate))
    beside = f"{os.path.splitext(path)[0]}_confidence.{'png' if f.kind == 'image' else 'npy'}"
    seen = C.confidence(f)
    with open(beside, "wb") as out:
        if f.kind == "image":
            out.write(media.write_png(np.clip(seen * 255.0, 0, 255).astype(np.uint8)))
        else:
            np.save(out, seen.astype(np.float32))
    return beside


class FieldView:
    """One content of a store: coverage, best reconstruction, healing; chunks are read and decoded on an executor."""

    def __init__(self, store: ChunkStore, cid: str):
        self.store, self.cid = store, cid

    def _chunks(self) -> DataFrame:
        return self.store.chunks(self.cid).select(F.lit(0).cast("long").alias("cid"), "name", "data", "score")

    def coverage(self) -> dict:
        """Chunks there are and should be, and the layout that the first readable header gives."""
        x = self._chunks().where(~F.col("name").startswith("recovery_"))
        kind = F.when(F.substring("data", 1, 4) == B.lit_bytes(B.IMAGE), "image").when(F.substring("data", 1, 4) == B.lit_bytes(B.AUDIO), "audio")
        total = F.when(kind == "image", B.from_be(F.col("data"), 14, 4)).otherwise(B.from_be(F.col("data"), 16, 4))
        first = x.where(kind.isNotNull()).orderBy("name").select(kind.alias("layout"), total.alias("total")).first()
        return {"present": self.store.count(self.cid), "total": first["total"] if first else 0, "layout": first["layout"] if first else "unknown"}

    def best(self, most: int | None = None, by_gain: bool = False, use_recovery: bool | None = None):
        """(values, confidence), or None if nothing decodes."""
        row = C.decode_fields(self._chunks(), most, by_gain, use_recovery).first()
        if row is None:
            return None
        values = np.frombuffer(row["values"], np.uint8 if row["kind"] == "image" else np.int16).reshape(row["shape"])
        return values, np.array(row["confidence"], np.float32)

    def save(self, path: str, **options) -> str | None:
        """Write the best state to a local file, PNG or WAVE, and its confidence beside it, as a grey PNG of the block map
        or a .npy curve; the latter's path, or None if nothing decodes.  ``options`` are those of ``best``."""
        f = C.gather([(r["name"], bytes(r["data"]), r["score"]) for r in self._chunks().toLocalIterator()], **options)
        if f is None:
            return None
        return save_field(f, path)

    def heal(self, **options) -> list[C.Chunk]:
        return [(r["name"], bytes(r["data"]), r["score"]) for r in C.heal_fields(self._chunks(), **options).orderBy("name").toLocalIterator()]


class FrameWindow:
    """Numbered frames of a stream and the contents that carry them."""

    def __init__(self, stream: str, frames: DataFrame):
        """``frames(frame, chunk_id, score)``."""
        self.stream, self.frames = stream, frames.withColumn("stream", F.lit(stream))

    def refs(self, order: str = "round_robin", limit: int | None = None) -> DataFrame:
        from lacuna.operators.ordering import schedule

        return schedule(self.frames, order, limit)

    def content_ids(self) -> DataFrame:
        from lacuna.functions.bytes import frame_content_id

        return self.frames.select("frame").distinct().withColumn("content_id", frame_content_id(F.lit(self.stream), F.col("frame")))

    def receive(self, chunks: DataFrame) -> DataFrame:
        """Assembled chunks(content_id, ...) with the frame they belong to; unknown contents keep a null frame."""
        return chunks.join(self.content_ids(), "content_id", "left")
