"""Reassembly of fragments as a stateful stream: open partials by content and chunk, dropped by a timer when they get old."""

from __future__ import annotations

import pickle
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lacuna.sources.persist import new_path

KEYS = ["content_id", "chunk_id"]
_OUT = "content_id string, chunk_id long, event string, frags int, bytes long, data binary"
_STATE = "open binary"
_IN = [*KEYS, "seen", "frag_idx", "frag_total", "chunk_len", "payload"]


def assemble(stream: DataFrame, max_age: float = 5.0, delay: str = "0 seconds", buckets: int = 2048) -> DataFrame:
    """Events of a stream of fragments (content_id, chunk_id, frag_idx, frag_total, chunk_len, payload, at timestamp).

    ``complete`` rows carry a chunk's bytes, ``expired`` rows count the fragments of a partial that was dropped since its
    first fragment is more than ``max_age`` seconds old: when a later fragment comes (which opens a new partial), or when
    the watermark, ``delay`` behind the latest fragment, says that none will come in time.  Duplicates overwrite;
    fragments that disagree with the first in count or length are ignored, as are those without chunk, index, count or length.

    Spark calls Python once a group and not once a row, which takes milliseconds; so a group is a bucket of chunks, whose
    open partials are one state value, and its timer is that of the partial that expires first.  The number of ``buckets``
    belongs to the checkpoint: a stream goes on with the one it began with.
    """

    def timer(first: float) -> int:
        return int((first + max_age) * 1000) + 1

    def push(key, frames, state: GroupState):
        out = []

        def say(at: tuple, event: str, frags: int, data: bytes | None = None) -> None:
            out.append((*at, event, frags, len(data or b""), data))

        now = state.getCurrentWatermarkMs()
        # by (content, chunk): time of the first fragment, count, length, payloads by index
        partials = pickle.loads(state.get[0]) if state.exists else {}
        if not state.hasTimedOut:
            rows = pd.concat(list(frames))
            rows = rows.iloc[np.lexsort((rows["frag_idx"], rows["seen"]))]
            for *at, seen, idx, total, size, payload in zip(*(rows[c].tolist() for c in _IN), strict=True):
                at = tuple(at)
                partial = partials.get(at)
                if partial and seen - partial[0] > max_age:
                    say(at, "expired", len(partial[3]))
                    del partials[at]
                    partial = None
                if not partial:
                    partial = (seen if seen == seen else now / 1000, total, size, {})
                first, *same, have = partial
                if [total, size] != same or not 0 <= idx < total:
                    continue
                have[idx] = payload or b""
                if len(have) == total:
                    say(at, "complete", total, b"".join(have[i] for i in range(total))[:size])
                    partials.pop(at, None)
                else:
                    partials[at] = partial
        for at in [at for at, p in partials.items() if timer(p[0]) < now]:
            say(at, "expired", len(partials.pop(at)[3]))
        if partials:
            state.update((pickle.dumps(partials, pickle.HIGHEST_PROTOCOL),))
            state.setTimeoutTimestamp(max(timer(min(p[0] for p in partials.values())), now + 1))
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in _OUT.split(", ")])

    timed = stream.withWatermark("at", delay).withColumn("seen", F.unix_micros("at") / 1e6)
    whole = timed.dropna(subset=["chunk_id", "frag_idx", "frag_total", "chunk_len"])
    dealt = whole.select(F.pmod(F.xxhash64(*KEYS), F.lit(buckets)).alias("bucket"), *_IN, "at")
    return dealt.groupBy("bucket").applyInPandasWithState(push, _OUT, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def counters(events: DataFrame) -> DataFrame:
    """One row: chunks that were completed, their bytes, partials that expired, and their fragments."""
    done = F.col("event") == "complete"
    return events.agg(
        F.count_if(done).alias("chunks_completed"),
        F.coalesce(F.sum(F.when(done, F.col("bytes"))), F.lit(0)).alias("bytes_completed"),
        F.count_if(~done).alias("partials_expired"),
        F.coalesce(F.sum(F.when(~done, F.col("frags"))), F.lit(0)).alias("fragments_expired"),
    )


def run_once(stream: DataFrame, name: str) -> DataFrame:
    """Process what is there and give the result; it is written to the shared folder, not held by the driver."""
    spark = stream.sparkSession
    base = f"{new_path(spark)}-{name}-{uuid.uuid4().hex[:8]}"
    q = stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception():
        raise RuntimeError(str(q.exception()))
    return spark.read.schema(stream.schema).parquet(f"{base}/out")
