"""Streams of many chunks: states, timers and the layout of their input."""

import datetime

from pyspark.sql import functions as F

from lacuna.plans import catalog
from lacuna.streaming import assembly

DAY = datetime.datetime(2024, 1, 1)


def fragments(spark, folder, batches):
    """A stream of the batches, one at a time; each of parts (first chunk, next after the last, index of two, seconds)."""
    for i, parts in enumerate(batches):
        x = spark.createDataFrame([(*p[:3], DAY + datetime.timedelta(seconds=p[3])) for p in parts], "a long, b long, frag_idx int, at timestamp")
        x = x.select(F.explode(F.sequence("a", F.col("b") - 1)).alias("chunk_id"), "frag_idx", "at")
        payload = F.encode(F.concat("chunk_id", F.lit("."), "frag_idx", F.lit(" ")), "UTF-8").alias("payload")
        x = x.select(F.lit("c").alias("content_id"), "chunk_id", "frag_idx", F.lit(2).alias("frag_total"), F.lit(100).cast("long").alias("chunk_len"), payload, "at")
        x.coalesce(1).write.parquet(f"{folder}/in/{i}")
    return spark.readStream.schema(x.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def run(stream, folder):
    """The events, and the number of states after each batch."""
    q = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out"), [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]


def test_chunks_share_states(spark, tmp_path):
    """Python is called once a state, so thousands of chunks must not have one each."""
    n = 4000
    s = fragments(spark, tmp_path, [[(0, n, 0, 0)], [(0, n, 1, 1)]])
    events, states = run(assembly.assemble(s, max_age=5), tmp_path)
    assert {r["chunk_id"]: (r["event"], bytes(r["data"]).decode()) for r in events.collect()} == {k: ("complete", f"{k}.0 {k}.1 ") for k in range(n)}
    assert 0 < max(states) <= n * 5 // 8


def test_events_in_part_files(spark, sf_dir, tmp_path):
    """The table as a folder of part files gives what the one file gives."""
    spark.read.parquet(f"{sf_dir}/events.parquet").repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    rows = [sorted(map(tuple, catalog.QUERIES["stream_assemble"](spark, d).collect())) for d in (sf_dir, str(tmp_path))]
    assert rows[0] and rows[0] == rows[1]


def test_timer_of_shared_states(spark, tmp_path):
    """A timer drops the partials that are due and leaves the others of their state."""
    n = 3000
    s = fragments(spark, tmp_path, [[(0, n, 0, 0)], [(n, 2 * n, 0, 90)], [(2 * n, 2 * n + 1, 0, 150)], [(n, 2 * n, 1, 180), (0, 1000, 1, 180)]])
    events, states = run(assembly.assemble(s, max_age=100), tmp_path)
    done = {r["chunk_id"]: bytes(r["data"]).decode() for r in events.where("event = 'complete'").collect()}
    assert done == {k: f"{k}.0 {k}.1 " for k in range(n, 2 * n)}
    assert assembly.counters(events).first() == (n, sum(map(len, done.values())), n, n)
    assert 0 < max(states) <= n * 5 // 6
