"""Gossip rounds as joins over (peer, id)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacuna.sources.persist import drop, stored


def ring(df: DataFrame, key: str) -> tuple[DataFrame, int]:
    """(key, peer) with places 0, 1, ... in order of the distinct keys, and their number; counted range by range, not in one task."""
    keys = df.select(key).where(F.col(key).isNotNull()).distinct()
    x = stored(keys.repartitionByRange(key).sortWithinPartitions(key).withColumn("at", F.monotonically_increasing_id()))
    part, place = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    sizes = dict(x.groupBy(part.alias("part")).count().collect())
    before = [0]
    for p in range(max(sizes, default=0)):
        before.append(before[-1] + sizes.get(p, 0))
    start = F.element_at(F.array(*map(F.lit, before)), part.cast("int") + 1)
    return x.select(key, (start + place).alias("peer")), sum(sizes.values())


def step(have: DataFrame, peers: int, most: int = 64) -> DataFrame:
    """Each peer takes the first ``most`` ids that the next one has and it lacks."""
    offer = have.select(F.pmod(F.col("peer") - 1, F.lit(peers)).alias("peer"), "id")
    missing = offer.join(have, ["peer", "id"], "left_anti")
    first = missing.withColumn("k", F.row_number().over(Window.partitionBy("peer").orderBy("id"))).where(F.col("k") <= most)
    return have.unionByName(first.select("peer", "id"))


def simulate(have: DataFrame, peers: int, rounds: int) -> DataFrame:
    """(round, peer, n): ids known after each round; rounds are written, so lineage stays short."""
    now = stored(have)
    out = now.groupBy("peer").agg(F.count("*").alias("n")).select(F.lit(0).alias("round"), "peer", "n")
    for r in range(1, rounds + 1):
        now = stored(step(now, peers))
        out = out.union(now.groupBy("peer").agg(F.count("*").alias("n")).select(F.lit(r), "peer", "n"))
    return out


def draw(seed: int, kind: int, at: int) -> Column:
    """A number in 0..1 for a (peer, id) in a round, the same in every run and partitioning."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(kind), F.lit(at), F.col("peer"), F.col("id")), F.lit(1 << 30)) / float(1 << 30)


def spread(have: DataFrame, links: DataFrame, rounds: int, seed: int = 0, forward: float = 0.25, most: int = 64, ttl: int | None = None) -> DataFrame:
    """(peer, id, since, last, held): what peers know after rounds of the node protocol over ``links(peer, to)``.

    In a round every peer forwards to its links what first came in the round before, each id with probability
    ``forward``; sends them one id it holds, drawn at random; and tells them its least ``most`` ids, of which they get
    what they lack.  ``since`` is the round of an id's first arrival (null: there from the start, and so not forwarded),
    ``last`` that of its latest.  Ids whose latest arrival is more than ``ttl`` rounds ago are no longer held; they can
    come again but are not forwarded again.  Repeated rows count once; null peers and ids are left out.
    """
    links = links.select("peer", "to").where(F.col("peer").isNotNull() & F.col("to").isNotNull()).distinct()
    start = have.select("peer", "id").where(F.col("peer").isNotNull() & F.col("id").isNotNull()).distinct()
    now = stored(start.select("peer", "id", F.lit(None).cast("int").alias("since"), F.lit(0).alias("last"), F.lit(True).alias("held")))
    for r in range(1, rounds + 1):
        held = now.where("held")
        fresh = held.where((F.col("since") == r - 1) & (draw(seed, 0, r) < forward)).select("peer", "id")
        any_ = held.groupBy("peer").agg(F.min_by("id", F.struct(draw(seed, 1, r), "id")).alias("id"))
        sent = fresh.unionByName(any_).join(links, "peer").select(F.col("to").alias("peer"), "id")
        told = held.withColumn("k", F.row_number().over(Window.partitionBy("peer").orderBy("id"))).where(F.col("k") <= most)
        lacked = told.join(links, "peer").select(F.col("to").alias("peer"), "id").join(held.select("peer", "id"), ["peer", "id"], "left_anti")
        arrived = sent.unionByName(lacked).select("peer", "id", F.lit(r).alias("since"), F.lit(r).alias("last"))
        both = now.select("peer", "id", "since", "last").unionByName(arrived)
        known = both.groupBy("peer", "id").agg(F.min("since").alias("since"), F.max("last").alias("last"))
        after = stored(known.withColumn("held", F.lit(True) if ttl is None else F.lit(r) - F.col("last") <= ttl))
        drop(now)
        now = after
    return now
