"""Operator 5 [native]: mixing sources to target weights by entropy balancing.

Targets: sources in code-point order (null last) weigh ``weights`` in turn and share ``share`` of all
words; a target stops at ``cap`` times its source's size and the excess is shared again by weight until none is above.

Rates: among all document rates the ones of least relative entropy to 1 that give each source its words
and exceed no ``cap`` are exponential tilts, rate = min(cap, exp(lambda * size / scale)), one multiplier a source.
The multipliers solve the convex dual by Newton iterations (kept inside a shrinking bracket, until every source is at its
target or its bracket is closed) over the histogram (source, size) -> documents, so an iteration never touches the
documents.  Sums over the histogram are exact decimals, which no order of rows changes.

Copies: in each source, running sums of the rates from the largest size down are rounded, which gives each cell
(source, size) of the histogram its number of copies.  Inside a cell all rows get the whole part, and the rows with the
least hashes of key and text one more; the hash up to which they do is found in slices of the hashes' range, whose
number follows the cell's rows, so no task sorts a hot cell.  What a row takes then depends on its own values and its
cell's only.  Everything is a function of the rows, so reruns agree.

Sizes: words of the text, null text 0.  Documents without words take nothing.  Null keys and sources are values like
others.  Repeated rows (equal key and text) share what their group takes, any of them getting the odd one.  Extra
columns travel along.  An empty table gives an empty result.  Windows run over the distinct sizes of one source, whose
number is at most the size of the largest document, over the slices of one cell, and over one slice; what the driver reads
per iteration is a row of sums.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacuna.llm.common import drop, salted_join, small, stored

_BREAK = "[ \\t\\n\\x0B\\f\\r]+"
#: Rows of a cell that are ranked together.
SLICE = 512
#: Farthest a multiplier goes: rates of documents half as large as the largest are then beyond any double.
FAR = 1e6


def size_of(text: str) -> Column:
    """Words of a text column."""
    t = F.coalesce(F.col(text), F.lit(""))
    words = F.size(F.split(t, _BREAK, -1)) - F.when(t.rlike("^[ \\t\\n\\x0B\\f\\r]"), 1).otherwise(0) - F.when(t.rlike("[ \\t\\n\\x0B\\f\\r]\\z"), 1).otherwise(0)
    return F.when(~t.rlike("[^ \\t\\n\\x0B\\f\\r]"), 0).otherwise(words).cast("long")


def draw_of(key: str, text: str) -> Column:
    """Hash that orders the rows of a cell."""
    return F.xxhash64(F.col(key).cast("string"), F.lit("mix"), F.col(text))


def _source_key(source: str) -> Column:
    """A source as a join key: null is a value of its own."""
    return F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit("n"))


def _exact(c: Column) -> Column:
    """A sum that does not depend on the order of rows: to a millionth, as a decimal."""
    return F.sum(c.cast("decimal(38,6)")).cast("double")


def ranked(sources: DataFrame) -> DataFrame:
    """``sources`` with their place in code-point order, null last, from 0.

    Range partitions are ranked apart and shifted by the counts of those before, so no task holds all sources.
    """
    last = F.col("source").isNull()
    part = stored(sources.repartitionByRange(last, F.col("source")).withColumn("__p", F.spark_partition_id()))
    counts = part.groupBy("__p").count()
    shift = counts.alias("a").join(counts.alias("b"), F.col("b.__p") < F.col("a.__p"), "left").groupBy(F.col("a.__p").alias("__p")).agg(F.coalesce(F.sum("b.count"), F.lit(0)).alias("__shift"))
    local = F.row_number().over(Window.partitionBy("__p").orderBy(last, "source")) - 1
    return part.withColumn("__r", local).join(F.broadcast(shift), "__p").withColumn("place", F.col("__r") + F.col("__shift")).drop("__p", "__r", "__shift")


def targets(histogram: DataFrame, weights=(3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(k, source, source_size, target) from (k, source, size, n)."""
    src = ranked(histogram.groupBy("k", "source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("place"), F.lit(len(weights))) + 1).cast("int"))
    src = stored(src.select("k", "source", "source_size", weight.alias("w"), (F.col("source_size") * cap).alias("limit")))
    total = src.agg(F.sum("source_size")).first()[0] or 0
    # the level rises from below and each round fixes the sources that it stops, so it ends after at most one round a source
    level, before = 0.0, -1
    while True:
        stopped = F.col("w") * level >= F.col("limit")
        row = src.agg(_exact(F.when(stopped, F.col("limit")).otherwise(0.0)).alias("full"), F.sum(F.when(stopped, 0.0).otherwise(F.col("w"))).alias("open"), F.count_if(stopped).alias("n")).first()
        if not row["open"] or row["n"] == before:
            break
        before, level = row["n"], (share * total - row["full"]) / row["open"]
    return src.select("k", "source", "source_size", F.least("limit", F.col("w") * level).alias("target"))


def multipliers(histogram: DataFrame, target: DataFrame, cap: float = 2.0, tolerance: float = 1e-7) -> DataFrame:
    """(k, scale, lam): the dual solution of each source that has words and a target.

    Newton's step is taken where it stays inside the bracket of the root, else the bracket is halved; a bracket that is
    no wider than rounding is a root.
    """
    scale = histogram.groupBy("k").agg(F.max("size").cast("double").alias("scale"))
    state = target.join(scale, "k").where("source_size > 0 and target > 0")
    state = stored(state.select("k", "target", "scale", F.lit(0.0).alias("lam"), F.lit(-FAR).alias("lo"), F.lit(FAR).alias("hi")))
    cells = histogram.where("size > 0").select("k", "size", "n")
    x = F.col("size") / F.col("scale")
    tilt = F.exp(F.least(F.col("lam") * x, F.lit(50.0)))
    words = F.col("size") * F.col("n")
    for _ in itertools.count():
        sums = salted_join(cells, state.select("k", "scale", "lam"), ["k"], spread="size").groupBy("k")
        sums = sums.agg(_exact(F.least(tilt, F.lit(cap)) * words).alias("got"), _exact(F.when(tilt < cap, tilt * x * words).otherwise(0.0)).alias("slope"))
        miss = F.col("got") - F.col("target")
        lo, hi = F.when(miss < 0, F.col("lam")).otherwise(F.col("lo")), F.when(miss > 0, F.col("lam")).otherwise(F.col("hi"))
        near = (F.abs(miss) <= tolerance * F.col("target")) | (hi - lo <= 1e-12 * F.greatest(F.lit(1.0), F.abs("lam")))
        step = F.col("lam") - miss / F.greatest(F.col("slope"), F.lit(1e-300))
        half = F.when((lo < 0) & (hi > 0), F.lit(0.0)).otherwise((lo + hi) / 2)
        wide = F.when(lo <= -FAR, F.when(F.col("lam") < 0, F.col("lam") * 8).otherwise(-1.0)).when(hi >= FAR, F.when(F.col("lam") > 0, F.col("lam") * 8).otherwise(1.0)).otherwise(half)
        aside = F.greatest(F.least(wide, F.lit(FAR)), F.lit(-FAR))
        new = F.when(near, F.col("lam")).when((step > lo) & (step < hi), step).otherwise(aside)
        done = near | (new == F.col("lam"))
        turned = stored(state.join(sums, "k").select("k", "target", "scale", new.alias("lam"), lo.alias("lo"), hi.alias("hi"), done.alias("done")))
        drop(state)
        state = turned
        if not state.where("not done").limit(1).count():
            return state.select("k", "scale", "lam")


def cells_of(docs: DataFrame, weights, share: float, cap: float) -> DataFrame:
    """What the rows of each cell take, from ``docs(k, source, size, h)``.

    (k, source, size, source_size, target, rate, base, last, odd, ties): ``base`` copies each, one more for rows whose ``h``
    is below ``last``, and for ``odd`` of the ``ties`` rows whose ``h`` is ``last``.
    """
    histogram = stored(docs.groupBy("k", "source", "size").agg(F.count("*").alias("n")))
    goal = stored(targets(histogram, weights, share, cap))
    lam = multipliers(histogram, goal, cap)
    full = F.col("target") >= F.col("source_size") * cap * (1 - 1e-12)
    tilt = F.least(F.exp(F.least(F.col("lam") * F.col("size") / F.col("scale"), F.lit(50.0))), F.lit(cap))
    rate = F.coalesce(F.when(F.col("size") == 0, 0.0).when(full, cap).otherwise(tilt), F.lit(0.0))
    known = goal.join(lam, "k", "left")
    c = histogram.select("k", "size", "n").join(known, "k").select("k", "source", "size", "n", "source_size", "target", rate.alias("rate"))
    down = Window.partitionBy("k").orderBy(F.desc("size"))
    c = c.withColumn("__up", F.floor(F.sum(F.col("n") * F.col("rate")).over(down.rowsBetween(Window.unboundedPreceding, Window.currentRow)) + 0.5))
    taken = F.least(F.col("__up") - F.coalesce(F.lag("__up").over(down), F.lit(0)), F.col("n") * int(cap))
    c = c.withColumn("__c", taken).withColumn("base", F.expr("__c div n")).withColumn("more", F.col("__c") % F.col("n"))
    c = stored(c.withColumn("slices", F.ceil(F.col("n") / SLICE)).drop("__up", "__c"))
    # the slice of the hashes' range, and in it the hash, up to which rows get one more
    cell = ["k", "size"]
    some = salted_join(docs.select("k", "size", "h"), c.where("more > 0").select(*cell, "more", "slices"), cell, spread="h")
    place = F.floor((F.col("h") / float(1 << 63) + 1) / 2 * F.col("slices"))
    some = stored(some.withColumn("slice", F.least(place, F.col("slices") - 1)))
    counts = some.groupBy(*cell, "slice").agg(F.count("*").alias("m"), F.first("more").alias("more"))
    upto = F.sum("m").over(Window.partitionBy(*cell).orderBy("slice").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = counts.withColumn("rest", F.col("more") - (upto - F.col("m"))).where((F.col("rest") > 0) & (F.col("rest") <= F.col("m")))
    inside = some.drop("more").join(stored(found.select(*cell, "slice", "rest")), [*cell, "slice"])
    ordered = Window.partitionBy(*cell).orderBy("h")
    inside = inside.withColumn("__i", F.row_number().over(ordered)).withColumn("__r", F.rank().over(ordered)).withColumn("ties", F.count("*").over(ordered.rangeBetween(Window.currentRow, Window.currentRow)))
    last = inside.where("__i = rest").select(*cell, F.col("h").alias("last"), (F.col("rest") - F.col("__r") + 1).alias("odd"), "ties")
    out = stored(c.join(last, cell, "left").select("k", "source", "size", "source_size", "target", "rate", "base", "last", F.coalesce("odd", F.lit(0)).alias("odd"), "ties"))
    drop(histogram, goal, c, some)
    return out


def _joined(docs: DataFrame, cells: DataFrame) -> DataFrame:
    return docs.join(small(cells), ["k", "size"])


def copies(df: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source", weights=(3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(key, source, size, source_size, target, rate, copies) of each row."""
    docs = stored(df.select(F.col(key).alias("key"), F.col(source).alias("source"), _source_key(source).alias("k"), size_of(text).alias("size"), draw_of(key, text).alias("h")))
    d = _joined(docs.drop("source"), cells_of(docs, weights, share, cap))
    tie = F.col("h") == F.col("last")
    plain = d.where(F.col("last").isNull() | ~tie).withColumn("extra", F.coalesce(F.col("h") < F.col("last"), F.lit(False)).cast("long"))
    at = F.row_number().over(Window.partitionBy("k", "size").orderBy("key"))
    ties = d.where(tie).withColumn("extra", (at <= F.col("odd")).cast("long"))
    both = plain.unionByName(ties)
    return both.select(F.col("key").alias(key), "source", "size", "source_size", "target", "rate", (F.col("base") + F.col("extra")).cast("long").alias("copies"))


def mix(df: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source", weights=(3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """The rows of ``df`` as often as the mix takes them, with its columns.

    Texts are not shuffled: a row's copies follow from its own values and a table of cells that is broadcast if it is
    small.  Only where several rows have a cell's last hash are these gathered, as one row and its number.
    """
    narrow = stored(df.select(F.col(source).alias("source"), _source_key(source).alias("k"), size_of(text).alias("size"), draw_of(key, text).alias("h")))
    cells = cells_of(narrow, weights, share, cap)
    cells = cells.select(F.col("k").alias("__k"), F.col("size").alias("__size"), F.struct("base", "last", "odd", "ties").alias("__c"))
    drop(narrow)
    marked = df.withColumns({"__k": _source_key(source), "__size": size_of(text), "__h": draw_of(key, text)}).join(small(cells), ["__k", "__size"])
    at, last, ties = F.col("__h"), F.col("__c.last"), F.col("__c.ties")
    more = F.coalesce((at < last) | (at == last) & (ties == 1), F.lit(False)).cast("long")
    rows = marked.select(*df.columns, (F.col("__c.base") + more).alias("__take"))
    if cells.where("__c.ties > 1").limit(1).count():  # the odd ones of equal rows are copies of one of them
        of = F.struct(*[F.col(f"`{c}`") for c in df.columns])
        odd = marked.where((at == last) & (ties > 1)).groupBy("__k", "__size", "__h").agg(F.first(of).alias("__row"), F.first("__c.odd").alias("__take"))
        rows = rows.union(odd.select("__row.*", F.col("__take").cast("long")))
    taken = rows.where("__take > 0")
    return taken.withColumn("__n", F.explode(F.sequence(F.lit(1), F.col("__take").cast("int")))).select(*df.columns)
