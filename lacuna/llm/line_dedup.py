"""Operator 7: line deduplication by overlapping windows of consecutive lines.

Every run of ``window`` consecutive lines is hashed (two 64-bit hashes).  Of each window found more
than once in the corpus the first occurrence by (key, line number) stays; the later ones
mark the lines they cover, overlapping marks are merged, and marked lines go.  A text of fewer lines
has one window, all its lines, which equals only windows of texts that have as few lines.

Null text has no lines and stays null.  Lines are cut at \\n; windows without a character other than
white space are not compared.  Rows with the same key are one document: their windows stand at the same
place, so neither is later than the other and both rows keep what the document keeps.  Null keys come first and keep all.  Extra columns are kept, but for
columns that are named as the two new ones (see ``prefix``), which these replace.

Windows see passages of three lines or more.  A passage of one or two lines that repeats between differing lines is none
of them, however long, and stays; a text of one or two lines is compared as a whole.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lacuna.llm.common import map_arrow, salted_join

BLANK = r"[^ \t\n\x0B\f\r]"


def windows(df: DataFrame, text: str, key: str, size: int) -> DataFrame:
    """(key, pos, h1, h2): one row for each window."""
    lines = df.select(F.col(key).alias("k"), F.split(F.col(text), "\n", -1).alias("lines")).where("lines is not null")
    at = lines.select("k", "lines", F.explode(F.sequence(F.lit(0), F.greatest(F.size("lines") - size, F.lit(0)))).alias("pos"))
    part = at.select("k", "pos", F.array_join(F.slice("lines", F.col("pos") + 1, size), "\n").alias("w"), F.least(F.size("lines"), F.lit(size)).alias("n"))
    part = part.where(F.col("w").rlike(BLANK))
    return part.select("k", "pos", F.xxhash64("w", "n").alias("h1"), F.xxhash64("n", "w", F.length("w")).alias("h2"))


def repeated(df: DataFrame, text: str = "text", key: str = "doc_id", size: int = 3) -> DataFrame:
    """(k, starts): the first lines of the windows of each key that occurred before.

    A window's first place is aggregated before it is shuffled; a window that very many documents have is dealt by salt.
    """
    w = windows(df, text, key, size)
    first = w.groupBy("h1", "h2").agg(F.min(F.struct("k", "pos")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = salted_join(w, first, ["h1", "h2"], spread="k").where(F.struct("k", "pos") > F.col("first"))
    return later.groupBy("k").agg(F.sort_array(F.collect_set("pos")).alias("starts"))


def dedup_lines(df: DataFrame, text: str = "text", key: str = "doc_id", size: int = 3, prefix: str = "") -> DataFrame:
    """``df`` with the later occurrences removed from ``text``, and n_lines and n_removed (long), named with ``prefix``."""
    starts = repeated(df, text, key, size)
    n_lines_, n_removed_ = f"{prefix}n_lines", f"{prefix}n_removed"
    joined = df.drop(n_lines_, n_removed_, "__starts").join(starts.select(F.col("k").alias("__k"), F.col("starts").alias("__starts")), F.col(key) == F.col("__k"), "left").drop("__k")
    columns = [c for c in joined.columns if c != "__starts"]
    at, mark = columns.index(text), len(columns)
    schema = StructType(list(joined.select(columns).schema.fields)).add(n_lines_, "long").add(n_removed_, "long")

    def run(batches):
        for b in batches:
            out, n_lines, n_removed = [], [], []
            for t, s in zip(b.column(at).to_pylist(), b.column(mark).to_pylist(), strict=True):
                lines = [] if t is None else t.split("\n")
                n_lines.append(len(lines))
                if not s or not lines:
                    out.append(t)
                    n_removed.append(0)
                    continue
                kept, covered = [], 0
                for p in s:  # ascending: merge as we go
                    kept += lines[covered:p] if p > covered else []
                    covered = max(covered, p + size)
                kept += lines[covered:]
                out.append("\n".join(kept))
                n_removed.append(len(lines) - len(kept))
            cols = [*b.columns[:at], pa.array(out, pa.string()), *b.columns[at + 1 : mark], pa.array(n_lines, pa.int64()), pa.array(n_removed, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=[*columns, n_lines_, n_removed_])

    return map_arrow(joined.select(*columns, "__starts"), run, schema)
