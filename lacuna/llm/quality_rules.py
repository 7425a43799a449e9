"""Operator 4 [native]: quality rules as a learned decision list.

Statistics of each whole text are Spark expressions.  A decision list is learned by sequential
covering from the statistics of a bounded sample of labelled rows: each rule is a conjunction of thresholds, grown
by information gain on two thirds of the sample, pruned on the rest, and accepted only if it is precise there; the
rows it covers leave and the next rule is grown.  The list is emitted as one ordered conditional expression
(``CASE WHEN``), so applying it is a projection: no shuffle, no Python.

Null text has no words: all statistics are 0 and the base rule fails it.  Without labels of both classes
the list is empty and keeps what passes the base rules.  Extra columns are ignored; repeated rows are judged alike.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
_BREAK = "[ \\t\\n\\x0B\\f\\r]+"

#: Name -> expression over the columns of statistics().
FEATURES: dict[str, str] = {
    "n_words": "double(n_words)",
    "word_length": "word_chars / greatest(n_words, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "dup_lines": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_words": "n_repeat_words / greatest(n_words, 1)",
    "words_per_line": "n_words / greatest(n_lines, 1)",
    "upper": "n_upper / greatest(word_chars, 1)",
    "digits": "n_digits / greatest(word_chars, 1)",
    "stops": "n_stops / greatest(n_words, 1)",
    "bars": "n_bars / greatest(n_words, 1)",
    "shouts": "n_shouts / greatest(n_words, 1)",
    "distinct_words": "n_distinct / greatest(n_words, 1)",
}


def _drop(c: Column, chars: str) -> Column:
    return F.translate(c, chars, "")


def _count(c: Column, chars: str) -> Column:
    return (F.length(c) - F.length(_drop(c, chars))).cast("long")


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeat_words(words: Column, width: int = 5) -> Column:
    """Words inside windows of ``width`` words found twice or more (64-bit window hashes), in n log n steps.

    Equal neighbours in the sorted list of (hash, place) give the repeated places; between consecutive repeated places
    a window adds the words that the next one does not cover.
    """
    n = F.size(words)

    def covered(h: Column) -> Column:
        marked = F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))

        def runs(s: Column) -> Column:
            same = F.filter(
                s,
                lambda x, i: F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False)),
            )
            places = F.array_sort(F.transform(same, lambda x: x["i"]))
            return _let(
                places,
                lambda p: F.aggregate(
                    F.transform(p, lambda x, k: F.least(F.lit(width), F.coalesce(F.get(p, k + 1) - x, F.lit(width)))),
                    F.lit(0).cast("long"),
                    lambda a, x: a + x,
                ),
            )

        return _let(F.sort_array(marked), runs)

    def windows(hashed: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), n - width), lambda i: F.xxhash64(*[F.get(hashed, i + j) for j in range(width)]))

    hashes = _let(F.transform(words, lambda w: F.xxhash64(w)), windows)
    found = _let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h)))
    return F.when(n <= width, F.lit(0).cast("long")).otherwise(found)


def statistics(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """``keep`` and the statistics of each text, all long."""
    t = F.coalesce(F.col(text), F.lit(""))
    has_word = lambda x: F.length(_drop(x, SPACES)) > 0
    s = df.select(*keep, t.alias("__t"))
    s = s.withColumn("__w", F.filter(F.split("__t", _BREAK, -1), lambda x: x != ""))
    s = s.withColumn("__l", F.filter(F.split("__t", "\n", -1), has_word))
    c = F.col("__t")
    return s.select(
        *keep,
        F.size("__w").cast("long").alias("n_words"),
        F.length(_drop(c, SPACES)).cast("long").alias("word_chars"),
        _count(c, SYMBOLS).alias("n_symbols"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("__w")).alias("n_repeat_words"),
        F.size("__l").cast("long").alias("n_lines"),
        _count(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("n_upper"),
        _count(c, "0123456789").alias("n_digits"),
        _count(c, ".?").alias("n_stops"),
        _count(c, "|").alias("n_bars"),
        _count(c, "!").alias("n_shouts"),
        F.size(F.array_distinct("__w")).cast("long").alias("n_distinct"),
    )


Rule = list[tuple[str, str, float]]


def _gain(p0: int, n0: int, p: int, n: int) -> float:
    return 0.0 if p == 0 else p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0)))


def _covers(rule: Rule, row: dict) -> bool:
    return all(row[f] <= v if op == "<=" else row[f] > v for f, op, v in rule)


def _grow(rows: list[tuple[dict, bool]], most: int, cuts: dict[str, list[float]]) -> Rule:
    rule: Rule = []
    while rows and len(rule) < most:
        p0 = sum(y for _, y in rows)
        n0 = len(rows) - p0
        if not p0 or not n0:
            break
        best, found = 1e-9, None
        for f, values in cuts.items():
            order = sorted((x[f], y) for x, y in rows)
            k = p = n = 0
            for v in values:
                while k < len(order) and order[k][0] <= v:
                    p, n, k = p + order[k][1], n + (not order[k][1]), k + 1
                for op, a, b in (("<=", p, n), (">", p0 - p, n0 - n)):
                    if (g := _gain(p0, n0, a, b)) > best:
                        best, found = g, (f, op, v)
        if found is None:
            break
        rule.append(found)
        rows = [r for r in rows if _covers([found], r[0])]
    return rule


def learn(rows: list[tuple[dict, bool]], most_rules: int = 12, most_conditions: int = 4, precision: float = 0.9, support: int = 8, bins: int = 64) -> list[Rule]:
    """Ordered rules for the rows marked True (low quality), by sequential covering."""
    names = list(FEATURES)
    cuts = {}
    for f in names:
        v = sorted({x[f] for x, _ in rows})
        mids = [(a + b) / 2 for a, b in zip(v, v[1:], strict=False)]
        cuts[f] = mids[:: max(1, len(mids) // bins)]
    grow, prune = [r for i, r in enumerate(rows) if i % 3], rows[::3]
    rules: list[Rule] = []

    def worth(rule: Rule, part) -> tuple[float, int, int]:
        hit = [y for x, y in part if _covers(rule, x)]
        p = sum(hit)
        return (p - (len(hit) - p)) / max(1, len(hit)), p, len(hit)

    while len(rules) < most_rules:
        rule = _grow(grow, most_conditions, cuts)
        if not rule:
            break
        short = max((rule[:k] for k in range(len(rule), 0, -1)), key=lambda r: worth(r, prune)[0])
        p, n = (a + b for a, b in zip(worth(short, grow)[1:], worth(short, prune)[1:], strict=True))
        _, pp, pn = worth(short, prune)
        if n < support or p < precision * n or pp < precision * pn or pn == 0:
            break
        rules.append(short)
        grow = [r for r in grow if not _covers(short, r[0])]
        prune = [r for r in prune if not _covers(short, r[0])]
    return rules


def expression(rules: list[Rule]) -> Column:
    """Number of the first rule that fits, from 1; 0 if none does."""
    if not rules:
        return F.lit(0)
    conds = [" AND ".join(f"({FEATURES[f]}) {op} {v!r}D" for f, op, v in rule) for rule in rules]
    return F.expr("CASE " + " ".join(f"WHEN {c} THEN {i + 1}" for i, c in enumerate(conds)) + " ELSE 0 END")


def train(df: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", good: str = "quality", sample_rows: int = 6000) -> list[Rule]:
    """Learn from at most ``sample_rows`` labelled rows, picked by a hash of their key."""
    usable = labels.where(F.col(key).isNotNull() & F.col(good).isNotNull()).groupBy(F.col(key).alias("__k")).agg(F.min(good).alias("__good"))
    chosen = usable.orderBy(F.xxhash64("__k"), "__k").limit(sample_rows)
    stats = statistics(df.select(F.col(key).alias("__k"), F.col(text).alias("__x")).join(F.broadcast(chosen), "__k"), "__x", ["__k", "__good"])
    rows = stats.select("__k", "__good", *[F.expr(e).alias(f) for f, e in FEATURES.items()]).limit(2 * sample_rows).collect()
    rows = sorted(((r["__k"], {f: r[f] for f in FEATURES}, r["__good"] == 0) for r in rows), key=lambda r: (r[0], sorted(r[1].items())))
    rows = [(x, y) for _, x, y in rows]
    if not rows or len({y for _, y in rows}) < 2:
        return []
    return learn(rows)


def judge(df: DataFrame, rules: list[Rule], text: str = "text", key: str = "doc_id") -> DataFrame:
    s = statistics(df, text, [key])
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    s = s.withColumn("base_failed", failed).withColumn("rule", expression(rules))
    counts = ["word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return s.select(key, "n_words", *counts, "base_failed", (~F.col("base_failed") & (F.col("rule") == 0)).alias("kept"), "rule")


def describe(rules: list[Rule]) -> str:
    return reduce(lambda a, r: a + "reject if " + " and ".join(f"{f} {op} {v:.4g}" for f, op, v in r) + "\n", rules, "")
