"""Low-discrepancy slot assignment as column arithmetic.

A field of n values visits its positions with a step coprime to n near the golden ratio; the i-th visited position goes to
block i mod B.  The inverse step turns this into a projection: position p is visited as number p * inverse mod n.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PHI_1 = 0.6180339887498949
TRIES = 4096
#: Euclid's algorithm ends within this many steps for 64-bit integers.
_EUCLID = 92


def gcd(a: Column, b: Column) -> Column:
    pair = lambda x, y: F.struct(x.cast("long").alias("a"), y.cast("long").alias("b"))
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(_EUCLID)), pair(a, b), lambda s, _: F.when(s["b"] == 0, s).otherwise(pair(s["b"], s["a"] % F.when(s["b"] == 0, 1).otherwise(s["b"]))), lambda s: s["a"]
    )


def golden_step(n: Column) -> Column:
    """Least step from floor((phi - 1) n) on that is coprime to n; 1 for n <= 1.

    Candidates are tried in growing runs, so the long run is built only for the rare n that needs it.
    """
    start = F.greatest(F.floor(F.lit(PHI_1) * n), F.lit(1))

    def first(lo: int, hi: int) -> Column:
        return F.get(F.filter(F.sequence(start + lo, start + hi - 1), lambda x: gcd(x, n) == 1), F.lit(0))

    return F.when(n <= 1, F.lit(1)).otherwise(F.coalesce(first(0, 4), first(4, 64), first(64, TRIES), F.lit(1))).cast("long")


def inverse(a: Column, n: Column) -> Column:
    """a ** -1 mod n for coprime a and n (0 for n = 1)."""
    four = lambda r0, r1, t0, t1: F.struct(*[c.cast("long").alias(k) for c, k in zip((r0, r1, t0, t1), "rstu", strict=True)])

    def step(s: Column, _: Column) -> Column:
        q = F.floor(s["r"] / F.when(s["s"] == 0, 1).otherwise(s["s"])).cast("long")
        return F.when(s["s"] == 0, s).otherwise(four(s["s"], s["r"] - q * s["s"], s["u"], s["t"] - q * s["u"]))

    return F.aggregate(F.sequence(F.lit(1), F.lit(_EUCLID)), four(n, a, F.lit(0), F.lit(1)), step, lambda s: F.pmod(s["t"], n))


STEP_SQL = f"coalesce(list_filter(range(greatest(CAST(floor({PHI_1}e0 * {{n}}) AS BIGINT), 1), greatest(CAST(floor({PHI_1}e0 * {{n}}) AS BIGINT), 1) + {TRIES}), lambda s: gcd(s, {{n}}) = 1)[1], 1)"


def step_sql(n: str) -> str:
    return f"(CASE WHEN {n} <= 1 THEN 1 ELSE {STEP_SQL.format(n=n)} END)"
