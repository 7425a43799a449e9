"""Operator 10: URL filter by empirical-Bayes host reputation.

Labelled page outcomes (good or bad) are counted by host, registered domain and suffix.  Beta-binomial
priors shrink them: the corpus rate is the prior of a suffix, the suffix's posterior mean that of a registered domain,
the domain's that of a host; prior strengths are fitted by moments at each level.  A page is
blocked if the lower bound of its host's posterior of being bad (mean less ``z`` standard deviations, not a beta quantile) is
above ``threshold``.  Explicit
rules (host and path prefix) come first, the longest that fits wins.

Null urls and urls without :// have an empty host and path, and so the prior's verdict.  Hosts without a labelled page have
their domain's, suffix's or the corpus's posterior.  Extra columns are ignored; repeated rows are judged alike.
All steps are DataFrame expressions; counts are aggregated before they are shuffled and a hot host's rows are dealt by salt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.llm.common import salted_join

#: Fixed values: (verdict, host, path prefix).
RULES = [("block", "net", "/"), ("block", "example.com", "/de/"), ("allow", "example.net", "/en/"), ("allow", "org", "/fr/")]
#: Second labels under which names are registered below a country code.
SECOND_LEVEL = "ac co com edu gov net org"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parse(url: str) -> tuple[Column, Column]:
    """(host, path) of a url column; both empty for null or without ://."""
    u = F.coalesce(F.col(url), F.lit(""))
    rest = F.when(F.instr(u, "://") > 0, F.substring(u, F.instr(u, "://") + 3, F.length(u))).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), path


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, kind).otherwise(verdict)
    return name, verdict


def levels(host: Column) -> tuple[Column, Column]:
    """(registered domain, suffix) of a host without its port; an address is its own domain and suffix."""
    parts = F.split(F.regexp_replace(host, r":\d*$", ""), r"\.", -1)
    n = F.size(parts)
    second = F.element_at(parts, -2).isin(*SECOND_LEVEL.split()) & (F.length(F.element_at(parts, -1)) == 2)
    width = F.when((n > 2) & second, 2).otherwise(1)
    join = lambda k: F.array_join(F.slice(parts, F.greatest(n - k + 1, F.lit(1)), k), ".")
    name = F.regexp_replace(host, r":\d*$", "")
    address = name.rlike(r"^\d+(\.\d+){3}$") | name.startswith("[")
    return F.when(address, name).when(n > 1, join(width + 1)).otherwise(join(width)), F.when(address, name).otherwise(join(width))


def _strength(counts: DataFrame, prior: str) -> float:
    """Strength of the beta prior from the spread of rates around their prior mean (method of moments), within [2, 1000]."""
    m, n = F.col(prior), F.col("n")
    row = counts.where("n > 1").agg(
        F.sum(n * (F.col("bad") / n - m) ** 2).alias("spread"),
        F.sum(m * (1 - m)).alias("noise"),
        F.sum((n - 1) * m * (1 - m)).alias("room"),
    ).first()
    if not row or not row["room"]:
        return 1000.0
    rho = (row["spread"] - row["noise"]) / row["room"]
    return min(1000.0, max(2.0, 1 / rho - 1)) if rho > 0 else 1000.0


def reputation(outcomes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, float]:
    """Posterior tables by host, domain and suffix from ``outcomes(host, bad)``, and the corpus rate."""
    domain, suffix = levels(F.col("host"))
    hosts = outcomes.groupBy("host").agg(F.sum("bad").cast("double").alias("bad"), F.count("*").cast("double").alias("n"))
    hosts = hosts.select("host", domain.alias("domain"), suffix.alias("suffix"), "bad", "n")
    add = [F.sum("bad").alias("bad"), F.sum("n").alias("n")]
    domains = hosts.groupBy("domain", "suffix").agg(*add)
    suffixes = domains.groupBy("suffix").agg(*add)
    total = suffixes.agg(*add).first()
    rate = (total["bad"] + 0.5) / (total["n"] + 1.0) if total["n"] else 0.0

    def post(df: DataFrame, prior: str) -> DataFrame:
        k = _strength(df, prior)
        return df.withColumn("a", F.col("bad") + k * F.col(prior)).withColumn("b", F.col("n") - F.col("bad") + k * (1 - F.col(prior)))

    mean = F.col("a") / (F.col("a") + F.col("b"))
    suffixes = post(suffixes.withColumn("prior", F.lit(rate)), "prior").select("suffix", "a", "b", mean.alias("mean"))
    domains = post(domains.join(suffixes.select("suffix", F.col("mean").alias("prior")), "suffix"), "prior").select("domain", "a", "b", mean.alias("mean"))
    hosts = post(salted_join(hosts, domains.select("domain", F.col("mean").alias("prior")), ["domain"], spread="host"), "prior").select("host", "a", "b")
    return hosts, domains, suffixes, rate


def judge(pages: DataFrame, outcomes: DataFrame, url: str = "url", key: str = "page_id", threshold: float = 0.5, z: float = 1.0, rules=RULES) -> DataFrame:
    """(key, host, path, rule, verdict, bad_bound); ``outcomes`` is (key, bad 0/1), nulls ignored."""
    host, path = parse(url)
    p = pages.select(F.col(key), host.alias("host"), path.alias("path"))
    seen = outcomes.where(F.col(key).isNotNull() & F.col("bad").isNotNull()).groupBy(key).agg(F.max("bad").alias("bad"))
    hosts, domains, suffixes, rate = reputation(p.where("host != ''").select(key, "host").join(seen, key).select("host", "bad"))

    def bound(a: Column, b: Column) -> Column:
        m = a / (a + b)
        return F.greatest(F.lit(0.0), m - z * F.sqrt(m * (1 - m) / (a + b + 1)))

    domain, suffix = levels(F.col("host"))
    each = p.groupBy("host").agg(F.count("*").alias("__n")).select("host", domain.alias("domain"), suffix.alias("suffix"))
    own = each.join(hosts.withColumn("h", bound(F.col("a"), F.col("b"))).select("host", "h"), "host", "left")
    own = salted_join(own, domains.withColumn("d", bound(F.col("a"), F.col("b"))).select("domain", "d"), ["domain"], "left", spread="host")
    own = salted_join(own, suffixes.withColumn("s", bound(F.col("a"), F.col("b"))).select("suffix", "s"), ["suffix"], "left", spread="host")
    own = own.select("host", F.coalesce("h", "d", "s", F.lit(float(rate))).alias("bad_bound"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    judged = salted_join(p, own, ["host"], "left", spread=key)
    return judged.select(key, "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("bad_bound") > threshold, "block").otherwise("allow")).alias("verdict"), "bad_bound")
