"""Operator 8: near-duplicate vectors by randomised-rotation binary codes.

Each unit vector is padded and rotated at random; the signs are its code, and the inner product of vector and code is
stored as the correction factor that makes <code, rotated other> / factor an unbiased estimate of the cosine, with a
confidence bound of ``eps`` standard errors.  Codes and factors are a written table.

Which pairs are looked at: codes meet in hash tables keyed by a few of their bits.  The number of bits follows the number
of vectors, the number of tables follows from the bits so that a pair at the threshold meets with probability ``recall``
(closer pairs more surely), so work grows a little faster than the input, not with its square.

First only codes travel (32 bytes a vector and table): in each bucket the share of differing bits bounds the angle, and
vectors that no other can reach go.  Exact vectors are joined to those that are left, in the tables where they first
meet a candidate: there the unbiased estimates decide by their bounds which pairs are recomputed in double precision.
Links are counted and a spanning forest of them leaves the task; pairs are never rows.

Equal vectors are one class, compared once.  A bucket is cut into blocks by hash and each pair of blocks is a task's tile,
so a bucket of m vectors of which none are equal costs m * m / ``BLOCK`` reads of codes: a group of n near copies that
are all different costs n * n products, in tiles of bounded memory.

Null vectors, zero vectors and vectors with null or non-finite components link with nothing.  Vectors of different
lengths are not compared.  Ties and repeated rows are equal vectors; rows with one id are one vector if equal.  Null ids link with
nothing.  Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.llm.common import components, drop, map_arrow, release, salted_join, stored

CODE_BITS = 256
BLOCK = 1024
#: Pairs that are handled at once.
STEP = 1 << 16


@functools.lru_cache(maxsize=8)
def rotation(width: int, bits: int, seed: int = 11) -> np.ndarray:
    """``width`` orthonormal rows in max(bits, width) dimensions (a multiple of 64): the rotation of a padded vector."""
    g = np.random.default_rng(seed).standard_normal((-(-max(bits, width) // 64) * 64, width))
    return np.linalg.qr(g)[0].T


class Codes:
    """Rotated vectors, their sign codes (packed) and correction factors."""

    def __init__(self, unit: np.ndarray, bits: int):
        self.rotated = (unit @ rotation(unit.shape[1], bits)).astype(np.float32)
        self.packed = np.packbits(self.rotated > 0, axis=1, bitorder="little")
        self.factor = np.maximum(np.abs(self.rotated).sum(1) / math.sqrt(self.rotated.shape[1]), 1e-6)


def signs(packed: np.ndarray) -> np.ndarray:
    """Codes as unit vectors of signs."""
    return (np.unpackbits(packed, axis=1, bitorder="little").astype(np.float32) * 2 - 1) / np.float32(math.sqrt(8 * packed.shape[1]))


def estimates(rotated: np.ndarray, code: np.ndarray, factor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unbiased estimates of the cosines of rotated vectors and the vectors of ``code``, pair by pair, and their standard errors."""
    error = np.sqrt(np.maximum(0, 1 - factor**2) / factor**2 / max(1, code.shape[1] - 1))
    return np.einsum("ij,ij->i", rotated, code) / factor, error


def plan(n: int, threshold: float, recall: float, bits: int = CODE_BITS) -> tuple[int, int]:
    """(bits of a key, tables): buckets of about 200 vectors if they were spread evenly.

    A pair at the threshold differs in a binomial number of its code's bits; a table finds it if its bits are among the others.
    """
    width = int(min(24, max(4, math.ceil(math.log2(max(n, 1) / 200 + 1)))))
    p = math.acos(threshold) / math.pi
    differ = np.arange(bits - width + 1)
    log_c = lambda a, b: math.lgamma(a + 1) - math.lgamma(b + 1) - math.lgamma(a - b + 1)
    weight = np.exp([log_c(bits, d) + d * math.log(p) + (bits - d) * math.log(1 - p) for d in differ])
    meet = np.exp([log_c(bits - d, width) - log_c(bits, width) for d in differ])
    tables = 1
    while (weight * (1 - meet) ** tables).sum() > 1 - recall:
        tables += 1
    return width, tables


def chosen_bits(width: int, tables: int, bits: int, seed: int = 23) -> np.ndarray:
    """(table, place): the bits of the code that key each table."""
    r = np.random.default_rng(seed)
    return np.stack([np.sort(r.choice(bits, width, replace=False)) for _ in range(tables)])


def bucket_keys(packed: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """(vector, table): keys of packed codes."""
    flags = np.unpackbits(packed, axis=1, bitorder="little")
    out = np.zeros((len(packed), len(chosen)), np.int32)
    for k in range(chosen.shape[1]):
        out |= flags[:, chosen[:, k]].astype(np.int32) << k
    return out


def most_differing(threshold: float, bits: int, eps: float) -> int:
    """Bits in which codes of vectors at the threshold differ at most, ``eps`` standard errors above the mean."""
    p = math.acos(threshold) / math.pi
    return math.floor(bits * p + eps * math.sqrt(bits * p * (1 - p)))


def code_pairs(a: np.ndarray, b: np.ndarray, most: int, same: bool):
    """Batches (i, j) of rows of the packed codes a and b that differ in at most ``most`` bits (i < j if they are one block)."""
    x, y = a.view("<u8"), b.view("<u8")
    step = max(1, STEP // max(1, len(y)))
    for s in range(0, len(x), step):
        apart = sum(np.bitwise_count(x[s : s + step, None, w] ^ y[None, :, w]).astype(np.int16) for w in range(x.shape[1]))
        i, j = np.nonzero(apart <= most)
        i += s
        yield (i[i < j], j[i < j]) if same else (i, j)


def _bytes(column, dtype, rows: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(rows, -1)


def near_duplicates(df: DataFrame, vector: str = "embedding", key: str = "vec_id", threshold: float = 0.9, recall: float = 0.99, eps: float = 4.0, bits: int = CODE_BITS) -> DataFrame:
    """(key, n_links, component_id, kept): one row for each row of ``df``."""
    kind = df.schema[key].dataType
    rows = df.select(F.col(key).alias("id"), F.transform(F.col(vector), lambda x: x.cast("double")).alias("v"))

    def normalise(batches):
        for b in batches:
            out = []
            for x in b.column(1).to_pylist():
                u = None
                if x and None not in x:
                    a = np.array(x, np.float64)
                    top = np.abs(a).max()
                    if np.isfinite(top) and top > 0:
                        a = a / top
                        u = (a / np.sqrt((a * a).sum()) + 0.0).tobytes()
                out.append(u)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["id", "u"])

    units = stored(map_arrow(rows, normalise, f"id {kind.simpleString()}, u binary").select("id", "u", F.sha2("u", 256).alias("h")))
    usable = units.where("u is not null and id is not null")
    classes = stored(usable.groupBy("h").agg(F.min("id").cast("long").alias("rep"), F.count("*").alias("size"), F.first("u").alias("u")))
    found = stored(_links(classes.select("rep", "size", "u"), classes.count(), threshold, recall, eps, bits))
    release(df.sparkSession)
    sums = found.groupBy("id").agg(F.sum("links").alias("links"))
    comp = components(found.where("id != root").select(F.col("id").alias("a"), F.col("root").alias("b")))
    base = classes.select("h", "rep", "size").join(sums, F.col("rep") == F.col("id"), "left").drop("id").join(comp, F.col("rep") == F.col("id"), "left").drop("id")
    base = stored(base.select("h", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("component", "rep").alias("component")))
    drop(classes, found, comp)
    out = salted_join(units.select("id", F.when(F.col("id").isNotNull(), F.col("h")).alias("h")), base, ["h"], "left", spread="id")
    component = F.coalesce("component", F.col("id").cast("long"))
    return out.select(F.col("id").alias(key), F.coalesce("links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def _links(classes: DataFrame, n: int, threshold: float, recall: float, eps: float, bits: int) -> DataFrame:
    """(id, links, root): for each tile, the links of its vectors and a forest that spans them."""
    width, tables = plan(n, threshold, recall, bits)
    chosen = chosen_bits(width, tables, bits)

    def encode(batches):
        for b in batches:
            by_length: dict[int, list[int]] = {}
            vectors = b.column(1).to_pylist()
            for r, u in enumerate(vectors):
                by_length.setdefault(len(u), []).append(r)
            for length, at in by_length.items():
                c = Codes(np.frombuffer(b"".join(vectors[r] for r in at), np.float64).reshape(len(at), -1), bits)
                codes = pa.array([x.tobytes() for x in c.packed], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array([length] * len(at), pa.int32()), codes, pa.array(c.factor.astype(np.float64))], names=["rep", "length", "code", "factor"])

    codes = stored(map_arrow(classes.select("rep", "u"), encode, "rep long, length int, code binary, factor double"))

    def bucket(batches):
        for b in batches:
            if b.num_rows:
                packed = [np.frombuffer(c, np.uint8)[: bits // 8] for c in b.column(2).to_pylist()]
                keys = bucket_keys(np.stack(packed), chosen)
                at = pa.array(np.repeat(np.arange(b.num_rows), tables))
                yield pa.RecordBatch.from_arrays([*(b.column(c).take(at) for c in range(3)), pa.array(np.tile(np.arange(tables), b.num_rows).astype(np.int32)), pa.array(keys.ravel())], names=["rep", "length", "code", "t", "key"])

    bucketed = map_arrow(codes.select("rep", "length", "code"), bucket, "rep long, length int, code binary, t int, key int")
    place = ["t", "length", "key"]
    sizes = stored(bucketed.groupBy(*place).count().where("count > 1").select(*place, F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")))
    rows = bucketed.join(sizes, place)
    rows = rows.withColumn("mine", F.pmod(F.xxhash64("rep", "t"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    tile = [*place, "i", "j"]
    rows = rows.select(*place, F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "rep", "code")

    def pairs_of(part: pa.Table, packed: np.ndarray):
        """Batches (x, y) of rows of a tile whose codes are near and met in no earlier table."""
        mine, i, j, t = part["mine"].to_numpy(), part["i"][0].as_py(), part["j"][0].as_py(), part["t"][0].as_py()
        left, right = np.flatnonzero(mine == i), np.flatnonzero(mine == j)
        earlier = bucket_keys(packed[:, : bits // 8], chosen[:t])
        for x, y in code_pairs(packed[left], packed[right], most_differing(threshold, 8 * packed.shape[1], eps + 1), i == j):
            x, y = left[x], right[y]
            first = np.ones(len(x), bool)
            for k in range(t):
                first &= earlier[x, k] != earlier[y, k]
            yield x[first], y[first]

    def near(part: pa.Table) -> pa.Table:
        keep = np.zeros(part.num_rows, bool)
        for x, y in pairs_of(part, _bytes(part["code"], np.uint8, part.num_rows)):
            keep[x] = keep[y] = True
        return part.drop_columns(["code"]).filter(pa.array(keep))

    left_over = stored(rows.groupBy(*tile).applyInArrow(near, "t int, length int, key int, i int, j int, mine int, rep long"))
    drop(sizes)
    vectors = classes.join(codes.select("rep", "code", "factor"), "rep")
    wanted = left_over.join(vectors, "rep").select(*tile, "mine", "rep", "size", "u", "code", "factor")

    def link(part: pa.Table) -> pa.Table:
        part = part.sort_by("rep")
        m = part.num_rows
        rep, size, factor = (part[c].to_numpy() for c in ("rep", "size", "factor"))
        unit, packed = _bytes(part["u"], np.float64, m), _bytes(part["code"], np.uint8, m)
        rotated, code = (unit @ rotation(unit.shape[1], bits)).astype(np.float32), signs(packed)
        links = np.zeros(m, np.int64)
        root = np.arange(m)
        for x, y in pairs_of(part, packed):
            for s in range(0, len(x), STEP):
                p, q = x[s : s + STEP], y[s : s + STEP]
                guess, error = estimates(rotated[p], code[q], factor[q])
                maybe = guess + eps * error >= threshold
                p, q = p[maybe], q[maybe]
                exact = np.einsum("ij,ij->i", unit[p], unit[q]) >= threshold
                p, q = p[exact], q[exact]
                np.add.at(links, p, size[q])
                np.add.at(links, q, size[p])
                # of these links, those that join what is not joined yet
                while len(apart := np.flatnonzero(root[p] != root[q])):
                    p, q = p[apart], q[apart]
                    low, high = np.minimum(root[p], root[q]), np.maximum(root[p], root[q])
                    np.minimum.at(root, high, low)
                    while (root[root] != root).any():
                        root = root[root]
        keep = links > 0
        return pa.table({"id": pa.array(rep[keep]), "links": pa.array(links[keep]), "root": pa.array(rep[root[keep]])})

    return wanted.groupBy(*tile).applyInArrow(link, "id long, links long, root long")
