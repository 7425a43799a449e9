"""Operator 6: n-gram Jaccard self-join by signature trees.

A document is the set of its distinct word shingles; documents with equal sets are one class.  Classes meet in
blocks: by prefix filtering, two sets that reach the threshold share one of their first
n - ceil(threshold * n) + 1 shingles in any fixed order, here: common ones (found on a bounded sample) last, else by hash.
The order changes the work, never the result.

Each class has a signature, a bitmap of its shingles' hashes with 8 to 16 bits a shingle, and a short one, folded
to a quarter, which travels first and rules out most.  In a block the classes are the leaves of a signature tree: sorted
by component and size, nodes hold the OR of their children's bitmaps and the range of their sizes.  A dual traversal descends pairs of nodes, starting with the root and itself, and leaves a pair of
nodes as soon as the largest possible overlap (a set bit of one side that the other lacks is at least one shingle not
shared) cannot reach the threshold, or when both are one component already.  Pairs of leaves that remain are
verified exactly on the 64-bit shingle hashes of the whole texts.

Rounds keep copies from being paired all with all.  First every class of a block is held only against the block's
least class, which joins most groups.  Then the traversal runs over blocks that still hold several components.  In
blocks of more than ``PART`` classes it offers each class its best few partners in other components; what links is
joined, and where a traversal held partners back the next round offers four times as many.  The rounds end when none was
held back, so every pair of classes is either verified or connected already, and no link that matters to a component is
lost.

A large block is cut into parts: by component where one component has more than ``PART`` classes in it, else by a hash of
the component.  Pairs of parts that lie in one component, or whose sizes are too far apart, are no task; each other pair
of parts is a task of at most some 2 * ``PART`` classes.  A block in which m classes of different components stay
apart costs about m * m / ``PART`` signature reads, but no more than a few pairs a class.

Null, empty and blank texts have no shingles and link with nothing; fewer words than the shingle's length are one
shingle.  Ties and repeated rows are equal sets; rows with equal keys are one node; null keys link with nothing.  Extra
columns are ignored; an empty table gives an empty result.  A class is named by 64 bits of a 128-bit hash of its set; a clash
between two classes is looked for, and another seed is taken where there is one.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.llm.common import components, drop, map_arrow, release, salted_join, small, stored
from lacuna.llm.words import CHUNK, mix64, shingles, slices_by_bytes, text_buffer, word_hashes

#: Classes of a part of a large block; blocks of up to FANOUT classes, one node of a tree, are expanded by a join.
PART, FANOUT = 512, 16
LEAST_BITS, MOST_BITS = 128, 1 << 17
#: Partners that a class is offered in the first traversal.
PARTNERS = 4


# --- sets and signatures ----------------------------------------------------------------------


def sets_of(batch: pa.RecordBatch, k: int):
    """(row, sorted distinct shingle hashes) for each row; the text is column 1."""
    data, offsets = text_buffer(batch.column(1))
    for a, b in slices_by_bytes(offsets, CHUNK):
        h, bounds = word_hashes(data, offsets[a : b + 1])
        for i in range(b - a):
            yield a + i, shingles(h[bounds[i] : bounds[i + 1]], k)


def class_of(s: np.ndarray, seed: int = 0) -> tuple[int, int]:
    """128 bits that stand for a set: two independent sums of avalanched members."""
    with np.errstate(over="ignore"):
        one = mix64(s ^ np.uint64(seed)).sum(dtype=np.uint64)
        two = mix64(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
    return int(one.view(np.int64)), int(two.view(np.int64))


def signature(s: np.ndarray) -> bytes:
    bits = min(MOST_BITS, max(LEAST_BITS, 8 << int(np.ceil(np.log2(max(len(s), 2))))))
    place = (s >> np.uint64(7)) & np.uint64(bits - 1)
    flags = np.zeros(bits, np.uint8)
    flags[place.astype(np.int64)] = 1
    return np.packbits(flags, bitorder="little").tobytes()


def short(sig: bytes) -> bytes:
    """A signature folded to a quarter of its bits."""
    return fold(sig, max(LEAST_BITS, 2 * len(sig))).tobytes()


def least_overlap(n, m, percent: int):
    """The least intersection with which sets of n and m members reach percent / 100."""
    return -(-percent * (n + m) // (100 + percent))


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


# --- the tree ---------------------------------------------------------------------------------


def fold(sig: bytes, bits: int) -> np.ndarray:
    """A signature as words of a bitmap of fewer bits."""
    w = np.frombuffer(sig, "<u8")
    while len(w) * 64 > bits:
        w = w[: len(w) // 2] | w[len(w) // 2 :]
    return w


class SignatureTree:
    """Leaves in the given order; level 0 are the leaves, each higher level joins FANOUT nodes."""

    def __init__(self, sizes: np.ndarray, bitmaps: np.ndarray, comps: np.ndarray):
        level = {"lo": sizes, "hi": sizes, "map": bitmaps, "c0": comps, "c1": comps, "slack": sizes - np.bitwise_count(bitmaps).sum(1).astype(np.int64)}
        self.levels = [level]
        while len(level["lo"]) > 1:
            at = np.arange(0, len(level["lo"]), FANOUT)
            level = {
                "lo": np.minimum.reduceat(level["lo"], at),
                "hi": np.maximum.reduceat(level["hi"], at),
                "map": np.bitwise_or.reduceat(level["map"], at, axis=0),
                "c0": np.minimum.reduceat(level["c0"], at),
                "c1": np.maximum.reduceat(level["c1"], at),
                "slack": np.maximum.reduceat(level["slack"], at),
            }
            self.levels.append(level)


def most_overlap(n: np.ndarray, m: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The largest possible intersections of sets of n and m members with bitmaps p and q."""
    return np.minimum(n - np.bitwise_count(p & ~q).sum(1), m - np.bitwise_count(q & ~p).sum(1))


def dual(tree: SignatureTree, other: SignatureTree | None, percent: int, words: int = 1 << 20) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of leaves that may reach the threshold and lie in different components, and by how much they may exceed it.

    The descent is depth first by groups of pairs, so that about ``words`` words of bitmaps are held at once.
    """
    same = other is None
    other = tree if same else other
    up = lambda t, h: t.levels[min(h, len(t.levels) - 1)]
    step = max(1, words // (FANOUT * FANOUT * tree.levels[0]["map"].shape[1]))
    left, right, room = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
    open_ = [(max(len(tree.levels), len(other.levels)) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while open_:
        h, x, y = open_.pop()
        a, b = up(tree, h), up(other, h)
        joined = (a["c0"][x] == a["c1"][x]) & (b["c0"][y] == b["c1"][y]) & (a["c0"][x] == b["c0"][y])
        x, y = x[~joined], y[~joined]
        # sizes: with the nearest sizes of both ranges
        lo, hi = np.maximum(a["lo"][x], b["lo"][y]), np.minimum(a["hi"][x], b["hi"][y])
        ok = 100 * hi >= percent * lo
        x, y = x[ok], y[ok]
        least = least_overlap(a["lo"][x], b["lo"][y], percent)
        if h == 0:
            most = most_overlap(a["lo"][x], b["lo"][y], a["map"][x], b["map"][y])
        else:
            # shingles of a leaf lie in bits that both maps have, but for those that share a bit (slack)
            most = np.minimum(a["slack"][x], b["slack"][y]) + np.bitwise_count(a["map"][x] & b["map"][y]).sum(1)
        ok = most >= least
        x, y = x[ok], y[ok]
        if h:
            open_ += [(h - 1, *_children(x[s : s + step], y[s : s + step], tree, other, h, same)) for s in range(0, len(x), step)]
            continue
        once = x < y if same else np.ones(len(x), bool)
        left.append(x[once])
        right.append(y[once])
        room.append((most[ok] / least[ok])[once])
    return np.concatenate(left), np.concatenate(right), np.concatenate(room)


def _children(i, j, tree, other, h, same):
    def kids(t, x):
        if h >= len(t.levels):
            return x[:, None], np.ones((len(x), 1), bool)
        c = x[:, None] * FANOUT + np.arange(FANOUT)
        return c, c < len(t.levels[h - 1]["lo"])

    a, va = kids(tree, i)
    b, vb = kids(other, j)
    x = np.broadcast_to(a[:, :, None], (len(i), a.shape[1], b.shape[1]))
    y = np.broadcast_to(b[:, None, :], x.shape)
    ok = va[:, :, None] & vb[:, None, :]
    if same:
        ok = ok & (x <= y)
    return x[ok], y[ok]


def traverse(part: pa.Table, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row pairs of one table (n, sig, comp, side) and their room; side is 0 throughout if it is held against itself.

    There is one tree for each signature length, so that short signatures do not blunt long ones; sets near enough in
    size have lengths that are equal or differ by one doubling.
    """
    n, comp, side = part["n"].to_numpy(), part["comp"].to_numpy(), part["side"].to_numpy()
    sigs = part["sig"].to_pylist()
    width = np.array([len(s) for s in sigs])
    itself = bool((side == 0).all())

    def tree(rows: np.ndarray, w: int) -> SignatureTree:
        return SignatureTree(n[rows], np.stack([fold(sigs[r], 8 * w) for r in rows]), comp[rows])

    # components that fill nodes stand together, the others by size
    _, which, count = np.unique(comp, return_inverse=True, return_counts=True)
    apart = np.where(count[which] >= FANOUT, which, -1)

    def rows_of(w: int, of: int) -> np.ndarray:
        rows = np.flatnonzero((width == w) & (side == of))
        return rows[np.lexsort((n[rows], apart[rows]))]

    left, right, room = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
    for w in np.unique(width).tolist():
        a = rows_of(w, 0)
        if not len(a):
            continue
        for v in (w, 2 * w) if itself else (w // 2, w, 2 * w):
            if itself and v == w:
                i, j, more = dual(tree(a, w), None, percent)
                b = a
            else:
                b = rows_of(v, 0 if itself else 1)
                if not len(b):
                    continue
                i, j, more = dual(tree(a, min(w, v)), tree(b, min(w, v)), percent)
            left.append(a[i])
            right.append(b[j])
            room.append(more)
    return np.concatenate(left), np.concatenate(right), np.concatenate(room)


def best_partners(i: np.ndarray, j: np.ndarray, room: np.ndarray, partners: int) -> np.ndarray:
    """Marks the pairs that are among the ``partners`` with the most room of either end."""
    keep = np.zeros(len(i), bool)
    for end in (i, j):
        order = np.lexsort((-room, end))
        first = np.flatnonzero(np.r_[True, end[order][1:] != end[order][:-1]]) if len(order) else order
        place = np.arange(len(order)) - np.repeat(first, np.diff(np.r_[first, len(order)]))
        keep[order[place < partners]] = True
    return keep


# --- the join ---------------------------------------------------------------------------------


def common_shingles(df: DataFrame, k: int, sample_rows: int, least: int = 4, most: int = 30_000) -> np.ndarray:
    """Shingles found in several of about ``sample_rows`` texts, at most ``most``; they only shape the order."""
    n = df.count()
    rate = min(1.0, sample_rows / max(1, n))
    some = df.where(F.pmod(F.xxhash64("key", F.lit("sample")), F.lit(1 << 30)) < int(rate * (1 << 30)))

    def run(batches):
        for b in batches:
            out = [s.view(np.int64) for _, s in sets_of(b, k)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out) if out else np.zeros(0, np.int64))], names=["s"])

    rows = map_arrow(some.select("key", "text"), run, "s long").groupBy("s").count().where(F.col("count") >= least).orderBy(F.desc("count"), "s").limit(most).collect()
    return np.sort(np.array([r["s"] for r in rows], np.int64).view(np.uint64))


def _lists(arrays: list[np.ndarray | None]) -> pa.ListArray:
    """Arrow lists of longs; None is null."""
    ends = np.cumsum([0, *(0 if a is None else len(a) for a in arrays)])
    flat = np.concatenate([a for a in arrays if a is not None] or [np.zeros(0, np.int64)]).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat), mask=pa.array([a is None for a in arrays], pa.bool_()))


def _described(base: DataFrame, k: int, percent: int, common: np.ndarray, seed: int) -> DataFrame:
    """(key, n, c1, c2, tokens, sig, mini): set size, class, prefix and signatures of each text, in one pass over the texts.

    Copies that a task has met have no tokens and signatures again.
    """

    def prefix(s: np.ndarray) -> np.ndarray:
        p = prefix_length(len(s), percent)
        if len(common):
            often = common[np.minimum(np.searchsorted(common, s), len(common) - 1)] == s
            s = np.concatenate([s[~often][:p], s[often][:p]])
        return s[:p]

    def run(batches):
        seen: set[tuple[int, int]] = set()
        for b in batches:
            n, one, two, tokens, sigs = [], [], [], [], []
            for _, s in sets_of(b, k):
                c = class_of(s, seed)
                new = len(s) > 0 and c not in seen
                if len(seen) > 200_000:
                    seen.clear()
                if new:
                    seen.add(c)
                n.append(len(s))
                one.append(c[0])
                two.append(c[1])
                tokens.append(prefix(s) if new else None)
                sigs.append(signature(s) if new else None)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.int64()) for x in (n, one, two)), _lists(tokens), pa.array(sigs, pa.binary()), pa.array([s and short(s) for s in sigs], pa.binary())], names=["key", "n", "c1", "c2", "tokens", "sig", "mini"])

    return map_arrow(base, run, "key long, n long, c1 long, c2 long, tokens array<long>, sig binary, mini binary")


def jaccard_components(df: DataFrame, text: str = "text", key: str = "doc_id", k: int = 4, percent: int = 85, sample_rows: int = 8000) -> DataFrame:
    """(key, n_shingles, component_id): one row for each row of ``df``."""
    spark = df.sparkSession
    name = df.schema[key].dataType.simpleString()
    base = df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    common = common_shingles(base, k, sample_rows)
    for seed in itertools.count():
        docs = stored(_described(base, k, percent, common, seed))
        classes = stored(docs.where("n > 0 and key is not null").groupBy("c1", "c2").agg(F.min("key").alias("rep"), F.first("n").alias("n")))
        if not classes.groupBy("c1").count().where("count > 1").limit(1).count():
            break
        drop(docs, classes)
    keys = stored(docs.select("key", "n", "c1", "c2"))
    blocks = _blocks(docs, classes)
    wanted = blocks.select("cls").distinct()
    sigs = docs.where("sig is not null").select(F.col("c1").alias("cls"), "n", "sig", "mini").join(wanted, "cls", "left_semi")
    sigs = stored(sigs.dropDuplicates(["cls"]))
    drop(docs)
    release(spark)
    c = _components(base, blocks, sigs, classes, k, percent, seed)
    best = classes.select(F.col("c1").alias("id"), "rep").join(c, "id")
    least = best.groupBy("component").agg(F.min("rep").alias("least"))
    named = stored(salted_join(best, least, ["component"], spread="id").select(F.col("id").alias("c1"), "least"))
    drop(blocks, sigs, c)
    comps = classes.select("c1", "c2", "rep").join(named, "c1", "left").select("c1", "c2", F.coalesce("least", "rep").alias("component"))
    out = salted_join(keys, comps, ["c1", "c2"], "left", spread="key")
    component = F.when(F.col("n") > 0, F.coalesce("component", "key")).otherwise(F.col("key"))
    return out.select(F.col("key").cast(name).alias(key), F.col("n").alias("n_shingles"), F.when(F.col("key").isNotNull(), component).cast("long").alias("component_id"))


def _blocks(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(token, cls, n, least) for prefix shingles that several classes have; ``least`` is the block's least class.

    Least and greatest class of a shingle are aggregated before they are shuffled, so a frequent shingle is no hot key.
    """
    keyed = docs.where("tokens is not null and key is not null").select(F.col("c1").alias("cls"), F.explode("tokens").alias("token"))
    ends = keyed.groupBy("token").agg(F.min("cls").alias("least"), F.max("cls").alias("greatest"))
    shared = stored(ends.where("least < greatest").select("token", "least"))
    rows = keyed.join(shared, "token").distinct()
    out = stored(rows.join(classes.select(F.col("c1").alias("cls"), "n"), "cls"))
    drop(shared)
    return out


def _bounded(pairs: DataFrame, sigs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) for which neither the short nor the whole signatures rule the threshold out.

    What the short ones leave is written, so that no task runs two kernels, and two Python workers, at once.
    """
    return _finely_bounded(_within_bound(pairs, sigs, percent, "mini"), sigs, percent)


def _finely_bounded(pairs: DataFrame, sigs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that the whole signatures leave; only the signatures of their ends are shuffled."""
    pairs = stored(pairs)
    ends = stored(pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).distinct())
    return _within_bound(pairs, sigs.join(small(ends), "cls", "left_semi"), percent, "sig")


def _within_bound(pairs: DataFrame, sigs: DataFrame, percent: int, sig: str) -> DataFrame:
    """The pairs (a, b) whose signatures leave room for the threshold."""

    def run(batches):
        for t in batches:
            keep = np.zeros(t.num_rows, bool)
            n, m = t["n"].to_numpy(), t["m"].to_numpy()
            p, q = t["p"].to_pylist(), t["q"].to_pylist()
            groups: dict[int, list[int]] = {}
            for r, (x, y) in enumerate(zip(p, q, strict=True)):
                groups.setdefault(min(len(x), len(y)), []).append(r)
            for width, rows in groups.items():
                step = max(1, (1 << 22) // width)
                for s in range(0, len(rows), step):
                    r = np.array(rows[s : s + step])
                    x, y = (np.stack([fold(v[i], 8 * width) for i in r]) for v in (p, q))
                    keep[r] = most_overlap(n[r], m[r], x, y) >= least_overlap(n[r], m[r], percent)
            yield pa.RecordBatch.from_arrays([t["a"], t["b"]], names=["a", "b"]).filter(pa.array(keep))

    left = sigs.select(F.col("cls").alias("a"), "n", F.col(sig).alias("p"))
    right = sigs.select(F.col("cls").alias("b"), F.col("n").alias("m"), F.col(sig).alias("q"))
    return map_arrow(pairs.join(left, "a").join(right, "b").select("a", "b", "n", "m", "p", "q"), run, "a long, b long")


def _verified(base: DataFrame, pairs: DataFrame, classes: DataFrame, k: int, percent: int, seed: int) -> DataFrame:
    """The pairs (a, b) that reach the threshold, by exact intersection of the sets of the whole texts."""

    def hashed(batches):
        for b in batches:
            cls = b.column(2).to_pylist()
            rows = [(i, s) for i, s in sets_of(b, k) if len(s) and class_of(s, seed)[0] == cls[i]]  # a key may stand for several texts
            yield pa.RecordBatch.from_arrays([pa.array([cls[i] for i, _ in rows], pa.int64()), pa.array([s.tobytes() for _, s in rows], pa.binary())], names=["cls", "set"])

    def check(batches):
        for t in batches:
            keep = np.zeros(t.num_rows, bool)
            for r, (x, y) in enumerate(zip(t["x"], t["y"], strict=True)):
                x, y = (np.frombuffer(v.as_buffer(), "<u8") for v in (x, y))
                c = len(np.intersect1d(x, y, assume_unique=True))
                keep[r] = 100 * c >= percent * (len(x) + len(y) - c)
            yield pa.RecordBatch.from_arrays([t["a"], t["b"]], names=["a", "b"]).filter(pa.array(keep))

    ends = pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).distinct()
    wanted = stored(ends.join(classes.select(F.col("c1").alias("cls"), "rep"), "cls").select(F.col("rep").alias("key"), "cls"))
    texts = base.join(small(wanted), "key").select("key", "text", "cls")
    sets = stored(map_arrow(texts, hashed, "cls long, set binary").dropDuplicates(["cls"]))
    both = pairs.join(sets.select(F.col("cls").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("cls").alias("b"), F.col("set").alias("y")), "b")
    out = stored(map_arrow(both.select("a", "b", "x", "y"), check, "a long, b long"))
    drop(wanted, sets)
    return out


def _near_in_size(n: str, m: str, percent: int):
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def _expanded(members: DataFrame, percent: int) -> DataFrame:
    """Pairs (a < b) in different components of blocks that fit one node."""
    x = members.select("token", F.col("cls").alias("a"), F.col("comp").alias("comp_a"), "n")
    y = members.select("token", F.col("cls").alias("b"), F.col("comp").alias("comp_b"), F.col("n").alias("m"))
    return x.join(y, "token").where((F.col("a") < F.col("b")) & (F.col("comp_a") != F.col("comp_b")) & _near_in_size("n", "m", percent)).select("a", "b").distinct()


def _parts(members: DataFrame) -> DataFrame:
    """``members(token, cls, comp, n, size)`` with ``own`` (its component where that has parts of its own, else null) and ``sub``."""
    of = stored(members.groupBy("token", "comp").agg(F.count("*").alias("here")).where(F.col("here") > PART))
    x = members.join(small(of), ["token", "comp"], "left")
    own = F.when(F.col("here").isNotNull(), F.col("comp"))
    sub = F.when(F.col("here").isNotNull(), F.pmod(F.xxhash64("cls"), F.ceil(F.col("here") / PART))).otherwise(F.pmod(F.xxhash64("comp"), F.ceil(F.col("size") / PART)))
    out = stored(x.select("token", "cls", "comp", "n", F.xxhash64(own, own.isNull(), sub).alias("part"), own.alias("own")))
    drop(of)
    return out


def _tiles(members: DataFrame, percent: int) -> DataFrame:
    """(g, side, cls, comp, n): one ``g`` for each pair of parts of a large block that may hold links."""
    cut = _parts(members)
    parts = cut.groupBy("token", "part").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.max("own").alias("own"))
    a, b = (parts.select("token", *[F.col(c).alias(f"{c}_{x}") for c in ("part", "lo", "hi", "own")]) for x in "ab")
    near = 100 * F.least("hi_a", "hi_b") >= percent * F.greatest("lo_a", "lo_b")
    pairs = stored(a.join(b, "token").where((F.col("part_a") <= F.col("part_b")) & near & ~F.coalesce(F.col("own_a") == F.col("own_b"), F.lit(False))).select("token", "part_a", "part_b"))
    g = F.xxhash64("token", "part_a", "part_b").alias("g")
    rows = ["cls", "comp", "n"]
    left = cut.join(pairs.withColumn("part", F.col("part_a")), ["token", "part"]).select(g, F.lit(0).alias("side"), *rows)
    right = cut.join(pairs.where("part_a < part_b").withColumn("part", F.col("part_b")), ["token", "part"]).select(g, F.lit(1).alias("side"), *rows)
    return left.union(right)


def _traversed(tiles: DataFrame, sigs: DataFrame, sig: str, percent: int, partners: int | None) -> DataFrame:
    """(a, b, held): pairs (a < b) that the traversal of each ``g`` offers, and whether it held others back."""

    def tile(t: pa.Table) -> pa.Table:
        cls = t["cls"].to_numpy()
        i, j, room = traverse(t, percent)
        held = False
        if partners is not None:
            keep = best_partners(i, j, room, partners)
            held, i, j = not keep.all(), i[keep], j[keep]
        a, b = cls[i], cls[j]
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b), "held": np.full(len(a), held)})

    rows = tiles.join(sigs.select("cls", F.col(sig).alias("sig")), "cls")
    return rows.select("g", "side", "cls", "comp", "n", "sig").groupBy("g").applyInArrow(tile, "a long, b long, held boolean")


def _offers_at_once(members: DataFrame, sigs: DataFrame, percent: int) -> DataFrame:
    """(a, b): all pairs of blocks of up to PART classes that the signatures leave.

    Blocks of a family share most classes, so blocks with the same least component are held in one tree, up to some
    4 * PART rows of them, in which a class stands once.
    """
    few = _expanded(members.where(F.col("size") <= FANOUT), percent)
    several = members.where((F.col("size") > FANOUT) & (F.col("size") <= PART))
    kin = stored(several.groupBy("c0").agg(F.count("*").alias("kin")))
    bins = max(1, (kin.agg(F.sum("kin")).first()[0] or 0) // (4 * PART))
    share = F.pmod(F.xxhash64("token", F.lit("share")), F.ceil(F.col("kin") / (4 * PART)))
    dealt = salted_join(several, kin, ["c0"], spread="token").select(F.pmod(F.xxhash64("c0", share), F.lit(bins)).alias("g"), F.lit(0).alias("side"), "cls", "comp", "n")
    walked = _traversed(dealt.distinct(), sigs, "mini", percent, None).select("a", "b")
    return _finely_bounded(_within_bound(few, sigs, percent, "mini").union(walked).distinct(), sigs, percent)


def _components(base: DataFrame, blocks: DataFrame, sigs: DataFrame, classes: DataFrame, k: int, percent: int, seed: int) -> DataFrame:
    """(id, component) of the classes that link."""
    stars = blocks.where("cls != least").select(F.col("least").alias("a"), F.col("cls").alias("b"), "n").distinct()
    stars = stars.join(classes.select(F.col("c1").alias("a"), F.col("n").alias("m")), "a").where(_near_in_size("n", "m", percent)).select("a", "b")
    tried = stored(_bounded(stars, sigs, percent))
    release(base.sparkSession)
    links = _verified(base, tried, classes, k, percent, seed)
    comp, partners = components(links), PARTNERS
    while True:
        members = _open(blocks, comp)
        offers = _traversed(_tiles(members.where(F.col("size") > PART), percent), sigs, "sig", percent, partners)
        if partners == PARTNERS:
            offers = offers.unionByName(_offers_at_once(members, sigs, percent).withColumn("held", F.lit(False)))
        offers = stored(offers.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("held").alias("held")))
        held = offers.where("held").limit(1).count() > 0
        known = tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        new = stored(offers.select("a", "b").join(known, ["a", "b"], "left_anti"))
        release(base.sparkSession)
        found = _verified(base, new, classes, k, percent, seed)
        if found.limit(1).count():
            comp = components(comp.select(F.col("id").alias("a"), F.col("component").alias("b")).union(found))
        drop(members, offers)
        if not held:
            return comp
        tried, partners = tried.union(new), 4 * partners


def _open(blocks: DataFrame, comp: DataFrame) -> DataFrame:
    """(token, cls, comp, n, size, c0) of the blocks that hold several components, of which c0 is the least."""
    named = blocks.join(comp.withColumnRenamed("id", "cls"), "cls", "left").select("token", "cls", "n", F.coalesce("component", "cls").alias("comp"))
    named = stored(named)
    ends = named.groupBy("token").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.count("*").alias("size"))
    held = stored(ends.where("c0 < c1").select("token", "size", "c0"))
    out = stored(named.join(held, "token"))
    drop(named, held)
    return out
