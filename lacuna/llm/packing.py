"""Operator 9: packing along a space-filling curve.

Each text gets a hashed vector (of its words), projected to few dimensions; the vector is quantised and its place on a
Hilbert curve is the sort key.  Documents are dealt to ranges of (curve place, hash of the document's key), whose number
follows the bytes of all texts, and each partition lays its documents' ids end to end along the curve, cutting where a
sequence is full.  The ids left over at the end of a partition are cut into sequences whose lengths are powers of two,
which need no padding.

Null and empty texts have only the end id.  Rows are packed one by one, repeated keys or not; ties on the curve are
broken by a hash of the key, then the key.  Extra columns are ignored; an empty table gives no piece.  A task holds one Arrow batch and at
most one sequence; equal texts share a curve key but are split by their keys.
"""

from __future__ import annotations

import functools
import itertools
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.llm.common import map_arrow, tokenizer
from lacuna.llm.words import CHUNK, slices_by_bytes, text_buffer, word_hashes, word_places

DIMS, BITS, SALT_BITS = 4, 10, 20
#: Bytes of texts that are encoded at once; a longer text stands alone.
STEP = 2 << 20


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Distance along the Hilbert curve of integer points (n, dims) below 2**bits, for all points at once.

    The bits are brought to Gray order from the highest down: where a coordinate has the bit, the lower bits of the
    first one are inverted, else they change places with its own; then the bits are interleaved.
    """
    x = points.astype(np.int64).T.copy()
    dims = len(x)
    for level in range(bits - 1, 0, -1):
        bit = 1 << level
        low = bit - 1
        for d in range(dims):
            has = (x[d] & bit) != 0
            swap = np.where(has, 0, (x[0] ^ x[d]) & low)
            x[0] ^= np.where(has, low, swap)
            x[d] ^= swap
    for d in range(1, dims):
        x[d] ^= x[d - 1]
    flip = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        flip ^= np.where(x[-1] & (1 << level), (1 << level) - 1, 0)
    x ^= flip
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for d in range(dims):
            key = (key << 1) | ((x[d] >> level) & 1)
    return key


def project(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Texts as points: per dimension the sum of their words' hashed weights over the root of the number of words.

    The words of text i are hashes[bounds[i]:bounds[i + 1]].
    """
    sums = np.zeros((len(hashes) + 1, DIMS))
    for d in range(DIMS):
        weights = ((hashes >> np.uint64(16 * d)) & np.uint64(0xFFFF)).astype(np.float64) / 32767.5 - 1
        np.cumsum(weights, out=sums[1:, d])
    return (sums[bounds[1:]] - sums[bounds[:-1]]) / np.sqrt(np.maximum(1, np.diff(bounds)))[:, None]


def curve_keys(df: DataFrame, ends: list[int] | None = None) -> DataFrame:
    """``df(k, t, salt)`` with ``h``: the place on the curve, then the salt, so that equal texts can be dealt out;
    and ``p``, the number of ``ends`` below it."""
    cuts = np.array(ends or [], np.int64)

    def run(batches):
        for b in batches:
            data, offsets = text_buffer(b.column(1))
            points = np.zeros((b.num_rows, DIMS))
            for i, j in slices_by_bytes(offsets, CHUNK):
                points[i:j] = project(*word_hashes(data, offsets[i : j + 1]))
            grid = np.clip(np.floor((np.tanh(points) + 1) * (1 << (BITS - 1))), 0, (1 << BITS) - 1)
            h = hilbert(grid) << SALT_BITS | b.column(2).to_numpy()
            p = np.searchsorted(cuts, h, side="left").astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(h), pa.array(p)], names=["k", "t", "h", "p"])

    kind = df.schema[0].dataType.simpleString()
    return map_arrow(df, run, f"k {kind}, t string, h long, p int")


def by_curve(df: DataFrame, task_bytes: int = 64 << 20, sample_rows: int = 20_000) -> DataFrame:
    """``df(k, t, salt)`` dealt to ranges of the curve and sorted.

    There is a range for every ``task_bytes`` of text, or for a smaller table as many as keep the cores busy.  Their ends
    are quantiles of the bytes of about ``sample_rows`` rows (20 a range if these are more) picked by hash: keys are
    computed once for every row and once more for the sample only, where a range shuffle would compute all twice.
    """
    whole = df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.octet_length("t")), F.lit(0)).alias("bytes")).first()
    n = max(1, -(-whole["bytes"] // task_bytes), min(3 * df.sparkSession.sparkContext.defaultParallelism, whole["bytes"] >> 20))
    rate = min(1.0, max(sample_rows, 20 * n) / max(1, whole["rows"]))
    some = curve_keys(df.where(F.pmod(F.xxhash64("salt", "k"), F.lit(1 << 30)) < int(rate * (1 << 30))))
    ends = some.agg(F.percentile("h", [i / n for i in range(1, n)], F.octet_length(F.coalesce("t", F.lit(""))) + 1)).first()[0] if n > 1 else None
    ends = [int(e) for e in ends or []]
    return curve_keys(df, ends).repartitionById(n, F.col("p")).sortWithinPartitions("h", "k")


#: Marks that are one pre-token after a word of letters: no apostrophe (contractions), none that a special string may hold.
_MARKS = b'!"#$%&()*+,-./:;=?@[\\]^_`{}~'


def _one_word(t: str) -> bool:
    """Whether the library, which composes and lowers first, sees letters only; it may split off a mark ("İ", "क़")."""
    return t.isascii() and t.isalpha() or unicodedata.normalize("NFC", t).lower().isalpha()


class Ids:
    """Ids of white-space separated words as the library gives them, looked up by the words' 64-bit hashes.

    The vocabulary's pre-tokens hold no white space and its special strings neither, so a text's ids are those of its
    words.  Known words stand as a sorted array of hashes beside their ids, some 30 bytes a word; beyond ``most`` words
    those met in one batch only go, or all if that is not enough.  (Of the words that one worker knows at a time two
    share a hash with a probability of about 1e-7.)
    """

    def __init__(self, path: str, most: int):
        self.encoder, self.most = tokenizer(path), most
        self.clear()
        vocab = self.encoder.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True

    def clear(self) -> None:
        self.hashes, self.start = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.length, self.batches = np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.ids, self.used = np.zeros(1 << 12, "<u4"), 0

    def shrink(self) -> None:
        """Forget the words that were met in one batch only, and all if the rest still fills half the room."""
        keep = self.batches > 1
        if keep.sum() > self.most // 2:
            self.clear()
            return
        length = self.length[keep].astype(np.int64)
        ids = self.ids[_ranges(self.start[keep], length)]
        self.hashes, self.length, self.batches = self.hashes[keep], self.length[keep], self.batches[keep] // 2
        self.start, self.ids, self.used = np.cumsum(length) - length, ids, len(ids)

    def _add(self, hashes: np.ndarray, encoded: list[bytes]) -> None:
        """New words, in order of their hashes."""
        ids = np.frombuffer(b"".join(encoded), "<u4")
        length = np.fromiter(map(len, encoded), np.int64, len(encoded)) // 4
        if self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.zeros(self.used + 2 * len(ids), "<u4")])
        self.ids[self.used : self.used + len(ids)] = ids
        at = np.searchsorted(self.hashes, hashes)
        self.start = np.insert(self.start, at, self.used + np.cumsum(length) - length)
        self.hashes, self.length, self.batches = (np.insert(x, at, v) for x, v in ((self.hashes, hashes), (self.length, length), (self.batches, 0)))
        self.used += len(ids)

    def of(self, data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds) of the texts data[offsets[i]:offsets[i + 1]]: those of text i are ids[bounds[i]:bounds[i + 1]].

        The vocabulary is lower case, so words are; ``lower`` is False for texts that may hold special strings, which are
        matched in their case.
        """
        hashes, starts, ends, bounds = word_places(data, offsets, lower)
        one, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.hashes) + len(one) > self.most:
            self.shrink()
        at = np.searchsorted(self.hashes, one)
        known = self.hashes[np.minimum(at, len(self.hashes) - 1)] == one if len(self.hashes) else np.zeros(len(one), bool)
        if not known.all():
            new = first[~known]
            base = int(offsets[0])
            raw = data[base : int(offsets[-1])].tobytes()
            raw = raw.lower() if lower else raw
            self._add(one[~known], self.encode([raw[s:e] for s, e in zip((starts[new] - base).tolist(), (ends[new] - base).tolist(), strict=True)]))
            at = np.searchsorted(self.hashes, one)
        self.batches[at] += 1
        place = at[which]
        length = self.length[place].astype(np.int64)
        return self.ids[_ranges(self.start[place], length)], np.r_[0, np.cumsum(length)][bounds]

    def encode(self, words: list[bytes]) -> list[bytes]:
        """Ids (little-endian bytes) of distinct words.

        Letters and the marks after them are separate pre-tokens, so only the parts of such words are encoded.
        """
        letters, other, split = set(), set(), {}
        for w in words:
            x = w.rstrip(_MARKS)
            if x.isalpha() or x and not x.isascii() and _one_word(x.decode()):
                letters.add(x)
                if len(x) < len(w):
                    split[w] = (x, w[len(x) :])
                    other.add(w[len(x) :])
            else:
                other.add(w)
        parts = self._letters(list(letters))
        parts.update(self._each(list(other)))
        return [parts[split[w][0]] + parts[split[w][1]] if w in split else parts[w] for w in words]

    def _each(self, words: list[bytes]) -> dict[bytes, bytes]:
        out = {}
        for i in range(0, len(words), 20_000):
            part = words[i : i + 20_000]
            got = self.encoder.encode_batch_fast([w.decode() for w in part], add_special_tokens=False)
            out.update((w, np.asarray(e.ids, "<u4").tobytes()) for w, e in zip(part, got, strict=True))
        return out

    def _letters(self, words: list[bytes], each: int = 1000) -> dict[bytes, bytes]:
        """Words of letters are one pre-token with one end mark: many are encoded as one text and told apart by the marks.

        Where their numbers differ (letters that the library doesn't know as such) the words are encoded one by one.
        """
        out = {}
        for i in range(0, len(words), 20 * each):
            part = words[i : i + 20 * each]
            joined = [b" ".join(part[j : j + each]).decode() for j in range(0, len(part), each)]
            ids = np.concatenate([np.asarray(e.ids, "<u4") for e in self.encoder.encode_batch_fast(joined, add_special_tokens=False)])
            ends = (np.flatnonzero(self.ends[ids]) + 1) * 4
            if len(ends) != len(part):
                out.update(self._each(part))
                continue
            data, start = ids.tobytes(), 0
            for w, end in zip(part, ends.tolist(), strict=True):
                out[w] = data[start:end]
                start = end
        return out


def _ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The places start[0], start[0] + 1, ... of all ranges one after the other."""
    before = np.cumsum(length) - length
    return np.repeat(start - before, length) + np.arange(int(length.sum()))


@functools.lru_cache(maxsize=2)
def shared_ids(path: str, most: int) -> Ids:
    return Ids(path, most)


def encoded(column: pa.Array, ids: Ids):
    """(row, ids) of each text; null is empty.  Texts that may hold special strings are encoded in their case."""
    special = pc.fill_null(pc.match_substring(column, "<|"), False).to_numpy(zero_copy_only=False)
    data, offsets = text_buffer(column)
    for a, b in slices_by_bytes(offsets, STEP):
        cut = np.flatnonzero(np.diff(special[a:b])) + a + 1
        for i, j in itertools.pairwise([a, *cut.tolist(), b]):
            flat, bounds = ids.of(data, offsets[i : j + 1], not special[i])
            for r in range(i, j):
                yield r, flat[bounds[r - i] : bounds[r - i + 1]]


def pack(df: DataFrame, path: str, text: str = "text", key: str = "doc_id", size: int = 2048, end_id: int = 1, most_words: int = 1_000_000) -> DataFrame:
    """One row a piece: (key, start, length, ids_crc32, doc_tokens, sequence_id, offset)."""
    end = np.asarray([end_id], "<u4").tobytes()

    def run(batches):
        from pyspark import TaskContext

        ids = shared_ids(path, most_words)
        sequence = TaskContext.get().partitionId() << 40
        used = 0
        held: list[tuple] = []  # pieces of the sequence that is being filled: (key, start, ids, doc_tokens)
        out: list[list] = [[] for _ in range(7)]

        def put(k, start, part, total, seq, offset):
            for c, v in zip(out, (k, start, len(part) // 4, zlib.crc32(part), total, seq, offset), strict=True):
                c.append(v)

        def flush(kind):
            arrays = [pa.array(out[0], kind), *[pa.array(c, pa.int64()) for c in out[1:]]]
            for c in out:
                c.clear()
            return pa.RecordBatch.from_arrays(arrays, names=[key, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        kind = None
        for b in batches:
            kind = b.column(0).type
            keys = b.column(0).to_pylist()
            for row, doc in encoded(b.column(1), ids):
                k, doc = keys[row], doc.tobytes() + end
                total, start = len(doc) // 4, 0
                while start < total:
                    take = min(size - used, total - start)
                    held.append((k, start, doc[4 * start : 4 * (start + take)], total))
                    start, used = start + take, used + take
                    if used == size:
                        offset = 0
                        for k2, s2, part, t2 in held:
                            put(k2, s2, part, t2, sequence, offset)
                            offset += len(part) // 4
                        held.clear()
                        sequence, used = sequence + 1, 0
            yield flush(kind)
        ids.shrink()
        if used:  # the rest, in lengths that are powers of two
            lengths = [1 << p for p in range(used.bit_length() - 1, -1, -1) if used >> p & 1]
            room, offset = lengths.pop(0), 0
            for k, start, part, total in held:
                while part:
                    now = part[: 4 * room]
                    put(k, start, now, total, sequence, offset)
                    n = len(now) // 4
                    part, start, room, offset = part[4 * n :], start + n, room - n, offset + n
                    if not room:
                        sequence, offset, room = sequence + 1, 0, lengths.pop(0) if lengths else 0
            yield flush(kind)

    salt = F.pmod(F.xxhash64(key, F.lit("curve")), F.lit(1 << SALT_BITS))
    base = df.select(F.col(key).alias("k"), F.col(text).alias("t"), salt.alias("salt"))
    dealt = by_curve(base).select("k", "t")
    name = df.schema[key].dataType.simpleString()
    return map_arrow(dealt, run, f"`{key}` {name}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
