"""Operator 3: hierarchical language identification.

A softmax model picks the language family; inside a family one-versus-one linear support
vector machines vote.  Features are hashed byte 2- and 3-grams of the lower-cased
whole text.  Models learn on a bounded sample of labelled rows (``sample_rows`` in all, an equal
share a language) whose crc32(key as text) mod 3 is not 1; language label, source and key are no inputs
of a prediction.  Scores are calibrated on a part of the sample that the models did not see.

Null text, empty text and text without a letter give ``und`` with score 0.  Without any labelled
row every text gives ``und``.  Ties in votes go to the larger sum of margins.  Null keys are neither
learned from nor held out.  Extra columns are ignored; rows stay as they are, repeated or not.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lacuna.llm.boosting import platt
from lacuna.llm.common import drop, map_arrow, small, stored

#: Families of ISO 639-1 codes; a code that is not listed is a family of its own.
FAMILIES = {
    "germanic": "af da de en fy is lb nl nb nn no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "baltic": "lt lv",
    "celtic": "br cy ga gd",
    "uralic": "et fi hu",
    "turkic": "az kk ky tr tt uz",
    "indic": "bn gu hi mr ne pa si ur",
    "semitic": "ar he mt",
}
FAMILY_OF = {code: name for name, codes in FAMILIES.items() for code in codes.split()}
DIMS = 1 << 11
_ASCII_LETTER = re.compile("[A-Za-z]")
_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[:128] = [c if chr(c).isalpha() else 32 for c in range(128)]


def has_letter(text: str | None) -> bool:
    return bool(text) and (_ASCII_LETTER.search(text) is not None or any(map(str.isalpha, text)))


def features(text: str) -> np.ndarray:
    """Unit vector of square roots of hashed n-gram counts; long texts are counted in steps that overlap by the n-grams' length."""
    counts = np.zeros(DIMS, np.float32)
    step, seam = 1 << 19, b""
    for i in range(0, max(1, len(text)), step):
        data = text[i : i + step].lower().encode()
        b = _FOLD[np.frombuffer(seam + data, np.uint8)]
        skip, seam = len(seam), (seam + data)[-2:]
        two = b[:-1] * np.uint32(257) + b[1:]
        three = two[:-1] * np.uint32(65599) + b[2:] * np.uint32(7919)
        h2 = (two[max(0, skip - 1) :] * np.uint32(2654435761)) >> np.uint32(21)
        h3 = (three * np.uint32(2246822519)) >> np.uint32(21)
        counts += np.bincount(h2, minlength=DIMS).astype(np.float32) * np.float32(0.5)
        counts += np.bincount(h3, minlength=DIMS).astype(np.float32)
    counts = np.sqrt(counts)
    return counts / max(float(np.linalg.norm(counts)), 1e-9)


def _svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, epochs: int = 15) -> np.ndarray:
    """Linear L2-loss support vector machine by dual coordinate descent; the last weight is the offset."""
    x = np.hstack([x, np.ones((len(x), 1))]).astype(np.float64)
    w, a = np.zeros(x.shape[1]), np.zeros(len(x))
    q = (x * x).sum(1) + 0.5 / c
    rng = np.random.default_rng(7)
    for _ in range(epochs):
        for i in rng.permutation(len(x)):
            g = y[i] * (x[i] @ w) - 1 + a[i] * 0.5 / c
            new = max(a[i] - g / q[i], 0.0)
            if new != a[i]:
                w += (new - a[i]) * y[i] * x[i]
                a[i] = new
    return w


def _softmax(x: np.ndarray, y: np.ndarray, k: int, rounds: int = 300) -> np.ndarray:
    x = np.hstack([x, np.ones((len(x), 1))])
    w, one = np.zeros((x.shape[1], k)), np.eye(k)[y]
    v = np.zeros_like(w)
    for _ in range(rounds):
        z = x @ w
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        v = 0.9 * v - 4.0 * (x.T @ (p - one) / len(x) + 1e-5 * w)
        w += v
    return w


class LanguageModel:
    """Families, pairwise machines and calibration, as arrays whose size follows the number of languages only."""

    def __init__(self, x: np.ndarray, lang: list[str]):
        self.langs = sorted(set(lang))
        fam = sorted({FAMILY_OF.get(v, v) for v in self.langs})
        self.family_of = [fam.index(FAMILY_OF.get(v, v)) for v in self.langs]
        self.n_families = len(fam)
        y = np.array([self.langs.index(v) for v in lang], int)
        fit = np.arange(len(y)) % 4 != 0
        if fit.sum() < 8:
            fit[:] = True
        self.family_w = _softmax(x[fit], np.array(self.family_of)[y[fit]], self.n_families) if self.n_families > 1 else None
        self.pairs, weights, self.platt = [], [], []
        for i in range(len(self.langs)):
            for j in range(i + 1, len(self.langs)):
                if self.family_of[i] != self.family_of[j]:
                    continue
                m = (y == i) | (y == j)
                w = _svm(x[m & fit], np.where(y[m & fit] == i, 1.0, -1.0))
                held = m & ~fit if (m & ~fit).sum() >= 4 else m
                margin = x[held] @ w[:-1] + w[-1]
                self.platt.append(platt(margin, y[held] == i))
                self.pairs.append((i, j))
                weights.append(w)
        self.pair_w = np.array(weights).T.astype(np.float32) if weights else None
        if self.family_w is not None:
            self.family_w = self.family_w.astype(np.float32)

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(x)
        prob = np.ones((n, self.n_families))
        if self.family_w is not None:
            z = x @ self.family_w[:-1] + self.family_w[-1]
            prob = np.exp(z - z.max(1, keepdims=True))
            prob /= prob.sum(1, keepdims=True)
        family = prob.argmax(1)
        vote = np.zeros((n, len(self.langs)))
        least = np.ones((n, len(self.langs)))
        if self.pair_w is not None:
            z = x @ self.pair_w[:-1] + self.pair_w[-1]
            for k, (i, j) in enumerate(self.pairs):
                a, b = self.platt[k]
                p = 1 / (1 + np.exp(-np.clip(a * z[:, k] + b, -30, 30)))
                won = z[:, k] > 0
                vote[:, i] += won + 1e-3 * np.tanh(z[:, k])
                vote[:, j] += ~won - 1e-3 * np.tanh(z[:, k])
                least[:, i] = np.minimum(least[:, i], p)
                least[:, j] = np.minimum(least[:, j], 1 - p)
        vote[np.array(self.family_of)[None, :] != family[:, None]] = -np.inf
        best = vote.argmax(1)
        rows = np.arange(n)
        return best, np.clip(prob[rows, family] * least[rows, best], 0, 1)


def held_out(key: str) -> F.Column:
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def train(df: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", sample_rows: int = 4000) -> LanguageModel | None:
    """Learn from at most about ``sample_rows`` labelled rows that are not held out."""
    usable = df.where(F.col(key).isNotNull() & ~held_out(key) & F.col(lang).isNotNull() & F.col(text).isNotNull())
    counts = stored(usable.groupBy(F.col(lang).alias("__l")).agg(F.count("*").alias("__n")))
    share = F.greatest(F.lit(1.0), F.lit(float(sample_rows)) / F.greatest(F.lit(1), F.lit(counts.count())))
    die = F.pmod(F.xxhash64(F.col(key), F.lit("language")), F.lit(1 << 30)) / float(1 << 30)
    chosen = usable.join(small(counts.select("__l", (share / F.col("__n")).alias("__rate"))), F.col(lang) == F.col("__l"))
    chosen = chosen.where(die < F.col("__rate")).select(F.col(key).alias("k"), F.col(lang).alias("l"), F.col(text).alias("t"))

    def run(batches):
        for b in batches:
            texts = b.column(2).to_pylist()
            keep = [i for i, t in enumerate(texts) if has_letter(t)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(keep, pa.int64())), b.column(1).take(pa.array(keep, pa.int64())), pa.array([features(texts[i]).astype(np.float16).tobytes() for i in keep], pa.binary())],
                names=["k", "l", "v"],
            )

    kind = df.schema[key].dataType.simpleString()
    order = F.xxhash64("k", F.lit("language"))
    rows = map_arrow(chosen, run, f"k {kind}, l string, v binary").orderBy(order, "k", "l", "v").limit(2 * sample_rows).collect()
    drop(counts)
    if not rows:
        return None
    rows.sort(key=lambda r: (r["k"], r["l"], r["v"]))
    return LanguageModel(np.array([np.frombuffer(r["v"], np.float16) for r in rows], np.float32), [r["l"] for r in rows])


def predict(df: DataFrame, model: LanguageModel | None, text: str = "text", pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """All columns of ``df`` with the language in ``pred`` and its score in ``score`` (replacing columns of these names)."""
    df = df.drop(pred, score)
    schema = StructType(list(df.schema.fields)).add(pred, "string").add(score, "double")
    at = df.columns.index(text)

    def run(batches):
        for b in batches:
            langs, scores = ["und"] * b.num_rows, [0.0] * b.num_rows
            texts = b.column(at).to_pylist()
            for s in range(0, len(texts), 512):
                rows = [i for i in range(s, min(s + 512, len(texts))) if model is not None and has_letter(texts[i])]
                if rows:
                    best, p = model.predict(np.array([features(texts[i]) for i in rows]))
                    for i, k, v in zip(rows, best.tolist(), p.tolist(), strict=True):
                        langs[i], scores[i] = model.langs[k], v
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*b.schema.names, pred, score])

    return map_arrow(df, run, schema)


def identify(df: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", sample_rows: int = 4000) -> DataFrame:
    """Train on ``df`` and predict for all its rows: (key, held_out, lang_pred, score)."""
    model = train(df, text, lang, key, sample_rows)
    out = predict(df.select(key, text), model, text)
    return out.select(key, held_out(key).alias("held_out"), "lang_pred", "score")
