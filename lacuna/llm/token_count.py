"""Operator 1: token counts.

Arrow functions hand whole texts to the tokenizer library in batches and return
lengths only.  Texts are cut at safe boundaries: before white space that follows a
character which is not white space.  No pre-token of a byte-level vocabulary crosses such
a place and no special string holds white space, so the counts of the pieces add up to
the count of the text.  Pieces repeat heavily, so each worker keeps a bounded table of piece lengths and encodes only
new pieces, in batches balanced by bytes: handing whole texts to the library costs more CPU (the README has figures).
A text is cut whether it is long or not; the table needs some 150 bytes a piece.  White space is the only safe boundary
here, so a run without any is one piece however long, and is encoded at once.

Null text counts as empty: 0 bytes, 0 tokens.  Repeated rows give repeated rows; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from lacuna.llm.common import map_arrow, tokenizer

#: White space of the pre-tokenizer (Unicode White_Space); \x1c-\x1f count for Python only.
_PIECE = re.compile(r"(?:(?![\x1c-\x1f])\s)*(?:[^\s]|[\x1c-\x1f])+|(?:(?![\x1c-\x1f])\s)+")
_PIECE_FAST = re.compile(r"\s*\S+|\s+")
_ODD = re.compile(r"[\x1c-\x1f]")


def pieces(text: str) -> list[str]:
    """The text cut at all its safe boundaries."""
    return (_PIECE if _ODD.search(text) else _PIECE_FAST).findall(text)


class Lengths(dict):
    """Token counts by piece; new pieces are encoded in batches of about ``batch_bytes``; emptied beyond ``most`` pieces."""

    def __init__(self, path: str, batch_bytes: int, most: int):
        super().__init__()
        self.encoder, self.batch_bytes, self.most = tokenizer(path), batch_bytes, most

    def _encode(self, batch: list[str]) -> None:
        for p, e in zip(batch, self.encoder.encode_batch_fast(batch, add_special_tokens=False), strict=True):
            self[p] = len(e)

    def learn(self, cut: list[list[str]]) -> None:
        new = {p for p in set().union(*cut) if p not in self}  # set.difference would walk the whole table
        if len(self) + len(new) > self.most:
            self.clear()
            new = set().union(*cut)
        batch, size = [], 0
        for p in new:
            batch.append(p)
            size += len(p) + 16
            if size >= self.batch_bytes:
                self._encode(batch)
                batch, size = [], 0
        self._encode(batch)

    def counts(self, texts: list[str]) -> list[int]:
        """Token counts of a few texts; a long one goes in steps, so that memory follows ``batch_bytes``."""
        cut = [pieces(t) for t in texts]
        step = max(1000, self.batch_bytes // 4)
        if len(cut) == 1 and len(cut[0]) > step:
            total = 0
            for i in range(0, len(cut[0]), step):
                part = cut[0][i : i + step]
                self.learn([part])
                total += sum(map(self.__getitem__, part))
            return [total]
        self.learn(cut)
        return [sum(map(self.__getitem__, c)) for c in cut]


@functools.lru_cache(maxsize=2)
def shared_lengths(path: str, batch_bytes: int, most: int) -> Lengths:
    """One table a worker process, kept between its tasks."""
    return Lengths(path, batch_bytes, most)


def count_tokens(
    df: DataFrame,
    path: str,
    text: str = "text",
    key: str = "doc_id",
    limit: int = 512,
    batch_bytes: int = 1 << 18,
    most_pieces: int = 600_000,
) -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) of each row's whole text."""

    def run(batches):
        lengths = shared_lengths(path, batch_bytes, most_pieces)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            size_of = [len(t.encode()) for t in texts]
            n: list[int] = []
            start, size = 0, 0
            for i, x in enumerate(size_of):
                if i > start and size + x > batch_bytes:
                    n += lengths.counts(texts[start:i])
                    start, size = i, 0
                size += x
            n += lengths.counts(texts[start:])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(size_of, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                names=[key, "n_bytes", "n_tokens", "over_limit"],
            )

    kind = df.schema[key].dataType.simpleString()
    return map_arrow(df.select(key, text), run, f"`{key}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
