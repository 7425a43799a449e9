"""Words whose normal form is not all letters, in packing."""

import random
import zlib

import numpy as np
import pyarrow as pa

from lacuna.llm import common, packing
from lacuna.llm.queries import vocabulary

SPLIT = ["İstanbul", "क़लम", "יִ", "क़", "x²", "½"]


def test_packing_words_with_marks(spark):
    path = vocabulary("word_bpe_49k.json")
    t = common.tokenizer(path)
    texts = [w + end for w in SPLIT for end in ("", ".", "?!", " plain words")] + ["Straße ΣΑΣ naïve Ǆ ﬁn été 日本.", "plain words. and, more!"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = packing.pack(df, path).collect()
    for k, x in enumerate(texts):
        ids = [*t.encode(x, add_special_tokens=False).ids, 1]
        mine = [r for r in rows if r["doc_id"] == k]
        assert sum(r["length"] for r in mine) == len(ids)
        for r in mine:
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes())


def test_words_that_the_marks_do_not_tell_apart(monkeypatch):
    path = vocabulary("word_bpe_49k.json")
    t = common.tokenizer(path)
    monkeypatch.setattr(packing, "_one_word", str.isalpha)
    ids = packing.Ids(path, 1000)
    words = ["İstanbul", "plain", "words"]
    assert ids.encode([w.encode() for w in words]) == [np.array(t.encode(w, add_special_tokens=False).ids, "<u4").tobytes() for w in words]


def test_ids_of_any_letters():
    """Every letter alone and beside others and marks, with more words than are kept."""
    path = vocabulary("word_bpe_49k.json")
    t, ids = common.tokenizer(path), packing.Ids(path, 4000)
    letters = [chr(c) for c in range(0x80, 0x11000) if chr(c).isalpha()]
    r = random.Random(4)
    texts = [f"{a}{b} {b}. x{a}!? {a}-{b} '{a}'s a{a}<|b" for a, b in zip(letters, r.sample(letters, len(letters)), strict=True)]
    texts += [" ".join(r.choice(letters + list(".,'!<|>#9 ")) for _ in range(30)) + " plain's <|endoftext|> it's ok..." for _ in range(200)]
    step, sizes = 400, []
    for i in range(0, len(texts), step):
        part = [*texts[i : i + step], None, "", "the same words. again and again."]
        want = [e.ids for e in t.encode_batch([x or "" for x in part], add_special_tokens=False)]
        got = dict(packing.encoded(pa.array(part), ids))
        assert [got[r].tolist() for r in range(len(part))] == want
        sizes.append(len(ids.hashes))
    assert any(b < a for a, b in zip(sizes, sizes[1:])) and max(sizes) < 4000 + 12 * step
