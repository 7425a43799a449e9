"""The pipeline's stages against brute force over small tables, and the whole run."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_operators import brute_groups, brute_lines, brute_targets, words

corpus_pipeline = pytest.importorskip("corpus_pipeline")

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, __n int"


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    """Real texts with copies, nulls, blanks, a long text, a repeated row, a null key and columns whose names clash."""
    from lacuna.llm.common import table

    rows = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in table(spark, sf_dir, "documents").orderBy("doc_id").collect()]
    base = words(1, 200, 9)
    lines = "\n".join(words(i, 12, 3) for i in (1, 2, 3, 4))
    extra = [None, "", " \n\t", "12 34 .", base, base, base.rsplit(" ", 3)[0] + " x y z", lines, lines + "\n" + words(9, 12, 3), "long text " * 30000]
    rows += [(10_000 + i, t, None, ["a", None][i % 2]) for i, t in enumerate(extra)]
    rows += [rows[0], (None, base, "en", "a"), (None, "a text without a key, in plain words of some length", "en", None)]
    return spark.createDataFrame([(*r, len(r[1] or ""), "clash", 7) for r in rows], SCHEMA).repartition(3)


def kept(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=lambda x: (x[0] is None, x))


def test_language_stage(spark, docs, sf_dir):
    out = corpus_pipeline.identify_language(spark, docs, sf_dir)
    assert out.columns == docs.columns and out.where("score != 'clash' or lang = 'und'").count() == 0
    before, after = Counter(kept_row for kept_row in kept(docs)), Counter(kept(out))
    letters = lambda t: bool(t) and any(map(str.isalpha, t))
    assert not after - before and all(letters(t) for _, t in after)
    clean = {x for x in before if x[0] is not None and x[0] < 10_000 and len(x[1]) > 200 and letters(x[1])}
    assert len(clean & set(after)) >= 0.98 * len(clean)


def test_line_stage(spark, docs, sf_dir):
    out = corpus_pipeline.dedup_lines(spark, docs, sf_dir)
    assert out.columns == docs.columns and out.where("length(text) != n_chars").count() == 0
    named = [(-1 if k is None else k, t) for k, t in kept(docs) if t is not None]  # null keys come first
    want = {k: t for k, t in brute_lines(named) if k >= 0}
    had = dict(named)
    got = [(k, t) for k, t in kept(out) if k is not None and t is not None]
    assert sorted(set(got)) == sorted((k, t) for k, t in want.items() if t == had[k] or re.search(r"[^\x20\x09-\x0D]", t))


def test_near_copy_stage(spark, docs, sf_dir):
    out = corpus_pipeline.join_near_copies(spark, docs, sf_dir)
    assert out.columns == docs.columns
    rows = kept(docs)
    stay = {k for k, _, c in brute_groups([r for r in rows if r[0] is not None], 5, 80) if c == k}
    assert kept(out) == [r for r in rows if r[0] is None or r[0] in stay]


def test_mixing_stage(spark, docs, sf_dir):
    out = corpus_pipeline.mix_sources(spark, docs, sf_dir)
    assert out.columns == docs.columns
    n = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    size, taken, most = Counter(), Counter(), Counter()
    for r in docs.collect():
        size[r["source"]] += n(r["text"])
        most[r["source"]] = max(most[r["source"]], n(r["text"]))
    rows = out.collect()
    for r in rows:
        taken[r["source"]] += n(r["text"])
    for s, want in brute_targets(dict(size)).items():
        assert abs(taken[s] - want) <= most[s]
    had = Counter(kept(docs))
    assert all(c <= 2 * had[x] for x, c in Counter((r["doc_id"], r["text"]) for r in rows).items())
    assert Counter(kept(corpus_pipeline.mix_sources(spark, docs.repartition(5), sf_dir))) == Counter((r["doc_id"], r["text"]) for r in rows)


def test_mixing_of_equal_rows(spark, sf_dir):
    """Nine equal rows, of which not all can be taken equally often."""
    rows = [(None, "one two three", "en", "a", 13, "", 0)] * 9 + [(1, "four five six seven", "en", "b", 19, "", 0), (2, None, "en", "c", 0, "", 0)]
    out = [r["text"] for r in corpus_pipeline.mix_sources(spark, spark.createDataFrame(rows, SCHEMA), sf_dir).collect()]
    want = brute_targets({"a": 27, "b": 4, "c": 0})
    assert abs(3 * out.count("one two three") - want["a"]) <= 1.5 + 1e-9 and out.count("four five six seven") == 2 and None not in out


def test_packing_stage(spark, docs, sf_dir):
    from lacuna.llm.common import tokenizer
    from lacuna.llm.queries import vocabulary

    t = tokenizer(vocabulary("word_bpe_49k.json"))
    pieces = {}
    for r in corpus_pipeline.pack_sequences(spark, docs, sf_dir).collect():
        pieces.setdefault(r["doc_id"], []).append(r)
    texts = {}
    for k, x in kept(docs):
        texts.setdefault(k, []).append([*t.encode(x or "", add_special_tokens=False).ids, 1])
    assert set(pieces) == set(texts)
    for k, ids in texts.items():
        assert sum(r["length"] for r in pieces[k]) == sum(map(len, ids))
        if k is not None:
            assert all(r["ids_crc32"] == zlib.crc32(np.array(ids[0][r["start"] : r["start"] + r["length"]], "<u4").tobytes()) for r in pieces[k])


def test_stages_of_empty_tables(spark, docs, sf_dir):
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs.limit(0), sf_dir)
        assert out.count() == 0 and (name == "pack" or out.columns == docs.columns)


def test_run(spark, sf_dir):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "line_dedup", "shingle_join", "mix", "pack"]
    out = corpus_pipeline.run(spark, sf_dir)
    sums = out.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    assert out.count() > 0 and sums.where("n > 2048").count() == 0
