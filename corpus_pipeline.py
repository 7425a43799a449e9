"""A training corpus from ``documents`` in five stages, each one of the operators in lacuna.llm.

Language ID, line dedup, n-gram Jaccard join, mixing to target weights, packing.  Each stage reads what its predecessor
kept, written as Parquet in the folder that all machines share; all but the last return the columns of ``documents``,
and extra columns travel along whatever their names.

Null and empty texts, and texts without a letter, have no language and go in the first stage.  Rows with a null key are
no copies of each other and stay.  Repeated rows are one document for line dedup and the Jaccard join (both rows stay
or go) and are mixed and packed one by one.  Ties go to the least key.  An empty table gives no piece.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.llm import language, line_dedup, mixing, packing, shingle_join
from lacuna.llm.common import drop, release, small, stored, table
from lacuna.llm.queries import vocabulary

#: Below this score a prediction counts as none; clean documents score far above.
LEAST_SCORE = 0.2


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language is recognised and write it to ``lang``."""
    found = language.predict(docs, language.train(docs), pred="__lang", score="__score")
    kept = found.where((F.col("__lang") != "und") & (F.col("__score") >= LEAST_SCORE))
    return kept.withColumn("lang", F.col("__lang")).select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove repeated passages of lines; a document of which nothing is left goes."""
    out = line_dedup.dedup_lines(docs, prefix="__").where((F.col("__n_removed") == 0) | F.col("text").rlike(line_dedup.BLANK))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def join_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the least id of each group of near copies (five-word shingles, 0.8)."""
    groups = shingle_join.jaccard_components(docs, k=5, percent=80)
    later = stored(groups.where("component_id != doc_id").select("doc_id").distinct())
    release(spark)
    return docs.join(small(later), "doc_id", "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat and drop documents so that each source comes to its target."""
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens along the curve."""
    return packing.pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("language", identify_language),
    ("line_dedup", dedup_lines),
    ("shingle_join", join_near_copies),
    ("mix", mix_sources),
    ("pack", pack_sequences),
]

#: Learned models and tokenization have no SQL; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        kept = stored(stage(spark, docs, sf_dir))
        drop(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
