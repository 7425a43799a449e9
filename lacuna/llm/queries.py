"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.llm import embedding_dups, language, line_dedup, mixing, packing, personal_data, quality_rules, shingle_join, token_count, url_reputation
from lacuna.llm.common import table


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.scan(table(spark, sf_dir, "documents"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_rules.judge(docs, quality_rules.train(docs, table(spark, sf_dir, "labels")))


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.copies(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "rate", "copies")


def op6_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingle_join.jaccard_components(table(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed")


def op8_embedding_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dups.near_duplicates(table(spark, sf_dir, "embeddings"))


def op9_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op10_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    bad = labels.select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int").alias("bad"))
    return url_reputation.judge(table(spark, sf_dir, "pages"), bad)


QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_personal_data": op2_personal_data,
    "op3_language": op3_language,
    "op4_quality_rules": op4_quality_rules,
    "op5_source_mix": op5_source_mix,
    "op6_shingle_join": op6_shingle_join,
    "op7_line_dedup": op7_line_dedup,
    "op8_embedding_dups": op8_embedding_dups,
    "op9_curve_packing": op9_curve_packing,
    "op10_url_reputation": op10_url_reputation,
}

#: Transitive closure of links (x, y), both directions in e; every node of ``nodes`` reaches itself.
REACH = """e AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(id, other) AS (SELECT id, id FROM nodes UNION SELECT r.id, e.y FROM reach r JOIN e ON e.x = r.other)"""

ORACLE_SQL: dict[str, str] = {
    "op6_shingle_join": f"""
WITH RECURSIVE nodes AS (SELECT doc_id AS id FROM documents),
w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \\t\\n\\x0B\\f\\r]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' ')) END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
{REACH}
SELECT id AS doc_id, coalesce(any_value(n), 0) AS n_shingles, min(other) AS component_id FROM reach LEFT JOIN n ON n.doc_id = id GROUP BY id
""",
    "op8_embedding_dups": f"""
WITH RECURSIVE nodes AS (SELECT vec_id AS id FROM embeddings),
v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
      WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id < b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.9),
{REACH},
c AS (SELECT x, count(*) AS n FROM e GROUP BY x)
SELECT id AS vec_id, coalesce(any_value(n), 0) AS n_links, min(other) AS component_id, id = min(other) AS kept FROM reach LEFT JOIN c ON c.x = id GROUP BY id
""",
    "op7_line_dedup": """
WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, pos, array_to_string(lines[pos + 1 : pos + 3], chr(10)) AS w, least(len(lines), 3) AS n
      FROM (SELECT doc_id, lines, unnest(range(0, greatest(len(lines) - 3, 0) + 1)) AS pos FROM l)),
r AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY w, n ORDER BY doc_id, pos) AS k FROM w
      WHERE regexp_matches(w, '[^ \\t\\n\\x0B\\f\\r]')),
c AS (SELECT doc_id, list(pos) AS starts FROM r WHERE k > 1 GROUP BY doc_id),
k AS (SELECT l.doc_id, lines, CASE WHEN starts IS NULL THEN lines ELSE
        list_filter(lines, lambda x, i: NOT list_has_any(starts, [i - 1, i - 2, i - 3])) END AS kept
      FROM l LEFT JOIN c USING (doc_id))
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE array_to_string(kept, chr(10)) END AS text,
       CAST(coalesce(len(lines), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(lines) - len(kept), 0) AS BIGINT) AS n_removed
FROM documents d LEFT JOIN k USING (doc_id)
""",
}
