"""The queries opN_* over the whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rangeloom.llm import jaccard, langid, quality, toxicity
from rangeloom.llm.bpe import bpe_digest
from rangeloom.llm.chat import chat_digest
from rangeloom.llm.common import table
from rangeloom.llm.covertree import near_pairs
from rangeloom.llm.lmscore import cross_entropy_difference
from rangeloom.llm.packing import pack_documents
from rangeloom.llm.topk import quantised, top_k


def op1_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_pairs(table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents", "doc_id", "text"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "toxic")
    return toxicity.classify(docs, labels)


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents", "doc_id", "text"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digest(table(spark, sf_dir, "documents", "doc_id", "text"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents", "doc_id", "text", "lang"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "quality")
    return quality.classify(docs, labels)


def op8_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quantised(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))
    return top_k(rows.filter("vec_id % 50 = 0"), rows)


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat_digest(rows.unionByName(more))


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels", "doc_id", "quality").withColumnRenamed("quality", "target")
    return cross_entropy_difference(table(spark, sf_dir, "documents", "doc_id", "text"), labels)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_embedding_neardup": op1_embedding_neardup,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_toxicity": op3_toxicity,
    "op4_ngram_jaccard": op4_ngram_jaccard,
    "op5_bpe": op5_bpe,
    "op6_language_id": op6_language_id,
    "op7_quality": op7_quality,
    "op8_topk_search": op8_topk_search,
    "op9_chat_format": op9_chat_format,
    "op10_lm_score": op10_lm_score,
}

ORACLE_SQL: dict[str, str] = {
    "op1_embedding_neardup": """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
)
SELECT v.vec_id, (SELECT count(*) FROM links WHERE links.a = v.vec_id) AS n_links,
       (SELECT min(b) FROM reach WHERE reach.a = v.vec_id) AS component_id,
       v.vec_id = (SELECT min(b) FROM reach WHERE reach.a = v.vec_id) AS kept
FROM v
""",
    "op8_topk_search": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
""",
    "op9_chat_format": r"""
WITH rows AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), marked AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text) AS k,
         lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text) AS before,
         length(text) + length(text) - length(replace(replace(replace(text, '\', ''), '<', ''), '#', '')) AS escaped
  FROM rows
)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY k), '')) AS loss_sha256,
       CAST(sum(4 + length(role) + 2 + escaped + 8) AS BIGINT) AS formatted_chars,
       bool_and(CASE WHEN role = 'system' THEN before IS NULL OR before = 'system'
                     WHEN role = 'user' THEN before IS NULL OR before IN ('system', 'assistant')
                     WHEN role = 'assistant' THEN coalesce(before = 'user', false) ELSE false END)
         AND max_by(role, k) IN ('assistant', 'user') AS valid
FROM marked GROUP BY conv_id
""",
}
