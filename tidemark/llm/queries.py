"""Queries of the llm operators and, where SQL can say the same, their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.keys import normal_key, normal_label
from tidemark.llm.garble import garbled_rows, restored_texts
from tidemark.llm.groups import linked_groups
from tidemark.llm.neardup import member_pairs, similar_texts, text_classes
from tidemark.llm.packing import fill_containers, fill_report
from tidemark.llm.pii import personal_spans, redacted
from tidemark.llm.tokens import encode_corpus
from tidemark.llm.truncation import cut_report, cut_scores
from tidemark.llm.vectors import nearest, neighbour_pairs
from tidemark.sources.tables import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    memories = table(spark, folder, "memories", "id", "content").select(normal_key(F.col("id")).alias("id"), "content")
    return personal_spans(memories, "id", "content").select(F.col("id").alias("memory_id"), F.col("kind").alias("pii_kind"), F.col("value").alias("pii_value")).distinct()


def p1_redacted(spark: SparkSession, folder: str) -> DataFrame:
    memories = table(spark, folder, "memories", "id", "content").select(normal_key(F.col("id")).alias("memory_id"), "content")
    return redacted(memories, "content").distinct()


def _matches(spark: SparkSession, folder: str) -> DataFrame:
    edges = table(spark, folder, "edges", "src_id", "dst_id", "edge_type")
    return edges.where(normal_label(F.col("edge_type")) == "similarity").select(normal_key(F.col("src_id")).alias("a"), normal_key(F.col("dst_id")).alias("b"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return linked_groups(_matches(spark, folder), "a", "b").select("group_id", F.col("member_id").alias("memory_id"))


_P3 = """
WITH RECURSIVE e AS (
  SELECT DISTINCT lower(trim(src_id)) AS a, lower(trim(dst_id)) AS b FROM edges
  WHERE lower(trim(edge_type)) = 'similarity' AND trim(src_id) <> '' AND trim(dst_id) <> '' AND lower(trim(src_id)) <> lower(trim(dst_id))),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT a AS memory_id, a AS root FROM u UNION SELECT u.b, r.root FROM r JOIN u ON u.a = r.memory_id WHERE r.root < u.b)
"""

def _nearest(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "vec_memories", "memory_id", "embedding").withColumn("memory_id", normal_key(F.col("memory_id")))
    return nearest(vectors, "memory_id", "embedding", size=384, k=5)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return neighbour_pairs(_nearest(spark, folder))


def p5_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return _nearest(spark, folder)


def _cut_scores(spark: SparkSession, folder: str) -> DataFrame:
    memories = table(spark, folder, "memories", "id", "content", "source", "updated_at")
    keyed = memories.select(normal_key(F.col("id")).alias("id"), "content", normal_label(F.col("source")).alias("source"), "updated_at")
    return cut_scores(keyed, "id", "content", "source", "updated_at")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return _cut_scores(spark, folder).where("probability >= 0.5").select(F.col("id").alias("memory_id"))


def p6_report(spark: SparkSession, folder: str) -> DataFrame:
    return cut_report(_cut_scores(spark, folder))


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encode_corpus(table(spark, folder, "documents", "doc_id", "text"), "doc_id", "text")


def _containers(spark: SparkSession, folder: str) -> DataFrame:
    return fill_containers(p8_ids(spark, folder).select("doc_id", F.size("ids").alias("n_tokens")), "doc_id", "n_tokens", capacity=2048)


def p9_containers(spark: SparkSession, folder: str) -> DataFrame:
    return _containers(spark, folder)


def p9_report(spark: SparkSession, folder: str) -> DataFrame:
    return fill_report(_containers(spark, folder), 2048)


def _near_duplicates(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    memories = table(spark, folder, "memories", "id", "project_id", "content", "updated_at")
    keyed = memories.select(normal_key(F.col("id")).alias("id"), normal_key(F.col("project_id")).alias("project_id"), "content", "updated_at")
    texts, members = text_classes(keyed, "id", "content", "project_id", "updated_at")
    return texts, members, similar_texts(texts, width=3, threshold=0.5, least_words=45)


#: Every pair of a project compared.
_P4 = r"""
WITH m AS (SELECT * FROM (SELECT nullif(lower(trim(id)), '') AS id, nullif(lower(trim(project_id)), '') AS p, content, updated_at FROM memories)
  WHERE id IS NOT NULL AND p IS NOT NULL AND content IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC) = 1),
w AS (SELECT id, p, regexp_extract_all(lower(content), '[\p{L}\p{N}]+') AS w FROM m),
s AS (SELECT id, p, list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM w WHERE len(w) >= 45)
SELECT a.id AS a_id, b.id AS b_id FROM s a JOIN s b ON a.p = b.p AND a.id < b.id WHERE 3 * len(list_intersect(a.g, b.g)) >= len(a.g) + len(b.g)
"""


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    texts, members, pairs = _near_duplicates(spark, folder)
    return member_pairs(pairs, members, texts, least_words=45)


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return garbled_rows(table(spark, folder, "documents", "doc_id", "text"), "doc_id", "text").select("doc_id")


def p10_restored(spark: SparkSession, folder: str) -> DataFrame:
    return restored_texts(table(spark, folder, "documents", "doc_id", "text"), "doc_id", "text")


QUERIES = {"p1_found": p1_found, "p1_redacted": p1_redacted, "p3_found": p3_found, "p4_found": p4_found, "p5_found": p5_found, "p5_neighbours": p5_neighbours, "p6_found": p6_found, "p6_report": p6_report, "p8_ids": p8_ids, "p9_containers": p9_containers, "p9_report": p9_report, "p10_found": p10_found, "p10_restored": p10_restored}
ORACLE = {"p4_found": _P4, "p3_found": _P3 + "SELECT min(root) AS group_id, memory_id FROM (SELECT * FROM r UNION SELECT DISTINCT a, a FROM u) GROUP BY memory_id"}
