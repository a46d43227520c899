"""Retrieval quality on question sets whose haystacks are apart from each other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.text import tokens
from tidemark.operators.retrieval import K1, B

INSTANCE = (
    "question_id string, question string, haystack_session_ids array<string>, haystack_sessions array<array<struct<role:string,content:string,has_answer:boolean>>>, answer_session_ids array<string>"
)


def read_instances(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of instances."""
    return spark.read.schema(INSTANCE).option("multiLine", True).json(path)


def turns(instances: DataFrame) -> DataFrame:
    """``question_id, id, session_id, content, has_answer``: one row per turn; id is session and turn number."""
    s = instances.select("question_id", "haystack_session_ids", F.posexplode("haystack_sessions").alias("k", "turns"))
    t = s.select("question_id", F.element_at("haystack_session_ids", F.col("k") + 1).alias("session_id"), F.posexplode("turns").alias("n", "turn"))
    return t.select("question_id", F.concat_ws("#", "session_id", F.col("n").cast("string")).alias("id"), "session_id", F.col("turn.content").alias("content"), F.coalesce("turn.has_answer", F.lit(False)).alias("has_answer"))


def gold(instances: DataFrame, rows: DataFrame) -> DataFrame:
    """``question_id, id``: the turns marked as answers where a question has any, else all turns of its answer sessions.
    Questions without answer sessions are left out; one whose gold is not in its haystack keeps a null id, a miss."""
    asked = instances.where(F.size("answer_session_ids") > 0).select("question_id", "answer_session_ids")
    marked = rows.where("has_answer").select("question_id", "id")
    named = rows.join(asked.select("question_id", F.explode("answer_session_ids").alias("session_id")), ["question_id", "session_id"], "left_semi").select("question_id", "id")
    by_session = named.join(marked.select("question_id").distinct(), "question_id", "left_anti")
    found = marked.join(asked, "question_id", "left_semi").unionByName(by_session)
    lost = asked.select("question_id").join(found, "question_id", "left_anti").select("question_id", F.lit(None).cast("string").alias("id"))
    return found.unionByName(lost)


def ranked_turns(instances: DataFrame, rows: DataFrame) -> DataFrame:
    """``question_id, id, rank`` by BM25 inside each question's own haystack: statistics never mix between questions."""
    d = rows.select("question_id", "id", tokens(F.col("content")).alias("w")).withColumn("length", F.size("w"))
    each = d.groupBy("question_id").agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean"))
    terms = instances.select("question_id", F.explode(F.array_distinct(tokens(F.col("question")))).alias("term"))
    tf = d.select("question_id", "id", "length", F.explode("w").alias("term")).groupBy("question_id", "id", "length", "term").agg(F.count(F.lit(1)).alias("tf"))
    hit = tf.join(terms, ["question_id", "term"])
    df = hit.groupBy("question_id", "term").agg(F.count(F.lit(1)).alias("df"))
    s = hit.join(df, ["question_id", "term"]).join(each, "question_id")
    idf = F.greatest(F.lit(1e-6), F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    score = s.groupBy("question_id", "id").agg(F.sum(part).alias("score"))
    return score.select("question_id", "id", F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc(F.round("score", 9)), "id")).alias("rank"))
