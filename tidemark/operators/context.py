"""Text within a budget, byte savings, and lists of memories."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import DEFAULTS
from tidemark.functions.metadata import has_tag
from tidemark.functions.scoring import context_score, days_between
from tidemark.functions.text import compress


def ranked_context(memories: DataFrame, as_of: datetime, candidates: int = DEFAULTS.context_candidates, by: str = "project_id") -> DataFrame:
    """Each project's newest ``candidates`` memories by context score: adds ``text`` (a rewrite if there is one), ``score``
    and ``rn``."""
    newest = Window.partitionBy(by).orderBy(F.desc("created_at"), "id")
    r = memories.where(F.col(by).isNotNull()).withColumn("__new", F.row_number().over(newest)).where(F.col("__new") <= candidates).drop("__new")
    score = context_score(F.coalesce("importance", F.lit(0.0)), days_between(F.lit(as_of), F.col("created_at")), F.coalesce("access_count", F.lit(0)), F.coalesce("strength", F.lit(1.0)))
    r = r.withColumn("score", score).withColumn("text", F.coalesce("compressed_content", "content", F.lit("")))
    return r.withColumn("rn", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), "id")))


def within_budget(ranked: DataFrame, budget: int, length: Column, by: str = "project_id", rank: str = "rn") -> DataFrame:
    """The ranked prefix whose running length stays within the budget; the first row always stays."""
    run = F.sum(length).over(Window.partitionBy(by).orderBy(rank).rowsBetween(Window.unboundedPreceding, 0))
    return ranked.withColumn("used", run).where((F.col("used") <= budget) | (F.col(rank) == 1))


def project_context(memories: DataFrame, as_of: datetime, tokens: int = DEFAULTS.context_tokens, candidates: int = DEFAULTS.context_candidates) -> DataFrame:
    """``project_id, n_memories, context`` under ``tokens`` of four bytes each."""
    budget = tokens * DEFAULTS.chars_per_token
    kept = within_budget(ranked_context(memories, as_of, candidates), budget, F.octet_length("text"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rn", "text"))), lambda x: x["text"]), "\n")
    return kept.groupBy("project_id").agg(F.count(F.lit(1)).alias("n_memories"), F.substring(text, 1, budget).alias("context"))


def token_savings(memories: DataFrame, newest: int | None = 200) -> DataFrame:
    """Bytes before and after compression of the newest rows (None: of all), and the share saved."""
    r = memories.where(F.col("content").isNotNull())
    r = r if newest is None else r.orderBy(F.desc("created_at"), "id").limit(newest)
    sums = r.select(F.octet_length("content").alias("a"), F.octet_length(F.coalesce("compressed_content", compress("content"))).alias("b")).agg(F.count(F.lit(1)).alias("n_rows"), F.sum("a").alias("before"), F.sum("b").alias("after"))
    return sums.withColumn("saved", F.round(F.lit(1.0) - F.col("after") / F.col("before"), 6))


def memory_page(memories: DataFrame, limit: int, offset: int = 0, project_id: str | None = None, memory_type: str | None = None) -> DataFrame:
    """A page, newest first, of the rows that match, with the number of all that match."""
    r = memories
    if project_id is not None:
        r = r.where(F.col("project_id") == project_id)
    if memory_type is not None:
        r = r.where(F.col("memory_type") == memory_type)
    total = r.agg(F.count(F.lit(1)).alias("total"))
    return r.orderBy(F.desc("created_at"), "id").offset(offset).limit(limit).crossJoin(F.broadcast(total))  # one row each


def memory_stats(memories: DataFrame, edges: DataFrame, projects: DataFrame, jobs: DataFrame) -> DataFrame:
    """``kind, name, n``: totals, and memories by type and by tier."""
    one = lambda df, name: df.agg(F.lit("total").alias("kind"), F.lit(name).alias("name"), F.count(F.lit(1)).alias("n"))
    by = lambda c: memories.groupBy(F.lit(c).alias("kind"), F.col(c).alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return one(memories, "memories").unionByName(one(edges, "edges")).unionByName(one(projects, "projects")).unionByName(one(jobs.where("status = 'pending'"), "pending_jobs")).unionByName(by("memory_type")).unionByName(by("tier"))


def with_project_names(memories: DataFrame, projects: DataFrame) -> DataFrame:
    """``memories`` with ``project_name``; null where the project or its name is unknown."""
    names = projects.groupBy("id").agg(F.max("name").alias("project_name"))
    return memories.join(names.withColumnRenamed("id", "project_id"), "project_id", "left")


def projects_by_last_seen(projects: DataFrame, memories: DataFrame) -> DataFrame:
    """``id, name, last_seen_at, n_memories, rank``: projects, the one seen last first, with their number of memories."""
    once = projects.groupBy("id").agg(F.max(F.struct("last_seen_at", "name")).alias("p")).select("id", F.col("p.name").alias("name"), F.col("p.last_seen_at").alias("last_seen_at"))
    n = memories.where(F.col("project_id").isNotNull()).groupBy(F.col("project_id").alias("id")).agg(F.count(F.lit(1)).alias("n_memories"))
    found = once.join(n, "id", "left").withColumn("n_memories", F.coalesce("n_memories", F.lit(0)))
    return found.withColumn("rank", F.row_number().over(Window.orderBy(F.desc_nulls_last("last_seen_at"), "id")))  # one row per project


def latest_session_summary(memories: DataFrame, tag: str) -> DataFrame:
    """``project_id, id, content``: each project's newest memory with the tag."""
    tagged = memories.where(F.col("project_id").isNotNull() & has_tag(F.col("metadata"), tag))
    newest = F.max(F.struct("created_at", "id", "content")).alias("n")
    return tagged.groupBy("project_id").agg(newest).select("project_id", F.col("n.id").alias("id"), F.col("n.content").alias("content"))
