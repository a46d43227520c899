"""Forgetting, tiering, consolidation and the pipeline over memories."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import DEFAULTS, Lifecycle
from tidemark.functions.metadata import has_tag, tool_name
from tidemark.functions.scoring import days_between, forgetting_strength
from tidemark.functions.text import ellipsis
from tidemark.operators.edges import threshold_edges
from tidemark.operators.sessions import numbered
from tidemark.operators.traverse import components

SUMMARY_TAG = "session-summary"


def updated_strengths(memories: DataFrame, lineage: DataFrame, as_of: datetime) -> DataFrame:
    """``id, strength``: forgetting curve for plain memories, the greatest of its children (0 without) for a decoy."""
    own = memories.where(~F.col("is_decoy")).select("id", forgetting_strength(F.col("created_at"), F.col("accessed_at"), F.col("access_count"), F.lit(as_of)).alias("strength"))
    above = lineage.join(own.withColumnRenamed("id", "child_id"), "child_id").groupBy(F.col("decoy_id").alias("id")).agg(F.max("strength").alias("strength"))
    decoys = memories.where("is_decoy").select("id").join(above, "id", "left").select("id", F.coalesce("strength", F.lit(0.0)).alias("strength"))
    return own.unionByName(decoys)


def cold_candidates(memories: DataFrame, as_of: datetime, conf: Lifecycle = DEFAULTS.lifecycle) -> DataFrame:
    """Plain, not cold, weak, old enough and hardly used."""
    return memories.where(~F.col("is_decoy") & (F.col("tier") != "cold") & (F.col("strength") < conf.min_strength) & (days_between(F.lit(as_of), F.col("created_at")) >= conf.cold_age_days) & (F.col("access_count") < conf.cold_access))


def consolidation_candidates(memories: DataFrame, conf: Lifecycle = DEFAULTS.lifecycle) -> DataFrame:
    return memories.where(F.col("project_id").isNotNull() & ~F.col("is_decoy") & (F.col("strength") < conf.consolidation_threshold) & (F.col("tier") != "cold"))


def decay_actions(memories: DataFrame, lineage: DataFrame, as_of: datetime, conf: Lifecycle = DEFAULTS.lifecycle) -> DataFrame:
    """``id, action``: archive where a summary holds the memory, prune where nothing does and it is nearly forgotten, else
    keep. Nothing is deleted; both actions mean the cold tier."""
    c = cold_candidates(memories, as_of, conf).select("id", "strength", "access_count", "project_id")
    held = lineage.select(F.col("child_id").alias("id"), F.lit(True).alias("held")).distinct()
    nearly = (F.col("strength") < conf.prune_strength) & (F.col("access_count") == 0) & F.col("project_id").isNotNull()
    return c.join(held, "id", "left").select("id", F.when(F.col("held"), "archive").when(nearly, "prune").otherwise("keep").alias("action"))


def clusters(vectors: DataFrame, id_col: str, vector_col: str, size: int, threshold: float = DEFAULTS.lifecycle.cluster_threshold, min_size: int = DEFAULTS.lifecycle.min_cluster) -> DataFrame:
    """``id, component`` of the single-linkage clusters at ``threshold`` of at least ``min_size`` members."""
    label = components(threshold_edges(vectors, id_col, vector_col, size, threshold))
    big = label.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_size).select("component")
    return label.join(big, "component", "left_semi")


def cohesion(cluster: DataFrame, vectors: DataFrame, id_col: str, vector_col: str, size: int) -> DataFrame:
    """``component, cohesion``: the mean cosine of all pairs inside a cluster, 1 for less than two members.

    From sums instead of pairs: the pairs' cosines add up to (|sum of unit vectors|^2 - n) / 2.
    """
    v = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")).join(cluster, "id")
    n = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    parts = v.select("component", "id", F.posexplode(F.transform("v", lambda x: x / n)).alias("k", "x"))
    sums = parts.groupBy("component", "k").agg(F.sum("x").alias("s"), F.count(F.lit(1)).alias("n"))
    total = sums.groupBy("component").agg(F.sum(F.col("s") * F.col("s")).alias("q"), F.max("n").alias("n"))
    return total.select("component", F.when(F.col("n") < 2, F.lit(1.0)).otherwise((F.col("q") - F.col("n")) / (F.col("n") * (F.col("n") - 1))).alias("cohesion"))


def cluster_summaries(cluster: DataFrame, memories: DataFrame, most: int = 280) -> DataFrame:
    """``component, n_children, importance, summary``: the content of the most important member (of equal ones the last
    id), cut to ``most`` characters; importance is the members' greatest, at least 0."""
    m = cluster.join(memories.select("id", "content", "importance"), "id")
    best = F.max(F.struct(F.coalesce("importance", F.lit(0.0)), "id", F.trim("content").alias("content"))).alias("best")
    return m.groupBy("component").agg(F.count(F.lit(1)).alias("n_children"), F.greatest(F.lit(0.0), F.max("importance")).alias("importance"), best).select("component", "n_children", "importance", ellipsis(F.col("best.content"), most).alias("summary"))


def consolidate(candidates: DataFrame, vectors: DataFrame, size: int, conf: Lifecycle = DEFAULTS.lifecycle, children: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Summary rows, their lineage (decoy_id, child_id), and the children's new tier. Rows that are children already
    (``children``: child_id) are left out, so that a second run makes nothing new."""
    c = candidates if children is None else candidates.join(children.select(F.col("child_id").alias("id")), "id", "left_anti")
    v = vectors.join(c.select(F.col("id").alias("memory_id")), "memory_id", "left_semi")
    cluster = clusters(v, "memory_id", "embedding", size, conf.cluster_threshold, conf.min_cluster)
    rows = cluster_summaries(cluster, c).join(cohesion(cluster, v, "memory_id", "embedding", size), "component")
    rows = rows.select(F.sha2(F.concat(F.lit("decoy:"), F.col("component")), 256).alias("id"), F.col("summary").alias("content"), "importance", "cohesion", "n_children", F.col("component"))
    lineage = cluster.join(rows.select("component", F.col("id").alias("decoy_id")), "component").select("decoy_id", F.col("id").alias("child_id"))
    tiers = lineage.join(c.select(F.col("id").alias("child_id"), "strength", "project_id"), "child_id")
    tiers = tiers.select(F.col("child_id").alias("id"), F.when((F.col("strength") < conf.consolidation_threshold) & F.col("project_id").isNotNull(), "cold").otherwise("warm").alias("tier"))
    return rows.drop("component"), lineage, tiers


def summary_members(memories: DataFrame, conf: Lifecycle = DEFAULTS.lifecycle, by: str = "project_id") -> DataFrame:
    """The rows that a project's session summary is made of, with their place ``t`` in it."""
    plain = memories.where(~F.col("is_decoy") & ~F.coalesce(has_tag(F.col("metadata"), SUMMARY_TAG), F.lit(False)) & F.col(by).isNotNull())
    newest = Window.partitionBy(by).orderBy(F.desc("created_at"), "id")
    r = plain.withColumn("r", F.row_number().over(newest)).where(F.col("r") <= conf.summary_window)
    top = Window.partitionBy(by).orderBy(F.desc("importance"), "id")
    return r.withColumn("t", F.row_number().over(top)).where(F.col("t") <= conf.summary_top)


def session_summaries(memories: DataFrame, conf: Lifecycle = DEFAULTS.lifecycle, most: int = 2000, by: str = "project_id") -> DataFrame:
    """``project, n_rows, summary``: of each project's newest plain memories the most important ones, joined."""
    r = summary_members(memories, conf, by)
    texts = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("t", F.coalesce("content", F.lit("")).alias("c")))), lambda x: x["c"]), "\n---\n")
    return r.groupBy(F.col(by).alias("project_id")).agg(F.count(F.lit(1)).alias("n_rows"), F.substring(texts, 1, most).alias("summary"))


#: Rows of one key that are looked at in one task for runs of steps.
STRETCH = 10_000


def frequent_sequences(rows: DataFrame, by: str, order: list[str], step: str, n: int = DEFAULTS.lifecycle.ngram, support: int = DEFAULTS.lifecycle.ngram_support, top: int | None = DEFAULTS.lifecycle.ngram_top, least_rows: int = DEFAULTS.lifecycle.ngram_min_rows, stretch: int = STRETCH) -> DataFrame:
    """``by, gram, n_times, rank``: runs of ``n`` steps that occur at least ``support`` times, the ``top`` per key.

    The rows of a key, in the order of a time and then of what follows it in ``order``, are cut into stretches that also
    hold the first rows of the next one: runs over a border are found once, and no task sees all rows of a key.
    """
    r = numbered(rows, (by,), order).where(F.col("__of") >= least_rows).select(by, F.col(step).alias("__step"), "__no")
    own = F.floor(F.col("__no") / stretch)
    again = (F.col("__no") % stretch < n - 1) & (own > 0)
    r = r.select(by, "__step", "__no", F.explode(F.when(again, F.array(own, own - 1)).otherwise(F.array(own))).alias("__part"))
    along = Window.partitionBy(by, "__part").orderBy("__no")
    grams = r.select(by, "__part", "__no", *[F.lead("__step", k).over(along).alias(f"g{k}") for k in range(n)])
    grams = grams.where((F.floor(F.col("__no") / stretch) == F.col("__part")) & F.col(f"g{n - 1}").isNotNull())
    counted = grams.select(by, F.concat_ws(" > ", *[f"g{k}" for k in range(n)]).alias("gram")).groupBy(by, "gram").agg(F.count(F.lit(1)).alias("n_times")).where(F.col("n_times") >= support)
    ranked = counted.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("n_times"), "gram")))
    return ranked if top is None else ranked.where(F.col("rank") <= top)


def sequence_rows(rows: DataFrame, by: str, order: list[str], step: str, n: int, id_col: str = "id") -> DataFrame:
    """``by, gram, id``: every row of every occurrence of every run of ``n`` steps."""
    along = Window.partitionBy(by).orderBy(*order)
    grams = rows.select(by, *[F.lead(step, k).over(along).alias(f"g{k}") for k in range(n)], F.array(*[F.lead(id_col, k).over(along) for k in range(n)]).alias("ids")).where(F.col(f"g{n - 1}").isNotNull())
    return grams.select(by, F.concat_ws(" > ", *[f"g{k}" for k in range(n)]).alias("gram"), F.explode("ids").alias("id")).distinct()


def code_steps(memories: DataFrame, newest: int = 200) -> DataFrame:
    """Each project's newest code memories with the ``tool`` of each."""
    recent = Window.partitionBy("project_id").orderBy(F.desc("created_at"), "id")
    code = memories.where((F.col("memory_type") == "code_context") & F.col("project_id").isNotNull()).withColumn("r", F.row_number().over(recent)).where(F.col("r") <= newest)
    return code.withColumn("tool", tool_name(F.col("metadata"), F.col("content")))


def procedures(memories: DataFrame, conf: Lifecycle = DEFAULTS.lifecycle, newest: int = 200) -> DataFrame:
    """Frequent tool sequences in each project's newest code memories."""
    code = code_steps(memories, newest)
    return frequent_sequences(code, "project_id", ["created_at", "id"], "tool", conf.ngram, conf.ngram_support, conf.ngram_top, conf.ngram_min_rows)


def pipeline_rows(memories: DataFrame, vectors: DataFrame, size: int, as_of: datetime, conf: Lifecycle = DEFAULTS.lifecycle, newest: int = 200) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (``id, project_id, memory_type, content, importance, created_at, is_decoy``) that the three stages make over
    all projects, their lineage (``decoy_id, child_id``), and ``summarizes`` edges from each session summary to the rows
    it was made of.

    A stage's row has the same id each time for the same project and content, so that a second run makes nothing new.
    """
    made = lambda kind, *parts: F.sha2(F.concat_ws(":", F.lit(kind), *parts), 256)
    row = lambda df, kind, importance: df.select("id", "project_id", F.lit(kind).alias("memory_type"), "content", importance.alias("importance"), F.lit(as_of).alias("created_at"), F.lit(True).alias("is_decoy"))
    newest_first = Window.partitionBy("project_id").orderBy(F.desc("created_at"), "id")

    top = summary_members(memories, conf)
    summaries = session_summaries(memories, conf).select(made("summary", "project_id", "summary").alias("id"), "project_id", F.col("summary").alias("content"))
    held = top.select("project_id", F.col("id").alias("child_id")).join(summaries.select("project_id", F.col("id").alias("decoy_id")), "project_id")
    edges = held.select(F.col("decoy_id").alias("src_id"), F.col("child_id").alias("dst_id"), F.lit("summarizes").alias("edge_type"), F.lit(None).cast("string").alias("label"), F.lit(1.0).alias("weight"))

    episodic = memories.where((F.col("memory_type") == "episodic") & ~F.col("is_decoy") & F.col("project_id").isNotNull()).withColumn("r", F.row_number().over(newest_first)).where(F.col("r") <= newest).drop("r")
    facts, facts_held, _ = consolidate(episodic, vectors, size, conf)
    fact_project = facts_held.join(episodic.select(F.col("id").alias("child_id"), "project_id"), "child_id").groupBy(F.col("decoy_id").alias("id")).agg(F.min("project_id").alias("project_id"))
    facts = facts.join(fact_project, "id")

    code = code_steps(memories, newest)
    grams = frequent_sequences(code, "project_id", ["created_at", "id"], "tool", conf.ngram, conf.ngram_support, conf.ngram_top, conf.ngram_min_rows)
    grams = grams.select(made("procedure", "project_id", "gram").alias("id"), "project_id", F.col("gram").alias("content"))
    occurring = sequence_rows(code, "project_id", ["created_at", "id"], "tool", conf.ngram)
    gram_held = occurring.withColumnRenamed("gram", "content").join(grams.select(F.col("id").alias("decoy_id"), "project_id", "content"), ["project_id", "content"]).select("decoy_id", F.col("id").alias("child_id"))

    rows = row(summaries, "episodic", F.lit(0.6)).unionByName(row(facts, "semantic", F.col("importance"))).unionByName(row(grams, "procedural", F.lit(0.6)))
    lineage = held.select("decoy_id", "child_id").unionByName(facts_held).unionByName(gram_held).distinct()
    return rows, lineage, edges


def pipeline(memories: DataFrame, vectors: DataFrame, size: int, conf: Lifecycle = DEFAULTS.lifecycle, newest: int = 200) -> DataFrame:
    """``stage, n``: how many rows the three stages make: session summaries, semantic facts, procedures."""
    rows, _, _ = pipeline_rows(memories, vectors, size, datetime(1970, 1, 1), conf, newest)
    stages = rows.groupBy(F.col("memory_type").alias("stage")).agg(F.count(F.lit(1)).alias("n"))
    names = memories.sparkSession.createDataFrame([("episodic",), ("semantic",), ("procedural",)], "stage string")
    return names.join(stages, "stage", "left").select("stage", F.coalesce("n", F.lit(0)).alias("n"))
