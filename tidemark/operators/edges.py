"""Construction of the memory graph, for all rows at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.config import DEFAULTS
from tidemark.functions.metadata import tags
from tidemark.functions.scoring import jaccard
from tidemark.operators.vectors import nearest, similar_pairs
from tidemark.session import materialize

EXCLUDED_TYPE = "code_context"


def _edge(pairs: DataFrame, kind: str, weight) -> DataFrame:
    return pairs.select(
        F.least("a", "b").alias("src_id"), F.greatest("a", "b").alias("dst_id"), F.lit(kind).alias("edge_type"), F.lit(None).cast("string").alias("label"), weight.cast("double").alias("weight")
    )


def similarity_edges(vectors: DataFrame, id_col: str, vector_col: str, size: int, threshold: float = DEFAULTS.edges.similarity_threshold, candidates: int = DEFAULTS.edges.similarity_candidates) -> DataFrame:
    """Edges to the nearest ``candidates`` rows of at least ``threshold``, each pair once."""
    near = nearest(vectors, vectors, id_col, vector_col, size, candidates, least=threshold)
    pairs = near.select(F.col("query_id").alias("a"), F.col("id").alias("b"), "score")
    return _edge(pairs, "similarity", F.col("score")).groupBy("src_id", "dst_id", "edge_type", "label").agg(F.max("weight").alias("weight"))


def threshold_edges(vectors: DataFrame, id_col: str, vector_col: str, size: int, threshold: float) -> DataFrame:
    """Edges of all pairs of at least ``threshold``, without a bound on their number per row."""
    pairs = similar_pairs(vectors, id_col, vector_col, size, threshold)
    return _edge(pairs, "similarity", F.col("score"))


#: Rows of one time bucket that meet in one task; fuller buckets are split.
BUCKET_ROWS = 2000


def temporal_edges(rows: DataFrame, window_s: int = DEFAULTS.edges.temporal_window_s, id_col: str = "id", project_col: str = "project_id", at_col: str = "created_at", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Edges of weight 1 between rows of one project at most ``window_s`` apart (both ends count).

    An interval join by equality: rows meet in time buckets of the window's width, each row in its own and the next one,
    so no range join over whole projects is planned. A bucket of very many rows (an import at one moment) is split on one
    side, so that its pairs, which are all results, come from many tasks.
    """
    us = F.unix_micros(F.col(at_col).cast("timestamp"))
    wide = window_s * 1_000_000
    r = rows.select(F.col(id_col).alias("id"), F.col(project_col).alias("p"), us.alias("t")).where(F.col("p").isNotNull() & F.col("t").isNotNull()).dropDuplicates(["id"])
    r = r.withColumn("k", F.floor(F.col("t") / F.lit(max(wide, 1))))
    full = r.groupBy("p", "k").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > bucket_rows).select("p", "k", F.ceil(F.col("n") / bucket_rows).cast("int").alias("parts"))
    full = materialize(full, "full-buckets")
    part = F.pmod(F.xxhash64("a"), F.coalesce("parts", F.lit(1))).cast("int")
    a = r.select(F.col("id").alias("a"), "p", F.col("t").alias("ta"), "k").join(full, ["p", "k"], "left").select("a", "p", "ta", "k", part.alias("part"))
    b = r.select(F.col("id").alias("b"), "p", F.col("t").alias("tb"), F.col("k").alias("own"), F.explode(F.array(F.col("k"), F.col("k") + 1)).alias("k"))
    b = b.join(full, ["p", "k"], "left").select("b", "p", "tb", "own", "k", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"))
    # a pair of one bucket meets once there, in order of ids; a pair of neighbouring ones where the later row lies
    ordered = F.when(F.col("a.k") == F.col("own"), F.col("a") < F.col("b")).otherwise(F.lit(True))
    pairs = a.alias("a").join(b.alias("b"), ["p", "k", "part"]).where(ordered & (F.abs(F.col("ta") - F.col("tb")) <= wide))
    return _edge(pairs.select("a", "b"), "temporal", F.lit(1.0))


def tag_edges(rows: DataFrame, least_shared: int = DEFAULTS.edges.tag_min_shared, least_jaccard: float = DEFAULTS.edges.tag_min_jaccard, id_col: str = "id", tags_col: str | None = None, metadata_col: str = "metadata", digits: int | None = None) -> DataFrame:
    """Edges between rows that share tags, weighted by Jaccard: at least two shared ones, or a Jaccard of a half; weights
    are rounded to ``digits`` if given, once per pair of tag sets instead of once per edge.

    Rows of equal tag sets are one class while tags meet, so a tag set that very many rows have costs one row.
    """
    given = F.col(tags_col) if tags_col else tags(F.col(metadata_col))
    r = rows.select(F.col(id_col).alias("id"), F.sort_array(F.array_distinct(given)).alias("tags")).where(F.size("tags") > 0).dropDuplicates(["id"])
    sets = r.select("tags").distinct().select("tags", F.concat_ws("\u0001", "tags").alias("s"), F.size("tags").alias("n"))
    t = sets.select("s", "n", F.explode("tags").alias("tag"))
    a, b = t.select(F.col("s").alias("sa"), F.col("n").alias("na"), "tag"), t.select(F.col("s").alias("sb"), F.col("n").alias("nb"), "tag")
    met = a.join(b, "tag").where("sa <= sb").groupBy("sa", "sb", "na", "nb").agg(F.count(F.lit(1)).alias("shared"))
    met = met.withColumn("weight", jaccard(F.col("shared"), F.col("na"), F.col("nb"))).where((F.col("shared") >= least_shared) | (F.col("weight") >= least_jaccard))
    met = met if digits is None else met.withColumn("weight", F.round("weight", digits))
    m = r.select("id", F.concat_ws("\u0001", "tags").alias("s"))
    pairs = met.join(m.select(F.col("id").alias("a"), F.col("s").alias("sa")), "sa").join(m.select(F.col("id").alias("b"), F.col("s").alias("sb")), "sb")
    return _edge(pairs.where((F.col("sa") != F.col("sb")) | (F.col("a") < F.col("b"))), "tag_overlap", F.col("weight"))


def explicit_edges(links: DataFrame, src: str = "src_id", dst: str = "dst_id") -> DataFrame:
    """Directed edges of weight 1 as given; links to oneself and repeated ones are dropped."""
    return links.select(F.col(src).alias("src_id"), F.col(dst).alias("dst_id")).where("src_id <> dst_id").distinct().select(
        "src_id", "dst_id", F.lit("explicit").alias("edge_type"), F.lit(None).cast("string").alias("label"), F.lit(1.0).alias("weight")
    )


def relation_edges(near: DataFrame, labels: DataFrame, weight: float = DEFAULTS.edges.relation_weight) -> DataFrame:
    """Directed labelled edges from replies that name a neighbour by its 1-based rank: ``labels(src_id, rank, label)``."""
    n = near.select(F.col("query_id").alias("src_id"), F.col("id").alias("dst_id"), "rank")
    return labels.join(n, ["src_id", "rank"]).select("src_id", "dst_id", F.lit("relation").alias("edge_type"), "label", F.lit(weight).alias("weight")).distinct()


def all_edges(memories: DataFrame, vectors: DataFrame, size: int, digits: int | None = None) -> DataFrame:
    """Similarity, temporal and tag edges of all memories but code context; weights rounded to ``digits`` if given."""
    m = memories.where(F.lower(F.trim("memory_type")) != EXCLUDED_TYPE)
    v = vectors.join(m.select(F.col("id").alias("memory_id")).distinct(), "memory_id", "left_semi")
    similar = similarity_edges(v, "memory_id", "embedding", size)
    similar = similar if digits is None else similar.withColumn("weight", F.round("weight", digits))
    return similar.unionByName(temporal_edges(m)).unionByName(tag_edges(m, digits=digits))


EDGE_KEY = ("src_id", "dst_id", "edge_type")


def new_edges(fresh: DataFrame, stored: DataFrame) -> DataFrame:
    """Edges of ``fresh`` whose (src, dst, type, label) is not stored yet, each once, the heaviest copy."""
    label = F.coalesce("label", F.lit(""))
    f = fresh.groupBy(*EDGE_KEY, label.alias("label")).agg(F.max("weight").alias("weight"))
    s = stored.select(*EDGE_KEY, label.alias("label"))
    return f.join(s, [*EDGE_KEY, "label"], "left_anti").select(*EDGE_KEY, F.nullif("label", F.lit("")).alias("label"), "weight")
