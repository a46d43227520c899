"""Hybrid retrieval: vector and keyword lists, graph expansion, reciprocal rank fusion, re-scoring."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import DEFAULTS, Retrieval
from tidemark.functions.metadata import tags
from tidemark.functions.porter import stem, stems
from tidemark.functions.scoring import days_between, final_score, recency, rrf_term
from tidemark.functions.text import tokens
from tidemark.operators.traverse import expand
from tidemark.operators.vectors import nearest
from tidemark.session import shared_dir

K1, B = 1.2, 0.75
#: Rows of a candidate pool that are broadcast.
POOL_ROWS = 100_000


@dataclass(frozen=True)
class Filters:
    """Conjuncts of a search; None is no condition."""

    memory_type: str | None = None
    project_id: str | None = None
    since: datetime | None = None
    tag: str | None = None

    def of(self, rows: DataFrame) -> DataFrame:
        if self.memory_type is not None:
            rows = rows.where(F.col("memory_type") == self.memory_type)
        if self.project_id is not None:
            rows = rows.where(F.col("project_id") == self.project_id)
        if self.since is not None:
            rows = rows.where(F.col("created_at") >= F.lit(self.since))
        if self.tag is not None:
            rows = rows.where(F.array_contains(tags(F.col("metadata")), self.tag))
        return rows


def postings(rows: DataFrame, id_col: str, text_col: str, stemmed: bool = False) -> DataFrame:
    """``id, term, tf, length``: the keyword index; with ``stemmed`` of English stems instead of words."""
    w = tokens(F.col(text_col))
    words = rows.select(F.col(id_col).alias("id"), (stems(w) if stemmed else w).alias("w")).select("id", F.size("w").alias("length"), F.explode("w").alias("term"))
    return words.groupBy("id", "term", "length").agg(F.count(F.lit(1)).alias("tf"))


@dataclass(frozen=True)
class KeywordIndex:
    """Postings stored by bucket of the term and sorted by term, with the numbers of the whole collection beside them."""

    postings: DataFrame
    n: int
    mean: float
    buckets: int
    stemmed: bool = False


#: Buckets of terms that postings are stored by; a search reads those of its terms.
TERM_BUCKETS = 64


def keyword_index(rows: DataFrame, id_col: str, text_col: str, buckets: int = TERM_BUCKETS, stemmed: bool = False) -> KeywordIndex:
    """Builds the index of ``rows`` in the shared folder. Null texts have no words and count. With ``stemmed`` words of one
    English stem are one term, in the index and in searches of it."""
    words = rows.select(F.col(id_col).alias("id"), tokens(F.col(text_col)).alias("w"))
    stats = words.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("w")).alias("mean")).first()
    stored = postings(rows, id_col, text_col, stemmed).withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int"))
    path = f"{shared_dir(rows.sparkSession)}/tidemark/postings-{uuid.uuid4().hex}"
    stored.repartition(buckets, "bucket").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").option("compression", "zstd").parquet(path)
    kind = stored.schema  # the partition column comes last, as in the folder
    return KeywordIndex(rows.sparkSession.read.schema(kind).parquet(path), int(stats["n"]), float(stats["mean"] or 1.0), buckets, stemmed)


def bm25(index: KeywordIndex, terms: Sequence[str], k: int | None = None, among: DataFrame | None = None) -> DataFrame:
    """``id, score`` of the rows holding one of the terms, greatest first, at most ``k``; with ``among`` (id) only of those.

    Okapi BM25 (k1 1.2, b 0.75), idf at least 1e-6. Document frequencies and the mean length are of the whole collection;
    no terms give no rows. Only the terms' postings are read: buckets are pruned, and the filter on terms reaches the scan.
    """
    terms = list(dict.fromkeys(stem(t) if index.stemmed else t for t in terms))
    wanted = sorted({int(r["b"]) for r in index.postings.sparkSession.createDataFrame([(t,) for t in terms], "t string").select(F.pmod(F.xxhash64("t"), F.lit(index.buckets)).cast("int").alias("b")).collect()}) if terms else []
    hit = index.postings.where(F.col("bucket").isin(wanted) & F.col("term").isin(terms)) if terms else index.postings.limit(0)
    df = {r["term"]: r["df"] for r in hit.groupBy("term").agg(F.count(F.lit(1)).alias("df")).collect()} if terms else {}
    idf = F.lit(0.0)
    for t, n in df.items():
        idf = F.when(F.col("term") == t, F.greatest(F.lit(1e-6), F.log((F.lit(float(index.n)) - n + 0.5) / (F.lit(float(n)) + 0.5)))).otherwise(idf)
    tf = F.col("tf").cast("double")
    part = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("length") / F.lit(index.mean)))
    found = hit.groupBy("id").agg(F.sum(part).alias("score"))
    found = found if among is None else found.join(among.select("id"), "id", "left_semi")
    return found if k is None else found.orderBy(F.desc("score"), "id").limit(k)


def ranked(df: DataFrame, *order) -> DataFrame:
    """``rank0`` of a list that is already cut: its length is the caller's limit."""
    return df.withColumn("rank0", F.row_number().over(Window.orderBy(*order)) - 1)


def fuse(dense: DataFrame, sparse: DataFrame, graph: DataFrame | None = None, conf: Retrieval = DEFAULTS.retrieval) -> DataFrame:
    """``id, rrf`` from lists with ``id, rank0`` (graph: also ``hop``).

    Dense and sparse terms are weight / (k + rank + 1); a graph hit's weight is halved per hop and its rank starts after
    the longer of the other lists.
    """
    parts = dense.select("id", rrf_term(conf.dense_weight, F.col("rank0"), conf.rrf_k).alias("s")).unionByName(sparse.select("id", rrf_term(conf.sparse_weight, F.col("rank0"), conf.rrf_k).alias("s")))
    if graph is not None:
        longest = dense.agg(F.count(F.lit(1)).alias("n")).unionByName(sparse.agg(F.count(F.lit(1)).alias("n"))).agg(F.max("n").alias("n")).first()["n"]
        term = F.lit(conf.graph_weight) * F.pow(F.lit(conf.hop_decay), F.col("hop")) / (F.lit(float(conf.rrf_k)) + F.lit(int(longest)) + F.col("rank0") + 1)
        parts = parts.unionByName(graph.select("id", term.alias("s")))
    return parts.groupBy("id").agg(F.sum("s").alias("rrf"))


def recall(
    memories: DataFrame,
    vectors: DataFrame | None,
    query_vector: DataFrame | None,
    terms: Sequence[str],
    as_of: datetime,
    limit: int,
    edges: DataFrame | None = None,
    size: int = 384,
    filters: Filters = Filters(),
    filter_mode: str = "pre",
    pool: bool = False,
    conf: Retrieval = DEFAULTS.retrieval,
    index: KeywordIndex | None = None,
) -> DataFrame:
    """``id, rrf, score, rank`` of the best ``limit`` memories (with ``pool`` the whole candidate pool).

    ``memories``: id, content, importance, created_at, strength and the filters' columns. ``query_vector``: one row
    (id, v); without it only keywords count. ``filter_mode`` pre puts the filters into the scans, post applies them to the
    pool, which can then hold fewer than ``limit``. Every ranking ends in the id, so ties are the same each time.
    ``index`` is the stored keyword index of ``memories``; without one it is built for this search.
    """
    rows = filters.of(memories) if filter_mode == "pre" else memories
    index = index or keyword_index(memories, "id", "content")
    among = rows.select("id") if filter_mode == "pre" and filters != Filters() else None
    sparse = ranked(bm25(index, terms, limit, among), F.desc("score"), "id")
    if vectors is not None and query_vector is not None:
        v = vectors.join(rows.select("id"), "id", "left_semi") if filter_mode == "pre" and filters != Filters() else vectors
        near = nearest(v, query_vector, "id", "v", size, limit)
        dense = near.select("id", (F.col("rank") - 1).alias("rank0"))
    else:
        dense = sparse.select("id", "rank0").limit(0)
    graph = None
    if edges is not None and conf.hops > 0:
        half = max(limit // 2, 1)
        seeds = dense.where(F.col("rank0") < half).select("id").unionByName(sparse.where(F.col("rank0") < half).select("id")).distinct()
        reached = expand(edges, seeds, limit, conf.hops)
        graph = ranked(reached, "hop", F.desc("priority"), "id")
        if filter_mode == "pre" and filters != Filters():
            graph = graph.join(rows.select("id"), "id", "left_semi")
    found = fuse(dense, sparse, graph, conf).orderBy(F.desc("rrf"), "id").limit(limit * conf.overfetch)
    # the pool holds at most limit * overfetch rows: memories are not moved for it unless the caller asks for very many
    hit = memories.join(F.broadcast(found) if limit * conf.overfetch <= POOL_ROWS else found, "id")
    hit = filters.of(hit) if filter_mode == "post" else hit
    score = final_score(F.col("rrf"), F.coalesce("importance", F.lit(0.5)), recency(days_between(F.lit(as_of), F.col("created_at")), conf.recency_days), F.coalesce("strength", F.lit(1.0)))
    scored = hit.select("id", "rrf", score.alias("score"))
    order = Window.orderBy(F.desc("score"), "id")
    scored = scored.withColumn("rank", F.row_number().over(order))
    return scored if pool else scored.where(F.col("rank") <= limit)


def access_delta(found: DataFrame, as_of: datetime) -> DataFrame:
    """The change that a search makes to its hits: one access more, at ``as_of``."""
    return found.select("id", F.lit(1).cast("long").alias("access_added"), F.lit(as_of).alias("accessed_at"))


def metrics(ranked_ids: DataFrame, gold: DataFrame, ks: Sequence[int] = (1, 5, 10)) -> DataFrame:
    """Recall at ``ks`` and MRR over questions: ``ranked_ids(question_id, id, rank)``, ``gold(question_id, id)``.

    Every question of ``gold`` counts; one whose gold ids are null or never found is a miss.
    """
    hit = ranked_ids.join(gold, ["question_id", "id"]).groupBy("question_id").agg(F.min("rank").alias("first"))
    each = gold.select("question_id").distinct().join(hit, "question_id", "left")
    return each.agg(
        F.count(F.lit(1)).alias("n_questions"), *[F.avg(F.when(F.col("first") <= k, 1.0).otherwise(0.0)).alias(f"recall_at_{k}") for k in ks], F.avg(F.coalesce(F.lit(1.0) / F.col("first"), F.lit(0.0))).alias("mrr")
    )
