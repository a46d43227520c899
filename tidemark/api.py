"""The tool surface: one object over the tables, every call a set operation on them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.metadata import merge_metadata
from tidemark.functions.scoring import clamp01
from tidemark.functions.text import query_tokens
from tidemark.operators import codegraph, context, retrieval
from tidemark.sources.ingest import memory_rows
from tidemark.sources.store import delete_memories, insert_or_ignore


@dataclass(frozen=True)
class Engine:
    """Tables as DataFrames; changes return a new Engine, writing it is the caller's."""

    memories: DataFrame
    vectors: DataFrame
    edges: DataFrame
    jobs: DataFrame
    lineage: DataFrame
    code_nodes: DataFrame | None = None
    code_edges: DataFrame | None = None
    embed: Callable[[str], list[float]] | None = None

    def remember(self, events: DataFrame) -> Engine:
        fresh = memory_rows(events).withColumnRenamed("project_path", "project_id")
        return replace(self, memories=insert_or_ignore(self.memories, fresh, ["id"]))

    def recall(self, query: str, as_of: datetime, limit: int = 10, filters: retrieval.Filters = retrieval.Filters(), size: int = 384) -> DataFrame:
        limit = min(max(limit, 1), 100)
        vector = None
        if self.embed is not None:
            vector = self.memories.sparkSession.createDataFrame([("?", self.embed(query))], "id string, v array<double>")
        v = self.vectors.select(F.col("memory_id").alias("id"), F.col("embedding").alias("v"))
        found = retrieval.recall(self.memories, v, vector, query_tokens(query), as_of, limit, self.edges, size, filters)
        return found.join(self.memories.select("id", "content", "memory_type"), "id")

    def forget(self, ids: DataFrame) -> Engine:
        left = delete_memories(ids, self.memories, self.vectors, self.edges, self.jobs, self.lineage)
        return replace(self, memories=left["memories"], vectors=left["vectors"], edges=left["edges"], jobs=left["jobs"], lineage=left["lineage"])

    def update_memory(self, changes: DataFrame) -> Engine:
        """``changes(id, content?, importance?, metadata?)``; null leaves a value as it is."""
        c = changes.select("id", *[F.col(x).alias(f"__{x}") for x in changes.columns if x != "id"])
        m = self.memories.join(c, "id", "left")
        for x in changes.columns:
            if x == "content":
                m = m.withColumn(x, F.coalesce("__content", "content"))
            elif x == "importance":
                m = m.withColumn(x, F.coalesce(clamp01(F.col("__importance")), "importance"))
            elif x == "metadata":
                m = m.withColumn(x, F.when(F.col("__metadata").isNull(), F.col("metadata")).otherwise(merge_metadata("metadata", "__metadata")))
        return replace(self, memories=m.select(*self.memories.columns))

    def project_context(self, as_of: datetime, tokens: int = 2000) -> DataFrame:
        return context.project_context(self.memories, as_of, tokens)

    def list_memories(self, limit: int = 20, offset: int = 0, **conditions: str) -> DataFrame:
        return context.memory_page(self.memories, min(max(limit, 1), 200), offset, **conditions)

    def memory_detail(self, memory_id: str) -> dict[str, DataFrame]:
        m = F.lit(memory_id)
        return {
            "row": self.memories.where(F.col("id") == m), "edges": self.edges.where((F.col("src_id") == m) | (F.col("dst_id") == m)),
            "children": self.memories.join(self.lineage.where(F.col("decoy_id") == m).select(F.col("child_id").alias("id")), "id", "left_semi"),
            "parent": self.memories.join(self.lineage.where(F.col("child_id") == m).select(F.col("decoy_id").alias("id")), "id", "left_semi"),
        }

    def codegraph_query(self, text: str) -> DataFrame:
        q = codegraph.parse_query(text)
        if q.op == "keyword":
            return codegraph.keyword(self.code_nodes, q.name)
        if q.op == "imports_of":
            return codegraph.imports_of(self.code_nodes, self.code_edges, q.name)
        if q.op == "path":
            steps = codegraph.path(self.code_nodes, self.code_edges, q.name, q.goal)
            order = self.code_nodes.sparkSession.createDataFrame(list(enumerate(steps)), "step int, id string")
            return self.code_nodes.join(order, "id").orderBy("step")
        return codegraph.one_hop(self.code_nodes, self.code_edges, q.name, *codegraph.ONE_HOP[q.op])

    def codegraph_blast_radius(self, target: str, depth: int = 5) -> tuple[DataFrame, DataFrame]:
        return codegraph.blast_radius(self.code_nodes, self.code_edges, target, depth)

    def codegraph_explore(self, name: str) -> DataFrame:
        return codegraph.explore(self.code_nodes, self.code_edges, name)

    def file_context(self, path: str, as_of: datetime, limit: int = 10) -> tuple[DataFrame, DataFrame | None]:
        """Memories that name a file, and the code nodes in it."""
        hits = self.recall(path.rsplit("/", 1)[-1], as_of, limit)
        return hits, None if self.code_nodes is None else self.code_nodes.where(F.col("file_path") == path)
