"""Bounded traversals: one join of a frontier with the edges per hop, never one query per node."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import materialize


def undirected(edges: DataFrame, src: str = "src_id", dst: str = "dst_id", extra: tuple[str, ...] = ()) -> DataFrame:
    """``a, b`` in both directions, each once; links to oneself are dropped."""
    e = edges.select(F.col(src).alias("a"), F.col(dst).alias("b"), *extra)
    return e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"), *extra)).where("a <> b")


def expand(edges: DataFrame, seeds: DataFrame, limit: int, hops: int, by: str = "id") -> DataFrame:
    """``id, hop, priority`` reached from the seeds in up to ``hops`` hops, the first hop counting.

    In a hop neighbours rank by weight (relation edges one higher), then id; altogether at most ``limit`` are kept: the
    limit is the operator's own. Seeds themselves are not given out.
    """
    both = undirected(edges, extra=("edge_type", "weight"))
    both = both.select("a", "b", (F.col("weight") + F.when(F.col("edge_type") == "relation", 1.0).otherwise(0.0)).alias("priority"))
    if hops > 1:
        both = materialize(both, "expand-edges")
    visited = frontier = seeds.select(F.col(by).alias("id")).distinct()
    found, left = None, limit
    for hop in range(1, max(hops, 1) + 1):
        step = both.join(frontier.select(F.col("id").alias("a")), "a", "left_semi").groupBy(F.col("b").alias("id")).agg(F.max("priority").alias("priority"))
        step = step.join(visited, "id", "left_anti").orderBy(F.desc("priority"), "id").limit(left)
        step = materialize(step.withColumn("hop", F.lit(hop)).select("id", "hop", "priority"), "hop")
        n = step.count()
        found = step if found is None else found.unionByName(step)
        left -= n
        if n == 0 or left <= 0:
            break
        frontier = step.select("id")
        visited = visited.unionByName(frontier)
    return found


def reachable(edges: DataFrame, seeds: DataFrame, depth: int, src: str = "a", dst: str = "b") -> DataFrame:
    """``id, hop`` of all nodes within ``depth`` steps along src -> dst, the least hop each; seeds have 0."""
    if depth > 1:
        edges = materialize(edges.select(src, dst), "reach-edges")
    found = frontier = materialize(seeds.select(F.col(seeds.columns[0]).alias("id")).distinct().withColumn("hop", F.lit(0)), "reach")
    for hop in range(1, depth + 1):
        step = edges.join(frontier.select(F.col("id").alias(src)), src, "left_semi").select(F.col(dst).alias("id")).distinct()
        step = materialize(step.join(found, "id", "left_anti").withColumn("hop", F.lit(hop)), "reach")
        if not step.limit(1).count():
            break
        found, frontier = found.unionByName(step), step
    return found


def neighborhood(edges: DataFrame, focus: DataFrame, depth: int, max_nodes: int, min_weight: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """Nodes (``id, hop``) around the focus over edges of enough weight, at most ``max_nodes`` by (hop, id), and the
    edges between them."""
    heavy = edges.where(F.col("weight") >= min_weight)
    nodes = reachable(undirected(heavy), focus, depth).orderBy("hop", "id").limit(max_nodes)
    return nodes, induced(heavy, nodes)


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes (``id``)."""
    return edges.join(nodes.select(F.col("id").alias("src_id")), "src_id", "left_semi").join(nodes.select(F.col("id").alias("dst_id")), "dst_id", "left_semi")


def sample(nodes: DataFrame, edges: DataFrame, most: int, at_col: str = "created_at") -> tuple[DataFrame, DataFrame]:
    """The newest ``most`` nodes and the edges between them."""
    kept = nodes.orderBy(F.desc(at_col), "id").limit(most)
    return kept, induced(edges, kept)


def edges_of(edges: DataFrame, ids: DataFrame, by: str = "id") -> DataFrame:
    """Edges that touch one of the ids at either end, each once."""
    i = ids.select(F.col(by).alias("__id")).distinct()
    return edges.join(i, F.col("src_id") == F.col("__id"), "left_semi").unionByName(
        edges.join(i, F.col("dst_id") == F.col("__id"), "left_semi").join(i, F.col("src_id") == F.col("__id"), "left_anti")
    )


def components(edges: DataFrame, src: str = "src_id", dst: str = "dst_id") -> DataFrame:
    """``id, component`` (the smallest id): least labels spread over edges, with pointer jumping, to the fixpoint."""
    both = materialize(undirected(edges, src, dst).select("a", "b").distinct(), "component-edges")
    label = materialize(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("component")), "component")
    while True:
        near = both.join(label.select(F.col("id").alias("b"), F.col("component").alias("other")), "b").groupBy(F.col("a").alias("id")).agg(F.min("other").alias("other"))
        step = label.join(near, "id").select("id", "component", F.least("component", "other").alias("next"))
        up = label.select(F.col("id").alias("next"), F.col("component").alias("above"))
        step = materialize(step.join(up, "next", "left").select("id", "component", F.least("next", F.coalesce("above", "next")).alias("next")), "component")
        moved = step.where("next <> component").limit(1).count()
        label = step.select("id", F.col("next").alias("component"))
        if not moved:
            return label


def shortest_path(edges: DataFrame, start: str, goal: str, src: str = "src_id", dst: str = "dst_id") -> list[str]:
    """Node ids from start to goal along directed edges, both included; the same node gives itself, no path gives none.

    Breadth-first frontiers with parents, until the goal is reached or nothing new is; of equally short paths the one of smallest predecessors.
    """
    if start == goal:
        return [start]
    spark = edges.sparkSession
    e = materialize(edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).distinct(), "path-edges")  # read once per hop
    found = frontier = spark.createDataFrame([(start, None)], "id string, parent string")
    while True:
        step = e.join(frontier.select(F.col("id").alias("a")), "a").groupBy(F.col("b").alias("id")).agg(F.min("a").alias("parent"))
        step = materialize(step.join(found.select("id"), "id", "left_anti"), "path")
        if not step.limit(1).count():
            return []
        found, frontier = found.unionByName(step), step
        if step.where(F.col("id") == goal).limit(1).count():
            path, at = [goal], goal
            while at != start:
                at = found.where(F.col("id") == at).first()["parent"]
                path.append(at)
            return path[::-1]

