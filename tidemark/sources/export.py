"""Exports of memories and graphs as lines of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _dot(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))


def _xml(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def _lines(spark, head: str, nodes: DataFrame, edges: DataFrame, tail: str) -> DataFrame:
    one = lambda part, text: spark.createDataFrame([(part, text)], "part int, line string")
    n, e = nodes.select(F.lit(1).alias("part"), "line"), edges.select(F.lit(2).alias("part"), "line")
    return one(0, head).unionByName(n).unionByName(e).unionByName(one(3, tail))


def dot(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``part, line`` of a DOT digraph; ordered by part it is the file."""
    n = nodes.select(F.concat(F.lit('  "'), _dot(F.col("id")), F.lit('" [label="'), _dot(F.col("name")), F.lit('"];')).alias("line"))
    e = edges.select(F.concat(F.lit('  "'), _dot(F.col("src_id")), F.lit('" -> "'), _dot(F.col("dst_id")), F.lit('" [label="'), _dot(F.col("kind")), F.lit('"];')).alias("line"))
    return _lines(nodes.sparkSession, "digraph codegraph {", n, e, "}")


def graphml(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    n = nodes.select(F.concat(F.lit('    <node id="'), _xml(F.col("id")), F.lit('"><data key="name">'), _xml(F.col("name")), F.lit("</data></node>")).alias("line"))
    e = edges.select(F.concat(F.lit('    <edge source="'), _xml(F.col("src_id")), F.lit('" target="'), _xml(F.col("dst_id")), F.lit('"><data key="kind">'), _xml(F.col("kind")), F.lit("</data></edge>")).alias("line"))
    head = '<?xml version="1.0" encoding="UTF-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns">\n  <key id="name" for="node" attr.name="name" attr.type="string"/>\n  <key id="kind" for="edge" attr.name="kind" attr.type="string"/>\n  <graph edgedefault="directed">'
    return _lines(nodes.sparkSession, head, n, e, "  </graph>\n</graphml>")


def graph_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One JSON line per node and edge; a graph of any size is written without one row that holds it all."""
    n = nodes.select(F.to_json(F.struct(F.lit("node").alias("record"), *nodes.columns)).alias("line"))
    return n.unionByName(edges.select(F.to_json(F.struct(F.lit("edge").alias("record"), *edges.columns)).alias("line")))


def memories_json(memories: DataFrame) -> DataFrame:
    return memories.select(F.to_json(F.struct(*memories.columns)).alias("line"))


def memories_markdown(memories: DataFrame) -> DataFrame:
    c = F.coalesce(F.col("content"), F.lit(""))
    return memories.select(F.format_string("## %s\n\n- type: %s\n- importance: %.2f\n- created: %s\n\n%s\n", F.col("id"), F.col("memory_type"), F.coalesce("importance", F.lit(0.0)), F.date_format("created_at", "yyyy-MM-dd HH:mm:ss"), c).alias("line"))
