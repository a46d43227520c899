"""The code graph: name resolution, incremental build, queries, impact."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import DEFAULTS
from tidemark.operators.traverse import induced, reachable, shortest_path

SYMBOLS = ("function", "method", "type")
#: Query prefix -> (edge kind, whether the named symbol is the edge's target).
ONE_HOP = {"callers_of": ("calls", True), "callees_of": ("calls", False), "tests_for": ("tests", True), "subtypes_of": ("extends", True), "supertypes_of": ("extends", False)}


@dataclass(frozen=True)
class Query:
    op: str
    name: str
    goal: str | None = None


def parse_query(text: str) -> Query:
    """``callers_of:x`` and the like, ``path:a..b``; anything else is a keyword search."""
    text = text.strip()
    op, colon, rest = text.partition(":")
    if colon and op in (*ONE_HOP, "imports_of"):
        return Query(op, rest.strip())
    if colon and op == "path" and ".." in rest:
        a, _, b = rest.partition("..")
        return Query("path", a.strip(), b.strip())
    return Query("keyword", text)


def resolve(refs: DataFrame, nodes: DataFrame, kinds: tuple[str, ...] = SYMBOLS, prefer_file: bool = True) -> DataFrame:
    """``refs(project_id, file_path, ref, ...)`` with ``node_id`` of the node of that name: of several the one in the same
    file, then by file, line and id, nulls last. Names without a node are dropped."""
    n = nodes.where(F.col("kind").isin(*kinds)).select("project_id", F.col("name").alias("ref"), F.col("id").alias("node_id"), F.col("file_path").alias("node_file"), "start_line")
    # the choice is made once per name, and per name and file: no reference meets all nodes of its name
    order = [x for c in ("node_file", "start_line", "node_id") for x in (F.col(c).isNull().alias(f"no_{c}"), F.col(c))]
    in_file = n.groupBy("project_id", "ref", "node_file").agg(F.min(F.struct(*order)).alias("own"))
    first = in_file.groupBy("project_id", "ref").agg(F.min("own").alias("b"))
    found = refs.distinct().join(first, ["project_id", "ref"])
    if prefer_file:
        own = in_file.where(F.col("node_file").isNotNull()).withColumnRenamed("node_file", "file_path")
        found = found.join(own, ["project_id", "ref", "file_path"], "left").withColumn("b", F.coalesce("own", "b"))
    return found.select(*refs.columns, F.col("b.node_id").alias("node_id"))


def resolve_edges(nodes: DataFrame, calls: DataFrame, tests: DataFrame, inherits: DataFrame) -> DataFrame:
    """``project_id, src_id, dst_id, kind`` of all references, computed for whole projects at once, so that a rebuild of
    some files gives what a full one does.

    ``calls(project_id, file_path, caller_id, ref)``, ``tests(project_id, file_path, test_id, ref)``,
    ``inherits(project_id, file_path, sub, ref)``. Calls without a caller, and of or to oneself, are dropped.
    """
    edge = lambda df, src, kind: df.select("project_id", F.col(src).alias("src_id"), F.col("node_id").alias("dst_id"), F.lit(kind).alias("kind"))
    c = edge(resolve(calls.where(F.col("caller_id").isNotNull()), nodes), "caller_id", "calls")
    t = edge(resolve(tests.where(F.col("ref").isNotNull()), nodes), "test_id", "tests")
    subs = resolve(inherits.select("project_id", "file_path", F.col("sub").alias("ref"), F.col("ref").alias("sup")), nodes, ("type",)).withColumnRenamed("node_id", "sub_id")
    i = edge(resolve(subs.select("project_id", "file_path", "sub_id", F.col("sup").alias("ref")), nodes, ("type",), False), "sub_id", "extends")
    return c.unionByName(t).unionByName(i).where("src_id <> dst_id").distinct()


def changed_files(current: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files to parse again (new or of another hash), and stored paths that are gone."""
    key = ["project_id", "path"]
    old = stored.select(*key, F.col("content_hash").alias("__old"))
    again = current.join(old, key, "left").where(~F.col("content_hash").eqNullSafe(F.col("__old"))).drop("__old")
    return again, stored.join(current.select(*key), key, "left_anti").select(*key)


def replace_files(rows: DataFrame, fresh: DataFrame, again: DataFrame, gone: DataFrame, file_col: str = "file_path") -> DataFrame:
    """Stored rows of unchanged files and the fresh ones of the others."""
    out = again.select("project_id", F.col("path").alias(file_col)).unionByName(gone.select("project_id", F.col("path").alias(file_col)))
    return rows.join(out, ["project_id", file_col], "left_anti").unionByName(fresh)


def in_project(rows: DataFrame, project_id: str | None) -> DataFrame:
    """Rows of one project; None stands for all, for graphs that hold one project only."""
    return rows if project_id is None else rows.where(F.col("project_id") == project_id)


def named(nodes: DataFrame, name: str, project_id: str | None = None) -> DataFrame:
    """The first symbol of that name, by file, line and id."""
    nodes = in_project(nodes, project_id)
    return nodes.where((F.col("name") == name) & F.col("kind").isin(*SYMBOLS)).orderBy("file_path", "start_line", "id").limit(1)


def keyword(nodes: DataFrame, text: str, limit: int = 50, project_id: str | None = None) -> DataFrame:
    nodes = in_project(nodes, project_id)
    return nodes.where(F.contains(F.lower("name"), F.lit(text.lower()))).orderBy("name", "id").limit(limit)


def one_hop(nodes: DataFrame, edges: DataFrame, name: str, kind: str, into: bool, project_id: str | None = None) -> DataFrame:
    """Nodes one edge before (``into``) or after the first symbol of that name."""
    nodes, edges = in_project(nodes, project_id), in_project(edges, project_id)
    at, other = ("dst_id", "src_id") if into else ("src_id", "dst_id")
    hit = edges.where(F.col("kind") == kind).join(F.broadcast(named(nodes, name).select(F.col("id").alias(at))), at, "left_semi")  # one node
    return nodes.join(hit.select(F.col(other).alias("id")).distinct(), "id", "left_semi")


def imports_of(nodes: DataFrame, edges: DataFrame, name: str, project_id: str | None = None) -> DataFrame:
    """What imports the module of that name; where no such edge is known, import nodes whose name holds it."""
    nodes, edges = in_project(nodes, project_id), in_project(edges, project_id)
    target = nodes.where((F.col("kind") == "import") & (F.col("name") == name)).select(F.col("id").alias("dst_id"))
    hit = edges.where(F.col("kind") == "imports").join(target, "dst_id", "left_semi").select(F.col("src_id").alias("id")).distinct()
    found = nodes.join(hit, "id", "left_semi")
    if found.limit(1).count():
        return found
    return keyword(nodes.where(F.col("kind") == "import"), name)


def path(nodes: DataFrame, edges: DataFrame, start: str, goal: str, project_id: str | None = None) -> list[str]:
    """Ids along the shortest chain of calls and imports between two names; nothing if one is unknown."""
    nodes, edges = in_project(nodes, project_id), in_project(edges, project_id)
    a, b = named(nodes, start).first(), named(nodes, goal).first()
    if a is None or b is None:
        return []
    return shortest_path(edges.where(F.col("kind").isin("calls", "imports")), a["id"], b["id"])


def blast_radius(nodes: DataFrame, edges: DataFrame, target: str, depth: int = DEFAULTS.blast_depth, project_id: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Dependents (``id, hop``) of a file's nodes, or else of all symbols of a name, over reversed calls, imports and
    extends; and the tests that cover them or the roots."""
    nodes, edges = in_project(nodes, project_id), in_project(edges, project_id)
    in_file = nodes.where(F.col("file_path") == target).select("id")
    roots = in_file if in_file.limit(1).count() else nodes.where((F.col("name") == target) & F.col("kind").isin(*SYMBOLS)).select("id")
    back = edges.where(F.col("kind").isin("calls", "imports", "extends")).select(F.col("dst_id").alias("a"), F.col("src_id").alias("b"))
    reached = reachable(back, roots, depth)
    tests = edges.where(F.col("kind") == "tests").join(reached.select(F.col("id").alias("dst_id")), "dst_id", "left_semi").select(F.col("src_id").alias("id")).distinct()
    return reached.where("hop > 0"), tests


def explore(nodes: DataFrame, edges: DataFrame, name: str, depth: int = DEFAULTS.blast_depth, project_id: str | None = None) -> DataFrame:
    """``role, id, hop`` around a symbol: dependents, tests, and its direct callers, callees, sub- and supertypes."""
    nodes, edges = in_project(nodes, project_id), in_project(edges, project_id)
    dependents, tests = blast_radius(nodes, edges, name, depth)
    out = dependents.select(F.lit("dependent").alias("role"), "id", "hop").unionByName(tests.select(F.lit("test").alias("role"), "id", F.lit(0).alias("hop")))
    for role, (kind, into) in ONE_HOP.items():
        out = out.unionByName(one_hop(nodes, edges, name, kind, into).select(F.lit(role).alias("role"), "id", F.lit(1).alias("hop")))
    return out


def view(nodes: DataFrame, edges: DataFrame, focus: str | None = None, limit: int = 500, depth: int = 1, project_id: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes to show (around the focus, or the first ``limit``) and the edges between them."""
    nodes, edges = in_project(nodes, project_id), in_project(edges, project_id)
    if focus is None:
        kept = nodes.orderBy("file_path", "start_line", "id").limit(limit)
    else:
        dependents, tests = blast_radius(nodes, edges, focus, depth)
        ids = dependents.select("id").unionByName(tests).unionByName(nodes.where((F.col("name") == focus) | (F.col("file_path") == focus)).select("id")).distinct()
        kept = nodes.join(ids, "id", "left_semi").orderBy("file_path", "start_line", "id").limit(limit)
    return kept, induced(edges, kept)


def stats(files: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    one = lambda df, name: df.groupBy("project_id").agg(F.count(F.lit(1)).alias(name))
    return one(files, "n_files").join(one(nodes, "n_nodes"), "project_id", "full").join(one(edges, "n_edges"), "project_id", "full").fillna(0)


def ranked_names(nodes: DataFrame) -> DataFrame:
    """The place of every symbol among those of its name, as :func:`named` picks it."""
    return nodes.withColumn("place", F.row_number().over(Window.partitionBy("project_id", "name").orderBy("file_path", "start_line", "id")))
