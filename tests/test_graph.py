from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidemark.operators import codegraph as cg
from tidemark.operators import edges as E
from tidemark.operators import traverse

# A small code graph.
_NODES = [
    ("p", "a.py#1:add", "a.py", "function", "add", 1, 3), ("p", "a.py#5:test_add", "a.py", "test", "test_add", 5, 8), ("p", "b.py#1:use_add", "b.py", "function", "use_add", 1, 4),
    ("p", "b.py#6:main", "b.py", "function", "main", 6, 9), ("p", "c.py#1:Animal", "c.py", "type", "Animal", 1, 2), ("p", "c.py#4:Dog", "c.py", "type", "Dog", 4, 6), ("p", "c.py#8:add", "c.py", "function", "add", 8, 9),
    ("p", "d.py#1:getUserById", "d.py", "function", "getUserById", 1, 5), ("p", "d.py#7:os.path", "d.py", "import", "os.path", 7, 7),
]
_CALLS = [("p", "a.py", "a.py#5:test_add", "add"), ("p", "b.py", "b.py#1:use_add", "add"), ("p", "b.py", "b.py#6:main", "use_add"), ("p", "c.py", None, "add"), ("p", "c.py", "c.py#8:add", "add"), ("p", "d.py", "d.py#1:getUserById", "main")]
_TESTS = [("p", "a.py", "a.py#5:test_add", "add")]
_INHERITS = [("p", "c.py", "Dog", "Animal")]


def _code(spark):
    nodes = spark.createDataFrame(_NODES, "project_id string, id string, file_path string, kind string, name string, start_line int, end_line int")
    calls = spark.createDataFrame(_CALLS, "project_id string, file_path string, caller_id string, ref string")
    tests = spark.createDataFrame(_TESTS, "project_id string, file_path string, test_id string, ref string")
    inherits = spark.createDataFrame(_INHERITS, "project_id string, file_path string, sub string, ref string")
    return nodes, cg.resolve_edges(nodes, calls, tests, inherits)


EDGE = "src_id string, dst_id string, edge_type string, weight double"
CHAIN = [("a", "b", "similarity", 0.9), ("b", "c", "similarity", 0.9), ("c", "d", "similarity", 0.9)]


def rows(df):
    return {tuple(r) for r in df.collect()}


def test_expand_hops_and_priority(spark):
    e = spark.createDataFrame(CHAIN, EDGE)
    seed = spark.createDataFrame([("a",)], "id string")
    assert rows(traverse.expand(e, seed, 10, 1).select("id", "hop")) == {("b", 1)}
    assert rows(traverse.expand(e, seed, 10, 2).select("id", "hop")) == {("b", 1), ("c", 2)}
    near = spark.createDataFrame([("s", "plain", "similarity", 0.95), ("s", "related", "relation", 0.5)], EDGE)
    assert rows(traverse.expand(near, spark.createDataFrame([("s",)], "id string"), 1, 1).select("id")) == {("related",)}


def test_neighborhood(spark):
    e = spark.createDataFrame(CHAIN, EDGE)
    focus = spark.createDataFrame([("b",)], "id string")
    nodes, edges = traverse.neighborhood(e, focus, 1, 10, 0.5)
    assert nodes.count() == 3 and edges.count() == 2
    nodes, edges = traverse.neighborhood(e, focus, 2, 10, 0.5)
    assert nodes.count() == 4 and edges.count() == 3
    nodes, edges = traverse.neighborhood(e, focus, 1, 2, 0.5)
    assert nodes.count() == 2 and edges.count() == 1


def test_components_and_paths(spark):
    e = spark.createDataFrame([*CHAIN, ("x", "y", "similarity", 1.0), ("z", "z", "similarity", 1.0)], EDGE)
    assert rows(traverse.components(e)) == {("a", "a"), ("b", "a"), ("c", "a"), ("d", "a"), ("x", "x"), ("y", "x")}
    assert traverse.shortest_path(e, "a", "d") == ["a", "b", "c", "d"] and traverse.shortest_path(e, "d", "a") == [] and traverse.shortest_path(e, "a", "a") == ["a"]


def test_temporal_window(spark):
    t = datetime(2024, 1, 1)
    m = [("m1", "p", t), ("m2", "p", t + timedelta(seconds=300)), ("m3", "q", t), ("m4", None, t), ("m5", "p", t + timedelta(seconds=601))]
    df = spark.createDataFrame(m, "id string, project_id string, created_at timestamp_ntz")
    assert {(r.src_id, r.dst_id) for r in E.temporal_edges(df, 300).collect()} == {("m1", "m2")}


def test_tag_overlap(spark):
    m = [("1", ["rust", "memory"]), ("2", ["rust", "memory", "cli"]), ("3", ["food"]), ("4", []), ("5", ["grpc", "architecture"]), ("6", ["nextjs", "architecture"]), ("7", ["onboarding"]), ("8", ["onboarding"]), ("9", None)]
    got = {(r.src_id, r.dst_id): r.weight for r in E.tag_edges(spark.createDataFrame(m, "id string, tags array<string>"), tags_col="tags").collect()}
    assert got == {("1", "2"): 2 / 3, ("7", "8"): 1.0}


def test_similarity_edges(spark):
    def v(axis, noise):
        x = [0.0] * 8
        x[axis], x[axis + 1] = 1.0, noise
        return x

    df = spark.createDataFrame([("m1", v(0, 0.05)), ("m2", v(0, 0.1)), ("m3", v(6, 0.0))], "id string, v array<double>")
    got = E.similarity_edges(df, "id", "v", 8, 0.82).collect()
    assert [(r.src_id, r.dst_id) for r in got] == [("m1", "m2")] and got[0].weight > 0.95
    stored = E.similarity_edges(df, "id", "v", 8, 0.82)
    assert E.new_edges(stored, stored).count() == 0


def test_explicit_and_relation(spark):
    links = spark.createDataFrame([("m1", "m2"), ("m1", "m1"), ("m1", "m2")], "src_id string, dst_id string")
    assert E.explicit_edges(links).count() == 1
    near = spark.createDataFrame([("a", "b", 1), ("a", "c", 2)], "query_id string, id string, rank int")
    labels = spark.createDataFrame([("a", 1, "uses"), ("a", 9, "none")], "src_id string, rank int, label string")
    assert {(r.src_id, r.dst_id, r.label) for r in E.relation_edges(near, labels).collect()} == {("a", "b", "uses")}


def test_code_queries(spark):
    nodes, e = _code(spark)
    assert cg.parse_query("callers_of: add").op == "callers_of" and cg.parse_query("path:a..b").goal == "b" and cg.parse_query("x:y").op == "keyword"
    assert cg.path(nodes, e, "main", "nothing") == []
    dependents, tests = cg.blast_radius(nodes, e, "a.py")
    assert rows(tests) == {("a.py#5:test_add",)} and ("b.py#1:use_add", 1) in rows(dependents)
    assert rows(cg.keyword(nodes, "ab").select("id")) == set()


def test_parser_and_incremental(spark, tmp_path):
    from tidemark.sources.code import parse, parsed_tables, snippets, source_files

    (tmp_path / "pkg").mkdir()
    (tmp_path / "pkg/a.py").write_text("def add(a, b):\n    return a + b\n\ndef test_add():\n    assert add(1, 2)\n")
    (tmp_path / "pkg/b.rs").write_text("struct Dog;\nfn use_add() {\n    add(1);\n}\n")
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules/x.js").write_text("function x() {}")
    files = source_files(spark, str(tmp_path), "p")
    assert {r.path for r in files.collect()} == {"pkg/a.py", "pkg/b.rs"}
    t = parsed_tables(parse(files))
    assert {(r.kind, r.name) for r in t["nodes"].collect()} == {("function", "add"), ("test", "test_add"), ("type", "Dog"), ("function", "use_add")}
    e = cg.resolve_edges(t["nodes"], t["calls"], t["tests"], t["inherits"])
    assert ("pkg/b.rs#2:use_add", "pkg/a.py#1:add", "calls") in {(r.src_id, r.dst_id, r.kind) for r in e.collect()}
    assert {r.id: r.snippet for r in snippets(t["nodes"], files).collect()}["pkg/a.py#1:add"].startswith("def add")


def test_long_paths_are_found(spark):
    e = spark.range(60).select(F.concat(F.lit("n"), F.lpad("id", 3, "0")).alias("src_id"), F.concat(F.lit("n"), F.lpad(F.col("id") + 1, 3, "0")).alias("dst_id"))
    assert len(traverse.shortest_path(e, "n000", "n060")) == 61


def test_two_projects_stay_apart(spark):
    nodes = spark.createDataFrame([("p", "p1", "a.py", "function", "f", 1, 2), ("q", "q1", "a.py", "function", "f", 1, 2), ("q", "q2", "b.py", "function", "g", 1, 2), ("p", "p2", "b.py", "function", "h", 1, 2)], "project_id string, id string, file_path string, kind string, name string, start_line int, end_line int")
    e = spark.createDataFrame([("p", "p2", "p1", "calls"), ("q", "q2", "q1", "calls")], "project_id string, src_id string, dst_id string, kind string")
    ids = lambda df: {r.id for r in df.collect()}
    assert ids(cg.one_hop(nodes, e, "f", "calls", True, "q")) == {"q2"} and ids(cg.one_hop(nodes, e, "f", "calls", True, "p")) == {"p2"}
    assert ids(cg.blast_radius(nodes, e, "f", project_id="q")[0]) == {"q2"} and ids(cg.keyword(nodes, "F", project_id="p")) == {"p1"}
    assert cg.path(nodes, e, "g", "f", "p") == [] and cg.path(nodes, e, "g", "f", "q") == ["q2", "q1"]


def test_full_time_buckets_are_split(spark):

    at = datetime(2024, 1, 1)
    rows = [(f"m{i:02}", "p", at + timedelta(seconds=(i % 3) * 200)) for i in range(30)]
    df = spark.createDataFrame(rows, "id string, project_id string, created_at timestamp")
    want = {(a, b) for a, _, s in rows for b, _, t in rows if a < b and abs((s - t).total_seconds()) <= 300}
    for n in (2000, 4):
        got = [(r.src_id, r.dst_id) for r in E.temporal_edges(df, bucket_rows=n).collect()]
        assert set(got) == want and len(got) == len(want)


def test_vector_blocks_equal_one_block(spark):
    import numpy as np

    from tidemark.operators import vectors as V

    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(f"v{i:03}", [float(x) for x in rng.normal(size=8)]) for i in range(90)] + [("n", None), ("s", [1.0])], "id string, e array<double>")
    pairs = lambda b: {(r.a, r.b, round(r.score, 9)) for r in V.similar_pairs(df, "id", "e", 8, 0.5, b).collect()}
    near = lambda b: {(r.query_id, r.id, r.rank) for r in V.nearest(df, df, "id", "e", 8, 3, block_values=b).collect()}
    assert pairs(10_000) == pairs(200) and near(10_000) == near(200) and len(near(200)) == 270


def test_incremental_build_equals_a_full_one(spark, tmp_path):
    from tidemark.sources import code

    a, b, c = (tmp_path / n for n in ("a.py", "b.py", "c.py"))
    a.write_text("def add(x):\n    return x\n\ndef test_add():\n    add(1)\n")
    b.write_text("class Animal:\n    pass\n\nclass Dog(Animal):\n    def bark(self):\n        return add(2)\n")
    c.write_text("def old():\n    return add(3)\n")
    first, n = code.build(code.source_files(spark, str(tmp_path), "p"))
    assert tuple(n.first())[:4] == (3, 3, 0, 0)
    b.write_text("class Animal:\n    pass\n\nclass Cat(Animal):\n    def purr(self):\n        return add(2)\n")
    c.unlink()
    second, n = code.build(code.source_files(spark, str(tmp_path), "p"), first)
    assert tuple(n.first())[:4] == (2, 1, 1, 1)
    full, _ = code.build(code.source_files(spark, str(tmp_path), "p"))
    for t in ("files", "nodes", "calls", "tests", "inherits", "edges"):
        assert rows(second[t].select(*sorted(second[t].columns))) == rows(full[t].select(*sorted(full[t].columns))), t
    assert {r.kind for r in full["edges"].collect()} == {"calls", "tests", "extends"}
    assert tuple(code.build(code.source_files(spark, str(tmp_path), "p"), full)[1].first())[:4] == (2, 0, 2, 0)


def test_names_that_very_many_nodes_and_references_share(spark):
    """A choice per name and per file: references that met all nodes of their name would be 3.6 billion pairs here."""
    i = F.col("id")
    place = F.concat(F.lit("f"), F.lpad((i % 700).cast("string"), 3, "0"))
    nodes = spark.range(60_000).select(F.lit("p").alias("project_id"), F.concat(F.lit("n"), i).alias("node"), place.alias("file_path"), F.lit("function").alias("kind"), F.lit("get").alias("name"), i.cast("int").alias("start_line"))
    nodes = nodes.withColumnRenamed("node", "id").unionByName(spark.createDataFrame([("p", "lost", None, "function", "get", 0)], "project_id string, id string, file_path string, kind string, name string, start_line int"))
    refs = spark.range(60_000).select(F.lit("p").alias("project_id"), F.concat(F.lit("f"), F.lpad((i % 800).cast("string"), 3, "0")).alias("file_path"), i.alias("caller_id"), F.lit("get").alias("ref"))
    refs = refs.unionByName(spark.createDataFrame([("p", None, -1, "get")], "project_id string, file_path string, caller_id long, ref string"))
    got = {r.caller_id: r.node_id for r in cg.resolve(refs, nodes).collect()}
    # the first of the same file, or else the first of all; a node of no known file comes last
    assert len(got) == 60_001 and got[5] == "n5" and got[805] == "n5" and got[799] == "n0" and got[-1] == "n0"


def test_blocks_keep_no_more_than_the_best():
    """A block gives k rows per query, however many chunks it passes in, and ties go to the smaller id."""
    import numpy as np
    import pyarrow as pa

    from tidemark.operators import vectors as V

    v = np.random.default_rng(4).normal(size=(6000, 8))
    v[3000:] = v[:3000]
    ids = [f"v{i:04}" for i in range(6000)][::-1]
    given = [b for b in V._kept(ids, v, ids, v, "cosine", V._Best(5, -np.inf, 1), pa.string())]
    t = pa.Table.from_batches(given)
    assert t.num_rows == 5 * 6000
    got = {}
    for q, i in zip(t["query_id"].to_pylist(), t["id"].to_pylist(), strict=True):
        got.setdefault(q, set()).add(i)
    n = v / np.linalg.norm(v, axis=1, keepdims=True)
    for j in range(0, 6000, 500):
        s = n @ n[j]
        s[j] = -9
        assert got[ids[j]] == {ids[i] for i in np.lexsort((np.arange(6000)[::-1], -np.round(s, 12)))[:5]}


def test_blocks_of_queries_shuffle_no_vector(spark):
    """Beyond one block every vector once met a copy of itself per block of the other side, by a shuffle of all of them."""
    import numpy as np

    from tidemark.operators import vectors as V

    x = np.random.default_rng(6).normal(size=(120, 8))
    x[60:] = x[:60] * 3
    rows = [(f"v{i:03}", [float(c) for c in v]) for i, v in enumerate(x)] + [("nan", [float("nan")] * 8)]
    for kind in ("float", "double"):
        df = spark.createDataFrame(rows, f"id string, e array<{kind}>")
        found = V.nearest(df, df, "id", "e", 8, 4, block_values=200, least=0.5)
        assert "CoGroups" not in found._jdf.queryExecution().toString()
        unit = np.array([r.e for r in df.collect()])[:120]
        unit /= np.linalg.norm(unit, axis=1, keepdims=True)
        best = {}
        for r in found.collect():
            best.setdefault(int(r.query_id[1:]), []).append((r.rank, int(r.id[1:]), r.score))
        for j in range(120):
            s = np.round(unit @ unit[j], 9)
            s[j] = -9
            right = [i for i in np.lexsort((np.arange(120), -s))[:4] if s[i] >= 0.5]
            got = sorted(best.get(j, []))
            assert np.allclose([c for _, _, c in got], s[right], atol=1e-9) and len(got) == len(right)
