"""Queries on vectors, keywords, fusion, graphs, code graphs and streams, and their SQL twins."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import Retrieval
from tidemark.operators import codegraph as cg
from tidemark.operators import edges as edge_ops
from tidemark.operators import lifecycle, retrieval, traverse, vectors
from tidemark.sources import export
from tidemark.sources.tables import table

AS_OF = datetime(2024, 3, 1)
TERMS = ("queue", "worker", "timeout", "migration")
SIZE, NEAR = 64, 0.35
QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return register


def emb(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings", "vec_id", "embedding", "label")


_V = "WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e, label FROM embeddings)"
_PAIRS = _V + f""", p AS (SELECT a.vec_id AS a, b.vec_id AS b, list_cosine_similarity(a.e, b.e) AS c FROM v a JOIN v b ON a.vec_id < b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= {NEAR}),
u AS (SELECT a, b, c FROM p UNION ALL SELECT b, a, c FROM p)"""


@query(_V + " SELECT v.vec_id AS id, round(list_cosine_similarity(v.e, q.e), 6) AS score FROM v, v q WHERE q.vec_id = 0 AND v.vec_id <> 0 ORDER BY list_cosine_similarity(v.e, q.e) DESC, v.vec_id LIMIT 10")
def knn_topk(spark, folder):
    e = emb(spark, folder)
    return vectors.nearest(e, e.where("vec_id = 0"), "vec_id", "embedding", SIZE, 10).select("id", F.round("score", 6).alias("score"))


@query(_V + " SELECT v.vec_id AS id, round(list_distance(v.e, q.e), 6) AS distance FROM v, v q WHERE q.vec_id = 0 AND v.vec_id <> 0 ORDER BY list_distance(v.e, q.e), v.vec_id LIMIT 10")
def knn_l2(spark, folder):
    e = emb(spark, folder)
    return vectors.nearest(e, e.where("vec_id = 0"), "vec_id", "embedding", SIZE, 10, "l2").select("id", F.round(-F.col("score"), 6).alias("distance"))


@query(_V + """ SELECT q, id, rank FROM (SELECT q.vec_id AS q, v.vec_id AS id, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(v.e, q.e) DESC, v.vec_id) AS rank FROM v JOIN v q ON v.vec_id <> q.vec_id) WHERE rank <= 5""")
def knn_join_k5(spark, folder):
    e = emb(spark, folder)
    return vectors.nearest(e, e, "vec_id", "embedding", SIZE, 5).select(F.col("query_id").alias("q"), "id", "rank")


@query(_PAIRS + " SELECT a AS src_id, b AS dst_id, round(c, 6) AS weight FROM p")
def edge_similarity(spark, folder):
    return edge_ops.threshold_edges(emb(spark, folder), "vec_id", "embedding", SIZE, NEAR).select("src_id", "dst_id", F.round("weight", 6).alias("weight"))


_INDEXES: dict[tuple[str, str], retrieval.KeywordIndex] = {}


def _index(spark: SparkSession, folder: str) -> retrieval.KeywordIndex:
    """The keyword index of a folder's documents: built once per application, searched many times."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _INDEXES:
        _INDEXES[key] = retrieval.keyword_index(table(spark, folder, "documents", "doc_id", "text"), "doc_id", "text")
    return _INDEXES[key]


_WORDS = "list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')"
_TF = ", ".join(f"len(list_filter(w, lambda x: x = '{t}')) AS tf{i}" for i, t in enumerate(TERMS))
_S = " + ".join(
    f"greatest(1e-6, ln((n - df{i} + 0.5) / (df{i} + 0.5))) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * length / mean))" for i in range(len(TERMS))
)
_BM = f"""WITH RECURSIVE d AS (SELECT doc_id AS id, {_WORDS} AS w FROM documents), c AS (SELECT id, len(w) AS length, {_TF} FROM d),
k AS (SELECT count(*)::DOUBLE AS n, avg(length) AS mean, {', '.join(f'count(*) FILTER (tf{i} > 0) AS df{i}' for i in range(len(TERMS)))} FROM c),
bm AS (SELECT id, {_S} AS score FROM c, k WHERE greatest({', '.join(f'tf{i}' for i in range(len(TERMS)))}) > 0)"""


@query(_BM + " SELECT id, round(score, 6) AS score FROM bm ORDER BY bm.score DESC, id LIMIT 10")
def bm25_topk(spark, folder):
    return retrieval.bm25(_index(spark, folder), TERMS, 10).select("id", F.round("score", 6).alias("score"))


@query(f"SELECT id, term, count(*) AS tf, any_value(length) AS length FROM (SELECT doc_id AS id, len({_WORDS}) AS length, unnest({_WORDS}) AS term FROM documents) GROUP BY 1, 2")
def index_fts(spark, folder):
    return retrieval.postings(table(spark, folder, "documents", "doc_id", "text"), "doc_id", "text").select("id", "term", "tf", "length")


def _docs(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents", "doc_id", "text", "created_at", "n_chars", "lang", "kind", "source")
    return d.select(
        F.col("doc_id").alias("id"), F.col("text").alias("content"), "created_at", (F.lit(0.3) + (F.col("n_chars") % 7) / 10.0).alias("importance"), (F.lit(1.0) - (F.col("doc_id") % 10) / 20.0).alias("strength"),
        F.col("kind").alias("memory_type"), F.col("source").alias("project_id"), F.to_json(F.struct(F.array("lang").alias("tags"))).alias("metadata"),
    )


_LISTS = _BM + """, v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
sp AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) - 1 AS r FROM bm QUALIFY r < 20),
de AS (SELECT v.vec_id AS id, row_number() OVER (ORDER BY list_cosine_similarity(v.e, q.e) DESC, v.vec_id) - 1 AS r FROM v, v q WHERE q.vec_id = 0 AND v.vec_id <> 0 QUALIFY r < 20),
"""
_FINAL = """, sc AS (SELECT f.id, f.rrf, f.rrf * (1 + 0.1 * (0.3 + (n_chars % 7) / 10.0) + 0.05 * greatest(0, 1 - (epoch_us(TIMESTAMP '2024-03-01') - epoch_us(created_at)) / 86400e6 / 30)) * (0.1 + 0.9 * (1 - (doc_id % 10) / 20.0)) AS score FROM f JOIN documents ON doc_id = f.id)
SELECT id, round(rrf, 6) AS rrf, round(score, 6) AS score, row_number() OVER (ORDER BY sc.score DESC, id) AS rank FROM sc QUALIFY rank <= 20"""


def _recall(spark, folder, **more) -> DataFrame:
    v = emb(spark, folder).select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    found = retrieval.recall(_docs(spark, folder), v, v.where("id = 0"), TERMS, AS_OF, 20, size=SIZE, index=_index(spark, folder), **more)
    return found.select("id", F.round("rrf", 6).alias("rrf"), F.round("score", 6).alias("score"), "rank")


@query(_LISTS + "f AS (SELECT id, sum(s) AS rrf FROM (SELECT id, 0.6 / (61.0 + r) AS s FROM de UNION ALL SELECT id, 0.4 / (61.0 + r) FROM sp) GROUP BY 1)" + _FINAL)
def recall_rrf(spark, folder):
    return _recall(spark, folder, conf=Retrieval(hops=0))


_GRAPH = f""", e AS (SELECT a.vec_id AS a, b.vec_id AS b, list_cosine_similarity(a.e, b.e) AS c FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= {NEAR}),
seed AS ({{seed}}),
h1 AS (SELECT b AS id, max(c) AS pr FROM e WHERE a IN (SELECT id FROM seed) AND b NOT IN (SELECT id FROM seed) GROUP BY 1 ORDER BY pr DESC, id LIMIT {{most}}),
h2 AS (SELECT * FROM (SELECT id, pr, row_number() OVER (ORDER BY pr DESC, id) AS n FROM (SELECT b AS id, max(c) AS pr FROM e WHERE a IN (SELECT id FROM h1) AND b NOT IN (SELECT id FROM seed) AND b NOT IN (SELECT id FROM h1) GROUP BY 1)) WHERE n <= {{most}} - (SELECT count(*) FROM h1)),
hop AS (SELECT id, 1 AS hop, pr FROM h1 UNION ALL SELECT id, 2, pr FROM h2),
gr AS (SELECT id, hop, row_number() OVER (ORDER BY hop, pr DESC, id) - 1 AS r FROM hop)"""


@query(_LISTS.rstrip().rstrip(",") + _GRAPH.format(seed="SELECT id FROM de WHERE r < 10 UNION SELECT id FROM sp WHERE r < 10", most=20) + """, f AS (SELECT id, sum(s) AS rrf FROM (SELECT id, 0.6 / (61.0 + r) AS s FROM de UNION ALL SELECT id, 0.4 / (61.0 + r) FROM sp
UNION ALL SELECT id, 0.3 * pow(0.5, hop) / (61.0 + greatest((SELECT count(*) FROM de), (SELECT count(*) FROM sp)) + r) FROM gr) GROUP BY 1)""" + _FINAL)
def recall_hybrid_graph(spark, folder):
    e = edge_ops.threshold_edges(emb(spark, folder), "vec_id", "embedding", SIZE, NEAR)
    return _recall(spark, folder, edges=e)


_NOTES = "SELECT doc_id FROM documents WHERE kind = 'note'"


@query(_LISTS.replace("FROM bm QUALIFY", f"FROM bm WHERE id IN ({_NOTES} AND lang = 'en') QUALIFY").replace("v.vec_id <> 0 QUALIFY", f"v.vec_id <> 0 AND v.vec_id IN ({_NOTES} AND lang = 'en') QUALIFY")
       + "f AS (SELECT id, sum(s) AS rrf FROM (SELECT id, 0.6 / (61.0 + r) AS s FROM de UNION ALL SELECT id, 0.4 / (61.0 + r) FROM sp) GROUP BY 1)" + _FINAL)
def recall_prefilter(spark, folder):
    return _recall(spark, folder, conf=Retrieval(hops=0), filters=retrieval.Filters(memory_type="note", tag="en"))


@query(_LISTS + "f AS (SELECT id, sum(s) AS rrf FROM (SELECT id, 0.6 / (61.0 + r) AS s FROM de UNION ALL SELECT id, 0.4 / (61.0 + r) FROM sp) GROUP BY 1)" + _FINAL.replace("ON doc_id = f.id)", f"ON doc_id = f.id WHERE f.id IN ({_NOTES}))").replace(" QUALIFY rank <= 20", ""))
def recall_postfilter(spark, folder):
    return _recall(spark, folder, conf=Retrieval(hops=0), filters=retrieval.Filters(memory_type="note"), filter_mode="post", pool=True)


@query(_V + """, r AS (SELECT q.vec_id AS q, q.label AS ql, v.label AS vl, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(v.e, q.e) DESC, v.vec_id) AS rank FROM v JOIN v q ON v.vec_id <> q.vec_id),
f AS (SELECT q, min(rank) FILTER (ql = vl AND rank <= 10) AS first FROM r GROUP BY 1)
SELECT count(*) AS n_questions, round(avg(CASE WHEN first <= 1 THEN 1.0 ELSE 0 END), 6) AS recall_at_1, round(avg(CASE WHEN first <= 5 THEN 1.0 ELSE 0 END), 6) AS recall_at_5, round(avg(CASE WHEN first <= 10 THEN 1.0 ELSE 0 END), 6) AS recall_at_10, round(avg(coalesce(1.0 / first, 0)), 6) AS mrr FROM f""")
def eval_recall_mrr(spark, folder):
    e = emb(spark, folder)
    near = vectors.nearest(e, e, "vec_id", "embedding", SIZE, 10).select(F.col("query_id").alias("question_id"), "id", "rank")
    labels = e.select("vec_id", "label")
    gold = labels.select(F.col("vec_id").alias("question_id"), "label").join(labels.select(F.col("vec_id").alias("id"), "label"), "label").select("question_id", "id")
    m = retrieval.metrics(near, gold)
    return m.select("n_questions", *[F.round(c, 6).alias(c) for c in m.columns[1:]])


@query(_PAIRS + ", w AS (SELECT 0::BIGINT AS id, 0 AS hop UNION SELECT u.b, w.hop + 1 FROM w JOIN u ON u.a = w.id WHERE w.hop < 2) SELECT id, min(hop) AS hop FROM w GROUP BY 1")
def graph_neighborhood(spark, folder):
    e = edge_ops.threshold_edges(emb(spark, folder), "vec_id", "embedding", SIZE, NEAR)
    nodes, _ = traverse.neighborhood(e, emb(spark, folder).where("vec_id = 0").select("vec_id"), 2, 100_000, NEAR)
    return nodes


@query(_V + _GRAPH.format(seed="SELECT vec_id AS id FROM v WHERE vec_id < 5", most=50) + " SELECT id, hop FROM hop")
def graph_expand(spark, folder):
    e = edge_ops.threshold_edges(emb(spark, folder), "vec_id", "embedding", SIZE, NEAR)
    return traverse.expand(e, emb(spark, folder).where("vec_id < 5").select(F.col("vec_id").alias("id")), 50, 2).select("id", "hop")


_COMP = _PAIRS + ", w AS (SELECT a AS id, a AS c0 FROM u UNION SELECT u.b, w.c0 FROM w JOIN u ON u.a = w.id WHERE w.c0 < u.b), comp AS (SELECT id, min(c0) AS component FROM w GROUP BY 1)"


@query(_COMP + " SELECT id, component FROM comp")
def graph_components(spark, folder):
    return traverse.components(edge_ops.threshold_edges(emb(spark, folder), "vec_id", "embedding", SIZE, NEAR))


@query(_COMP + ", k AS (SELECT component, count(*) AS n FROM comp GROUP BY 1), q AS (SELECT x.component, avg(list_cosine_similarity(va.e, vb.e)) AS cohesion FROM comp x JOIN comp y ON x.component = y.component AND x.id < y.id JOIN v va ON va.vec_id = x.id JOIN v vb ON vb.vec_id = y.id GROUP BY 1) SELECT component, n, round(cohesion, 6) AS cohesion FROM k JOIN q USING (component) WHERE n >= 2")
def cluster_summary(spark, folder):
    e = emb(spark, folder)
    c = lifecycle.clusters(e, "vec_id", "embedding", SIZE, NEAR)
    n = c.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    return n.join(lifecycle.cohesion(c, e, "vec_id", "embedding", SIZE), "component").select("component", "n", F.round("cohesion", 6).alias("cohesion"))


# A code graph derived from the tables: parts are symbols, brands are files, large returned lines are calls.
_SYMBOLS = "('function', 'method', 'type')"
_CG = f"""WITH RECURSIVE n AS (SELECT 'p' || p_size % 2 AS project_id, f || '#' || k || ':' || name AS id, f AS file_path, kind, name, k AS start_line, k + 3 AS end_line, k
  FROM (SELECT p_size, p_partkey AS k, 'src/' || replace(lower(p_brand), '#', '') || '.py' AS f, CASE p_partkey % 10 WHEN 0 THEN 'type' WHEN 1 THEN 'test' WHEN 2 THEN 'import' ELSE 'function' END AS kind,
  CASE WHEN p_partkey % 10 = 1 THEN 'test_s' || (p_partkey + 2) % 300 ELSE 's' || p_partkey % 300 END AS name FROM part)),
c AS (SELECT DISTINCT project_id, file_path, id AS caller_id, 's' || l_suppkey * 3 % 300 AS ref FROM lineitem JOIN n ON k = l_partkey WHERE l_returnflag = 'R' AND l_quantity >= 45 AND kind IN ('function', 'test')),
cr AS (SELECT c.project_id, caller_id AS src_id, n.id AS dst_id, 'calls' AS kind FROM c JOIN n ON n.project_id = c.project_id AND n.name = c.ref AND n.kind IN {_SYMBOLS}
  QUALIFY row_number() OVER (PARTITION BY c.project_id, c.file_path, caller_id, ref ORDER BY n.file_path = c.file_path DESC, n.file_path, start_line, n.id) = 1),
tr AS (SELECT t.project_id, t.id AS src_id, n.id AS dst_id, 'tests' AS kind FROM n t JOIN n ON n.project_id = t.project_id AND n.name = replace(t.name, 'test_', '') AND n.kind IN {_SYMBOLS} WHERE t.kind = 'test'
  QUALIFY row_number() OVER (PARTITION BY t.id ORDER BY n.file_path = t.file_path DESC, n.file_path, n.start_line, n.id) = 1),
ir AS (SELECT s.project_id, s.id AS src_id, n.id AS dst_id, 'extends' AS kind FROM (SELECT x.project_id, x.file_path, x.name AS sub, 's' || x.k * 7 % 300 AS sup, y.id FROM n x JOIN n y ON y.project_id = x.project_id AND y.name = x.name AND y.kind = 'type' WHERE x.kind = 'type'
  QUALIFY row_number() OVER (PARTITION BY x.project_id, x.file_path, x.name, x.k * 7 % 300 ORDER BY y.file_path = x.file_path DESC, y.file_path, y.start_line, y.id) = 1) s JOIN n ON n.project_id = s.project_id AND n.name = s.sup AND n.kind = 'type'
  QUALIFY row_number() OVER (PARTITION BY s.project_id, s.file_path, s.sub, s.sup, s.id ORDER BY n.file_path, n.start_line, n.id) = 1),
e AS (SELECT DISTINCT * FROM (SELECT * FROM cr UNION ALL SELECT * FROM tr UNION ALL SELECT * FROM ir) WHERE src_id <> dst_id), pn AS (SELECT * FROM n WHERE project_id = 'p0'), pe AS (SELECT * FROM e WHERE project_id = 'p0')"""
PROJECT = "p0"


def _code(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    k, text = F.col("p_partkey"), lambda c: c.cast("string")
    kind = F.when(k % 10 == 0, "type").when(k % 10 == 1, "test").when(k % 10 == 2, "import").otherwise("function")
    name = F.when(k % 10 == 1, F.concat(F.lit("test_s"), text((k + 2) % 300))).otherwise(F.concat(F.lit("s"), text(k % 300)))
    file = F.concat(F.lit("src/"), F.replace(F.lower("p_brand"), F.lit("#"), F.lit("")), F.lit(".py"))
    parts = table(spark, folder, "part", "p_partkey", "p_brand", "p_size").select(F.concat(F.lit("p"), text(F.col("p_size") % 2)).alias("project_id"), file.alias("file_path"), kind.alias("kind"), name.alias("name"), k.alias("start_line"), (k + 3).alias("end_line"))
    nodes = parts.select("project_id", F.concat("file_path", F.lit("#"), text(F.col("start_line")), F.lit(":"), "name").alias("id"), "file_path", "kind", "name", "start_line", "end_line")
    lines = table(spark, folder, "lineitem", "l_partkey", "l_suppkey", "l_returnflag", "l_quantity").where("l_returnflag = 'R' AND l_quantity >= 45")
    callers = nodes.where(F.col("kind").isin("function", "test")).withColumnRenamed("start_line", "l_partkey")
    calls = lines.join(callers, "l_partkey").select("project_id", "file_path", F.col("id").alias("caller_id"), F.concat(F.lit("s"), text(F.col("l_suppkey") * 3 % 300)).alias("ref")).distinct()
    tests = nodes.where("kind = 'test'").select("project_id", "file_path", F.col("id").alias("test_id"), F.replace("name", F.lit("test_"), F.lit("")).alias("ref"))
    inherits = nodes.where("kind = 'type'").select("project_id", "file_path", F.col("name").alias("sub"), F.concat(F.lit("s"), text(F.col("start_line") * 7 % 300)).alias("ref")).distinct()
    return nodes, cg.resolve_edges(nodes, calls, tests, inherits)


@query(_CG + " SELECT project_id, src_id, dst_id, kind FROM e")
def cg_resolve(spark, folder):
    return _code(spark, folder)[1].select("project_id", "src_id", "dst_id", "kind")


def _named(name: str) -> str:
    return f"(SELECT id FROM pn WHERE name = '{name}' AND kind IN {_SYMBOLS} ORDER BY file_path, start_line, id LIMIT 1)"


def _hop(text: str):
    q = cg.parse_query(text)

    def run(spark, folder):
        nodes, e = _code(spark, folder)
        return cg.one_hop(nodes, e, q.name, *cg.ONE_HOP[q.op], PROJECT).select("id")

    return run


_HOPS = {"callers_of": ("calls", "dst_id", "src_id"), "callees_of": ("calls", "src_id", "dst_id"), "tests_for": ("tests", "dst_id", "src_id"), "subtypes_of": ("extends", "dst_id", "src_id"), "supertypes_of": ("extends", "src_id", "dst_id")}
for _name, _text in (("cg_callers", "callers_of:s3"), ("cg_callees", "callees_of:s3"), ("cg_tests", "tests_for:s3"), ("cg_subtypes", "subtypes_of:s70"), ("cg_supertypes", "supertypes_of:s10")):
    _op, _, _symbol = _text.partition(":")
    QUERIES[_name] = _hop(_text)
    ORACLE[_name] = _CG + f" SELECT DISTINCT {_HOPS[_op][2]} AS id FROM pe WHERE kind = '{_HOPS[_op][0]}' AND {_HOPS[_op][1]} = {_named(_symbol)}"


@query(_CG + " SELECT id FROM (SELECT id, name FROM pn WHERE kind = 'import' AND contains(lower(name), 's12') ORDER BY name, id LIMIT 50)")
def cg_imports(spark, folder):
    return cg.imports_of(*_code(spark, folder), "S12", PROJECT).select("id")


@query(_CG + " SELECT id FROM (SELECT id, name FROM pn WHERE contains(lower(name), 's1') ORDER BY name, id LIMIT 50)")
def cg_keyword(spark, folder):
    return cg.keyword(_code(spark, folder)[0], "S1", project_id=PROJECT).select("id")


@query(_CG + f""", w AS (SELECT {_named('s184')} AS id, 0 AS hop UNION SELECT pe.dst_id, w.hop + 1 FROM w JOIN pe ON pe.src_id = w.id AND pe.kind IN ('calls', 'imports') WHERE w.hop < 40)
SELECT {_named('s184')} AS first_id, {_named('s213')} AS last_id, min(hop) AS n_steps FROM w WHERE id = {_named('s213')} HAVING count(*) > 0""")
def cg_path(spark, folder):
    found = cg.path(*_code(spark, folder), "s184", "s213", PROJECT)
    return spark.createDataFrame([(found[0], found[-1], len(found) - 1)] if found else [], "first_id string, last_id string, n_steps int")


_BLAST = _CG + f""", w AS (SELECT id, 0 AS hop FROM pn WHERE name = 's3' AND kind IN {_SYMBOLS} UNION SELECT pe.src_id, w.hop + 1 FROM w JOIN pe ON pe.dst_id = w.id AND pe.kind IN ('calls', 'imports', 'extends') WHERE w.hop < 5),
reached AS (SELECT id, min(hop) AS hop FROM w GROUP BY 1)"""


@query(_BLAST + " SELECT id, hop FROM reached WHERE hop > 0")
def blast_radius(spark, folder):
    return cg.blast_radius(*_code(spark, folder), "s3", project_id=PROJECT)[0]


@query(_BLAST + " SELECT 'dependent' AS role, id, hop FROM reached WHERE hop > 0 UNION ALL SELECT DISTINCT 'test', src_id, 0 FROM pe WHERE kind = 'tests' AND dst_id IN (SELECT id FROM reached)"
       + "".join(f" UNION ALL SELECT DISTINCT '{op}', {out}, 1 FROM pe WHERE kind = '{kind}' AND {at} = {_named('s3')}" for op, (kind, at, out) in _HOPS.items()))
def cg_explore(spark, folder):
    return cg.explore(*_code(spark, folder), "s3", project_id=PROJECT)


_FIRST = "(SELECT id FROM pn ORDER BY file_path, start_line, id LIMIT 200)"


@query(_CG + f" SELECT src_id, dst_id FROM pe WHERE src_id IN {_FIRST} AND dst_id IN {_FIRST}")
def codegraph_view(spark, folder):
    return cg.view(*_code(spark, folder), limit=200, project_id=PROJECT)[1].select("src_id", "dst_id")


@query("""WITH now AS (SELECT p_brand AS path, count(*) AS h FROM part GROUP BY 1), old AS (SELECT p_brand AS path, count(*) FILTER (p_size <> 11) AS h FROM part WHERE p_brand <> 'Brand#1' GROUP BY 1 UNION ALL SELECT 'gone-' || r_name, 1 FROM region)
SELECT now.path, 'again' AS what FROM now LEFT JOIN old USING (path) WHERE old.h IS DISTINCT FROM now.h UNION ALL SELECT path, 'gone' FROM old WHERE path NOT IN (SELECT path FROM now)""")
def cg_incremental(spark, folder):
    """Files (brands) whose symbols changed since the stored state, in which one size, one brand and some others differ."""
    part, hashed = table(spark, folder, "part", "p_brand", "p_size"), lambda c: c.cast("string").alias("content_hash")
    now = part.groupBy(F.lit("p").alias("project_id"), F.col("p_brand").alias("path")).agg(hashed(F.count(F.lit(1))))
    old = part.where("p_brand <> 'Brand#1'").groupBy(F.lit("p").alias("project_id"), F.col("p_brand").alias("path")).agg(hashed(F.count(F.when(F.col("p_size") != 11, 1))))
    dropped = table(spark, folder, "region", "r_name").select(F.lit("p").alias("project_id"), F.concat(F.lit("gone-"), "r_name").alias("path"), F.lit("1").alias("content_hash"))
    again, gone = cg.changed_files(now, old.unionByName(dropped))
    return again.select("path", F.lit("again").alias("what")).unionByName(gone.select("path", F.lit("gone").alias("what")))


@query(_CG + ", f AS (SELECT project_id, count(DISTINCT file_path) AS n_files, count(*) AS n_nodes FROM n GROUP BY 1), k AS (SELECT project_id, count(*) AS n_edges FROM e GROUP BY 1) SELECT project_id, n_files, n_nodes, coalesce(n_edges, 0) AS n_edges FROM f LEFT JOIN k USING (project_id)")
def cg_stats(spark, folder):
    nodes, e = _code(spark, folder)
    return cg.stats(nodes.select("project_id", "file_path").distinct(), nodes, e)


@query(_CG + """ SELECT 0 AS part, 'digraph codegraph {' AS line UNION ALL SELECT 1, '  "' || id || '" [label="' || name || '"];' FROM n UNION ALL SELECT 2, '  "' || src_id || '" -> "' || dst_id || '" [label="' || kind || '"];' FROM e UNION ALL SELECT 3, '}'""")
def export_dot(spark, folder):
    return export.dot(*_code(spark, folder))


@query(_CG + """ SELECT 1 AS part, '    <node id="' || id || '"><data key="name">' || name || '</data></node>' AS line FROM n UNION ALL SELECT 2, '    <edge source="' || src_id || '" target="' || dst_id || '"><data key="kind">' || kind || '</data></edge>' FROM e""")
def export_graphml(spark, folder):
    return export.graphml(*_code(spark, folder)).where("part IN (1, 2)")


@query(_CG + """ SELECT to_json({'record': 'node', 'project_id': project_id, 'id': id, 'file_path': file_path, 'kind': kind, 'name': name, 'start_line': start_line, 'end_line': end_line})::VARCHAR AS line FROM n
UNION ALL SELECT to_json({'record': 'edge', 'project_id': project_id, 'src_id': src_id, 'dst_id': dst_id, 'kind': kind})::VARCHAR FROM e""")
def export_graph_json(spark, folder):
    return export.graph_json(*_code(spark, folder))


@query("""WITH e AS (SELECT user_id, event_type, lead(event_type, 1) OVER w AS b, lead(event_type, 2) OVER w AS c, count(*) OVER (PARTITION BY user_id) AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
k AS (SELECT user_id, event_type || ' > ' || b || ' > ' || c AS gram, count(*) AS n_times FROM e WHERE n >= 4 AND c IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 2)
SELECT * FROM (SELECT user_id, gram, n_times, row_number() OVER (PARTITION BY user_id ORDER BY n_times DESC, gram) AS rank FROM k) WHERE rank <= 5""")
def ngram_events(spark, folder):
    return lifecycle.frequent_sequences(table(spark, folder, "events"), "user_id", ["ts", "event_id"], "event_type")
