"""Queries on edges of real vectors, consolidation, pipeline rows, stored tables and streams, and their SQL twins."""

from __future__ import annotations

import uuid
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import Jobs, Lifecycle
from tidemark.functions import metadata as md
from tidemark.functions.keys import normal_key
from tidemark.operators import context, edges as edge_ops, evaluate, lifecycle, retrieval, sessions
from tidemark.operators.vectors import usable
from tidemark.plans.memory_queries import _GAP, _MEM, _TAGS, AS_OF, edges, jobs, mem
from tidemark.session import materialize, shared_dir
from tidemark.sources.ingest import EVENT_TYPES
from tidemark.sources.store import delete_cold, insert_or_replace, read_cold, upsert, write_cold
from tidemark.sources.tables import table
from tidemark.streaming import pipelines

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
SIZE = 384


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return register


def vec(spark: SparkSession, folder: str) -> DataFrame:
    """``memory_id, embedding``: usable vectors, one per memory."""
    v = table(spark, folder, "vec_memories", "memory_id", "embedding").where(usable(F.col("embedding"), SIZE))
    v = v.select(normal_key(F.col("memory_id")).alias("memory_id"), "embedding").where("memory_id IS NOT NULL")
    return v.groupBy("memory_id").agg(F.max("embedding").alias("embedding"))


_VEC = _MEM.replace("WITH mem", "WITH RECURSIVE mem") + f""", vec AS (SELECT id, max(e) AS e FROM (SELECT nullif(lower(trim(memory_id)), '') AS id, embedding::DOUBLE[] AS e FROM vec_memories
  WHERE len(embedding) = {SIZE} AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0) WHERE id IS NOT NULL GROUP BY 1)"""
_NN = "SELECT a.id AS q, b.id AS o, list_cosine_similarity(a.e, b.e) AS c, row_number() OVER (PARTITION BY a.id ORDER BY round(list_cosine_similarity(a.e, b.e), 9) DESC, b.id) AS r FROM {v} a JOIN {v} b ON a.id <> b.id"
_SIM = "SELECT least(q, o) AS src_id, greatest(q, o) AS dst_id, 'similarity' AS edge_type, round(max(c), 6) AS weight FROM nn WHERE r <= 20 AND c >= 0.82 GROUP BY 1, 2"


@query(_VEC + f", nn AS ({_NN.format(v='vec')}) {_SIM}")
def edge_similarity_nn(spark, folder):
    e = edge_ops.similarity_edges(vec(spark, folder), "memory_id", "embedding", SIZE)
    return e.select("src_id", "dst_id", "edge_type", F.round("weight", 6).alias("weight"))


_TAG_PAIRS = "SELECT a.id AS src_id, b.id AS dst_id, 'tag_overlap' AS edge_type, round(len(list_intersect(a.t, b.t)) / (len(a.t) + len(b.t) - len(list_intersect(a.t, b.t))), 6) AS weight FROM {t} a JOIN {t} b ON a.id < b.id WHERE len(list_intersect(a.t, b.t)) >= 2 OR 2 * len(list_intersect(a.t, b.t)) >= len(a.t) + len(b.t) - len(list_intersect(a.t, b.t))"


@query(_MEM + f", tg AS (SELECT id, list_distinct({_TAGS}) AS t FROM mem WHERE len({_TAGS}) > 0) " + _TAG_PAIRS.format(t="tg"))
def edge_tag_overlap(spark, folder):
    return edge_ops.tag_edges(mem(spark, folder, "metadata"), digits=6).select("src_id", "dst_id", "edge_type", "weight")


@query(_VEC + f""", plain AS (SELECT * FROM mem WHERE memory_type <> 'code_context'), pv AS (SELECT vec.* FROM vec WHERE id IN (SELECT id FROM plain)), nn AS ({_NN.format(v='pv')}),
tg AS (SELECT id, list_distinct({_TAGS}) AS t FROM plain WHERE len({_TAGS}) > 0),
every AS ({_SIM} UNION ALL SELECT a.id, b.id, 'temporal', 1.0 FROM plain a JOIN plain b ON a.project_id = b.project_id AND a.id < b.id AND abs(epoch_us(a.created_at) - epoch_us(b.created_at)) <= 300000000 UNION ALL {_TAG_PAIRS.format(t='tg')})
SELECT src_id, dst_id, edge_type, weight FROM every""")
def edges_all(spark, folder):
    e = edge_ops.all_edges(mem(spark, folder, "memory_type", "project_id", "created_at", "metadata"), vec(spark, folder), SIZE, digits=6)
    return e.select("src_id", "dst_id", "edge_type", "weight")


_CONF = Lifecycle(consolidation_threshold=0.8, ngram=2)
_COMP = """cp AS (SELECT a.id AS a, b.id AS b, list_cosine_similarity(a.e, b.e) AS c FROM {v} a JOIN {v} b ON a.id <> b.id WHERE list_cosine_similarity(a.e, b.e) >= 0.75),
cw AS (SELECT a AS id, a AS c0 FROM cp UNION SELECT cp.b, cw.c0 FROM cw JOIN cp ON cp.a = cw.id WHERE cw.c0 < cp.b), comp AS (SELECT id, min(c0) AS component FROM cw GROUP BY 1)"""
_CONS = _VEC + ", cand AS (SELECT * FROM mem WHERE project_id IS NOT NULL AND NOT is_decoy AND strength < 0.8 AND tier <> 'cold'), cv AS (SELECT vec.* FROM vec WHERE id IN (SELECT id FROM cand)), " + _COMP.format(v="cv") + """,
member AS (SELECT component, m.*, row_number() OVER (PARTITION BY component ORDER BY coalesce(importance, 0) DESC, m.id DESC) AS place, count(*) OVER (PARTITION BY component) AS n FROM comp JOIN cand m USING (id)),
coh AS (SELECT x.component, avg(list_cosine_similarity(va.e, vb.e)) AS cohesion FROM comp x JOIN comp y ON x.component = y.component AND x.id < y.id JOIN cv va ON va.id = x.id JOIN cv vb ON vb.id = y.id GROUP BY 1)"""


def _candidates(spark: SparkSession, folder: str) -> DataFrame:
    return lifecycle.consolidation_candidates(mem(spark, folder, "content", "project_id", "is_decoy", "strength", "tier", "importance"), _CONF)


@query(_CONS + """ SELECT sha256('decoy:' || component) AS id, CASE WHEN length(trim(content)) > 280 THEN left(trim(content), 277) || '...' ELSE trim(content) END AS content,
greatest(0, (SELECT max(importance) FROM member k WHERE k.component = member.component)) AS importance, round(cohesion, 6) AS cohesion, n AS n_children FROM member JOIN coh USING (component) WHERE place = 1""")
def consolidate_rows(spark, folder):
    rows, _, _ = lifecycle.consolidate(_candidates(spark, folder), vec(spark, folder), SIZE, _CONF)
    return rows.withColumn("cohesion", F.round("cohesion", 6))


@query(_CONS + " SELECT sha256('decoy:' || component) AS decoy_id, id AS child_id, 'cold' AS tier FROM member")
def consolidate_lineage(spark, folder):
    _, lineage, tiers = lifecycle.consolidate(_candidates(spark, folder), vec(spark, folder), SIZE, _CONF)
    return lineage.join(tiers.withColumnRenamed("id", "child_id"), "child_id").select("decoy_id", "child_id", "tier")


@query(_VEC + f""", n AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY created_at DESC, id) AS r FROM mem WHERE project_id IS NOT NULL AND NOT is_decoy AND NOT list_contains({_TAGS}, 'session-summary')),
t AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY importance DESC NULLS LAST, id) AS t FROM n WHERE r <= 30),
su AS (SELECT project_id, sha256('summary:' || project_id || ':' || left(string_agg(coalesce(content, ''), chr(10) || '---' || chr(10) ORDER BY t), 2000)) AS id, count(*) AS n_children FROM t WHERE t <= 10 GROUP BY 1),
ep AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY created_at DESC, id) AS r FROM mem WHERE memory_type = 'episodic' AND NOT is_decoy AND project_id IS NOT NULL) WHERE r <= 200),
ev AS (SELECT vec.* FROM vec WHERE id IN (SELECT id FROM ep)), {_COMP.format(v='ev')},
fa AS (SELECT min(project_id) AS project_id, sha256('decoy:' || component) AS id, count(*) AS n_children FROM comp JOIN ep USING (id) GROUP BY component),
co AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY created_at DESC, id) AS r FROM mem WHERE memory_type = 'code_context' AND project_id IS NOT NULL),
st AS (SELECT *, coalesce(CASE WHEN json_valid(metadata) THEN json_extract_string(metadata, '$.tool') END, nullif(regexp_extract(coalesce(content, ''), '^\\s*(\\S+)', 1), ''), '?') AS tool, count(*) OVER (PARTITION BY project_id) AS n FROM co WHERE r <= 200),
gr AS (SELECT project_id, id, lead(id, 1) OVER w AS id2, tool || ' > ' || lead(tool, 1) OVER w AS gram, n FROM st WINDOW w AS (PARTITION BY project_id ORDER BY created_at, id)),
gk AS (SELECT * FROM (SELECT project_id, gram, row_number() OVER (PARTITION BY project_id ORDER BY count(*) DESC, gram) AS rank FROM gr WHERE gram IS NOT NULL AND n >= 4 GROUP BY 1, 2 HAVING count(*) >= 2) WHERE rank <= 5),
pr AS (SELECT project_id, sha256('procedure:' || project_id || ':' || gram) AS id, count(DISTINCT child) AS n_children FROM (SELECT project_id, gram, unnest([gr.id, gr.id2]) AS child FROM gr JOIN gk USING (project_id, gram)) GROUP BY 1, 2)
SELECT 'episodic' AS memory_type, * FROM su UNION ALL SELECT 'semantic', * FROM fa UNION ALL SELECT 'procedural', * FROM pr""")
def pipeline_rows(spark, folder):
    m = materialize(mem(spark, folder, "content", "project_id", "is_decoy", "strength", "tier", "importance", "memory_type", "metadata", "created_at"), "pipeline-memories")
    rows, lineage, _ = lifecycle.pipeline_rows(m, vec(spark, folder), SIZE, AS_OF, _CONF)
    n = lineage.groupBy(F.col("decoy_id").alias("id")).agg(F.count(F.lit(1)).alias("n_children"))
    return rows.join(n, "id").select("memory_type", "project_id", "id", "n_children")


@query(_MEM + ", names AS (SELECT lower(trim(id)) AS project_id, max(name) AS project_name FROM projects GROUP BY 1) SELECT id, project_id, project_name FROM mem LEFT JOIN names USING (project_id)")
def project_names(spark, folder):
    p = table(spark, folder, "projects", "id", "name").withColumn("id", normal_key(F.col("id")))
    return context.with_project_names(mem(spark, folder, "project_id"), p).select("id", "project_id", "project_name")


@query(_MEM + """, p AS (SELECT lower(trim(id)) AS id, name, last_seen_at FROM projects QUALIFY row_number() OVER (PARTITION BY lower(trim(id)) ORDER BY last_seen_at DESC NULLS LAST, name DESC NULLS LAST) = 1)
SELECT id, name, (SELECT count(*) FROM mem WHERE project_id = p.id) AS n_memories, row_number() OVER (ORDER BY last_seen_at DESC NULLS LAST, id) AS rank FROM p""")
def projects_last_seen(spark, folder):
    p = table(spark, folder, "projects", "id", "name", "last_seen_at").withColumn("id", normal_key(F.col("id")))
    return context.projects_by_last_seen(p, mem(spark, folder, "project_id")).select("id", "name", "n_memories", "rank")


@query(_MEM + f"SELECT project_id, id, content FROM mem WHERE project_id IS NOT NULL AND list_contains({_TAGS}, 'cursor') QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY created_at DESC, id DESC) = 1")
def session_summary_latest(spark, folder):
    return context.latest_session_summary(mem(spark, folder, "project_id", "metadata", "content", "created_at"), "cursor")


@query(_MEM + "SELECT id, content, project_id FROM mem WHERE tier = 'cold' AND id IS NOT NULL AND id NOT IN (SELECT memory_id FROM dead)")
def cold_tier(spark, folder):
    """The cold memories written to the tier, the deleted ones removed from it, the rest fetched by their ids."""
    place = f"{shared_dir(spark)}/tidemark/cold-{uuid.uuid4().hex}"
    m = mem(spark, folder, "content", "project_id", "tier").where("tier = 'cold'")
    write_cold(m, place)
    dead = table(spark, folder, "deleted_memories", "memory_id").select(normal_key(F.col("memory_id")).alias("id")).where("id IS NOT NULL")
    delete_cold(spark, place, dead)
    return read_cold(spark, place, m.select("id"))


@query("""WITH p AS (SELECT DISTINCT lower(trim(id)) AS id, name FROM projects), g AS (SELECT lower(trim(project_id)) AS id, max(reason) AS name FROM deleted_projects GROUP BY 1)
SELECT id, name FROM g UNION ALL SELECT id, max(name) FROM p WHERE id NOT IN (SELECT id FROM g) GROUP BY 1""")
def upsert_projects(spark, folder):
    p = table(spark, folder, "projects", "id", "name").withColumn("id", normal_key(F.col("id"))).groupBy("id").agg(F.max("name").alias("name"))
    g = table(spark, folder, "deleted_projects", "project_id", "reason").groupBy(normal_key(F.col("project_id")).alias("id")).agg(F.max("reason").alias("name"))
    return upsert(p, g, ["id"])


@query("SELECT lower(trim(id)) AS id, status, attempts FROM jobs QUALIFY row_number() OVER (PARTITION BY lower(trim(id)) ORDER BY updated_at DESC, attempts DESC, status DESC) = 1")
def insert_or_replace_jobs(spark, folder):
    j = jobs(spark, folder, "status", "attempts", "updated_at")
    old = j.withColumns({"status": F.lit("stale"), "updated_at": F.col("updated_at") - F.expr("INTERVAL 1 HOUR")})
    return insert_or_replace(old, j, ["id"], "updated_at").select("id", "status", "attempts")


_PASSED = """, d AS (SELECT *, row_number() OVER (ORDER BY created_at, id) AS n FROM job WHERE status = 'pending' AND (attempts = 0 OR epoch_us(TIMESTAMP '2024-03-01') - epoch_us(updated_at) >= 10000000 * pow(2, least(attempts, 6)))),
o AS (SELECT id, job_type = 'summarize' AS ok FROM d WHERE n <= 64)"""


@query(_MEM + _PASSED + """ SELECT job.id, CASE WHEN o.id IS NULL THEN status WHEN ok THEN 'done' WHEN attempts + 1 >= 3 THEN 'failed' ELSE 'pending' END AS status, attempts + CASE WHEN o.id IS NOT NULL AND NOT ok THEN 1 ELSE 0 END AS attempts FROM job LEFT JOIN o USING (id)""")
def queue_pass(spark, folder):
    """One pass of the queue, half of the jobs coming in with it: the oldest due ones are worked on, a batch at most."""
    j = jobs(spark, folder, "job_type", "memory_id", "status", "attempts", "last_error", "created_at", "updated_at")
    known = F.pmod(F.xxhash64("id"), F.lit(2)) == 0
    worker = lambda d: d.select("id", (F.col("job_type") == "summarize").alias("ok"), F.lit("no answer").alias("error"))
    return pipelines.queue_pass(j.where(known), j.where(~known), worker, AS_OF, Jobs()).select("id", "status", "attempts")


def _source(spark: SparkSession, rows: DataFrame, label: str) -> tuple[DataFrame, str, str]:
    """A stream over a folder that rows are written to, the folder, and a place for the query's own files."""
    base = f"{shared_dir(spark)}/tidemark/stream/{label}-{uuid.uuid4().hex}"
    rows.limit(0).write.parquet(f"{base}/in")
    return spark.readStream.schema(rows.schema).parquet(f"{base}/in"), f"{base}/in", base


def run_in_parts(spark: SparkSession, rows: list[DataFrame], label: str, make) -> DataFrame:
    """What a streaming query gives in append mode when the parts of ``rows`` arrive one after another; state and watermark
    live on between the parts."""
    stream, place, base = _source(spark, rows[0], label)
    out = make(stream)
    for part in rows:
        part.write.mode("append").parquet(place)
        q = out.writeStream.outputMode("append").format("parquet").option("path", f"{base}/rows").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{base}/rows")


def with_late_rows(events: DataFrame) -> list[DataFrame]:
    """Events in two parts by time; then rows of the first part again, under new ids, which are too late to count, and
    one far later row, after which everything before is final."""
    half = events.agg(F.percentile_approx("ts", 0.5).alias("t")).first()["t"]
    early, rest = events.where(F.col("ts") <= F.lit(half)), events.where(F.col("ts") > F.lit(half))
    late = early.where("event_type = 'error'").withColumn("event_id", -F.col("event_id") - 1)
    last = events.agg(F.max("ts").alias("ts")).select(*[F.lit("end").alias(c) if c == "event_type" else (F.col("ts") + timedelta(days=30)).alias(c) if c == "ts" else F.lit(None).cast(events.schema[c].dataType).alias(c) for c in events.columns])
    return [early, rest, late.unionByName(last)]


@query("SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_counts(spark, folder):
    found = run_in_parts(spark, with_late_rows(table(spark, folder, "events")), "counts", lambda s: pipelines.counts(s, "ts", ["event_type"]))
    return found.select(F.col("window_start").cast("timestamp_ntz").alias("hour"), "event_type", "n")


@query("""WITH f AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) <= 1800000000 THEN 0 ELSE 1 END AS first FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(first) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS no FROM f)
SELECT user_id, min(ts) AS started_at, max(ts) AS ended_at, count(*) AS n_rows FROM s GROUP BY user_id, no""")
def stream_sessions(spark, folder):
    found = run_in_parts(spark, with_late_rows(table(spark, folder, "events")), "sessions", lambda s: pipelines.sessions(s, "ts", ["user_id"]))
    return found.select("user_id", F.col("started_at").cast("timestamp_ntz").alias("started_at"), F.col("ended_at").cast("timestamp_ntz").alias("ended_at"), "n_rows")


@query("""WITH f AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) <= 60000000 THEN 0 ELSE 1 END AS first FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)),
s AS (SELECT *, sum(first) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS no FROM f)
SELECT event_type, max(ts) AS last_event, count(*) AS n_rows FROM s GROUP BY event_type, no""")
def stream_debounce(spark, folder):
    found = run_in_parts(spark, with_late_rows(table(spark, folder, "events")), "debounce", lambda s: pipelines.debounced(s, "ts", ["event_type"], "60 seconds"))
    return found.select("event_type", F.col("last_event").cast("timestamp_ntz").alias("last_event"), "n_rows")


@query("""WITH RECURSIVE f AS (SELECT event_type, min(ts) AS t FROM events GROUP BY 1 UNION ALL
SELECT f.event_type, n.t FROM f, LATERAL (SELECT min(ts) AS t FROM events e WHERE e.event_type = f.event_type AND e.ts >= f.t + INTERVAL 6 HOUR) n WHERE n.t IS NOT NULL)
SELECT event_type, t AS fired_at FROM f""")
def stream_throttle(spark, folder):
    parts = with_late_rows(table(spark, folder, "events"))[:2]
    found = run_in_parts(spark, parts, "throttle", lambda s: pipelines.throttled(s, "ts", "event_type", 6 * 3600))
    return found.select("event_type", F.col("fired_at").cast("timestamp_ntz").alias("fired_at"))


@query("SELECT DISTINCT event_id FROM events")
def stream_dedupe(spark, folder):
    e = table(spark, folder, "events")
    return run_in_parts(spark, [e, e], "dedupe", lambda s: pipelines.deduplicated(s, "ts", ["event_id"], "60 days").select("event_id"))


_KINDS = ", ".join(f"('{k}', '{v}')" for k, v in EVENT_TYPES.items())


@query(_MEM + f""", e AS (SELECT id, content, CASE WHEN json_valid(metadata) THEN json_extract_string(metadata, '$.event') END AS event FROM mem), k(event, memory_type) AS (VALUES {_KINDS})
SELECT memory_type, content, count(*) AS n FROM e JOIN k USING (event) WHERE trim(coalesce(content, '')) <> '' GROUP BY 1, 2""")
def stream_ingest(spark, folder):
    m = mem(spark, folder, "content", "metadata", "created_at", "project_id")
    at = lambda k: F.get_json_object("metadata", f"$.{k}").alias(k)
    events = m.select("content", at("event"), at("client"), at("tool"), "metadata", F.col("created_at").alias("timestamp"), F.col("project_id").alias("project_path"))
    found = run_in_parts(spark, [events], "ingest", lambda s: pipelines.ingest(s))
    return found.groupBy("memory_type", "content").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH o AS (SELECT user_id, ts, event_type <> 'error' AS ok, event_id FROM events), b AS (SELECT *, coalesce(sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER w, 0) AS done FROM o WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id, done ORDER BY ts, event_id) AS k FROM b)
SELECT CAST(user_id AS VARCHAR) AS id, CASE WHEN ok THEN (k - 1) % 3 ELSE (k - 1) % 3 + 1 END AS attempts, CASE WHEN ok THEN 'done' WHEN (k - 1) % 3 = 2 THEN 'failed' ELSE 'pending' END AS status, count(*) AS n FROM r WHERE user_id IS NOT NULL GROUP BY 1, 2, 3""")
def stream_retries(spark, folder):
    """Outcomes one after another: each user's events, an error being a failure; a job that is done or failed starts anew."""
    e = table(spark, folder, "events").where("user_id IS NOT NULL").select(F.col("user_id").cast("string").alias("id"), (F.col("event_type") != "error").alias("ok"), F.col("ts").alias("at"))
    found = run_in_parts(spark, [e], "retries", lambda s: pipelines.retries(s))
    return found.where("status <> 'due'").groupBy("id", "attempts", "status").agg(F.count(F.lit(1)).alias("n"))


_VALID = "CASE WHEN json_valid(metadata) AND json_type(metadata) = 'OBJECT' THEN metadata END"


@query(_MEM + f"""SELECT id, array_to_string(list_concat(list_filter({_TAGS}, lambda x: true), CASE WHEN list_contains({_TAGS}, 'merged') THEN [] ELSE ['merged'] END), ',') AS tags, 'true' AS seen, json_extract_string({_VALID}, '$.client') AS client FROM mem""")
def metadata_merge(spark, folder):
    extra = F.lit('{"tags": ["merged"], "seen": true}')
    merged = mem(spark, folder, "metadata").select("id", md.merge_metadata(F.col("metadata"), extra).alias("m"))
    return merged.select("id", F.array_join(md.tags(F.col("m")), ",").alias("tags"), F.get_json_object("m", "$.seen").alias("seen"), F.get_json_object("m", "$.client").alias("client"))


_LEAF = "CASE json_type(v) WHEN 'VARCHAR' THEN json_extract_string(v, '$') ELSE CAST(v AS VARCHAR) END"


@query(_MEM + f""", o AS (SELECT id, {_VALID} AS m FROM mem), k AS (SELECT id, m, unnest(json_keys(m)) AS k FROM o WHERE m IS NOT NULL), a AS (SELECT id, k, json_extract(m, '$."' || k || '"') AS v FROM k),
b AS (SELECT id, k, v, unnest(json_keys(v)) AS k2 FROM a WHERE json_type(v) = 'OBJECT'), c AS (SELECT id, k || '.' || k2 AS path, json_extract(v, '$."' || k2 || '"') AS v FROM b)
SELECT id, k AS path, {_LEAF} AS value FROM a WHERE json_type(v) <> 'OBJECT' UNION ALL SELECT id, path, {_LEAF} FROM c""")
def metadata_flat(spark, folder):
    return mem(spark, folder, "metadata").select("id", F.explode(md.flatten_json("metadata")).alias("path", "value"))


@query(_MEM + """, s AS (SELECT DISTINCT src_id, dst_id, edge_type, coalesce(label, '') AS l FROM edge WHERE created_at < TIMESTAMP '2024-01-15'),
f AS (SELECT src_id, dst_id, edge_type, coalesce(label, '') AS l, max(weight) AS weight FROM edge WHERE src_id <> dst_id AND src_id <> '' AND dst_id <> '' AND edge_type IS NOT NULL GROUP BY 1, 2, 3, 4)
SELECT src_id, dst_id, edge_type, weight FROM f ANTI JOIN s USING (src_id, dst_id, edge_type, l)""")
def edges_dedupe(spark, folder):
    """All edges against those stored before a day: what is new, each once."""
    e = edges(spark, folder, "src_id", "dst_id", "edge_type", "label", "weight", "created_at")
    fresh = e.where("src_id <> dst_id AND src_id <> '' AND dst_id <> '' AND edge_type IS NOT NULL")
    return edge_ops.new_edges(fresh, e.where("created_at < TIMESTAMP_NTZ '2024-01-15 00:00:00'")).select("src_id", "dst_id", "edge_type", "weight")


_TURN_WORDS = "list_filter(string_split_regex(lower(coalesce(content, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')"


@query(_GAP + f""", q AS (SELECT project_id, content AS question, session_no FROM s WHERE trim(content) <> '' QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY importance DESC NULLS LAST, id) = 1),
d AS (SELECT project_id, id, session_no, {_TURN_WORDS} AS w FROM s), every AS (SELECT project_id, count(*) AS n, avg(len(w)) AS mean FROM d GROUP BY 1),
tf AS (SELECT project_id, id, term, len(any_value(w)) AS length, count(*) AS tf FROM (SELECT *, unnest(w) AS term FROM d) GROUP BY 1, 2, 3),
tm AS (SELECT DISTINCT project_id, unnest({_TURN_WORDS.replace('content', 'question')}) AS term FROM q), hit AS (SELECT * FROM tf JOIN tm USING (project_id, term)),
df AS (SELECT project_id, term, count(*) AS df FROM hit GROUP BY 1, 2),
sc AS (SELECT project_id, id, sum(greatest(1e-6, ln((n - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))) AS score FROM hit JOIN df USING (project_id, term) JOIN every USING (project_id) GROUP BY 1, 2),
rk AS (SELECT project_id, id, row_number() OVER (PARTITION BY project_id ORDER BY round(score, 9) DESC, id) AS rank FROM sc),
first AS (SELECT q.project_id, min(rank) AS first FROM q LEFT JOIN (SELECT rk.*, session_no FROM rk JOIN s USING (project_id, id)) g ON g.project_id = q.project_id AND g.session_no = q.session_no GROUP BY 1)
SELECT count(*) AS n_questions, round(avg(CASE WHEN first <= 1 THEN 1.0 ELSE 0 END), 6) AS recall_at_1, round(avg(CASE WHEN first <= 5 THEN 1.0 ELSE 0 END), 6) AS recall_at_5, round(avg(CASE WHEN first <= 10 THEN 1.0 ELSE 0 END), 6) AS recall_at_10, round(avg(coalesce(1.0 / first, 0)), 6) AS mrr FROM first""")
def eval_questions(spark, folder):
    """A question set from the data: each project's haystack are its sessions, the question is its most important
    memory, the answer that memory's session."""
    m = mem(spark, folder, "project_id", "content", "created_at", "importance").where("project_id IS NOT NULL")
    s = materialize(sessions.gap_sessions(m).withColumn("session_id", F.col("session_no").cast("string")), "questions")
    rows = s.select(F.col("project_id").alias("question_id"), "id", "session_id", "content", F.lit(False).alias("has_answer"))
    asked = s.where("trim(content) <> ''").groupBy(F.col("project_id").alias("question_id"))
    asked = asked.agg(F.min_by(F.struct("content", "session_id"), F.struct(-F.coalesce("importance", F.lit(-1e9)), F.col("id"))).alias("q"))
    instances = asked.select("question_id", F.col("q.content").alias("question"), F.array("q.session_id").alias("answer_session_ids"))
    found = retrieval.metrics(evaluate.ranked_turns(instances, rows), evaluate.gold(instances, rows))
    return found.select("n_questions", *[F.round(c, 6).alias(c) for c in found.columns[1:]])
