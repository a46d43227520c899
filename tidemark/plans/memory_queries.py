"""Queries over the memory tables and their SQL twins. ``AS_OF`` stands for the present."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import Lifecycle
from tidemark.functions import metadata as md
from tidemark.functions.keys import normal_key, normal_label
from tidemark.functions.scoring import context_score, days_between, forgetting_strength, recency
from tidemark.functions.text import ellipsis, expand, git_remote, names_excluded_path, redact
from tidemark.functions.text import compress as compress_udf
from tidemark.operators import context, edges as edge_ops, jobs as job_ops, lifecycle, sessions
from tidemark.operators.retrieval import Filters
from tidemark.sources.ingest import dispositions
from tidemark.sources.store import by_ids, delete_memories, delete_projects, detect_projects, insert_or_ignore
from tidemark.sources.tables import latest_copy, table

AS_OF = datetime(2024, 3, 1)
_AT = "TIMESTAMP '2024-03-01 00:00:00'"


def mem(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """``id`` and ``columns`` of memories, once each (the latest copy), keys and labels in normal form.

    Nothing else is read or moved but what tells copies apart.
    """
    m = table(spark, folder, "memories", *dict.fromkeys(["id", "updated_at", "access_count", *columns]))
    m = latest_copy(m.withColumn("id", normal_key(F.col("id"))), "id", "updated_at", "access_count").select(*dict.fromkeys(["id", *columns]))
    forms = {"memory_type": normal_label, "project_id": normal_key, "source": normal_label}
    return m.withColumns({c: f(F.col(c)) for c, f in forms.items() if c in columns})


_MEM = """WITH mem AS (SELECT * FROM (SELECT * REPLACE (nullif(lower(trim(id)), '') AS id, lower(trim(memory_type)) AS memory_type, nullif(lower(trim(project_id)), '') AS project_id, lower(trim(source)) AS source)
  FROM memories) QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC, access_count DESC) = 1),
job AS (SELECT * FROM (SELECT * REPLACE (nullif(lower(trim(id)), '') AS id, nullif(lower(trim(memory_id)), '') AS memory_id) FROM jobs) QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC, attempts DESC, status DESC) = 1),
edge AS (SELECT DISTINCT lower(trim(id)) AS id, lower(trim(src_id)) AS src_id, lower(trim(dst_id)) AS dst_id, lower(trim(edge_type)) AS edge_type, label, weight, created_at FROM edges),
dead AS (SELECT DISTINCT lower(trim(memory_id)) AS memory_id FROM deleted_memories WHERE trim(memory_id) <> ''),
gone AS (SELECT DISTINCT lower(trim(project_id)) AS project_id FROM deleted_projects WHERE trim(project_id) <> '')
"""


def jobs(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """``id`` and ``columns`` of jobs, once each, keys in normal form."""
    j = table(spark, folder, "jobs", *dict.fromkeys(["id", "updated_at", "attempts", "status", *columns])).withColumn("id", normal_key(F.col("id")))
    j = latest_copy(j, "id", "updated_at", "attempts", "status").select(*dict.fromkeys(["id", *columns]))
    return j.withColumn("memory_id", normal_key(F.col("memory_id"))) if "memory_id" in columns else j


def edges(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """Edges once each, ends and types in normal form; with ``columns`` just those, once each."""
    e = table(spark, folder, "edges", *columns)
    forms = {"id": normal_key, "src_id": normal_label, "dst_id": normal_label, "edge_type": normal_label}
    return e.withColumns({c: f(F.col(c)) for c, f in forms.items() if c in e.columns}).distinct()


def _keys(spark: SparkSession, folder: str, name: str, column: str) -> DataFrame:
    """``id``: the keys of a table of deletions, in normal form."""
    return table(spark, folder, name, column).select(normal_key(F.col(column)).alias("id")).where("id IS NOT NULL").distinct()


QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return register


_TAGS = "CASE WHEN json_valid(metadata) THEN coalesce(json_extract_string(metadata, '$.tags[*]'), []) ELSE [] END"


@query(_MEM + "SELECT id, memory_type, (SELECT count(*) FROM mem WHERE memory_type = 'episodic') AS total FROM mem WHERE memory_type = 'episodic' ORDER BY created_at DESC, id LIMIT 20 OFFSET 40")
def mem_list_page(spark, folder):
    return context.memory_page(mem(spark, folder, "memory_type", "created_at"), 20, 40, memory_type="episodic").select("id", "memory_type", "total")


@query(_MEM + f"SELECT id FROM mem WHERE memory_type = 'code_context' AND created_at >= TIMESTAMP '2024-01-15' AND list_contains({_TAGS}, 'cursor')")
def mem_filters_all(spark, folder):
    return Filters(memory_type="code_context", since=datetime(2024, 1, 15), tag="cursor").of(mem(spark, folder, "memory_type", "created_at", "metadata")).select("id")


@query(_MEM + "SELECT id, project_id FROM mem WHERE id IN (SELECT memory_id FROM job WHERE status = 'failed')")
def mem_by_ids(spark, folder):
    failed = jobs(spark, folder, "memory_id", "status").where("status = 'failed'").select(F.col("memory_id").alias("id"))
    return by_ids(mem(spark, folder, "project_id"), failed).select("id", "project_id")


@query(_MEM + """SELECT 'total' AS kind, 'memories' AS name, count(*) AS n FROM mem UNION ALL SELECT 'total', 'edges', count(*) FROM edge UNION ALL SELECT 'total', 'projects', count(*) FROM projects
UNION ALL SELECT 'total', 'pending_jobs', count(*) FROM job WHERE status = 'pending' UNION ALL SELECT 'memory_type', memory_type, count(*) FROM mem GROUP BY 2 UNION ALL SELECT 'tier', tier, count(*) FROM mem GROUP BY 2""")
def stats_breakdown(spark, folder):
    return context.memory_stats(mem(spark, folder, "memory_type", "tier"), edges(spark, folder), table(spark, folder, "projects"), jobs(spark, folder, "status"))


@query(_MEM + "SELECT project_id, memory_type, count(*) AS n, round(avg(importance), 6) AS mean_importance FROM mem GROUP BY ROLLUP (project_id, memory_type)")
def stats_rollup(spark, folder):
    return mem(spark, folder, "project_id", "memory_type", "importance").rollup("project_id", "memory_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("importance"), 6).alias("mean_importance"))


@query(_MEM + "SELECT job_type, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'running') AS running FROM job WHERE status IN ('pending', 'running') GROUP BY job_type")
def job_activity(spark, folder):
    return job_ops.activity(jobs(spark, folder, "job_type", "status"))


@query(_MEM + f"SELECT id, job_type, attempts FROM job WHERE status = 'pending' AND (attempts = 0 OR epoch_us({_AT}) - epoch_us(updated_at) >= 10000000 * pow(2, least(attempts, 6)))")
def jobs_due(spark, folder):
    return job_ops.due(jobs(spark, folder, "job_type", "attempts", "status", "updated_at"), AS_OF).select("id", "job_type", "attempts")


@query(_MEM + """SELECT id, CASE WHEN status <> 'pending' THEN status WHEN ok THEN 'done' WHEN attempts + 1 >= 3 THEN 'failed' ELSE 'pending' END AS status,
  attempts + CASE WHEN status = 'pending' AND NOT ok THEN 1 ELSE 0 END AS attempts FROM (SELECT *, length(id) % 2 = 1 OR ascii(right(id, 1)) % 2 = 0 AS ok FROM job)""")
def jobs_transition(spark, folder):
    j = jobs(spark, folder, "status", "attempts", "last_error", "updated_at")
    ok = (F.length("id") % 2 == 1) | (F.ascii(F.right("id", F.lit(1))) % 2 == 0)
    outcomes = j.where("status = 'pending'").select("id", ok.alias("ok"), F.when(~ok, "boom").alias("error"))
    return job_ops.after_pass(j, outcomes, AS_OF).select("id", "status", "attempts")


@query(_MEM + "SELECT DISTINCT id AS memory_id, t AS job_type, 'pending' AS status FROM mem, (VALUES ('compute_edges'), ('summarize')) v(t) WHERE octet_length(encode(coalesce(content, ''))) >= 280")
def jobs_enqueue(spark, folder):
    long = mem(spark, folder, "content").where(F.octet_length(F.coalesce("content", F.lit(""))) >= 280)
    return job_ops.enqueue(long, ("compute_edges", "summarize"), AS_OF).select("memory_id", "job_type", "status")


@query(_MEM + """SELECT least(a.id, b.id) AS src_id, greatest(a.id, b.id) AS dst_id, 'temporal' AS edge_type, 1.0::DOUBLE AS weight FROM mem a JOIN mem b ON a.project_id = b.project_id AND a.id < b.id
AND abs(epoch_us(a.created_at) - epoch_us(b.created_at)) <= 300000000 WHERE a.memory_type <> 'code_context' AND b.memory_type <> 'code_context'""")
def edge_temporal(spark, folder):
    m = mem(spark, folder, "project_id", "created_at", "memory_type").where("memory_type <> 'code_context'")
    return edge_ops.temporal_edges(m).select("src_id", "dst_id", "edge_type", "weight")


@query(_MEM + "SELECT DISTINCT src_id, dst_id, 'explicit' AS edge_type FROM edge WHERE edge_type = 'explicit' AND src_id <> dst_id")
def edge_explicit(spark, folder):
    return edge_ops.explicit_edges(edges(spark, folder, "src_id", "dst_id", "edge_type").where("edge_type = 'explicit'")).select("src_id", "dst_id", "edge_type")


_GAP = _MEM + """, f AS (SELECT *, CASE WHEN epoch_us(created_at) - epoch_us(lag(created_at) OVER w) <= 1800000000 THEN 0 ELSE 1 END AS first FROM mem WHERE project_id IS NOT NULL WINDOW w AS (PARTITION BY project_id ORDER BY created_at, id)),
s AS (SELECT *, sum(first) OVER (PARTITION BY project_id ORDER BY created_at, id ROWS UNBOUNDED PRECEDING) AS session_no FROM f)
"""


@query(_GAP + "SELECT project_id, CAST(session_no AS BIGINT) AS session_no, count(*) AS n, min(created_at) AS started_at, max(created_at) AS ended_at FROM s GROUP BY 1, 2")
def sessions_gap(spark, folder):
    s = sessions.gap_sessions(mem(spark, folder, "project_id", "created_at").where("project_id IS NOT NULL"))
    return s.groupBy("project_id", "session_no").agg(F.count(F.lit(1)).alias("n"), F.min("created_at").alias("started_at"), F.max("created_at").alias("ended_at"))


@query(_MEM + """, f AS (SELECT *, CASE WHEN epoch_us(created_at) - epoch_us(lag(created_at) OVER w) <= 1800000000 AND project_id IS NOT DISTINCT FROM lag(project_id) OVER w THEN 0 ELSE 1 END AS first FROM mem WINDOW w AS (ORDER BY created_at, id)),
s AS (SELECT *, sum(first) OVER (ORDER BY created_at, id ROWS UNBOUNDED PRECEDING) AS session_no FROM f) SELECT CAST(session_no AS BIGINT) AS session_no, count(*) AS n, min(created_at) AS started_at FROM s GROUP BY 1""")
def sessions_interleaved(spark, folder):
    s = sessions.interleaved_sessions(mem(spark, folder, "project_id", "created_at"))
    return s.groupBy("session_no").agg(F.count(F.lit(1)).alias("n"), F.min("created_at").alias("started_at"))


_KEY = "CASE WHEN json_valid(metadata) THEN coalesce(json_extract_string(metadata, '$.session_id'), json_extract_string(metadata, '$.extra.session_id')) END"


@query(_MEM + f"SELECT {_KEY} AS session_no, count(*) AS n, min(created_at) AS started_at, max(created_at) AS ended_at FROM mem WHERE {_KEY} IS NOT NULL GROUP BY 1")
def sessions_keyed(spark, folder):
    s = sessions.keyed_sessions(mem(spark, folder, "metadata", "created_at"))
    return s.groupBy("session_no").agg(F.count(F.lit(1)).alias("n"), F.min("created_at").alias("started_at"), F.max("created_at").alias("ended_at"))


@query(_GAP + """SELECT project_id, CAST(session_no AS BIGINT) AS session_no, memory_count, started_at, duration_s, avg_strength, type_counts FROM
(SELECT project_id, session_no, count(*) AS memory_count, min(created_at) AS started_at, (epoch_us(max(created_at)) - epoch_us(min(created_at))) / 1e6 AS duration_s, round(coalesce(avg(strength), 1), 6) AS avg_strength FROM s GROUP BY 1, 2)
JOIN (SELECT project_id, session_no, string_agg(k || ':' || n, ',' ORDER BY k || ':' || n) AS type_counts FROM (SELECT project_id, session_no, coalesce(memory_type, '?') AS k, count(*) AS n FROM s GROUP BY 1, 2, 3) GROUP BY 1, 2) USING (project_id, session_no)""")
def timeline_stats(spark, folder):
    s = sessions.session_stats(sessions.gap_sessions(mem(spark, folder, "project_id", "created_at", "memory_type", "source", "strength").where("project_id IS NOT NULL")), ["project_id", "session_no"])
    return s.select("project_id", "session_no", "memory_count", "started_at", "duration_s", F.round("avg_strength", 6).alias("avg_strength"), "type_counts")


_AGE = f"greatest((epoch_us({_AT}) - epoch_us(created_at)) / 86400e6, 0)"
_SINCE = f"greatest((epoch_us({_AT}) - epoch_us(coalesce(accessed_at, created_at))) / 86400e6, 0)"


@query(_MEM + f"SELECT id, round(least(1, exp(-{_AGE} / (1 + ln(1 + coalesce(access_count, 0)) / (1 + {_SINCE} / 7)))), 6) AS strength FROM mem")
def strength_decay(spark, folder):
    return mem(spark, folder, "created_at", "accessed_at", "access_count").select("id", F.round(forgetting_strength(F.col("created_at"), F.col("accessed_at"), F.col("access_count"), F.lit(AS_OF)), 6).alias("strength"))


_WEAK = Lifecycle(min_strength=0.6, prune_strength=0.4)
_COLD = f"NOT is_decoy AND tier <> 'cold' AND strength < 0.6 AND (epoch_us({_AT}) - epoch_us(created_at)) / 86400e6 >= 14 AND access_count < 3"


@query(_MEM + f"SELECT id FROM mem WHERE {_COLD}")
def cold_candidates(spark, folder):
    return lifecycle.cold_candidates(mem(spark, folder, "is_decoy", "tier", "strength", "created_at", "access_count"), AS_OF, _WEAK).select("id")


def _lineage(m: DataFrame) -> DataFrame:
    """Each project's decoys hold its plain memories: a stand-in where the lineage table isn't stored."""
    d = m.where("is_decoy AND project_id IS NOT NULL").groupBy("project_id").agg(F.min("id").alias("decoy_id"))
    return m.where("NOT is_decoy").join(d, "project_id").select("decoy_id", F.col("id").alias("child_id"))


_LINE = """, line AS (SELECT d.decoy_id, m.id AS child_id FROM mem m JOIN (SELECT project_id, min(id) AS decoy_id FROM mem WHERE is_decoy AND project_id IS NOT NULL GROUP BY 1) d USING (project_id) WHERE NOT m.is_decoy)
"""


@query(_MEM + _LINE + f"SELECT id, CASE WHEN id IN (SELECT child_id FROM line) THEN 'archive' WHEN strength < 0.4 AND access_count = 0 AND project_id IS NOT NULL THEN 'prune' ELSE 'keep' END AS action FROM mem WHERE {_COLD}")
def decay_classify(spark, folder):
    m = mem(spark, folder, "is_decoy", "tier", "strength", "created_at", "access_count", "project_id")
    return lifecycle.decay_actions(m, _lineage(m), AS_OF, _WEAK)


@query(_MEM + _LINE + f""", own AS (SELECT id, round(least(1, exp(-{_AGE} / (1 + ln(1 + coalesce(access_count, 0)) / (1 + {_SINCE} / 7)))), 6) AS strength FROM mem WHERE NOT is_decoy)
SELECT m.id, coalesce(max(own.strength), 0) AS strength FROM mem m LEFT JOIN line ON line.decoy_id = m.id LEFT JOIN own ON own.id = line.child_id WHERE m.is_decoy GROUP BY m.id""")
def decoy_max(spark, folder):
    m = mem(spark, folder, "is_decoy", "created_at", "accessed_at", "access_count", "project_id")
    return lifecycle.updated_strengths(m, _lineage(m), AS_OF).join(m.where("is_decoy").select("id"), "id", "left_semi").select("id", F.round("strength", 6).alias("strength"))


@query(_MEM + "SELECT id, project_id FROM mem WHERE project_id IS NOT NULL AND NOT is_decoy AND strength < 0.3 AND tier <> 'cold'")
def consolidation_candidates(spark, folder):
    return lifecycle.consolidation_candidates(mem(spark, folder, "project_id", "is_decoy", "strength", "tier")).select("id", "project_id")


_SCORE = f"(0.1 + coalesce(importance, 0)) / (1 + {_AGE} / 7) * (1 + ln(1 + coalesce(access_count, 0))) * (0.1 + 0.9 * coalesce(strength, 1))"
_RANKED = _MEM + f""", n AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY created_at DESC, id) AS new FROM mem WHERE project_id IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY {_SCORE} DESC, id) AS rn, coalesce(compressed_content, content, '') AS text FROM n WHERE new <= 200),
b AS (SELECT *, sum(octet_length(encode(text))) OVER (PARTITION BY project_id ORDER BY rn ROWS UNBOUNDED PRECEDING) AS used FROM r)
"""


@query(_RANKED + "SELECT project_id, id, rn, CAST(used AS BIGINT) AS used FROM b WHERE used <= 8000 OR rn = 1")
def context_budget(spark, folder):
    kept = context.within_budget(context.ranked_context(mem(spark, folder, "project_id", "created_at", "importance", "access_count", "strength", "compressed_content", "content"), AS_OF), 8000, F.octet_length("text"))
    return kept.select("project_id", "id", "rn", "used")


@query(_RANKED + "SELECT project_id, count(*) AS n_memories, left(string_agg(text, chr(10) ORDER BY rn), 8000) AS context FROM b WHERE used <= 8000 OR rn = 1 GROUP BY 1")
def project_context(spark, folder):
    return context.project_context(mem(spark, folder, "project_id", "created_at", "importance", "access_count", "strength", "compressed_content", "content"), AS_OF)


@query(_MEM + f""", n AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY created_at DESC, id) AS r FROM mem WHERE project_id IS NOT NULL AND NOT is_decoy AND NOT list_contains({_TAGS}, 'session-summary')),
t AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY importance DESC NULLS LAST, id) AS t FROM n WHERE r <= 30)
SELECT project_id, count(*) AS n_rows, left(string_agg(coalesce(content, ''), chr(10) || '---' || chr(10) ORDER BY t), 2000) AS summary FROM t WHERE t <= 10 GROUP BY 1""")
def session_summary_top(spark, folder):
    return lifecycle.session_summaries(mem(spark, folder, "project_id", "is_decoy", "metadata", "created_at", "importance", "content"))


@query(_MEM + """, c AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY created_at DESC, id) AS r FROM mem WHERE memory_type = 'code_context' AND project_id IS NOT NULL),
s AS (SELECT *, coalesce(CASE WHEN json_valid(metadata) THEN json_extract_string(metadata, '$.tool') END, nullif(regexp_extract(coalesce(content, ''), '^\\s*(\\S+)', 1), ''), '?') AS tool, count(*) OVER (PARTITION BY project_id) AS n FROM c WHERE r <= 200),
g AS (SELECT project_id, tool || ' > ' || lead(tool, 1) OVER w AS gram FROM s WHERE n >= 4 WINDOW w AS (PARTITION BY project_id ORDER BY created_at, id)),
k AS (SELECT project_id, gram, count(*) AS n_times FROM g WHERE gram IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 2)
SELECT * FROM (SELECT project_id, gram, n_times, row_number() OVER (PARTITION BY project_id ORDER BY n_times DESC, gram) AS rank FROM k) WHERE rank <= 5""")
def ngram_top(spark, folder):
    return lifecycle.procedures(mem(spark, folder, "memory_type", "project_id", "created_at", "metadata", "content"), Lifecycle(ngram=2))


@query(_MEM + "SELECT id, regexp_replace('x <private lang=\"a\">' || content || '</PRIVATE> y ' || content, '(?is)<private(?:\\s[^>]*)?>.*?</private\\s*>', '', 'g') AS text FROM mem WHERE content IS NOT NULL")
def redact_text(spark, folder):
    m = mem(spark, folder, "content").where("content IS NOT NULL")
    text = F.concat(F.lit('x <private lang="a">'), "content", F.lit("</PRIVATE> y "), "content")
    return m.select("id", redact(text, ("private",)).alias("text"))


@query(_MEM + """SELECT id FROM mem WHERE len(list_filter(string_split_regex(coalesce(content, ''), '\\s+'), lambda w: regexp_matches(regexp_replace(w, '^[!-\\-:-@\\[-`{-~]+|[!-\\-:-@\\[-`{-~]+$', '', 'g'), '^(?:(?:.*/)?.*\\.sql)$|^(?:(?:.*/)?services/.*)$'))) > 0""")
def exclude_paths(spark, folder):
    return mem(spark, folder, "content").where(names_excluded_path(F.col("content"), ("**/*.sql", "**/services/**"))).select("id")


@query()
def token_savings(spark, folder):
    return context.token_savings(mem(spark, folder, "content", "compressed_content"), None)


@query(_MEM + "SELECT count(*) AS n, count(*) AS n_same FROM mem WHERE content IS NOT NULL")
def compress_roundtrip(spark, folder):
    m = mem(spark, folder, "content").where("content IS NOT NULL").select("content", expand(compress_udf("content")).alias("back"))
    return m.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("content") == F.col("back"), 1)).alias("n_same"))


_REMOTE = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(git_remote), '^[^:]*://', ''), '^.*@', ''), '^([^:]*):\\d[^/]*/?', '\\1/'), '^([^:/]*):', '\\1/'), '(\\.git)?/*$', '')"


@query(f"SELECT id, CASE WHEN regexp_matches(r, '^[^/]+/.+$') THEN lower(regexp_extract(r, '^([^/]+)/(.+)$', 1)) || '/' || regexp_extract(r, '^([^/]+)/(.+)$', 2) END AS remote FROM (SELECT DISTINCT id, {_REMOTE} AS r FROM projects WHERE git_remote IS NOT NULL)")
def git_remote_norm(spark, folder):
    return table(spark, folder, "projects", "id", "git_remote").where("git_remote IS NOT NULL").select("id", git_remote(F.col("git_remote")).alias("remote")).distinct()


@query(_MEM + f"SELECT t AS tag, count(*) AS n FROM (SELECT id, unnest(list_distinct({_TAGS})) AS t FROM mem) GROUP BY 1")
def tag_counts(spark, folder):
    return mem(spark, folder, "metadata").select(F.explode(F.array_distinct(md.tags(F.col("metadata")))).alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


@query(_MEM + """, e AS (SELECT id, content, CASE WHEN json_valid(metadata) THEN json_extract_string(metadata, '$.event') END AS event FROM mem)
SELECT id, CASE WHEN trim(coalesce(content, '')) = '' THEN 'empty' WHEN event IS NULL OR event NOT IN ('tool_use', 'file_edit', 'terminal', 'command_exec', 'user_message', 'assistant_message', 'session_start', 'session_end', 'session_error', 'permission', 'todo_update') THEN 'unknown_event' ELSE 'accepted' END AS disposition FROM e""")
def event_ingest_dispositions(spark, folder):
    m = mem(spark, folder, "content", "metadata").select("id", "content", F.get_json_object("metadata", "$.event").alias("event"), F.get_json_object("metadata", "$.client").alias("client"), "metadata")
    return dispositions(m).select("id", "disposition")


@query(_MEM + "SELECT id FROM mem ORDER BY created_at DESC, id LIMIT 500")
def graph_sample_nodes(spark, folder):
    from tidemark.operators.traverse import sample

    return sample(mem(spark, folder, "created_at"), edges(spark, folder, "id", "src_id", "dst_id"), 500)[0].select("id")


@query(_MEM + ", n AS (SELECT id FROM mem ORDER BY created_at DESC, id LIMIT 2000) SELECT DISTINCT e.id, e.src_id, e.dst_id FROM edge e WHERE src_id IN (SELECT id FROM n) AND dst_id IN (SELECT id FROM n)")
def graph_sample_edges(spark, folder):
    from tidemark.operators.traverse import sample

    return sample(mem(spark, folder, "created_at"), edges(spark, folder, "id", "src_id", "dst_id"), 2000)[1].select("id", "src_id", "dst_id").distinct()


@query(_MEM + "SELECT DISTINCT e.id FROM edge e, (SELECT memory_id AS k FROM dead) d WHERE e.src_id = d.k OR e.dst_id = d.k")
def edges_incident(spark, folder):
    from tidemark.operators.traverse import edges_of

    return edges_of(edges(spark, folder, "id", "src_id", "dst_id"), _keys(spark, folder, "deleted_memories", "memory_id")).select("id").distinct()


@query(_MEM + _LINE + """SELECT 'memories' AS table_name, id AS row_id, NULL AS other_id FROM mem WHERE id IS NULL OR id NOT IN (SELECT memory_id FROM dead) UNION ALL SELECT 'jobs', id, memory_id FROM job WHERE memory_id IS NULL OR memory_id NOT IN (SELECT memory_id FROM dead)
UNION ALL SELECT DISTINCT 'edges', src_id, dst_id FROM edge WHERE (src_id IS NULL OR src_id NOT IN (SELECT memory_id FROM dead)) AND (dst_id IS NULL OR dst_id NOT IN (SELECT memory_id FROM dead))
UNION ALL SELECT DISTINCT 'vectors', lower(trim(memory_id)), NULL FROM vec_memories WHERE lower(trim(memory_id)) NOT IN (SELECT memory_id FROM dead)
UNION ALL SELECT 'lineage', decoy_id, child_id FROM line WHERE decoy_id NOT IN (SELECT memory_id FROM dead) AND child_id NOT IN (SELECT memory_id FROM dead)""")
def delete_cascade(spark, folder):
    """What is left of every table once the deleted memories are gone from it."""
    ids = _keys(spark, folder, "deleted_memories", "memory_id")
    m = mem(spark, folder, "is_decoy", "project_id")
    vectors = table(spark, folder, "vec_memories", "memory_id").select(normal_key(F.col("memory_id")).alias("memory_id")).where("memory_id IS NOT NULL").distinct()
    left = delete_memories(ids, m, vectors, edges(spark, folder, "src_id", "dst_id"), jobs(spark, folder, "memory_id"), _lineage(m))
    keys = {"memories": ("id", None), "jobs": ("id", "memory_id"), "edges": ("src_id", "dst_id"), "vectors": ("memory_id", None), "lineage": ("decoy_id", "child_id")}
    parts = [left[t].select(F.lit(t).alias("table_name"), F.col(a).alias("row_id"), (F.col(b) if b else F.lit(None).cast("string")).alias("other_id")) for t, (a, b) in keys.items()]
    return reduce(DataFrame.unionByName, parts)


@query(_MEM + "SELECT CASE WHEN project_id NOT IN (SELECT project_id FROM gone) THEN project_id END AS project_id, count(*) AS n FROM mem GROUP BY 1")
def delete_set_null(spark, folder):
    ids = _keys(spark, folder, "deleted_projects", "project_id")
    left = delete_projects(ids, table(spark, folder, "projects"), mem(spark, folder, "project_id"))
    return left["memories"].groupBy("project_id").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH p AS (SELECT lower(trim(id)) AS id, max(name) AS name FROM projects GROUP BY 1), g AS (SELECT lower(trim(project_id)) AS id, CASE WHEN count(*) > count(reason) THEN NULL ELSE min(reason) END AS name FROM deleted_projects GROUP BY 1)
SELECT id, name FROM p UNION ALL SELECT id, name FROM g WHERE id NOT IN (SELECT id FROM p)""")
def insert_or_ignore_projects(spark, folder):
    p = table(spark, folder, "projects", "id", "name").groupBy(normal_key(F.col("id")).alias("id")).agg(F.max("name").alias("name"))
    g = table(spark, folder, "deleted_projects", "project_id", "reason").select(normal_key(F.col("project_id")).alias("id"), F.col("reason").alias("name"))
    return insert_or_ignore(p, g, ["id"])


@query("""WITH w AS (SELECT DISTINCT path, git_remote FROM projects UNION SELECT DISTINCT path || '-copy', git_remote FROM projects),
p AS (SELECT path, min(id) AS id FROM projects GROUP BY 1), r AS (SELECT git_remote, min(id) AS id FROM projects WHERE git_remote <> '' GROUP BY 1)
SELECT w.path, CASE WHEN p.id IS NOT NULL THEN 'path' WHEN r.id IS NOT NULL THEN 'remote' ELSE 'new' END AS found_by FROM w LEFT JOIN p USING (path) LEFT JOIN r ON r.git_remote = w.git_remote""")
def detect_project(spark, folder):
    p = table(spark, folder, "projects", "id", "path", "git_remote")
    wanted = p.select("path", "git_remote").unionByName(p.select(F.concat("path", F.lit("-copy")).alias("path"), "git_remote")).distinct()
    return detect_projects(wanted, p).select("path", "found_by")


@query(_MEM + f"SELECT id, round(greatest(0, 1 - ((epoch_us({_AT}) - epoch_us(created_at)) / 86400e6) / 30), 6) AS recency, round({_SCORE}, 6) AS score, CASE WHEN length(content) > 60 THEN left(content, 57) || '...' ELSE content END AS head FROM mem")
def scalar_scores(spark, folder):
    m = mem(spark, folder, "created_at", "importance", "access_count", "strength", "content")
    age = days_between(F.lit(AS_OF), F.col("created_at"))
    score = context_score(F.coalesce("importance", F.lit(0.0)), age, F.coalesce("access_count", F.lit(0)), F.coalesce("strength", F.lit(1.0)))
    return m.select("id", F.round(recency(age), 6).alias("recency"), F.round(score, 6).alias("score"), ellipsis(F.col("content"), 60).alias("head"))


