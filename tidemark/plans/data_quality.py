"""Queries on references and sessions over the memory tables, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.keys import normal_key, normal_label
from tidemark.operators.references import Referrer, Target, orphan_references, orphan_report
from tidemark.operators.streams import paired_sessions, session_totals
from tidemark.sources.tables import table


def _orphans(spark: SparkSession, folder: str) -> DataFrame:
    memories = table(spark, folder, "memories", "id", "project_id", "created_at")
    referrers = [
        Referrer("edges", table(spark, folder, "edges", "id", "src_id", "dst_id", "created_at"), ["src_id", "dst_id"], "memories"),
        Referrer("jobs", table(spark, folder, "jobs", "id", "memory_id", "created_at"), ["memory_id"], "memories"),
        Referrer("memories", memories, ["project_id"], "projects"),
    ]
    targets = {
        "memories": Target(memories, table(spark, folder, "deleted_memories", "memory_id"), deleted_col="memory_id"),
        "projects": Target(table(spark, folder, "projects", "id", "created_at"), table(spark, folder, "deleted_projects", "project_id"), deleted_col="project_id"),
    }
    return orphan_references(referrers, targets)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return _orphans(spark, folder)


def p2_report(spark: SparkSession, folder: str) -> DataFrame:
    return orphan_report(_orphans(spark, folder))


def _sessions(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "memories", "id", "project_id", "source", "created_at")
    return paired_sessions(rows, {"project_id": normal_key(F.col("project_id")), "source": normal_label(F.col("source"))})


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return _sessions(spark, folder).select("project_id", "source", "start_us", "end_us", "n_rows")


def p7_totals(spark: SparkSession, folder: str) -> DataFrame:
    return session_totals(_sessions(spark, folder), ["source"])


def _key(c: str) -> str:
    return f"nullif(lower(trim({c})), '')"


_P2 = f"""
WITH m AS (SELECT DISTINCT {_key('id')} AS id, {_key('project_id')} AS p, created_at FROM memories),
e AS (SELECT DISTINCT {_key('id')} AS id, {_key('src_id')} AS s, {_key('dst_id')} AS d, created_at FROM edges),
j AS (SELECT DISTINCT {_key('id')} AS id, {_key('memory_id')} AS k, created_at FROM jobs),
refs AS (
  SELECT 'edges' AS table_name, 'src_id' AS field_name, id AS row_id, s AS ref_id, created_at, 'm' AS target FROM e
  UNION ALL SELECT 'edges', 'dst_id', id, d, created_at, 'm' FROM e
  UNION ALL SELECT 'jobs', 'memory_id', id, k, created_at, 'm' FROM j
  UNION ALL SELECT 'memories', 'project_id', id, p, created_at, 'p' FROM m),
rec AS (
  SELECT 'm' AS target, id, min(created_at) AS made FROM m GROUP BY id
  UNION ALL SELECT 'p', {_key('id')}, min(created_at) FROM projects GROUP BY 2),
gone AS (
  SELECT DISTINCT 'm' AS target, {_key('memory_id')} AS id FROM deleted_memories
  UNION ALL SELECT DISTINCT 'p', {_key('project_id')} FROM deleted_projects)
SELECT table_name, field_name, row_id, ref_id,
  CASE WHEN rec.id IS NOT NULL THEN 'late' WHEN gone.id IS NOT NULL THEN 'deleted' ELSE 'missing' END AS ref_state,
  strftime(refs.created_at, '%Y-%m') AS ref_month
FROM refs LEFT JOIN rec ON rec.target = refs.target AND rec.id = refs.ref_id
LEFT JOIN gone ON gone.target = refs.target AND gone.id = refs.ref_id
WHERE ref_id IS NOT NULL AND (rec.id IS NULL OR rec.made > refs.created_at)
"""

_P7 = f"""
WITH m AS (SELECT DISTINCT {_key('id')} AS id, {_key('project_id')} AS project_id, lower(trim(source)) AS source, epoch_us(created_at) AS us FROM memories),
f AS (SELECT *, CASE WHEN us - lag(us) OVER w <= 1800000000 THEN 0 ELSE 1 END AS first FROM m WHERE project_id IS NOT NULL
      WINDOW w AS (PARTITION BY project_id, source ORDER BY us, id)),
s AS (SELECT *, sum(first) OVER (PARTITION BY project_id, source ORDER BY us, id ROWS UNBOUNDED PRECEDING) AS no FROM f),
g AS (SELECT project_id, source, min(us) AS start_us, max(us) AS end_us, count(*) AS n_rows FROM s GROUP BY project_id, source, no)
"""

QUERIES = {"p2_found": p2_found, "p2_report": p2_report, "p7_found": p7_found, "p7_totals": p7_totals}
ORACLE = {
    "p2_found": _P2,
    "p2_report": f"SELECT table_name, field_name, ref_state, ref_month, count(*) AS n_refs, count(DISTINCT ref_id) AS n_keys FROM ({_P2}) GROUP BY ALL",
    "p7_found": _P7 + "SELECT project_id, source, start_us, end_us, n_rows FROM g",
    "p7_totals": _P7 + "SELECT source, count(*) AS n_sessions, CAST(sum(n_rows) AS BIGINT) AS n_rows, CAST(sum(end_us - start_us) AS BIGINT) / 1e6 AS seconds FROM g GROUP BY source",
}
