"""Canonical schemas, and evolution of older tables to them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MEMORIES = (
    "id string, content string, memory_type string, importance double, project_id string, source string, metadata string, created_at timestamp, updated_at timestamp, accessed_at timestamp, "
    "access_count long, is_decoy boolean, tier string, strength double, cold_path string, compressed_content string, compression_mode string"
)
VECTORS = "memory_id string, embedding array<float>"
EDGES = "id string, src_id string, dst_id string, edge_type string, label string, weight double, created_at timestamp"
PROJECTS = "id string, path string, git_remote string, name string, created_at timestamp, last_seen_at timestamp"
JOBS = "id string, job_type string, memory_id string, status string, attempts long, last_error string, created_at timestamp, updated_at timestamp"
LINEAGE = "decoy_id string, child_id string"
CODE_FILES = "project_id string, path string, language string, content_hash string, updated_at timestamp"
CODE_NODES = "project_id string, id string, file_path string, kind string, name string, start_line int, end_line int"
CODE_EDGES = "project_id string, src_id string, dst_id string, kind string"
EVENTS = "event string, client string, project_path string, content string, tool string, metadata string, timestamp timestamp"

MEMORY_TYPES = ("episodic", "semantic", "procedural", "fact", "preference", "code_context")
SOURCES = ("explicit", "passive", "cli", "import")
EDGE_TYPES = ("explicit", "similarity", "temporal", "tag_overlap", "relation")
JOB_TYPES = ("compute_edges", "summarize", "extract_entities", "extract_relations", "score_importance", "extract_compress")
TIERS = ("hot", "warm", "cold")

#: Columns added to memories by version, with the values of older rows.
MEMORY_MIGRATIONS: dict[int, dict[str, tuple[str, object]]] = {
    2: {"is_decoy": ("boolean", False), "tier": ("string", "hot"), "strength": ("double", 1.0), "cold_path": ("string", None)},
    4: {"compressed_content": ("string", None), "compression_mode": ("string", None)},
}


def migrate(df: DataFrame, version: int, migrations: dict[int, dict[str, tuple[str, object]]] = MEMORY_MIGRATIONS) -> DataFrame:
    """``df`` of schema ``version`` with the columns of all later versions; columns that exist are kept."""
    for v in sorted(migrations):
        if v > version:
            for name, (kind, value) in migrations[v].items():
                if name not in df.columns:
                    df = df.withColumn(name, F.lit(value).cast(kind))
    return df


def enum_or(column: str, domain: tuple[str, ...], default: str):
    """Known label in normal spelling, else the default."""
    c = F.lower(F.trim(F.col(column)))
    return F.when(c.isin(*domain), c).otherwise(F.lit(default))
