"""Captured events -> memory rows: the same transform for batches and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.config import DEFAULTS, Privacy
from tidemark.functions.text import names_excluded_path, redact

# Event kinds and the memory types they make.
EVENT_TYPES = {
    "tool_use": "code_context", "file_edit": "code_context", "terminal": "code_context", "command_exec": "code_context",
    "user_message": "episodic", "assistant_message": "episodic", "session_start": "episodic", "session_end": "episodic", "session_error": "episodic", "permission": "episodic",
    "todo_update": "procedural",
}


def dispositions(events: DataFrame, conf: Privacy = DEFAULTS.privacy) -> DataFrame:
    """``events`` with ``content`` redacted, ``memory_type`` and ``disposition``: accepted, or why not (empty, too_large,
    unknown_event, excluded_path, redacted_empty). Stateless: nothing is dropped or deduplicated here."""
    kinds = F.create_map(*[F.lit(x) for kv in EVENT_TYPES.items() for x in kv])
    raw, clean = F.coalesce(F.col("content"), F.lit("")), redact(F.coalesce(F.col("content"), F.lit("")), conf.redaction_tags)
    kind = F.try_element_at(kinds, F.col("event"))
    why = (
        F.when(F.trim(raw) == "", "empty").when(F.octet_length(raw) > conf.max_content_bytes, "too_large").when(kind.isNull(), "unknown_event")
        .when(names_excluded_path(raw, conf.exclude_paths), "excluded_path").when(F.trim(clean) == "", "redacted_empty").otherwise("accepted")
    )
    return events.withColumn("disposition", why).withColumn("memory_type", kind).withColumn("content", clean)


def memory_rows(events: DataFrame, conf: Privacy = DEFAULTS.privacy) -> DataFrame:
    """Memory rows of the accepted events: tags from client and tool, the session key hoisted to the top level."""
    ok = dispositions(events, conf).where("disposition = 'accepted'")
    session = F.get_json_object("metadata", "$.session_id")
    meta = F.to_json(F.struct(
        F.array_compact(F.array("client", "tool")).alias("tags"), F.col("event"), F.col("client"), F.col("timestamp"), F.col("tool"), session.alias("session_id"), F.col("metadata").alias("extra"),
    ))
    return ok.select(
        F.sha2(F.concat_ws("\u0001", F.col("timestamp").cast("string"), "client", "event", "project_path", "content"), 256).alias("id"), "content", "memory_type",
        F.lit(conf.passive_importance).alias("importance"), F.col("project_path"), F.lit("passive").alias("source"), meta.alias("metadata"), F.col("timestamp").alias("created_at"),
        F.lit(0).cast("long").alias("access_count"), F.lit(False).alias("is_decoy"), F.lit("hot").alias("tier"), F.lit(1.0).alias("strength"),
    )
