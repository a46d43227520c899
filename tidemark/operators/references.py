"""References to records that do not exist, or exist only later.

Skew-aware split: references are counted per key and month before anything else is moved. Of these counts the few heavy
keys (a bounded list) are checked by broadcast, the rest by one shuffle anti-join, and both parts are united. Only rows
that refer to an orphan key are then fetched, and only those are told apart from their copies.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.keys import normal_key
from tidemark.operators.skew import HEAVY_SHARE, heavy_keys, lookup_join
from tidemark.session import materialize

#: Result of :func:`orphan_references`.
ORPHAN_COLUMNS = ("table_name", "field_name", "row_id", "ref_id", "ref_state", "ref_month")


@dataclass(frozen=True)
class Referrer:
    """A table whose ``fields`` hold keys of the records called ``target``."""

    name: str
    rows: DataFrame
    fields: Sequence[str]
    target: str
    id_col: str = "id"
    at_col: str = "created_at"


@dataclass(frozen=True)
class Target:
    """Records that can be referred to, and the keys known to be deleted."""

    records: DataFrame
    deleted: DataFrame
    id_col: str = "id"
    at_col: str = "created_at"
    deleted_col: str = "key"


def _references(r: Referrer) -> DataFrame:
    """``table_name, field_name, row_id, ref_id, ref_at, ref_month, __key`` of every reference of every copy of a row."""
    rows = r.rows.select(
        normal_key(F.col(r.id_col)).alias("row_id"), F.col(r.at_col).alias("ref_at"), *[normal_key(F.col(f)).alias(f"f{i}") for i, f in enumerate(r.fields)]
    )
    pairs = F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f"f{i}").alias("ref_id")) for i, f in enumerate(r.fields)])
    return (
        rows.select("row_id", "ref_at", F.inline(pairs))
        .where(F.col("ref_id").isNotNull())
        .select(F.lit(r.name).alias("table_name"), "field_name", "row_id", "ref_id", "ref_at", F.date_format("ref_at", "yyyy-MM").alias("ref_month"), _target_key(F.lit(r.target), F.col("ref_id")).alias("__key"))
    )


def _target_key(target: Column, key: Column) -> Column:
    """One key column for all targets, so that a project and a memory of the same spelling stay apart."""
    return F.concat_ws("\u0001", target, key)


def _united(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _known(targets: dict[str, Target]) -> DataFrame:
    """``__key, made_at, exists, gone``: one row per key of a record or of a deleted one."""
    parts = []
    for name, t in targets.items():
        made = t.records.select(normal_key(F.col(t.id_col)).alias("ref_id"), F.col(t.at_col).alias("made_at"), F.lit(True).alias("exists"), F.lit(False).alias("gone"))
        gone = t.deleted.select(normal_key(F.col(t.deleted_col)).alias("ref_id"), F.lit(None).cast(made.schema["made_at"].dataType).alias("made_at"), F.lit(False).alias("exists"), F.lit(True).alias("gone"))
        parts.append(made.unionByName(gone).where(F.col("ref_id").isNotNull()).withColumn("__key", _target_key(F.lit(name), F.col("ref_id"))))
    return _united(parts).groupBy("__key").agg(F.min("made_at").alias("made_at"), F.max("exists").alias("exists"), F.max("gone").alias("gone"))


def reference_counts(refs: DataFrame) -> DataFrame:
    """``__key, ref_month, n, first_at``: references per key and month, copies included; combined where they lie first."""
    return refs.groupBy("__key", "ref_month").agg(F.count(F.lit(1)).alias("n"), F.min("ref_at").alias("first_at"))


def orphan_references(referrers: Sequence[Referrer], targets: dict[str, Target], share: int = HEAVY_SHARE) -> DataFrame:
    """One row per referring record and field whose key has no record (``missing``; ``deleted`` if listed as deleted) or
    whose record was created after the referring row (``late``).

    Keys are compared trimmed and in lower case; null, empty and blank keys are no references. A record sent several
    times counts once where its reference and created_at are the same; copies that differ in these are references of
    their own. Rows without an id cannot be recognised as repeats and each count. A referring row or a record without
    created_at is never ``late``, its ref_month is null. Keys of different targets never meet. Extra columns are
    ignored. Empty tables give no rows; at least one referrer and one target are needed.
    """
    refs, known = _united([_references(r) for r in referrers]), _known(targets)
    per_key = reference_counts(refs).groupBy("__key").agg(F.sum("n").alias("n"), F.min("first_at").alias("first_at"))
    per_key = materialize(per_key, "reference-counts")
    heavy = heavy_keys(per_key, "__key", "n", share)
    checked = lookup_join(per_key, known, "__key", heavy)
    # an anti-join that keeps the keys whose record may have come too late for some of their references
    orphan = checked.where(~F.coalesce("exists", F.lit(False)) | (F.col("made_at") > F.col("first_at"))).select("__key", "exists", "gone", "made_at")
    orphan = materialize(orphan.withColumn("orphan", F.lit(True)), "orphan-keys")
    found = lookup_join(refs, orphan, "__key", heavy, only_met=True)
    state = (
        F.when(F.coalesce(F.col("exists"), F.lit(False)), F.when(F.col("made_at") > F.col("ref_at"), F.lit("late")))
        .when(F.col("gone"), F.lit("deleted"))
        .otherwise(F.lit("missing"))
    )
    rows = found.withColumn("ref_state", state).where(F.col("ref_state").isNotNull())
    once = rows.where(F.col("row_id").isNotNull()).select(*ORPHAN_COLUMNS, "ref_at").distinct()
    return once.unionByName(rows.where(F.col("row_id").isNull()).select(*ORPHAN_COLUMNS, "ref_at")).select(*ORPHAN_COLUMNS)


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Orphans counted per table, field, state and month of the referring row."""
    return orphans.groupBy("table_name", "field_name", "ref_state", "ref_month").agg(F.count(F.lit(1)).cast(T.LongType()).alias("n_refs"), F.countDistinct("ref_id").cast(T.LongType()).alias("n_keys"))
