"""Session groups of memories and the timeline over them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.metadata import session_key
from tidemark.functions.scoring import seconds_between

#: Width of the slices of time that a key's rows are cut into.
SLICE_SECONDS = 86_400


def keyed_sessions(rows: DataFrame) -> DataFrame:
    """Rows with a session key in their metadata: ``session_no`` is that key."""
    return rows.withColumn("session_no", session_key(F.col("metadata"))).where(F.col("session_no").isNotNull())


def _with(rows: DataFrame, small: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` joined with one row per ``keys``; null keys are equal. Comes as an equality join."""
    names = {k: f"__on_{k}" for k in keys}
    on = [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()]
    return rows.join(small.select(*[F.col(k).alias(n) for k, n in names.items()], *[c for c in small.columns if c not in keys]), reduce(lambda x, y: x & y, on)).drop(*names.values())


def _sliced(rows: DataFrame, at: str, slice_s: int) -> DataFrame:
    """``__t`` and its time slice ``__k``; rows without a time are a slice of their own, before all others."""
    t = F.unix_micros(F.col(at).cast("timestamp"))
    return rows.withColumn("__t", t).withColumn("__k", F.coalesce(F.floor(F.col("__t") / F.lit(slice_s * 1_000_000)), F.lit(-(1 << 60)).cast("bigint")))


def gap_sessions(rows: DataFrame, gap_s: int = 1800, by: tuple[str, ...] = ("project_id",), at: str = "created_at", id_col: str = "id", slice_s: int = SLICE_SECONDS) -> DataFrame:
    """``session_no`` of rows per ``by``: a new one after a gap of more than ``gap_s`` seconds.

    Rows are compared within slices of time, and slices by their last rows, so that no task sees all rows of a key.
    """
    keys = [*by, "__k"]
    r = _sliced(rows, at, slice_s)
    order, along = Window.partitionBy(*keys).orderBy("__t", id_col), Window.partitionBy(*by).orderBy("__k")
    before = r.groupBy(*keys).agg(F.max("__t").alias("__last")).select(*keys, F.lag("__last").over(along).alias("__before"))
    r = _with(r, before, keys)
    first = F.when(F.col("__t") - F.coalesce(F.lag("__t").over(order), F.col("__before")) <= gap_s * 1_000_000, 0).otherwise(1)
    r = r.withColumn("__first", first)
    base = r.groupBy(*keys).agg(F.sum("__first").alias("n"))
    base = base.select(*keys, (F.sum("n").over(along.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("__base"))
    r = _with(r, base, keys)
    return r.withColumn("session_no", F.col("__base") + F.sum("__first").over(order.rowsBetween(Window.unboundedPreceding, 0))).select(*rows.columns, "session_no")


def numbered(rows: DataFrame, by: tuple[str, ...], order: list[str], slice_s: int = SLICE_SECONDS) -> DataFrame:
    """``rows`` with ``__no``, the place of each among those of its key (from 0), and ``__of``, how many these are. The
    first column of ``order`` is a time; the work is cut by it, so that no task sees all rows of a key."""
    keys = [*by, "__k"]
    r = _sliced(rows, order[0], slice_s)
    along = Window.partitionBy(*by).orderBy("__k")
    sizes = r.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.select(*keys, (F.sum("n").over(along.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("__base"), F.sum("n").over(Window.partitionBy(*by)).alias("__of"))
    within = Window.partitionBy(*keys).orderBy(*order)
    return _with(r, sizes, keys).withColumn("__no", F.col("__base") + F.row_number().over(within) - 1).select(*rows.columns, "__no", "__of")


def interleaved_sessions(rows: DataFrame, gap_s: int = 1800, by: str = "project_id", at: str = "created_at", id_col: str = "id", slice_s: int = 86_400) -> DataFrame:
    """``session_no`` over the global order of time: a new session after a gap or wherever the project changes.

    The order is global, the work is not: rows are numbered within slices of time, and slices joined by their last rows.
    """
    us = F.unix_micros(F.col(at).cast("timestamp"))
    r = rows.withColumn("__t", us).where(F.col("__t").isNotNull()).withColumn("__k", F.floor(F.col("__t") / F.lit(slice_s * 1_000_000)))
    order = Window.partitionBy("__k").orderBy("__t", id_col)
    last = r.groupBy("__k").agg(F.max(F.struct("__t", F.col(id_col), F.col(by).alias("p"))).alias("l"))
    along = Window.orderBy("__k")  # one row per slice of time
    before = last.select("__k", F.lag("l").over(along).alias("__before"))
    r = r.join(before, "__k").withColumn("__pt", F.coalesce(F.lag("__t").over(order), F.col("__before.__t"))).withColumn("__pp", F.when(F.row_number().over(order) == 1, F.col("__before.p")).otherwise(F.lag(by).over(order)))
    same = (F.col("__t") - F.col("__pt") <= gap_s * 1_000_000) & F.col(by).eqNullSafe(F.col("__pp"))
    r = r.withColumn("__first", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1))
    base = r.groupBy("__k").agg(F.sum("__first").alias("n"))
    base = base.select("__k", (F.sum("n").over(along.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("__base"))
    r = r.join(base, "__k").withColumn("session_no", F.col("__base") + F.sum("__first").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return r.drop("__t", "__k", "__before", "__pt", "__pp", "__first", "__base")


def _counted(rows: DataFrame, keys: list[str], column: str, name: str) -> DataFrame:
    per = rows.groupBy(*keys, F.coalesce(F.col(column).cast("string"), F.lit("?")).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy(*keys).agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", "k", F.col("n").cast("string")))), ",").alias(name))


def session_stats(rows: DataFrame, keys: list[str], at: str = "created_at", type_col: str = "memory_type", source_col: str = "source", strength_col: str = "strength") -> DataFrame:
    """Per session: start, end, rows, seconds, counts by type and by source (as sorted text), mean strength (1 if none)."""
    base = rows.groupBy(*keys).agg(F.min(at).alias("started_at"), F.max(at).alias("ended_at"), F.count(F.lit(1)).alias("memory_count"), F.coalesce(F.avg(strength_col), F.lit(1.0)).alias("avg_strength"))
    base = base.withColumn("duration_s", seconds_between(F.col("ended_at"), F.col("started_at")))
    return base.join(_counted(rows, keys, type_col, "type_counts"), keys).join(_counted(rows, keys, source_col, "source_counts"), keys)


def timeline(stats: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """A page of sessions, newest first."""
    return stats.orderBy(F.desc("started_at"), *stats.columns[:1]).offset(offset).limit(limit)
