"""Parquet tables of a data folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """Table ``name`` of ``folder``; with ``columns``, just those (the scan then reads nothing else)."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df


def latest_copy(df: DataFrame, key: str, *order: str) -> DataFrame:
    """One row per ``key``: the copy with the greatest ``order`` columns, ties broken by all other columns.

    A record sent twice counts once. Rows whose key is null cannot be told to be copies and are all kept. The rows are
    compared as one struct, so the result does not depend on their order; no window, hence no sort of hot keys.
    """
    rest = [c for c in df.columns if c != key and c not in order]
    packed = F.struct(*order, *rest)
    known = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(packed).alias("__row"))
    known = known.select(*[F.col(key) if c == key else F.col(f"__row.`{c}`").alias(c) for c in df.columns])
    return known.unionByName(df.where(F.col(key).isNull()))


def with_prefix(df: DataFrame, prefix: str) -> DataFrame:
    """All columns renamed with ``prefix``, for joins between tables with clashing names."""
    return df.select(*[F.col(f"`{c}`").alias(prefix + c) for c in df.columns])


def or_else(c: Column, value: object) -> Column:
    return F.coalesce(c, F.lit(value))
