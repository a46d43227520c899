"""Joins that stay balanced when one key holds a large part of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is heavy when it holds at least one part in so many of all references: there are at most that many heavy keys.
HEAVY_SHARE = 1000


def heavy_keys(counts: DataFrame, key: str, n: str, share: int = HEAVY_SHARE) -> DataFrame:
    """Keys holding at least ``1/share`` of the sum of ``n``: by construction no more than ``share`` rows.

    ``counts`` has one row per key. The total comes back as one number; nothing that grows with the data does.
    """
    total = counts.agg(F.sum(n).alias("t")).first()["t"] or 0
    return counts.where(F.col(n) * F.lit(share) >= F.lit(max(int(total), 1))).select(key)


def lookup_join(rows: DataFrame, lookup: DataFrame, key: str, heavy: DataFrame, only_met: bool = False) -> DataFrame:
    """Left join of ``rows`` with ``lookup`` (one row per key) on ``key``; with ``only_met`` an inner join.

    ``heavy`` (a bounded list of keys, see :func:`heavy_keys`) is broadcast twice: its rows meet their lookup records
    where they lie, and only the rows of other keys are shuffled - not even those where the planner knows ``lookup`` to
    be small. Null keys keep null lookup columns.
    """
    how = "inner" if only_met else "left"
    marked = rows.join(F.broadcast(heavy.withColumn("__heavy", F.lit(True))), key, "left")
    few = lookup.join(F.broadcast(heavy), key, "left_semi")
    hot = marked.where(F.col("__heavy")).drop("__heavy").join(F.broadcast(few), key, how)
    cold = marked.where(F.col("__heavy").isNull()).drop("__heavy").join(lookup if only_met else lookup.hint("merge"), key, how)
    return hot.unionByName(cold)
