"""Groups of records linked directly or through others, from pairwise matches.

Union-find runs inside bounded edge partitions and keeps only their spanning forests, as stars around one key. Forests
are merged level by level into fewer partitions. Where a forest is no smaller than the edges it came from (as many keys
as edges, more than one partition holds), the merging goes on by key: each key's edges meet in the partition of its hash;
a key that is no parent leaves the graph with a pointer to a parent, its parents being joined in its place, and only the
forest of what stays goes up. Levels shrink geometrically and every partition stays bounded; pointers are then followed
down again.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.skew import heavy_keys, lookup_join
from tidemark.session import materialize

#: Edges that one partition may hold in memory as a union-find.
EDGES_PER_PARTITION = 1_000_000

_STAR = "child string, parent string"


def roots(x: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """Union-find over the edges ``x[i] - y[i]`` of the keys 0 .. n-1, all edges at a time: the smallest key of each tree.

    In each round the greater root of every open edge is hung below the smaller one, and all paths are compressed.
    """
    up = np.arange(n)
    while len(x):
        a, b = up[x], up[y]
        np.minimum.at(up, np.maximum(a, b), np.minimum(a, b))
        while True:
            above = up[up]
            if np.array_equal(above, up):
                break
            up = above
        still = up[x] != up[y]
        x, y = x[still], y[still]
    return up


def _coded(x: pa.ChunkedArray, y: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Both ends as numbers in the order of their keys, and the keys."""
    both = pa.chunked_array([*x.chunks, *y.chunks], pa.string())
    codes, names = pd.factorize(both.to_pandas())
    names = pa.array(names, pa.string())
    order = pc.sort_indices(names).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    codes = rank[codes]
    return codes[: len(x)], codes[len(x) :], names.take(pa.array(order))


def _table(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    held = list(batches)
    return pa.Table.from_batches(held) if held else None


def _star(child: pa.Array, parent: pa.Array) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(child), 50_000):
        yield pa.record_batch([child.slice(at, 50_000), parent.slice(at, 50_000)], names=["child", "parent"])


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spanning forest of the edges of one partition: every key but the smallest of its tree, with that smallest key."""
    held = _table(batches)
    if held is None:
        return
    x, y, names = _coded(held.column(0), held.column(1))
    up = roots(x, y, len(names))
    below = np.flatnonzero(up != np.arange(len(names)))
    yield from _star(names.take(pa.array(below)), names.take(pa.array(up[below])))


def _turn(names: pa.Array) -> np.ndarray:
    """A mixed order of keys, the same everywhere: no way of naming keys makes long descents."""
    return np.array([xxhash.xxh64_intdigest(k) for k in names.to_pylist()], np.uint64)


def _peel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One level within the keys of one partition. In: ``child, parent`` at the child's home, and ``key, null`` for every
    key that is a parent somewhere. Out: pointers of leaving keys (``leaves``), and the forest of what stays."""
    held = _table(batches)
    if held is None:
        return
    stays = held.filter(pc.is_null(held.column(1))).column(0)
    held = held.filter(pc.is_valid(held.column(1)))
    if not held.num_rows:
        return
    x, y, names = _coded(held.column(0), held.column(1))
    kept = pc.is_in(names, value_set=stays.combine_chunks()).to_numpy(zero_copy_only=False)
    turn = _turn(names)
    rank = np.empty(len(names), np.int64)
    rank[np.argsort(turn, kind="stable")] = np.arange(len(names))
    # a leaving key joins its parents: the first of them takes the others
    first = np.full(len(names), -1)
    order = np.argsort(-rank[y], kind="stable")
    first[x[order]] = y[order]
    gone = np.unique(x[~kept[x]])
    a = np.where(kept[x], x, first[x])
    up = roots(rank[a], rank[y], len(names))
    back = np.argsort(rank)
    used = np.unique(np.concatenate([a, y]))
    top = back[up[rank[used]]]
    moved = used != top
    for child, parent, leaves in ((gone, first[gone], True), (used[moved], top[moved], False)):
        for b in _star(names.take(pa.array(child)), names.take(pa.array(parent))):
            yield pa.record_batch([*b.columns, pa.array([leaves] * b.num_rows, pa.bool_())], names=["child", "parent", "leaves"])


def _local(edges: DataFrame, partitions: int, *keys: str) -> DataFrame:
    placed = edges.coalesce(1) if partitions == 1 else edges.repartition(partitions, *keys)
    return placed.mapInArrow(_forest, _STAR)


def _turned(edges: DataFrame) -> DataFrame:
    """Edges with the end that comes first in the mixed order as parent; the order is that of :func:`_turn`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            swap = pa.array(_turn(batch.column(0)) < _turn(batch.column(1)))
            x, y = batch.column(0), batch.column(1)
            yield pa.record_batch([pc.if_else(swap, y, x), pc.if_else(swap, x, y)], names=["child", "parent"])

    return edges.mapInArrow(run, _STAR)


def _merged_by_key(forest: DataFrame, n: int, bound: int) -> DataFrame:
    """``member, root`` of every key of a forest that no single partition holds; roots are members of themselves."""
    edges, levels = materialize(_turned(forest), "turned"), []
    while n > bound:
        parents = edges.select(F.col("parent").alias("child"), F.lit(None).cast("string").alias("parent")).distinct()
        parts = max(2, math.ceil(2 * n / bound))
        level = materialize(edges.unionByName(parents).repartition(parts, "child").mapInArrow(_peel, _STAR + ", leaves boolean"), "level")
        levels.append(level.where("leaves").drop("leaves"))
        edges = level.where("NOT leaves").drop("leaves")
        n = edges.count()
    top = materialize(_local(edges, 1), "top")
    found = top.select(F.col("child").alias("member"), F.col("parent").alias("root")).distinct()
    for pointers in reversed(levels):
        heavy = heavy_keys(pointers.groupBy("parent").agg(F.count(F.lit(1)).alias("n")), "parent", "n")
        below = lookup_join(pointers, found.withColumnRenamed("member", "parent"), "parent", heavy)
        below = below.select(F.col("child").alias("member"), F.coalesce("root", "parent").alias("root"))
        found = materialize(found.unionByName(below), "found")
    ends = found.select(F.col("root").alias("member"), "root").distinct()
    return found.unionByName(ends)


def linked_groups(pairs: DataFrame, a: str, b: str, edges_per_partition: int = EDGES_PER_PARTITION) -> DataFrame:
    """``group_id, member_id``: one row per key that occurs in a pair of two different keys; group_id is the smallest key
    of all keys linked directly or through others, and has a row with itself.

    Pairs with a null end, and of a key with itself, are no links. Repeated and reversed pairs change nothing; no pairs
    give no rows; extra columns are ignored. ``edges_per_partition`` only bounds memory, the result is the same.
    """
    x, y = F.col(a).cast("string"), F.col(b).cast("string")
    edges = pairs.select(F.greatest(x, y).alias("child"), F.least(x, y).alias("parent")).where(x.isNotNull() & y.isNotNull() & (x != y))
    edges = materialize(edges, "pairs")
    n = edges.count()
    # edges of one hub are spread at first; in a forest every child has at most one edge per partition before it
    keys = ("child", "parent")
    while True:
        parts = max(1, math.ceil(n / edges_per_partition))
        forest = materialize(_local(edges, parts, *keys), "forest")
        if parts == 1:
            return forest.select(F.col("parent").alias("group_id"), F.col("child").alias("member_id")).unionByName(
                forest.select(F.col("parent").alias("group_id"), F.col("parent").alias("member_id")).distinct()
            )
        left = forest.count()
        if left > edges_per_partition and left > 0.7 * n:
            break
        edges, n, keys = forest, left, ("child",)
    found = materialize(_merged_by_key(forest, left, edges_per_partition), "members")
    groups = found.groupBy("root").agg(F.min("member").alias("group_id"), F.count(F.lit(1)).alias("n"))
    groups = materialize(groups, "groups")
    named = lookup_join(found, groups.drop("n"), "root", heavy_keys(groups, "root", "n"))
    return named.select("group_id", F.col("member").alias("member_id"))
