"""Exact nearest neighbours and similarity pairs by blocks of matrix products.

A query set within the bound of one block is broadcast, and every row stays where it is. Beyond it, queries are cut into
blocks by hash, and the blocks are broadcast one after another, so no vector is shuffled and disk holds one copy of them. All
rows against all rows is quadratic by its nature: what is exact here is for query sets and moderate collections.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import materialize

#: Vector values that one block may hold (32 MB as floats).
BLOCK_VALUES = 8_000_000

_SCORES = ["query_id", "id", "score"]


def usable(c: Column, size: int) -> Column:
    """True for vectors of exactly ``size`` values, all finite, not all zero."""
    bad = F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.coalesce(c.isNotNull() & (F.size(c) == size) & ~bad & F.exists(c, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array | pa.ChunkedArray, size: int) -> np.ndarray:
    """Rows of the type they come in: single floats are widened where they are compared."""
    flat = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(-1, size)


def _unit(v: np.ndarray) -> np.ndarray:
    """Directions as single floats."""
    n = np.sqrt(np.einsum("ij,ij->i", v, v, dtype=np.float64, casting="same_kind"))[:, None]
    return np.divide(v, n, out=np.zeros(v.shape, np.float32), where=n > 0, casting="same_kind")


def _cosines(v: np.ndarray, q: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of the pairs (a, b) in whole precision, a bounded number at a time."""
    found = np.empty(len(a))
    for at in range(0, len(a), 10_000):
        x, y = v[a[at : at + 10_000]].astype(np.float64), q[b[at : at + 10_000]].astype(np.float64)
        n = np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1)
        prod = np.einsum("ij,ij->i", x, y)
        found[at : at + 10_000] = np.divide(prod, n, out=np.zeros_like(prod), where=n > 0)
    return found


def _score(v: np.ndarray, q: np.ndarray, metric: str) -> np.ndarray:
    prod = v @ q.T
    if metric == "dot":
        return prod
    if metric == "l2":
        return -np.sqrt(np.maximum(0, (v**2).sum(1)[:, None] + (q**2).sum(1)[None, :] - 2 * prod))
    n = np.linalg.norm(v, axis=1)[:, None] * np.linalg.norm(q, axis=1)[None, :]
    return np.divide(prod, n, out=np.zeros_like(prod), where=n > 0)


#: Scores that a task holds at a time.
HELD = 1_000_000

#: From a chunk of scores to places in it (rows, queries) that may be kept.
Keep = Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


class _Best:
    """The ``k`` best rows per query of a block, kept while its rows pass in chunks; ties go to the smaller id."""

    def __init__(self, k: int, least: float, queries: int):
        self.k, self.edge, self.held = k, np.full(queries, least), 0
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, score: np.ndarray, at: int, order: np.ndarray, slack: float = 0.0, exact: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> None:
        """Scores of the rows from ``at`` on. Those that ``exact`` gives again for chosen pairs may be off by ``slack``."""
        if not self.found and len(score) >= self.k:
            some = np.where(np.isnan(score), -np.inf, score)
            self.edge = np.maximum(self.edge, np.partition(some, len(some) - self.k, axis=0)[len(some) - self.k] - slack)
        a, b = np.nonzero((score >= (self.edge - slack).astype(score.dtype)[None, :]) & np.isfinite(score))
        s = exact(at + a, b) if exact else score[a, b]
        if exact:
            keep = s >= self.edge[b]
            a, b, s = a[keep], b[keep], s[keep]
        self.found.append((at + a, b, s))
        self.held += len(a)
        if self.held > HELD:
            self.cut(order)

    def cut(self, order: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b, s = (np.concatenate(x) for x in zip(*self.found, strict=True))
        by = np.lexsort((order[a], -s, b))
        a, b, s = a[by], b[by], s[by]
        rank = np.arange(len(b)) - np.searchsorted(b, b)
        last = rank == self.k - 1
        self.edge[b[last]] = np.maximum(self.edge[b[last]], s[last])
        keep = rank < self.k
        self.found, self.held = [(a[keep], b[keep], s[keep])], 0
        return self.found[0]


def _kept(rid: list, v: np.ndarray, qids: list, q: np.ndarray, metric: str, keep: Keep | _Best, kind: pa.DataType, unit: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """What is kept of one block of rows and one of queries; only a bounded number of scores is held."""
    some = max(1, HELD // len(qids))
    quick = isinstance(keep, _Best) and metric == "cosine"
    if isinstance(keep, _Best):
        keep = _Best(keep.k, keep.edge[0], len(qids))
        place = {x: j for j, x in enumerate(qids)}
        order = np.empty(len(rid), np.int64)
        order[sorted(range(len(rid)), key=rid.__getitem__)] = np.arange(len(rid))
    if quick:  # single floats choose, whole precision decides; a sum of n products of parts of unit vectors is off by less
        some, slack = max(1, 4 * HELD // len(qids)), 2.0**-22 * (v.shape[1] + 8)
        vu, qu = _unit(v), _unit(q) if unit is None else unit
    else:
        v, q = v.astype(np.float64, copy=False), q.astype(np.float64, copy=False)
    for at in range(0, len(rid), some):
        score = vu[at : at + some] @ qu.T if quick else _score(v[at : at + some], q, metric)
        if isinstance(keep, _Best):
            for i, x in enumerate(rid[at : at + some]):
                if x in place:
                    score[i, place[x]] = -np.inf
            if quick:
                keep.add(score, at, order, slack, lambda a, b: _cosines(v, q, a, b))
            else:
                keep.add(score, at, order)
        else:
            a, b = keep(score, rid[at : at + some], qids)
            yield pa.record_batch([pa.array([qids[j] for j in b], kind), pa.array([rid[at + i] for i in a], kind), pa.array(score[a, b])], names=_SCORES)
    if isinstance(keep, _Best) and keep.found:
        a, b, s = keep.cut(order)
        for at in range(0, len(a), 100_000):
            part = slice(at, at + 100_000)
            yield pa.record_batch([pa.array([qids[j] for j in b[part]], kind), pa.array([rid[i] for i in a[part]], kind), pa.array(s[part])], names=_SCORES)


def _scores(rows: DataFrame, queries: DataFrame, size: int, metric: str, keep: Keep | _Best, block_values: int) -> DataFrame:
    """``query_id, id, score`` of the pairs that ``keep(scores, row ids, query ids)`` selects in each block."""
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"query_id {kind}, id {kind}, score double"
    if same := rows is queries:  # what both come from is computed once
        rows = queries = materialize(rows.select("id", "v"), "vectors")
    parts = max(1, -(-queries.count() * size // block_values))
    if parts == 1:
        return _against(rows, queries, size, metric, keep, schema)[0]
    if not same:
        rows, queries = materialize(rows.select("id", "v"), "vectors"), materialize(queries.select("id", "v"), "query-vectors")
    found = []
    for n in range(parts):
        scores, shared = _against(rows, queries.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == n), size, metric, keep, schema)
        found.append(materialize(scores, "scores"))
        shared.destroy()
    return reduce(DataFrame.unionByName, found)


def _against(rows: DataFrame, queries: DataFrame, size: int, metric: str, keep: Keep | _Best, schema: str) -> tuple[DataFrame, Broadcast]:
    """Every row with a query set of one block, and the broadcast that the result reads."""
    got = queries.toArrow()  # within the bound of one block
    shared = rows.sparkSession.sparkContext.broadcast((got.column("id").to_pylist(), _matrix(got.column("v"), size)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, q = shared.value
        unit = _unit(q) if metric == "cosine" else None
        for batch in batches:
            if batch.num_rows and qids:
                yield from _kept(batch.column(0).to_pylist(), _matrix(batch.column(1), size), qids, q, metric, keep, batch.column(0).type, unit)

    return rows.select("id", "v").mapInArrow(run, schema), shared


def _prepared(rows: DataFrame, id_col: str, vector_col: str, size: int) -> DataFrame:
    # single floats stay as they are until they are compared: half of what is sent
    given = rows.schema[vector_col].dataType.simpleString()
    v = F.col(vector_col) if given == "array<float>" else F.col(vector_col).cast("array<double>")
    whole = (F.size("v") == size) & ~F.exists("v", lambda x: x.isNull())
    return rows.select(F.col(id_col).alias("id"), v.alias("v")).where(whole & F.col("id").isNotNull())


def nearest(rows: DataFrame, queries: DataFrame, id_col: str, vector_col: str, size: int, k: int, metric: str = "cosine", block_values: int = BLOCK_VALUES, least: float = -np.inf) -> DataFrame:
    """``query_id, id, score, rank``: the ``k`` rows of greatest score, and of at least ``least``, per query, itself excluded,
    ties to the smaller id.

    ``metric``: cosine, dot, or l2 (score is then the negative distance). Vectors of another length or with a null are
    left out.
    """
    r = _prepared(rows, id_col, vector_col, size)
    q = r if queries is rows else _prepared(queries, id_col, vector_col, size)

    found = _scores(r, q, size, metric, _Best(k, least, 1), block_values)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def similar_pairs(rows: DataFrame, id_col: str, vector_col: str, size: int, threshold: float, block_values: int = BLOCK_VALUES) -> DataFrame:
    """``a, b, score`` (a < b) of all pairs of cosine at least ``threshold``."""
    r = _prepared(rows, id_col, vector_col, size)

    def over(score: np.ndarray, rid: list, qids: list) -> tuple[np.ndarray, np.ndarray]:
        a, b = np.nonzero(score >= threshold)
        keep = np.array([rid[i] < qids[j] for i, j in zip(a, b, strict=True)], bool)
        return a[keep], b[keep]

    found = _scores(r, r, size, "cosine", over, block_values)
    return found.select(F.col("id").alias("a"), F.col("query_id").alias("b"), "score")
