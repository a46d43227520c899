"""Most similar vectors for every vector, from cells around pivots that grow in number with the rows.

Every row enters the cells of its nearest pivots. The cells are range-partitioned; a row meets all rows of its cells,
compared on their whole vectors. What the cells found is merged and ranked again. A cell is as full at any size of the
table, so what is missed does not grow with it. Cells of far too many rows are ordered along a Hilbert curve of their own
directions, and rows meet those near them in that order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import materialize

#: Cells that a row enters, rows that a cell holds, about, and rows beyond which a cell is looked through in windows.
PROBES, CELL_ROWS, FULL_ROWS = 5, 6000, 36_000
#: The sample that pivots are taken from and balanced on: at least so many rows, and so many for each pivot.
SAMPLE, PER_PIVOT = 8192, 4
#: Turns in which cells are made alike in size, and the step of each.
TURNS, STEP = 12, 0.01
#: Directions that a full cell is ordered by, bits of each, and principal directions they are turned in.
CURVE_DIMS, CURVE_BITS, POOL = 8, 12, 32
#: Vector values that a partition holds, about; of rows of 384 values these are 20 000.
PARTITION_VALUES = 8_000_000


def usable(c: Column, size: int) -> Column:
    """True for vectors of exactly ``size`` values, all finite, not all zero."""
    bad = F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.coalesce(c.isNotNull() & (F.size(c) == size) & ~bad & F.exists(c, lambda x: x != 0), F.lit(False))


def hilbert_keys(points: np.ndarray, bits: int) -> np.ndarray:
    """Byte keys (rows of uint8) in Hilbert order of non-negative integer points below 2**bits.

    The Gray-code walk is undone level by level over all points at once; keys compare as big-endian numbers.
    """
    x = points.astype(np.uint32).copy()
    n, dims = x.shape
    level = np.uint32(1 << (bits - 1))
    while level > 1:
        below = np.uint32(level - 1)
        for i in range(dims):
            high = (x[:, i] & level) != 0
            swap = np.where(high, np.uint32(0), (x[:, 0] ^ x[:, i]) & below)
            x[:, 0] ^= np.where(high, below, np.uint32(0)) ^ swap
            if i:
                x[:, i] ^= swap
        level = np.uint32(level >> 1)
    for i in range(1, dims):
        x[:, i] ^= x[:, i - 1]
    flip = np.zeros(n, np.uint32)
    level = np.uint32(1 << (bits - 1))
    while level > 1:
        flip ^= np.where((x[:, dims - 1] & level) != 0, np.uint32(level - 1), np.uint32(0))
        level = np.uint32(level >> 1)
    x ^= flip[:, None]
    planes = [(x >> np.uint32(bits - 1 - b)) & 1 for b in range(bits)]
    return np.packbits(np.concatenate(planes, axis=1).astype(np.uint8), axis=1)


class Cells:
    """Pivots from a sample of the rows, each with a handicap that makes the cells about alike in size."""

    def __init__(self, sample: np.ndarray, cells: int, probes: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        cells = max(1, min(cells, len(sample)))
        self.probes = min(probes, cells)
        self.pivots = sample[rng.permutation(len(sample))[:cells]].astype(np.float32)
        self.handicap = np.zeros(cells, np.float32)
        if cells <= self.probes:
            return
        for turn in range(TURNS):
            load = np.bincount(self.nearest(sample).ravel(), minlength=cells)
            self.handicap += np.float32(STEP / (1 + turn / 4)) * np.log((load + 1) / (load.mean() + 1)).astype(np.float32)

    def nearest(self, unit: np.ndarray) -> np.ndarray:
        """The cells that each row enters."""
        if len(self.pivots) <= self.probes:
            return np.tile(np.arange(len(self.pivots), dtype=np.int32), (len(unit), 1))
        found = [np.zeros((0, self.probes), np.int32)]
        for at in range(0, len(unit), 512):
            score = unit[at : at + 512] @ self.pivots.T - self.handicap
            found.append(np.argpartition(score, -self.probes, axis=1)[:, -self.probes :].astype(np.int32))
        return np.concatenate(found)


def along_curve(vec: np.ndarray) -> np.ndarray:
    """The order of ``vec`` along a Hilbert curve of its principal directions."""
    rng = np.random.default_rng(len(vec))
    some = vec[rng.permutation(len(vec))[:SAMPLE]].astype(np.float64)
    mean = some.mean(axis=0)
    _, _, axes = np.linalg.svd(some - mean, full_matrices=False)
    axes = axes[:POOL]
    turn = axes.T @ np.linalg.qr(rng.normal(size=(len(axes), len(axes))))[0][:, :CURVE_DIMS]
    at = (vec - mean) @ turn
    low, high = np.quantile(at, 0.001), np.quantile(at, 0.999)
    z = np.clip((at - low) / max(high - low, 1e-9), 0, 1 - 1e-9) * (1 << CURVE_BITS)
    return np.lexsort(hilbert_keys(z, CURVE_BITS).T[::-1])


def borders(keys: list[bytes], parts: int, margin: int) -> list[tuple[bytes, bytes, bytes]]:
    """Keys that cut sorted ``keys`` into ``parts``: each with the keys ``margin`` places before and after it."""
    n = len(keys)
    at = sorted({n * i // parts for i in range(1, parts)} - {0})
    return [(keys[max(0, i - margin)] if i >= margin else b"", keys[i], keys[i + margin] if i + margin < n else b"\xff") for i in at]


def _unit(column: pa.Array, size: int) -> np.ndarray:
    flat = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten().to_numpy(zero_copy_only=False)
    rows = flat.reshape(-1, size).astype(np.float64)
    rows /= np.abs(rows).max(axis=1, keepdims=True)  # no overflow of squares
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _halves(column: pa.Array | pa.ChunkedArray, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float16).reshape(-1, size).astype(np.float32)


def _neighbours(no: np.ndarray, vec: np.ndarray, k: int, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best ``k`` of the rows up to ``reach`` before or after each row."""
    n, block = len(no), 256
    width = min(n, block + 2 * reach)
    # one place for all scores: fresh ones for each block would leave holes in memory
    scores, above = np.empty(block * width, np.float32), np.empty(block * width, bool)
    others, values = np.full((n, k), -1, np.int64), np.empty((n, k), np.float32)
    for at in range(0, n, block):
        low, high, end = max(0, at - reach), min(n, at + block + reach), min(n, at + block)
        shape, size = (end - at, high - low), (end - at) * (high - low)
        score = np.matmul(vec[at:end], vec[low:high].T, out=scores[:size].reshape(shape))
        score[np.arange(end - at), np.arange(at - low, end - low)] = -9
        # the k-th best of a part of the others is a bound that few of all are above
        part = score[:, : max(shape[1] // 8, 8 * k)]
        bound = np.partition(part, part.shape[1] - k, axis=1)[:, -k][:, None] if part.shape[1] > k else np.float32(-5)
        place = np.flatnonzero(np.greater_equal(score, np.maximum(bound, np.float32(-5)), out=above[:size].reshape(shape)))
        row, value = place // shape[1], score.ravel()[place]
        order = np.lexsort((-value, row))
        row = row[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        best = rank < k
        others[at + row[best], rank[best]] = low + place[order[best]] % shape[1]
        values[at + row[best], rank[best]] = value[order[best]]
    there = others >= 0
    return np.repeat(no, there.sum(axis=1)), no[others[there]], values[there]


def nearest(rows: DataFrame, id_col: str, vector_col: str, size: int, k: int = 5, probes: int = PROBES, cell_rows: int = CELL_ROWS, sample: int = SAMPLE) -> DataFrame:
    """``a_id, b_id, score``: for each id with a usable vector up to ``k`` other ids of greatest cosine.

    Ids are strings compared as they are; null ids and unusable vectors (null, other length, not finite, all zero) are
    left out. A repeated id counts once (one of its vectors, the same each time). Vectors of equal direction are one class: its members are neighbours of
    each other with score 1, the smaller id first, however many they are, and share their other neighbours. Ties go to
    the smaller id. Some loss is accepted: a neighbour that shares no cell is missed. Extra columns are ignored; no rows
    give no rows. ``sample`` bounds only the rows that pivots are chosen among; every row is indexed.
    """
    spark = rows.sparkSession
    ok = rows.select(F.col(id_col).cast("string").alias("id"), F.col(vector_col).cast("array<float>").alias("v")).where(F.col("id").isNotNull() & usable(F.col("v"), size))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit = _unit(batch.column(1), size)
            exact = [r.tobytes() for r in unit.astype(np.float32)]
            keys = [pa.array(np.array([xxhash.xxh64_intdigest(x, seed) for x in exact], np.uint64).view(np.int64)) for seed in (0, 1)]
            yield pa.record_batch([batch.column(0), *keys, pa.array([r.tobytes() for r in unit.astype(np.float16)], pa.binary())], names=["id", "k1", "k2", "h"])

    halves = ok.mapInArrow(pack, "id string, k1 long, k2 long, h binary")
    once = halves.groupBy("id").agg(F.max(F.struct("k1", "k2", "h")).alias("v")).select("id", "v.k1", "v.k2", "v.h")
    # a class per distinct direction in whole precision, told by 128 bits of hash: what only rounds alike stays apart
    classes = once.groupBy("k1", "k2").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"), F.max("h").alias("h"))
    classes = materialize(classes.select(F.monotonically_increasing_id().alias("no"), "k1", "k2", "h", "first", "n"), "vector-classes")
    n = classes.count()
    cells = -(-n * probes // cell_rows) if n > cell_rows else 1
    sample = max(sample, PER_PIVOT * cells)
    fraction = min(1.0, 1.5 * sample / max(n, 1))
    taken = classes.select("h").sample(withReplacement=False, fraction=fraction, seed=11).limit(sample).toArrow().column(0)
    seen = _halves(taken, size)
    fitted = Cells(seen, cells, probes)
    # borders of the partitions from the cells of the sample; a cell lies in one partition
    parts = max(1, -(-n * fitted.probes * size // PARTITION_VALUES))
    at_cells = [at for _, at, _ in borders(sorted(c.to_bytes(4, "big") for c in fitted.nearest(seen).ravel().tolist()), parts, 0)]
    del seen, taken
    cuts = np.array([int.from_bytes(c, "big") for c in at_cells], np.int32)
    shared = spark.sparkContext.broadcast((fitted, cuts))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted, cuts = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                some = batch.slice(at, 2048)
                cell = fitted.nearest(_halves(some.column(1), size))
                row = pa.array(np.repeat(np.arange(some.num_rows, dtype=np.int32), cell.shape[1]))
                part = np.searchsorted(cuts, cell.ravel(), side="right").astype(np.int32)
                yield pa.record_batch([pa.array(part), pa.array(cell.ravel()), some.column(0).take(row), some.column(1).take(row)], names=["part", "cell", "no", "h"])

    placed = classes.select("no", "h").mapInArrow(place, "part int, cell int, no long, h binary")
    ordered = placed.repartitionById(parts, F.col("part"))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, no, vec = [], [], []
        for batch in batches:
            cell.append(batch.column(1).to_numpy(zero_copy_only=False))
            no.append(batch.column(2).to_numpy(zero_copy_only=False))
            vec.append(np.frombuffer(b"".join(batch.column(3).to_pylist()), np.float16).reshape(-1, size))
        if not cell:
            return
        which, numbers, vectors = np.concatenate(cell), np.concatenate(no), np.concatenate(vec)
        del cell, no, vec
        for w in np.unique(which):
            here = np.flatnonzero(which == w)
            unit = vectors[here].astype(np.float32)
            # rounding to 16 bits changes lengths by as much as close vectors differ
            unit /= np.linalg.norm(unit, axis=1, keepdims=True)
            full = len(here) > FULL_ROWS
            order = along_curve(unit) if full else slice(None)
            a, b, s = _neighbours(numbers[here][order], unit[order], k, FULL_ROWS // 2 if full else len(here))
            for at in range(0, len(a), 100_000):
                yield pa.record_batch([pa.array(x[at : at + 100_000]) for x in (a, b, s)], names=["a", "b", "score"])

    near = ordered.mapInArrow(look, "a long, b long, score float")
    best = near.groupBy("a", "b").agg(F.max("score").alias("score"))
    rank = Window.partitionBy("a").orderBy(F.desc("score"), "b")
    best = best.withColumn("r", F.row_number().over(rank)).where(F.col("r") <= k).drop("r")
    plain = classes.select("no", "first", "n")
    if not classes.where("n > 1").limit(1).count():
        firsts = plain.select("no", "first")
        return best.join(firsts.select(F.col("no").alias("a"), F.col("first").alias("a_id")), "a").join(firsts.select(F.col("no").alias("b"), F.col("first").alias("b_id")), "b").select("a_id", "b_id", "score")
    return _expanded(best, classes, halves.groupBy("id").agg(F.max(F.struct("k1", "k2")).alias("v")).select("id", "v.k1", "v.k2"), k)


def _expanded(best: DataFrame, classes: DataFrame, once: DataFrame, k: int) -> DataFrame:
    """Neighbours of every id from those of its class: at most ``k + 1`` smallest members of any class can be somebody's
    neighbours, and they are found without a window over the class."""
    numbers = classes.select("no", "k1", "k2", "n")
    members = materialize(once.join(numbers, ["k1", "k2"]).select("no", "id", "n"), "vector-members")
    alone = members.where("n = 1").select("no", "id")
    # salted: a class may hold a third of all rows
    shared = members.where("n > 1").withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64)))
    few = shared.withColumn("r", F.row_number().over(Window.partitionBy("no", "salt").orderBy("id"))).where(F.col("r") <= k + 1)
    few = few.withColumn("r", F.row_number().over(Window.partitionBy("no").orderBy("id"))).where(F.col("r") <= k + 1).select("no", "id")
    given = alone.unionByName(few)
    own = few.select(F.col("no").alias("a"), F.col("id").alias("b_id"), F.lit(1.0).cast("float").alias("score"))
    other = best.join(given.select(F.col("no").alias("b"), F.col("id").alias("b_id")), "b").select("a", "b_id", "score")
    both = own.unionByName(other)
    order = Window.partitionBy("a").orderBy(F.desc("score"), "b_id")
    both = both.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1)
    lists = both.groupBy("a").agg(F.sort_array(F.collect_list(F.struct("r", "b_id", "score"))).alias("near"))  # k + 1 entries
    ids = members.select(F.col("no").alias("a"), F.col("id").alias("a_id"))
    each = ids.join(lists, "a").select("a_id", F.slice(F.filter("near", lambda x: x["b_id"] != F.col("a_id")), 1, k).alias("near"))
    return each.select("a_id", F.inline("near")).select("a_id", "b_id", "score")


def neighbour_pairs(near: DataFrame) -> DataFrame:
    """Each unordered pair once, ``a_id < b_id``."""
    return near.select(F.least("a_id", "b_id").alias("a_id"), F.greatest("a_id", "b_id").alias("b_id")).distinct()
