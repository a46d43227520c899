"""Near-duplicate texts within blocks by T-occurrence search.

A text is its set of word sequences (shingles). Two texts of similarity t or more share at least T of them. As in
DivideSkip, each text's shingles are divided: the longest inverted lists, those of its L most frequent shingles, are
skipped. The short ones are partitioned by shingle, hot ones split, and within each task all lists of a text
are merged and occurrences counted. What occurs fewer than T - L times in the short lists is out; for the rest sorted
lists of the candidates are built and probed by binary search, which gives the exact similarity.
Equal texts are one class throughout, so that copies meet once.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.skew import heavy_keys, lookup_join
from tidemark.session import materialize

WORD = regex.compile(r"[\p{L}\p{N}]+")
#: What orders shingles by rarity: counters of a sketch (two to this power), that all shingles of all texts are counted into.
SKETCH_BITS = 21
#: Distinct words a worker remembers, texts (fewer than 2**15) whose shingles are computed together, and pairs that are counted together.
CACHE, TOGETHER, COUNTED = 500_000, 1000, 4_000_000
#: Texts of an inverted list that one task holds; longer lists are split. Entries of all lists of one task, about.
LIST_PART, ENTRIES = 16_384, 2_000_000
#: Bytes of a list's entry: shingle, text, size and role, part of the list.
ENTRY_BYTES = 24

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)


_SPACED = str.maketrans({chr(i): " " for i in range(128) if not chr(i).isalnum()})


def words_of(text: str) -> list[str]:
    """Maximal runs of letters and digits of the lower-cased text."""
    low = text.lower()
    return low.translate(_SPACED).split() if low.isascii() else WORD.findall(low)


class Shingler:
    """Shingles of texts as 64-bit numbers, whole batches at a time."""

    def __init__(self, width: int):
        self.width = width
        self.code: dict[str, int] = {}
        self.number = np.zeros(1024, np.uint64)

    def _codes(self, words: list[str]) -> np.ndarray:
        known = self.code
        new = set(words) - known.keys()
        if new:
            if len(known) + len(new) > CACHE:
                known.clear()
                new = set(words)
            at = len(known)
            while len(self.number) < at + len(new):
                self.number = np.concatenate([self.number, np.zeros_like(self.number)])
            for w in new:
                known[w] = at
                self.number[at] = xxhash.xxh64_intdigest(w)
                at += 1
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))

    def batch(self, blocks: list[str], texts: list[str], least_words: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """``owner, key`` of the distinct shingles of all texts, in the order of owner and key; no shingles for
        fewer words than the width or than ``least_words``.

        A shingle's number also depends on the block, so that only texts of the same block have any in common.
        """
        words: list[str] = []
        sizes = np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            found = words_of(t)
            if len(found) >= max(self.width, least_words):
                words += found
                sizes[i] = len(found)
        if not words:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        code = self._codes(words)
        number = self.number[code]
        n = len(words) - self.width + 1
        owner = np.repeat(np.arange(len(texts)), sizes)
        mixed = np.array([xxhash.xxh64_intdigest(b) if k else 0 for b, k in zip(blocks, sizes, strict=True)], np.uint64)[owner[:n]]
        for k in range(self.width):
            mixed = (mixed ^ number[k : k + n]) * _ODD[k % len(_ODD)]
            mixed ^= mixed >> np.uint64(29)
        whole = owner[:n] == owner[self.width - 1 :]
        owner, key = owner[:n][whole], mixed.view(np.int64)[whole]
        order = np.argsort(key)
        order = order[np.argsort(owner[order].astype(np.int16), kind="stable")]  # small numbers are sorted by counting
        owner, key = owner[order], key[order]
        first = np.ones(len(key), bool)
        first[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
        return owner[first], key[first]


def _hashed(df: DataFrame, *columns: str) -> list:
    return [F.xxhash64(*columns).alias("k1"), F.xxhash64(F.lit(1), *columns).alias("k2")]


def text_classes(rows: DataFrame, id_col: str, text_col: str, block_col: str, order_col: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Distinct texts of each block (``no, block, text, several``), and the class of every id (``id, no``). ``several``
    is false where no other row has the text.

    Null ids, blocks and texts have no class. A repeated id counts once: the copy greatest by ``order_col``, then text.
    """
    given = rows.select(
        F.col(id_col).cast("string").alias("id"), F.col(block_col).cast("string").alias("block"), F.col(text_col).cast("string").alias("text"),
        (F.col(order_col) if order_col else F.lit(0)).alias("at"),
    ).where(F.col("id").isNotNull() & F.col("block").isNotNull() & F.col("text").isNotNull())
    texts = given.groupBy("block", "text").agg((F.count(F.lit(1)) > 1).alias("several")).select(F.monotonically_increasing_id().alias("no"), "block", "text", "several")
    texts = materialize(texts, "texts")
    keyed = given.select("id", "at", *_hashed(given, "block", "text"))
    members = keyed.groupBy("id").agg(F.max(F.struct("at", "k1", "k2")).alias("m")).select("id", "m.k1", "m.k2")
    return texts, materialize(members.join(texts.select("no", *_hashed(texts, "block", "text")), ["k1", "k2"]).select("id", "no"), "members")


def _sum_counters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        for packed in batch.column(0).to_pylist():
            part = np.frombuffer(zlib.decompress(packed), np.uint64)
            total = part if total is None else total + part
    if total is not None:
        yield pa.record_batch([pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())], names=["counters"])


def _sketch(texts: DataFrame, width: int, least_words: int, bits: int) -> tuple[np.ndarray, int]:
    """How common shingles are, by the leading bits of their numbers: logarithms of counts over all texts, as bytes; and
    the sum of the counts.

    Each task sums up its counters, tasks are summed up in levels, and the driver gets one array of fixed size.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, total = Shingler(width), np.zeros(1 << bits, np.uint64)
        held: list[np.ndarray] = []

        def count_held() -> None:
            if held:
                total[:] += np.bincount(np.concatenate(held), minlength=1 << bits).astype(np.uint64)
                held.clear()

        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(at, TOGETHER)
                held.append(_counter(shingler.batch(part.column(0).to_pylist(), part.column(1).to_pylist(), least_words)[1], bits))
                if sum(map(len, held)) > COUNTED:
                    count_held()
        count_held()
        yield pa.record_batch([pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())], names=["counters"])

    parts = texts.rdd.getNumPartitions()
    sums = texts.select("block", "text").mapInArrow(count, "counters binary")
    while parts > 1:
        parts = -(-parts // 32)
        sums = sums.repartition(parts).mapInArrow(_sum_counters, "counters binary")
    total = np.zeros(1 << bits, np.uint64)
    for r in sums.collect():
        total += np.frombuffer(zlib.decompress(r["counters"]), np.uint64)
    return np.round(2 * np.log2(total + 1.0)).astype(np.uint8), int(total.sum())


def _counter(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys.view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)


def similar_texts(texts: DataFrame, width: int, threshold: float, least_words: int = 0, sketch_bits: int = SKETCH_BITS, list_part: int = LIST_PART) -> DataFrame:
    """``a_no, b_no, similarity`` of the pairs of different texts of one block whose shingle sets have a Jaccard
    similarity of at least ``threshold``. ``texts``: ``no, block, text`` from :func:`text_classes`.

    Texts of fewer than ``least_words`` words, or with no shingle, are in no pair. No pair is lost: the order of shingles
    by rarity only decides how many candidates there are. Shingles meet by 64-bit numbers, of which two different ones
    can be equal with a chance of one in 2**64; the final similarity counts the same numbers.
    """
    spark = texts.sparkSession
    # a text of n words has at least 2n - 1 characters: cheap to see before anything is read in detail
    long = texts.where(F.length(F.lower("text")) >= 2 * max(least_words, width) - 1)
    rarity, n_shingles = _sketch(long, width, least_words, sketch_bits)
    sketch = spark.sparkContext.broadcast(rarity)
    # a task holds its lists in memory: as many tasks as the number of entries asks for, if the session has set fewer
    parts_of_lists = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(n_shingles * (1 - threshold) / ENTRIES))

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(width)
        for whole in batches:
            for at in range(0, whole.num_rows, TOGETHER):
                batch = whole.slice(at, TOGETHER)
                owner, keys = shingler.batch(batch.column(1).to_pylist(), batch.column(2).to_pylist(), least_words)
                if not len(keys):
                    continue
                n = np.bincount(owner, minlength=batch.num_rows)
                # of two similar texts the larger has at least ceil(t n) in common with the other, the smaller at least
                # ceil(2 t n / (1 + t)): so many shingles are left out by each, the rarest remain
                probe = n - np.ceil(threshold * n - 1e-9).astype(np.int64) + 1
                index = n - np.ceil(2 * threshold / (1 + threshold) * n - 1e-9).astype(np.int64) + 1
                held = sketch.value[_counter(keys, sketch_bits)]
                order = np.argsort(held, kind="stable")
                order = order[np.argsort(owner[order].astype(np.int16), kind="stable")]
                owner, keys, held = owner[order], keys[order], held[order]
                place = np.arange(len(keys)) - np.concatenate([[0], np.cumsum(n)])[owner]
                short = place < probe[owner]
                owner, keys, indexed, parts = owner[short], keys[short], (place < index[owner])[short], np.ceil(np.exp2(held[short] / 2.0) / list_part).astype(np.int64)
                no = batch.column(0).to_numpy(zero_copy_only=False)[owner]
                # a long list is split: its texts go to one part each, whoever searches it to all
                own = keys.view(np.uint64) ^ (no.astype(np.uint64) * _ODD[0])
                piece = np.where(parts > 1, (own % parts.astype(np.uint64)).astype(np.int64), 0)
                more = np.repeat(np.arange(len(keys)), parts - 1)
                other = np.arange(len(more)) - np.repeat(np.cumsum(parts - 1) - (parts - 1), parts - 1)
                other += other >= piece[more]
                rows = np.concatenate([np.arange(len(keys)), more])
                listed = np.concatenate([indexed, np.zeros(len(more), bool)])
                # entries of one task travel together, as arrays: rows of their own would cost more than the work
                at_piece = np.concatenate([piece, other])
                where = ((keys[rows].view(np.uint64) ^ (at_piece.astype(np.uint64) * _ODD[1])) % np.uint64(parts_of_lists)).astype(np.int64)
                order = np.argsort(where, kind="stable")
                rows, ends = rows[order], np.concatenate([[0], np.cumsum(np.bincount(where, minlength=parts_of_lists))])
                columns = (keys[rows], no[rows], (n[owner[rows]] * 2 + listed[order]).astype(np.int32), at_piece[order].astype(np.int32))
                there = np.flatnonzero(np.diff(ends))
                packed = [b"".join(c[ends[k] : ends[k + 1]].tobytes() for c in columns) for k in there]
                yield pa.record_batch([pa.array(there.astype(np.int32)), pa.array(packed, pa.binary())], names=["part", "entries"])

    entries = long.select("no", "block", "text").mapInArrow(lists, "part int, entries binary")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = [x for b in batches for x in b.column(1).to_pylist()]
        if packed:
            sizes = [len(x) // ENTRY_BYTES for x in packed]
            column = lambda kind, at: np.concatenate([np.frombuffer(x, kind, n, at * n) for x, n in zip(packed, sizes, strict=True)])
            yield from merged_lists(column(np.int64, 0), column(np.int32, 20), column(np.int64, 8), column(np.int32, 16), threshold)

    meet = entries.repartitionById(parts_of_lists, F.col("part")).mapInArrow(merge, "a_no long, b_no long, a_n int, b_n int, met int")
    counted = meet.groupBy("a_no", "b_no", "a_n", "b_n").agg(F.sum("met").cast("int").alias("met"))
    # T - L: the text whose short lists end earlier in the order meets there all that both have, but for what it skipped
    need = F.ceil(F.lit(threshold / (1 + threshold)) * (F.col("a_n") + F.col("b_n")) - 1e-9)
    skipped = F.greatest(F.ceil(F.lit(2 * threshold / (1 + threshold)) * F.col("a_n") - 1e-9), F.ceil(F.lit(threshold) * F.col("b_n") - 1e-9)) - 1
    able = counted.where(F.col("met") >= need - skipped).select("a_no", "b_no")
    able = materialize(able, "candidates")
    text = long.select(F.col("no"), F.col("block"), F.col("text"))
    sides = able.join(text.select(F.col("no").alias("a_no"), "block", F.col("text").alias("a_text")), "a_no")
    # both joins take the same columns of the texts, so that these are shuffled once
    sides = sides.join(text.select(F.col("no").alias("b_no"), F.col("block").alias("b_block"), F.col("text").alias("b_text")), "b_no")

    def probe_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(width)
        for whole in batches:
            for at in range(0, whole.num_rows, TOGETHER):
                batch = whole.slice(at, TOGETHER)
                a, b = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
                similarity = probed(shingler, a, b, *(batch.column(k).to_pylist() for k in (2, 3, 4)))
                keep = np.flatnonzero(similarity >= threshold)
                yield pa.record_batch([pa.array(a[keep]), pa.array(b[keep]), pa.array(similarity[keep])], names=["a_no", "b_no", "similarity"])

    return sides.where("block = b_block").select("a_no", "b_no", "block", "a_text", "b_text").mapInArrow(probe_all, "a_no long, b_no long, similarity double")


def merged_lists(h: np.ndarray, piece: np.ndarray, no: np.ndarray, nr: np.ndarray, threshold: float) -> Iterator[pa.RecordBatch]:
    """``a_no, b_no, a_n, b_n, met``: how many of one task's inverted lists have both texts, the smaller one first.

    Lists are sorted by size, so that of each only the texts of a possible size are merged. All lists of a text are
    merged at once: their concatenation is sorted, which merges runs, and equal ones are counted.
    """
    n = nr >> 1
    # texts in the order of size, then number
    first = np.unique(no, return_index=True)[1]
    order = first[np.lexsort((no[first], n[first]))]
    numbers, sizes = no[order], n[order]
    by_no = np.argsort(numbers)
    rank = by_no[np.searchsorted(numbers, no, sorter=by_no)]
    many = len(numbers)
    pair = np.lexsort((piece, h)) if piece.any() else np.argsort(h)
    new = np.ones(len(h), bool)
    new[1:] = (h[pair][1:] != h[pair][:-1]) | (piece[pair][1:] != piece[pair][:-1])
    group = np.empty(len(h), np.int64)
    group[pair] = np.cumsum(new) - 1
    listed = np.sort((group * many + rank)[(nr & 1) == 1])
    query = np.argsort(rank, kind="stable")
    group, rank = group[query], rank[query]
    low = np.searchsorted(listed, group * many + np.searchsorted(sizes, np.ceil(threshold * sizes - 1e-9))[rank])
    count = np.maximum(np.searchsorted(listed, group * many + rank) - low, 0)
    some = count > 0
    low, count, rank = low[some], count[some], rank[some]
    ends = np.flatnonzero(np.diff(rank, append=-1))  # last list of each text
    total = np.cumsum(count)
    at = 0
    while at < len(rank):
        # as many whole texts as are counted together, one at least
        done = ends[np.searchsorted(ends, at) :]
        to = done[max(np.searchsorted(total[done], (total[at - 1] if at else 0) + COUNTED, side="right") - 1, 0)] + 1
        c = count[at:to]
        start = np.repeat(low[at:to] - (np.cumsum(c) - c), c)
        a = listed[start + np.arange(len(start))] % many
        both, met = np.unique(np.repeat(rank[at:to], c) * many + a, return_counts=True)
        x, y = both % many, both // many
        for k in range(0, len(x), 100_000):
            i, j = x[k : k + 100_000], y[k : k + 100_000]
            yield pa.record_batch([pa.array(numbers[i]), pa.array(numbers[j]), pa.array(sizes[i].astype(np.int32)), pa.array(sizes[j].astype(np.int32)), pa.array(met[k : k + 100_000].astype(np.int32))], names=["a_no", "b_no", "a_n", "b_n", "met"])
        at = to


def probed(shingler: Shingler, a: np.ndarray, b: np.ndarray, blocks: list[str], a_texts: list[str], b_texts: list[str]) -> np.ndarray:
    """Similarity of candidate pairs: the inverted lists of the candidates ``a`` are built, sorted, and every shingle of
    ``b`` is looked for in its list by binary search."""
    once_a, first_a, of_a = np.unique(a, return_index=True, return_inverse=True)
    once_b, first_b, of_b = np.unique(b, return_index=True, return_inverse=True)
    owner_a, key_a = shingler.batch([blocks[i] for i in first_a], [a_texts[i] for i in first_a])
    owner_b, key_b = shingler.batch([blocks[i] for i in first_b], [b_texts[i] for i in first_b])
    n_a, n_b = np.bincount(owner_a, minlength=len(once_a)), np.bincount(owner_b, minlength=len(once_b))
    keys, code = np.unique(key_a, return_inverse=True)
    lists = np.sort(code * len(once_a) + owner_a)
    found = np.searchsorted(keys, key_b)
    there = keys[np.minimum(found, len(keys) - 1)] == key_b if len(keys) else np.zeros(len(key_b), bool)
    start = np.concatenate([[0], np.cumsum(n_b)])
    c = n_b[of_b]
    at = np.repeat(start[of_b] - (np.cumsum(c) - c), c) + np.arange(c.sum())
    pair = np.repeat(np.arange(len(a)), c)[there[at]]
    at = at[there[at]]
    wanted = found[at] * len(once_a) + of_a[pair]
    hit = lists[np.minimum(np.searchsorted(lists, wanted), len(lists) - 1)] == wanted if len(lists) else np.zeros(0, bool)
    common = np.bincount(pair[hit], minlength=len(a))
    return common / np.maximum(n_a[of_a] + n_b[of_b] - common, 1)


#: Members of a class that meet in one task when classes are expanded into pairs of ids.
EXPANDED = 2000


def text_links(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """``id, no, n_copies, n_links``: one row per id with its class of equal texts, the other ids of it, and the other
    classes it is similar to. Nothing is expanded."""
    sizes = members.groupBy("no").agg((F.count(F.lit(1)) - 1).alias("n_copies"))
    ends = pairs.select(F.col("a_no").alias("no")).unionByName(pairs.select(F.col("b_no").alias("no")))
    links = ends.groupBy("no").agg(F.count(F.lit(1)).alias("n_links"))
    each = sizes.join(links, "no", "left").select("no", "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return lookup_join(members, each, "no", heavy_keys(sizes, "no", "n_copies")).select("id", "no", "n_copies", "n_links")


def member_pairs(pairs: DataFrame, members: DataFrame, texts: DataFrame, least_words: int = 0) -> DataFrame:
    """``a_id, b_id`` (a_id < b_id) of all ids whose texts are the same or a pair of :func:`similar_texts`.

    This is as many rows as there are pairs of ids. Large classes are salted: each part of a class's members meets the
    class once more in a task of its own.
    """
    numbered = members.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(1 << 20)))
    sizes = members.groupBy("no").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # written, so that the planner knows how few classes have several members
    parts = materialize(sizes.select("no", "n", F.ceil(F.col("n") / EXPANDED).cast("int").alias("parts")), "large-classes")

    # words are counted only of texts that have copies
    copied = texts.where("several").where(F.size(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}]+)"), 1)) >= max(least_words, 1)).select("no")
    shared = parts.join(copied, "no", "left_semi")
    own = numbered.join(shared, "no").select("no", "id", F.pmod("part", "parts").alias("part"), "parts")
    again = own.select("no", F.col("id").alias("y"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts").cast("bigint") - 1)).alias("part"))
    same = own.select("no", F.col("id").alias("x"), F.col("part").cast("bigint").alias("part")).join(again, ["no", "part"]).where("x < y").select("x", "y")
    # between two classes the members of the first are salted, as many times as it is large
    linked = pairs.select("a_no", "b_no")
    split = linked.join(parts.select(F.col("no").alias("a_no"), "parts"), "a_no", "left").select("a_no", "b_no", F.coalesce("parts", F.lit(1)).alias("parts"))
    split = split.select("a_no", "b_no", "parts", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    x = numbered.join(parts.select("no", "parts"), "no", "left").select(F.col("no").alias("a_no"), F.col("id").alias("x"), F.pmod("part", F.coalesce("parts", F.lit(1))).cast("int").alias("part"))
    y = members.select(F.col("no").alias("b_no"), F.col("id").alias("y"))
    several = split.join(x, ["a_no", "part"]).join(y, "b_no").select("x", "y")
    both = several.unionByName(same)
    return both.select(F.least("x", "y").alias("a_id"), F.greatest("x", "y").alias("b_id")).where("a_id <> b_id")
