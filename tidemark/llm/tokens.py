"""Encoding of whole corpora with byte-level BPE vocabularies, by speculation and verification.

Words come from the vocabulary's public split pattern. For each distinct word, greedy longest match proposes tokens; a
vectorised check tests every adjacent pair for compatibility (byte-pair merging of the two tokens' bytes gives the same
two tokens back). Where all pairs pass, the proposal is the exact encoding; only failing words are merged exactly.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Folder of the vocabulary files.
TOKENIZERS = os.environ.get("TIDEMARK_TOKENIZERS", "/opt/tokenizers")
#: Fixed value: the published split pattern of the byte-level vocabularies.
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
#: Distinct words whose ids a worker keeps, and their length in characters: longer ones are encoded each time.
CACHE, CACHED_LENGTH = 400_000, 64


def read_ranks(path: str) -> list[bytes]:
    """Token bytes by rank of a .tiktoken file."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    ranks = {int(r): base64.b64decode(t) for t, r in pairs}
    return [ranks[i] for i in range(len(ranks))]


class BytePairs:
    """A byte-level BPE vocabulary whose ranks are the merge order."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.rank = {t: i for i, t in enumerate(tokens)}
        self.longest = max(map(len, tokens))
        self.words: dict[str, list[int]] = {}
        self.split = regex.compile(SPLIT)
        #: the two parts of every token's last merge; single bytes have themselves
        self.left = np.arange(len(tokens))
        self.right = np.arange(len(tokens))
        for i, t in enumerate(tokens):
            if len(t) > 1:
                parts = self.exact(t, i)
                if len(parts) == 2:
                    self.left[i], self.right[i] = parts
        two = np.flatnonzero(self.left != np.arange(len(tokens)))
        merges = self.left[two] * len(tokens) + self.right[two]
        order = np.argsort(merges)
        self.merge_keys, self.merge_ranks = merges[order], two[order]

    def exact(self, word: bytes, below: int | None = None) -> list[int]:
        """Byte-pair merging, lowest rank first, leftmost first; with ``below`` only merges of lower rank.

        Parts are linked, and possible merges wait in a heap: n log n for a word of n bytes, however long it is.
        """
        n, top = len(word), len(self.tokens) if below is None else below
        look, tokens = self.rank.get, self.tokens
        part = [self.rank[word[i : i + 1]] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        waiting = []
        for i in range(n - 1):
            r = look(word[i : i + 2], top)
            if r < top:
                waiting.append((r, i, part[i], part[i + 1]))
        heapify(waiting)
        while waiting:
            r, i, x, y = heappop(waiting)
            j = after[i]
            if part[i] != x or j >= n or part[j] != y:
                continue  # one of both parts has been merged since
            part[i], part[j] = r, -1
            k = after[i] = after[j]
            h = before[i]
            if k < n:
                before[k] = i
                t = look(tokens[r] + tokens[part[k]], top)
                if t < top:
                    heappush(waiting, (t, i, r, part[k]))
            if h >= 0:
                t = look(tokens[part[h]] + tokens[r], top)
                if t < top:
                    heappush(waiting, (t, h, part[h], r))
        return [p for p in part if p >= 0]

    def proposed(self, word: bytes) -> list[int]:
        """Greedy longest match."""
        found, at, n = [], 0, len(word)
        while at < n:
            end = min(n, at + self.longest)
            while word[at:end] not in self.rank:
                end -= 1
            found.append(self.rank[word[at:end]])
            at = end
        return found

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging never crosses the border of each pair.

        Both tokens' merges are undone in reverse order along the border; if at some time the two pieces touching there
        would have merged before the piece that contains one of them was formed, the pair is incompatible.
        """
        a, b = a.copy(), b.copy()
        good = np.ones(len(a), bool)
        size = len(self.tokens)
        limit = np.full(len(a), size)
        live = np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            at = np.searchsorted(self.merge_keys, x * size + y)
            at = np.minimum(at, len(self.merge_keys) - 1)
            merged = np.where(self.merge_keys[at] == x * size + y, self.merge_ranks[at], size)
            bad = merged < limit[live]
            good[live[bad]] = False
            # the younger of both pieces is undone; a left piece wins a tie of merges, as merging goes from the left
            undo_a = x > y
            inner_a, inner_b = self.right[x], self.left[y]
            stuck_a, stuck_b = inner_a == x, inner_b == y
            take_a = (undo_a & ~stuck_a) | (~undo_a & stuck_b & ~stuck_a)
            take_b = ~take_a & ~stuck_b
            limit[live] = np.where(take_a, x, np.where(take_b, y + 1, limit[live]))
            a[live] = np.where(take_a, inner_a, x)
            b[live] = np.where(take_b, inner_b, y)
            live = live[~bad & (take_a | take_b)]
        return good

    def learn(self, words: list[str]) -> None:
        """Ids of words not seen so far, all together."""
        if len(self.words) + len(words) > CACHE:
            self.words.clear()
        raw = [w.encode() for w in words]
        tries: list[list[int]] = []
        owner, first, second = [], [], []
        for no, w in enumerate(raw):
            whole = self.rank.get(w)
            ids = [whole] if whole is not None else self.proposed(w)
            tries.append(ids)
            if len(ids) > 1:
                owner += [no] * (len(ids) - 1)
                first += ids[:-1]
                second += ids[1:]
        if owner:
            pairs, back = np.unique(np.array(first, np.int64) * len(self.tokens) + np.array(second, np.int64), return_inverse=True)
            good = self.compatible(pairs // len(self.tokens), pairs % len(self.tokens))[back]
            for no in np.unique(np.array(owner)[~good]):
                tries[no] = self.exact(raw[no])
        self.words.update(zip(words, tries, strict=True))

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        split = [self.split.findall(t) if t else [] for t in texts]
        unseen = {w for ws in split for w in ws} - self.words.keys()
        if unseen:
            known = len(self.words)
            self.learn(list(unseen))
            if len(self.words) < known:  # the cache was emptied
                self.learn(list({w for ws in split for w in ws} - self.words.keys()))
        look = self.words
        found = [[i for w in ws for i in look[w]] for ws in split]
        for w in unseen:
            if len(w) > CACHED_LENGTH:
                del look[w]
        return found


_LOADED: dict[str, BytePairs] = {}


def _vocabulary(name: str, shared) -> BytePairs:
    """The worker's copy, kept over tasks together with the words it has met."""
    if name not in _LOADED:
        _LOADED.clear()
        _LOADED[name] = BytePairs(shared.value)
    return _LOADED[name]


def encode_corpus(rows: DataFrame, id_col: str, text_col: str, vocabulary: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """``<id_col>, ids``: each row's text as token ids, without special tokens; their strings are ordinary text.

    Null and empty texts give an empty list, blank texts are encoded as they are, whatever the length. Every row gives
    one row, repeated ids too, a null id keeps null. Nothing is shuffled; each worker remembers the words it has seen.
    """
    path = f"{folder}/{vocabulary}.tiktoken"
    shared = rows.sparkSession.sparkContext.broadcast(read_ranks(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = _vocabulary(path, shared)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids = pairs.encode(part.column(1).to_pylist())
                offsets = np.zeros(len(ids) + 1, np.int32)
                np.cumsum([len(x) for x in ids], out=offsets[1:])
                flat = pa.array([i for x in ids for i in x], pa.int32())
                yield pa.record_batch([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), flat)], names=["id", "ids"])

    kind = rows.schema[id_col].dataType.simpleString()
    out = rows.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, ids array<int>")
    return out.withColumnRenamed("id", id_col)
