"""Personal information inside free text: found, and replaced with typed placeholders.

High-recall generators (see spans) propose overlapping spans; boosted trees judge them by format and context; thresholds
calibrated on held-out ways of writing and held-out surroundings select what is redacted. The trees are fitted on made-up
values and decoys (see made), set in made-up frames and amid made-up sentences. What a corpus adds, its common words and
given names, is counted over all of it.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.boosting import BoostedTrees, best_threshold
from tidemark.llm.givennames import learned_given_of
from tidemark.llm.made import SURROUNDINGS, made_texts
from tidemark.llm.spans import KINDS, CommonWords, Span, bare, candidates, given_names, measures
from tidemark.operators.skew import heavy_keys
from tidemark.session import materialize

#: Made-up values per kind that the model is fitted on.
MADE = 1500
#: A word is common if it makes up at least one part in so many of all words: no more than that many are.
COMMON_SHARE = 40_000
#: One frame and one way of writing in so many is held out for the thresholds.
HELD = 4
#: Times that one sequence of words outside made-up names counts as no name.
REPEATED = 3


class PersonalModel:
    """Fitted on made-up values amid the sentences of ``sample``, with the common words and given names of a corpus."""

    def __init__(self, sample: list[str], common: frozenset[str], made: int = MADE):
        self.common = common
        parts = [p for t in sample for p in t.replace("\n", ". ").split(". ") if 20 < len(p) < 200][: 4 * made]
        rows: dict[str, list] = {k: [] for k in KINDS}
        seen: Counter[str] = Counter()
        given = given_names(common)
        frequent = sorted(w for w in common if len(w) >= 4 and w not in given)
        copied = sorted(w for w in getattr(common, "often", ()) if w not in common and w not in given)
        for text, truth, frame, family, (low, high) in made_texts(parts, made, frequent=frequent, copied=copied):
            held = frame >= 0 and frame % 1000 % HELD == 1 or family >= 0 and family % HELD == 1
            for s in candidates(text, common):
                is_true = (s.kind, s.start, s.end) in truth
                if s.kind == "name" and not is_true:
                    if (s.end <= low or s.start >= high) and self._maybe_name(text[s.start : s.end], given):
                        continue  # the sample's own sentences have names, and nobody has said which
                    # what the sample's sentences repeat may be a person's name: it is no evidence against names beyond this
                    seen[text[s.start : s.end]] += 1
                    if seen[text[s.start : s.end]] > REPEATED:
                        continue
                rows[s.kind].append((text, s, float(is_true), held))
        self.trees: dict[str, BoostedTrees] = {}
        self.threshold: dict[str, float] = {}
        for kind in KINDS:
            self._fit(kind, rows[kind])

    def _maybe_name(self, value: str, given: frozenset[str]) -> bool:
        words = value.replace(",", "").replace(".", "").split(" ")
        return (bare(words[0]) in given or bare(words[-1]) in given or len(words[0]) == 1) and any(w.lower() not in self.common for w in words)

    def _numbers(self, pairs: list[tuple[str, Span]]) -> np.ndarray:
        return np.array([measures(t, s, self.common) for t, s in pairs])

    def _fit(self, kind: str, rows: list) -> None:
        y = np.array([r[2] for r in rows])
        if not len(y) or y.min() == y.max():
            self.trees[kind], self.threshold[kind] = BoostedTrees(trees=0), 0.5
            self.trees[kind].base = -30.0
            return
        x = self._numbers([(r[0], r[1]) for r in rows])
        place = np.unique([r[0] for r in rows], return_inverse=True)[1]
        held = np.array([r[3] for r in rows])
        first = BoostedTrees(trees=100, depth=4, rate=0.2, least=20).fit(x[~held], y[~held])
        # of overlapping spans only the likeliest is taken: thresholds are set on the best of each held-out text
        p, of, truth = first.probability(x[held]), place[held], y[held]
        order = np.lexsort((-p, of))
        best = order[np.unique(of[order], return_index=True)[1]]
        self.threshold[kind] = best_threshold(p[best], truth[best])
        self.trees[kind] = BoostedTrees(trees=100, depth=4, rate=0.2, least=20).fit(x, y)

    def probability(self, pairs: list[tuple[str, Span]]) -> np.ndarray:
        found = np.zeros(len(pairs))
        for kind in KINDS:
            mine = [i for i, (_, s) in enumerate(pairs) if s.kind == kind]
            if mine:
                found[mine] = self.trees[kind].probability(self._numbers([pairs[i] for i in mine]))
        return found

    def select(self, texts: list[str]) -> list[list[tuple[Span, float]]]:
        """Spans to redact in each text, in order and without overlap: the likelier first, then the longer."""
        pairs, owner = [], []
        for no, text in enumerate(texts):
            for s in candidates(text, self.common):
                pairs.append((text, s))
                owner.append(no)
        chosen: list[list[tuple[Span, float]]] = [[] for _ in texts]
        if not pairs:
            return chosen
        p = self.probability(pairs)
        for i in np.lexsort((np.array([s.start - s.end for _, s in pairs]), -np.round(p, 3))).tolist():
            s = pairs[i][1]
            if p[i] >= self.threshold[s.kind] and all(s.end <= o.start or s.start >= o.end for o, _ in chosen[owner[i]]):
                chosen[owner[i]].append((s, float(p[i])))
        return [sorted(c, key=lambda x: x[0].start) for c in chosen]


def common_words(texts: DataFrame, share: int) -> CommonWords:
    """Words of many distinct texts, and beside them those of many rows: copies tell the trees something, but drop nothing."""
    once = texts.groupBy("text").agg(F.count(F.lit(1)).alias("copies"))
    words = once.select("copies", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}]+)"), 1))).alias("w"))
    counts = materialize(words.groupBy("w").agg(F.count(F.lit(1)).alias("n"), F.sum("copies").alias("rows")).where("rows >= 10"), "words")
    common = CommonWords(r["w"] for r in heavy_keys(counts.where("n >= 10"), "w", "n", share).collect())
    common.times = {r["w"]: r["n"] for r in counts.where(F.col("n") >= 10).join(heavy_keys(counts.where("n >= 10"), "w", "n", share), "w", "left_semi").collect()}
    common.often = frozenset(r["w"] for r in heavy_keys(counts, "w", "rows", share).collect())
    return common


def fitted_model(texts: DataFrame, made: int = MADE) -> PersonalModel:
    """The model for a corpus (``text``): common words and given names from all of it, the rest made up."""
    common = common_words(texts, COMMON_SHARE)
    common.given = learned_given_of(texts, common)
    return PersonalModel(SURROUNDINGS, common, made)


def _texts(rows: DataFrame, text_col: str) -> DataFrame:
    return rows.select(F.col(text_col).cast("string").alias("text")).where(F.col("text").rlike(r"\S"))


def personal_spans(rows: DataFrame, id_col: str, text_col: str, model: PersonalModel | None = None) -> DataFrame:
    """``id, kind, value, start, probability``: every place of personal information; start counts characters.

    Null, empty and blank texts have none. Every row is read whole; rows of a null id are left out; repeated rows give
    repeated places. Extra columns are ignored.
    """
    model = model or fitted_model(_texts(rows, text_col))
    shared = rows.sparkSession.sparkContext.broadcast(model)
    given = rows.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where(F.col("id").isNotNull() & F.col("text").rlike(r"\S"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out = [(i, s.kind, t[s.start : s.end], s.start, p) for i, t, spans in zip(ids, texts, shared.value.select(texts), strict=True) for s, p in spans]
            kinds = (batch.column(0).type, pa.string(), pa.string(), pa.int32(), pa.float64())
            yield pa.record_batch([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=["id", "kind", "value", "start", "probability"])

    return given.mapInArrow(run, f"id {given.schema['id'].dataType.simpleString()}, kind string, value string, start int, probability double")


def redacted(rows: DataFrame, text_col: str, model: PersonalModel | None = None) -> DataFrame:
    """``rows`` with personal information in ``text_col`` replaced by ``[EMAIL]``, ``[PHONE]``, ``[ID_NUMBER]``,
    ``[ADDRESS]`` and ``[NAME]``; all else stays as it is, null stays null. Other columns are unchanged."""
    model = model or fitted_model(_texts(rows, text_col))
    shared = rows.sparkSession.sparkContext.broadcast(model)
    at = rows.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            out = []
            for t, spans in zip(texts, shared.value.select([t or "" for t in texts]), strict=True):
                for s, _ in reversed(spans):
                    t = f"{t[: s.start]}[{s.kind.upper()}]{t[s.end :]}"
                out.append(t)
            columns = [pa.array(out, pa.string()) if k == at else c for k, c in enumerate(batch.columns)]
            yield pa.record_batch(columns, names=batch.schema.names)

    return rows.withColumn(text_col, F.col(f"`{text_col}`").cast("string")).mapInArrow(run, rows.withColumn(text_col, F.col(f"`{text_col}`").cast("string")).schema)
