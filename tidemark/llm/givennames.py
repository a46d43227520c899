"""Given names learned from a corpus: words that stand where known given names stand.

A run of a word and a rare word stands in slots: what is before it and what is after it. Slots and words score each
other in turns, starting from a short public list of given names; words that score like the known names do without
their own label, and that go with several rare words, are taken for given names too.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.spans import GIVEN, PARTICLES, PRODUCT_WORDS, VENDORS, bare
from tidemark.session import materialize

#: Turns of scoring, different rare words that a learned name goes with, and what part of the known names' median score it needs.
TURNS, PARTNERS, PART = 4, 2, 0.25
#: Times that a word counts in one slot, and links that are scored at one place.
MOST, LINKS = 3, 1_000_000
#: A common word is a learned name only if in so large a part of its texts it goes with a rare word ("For" does not).
RUNS_PART = 0.05
#: What every text with a run has: a capital, a space, at most four short words, a capital.
_MAYBE = r"\p{Lu}\S+[^\S\n](?:\S{1,12}\s?){0,4}\p{Lu}\p{L}"

_TOKEN = regex.compile(r"\p{L}[\p{L}\p{M}'’]*(?:-\p{L}[\p{L}\p{M}'’]+)*|\d+|[^\s\p{L}\d]|\n")


def _runs(text: str, common: frozenset[str]) -> list[tuple[str, str, tuple[str, ...]]]:
    """First word, last word and slots of every run of a capitalised word, maybe a particle or an initial, and a rare one."""
    tokens = [(m.group(), m.start(), m.end()) for m in _TOKEN.finditer(text)]
    kind = [t if not t[0].isalnum() else "0" if t[0].isdigit() else t.lower() for t, _, _ in tokens]
    found = []
    for i in range(len(tokens) - 1):
        first, _, end = tokens[i]
        if len(first) < 2 or not first[0].isupper() or first.lower() in PARTICLES:
            continue
        j = i + 1
        while j < len(tokens) - 1 and tokens[j][1] - end <= 1 and (kind[j] in PARTICLES or kind[j] == "." or len(kind[j]) == 1 and tokens[j][0].isupper()) and j - i < 4:
            end = tokens[j][2]
            j += 1
        last, start, end = tokens[j]
        if text[tokens[j - 1][2] : start] != " " or len(last) < 3 or not last[0].isupper() or last.lower() in common:
            continue
        before = kind[max(0, i - 2) : i]
        after = kind[j + 1 : j + 3]
        slots = ("<" + " ".join(before), ">" + " ".join(after), "-" + " ".join(before[-1:]) + "|" + " ".join(after[:1]))
        found.append((first, last.lower(), slots))
    return found


def _names_in(texts: Iterable[str], common: frozenset[str]) -> tuple[Counter[tuple[str, str]], Counter[tuple[str, str]]]:
    """How often words go with rare words, and how often they stand in slots that say something."""
    goes, links = Counter(), Counter()
    for text in texts:
        for first, last, slots in _runs(text, common):
            w = bare(first)
            goes[w, last] += 1
            links.update((w, s) for s in slots if any(c.isalpha() for c in s))
    return goes, links


def _slot_scores(links: list[tuple[str, str, int]]) -> dict[str, float]:
    """Each word's score by its ``word, slot, times`` and those of the others."""
    names = sorted({w for w, _, _ in links})
    if not names:
        return {}
    number, slot = {w: i for i, w in enumerate(names)}, {}
    w, s, n = np.array([(number[a], slot.setdefault(b, len(slot)), min(c, MOST)) for a, b, c in links]).T
    seed = np.array([a in GIVEN for a in names])
    own = np.bincount(w, n, len(names))
    score = seed.astype(float)
    for _ in range(TURNS):
        label = np.where(seed, 1.0, score)
        total, weight = np.bincount(s, n * label[w], len(slot)), np.bincount(s, n, len(slot))
        # a word's score leaves its own label out of its slots; what few others share says little
        left, others = total[s] - n * label[w], weight[s] - n
        score = np.bincount(w, n * left / (others + 1.0), len(names)) / own
    return dict(zip(names, score.tolist(), strict=True))


def _spread_scores(links: DataFrame) -> DataFrame:
    """``w, score``: the same by joins, for links (``w, s, n``) beyond one block."""
    n = materialize(links.select("w", "s", F.least("n", F.lit(MOST)).cast("double").alias("n"), F.col("w").isin(sorted(GIVEN)).alias("seed")), "name-links")
    score = n.select("w", F.col("seed").cast("double").alias("score")).distinct()
    for _ in range(TURNS):
        known = n.join(score, "w").withColumn("label", F.when(F.col("seed"), F.lit(1.0)).otherwise(F.col("score")))
        slots = known.groupBy("s").agg(F.sum(F.col("n") * F.col("label")).alias("total"), F.sum("n").alias("weight"))
        part = F.col("n") * (F.col("total") - F.col("n") * F.col("label")) / (F.col("weight") - F.col("n") + 1)
        score = materialize(known.join(slots, "s").groupBy("w").agg((F.sum(part) / F.sum("n")).alias("score")), "name-scores")
    return score


def _least(known: list[float]) -> float:
    return max(PART * float(np.median(known)), 1e-6)


def _allowed(w: str, runs: int, common: frozenset[str]) -> bool:
    return w not in VENDORS and w not in PRODUCT_WORDS and runs >= RUNS_PART * getattr(common, "times", {}).get(w, 0)


def learned_given(texts: list[str], common: frozenset[str]) -> frozenset[str]:
    """Given names of a list of distinct texts: the known ones and those that stand like them."""
    goes, links = _names_in(texts, common)
    return _chosen(_slot_scores([(w, s, n) for (w, s), n in links.items()]), _partners(goes), common)


def _partners(goes: dict[tuple[str, str], int]) -> dict[str, tuple[int, int]]:
    partners, runs = Counter(w for w, _ in goes), Counter()
    for (w, _), n in goes.items():
        runs[w] += n
    return {w: (k, runs[w]) for w, k in partners.items() if k >= PARTNERS}


def _chosen(score: dict[str, float], partners: dict[str, tuple[int, int]], common: frozenset[str]) -> frozenset[str]:
    """Of ``partners``, which holds the words of enough partners with their runs, those that score like known names."""
    known = [v for a, v in score.items() if a in GIVEN and a in partners]
    if not known:
        return GIVEN
    return GIVEN | {a for a, v in score.items() if a in partners and v >= _least(known) and _allowed(a, partners[a][1], common)}


def learned_given_of(texts: DataFrame, common: frozenset[str], block: int = LINKS) -> frozenset[str]:
    """The same for all distinct texts (``text``) of a table; up to ``block`` links are scored here, more by joins."""
    shared = texts.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            goes, links = _names_in(batch.column(0).to_pylist(), shared.value)
            rows = [(w, last, None, n) for (w, last), n in goes.items()] + [(w, None, s, n) for (w, s), n in links.items()]
            yield pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(),) * 3 + (pa.int64(),))], names=["w", "last", "s", "n"])

    found = texts.where(F.col("text").rlike(_MAYBE)).select("text").distinct().mapInArrow(run, "w string, last string, s string, n long")
    found = materialize(found.groupBy("w", "last", "s").agg(F.sum("n").alias("n")), "name-runs")
    links = found.where("s IS NOT NULL").select("w", "s", "n")
    partners = found.where("last IS NOT NULL").groupBy("w").agg(F.count(F.lit(1)).alias("partners"), F.sum("n").alias("runs")).where(F.col("partners") >= PARTNERS)
    if links.count() <= block:
        times = {r["w"]: (r["partners"], r["runs"]) for r in partners.collect()}
        return _chosen(_slot_scores([tuple(r) for r in links.orderBy("w", "s").collect()]), times, common)
    score = materialize(_spread_scores(links).join(partners, "w"), "name-scores")
    known = [r["score"] for r in score.where(F.col("w").isin(sorted(GIVEN))).collect()]
    if not known:
        return GIVEN
    return GIVEN | {r["w"] for r in score.where(F.col("score") >= _least(known)).select("w", "runs").collect() if _allowed(r["w"], r["runs"], common)}
