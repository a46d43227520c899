"""Texts cut off by field limits or broken transfers.

Intact texts are cut artificially to get positives; a hashed logistic regression on closing characters, open structure
and the distance to the lengths at which a source's texts pile up is trained on them, and scores every row.
"""

from __future__ import annotations

import json
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.hashed import HashedLogistic
from tidemark.operators.skew import heavy_keys
from tidemark.session import materialize

#: Bound of the labelled rows that the model is fitted on; words that can count as known; lengths of one source that can count as limits.
SAMPLE, KNOWN_WORDS, LIMITS = 8000, 30_000, 4000
#: Ways in which distinct texts go on to the same last three words before these count as an ending that was meant.
SHARED_ENDING = 4
#: Probability from which a short text without a sentence's end is no longer taken for a whole one while fitting.
SUSPECT = 0.1
#: Texts shorter than this, and held by at least one row in so many, are replies that were meant.
SHORT, SHORT_SHARE = 40, 2000

#: Marks that cutting programs leave.
MARKS = ("...", "…", " ...", " …", "[...]", " [...]", " [cut]", " [truncated]", "[truncated]", " <snip>", " <truncated>", " (truncated)", " (+{n} chars)", " [+{n} chars]", " (+{n} more)", " [more]", " --More--")

_MARK = regex.compile(r"\s*(?:\.\.\.|…|[\[<(](?:\.\.\.|…|\+?\d+ (?:more )?(?:chars|characters|bytes|lines)|\+\d+ more|cut|snip|snipped|truncated|more|continued|trimmed)[^\])>]{0,12}[\])>]|--More--)\s*$", regex.I)
_WORD = regex.compile(r"[\p{L}\p{N}]+(?:[._/'’-][\p{L}\p{N}]+)*")
_SENTENCE_END = regex.compile(r"[.!?。！？][\"'”’)\]»」`]*(?:\s|$)")
_ENDS_SENTENCE = regex.compile(r"[.!?。！？][\"'”’)\]»」`*_]*$")
_PATH = regex.compile(r"^[\w.-]+(?:/[\w.-]+)+(?::\d+)?$")
_FINAL_PATH = regex.compile(r"/[\w-]+\.\w{1,5}(?::\d+)?$")


def _shape(text: str) -> str:
    out = []
    for c in text:
        k = "a" if c.islower() else "A" if c.isupper() else "l" if c.isalpha() else "0" if c.isdigit() else "_" if c in " \t" else "n" if c in "\r\n" else c
        if not out or out[-1] != k or k not in "aA0l":
            out.append(k)
    return "".join(out)


def _json_state(text: str) -> str:
    try:
        json.loads(text)
        return "whole"
    except ValueError:
        pass
    depth, inside, skip = 0, False, False
    for c in text:
        if skip:
            skip = False
        elif inside:
            if c == "\\":
                skip = True
            elif c == '"':
                inside = False
        elif c == '"':
            inside = True
        elif c in "{[":
            depth += 1
        elif c in "}]":
            depth -= 1
    return "in string" if inside else "open" if depth > 0 else "broken"


class Limits:
    """Lengths at which texts of a source pile up: characters and bytes, as sorted lists."""

    def __init__(self, peaks: dict[tuple[str, str], list[int]]):
        self.peaks = {k: sorted(v) for k, v in peaks.items()}

    def near(self, source: str, kind: str, n: int) -> str:
        at = self.peaks.get((source, kind))
        if not at:
            return "none"
        i = bisect_left(at, n)
        below = at[i] - n if i < len(at) else 99
        if below == 0:
            return "at"
        return "under" if below <= 12 else "far"


def features(text: str, source: str, limits: Limits, known: frozenset[str]) -> list[str]:
    """Names of the features of one text that is neither null nor blank."""
    mark = _MARK.search(text)
    body = text[: mark.start()] if mark else text
    tail = body.rstrip()
    start = text.lstrip()[:1]
    fences = text.count("```")
    is_json = start in "{[" and bool(start) and (":" in text or "," in text) and not _SENTENCE_END.search(text[:1])
    if start == "[" and not (text.lstrip()[1:2] in '"{[' or text.lstrip()[1:2].isdigit()):
        is_json = False
    words = _WORD.findall(tail)
    sentences = len(_SENTENCE_END.findall(tail))
    closed = bool(_ENDS_SENTENCE.search(tail))
    last = words[-1] if words and tail.endswith(words[-1]) else ""
    lone = len(words) <= 8 and sentences == 0
    if fences:
        kind = "fence open" if fences % 2 else "fence shut"
    elif is_json:
        kind = "json " + _json_state(body.strip() if mark else text.strip())
    elif "\n" not in tail and sentences == 0 and len(tail) < 80:
        kind = "short"
    else:
        kind = "prose"
    first = words[0] if words else ""
    m = mark.group().strip()[:6] if mark else ""
    m = regex.sub(r"\d+", "0", m)
    at = [limits.near(source, "c", len(text)), limits.near(source, "b", len(text.encode())), limits.near(source, "c", len(body))]
    limit = "at" if "at" in at else "under" if "under" in at else "far"
    end = tail[-1:]
    cls = "end" if closed else "word" if last else "comma" if end in ",;:、，" else "open" if end in "([{<“„«\"'" else "join" if end in "-_/\\=.+" else "close" if end in ")]}>`" else "other"
    open_pairs = "".join(a for a, b in ("()", "[]", "{}", "“”", "«»") if tail.count(a) > tail.count(b)) + ("`" if tail.count("`") % 2 else "") + ('"' if tail.count('"') % 2 else "")
    novel = "" if not last else "known" if last.lower() in known else "number" if last.isdigit() else "path" if _FINAL_PATH.search(tail) else "new"
    found = [
        "kind=" + kind, "class=" + cls, f"kind,class={kind},{cls}", "mark=" + m, f"mark,class={bool(mark)},{cls}", f"mark,kind={bool(mark)},{kind}",
        "shape=" + _shape(tail[-4:]), f"kind,shape={kind},{_shape(tail[-3:])}", "limit=" + limit, f"limit,class={limit},{cls}", f"limit,kind={limit},{kind}",
        "open=" + open_pairs, f"open,kind={bool(open_pairs)},{kind}", f"novel={kind},{novel}", f"novel,class={novel},{cls},{min(sentences, 2)}", f"size={kind},{min(len(text).bit_length(), 12)}",
        f"sentences={min(sentences, 3)},{cls}", f"lone={lone},{cls}", f"first={first.lower()},{lone}", f"last={last.lower()[:12]},{bool(mark)}", "last two=" + " ".join(words[-2:]).lower()[-24:] + f",{bool(mark)}",
        f"space={body[-1:].isspace()},{cls}", "lost=" + str("�" in text[-3:]), f"lines={min(text.count(chr(10)), 3)},{cls}",
    ]
    if kind == "short":
        found += [f"short word={first.lower()},{len(words)}", f"short end={_shape(tail[-8:])}", f"short size={len(tail) // 8}"]
    return found


def cut(text: str, rng: np.random.Generator, limits: list[int]) -> str | None:
    """A start of the text that ends inside a sentence, a block or a value; None if there is none."""
    for _ in range(6):
        fit = [n for n in limits if 40 <= n < len(text)]
        if fit and rng.random() < 0.5:
            n = fit[int(rng.integers(len(fit)))]
        else:
            n = int(rng.integers(25, max(26, len(text) - 3 if rng.random() < 0.8 else min(90, len(text) - 3))))
        part = text[:n]
        open_block = part.count("```") % 2 == 1 or text.lstrip()[:1] == "{"
        if not part.strip() or (_ENDS_SENTENCE.search(part.rstrip()) and not open_block):
            continue  # nobody could tell
        if rng.random() < 0.35:
            part = part.rstrip() if rng.random() < 0.5 else part
            part += MARKS[int(rng.integers(len(MARKS)))].format(n=len(text) - n)
        elif rng.random() < 0.05:
            part += "�"  # a transfer broke off inside a character
        return part
    return None


def _last_words(text: Column) -> Column:
    return F.split(F.rtrim(F.lower(F.right(text, F.lit(160)))), r"\s+")


def _ending(words: Column) -> Column:
    """The last three words."""
    return F.array_join(F.slice(words, F.greatest(F.size(words) - 2, F.lit(1)), 3), " ")


def _lead(words: Column) -> Column:
    """The words from the twelfth to the ninth from the end: what is before a last sentence that texts may share."""
    return F.array_join(F.slice(words, F.greatest(F.size(words) - 11, F.lit(1)), F.greatest(F.least(F.lit(4), F.size(words) - 3), F.lit(0))), " ")


def _intact(text: str) -> bool:
    tail = text.rstrip()
    start = text.lstrip()[:1]
    if "```" in text:
        return text.count("```") % 2 == 0 and tail.endswith("```")
    if start == "{":
        return _json_state(text.strip()) == "whole"
    return bool(_ENDS_SENTENCE.search(tail)) and not _MARK.search(text)


def _brief(text: str) -> bool:
    """Commands and short replies: one line without any sentence, mark or open block."""
    tail = text.strip()
    return len(tail) < 100 and "\n" not in tail and tail[:1] not in "{[" and not _SENTENCE_END.search(tail) and not _MARK.search(text)


class CutModel:
    """Fitted on a bounded sample of (source, text); no text at all gives a model that finds nothing. ``meant`` are the
    texts of the sample whose ending is known to be intact, ``replies`` short intact ones with their weights."""

    def __init__(self, sample: list[tuple[str, str]], limits: Limits, known: frozenset[str], meant: frozenset[str] = frozenset(), replies: list[tuple[str, str, int]] | None = None, seed: int = 17):
        self.limits, self.known = limits, known
        rng = np.random.default_rng(seed)
        known_good = [(s, t) for s, t in sample if _intact(t) or t in meant]
        known_good += [(s, t) for s, t, n in replies or [] for _ in range(n)]
        brief = [(s, t) for s, t in sample if _brief(t) and not _intact(t) and t not in meant]
        made = []
        for s, t in sample:
            if len(t) >= 60 and _intact(t):
                c = cut(t, rng, limits.peaks.get((s, "c"), []))
                if c:
                    made.append(features(c, s, limits, known))
        self.model = HashedLogistic()
        if not made:
            self.model.bias = -30.0
            return
        good, short = ([features(t, s, limits, known) for s, t in rows] for rows in (known_good, brief))
        # among short texts without a sentence's end some are cut: those that look it are taken for neither in a second fit
        labels = lambda n: np.array([0.0] * (len(good) + n) + [1.0] * len(made))
        self.model.fit(good + short + made, labels(len(short)))
        clear = [f for f, p in zip(short, self.model.probability(short), strict=True) if p < SUSPECT] if short else []
        if len(clear) < len(short):
            self.model = HashedLogistic().fit(good + clear + made, labels(len(clear)))

    def probability(self, rows: list[tuple[str, str]]) -> np.ndarray:
        return self.model.probability([features(t, s, self.limits, self.known) for s, t in rows])


def _limits(rows: DataFrame, most: int) -> Limits:
    """Lengths held by far more texts of a source than the lengths around them, counted over all rows."""
    long = rows.where(F.length("text") >= 40)
    lengths = F.array(F.struct(F.lit("c").alias("kind"), F.length("text").alias("n")), F.struct(F.lit("b").alias("kind"), F.octet_length("text").alias("n")))
    counts = materialize(long.select("source", F.inline(lengths)).groupBy("source", "kind", "n").agg(F.count(F.lit(1)).alias("c")), "lengths")
    around = counts.select("source", "kind", "n", "c", F.explode(F.sequence(F.lit(-5), F.lit(5))).alias("d"))
    near = around.where("d <> 0").select("source", "kind", (F.col("n") + F.col("d")).alias("n"), F.col("c").alias("o")).groupBy("source", "kind", "n").agg(F.sum("o").alias("others"))
    # the ten neighbours together hold less than this length alone would explain
    total = counts.groupBy("source", "kind").agg(F.sum("c").alias("t"))
    often = counts.join(total, ["source", "kind"]).where(F.col("c") * F.lit(most) >= F.col("t")).drop("t")  # no more than ``most`` of a source can be
    peaks = often.join(near, ["source", "kind", "n"], "left").withColumn("others", F.coalesce("others", F.lit(0))).where("c >= 8 AND c * 10 > 4 * others")
    found: dict[tuple[str, str], list[int]] = {}
    for r in peaks.collect():
        found.setdefault((r["source"], r["kind"]), []).append(r["n"])
    return Limits(found)


def _known_words(rows: DataFrame, most: int) -> frozenset[str]:
    """Words before a text's last that make up at least one part in ``most`` of all: no more than that many."""
    inner = F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}]+)(?=[^\p{L}\p{N}])"), 1)
    words = materialize(rows.select(F.explode(F.array_distinct(inner)).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "words")
    return frozenset(r["w"] for r in heavy_keys(words, "w", "n", most).collect())


def _meant_endings(rows: DataFrame, endings: list[str]) -> frozenset[str]:
    """Those of the endings that are meant. A cut ends anywhere, so an ending to which many texts go on in different ways
    was meant; copies of one text, and texts alike before the ending, are one way. Counted over all rows."""
    wanted = rows.sparkSession.createDataFrame([(e,) for e in endings], "ending string")
    words = rows.select(_last_words(F.col("text")).alias("words"))
    met = words.select(_ending(F.col("words")).alias("ending"), _lead(F.col("words")).alias("lead"))
    ways = met.join(F.broadcast(wanted), "ending", "left_semi").distinct().groupBy("ending").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= SHARED_ENDING)
    return frozenset(r["ending"] for r in ways.collect())


def cut_scores(rows: DataFrame, id_col: str, text_col: str, source_col: str, order_col: str | None = None, sample: int = SAMPLE) -> DataFrame:
    """``id, source, probability``: one row per id whose text is neither null, empty nor blank.

    A repeated id counts once: its copy greatest by ``order_col``, then by probability and source; null ids are left out.
    A null source is a source of its own. ``sample`` bounds the rows the model is fitted on; lengths, words and scores
    cover all rows and whole texts. Extra columns are ignored; no rows give no rows.
    """
    spark = rows.sparkSession
    given = rows.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"), F.col(text_col).cast("string").alias("text"),
        (F.col(order_col) if order_col else F.lit(0)).alias("at"), F.col(source_col).cast("string").alias("given_source"),
    ).where(F.col("id").isNotNull() & F.col("text").rlike(r"\S"))
    limits, known = _limits(given, LIMITS), _known_words(given, KNOWN_WORDS)
    # the distinct texts of smallest hash: a random sample that is the same each time; what is far above it stays with the executors
    n_rows, n = (max(x, 1) for x in given.agg(F.count(F.lit(1)), F.approx_count_distinct(F.xxhash64("text"))).first())
    short = given.where(F.length("text") < SHORT).groupBy("text").agg(F.count(F.lit(1)).alias("n"), F.min("source").alias("source"))
    replies = [(r["source"], r["text"], max(1, round(r["n"] * sample / n_rows))) for r in short.where(F.col("n") * SHORT_SHARE >= n_rows).where("n > 1").orderBy("text").collect()]
    bound = int(min(1.0, 1.3 * sample / n + 200 / n) * 2**31)
    hashed = given.select("source", "text", F.pmod(F.xxhash64("text"), F.lit(2**31)).alias("h")).where(F.col("h") < bound)
    once = hashed.groupBy("h").agg(F.min(F.struct("text", "source")).alias("r"))
    part = once.orderBy("h").limit(sample).select("r.source", "r.text", _ending(_last_words(F.col("r.text"))).alias("ending")).collect()
    meant = _meant_endings(given, sorted({r["ending"] for r in part}))
    fitted = CutModel([(r["source"], r["text"]) for r in part], limits, known, frozenset(r["text"] for r in part if r["ending"] in meant), replies)
    model = spark.sparkContext.broadcast(fitted)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = model.value.probability(list(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)))
            yield pa.record_batch([batch.column(0), batch.column(3), batch.column(4), pa.array(p)], names=["id", "at", "source", "probability"])

    kinds = {f.name: f.dataType.simpleString() for f in given.schema.fields}
    scored = given.select("id", "source", "text", "at", "given_source").mapInArrow(score, f"id {kinds['id']}, at {kinds['at']}, source string, probability double")
    return scored.groupBy("id").agg(F.max(F.struct("at", "probability", "source")).alias("r")).select("id", F.col("r.source").alias("source"), F.col("r.probability").alias("probability"))


def cut_report(scores: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Rows, cut rows and their share, per source."""
    return scores.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count(F.when(F.col("probability") >= threshold, 1)).alias("n_cut"), F.round(F.avg((F.col("probability") >= threshold).cast("double")), 6).alias("share")
    )
