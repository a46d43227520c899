"""Text read in the wrong encoding: affected rows and, where it can be regained, the original text.

Every distinct word of the corpus is garbled under all chains of a wrong reading; a word of the corpus that equals such
a form is joined to its original by hash. A match counts as it stands where the form is one that no language writes
(several characters for one) or no word has, while its original is plausible; else the words of its line decide together.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.skew import heavy_keys, lookup_join
from tidemark.session import materialize

#: Encodings that text is written in, and those it is mistaken for. "web" is cp1252 with the five
#: undefined bytes kept as control characters, as browsers read it.
WRITTEN = ("utf-8", "web", "cp1250", "iso8859-2", "cp1251", "koi8-r", "shift_jis", "euc_jp", "mac_roman", "cp850", "cp437")
READ = ("web", "latin-1", "cp1250", "iso8859-2", "iso8859-15", "cp1251", "koi8-r", "mac_roman", "cp850", "cp437", "cp866", "cp1254", "gb18030")
#: Readings that a text goes through twice, in any order of two.
TWICE = ("web", "latin-1", "cp1251", "cp850", "cp437", "mac_roman", "cp1250")

#: What stands for a character that could not be read.
LOST = "\ufffd"
#: Distinct words whose forms one task makes, about.
WORDS = 20_000

_SPACE = regex.compile(r"[ \t\r\n]+")
_FENCED = regex.compile(r"`[^`\n]*`")
_EDGE = regex.compile(r"^[\x21-\x2f\x3a-\x40\x5b-\x60\x7b-\x7e]+|[\x21-\x2f\x3a-\x40\x5b-\x60\x7b-\x7e]+$")
_CONTROLS = regex.compile(r"[\x80-\x9f]")
_WEB_UP = {b: chr(b) for b in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}


def _put(text: str, encoding: str) -> bytes:
    if encoding != "web":
        return text.encode(encoding)
    try:
        return text.encode("cp1252")
    except UnicodeError:
        pass
    return b"".join(bytes([ord(c)]) if ord(c) in _WEB_UP else c.encode("cp1252") for c in text)


def _get(raw: bytes, encoding: str) -> str:
    if encoding.endswith("?"):  # what cannot be read is replaced and lost
        return raw.decode(encoding[:-1], "replace")
    if encoding != "web":
        return raw.decode(encoding)
    try:
        return raw.decode("cp1252")
    except UnicodeError:
        pass
    return "".join(_WEB_UP.get(b) or bytes([b]).decode("cp1252") for b in raw)


@lru_cache
def chains() -> list[tuple[tuple[str, str], ...]]:
    """Every chain as steps (written in, read as); its index names it."""
    once = [((w, r),) for w in WRITTEN for r in READ if w != r and (w, r) not in (("web", "latin-1"), ("web", "iso8859-15"), ("web", "cp1254"))]
    lossy = [(("utf-8", r), ("controls", "dropped")) for r in ("latin-1", "web")]
    replaced = [((w, "utf-8?"),) for w in WRITTEN if w != "utf-8"] + [(("utf-8", "ascii?"),)]
    return once + lossy + replaced + [(("utf-8", a), ("utf-8", b)) for a in TWICE for b in TWICE]


def garbled(text: str, chain: tuple[tuple[str, str], ...]) -> str | None:
    """``text`` after the chain, None where a step is impossible."""
    try:
        for written, read in chain:
            if written == "controls":
                text = _CONTROLS.sub("", text)
                continue
            text = _get(_put(text, written), read)
    except (UnicodeError, ValueError):
        return None
    return text


def regained(text: str, chain: tuple[tuple[str, str], ...]) -> str | None:
    """The text that the chain turns into ``text``, verified by going forth again; None for chains that lose characters."""
    back = text
    if chain[-1][0] == "controls" or chain[-1][1].endswith("?"):
        return None
    try:
        for written, read in reversed(chain):
            back = _get(_put(back, read), written)
    except (UnicodeError, ValueError):
        return None
    return back if back != text and garbled(back, chain) == text else None


def sure(chain: tuple[tuple[str, str], ...]) -> bool:
    """Several characters stand for one: no coincidence of single letters."""
    return chain[0][0] in ("utf-8", "shift_jis", "euc_jp")


def words_of(line: str) -> list[str]:
    """Words with a character beyond ASCII, without ASCII punctuation around them; nothing between backticks counts."""
    if line.isascii():
        return []
    plain = _FENCED.sub(" ", line) if "`" in line else line
    found = []
    for w in _SPACE.split(plain):
        if w and not w.isascii():
            w = _EDGE.sub("", w)
            if w:
                found.append(w)
    return found


def _forms(word: str) -> list[tuple[str, int]]:
    """The garbled forms of a word, each with the first chain that gives it; what chains have in common is done once."""
    raw: dict[str, bytes | None] = {}
    first: dict[tuple[str, str], str | None] = {}
    again: dict[tuple[str, str], bytes | None] = {}
    found: dict[str, int] = {}
    for no, chain in enumerate(chains()):
        written, read = chain[0]
        if written not in raw:
            try:
                raw[written] = _put(word, written)
            except UnicodeError:
                raw[written] = None
        if raw[written] is None:
            continue
        g = first.get(chain[0], "")
        if g == "":
            try:
                g = _get(raw[written], read)
            except UnicodeError:
                g = None
            first[chain[0]] = g
        if g is None:
            continue
        if len(chain) == 2:
            if chain[1][0] == "controls":
                g = _CONTROLS.sub("", g)
            else:
                if chain[0] not in again:
                    again[chain[0]] = _put(g, chain[1][0])
                try:
                    g = _get(again[chain[0]], chain[1][1])
                except UnicodeError:
                    continue
        if g and g != word and not g.isascii() and g not in found and 2 * g.count(LOST) <= len(g):
            found[g] = no
    return list(found.items())


def _looks_broken(word: str) -> bool:
    """Control characters, private-use characters, box drawing, or two scripts in one word."""
    return bool(_BROKEN.search(word)) or bool(_LATIN.search(word) and _CYRILLIC.search(word)) or bool(_LATIN.search(word) and _GREEK.search(word))


def _plausible(word: str) -> bool:
    """A word as it is written: of one script, letters only beyond ASCII, and no capital after a small letter."""
    return not (_looks_broken(word) or _NO_LETTER.search(word) or _TURNED.search(word))


_NO_LETTER = regex.compile(r"[^\x00-\x7f\p{L}\p{M}\p{Pd}\p{Pi}\p{Pf}]")
_TURNED = regex.compile(r"(?<!\p{Lu})\p{Ll}\p{Lu}")
_BROKEN = regex.compile(r"[\x80-\x9f-─-▟]")
_LATIN, _CYRILLIC, _GREEK = regex.compile(r"\p{Latin}"), regex.compile(r"\p{Cyrillic}"), regex.compile(r"\p{Greek}")


def _tokens(rows: DataFrame) -> DataFrame:
    """``id, line, word, lost, of`` of every line, ``of`` so many words; ``lost`` are words with U+FFFD."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            no, line, word, broken, of = [], [], [], [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if text is None or text.isascii():
                    continue
                for k, row in enumerate(text.split("\n")):
                    words = dict.fromkeys(words_of(row))
                    for w in words:
                        of.append(len(words))
                        no.append(i)
                        line.append(k)
                        word.append(w)
                        broken.append(LOST in w)
            yield pa.record_batch([pa.array(no, batch.column(0).type), pa.array(line, pa.int32()), pa.array(word, pa.string()), pa.array(broken, pa.bool_()), pa.array(of, pa.int32())], names=["id", "line", "word", "lost", "of"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, line int, word string, lost boolean, of int")


def _hash(word: str) -> int:
    return xxhash.xxh64_intdigest(word) - (1 << 63)


def garbled_words(tokens: DataFrame, ratio: float = 3.0) -> DataFrame:
    """``word, original, chain, strong, firm, lean`` of the distinct garbled words: one row per word, its commonest original.

    A single character needs a chain of several characters for one. ``strong`` words are evidence by themselves, ``firm``
    ones beside another, the others only as part of a whole line; ``lean`` says how much commoner the original is (log 2).
    """
    counts = materialize(tokens.groupBy("word").agg(F.count(F.lit(1)).alias("n")), "words")

    def forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, word, n, chain = [], [], [], []
            for w, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for g, no in _forms(w) if LOST not in w else ():
                    key.append(_hash(g))
                    word.append(w)
                    n.append(c)
                    chain.append(no)
            yield pa.record_batch([pa.array(key, pa.int64()), pa.array(word, pa.string()), pa.array(n, pa.int64()), pa.array(chain, pa.int32())], names=["key", "original", "n_original", "chain"])

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = [_hash(w) for w in batch.column(0).to_pylist()]
            yield pa.record_batch([pa.array(key, pa.int64()), batch.column(0), batch.column(1)], names=["key", "word", "n"])

    # few rows, but each gives a form per chain: spread, and never taken for small enough to broadcast
    spread = counts.repartition(max(2 * counts.sparkSession.sparkContext.defaultParallelism, -(-counts.count() // WORDS)), "word")
    table = spread.mapInArrow(forms, "key long, original string, n_original long, chain int").hint("merge")
    seen = counts.mapInArrow(keyed, "key long, word string, n long")
    met = seen.join(table, "key").where(F.col("n_original") > 0).select("word", "n", "original", "n_original", "chain")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = chains()
        for batch in batches:
            keep = []
            for w, n, o, m, no in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if garbled(o, every[no]) != w:
                    continue  # two words of one hash
                certain = sure(every[no]) and len(w) > len(o) or LOST in w
                broken = bool(_BROKEN.search(w)) and m >= ratio * n
                if not certain and not broken and len(w) < 2:
                    continue
                odd = not certain and not _plausible(w)
                if not certain and not odd and not _plausible(o):
                    continue  # the other way round
                odd = odd and _plausible(o)
                strong = certain or broken or (len(w) >= 4 and (odd or (m >= ratio * n and _looks_broken(w)) or m >= 10 * ratio * n))
                keep.append((w, o, no, strong, certain or odd or m >= ratio * n, math.log2(m / n), m))
            if keep:
                kinds = (pa.string(), pa.string(), pa.int32(), pa.bool_(), pa.bool_(), pa.float64(), pa.int64())
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*keep, strict=True), kinds, strict=True)], names=["word", "original", "chain", "strong", "firm", "lean", "m"])

    checked = met.mapInArrow(verify, "word string, original string, chain int, strong boolean, firm boolean, lean double, m long")
    best = F.max(F.struct("strong", "firm", "m", "original", "chain", "lean")).alias("b")
    return checked.groupBy("word").agg(best).select("word", F.col("b.original").alias("original"), F.col("b.chain").alias("chain"), F.col("b.strong").alias("strong"), F.col("b.firm").alias("firm"), F.col("b.lean").alias("lean"))


def _evidence(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, line, word, original, chain, strong, firm, lean, lost, of`` of the garbled words of every line."""
    given = rows.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where(F.col("text").isNotNull())
    tokens = materialize(_tokens(given), "tokens")
    table = materialize(garbled_words(tokens), "garbled")
    per_word = tokens.groupBy("word").agg(F.count(F.lit(1)).alias("n")).join(table.select("word"), "word")
    hot = heavy_keys(per_word, "word", "n")
    # words of the table, and those that have lost characters and have no original in it
    hits = lookup_join(tokens, table, "word", hot).where(F.col("original").isNotNull() | F.col("lost"))
    sure_or = lambda c: F.coalesce(c, F.lit(True))
    return hits.select("id", "line", "word", "original", "chain", sure_or(F.col("strong")).alias("strong"), sure_or(F.col("firm")).alias("firm"), F.coalesce("lean", F.lit(0.0)).alias("lean"), (F.col("lost") & F.col("original").isNull()).alias("lost"), "of")


#: How much commoner the originals of a line's words have to be on average (log 2) where none is evidence by itself.
LEAN = 0.5


def _passages(words: DataFrame, weak_words: int, *more: Column) -> DataFrame:
    """The lines that count, with their number of words: one strong word, several firm ones, or most words by one chain."""
    lines = words.groupBy("id", "line").agg(
        F.max("strong").alias("strong"), F.countDistinct(F.when(F.col("firm"), F.col("word"))).alias("n_firm"), F.countDistinct("word").alias("n"),
        F.countDistinct("chain").alias("n_chains"), F.avg("lean").alias("lean"), F.max("of").alias("of"), F.count(F.when(F.col("lost"), 1)).alias("n_lost"), *more,
    )
    together = (F.col("n") >= weak_words) & (F.col("n_chains") == 1) & (2 * F.col("n") >= F.col("of")) & (F.col("lean") >= LEAN)
    return lines.where(F.col("strong") | (F.col("n_firm") >= weak_words) | together)


def garbled_rows(rows: DataFrame, id_col: str, text_col: str, weak_words: int = 2) -> DataFrame:
    """``<id_col>, n_words, n_lines, n_lost``: one row per id with a garbled passage, regainable or not; ``n_lost`` of its
    words have lost characters (U+FFFD) and no original in the corpus, and tell so by that character alone.

    A line counts if it has a strong word, a lost character (U+FFFD), or ``weak_words`` different firm words, or if one
    chain takes so many and at least half of its words back to words that are commoner on the whole. What is
    quoted between backticks on one line is none. Null, empty and blank texts have no passage. A repeated id counts its
    rows together. Extra columns are ignored.
    """
    lines = _passages(_evidence(rows, id_col, text_col), weak_words)
    return lines.groupBy("id").agg(F.sum("n").alias("n_words"), F.count(F.lit(1)).alias("n_lines"), F.sum("n_lost").alias("n_lost")).withColumnRenamed("id", id_col)


def restored_texts(rows: DataFrame, id_col: str, text_col: str, weak_words: int = 2) -> DataFrame:
    """``<id_col>, restored, n_restored, n_lost``: the affected rows with garbled words replaced by their originals.

    Where a line's words agree on one chain and the whole line can be taken back through it and forth again unchanged,
    the line is taken back as a whole, so that words without a match are regained too. Lost characters stay and are
    counted. Ids must be unique for a definite result.
    """
    words = _evidence(rows, id_col, text_col)
    lines = _passages(words, weak_words, F.collect_set(F.struct("word", "original", "chain")).alias("words"))
    # a row's garbled words are part of the row itself, so this is no larger than the text
    per = lines.groupBy("id").agg(F.collect_list(F.struct("line", "words")).alias("lines"))
    given = rows.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = given.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = chains()
        for batch in batches:
            out, done, lost = [], [], []
            for text, marks in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                parts, n = text.split("\n"), 0
                for mark in marks:
                    known = {w["word"]: w["original"] for w in mark["words"] if w["original"] is not None}
                    used = {w["chain"] for w in mark["words"] if w["original"] is not None}
                    line = parts[mark["line"]]
                    whole = regained(line, every[next(iter(used))]) if len(used) == 1 and "`" not in line else None
                    if whole is not None:
                        line = whole
                        n += len(known)
                    else:
                        for w in sorted(known, key=len, reverse=True):
                            if w in line:
                                line = line.replace(w, known[w])
                                n += 1
                    parts[mark["line"]] = line
                fixed = "\n".join(parts)
                out.append(fixed)
                done.append(n)
                lost.append(fixed.count(LOST))
            yield pa.record_batch([batch.column(0), pa.array(out, pa.string()), pa.array(done, pa.int32()), pa.array(lost, pa.int32())], names=["id", "restored", "n_restored", "n_lost"])

    return given.join(per, "id").mapInArrow(run, f"id {kind}, restored string, n_restored int, n_lost int").withColumnRenamed("id", id_col)
