"""Text functions: tokens, redaction, path exclusion, remotes, reversible compression."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKEN_SPLIT = r"[^\p{L}\p{N}]+"


def tokens(c: Column) -> Column:
    """Lower-case runs of letters and digits, repeated ones too; null gives an empty array."""
    return F.array_remove(F.split(F.lower(F.coalesce(c, F.lit(""))), TOKEN_SPLIT), "")


def query_tokens(query: str) -> list[str]:
    return [t for t in re.split(r"[^\w]+|_", query.lower()) if t]


def redact(c: Column, tags: tuple[str, ...]) -> Column:
    """Text without ``<tag ...>...</tag>``; an unterminated tag stays."""
    for t in tags:
        c = F.regexp_replace(c, rf"(?is)<{re.escape(t)}(?:\s[^>]*)?>.*?</{re.escape(t)}\s*>", "")
    return c


def glob_regex(glob: str) -> str:
    """Java and RE2 pattern of a whole-path glob; ``*`` crosses ``/``, a leading ``**/`` may match nothing."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif glob[i] == "*":
            out, i = out + ".*", i + 1
        elif glob[i] == "?":
            out, i = out + ".", i + 1
        else:
            out, i = out + re.escape(glob[i]), i + 1
    return f"^(?:{out})$"


#: ASCII punctuation around a path-like token, without ``.`` and ``/``.
EDGE_PUNCTUATION = r"^[!-\-:-@\[-`{-~]+|[!-\-:-@\[-`{-~]+$"


def names_excluded_path(c: Column, globs: tuple[str, ...]) -> Column:
    """Whether a whitespace token of the text, without punctuation around it, matches a glob."""
    pattern = "|".join(glob_regex(g) for g in globs)
    words = F.split(F.coalesce(c, F.lit("")), r"\s+")
    return F.exists(words, lambda w: F.regexp_replace(w, EDGE_PUNCTUATION, "").rlike(pattern))


def git_remote(c: Column) -> Column:
    """``host/path`` of a remote in any spelling: no scheme, user, port or ``.git``, host in lower case; else null."""
    rest = F.regexp_replace(F.trim(c), r"^[^:]*://", "")
    rest = F.regexp_replace(rest, r"^.*@", "")
    rest = F.regexp_replace(rest, r"^([^:]*):\d[^/]*/?", "$1/")
    rest = F.regexp_replace(rest, r"^([^:/]*):", "$1/")
    rest = F.regexp_replace(F.regexp_replace(F.regexp_replace(rest, r"/+$", ""), r"(\.git)+$", ""), r"/+$", "")
    host, path = F.regexp_extract(rest, r"^([^/]+)/(.+)$", 1), F.regexp_extract(rest, r"^([^/]+)/(.+)$", 2)
    return F.when((host != "") & (path != ""), F.concat(F.lower(host), F.lit("/"), path))


def ellipsis(c: Column, most: int, mark: str = "...") -> Column:
    """At most ``most`` characters; longer texts end in the mark."""
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most - len(mark)), F.lit(mark))).otherwise(c)


def content_hash(c: Column) -> Column:
    return F.lower(F.hex(F.xxhash64(c)))


# The dictionary; a word's marker is its place in it, counted from the first private-use character.
DICTIONARY = (
    "the and that with this from have been were which their would there about because should could these those where after before through between during without however therefore "
    "although function implementation configuration application currently previously essentially basically actually additionally specifically particularly significantly memory project "
    "session default enabled disabled"
).split()
_FIRST, _CAPITAL, _AS_IS = 0xE000, chr(0xE0F0), chr(0xE0FF)
_TO_MARK = {w: chr(_FIRST + i) for i, w in enumerate(DICTIONARY)}
_FROM_MARK = {m: w for w, m in _TO_MARK.items()}
_MARKED = re.compile(f"[{chr(_FIRST)}-{_AS_IS}]")
_EXPAND = re.compile(f"([{chr(_FIRST)}-{chr(_FIRST + 0xEF)}])({_CAPITAL})?")
_CORE = re.compile(r"^([!-/:-@\[-`{-~]*)([^\W\d_]+)([!-/:-@\[-`{-~]*)$")


def _mark(m: re.Match) -> str:
    word = m.group()
    parts = None if re.search(r"[/\\@_0-9]", word) else _CORE.match(word)
    if not parts:
        return word
    core = parts.group(2)
    mark = _TO_MARK.get(core.lower())
    if mark is None or core not in (core.lower(), core.capitalize()):
        return word  # other spellings would not come back
    return parts.group(1) + mark + (_CAPITAL if core[0].isupper() else "") + parts.group(3)


def compress_text(text: str | None) -> str | None:
    """Dictionary words as single characters; code fences, inline code and tokens like paths stay. Text that holds a
    marker already is kept as it is behind a mark of its own, so that expanding always gives the input back."""
    if text is None:
        return None
    if _MARKED.search(text):
        return _AS_IS + text
    out, fenced = [], False
    for line in text.split("\n"):
        if line.lstrip().startswith("```"):
            fenced = not fenced
        elif not fenced:
            line = "".join(p if p[:1] == "`" else re.sub(r"\S+", _mark, p) for p in re.split(r"(`[^`]*`|`[^`]*$)", line))
        out.append(line)
    return "\n".join(out)


def expand_text(text: str | None) -> str | None:
    if text is None:
        return None
    if text.startswith(_AS_IS):
        return text[1:]
    return _EXPAND.sub(lambda m: (w.capitalize() if m.group(2) else w) if (w := _FROM_MARK.get(m.group(1))) else m.group(), text)


@F.pandas_udf(T.StringType())
def compress(c: pd.Series) -> pd.Series:
    return c.map(compress_text)


@F.pandas_udf(T.StringType())
def expand(c: pd.Series) -> pd.Series:
    return c.map(expand_text)
