"""The JSON column of memories."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def tags(metadata: Column) -> Column:
    """Tags of the metadata; null, corrupt or missing ones give an empty array."""
    return F.coalesce(F.from_json(F.get_json_object(metadata, "$.tags"), "array<string>"), F.array().cast("array<string>"))


def has_tag(metadata: Column, tag: str) -> Column:
    return F.array_contains(tags(metadata), tag)


def session_key(metadata: Column) -> Column:
    return F.coalesce(F.get_json_object(metadata, "$.session_id"), F.get_json_object(metadata, "$.extra.session_id"))


def tool_name(metadata: Column, content: Column) -> Column:
    first = F.regexp_extract(F.coalesce(content, F.lit("")), r"^\s*(\S+)", 1)
    return F.coalesce(F.get_json_object(metadata, "$.tool"), F.when(first != "", first), F.lit("?"))


def _merged(old: str | None, new: str | None, union: tuple[str, ...] = ("tags", "entities")) -> str | None:
    def read(x: str | None) -> dict:
        try:
            v = json.loads(x) if x else {}
        except ValueError:
            v = {}
        return v if isinstance(v, dict) else {}

    a, b = read(old), read(new)
    if not a and not b:
        return None
    out = a | b
    for k in union:
        if isinstance(a.get(k), list) and isinstance(b.get(k), list):
            out[k] = a[k] + [x for x in b[k] if x not in a[k]]
    return json.dumps(out, sort_keys=True, ensure_ascii=False)


@F.pandas_udf(T.StringType())
def merge_metadata(old: pd.Series, new: pd.Series) -> pd.Series:
    """Keys of ``new`` over those of ``old``; tags and entities are united in order. Corrupt JSON counts as empty."""
    return pd.Series([_merged(a, b) for a, b in zip(old, new, strict=True)])


def _flat(value: object, path: str = "") -> dict[str, str]:
    if isinstance(value, dict):
        out: dict[str, str] = {}
        for k, v in value.items():
            out |= _flat(v, f"{path}.{k}" if path else str(k))
        return out
    return {path: value if isinstance(value, str) else json.dumps(value, separators=(",", ":"), ensure_ascii=False)}


@F.pandas_udf(T.MapType(T.StringType(), T.StringType()))
def flatten_json(c: pd.Series) -> pd.Series:
    """Dotted paths of a JSON object and their values as text; corrupt JSON gives no entries."""

    def one(x: str | None) -> dict[str, str]:
        try:
            v = json.loads(x) if x else {}
        except ValueError:
            return {}
        return _flat(v) if isinstance(v, dict) else {}

    return c.map(one)
