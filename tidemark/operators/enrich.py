"""What replies of a language model change. Replies come as DataFrames: who makes them is the caller's affair."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.metadata import merge_metadata
from tidemark.functions.scoring import clamp01

LEAST_BYTES = 280


def ask(rows: DataFrame, text_col: str, reply: Callable[[list[str]], list[str | None]]) -> DataFrame:
    """``id, reply``: the callable gets batches of texts; without a model a deterministic stand-in does."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"id": f["id"], "reply": reply(f["text"].fillna("").tolist())})

    return rows.select(F.col("id").cast("string").alias("id"), F.col(text_col).alias("text")).mapInPandas(run, "id string, reply string")


def worth_a_summary(memories: DataFrame) -> DataFrame:
    return memories.where(F.octet_length("content") >= LEAST_BYTES)


def with_summaries(memories: DataFrame, replies: DataFrame) -> DataFrame:
    """The reply as ``summary`` in the metadata; rows without one stay."""
    r = replies.where(F.trim("reply") != "").select("id", F.to_json(F.struct(F.trim("reply").alias("summary"))).alias("__new"))
    return _merged(memories, r)


def with_entities(memories: DataFrame, replies: DataFrame) -> DataFrame:
    """Entities (a JSON array) in the metadata and among the tags; what is no array changes nothing."""
    e = F.from_json("reply", "array<string>")
    r = replies.select("id", e.alias("e")).where(F.size("e") > 0).select("id", F.to_json(F.struct(F.col("e").alias("tags"), F.col("e").alias("entities"))).alias("__new"))
    return _merged(memories, r)


def with_importance(memories: DataFrame, replies: DataFrame) -> DataFrame:
    """The reply's number, between 0 and 1; what is no number changes nothing."""
    r = replies.select("id", F.try_to_number("reply", F.lit("9.9999")).cast("double").alias("__new"))
    return memories.join(r, "id", "left").withColumn("importance", F.coalesce(clamp01(F.col("__new")), F.col("importance"))).drop("__new")


def with_rewrites(memories: DataFrame, replies: DataFrame) -> DataFrame:
    """A shorter rewrite as ``compressed_content``; the content stays what searches read."""
    r = replies.select("id", F.trim("reply").alias("__new"))
    better = (F.col("__new") != "") & (F.octet_length("__new") < F.octet_length("content"))
    return memories.join(r, "id", "left").withColumn("compressed_content", F.when(better, F.col("__new")).otherwise(F.col("compressed_content"))).drop("__new")


def facts(replies: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Semantic rows and their lineage from replies ``[{fact, sources, confidence}]``; ``sources(id, position, child_id)``
    are the rows that were shown, numbered from 1."""
    kind = "array<struct<fact:string,sources:array<int>,confidence:double>>"
    f = replies.select("id", F.posexplode(F.from_json("reply", kind)).alias("k", "f")).where(F.trim("f.fact") != "")
    f = f.select(F.sha2(F.concat_ws(":", "id", F.col("k").cast("string"), "f.fact"), 256).alias("decoy_id"), "id", F.trim("f.fact").alias("content"), clamp01(F.coalesce("f.confidence", F.lit(0.5))).alias("importance"), F.col("f.sources").alias("s"))
    rows = f.select(F.col("decoy_id").alias("id"), "content", F.lit("semantic").alias("memory_type"), "importance")
    lineage = f.select("decoy_id", "id", F.explode("s").alias("position")).join(sources, ["id", "position"]).select("decoy_id", "child_id").distinct()
    return rows, lineage


def _merged(memories: DataFrame, fresh: DataFrame) -> DataFrame:
    joined = memories.join(fresh, "id", "left")
    return joined.withColumn("metadata", F.when(F.col("__new").isNull(), F.col("metadata")).otherwise(merge_metadata("metadata", "__new"))).drop("__new")


def first_sentence(texts: list[str]) -> list[str | None]:
    """The stand-in for summaries: a text's first sentence."""
    return [(t.split(". ")[0].strip() + ".")[:LEAST_BYTES] if t.strip() else None for t in texts]


def no_entities(texts: list[str]) -> list[str | None]:
    """The stand-in for entities: capitalised words."""
    return [json.dumps(sorted({w for w in t.split() if w[:1].isupper() and w.isalpha()})[:5]) for t in texts]
