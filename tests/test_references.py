from datetime import datetime

from pyspark.sql import functions as F

from tidemark.operators.references import Referrer, Target, orphan_references, orphan_report
from tidemark.operators.skew import heavy_keys, lookup_join

ROWS = "id string, ref string, created_at timestamp_ntz, exists string"
T = datetime(2024, 1, 10)


def found(spark, rows, records, deleted, share=1000):
    r = Referrer("t", spark.createDataFrame(rows, ROWS), ["ref"], "x")
    t = Target(spark.createDataFrame(records, "id string, created_at timestamp_ntz"), spark.createDataFrame(deleted, "key string"))
    return {tuple(x) for x in orphan_references([r], {"x": t}, share).collect()}


def test_states_spellings_and_repeats(spark):
    rows = [
        ("1", " A ", T, ""), ("1", " A ", T, ""), ("2", "gone", T, ""), ("3", "b", T, ""), ("4", "late", T, ""), ("5", None, T, ""), ("6", "  ", T, ""), ("7", "", T, ""), (None, "b", T, ""), (None, "b", T, ""), ("8", "B", None, ""),
    ]
    got = found(spark, rows, [("a", T), ("LATE", datetime(2024, 2, 1)), ("late", datetime(2024, 2, 1))], [("Gone",), ("a",), (None,)])
    assert got == {("t", "ref", "2", "gone", "deleted", "2024-01"), ("t", "ref", "3", "b", "missing", "2024-01"), ("t", "ref", "4", "late", "late", "2024-01"), ("t", "ref", None, "b", "missing", "2024-01"), ("t", "ref", "8", "b", "missing", None)}


def test_rows_without_id_each_count(spark):
    r = Referrer("t", spark.createDataFrame([(None, "b", T, "")] * 3, ROWS), ["ref"], "x")
    t = Target(spark.createDataFrame([], "id string, created_at timestamp_ntz"), spark.createDataFrame([], "key string"))
    assert orphan_references([r], {"x": t}).count() == 3


def test_heavy_and_light_keys_give_the_same(spark):
    rows = [(str(i), "hot" if i % 3 == 0 else f"k{i}", T, "") for i in range(90)]
    records = [(f"k{i}", T) for i in range(0, 90, 2)]
    assert found(spark, rows, records, [], share=5) == found(spark, rows, records, [], share=1)


def test_empty(spark):
    assert found(spark, [], [], []) == set()


def test_report(spark):
    r = Referrer("t", spark.createDataFrame([("1", "b", T, ""), ("2", "b", T, "")], ROWS), ["ref"], "x")
    t = Target(spark.createDataFrame([], "id string, created_at timestamp_ntz"), spark.createDataFrame([], "key string"))
    assert [(x.n_refs, x.n_keys) for x in orphan_report(orphan_references([r], {"x": t})).collect()] == [(2, 1)]


def test_lookup_join_keeps_null_keys(spark):
    rows = spark.createDataFrame([("a", 1), (None, 2), ("b", 3)], "k string, n int")
    out = lookup_join(rows, spark.createDataFrame([("a", 9)], "k string, v int"), "k", spark.createDataFrame([("a",)], "k string"))
    assert {(r.n, r.v) for r in out.collect()} == {(1, 9), (2, None), (3, None)}


def test_heavy_keys_bounded(spark):
    counts = spark.range(100).select(F.col("id").cast("string").alias("k"), F.lit(1).alias("n"))
    assert heavy_keys(counts, "k", "n", 10).count() == 0
    assert heavy_keys(counts.limit(5), "k", "n", 10).count() == 5
