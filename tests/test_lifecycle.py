from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidemark.operators import context, jobs, lifecycle, retrieval
from tidemark.sources import store
from tidemark.sources.ingest import dispositions, memory_rows

NOW = datetime(2024, 3, 1)


def test_clusters_and_consolidation(spark):
    vec = spark.createDataFrame([("a", [1.0, 0.0, 0.0]), ("b", [0.9, 0.1, 0.0]), ("c", [0.0, 0.0, 1.0])], "memory_id string, embedding array<double>")
    assert {r.id for r in lifecycle.clusters(vec, "memory_id", "embedding", 3, 0.7).collect()} == {"a", "b"}
    m = spark.createDataFrame([("a", "first", 0.2, 0.1, "p"), ("b", "x" * 400, 0.9, 0.9, "p"), ("c", "z", 0.1, 0.1, None)], "id string, content string, importance double, strength double, project_id string")
    rows, lineage, tiers = lifecycle.consolidate(m, vec, 3)
    got = rows.first()
    assert got.n_children == 2 and got.importance == 0.9 and got.content.endswith("...") and len(got.content) == 280 and 0.99 < got.cohesion < 1
    assert {(r.id, r.tier) for r in tiers.collect()} == {("a", "cold"), ("b", "warm")}
    assert lifecycle.consolidate(m, vec, 3, children=lineage)[0].count() == 0


def test_sequences(spark):
    rows = [("p", i, t) for i, t in enumerate(["edit", "test", "commit"] * 2)]
    got = lifecycle.frequent_sequences(spark.createDataFrame(rows, "p string, n int, tool string"), "p", ["n"], "tool").first()
    assert got.gram == "edit > test > commit" and got.n_times == 2


def test_jobs(spark):
    kind = "id string, job_type string, memory_id string, status string, attempts long, last_error string, created_at timestamp, updated_at timestamp"
    j = spark.createDataFrame([("1", "t", "m", "pending", 1, None, NOW, NOW), ("2", "t", "m", "pending", 2, None, NOW, NOW), ("3", "t", "m", "done", 0, None, NOW, NOW)], kind)
    assert jobs.due(j, NOW).count() == 0 and jobs.due(j, NOW + timedelta(seconds=21)).count() == 1
    after = jobs.after_pass(j, spark.createDataFrame([("1", True, None), ("2", False, "x")], "id string, ok boolean, error string"), NOW)
    assert {(r.id, r.status, r.attempts) for r in after.collect()} == {("1", "done", 1), ("2", "failed", 3), ("3", "done", 0)}


def test_budget_keeps_the_first(spark):
    kind = "id string, project_id string, importance double, access_count long, strength double, content string, compressed_content string, created_at timestamp"
    m = spark.createDataFrame([("lo", "p", 0.1, 0, 1.0, "y" * 30, None, NOW), ("hi", "p", 0.9, 0, 1.0, "x" * 90, "short", NOW)], kind)
    assert context.project_context(m, NOW).first().context == "short\n" + "y" * 30
    big = context.project_context(m.withColumn("compressed_content", F.lit(None).cast("string")), NOW, tokens=10).first()
    assert big.n_memories == 1 and big.context == "x" * 40


def test_ingest(spark):
    kind = "event string, client string, project_path string, content string, tool string, metadata string, timestamp timestamp"
    e = spark.createDataFrame(
        [("tool_use", "c", None, "ls", "grep", '{"session_id": "s"}', NOW), ("nope", "c", None, "x", None, None, NOW), ("terminal", "c", None, " ", None, None, NOW), ("terminal", "c", None, "cat .env", None, None, NOW), ("terminal", "c", None, "<private>x</private>", None, None, NOW)], kind
    )
    assert [r.disposition for r in dispositions(e).collect()] == ["accepted", "unknown_event", "empty", "excluded_path", "redacted_empty"]
    row = memory_rows(e).first()
    assert row.memory_type == "code_context" and '"session_id":"s"' in row.metadata and '"tags":["c","grep"]' in row.metadata and row.importance == 0.3


def test_fusion_and_filters(spark):
    lists = lambda ids: spark.createDataFrame([(x, i) for i, x in enumerate(ids)], "id string, rank0 int")
    graph = spark.createDataFrame([("e", 0, 1)], "id string, rank0 int, hop int")
    got = {r.id: r.rrf for r in retrieval.fuse(lists("abc"), lists("bcd"), graph).collect()}
    assert got["b"] > got["a"] and got["b"] > got["d"] and got["e"] > 0
    assert abs(got["a"] - 0.6 / 61) < 1e-12 and abs(got["e"] - 0.3 * 0.5 / 64) < 1e-12


def test_bm25_edge_cases(spark):
    d = spark.createDataFrame([("1", "red fox"), ("2", None), ("3", ""), ("4", "fox fox fox")], "id string, text string")
    assert [r.id for r in retrieval.bm25(retrieval.keyword_index(d, "id", "text"), ["fox"], 5).collect()] == ["4", "1"]
    assert retrieval.bm25(retrieval.keyword_index(d, "id", "text"), [], 5).count() == 0 and retrieval.bm25(retrieval.keyword_index(d.limit(0), "id", "text"), ["fox"], 5).count() == 0


def test_metrics(spark):
    ranked = spark.createDataFrame([("q1", "s1", 1), ("q1", "s2", 2)], "question_id string, id string, rank int")
    gold = spark.createDataFrame([("q1", "s2"), ("q2", None)], "question_id string, id string")
    m = retrieval.metrics(ranked, gold).first()
    assert (m.n_questions, m.recall_at_1, m.recall_at_5, m.mrr) == (2, 0.0, 0.5, 0.25)


def test_store(spark):
    s = spark.createDataFrame([("a", 1), ("b", 1)], "id string, n int")
    f = spark.createDataFrame([("b", 2), ("c", 2)], "id string, n int")
    rows = lambda df: {tuple(r) for r in df.collect()}
    assert rows(store.insert_or_ignore(s, f, ["id"])) == {("a", 1), ("b", 1), ("c", 2)}
    assert rows(store.upsert(s, f, ["id"])) == rows(store.insert_or_replace(s, f, ["id"], "n")) == {("a", 1), ("b", 2), ("c", 2)}


def test_cold_round_trip(spark, tmp_path):
    m = spark.createDataFrame([("a", "text", "p"), ("b", "more", "q")], "id string, content string, project_id string")
    store.write_cold(m, str(tmp_path / "cold"))
    assert [r.content for r in store.read_cold(spark, str(tmp_path / "cold"), spark.createDataFrame([("b",)], "id string")).collect()] == ["more"]
