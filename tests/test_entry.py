import duckdb
import pytest

import __spark_entry__ as e
from tidemark import plans

CORE = plans.queries()


@pytest.fixture(scope="module")
def con(folder):
    c = duckdb.connect()
    from verify import TABLES

    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_query_equals_sql(spark, folder, con, name):
    from verify import rows_of

    df = CORE[name](spark, folder)
    cur = con.execute(plans.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(cols)
    assert rows_of([tuple(r) for r in df.collect()], df.columns) == rows_of(cur.fetchall(), cols)


def test_flagship(spark):
    assert e.entry(spark).count() == 20


def test_every_sql_has_a_query():
    assert set(e.oracle_sql()) <= set(e.queries())


def test_no_cartesian_product(spark, folder):
    for name in ("edge_temporal", "recall_rrf", "timeline_stats", "p2_found", "p7_found"):
        plan = CORE[name](spark, folder)._jdf.queryExecution().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_stateful_retries(spark, tmp_path):
    from datetime import datetime, timedelta

    from tidemark.streaming import pipelines

    t = datetime(2024, 1, 1)
    spark.createDataFrame([("j", False, t), ("j", False, t + timedelta(seconds=30)), ("k", True, t)], "id string, ok boolean, at timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id string, ok boolean, at timestamp").parquet(str(tmp_path / "in"))
    got = pipelines.to_memory_sink(pipelines.retries(stream), "retries").collect()
    assert {(r.id, r.attempts, r.status) for r in got} == {("j", 1, "pending"), ("j", 2, "pending"), ("k", 0, "done")}


@pytest.mark.parametrize("name", ["strength_decay", "cold_candidates", "stats_breakdown", "jobs_due", "job_activity", "sessions_gap", "sessions_keyed", "consolidation_candidates"])
def test_scans_read_no_text(spark, folder, name):
    plan = CORE[name](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema" in plan
    for column in ("content:", "compressed_content:", "cold_path:", "last_error:"):
        assert column not in plan, (name, column)


def test_keyword_search_reads_the_postings_of_its_terms(spark, folder):
    plan = CORE["bm25_topk"](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "postings" in plan and "text" not in plan.split("ReadSchema")[1][:120]
    assert "In(term, [" in plan and "bucket" in plan.split("PartitionFilters")[1][:200]
