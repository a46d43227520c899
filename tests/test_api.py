import json
import struct
from datetime import datetime

from pyspark.sql import functions as F

from tidemark import schema
from tidemark.api import Engine
from tidemark.config import DEFAULTS, interpolate, load
from tidemark.functions.scoring import vector_of_bytes
from tidemark.operators import enrich, evaluate, retrieval

NOW = datetime(2024, 3, 1)


def engine(spark):
    t = lambda kind: spark.createDataFrame([], kind)
    return Engine(t(schema.MEMORIES), t(schema.VECTORS), t(schema.EDGES), t(schema.JOBS), t(schema.LINEAGE))


def test_round_trip(spark):
    events = spark.createDataFrame([("user_message", "c", "p", "the cache needs a lock", None, None, NOW), ("user_message", "c", "p", "unrelated words", None, None, NOW)], schema.EVENTS)
    e = engine(spark).remember(events)
    assert e.memories.count() == 2 and e.remember(events).memories.count() == 2
    hit = e.recall("lock?", NOW, 5).collect()
    assert [r.content for r in hit] == ["the cache needs a lock"]
    ids = spark.createDataFrame([(hit[0].id,)], "id string")
    changed = e.update_memory(ids.withColumn("importance", F.lit(5.0)).withColumn("metadata", F.lit('{"tags": ["new"]}')))
    row = changed.memories.where(F.col("id") == hit[0].id).first()
    assert row.importance == 1.0 and json.loads(row.metadata)["tags"] == ["c", "new"]
    assert "lock" in e.project_context(NOW).first().context and e.list_memories(1).first().total == 2
    assert e.forget(ids).memories.count() == 1 and e.memory_detail(hit[0].id)["row"].count() == 1


def test_migration(spark):
    old = spark.createDataFrame([("1", "x")], "id string, content string")
    new = schema.migrate(old, 1).first()
    assert new.tier == "hot" and new.strength == 1.0 and new.is_decoy is False and new.compressed_content is None


def test_config(tmp_path):
    (tmp_path / "c.toml").write_text('session_gap_s = 60\nunknown = 1\n[privacy]\nredaction_tags = ["{ env.TAG }"]\n')
    c = load(str(tmp_path / "c.toml"), {"TAG": "hidden"})
    assert c.session_gap_s == 60 and c.privacy.redaction_tags == ("hidden",) and c.edges == DEFAULTS.edges
    assert interpolate({"a": ["x{ env.NO }y"]}, {}) == {"a": ["xy"]}


def test_evaluation(spark, tmp_path):
    turn = lambda text, has=None: {"role": "user", "content": text, "has_answer": has}
    data = [
        {"question_id": "q1", "question": "where is the blue key", "haystack_session_ids": ["s1", "s2", "s3"], "haystack_sessions": [[turn("red door")], [turn("the blue key is here")], [turn("the weather")]], "answer_session_ids": ["s2"]},
        {"question_id": "q2", "question": "lost", "haystack_session_ids": ["s1"], "haystack_sessions": [[turn("x")]], "answer_session_ids": ["s9"]},
        {"question_id": "q3", "question": "no gold", "haystack_session_ids": ["s1"], "haystack_sessions": [[turn("x")]], "answer_session_ids": []},
    ]
    (tmp_path / "d.json").write_text(json.dumps(data))
    i = evaluate.read_instances(spark, str(tmp_path / "d.json"))
    rows = evaluate.turns(i)
    m = retrieval.metrics(evaluate.ranked_turns(i, rows), evaluate.gold(i, rows)).first()
    assert (m.n_questions, m.recall_at_1, m.mrr) == (2, 0.5, 0.5)


def test_replies(spark):
    m = spark.createDataFrame([("1", "a long text. more", 0.2, '{"tags": ["a"]}', None), ("2", "b", 0.3, None, None)], "id string, content string, importance double, metadata string, compressed_content string")
    r = lambda rows: spark.createDataFrame(rows, "id string, reply string")
    got = {x.id: x for x in enrich.with_entities(m, r([("1", '["rust", "sqlite"]'), ("2", "nonsense")])).collect()}
    assert json.loads(got["1"].metadata) == {"tags": ["a", "rust", "sqlite"], "entities": ["rust", "sqlite"]} and got["2"].metadata is None
    assert {x.importance for x in enrich.with_importance(m, r([("1", "0.85"), ("2", "high")])).collect()} == {0.85, 0.3}
    assert [x.compressed_content for x in enrich.with_rewrites(m, r([("1", "short"), ("2", "much longer")])).orderBy("id").collect()] == ["short", None]
    assert json.loads(enrich.with_summaries(m, enrich.ask(m.limit(1), "content", enrich.first_sentence)).where("id = '1'").first().metadata)["summary"] == "a long text."
    rows, lineage = enrich.facts(r([("b", '[{"fact": "x is y", "sources": [1, 2], "confidence": 0.9}]')]), spark.createDataFrame([("b", 1, "m1"), ("b", 2, "m2")], "id string, position int, child_id string"))
    assert rows.first().importance == 0.9 and {x.child_id for x in lineage.collect()} == {"m1", "m2"}


def test_vector_bytes(spark):
    df = spark.createDataFrame([(struct.pack("<2f", 1.0, -2.5),), (b"abc",), (None,)], "b binary")
    assert [r[0] for r in df.select(vector_of_bytes("b")).collect()] == [[1.0, -2.5], None, None]
