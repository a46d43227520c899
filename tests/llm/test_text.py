import json

import hypothesis.strategies as st
import numpy as np
import pytest
from hypothesis import given, settings
from pyspark.sql import functions as F

from tidemark.llm import garble
from tidemark.llm.boosting import BoostedTrees, best_threshold
from tidemark.llm.made import made_texts
from tidemark.llm.pii import PersonalModel, common_words, personal_spans, redacted
from tidemark.llm.spans import GIVEN, CommonWords, candidates, measures
from tidemark.llm.truncation import _limits as limits_of
from tidemark.llm.truncation import cut_report, cut_scores

COMMON = frozenset("write to about it the from and is in at by asked us wait approved reviewer meeting call if again lives according file row number build tag passed did not".split())
FILLER = ["The import of 90 sessions stopped at row 12 because the cache was cold", "We agreed on short functions for the reader", "Build time went from 10 to 12 in staging", "The old write path was removed last week"]
COMMON |= {w for f in FILLER for w in f.lower().split()}


@pytest.fixture(scope="module")
def model():
    return PersonalModel([f + "." for f in FILLER] * 20, COMMON, made=1000)


def values(model, text):
    return {(s.kind, text[s.start : s.end]) for s, _ in model.select([text])[0]}


def test_kinds(model):
    text = "Reply came from ana.brenmund@post.example about it. Call +44 7700 900123 if it fails. SSN 943-08-4839 was in the log. lives at 12 Pelham Road, Norwick according to the file. Approved by Nadia Brenwick in the meeting."
    assert values(model, text) == {("email", "ana.brenmund@post.example"), ("phone", "+44 7700 900123"), ("id_number", "943-08-4839"), ("address", "12 Pelham Road, Norwick"), ("name", "Nadia Brenwick")}


def test_decoys(model):
    for text in ("git remote add origin git@forge.x.example:a/b.git", "npm i batch-reader@3.1.20", "Build tag 718-39-3354 passed and 303-81-3470 did not.", "Part number 508.774.7539 matches checksum 90756398.", "Use user@reader as a placeholder only", "Port range 3079-1165 on 198.51.100.28 stays closed."):
        assert values(model, text) == set(), text


def test_held_out_accuracy(model):
    hit = wrong = missed = 0
    for text, truth, *_ in made_texts([], 60, seed=99):
        got = {(s.kind, s.start, s.end) for s, _ in model.select([text])[0]}
        hit, wrong, missed = hit + len(got & truth), wrong + len(got - truth), missed + len(truth - got)
    assert hit / (hit + wrong) > 0.85 and hit / (hit + missed) > 0.85


def test_spans_and_redaction(spark, model):
    kind = "id string, content string, kind string, text string"
    df = spark.createDataFrame([("1", "Call +44 7700 900123 if it fails.", "a", "b"), ("2", None, "a", "b"), ("3", "", "a", "b"), ("4", "  ", "a", "b"), (None, "Call +44 7700 900123.", "a", "b"), ("5", "no " * 30_000, "a", "b"), ("1", "Call +44 7700 900123 if it fails.", "a", "b")], kind)
    assert [(r.id, r.kind, r.value, r.start) for r in personal_spans(df, "id", "content", model).collect()] == [("1", "phone", "+44 7700 900123", 5)] * 2
    out = redacted(df, "content", model).collect()
    assert out[0].content == "Call [PHONE] if it fails." and out[1].content is None and out[3].content == "  " and out[0].kind == "a" and len(out) == 7
    assert personal_spans(df.limit(0), "id", "content").count() == 0


def test_measures_have_one_length_per_kind():
    seen = {}
    for text, *_ in made_texts(FILLER, 30):
        for s in candidates(text, COMMON):
            seen.setdefault(s.kind, set()).add(len(measures(text, s, COMMON)))
    assert all(len(n) == 1 for n in seen.values())


def test_trees_and_threshold():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    p = BoostedTrees().fit(x[:1500], y[:1500]).probability(x[1500:])
    assert ((p > 0.5) == y[1500:]).mean() > 0.95
    assert 0.15 <= best_threshold(p, y[1500:]) <= 0.5 and best_threshold(np.zeros(0), np.zeros(0)) == 0.5


def test_cut_texts(spark):
    rows = []
    for i in range(400):
        rows.append((f"p{i}", f"The reader number {i} stopped at row {i * 7} because the cache was cold. It was started again with a limit of {i % 50} rows.", "a", 1))
        rows.append((f"j{i}", json.dumps({"k": i, "list": [1, 2, i], "name": "the queue"}), "b", 1))
        rows.append((f"c{i}", f"git checkout {i} -- src/file{i}.py", "b", 1))
    full = "The writer was moved because the old one lost rows. Nobody saw that the worker restarted twice a day before."
    rows += [("x1", full[:80], "a", 1), ("x2", full[:95] + "...", "a", 1), ("x3", '{"k": 1, "list": [1, 2', "b", 1), ("x4", "Read it\n```\ndef f():\n    ret", "b", 1)]
    rows += [("n1", None, "a", 1), ("n2", "", "a", 1), ("n3", " \n", "a", 1), (None, "x", "a", 1), ("r", full, "a", 2), ("r", full[:70], "a", 1), ("q", full, None, 1)]
    df = spark.createDataFrame(rows, "id string, text string, source string, at int").withColumn("probability", F.lit("clash"))
    got = cut_scores(df, "id", "text", "source", "at")
    by = {r.id: r.probability for r in got.collect()}
    assert all(by[k] > 0.5 for k in ("x1", "x2", "x3", "x4")) and by["r"] < 0.5 and by["q"] < 0.5
    assert not {"n1", "n2", "n3", None} & by.keys() and len(by) == 1206
    wrong = sum(p > 0.5 for k, p in by.items() if k[0] in "pjc")
    assert wrong <= 12
    report = {r.source: r for r in cut_report(got).collect()}
    assert report["a"].n_cut >= 2 and report[None].n_rows == 1
    assert cut_scores(df.limit(0), "id", "text", "source").count() == 0


@settings(deadline=None)
@given(st.text(alphabet="aäöéß—…€Łжи日", min_size=1, max_size=12), st.integers(0, len(garble.chains()) - 1))
def test_chains_come_back(text, no):
    chain = garble.chains()[no]
    wrong = garble.garbled(text, chain)
    if wrong is not None and wrong != text and chain[-1][0] != "controls" and not chain[-1][1].endswith("?"):
        back = garble.regained(wrong, chain)
        assert back is None or garble.garbled(back, chain) == wrong


@settings(deadline=None, max_examples=60)
@given(st.text(alphabet="aäöéß—…€Łжи日", min_size=1, max_size=9))
def test_forms_are_those_of_the_chains(word):
    got = garble._forms(word)
    for g, no in got:
        assert garble.garbled(word, garble.chains()[no]) == g
    every = {g for c in garble.chains() if (g := garble.garbled(word, c)) and g != word and not g.isascii() and 2 * g.count(garble.LOST) <= len(g)}
    assert {g for g, _ in got} == every


def test_garbled_rows(spark):
    clean = "Größere Änderungen an der Prüfung künftig prüfen"
    rows = [(i, clean + f" {i}") for i in range(40)]
    rows += [(100, clean.encode().decode("cp1252")), (101, "ok\n" + "Prüfung künftig".encode().decode("latin-1") + "\nok"), (102, "shown as `GrÃ¶Ã\x9fere` on purpose"), (103, "NÃO alterar a MIGRAÇÃO"), (104, None), (105, ""), (106, " "), (107, "a lost � here"), (108, "a `�` is fine"), (109, "plain ascii"), (110, clean.encode("cp1252").decode("cp1251"))]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("line", F.lit(1)).withColumn("word", F.lit("clash"))
    assert {r.doc_id for r in garble.garbled_rows(df, "doc_id", "text").collect()} == {100, 101, 107, 110}
    fixed = {r.doc_id: r for r in garble.restored_texts(df, "doc_id", "text").collect()}
    assert fixed[100].restored == clean and fixed[101].restored == "ok\nPrüfung künftig\nok" and fixed[110].restored == clean and fixed[107].n_lost == 1
    assert garble.garbled_rows(df.limit(0), "doc_id", "text").count() == 0


def test_common_family_names():
    common = CommonWords(COMMON | {"tassmereux", "cold"})
    common.given = GIVEN | {"nadia"}  # as learned from a corpus that says it often
    model = PersonalModel([f + "." for f in FILLER] * 20, common, made=1000)
    for text, name in (("Approved by Nadia Tassmereux in the meeting.", "Nadia Tassmereux"), ("Reviewer: Thomas Cold (a1b2c3d4).", "Thomas Cold"), ("nadia tassmereux asked us to wait.", "nadia tassmereux")):
        assert ("name", name) in values(model, text), text


def test_copies_make_no_word_common(spark):
    texts = ["Approved by Mirela Tassmereux."] * 300 + [f"the cache number {i}" for i in range(300)]
    common = common_words(spark.createDataFrame([(t,) for t in texts], "text string"), 1000)
    assert "tassmereux" not in common and "tassmereux" in common.often and "cache" in common


def test_common_streets_have_addresses():
    spans = candidates("Office: Ashcombegasse 12, 70173 Dunwick", COMMON | {"office", "ashcombegasse"})
    assert any(s.kind == "address" and s.start == 8 for s in spans)


def test_garbled_hot_source(spark):
    russian = "проверка кэша завершена, очередь пуста"
    rows = [(i, f"{russian} {i}") for i in range(40)] + [(100 + i, f"{russian} {i}".encode("cp1251").decode("koi8-r")) for i in range(20)]
    once = "Łódź różnych"
    rows += [(200, once), (201, once.encode("iso8859-2").decode("cp1252"))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in garble.garbled_rows(df, "doc_id", "text").collect()} == {*range(100, 120), 201}
    assert {r.restored for r in garble.restored_texts(df, "doc_id", "text").where("doc_id > 100").collect()} == {f"{russian} {i}" for i in range(1, 20)} | {once}


def test_copies_of_a_cut_text_are_cut(spark):
    rows = [(f"p{i}", f"The reader number {i} stopped at row {i * 7} because the cache was cold. It was started again with a limit of {i % 50} rows.", "a") for i in range(600)]
    rows += [(f"c{i}", "The writer was moved because the old one lost rows. Nobody saw that the worker resta", "a") for i in range(300)]
    rows += [(f"m{i}", f"Rows of kind {i} and {i * 3} and so on...", "a") for i in range(40)]
    by = {r.id: r.probability for r in cut_scores(spark.createDataFrame(rows, "id string, text string, source string"), "id", "text", "source").collect()}
    assert all(p > 0.5 for k, p in by.items() if k[0] == "c") and sum(p > 0.5 for k, p in by.items() if k[0] != "c") <= 6


def test_limits_of_a_small_source(spark):
    rows = [("big", "x" * n) for n in range(40, 1040) for _ in range(50)] + [("small", "y" * 400)] * 12 + [("small", "y" * n) for n in range(500, 700)]
    assert limits_of(spark.createDataFrame(rows, "source string, text string"), 4000).near("small", "c", 400) == "at"
