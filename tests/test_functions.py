import math

import hypothesis.strategies as st
from hypothesis import given
from pyspark.sql import functions as F

from tidemark.functions import metadata as md
from tidemark.functions import scoring
from tidemark.functions.text import compress_text, ellipsis, expand_text, git_remote, glob_regex, names_excluded_path, redact, tokens


@given(st.one_of(st.text(), st.lists(st.sampled_from(["the", "The", "THE", "and", "memory,", "`the`", "```", "\n", " ", "a/the", "(Because)", "\ue000", "\ue0f0", "\ue0ff"])).map(" ".join)))
def test_compression_comes_back(text):
    assert expand_text(compress_text(text)) == text


def test_compression_saves_and_protects():
    text = "This function and the configuration\n```\nthe and\n```\n`the` path/the the_x"
    packed = compress_text(text)
    assert len(packed) < len(text) and "```\nthe and\n```" in packed and "`the`" in packed and "path/the" in packed
    assert expand_text(packed) == text
    assert compress_text("THE") == "THE" and compress_text(None) is None and compress_text("") == ""


def one(spark, expr, value="x", kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(expr).first()[0]


def test_redact(spark):
    r = redact(F.col("c"), ("private", "secret"))
    assert one(spark, r, 'a <private x="1">b\nc</PRIVATE> d') == "a  d"
    assert one(spark, r, "a <private>b") == "a <private>b"
    assert one(spark, r, "<privateer>x</privateer>") == "<privateer>x</privateer>"
    assert one(spark, r, None) is None


def test_excluded_paths(spark):
    e = names_excluded_path(F.col("c"), ("**/.env", "**/*.pem", "**/secrets/**"))
    for text, hit in ((".env", True), ("see (server.pem), ok", True), ("secrets/db.key", True), ("src/main.rs", False), ("", False), (None, False)):
        assert one(spark, e, text) is hit, text
    assert glob_regex("**/x").startswith("^(?:")


def test_git_remotes(spark):
    for url, want in (
        ("https://GitForge.example/a/b.git", "gitforge.example/a/b"), ("git@host.example:a/b.git", "host.example/a/b"), ("ssh://git@host.example:22/a/b/", "host.example/a/b"), ("http://u:p@h.example/a", "h.example/a"), ("nonsense", None), ("", None),
    ):
        assert one(spark, git_remote(F.col("c")), url) == want, url


def test_scores(spark):
    v = "a array<double>, b array<double>"
    c = lambda a, b: spark.createDataFrame([(a, b)], v).select(scoring.cosine(F.col("a"), F.col("b"))).first()[0]
    assert c([1.0, 0.0], [1.0, 0.0]) == 1 and c([1.0, 0.0], [0.0, 1.0]) == 0 and c([1.0], [1.0, 2.0]) == 0 and c([0.0], [0.0]) == 0
    assert abs(one(spark, scoring.rrf_term(1.0, F.lit(0))) - 1 / 61) < 1e-12
    assert one(spark, scoring.recency(F.lit(0.0))) == 1 and one(spark, scoring.recency(F.lit(60.0))) == 0
    assert abs(one(spark, scoring.final_score(F.lit(0.1), F.lit(0.8), F.lit(1.0), F.lit(1.0))) - 0.113) < 1e-9
    assert one(spark, scoring.backoff_seconds(F.lit(9))) == 640 and one(spark, scoring.reinforced(F.lit(0.5))) == 0.75
    assert abs(one(spark, scoring.context_score(F.lit(0.9), F.lit(-5.0), F.lit(0), F.lit(1.0))) - 1.0) < 1e-12
    assert math.isclose(one(spark, scoring.strength_factor(F.lit(0.3))), 0.37)


def test_metadata(spark):
    m = '{"tags": ["a", "b"], "extra": {"session_id": "s"}, "tool": "grep"}'
    assert one(spark, md.tags(F.col("c")), m) == ["a", "b"] and one(spark, md.tags(F.col("c")), "{broken") == []
    assert one(spark, md.session_key(F.col("c")), m) == "s" and one(spark, md.tool_name(F.col("c"), F.lit("x y")), None) == "x"
    assert one(spark, md.merge_metadata(F.col("c"), F.lit('{"tags": ["b", "c"], "k": 1}')), m) == '{"extra": {"session_id": "s"}, "k": 1, "tags": ["a", "b", "c"], "tool": "grep"}'
    assert one(spark, md.flatten_json(F.col("c")), m)["extra.session_id"] == "s"


def test_text(spark):
    assert one(spark, tokens(F.col("c")), "Ab-c, Élan 9!") == ["ab", "c", "élan", "9"] and one(spark, tokens(F.col("c")), None) == []
    assert one(spark, ellipsis(F.col("c"), 5), "abcdefgh") == "ab..." and one(spark, ellipsis(F.col("c"), 8), "abcdefgh") == "abcdefgh"


def test_stems(spark):
    from tidemark.functions.porter import stem
    from tidemark.operators import retrieval

    want = "caresses caress|ponies poni|ties ti|cats cat|feed feed|agreed agre|plastered plaster|bled bled|motoring motor|sing sing|conflated conflat|troubled troubl|sized size|hopping hop|tanned tan|falling fall|hissing hiss|fizzed fizz|failing fail|filing file|happy happi|sky sky|relational relat|conditional condit|rational ration|valenci valenc|digitizer digit|operator oper|feudalism feudal|decisiveness decis|hopefulness hope|formaliti formal|triplicate triplic|formative form|formalize formal|electrical electr|goodness good|revival reviv|allowance allow|inference infer|airliner airlin|adjustable adjust|defensible defens|irritant irrit|replacement replac|adjustment adjust|dependent depend|adoption adopt|communism commun|activate activ|effective effect|bowdlerize bowdler|probate probat|rate rate|cease ceas|controll control|roll roll|größe größe|42 42|as as"
    assert {w: stem(w) for w, _ in (p.split() for p in want.split("|"))} == dict(p.split() for p in want.split("|"))
    d = spark.createDataFrame([("1", "the queues were connected"), ("2", "connecting a queue"), ("3", "nothing here")], "id string, text string")
    index = retrieval.keyword_index(d, "id", "text", stemmed=True)
    assert {r.id for r in retrieval.bm25(index, ["connection", "queueing"]).collect()} == {"1", "2"}
    assert retrieval.bm25(retrieval.keyword_index(d, "id", "text"), ["connection"]).count() == 0
