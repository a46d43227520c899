import itertools
import math
import random

import hypothesis.strategies as st
import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from pyspark.sql import functions as F

from tidemark.llm.groups import linked_groups
from tidemark.llm.neardup import member_pairs, similar_texts, text_classes
from tidemark.llm.packing import RoomTree, fill_containers, fill_report, first_fit_decreasing
from tidemark.llm.tokens import TOKENIZERS, BytePairs, encode_corpus, read_ranks
from tidemark.llm.vectors import borders, hilbert_keys, nearest, neighbour_pairs


def components(pairs):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            x, y = sorted((find(a), find(b)))
            up[y] = x
    groups = {}
    for k in up:
        groups.setdefault(find(k), []).append(k)
    return {(min(g), k) for g in groups.values() for k in g}


@pytest.mark.parametrize("bound", [1_000_000, 12, 3])
def test_groups_at_every_bound(spark, bound):
    rng = random.Random(bound)
    pairs = [(f"k{rng.randrange(90):02}", f"k{rng.randrange(90):02}") for _ in range(70)] + [(f"c{i:03}", f"c{i + 1:03}") for i in range(40)] + [("hub", f"h{i:02}") for i in range(40)]
    pairs += [(None, "x"), ("x", None), ("s", "s"), *pairs[:10], *[(b, a) for a, b in pairs[:10]]]
    df = spark.createDataFrame(pairs, "a string, b string").withColumn("child", F.lit("clash"))
    got = [tuple(r) for r in linked_groups(df, "a", "b", bound).collect()]
    assert set(got) == components(pairs) and len(got) == len(set(got))


def test_no_groups(spark):
    assert linked_groups(spark.createDataFrame([], "a string, b string"), "a", "b").count() == 0


def shingles(text, k=3):
    import regex

    w = regex.findall(r"[\p{L}\p{N}]+", text.lower())
    return len(w), {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(60):
        base = [rng.choice(words) for _ in range(rng.randrange(8, 40))]
        rows.append((f"a{i:03}", " ".join(base), f"p{i % 2}", 1))
        for j in range(rng.randrange(3)):
            edited = list(base)
            for _ in range(rng.randrange(1, 4)):
                edited[rng.randrange(len(edited))] = rng.choice(words)
            rows.append((f"b{i:03}{j}", " ".join(edited), f"p{i % 2}", 1))
    rows += [("c1", rows[0][1], "p0", 1), ("c2", rows[0][1], "p0", 1), ("c3", rows[0][1], "p1", 1), ("n1", None, "p0", 1), ("n2", "", "p0", 1), ("n3", rows[0][1], None, 1), (None, rows[0][1], "p0", 1), ("old", "other words", "p0", 1), ("old", rows[0][1], "p0", 2)]
    long = " ".join(f"x{i}" for i in range(20_000))
    rows += [("l1", long, "p0", 1), ("l2", long + " y", "p0", 1)]
    df = spark.createDataFrame(rows, "id string, text string, block string, at int").withColumn("no", F.lit("clash"))
    latest = {}
    for i, t, b, at in rows:
        if i is not None and t is not None and b is not None:
            latest[i] = max(latest.get(i, (0, "", "")), (at, t, b))
    want = set()
    for (x, (_, s, p)), (y, (_, t, q)) in itertools.combinations(sorted(latest.items()), 2):
        (n, a), (m, b) = shingles(s), shingles(t)
        if p == q and min(n, m) >= 6 and a and b and len(a & b) / len(a | b) >= 0.5:
            want.add((x, y))
    for bits, list_part in ((21, 16_384), (2, 16_384), (2, 7), (21, 1)):  # a sketch that tells nothing apart loses nothing, nor do split lists
        texts, members = text_classes(df, "id", "text", "block", "at")
        got = [tuple(r) for r in member_pairs(similar_texts(texts, 3, 0.5, 6, sketch_bits=bits, list_part=list_part), members, texts, 6).collect()]
        assert set(got) == want and len(got) == len(want)


def test_links_and_expansion_of_large_classes(spark, monkeypatch):
    from tidemark.llm import neardup

    monkeypatch.setattr(neardup, "EXPANDED", 3)
    members = spark.createDataFrame([(f"x{i}", 1) for i in range(10)] + [(f"y{i}", 2) for i in range(4)] + [("z", 3)], "id string, no long")
    texts = spark.createDataFrame([(n, "p", "some words here", n < 3) for n in (1, 2, 3)], "no long, block string, text string, several boolean")
    pairs = spark.createDataFrame([(1, 2, 0.9), (3, 1, 0.8)], "a_no long, b_no long, similarity double")
    got = [tuple(r) for r in member_pairs(pairs, members, texts).collect()]
    ids = {1: [f"x{i}" for i in range(10)], 2: [f"y{i}" for i in range(4)], 3: ["z"]}
    want = {tuple(sorted(p)) for n in ids for p in itertools.combinations(ids[n], 2)} | {tuple(sorted((x, y))) for a, b in ((1, 2), (3, 1)) for x in ids[a] for y in ids[b]}
    assert set(got) == want and len(got) == len(want)
    links = {r.id: (r.n_copies, r.n_links) for r in neardup.text_links(pairs, members).collect()}
    assert links["x3"] == (9, 2) and links["y0"] == (3, 1) and links["z"] == (0, 1)


def test_near_duplicates_of_nothing(spark):
    texts, members = text_classes(spark.createDataFrame([], "id string, text string, block string"), "id", "text", "block")
    assert member_pairs(similar_texts(texts, 5, 0.8), members, texts).count() == 0


def test_hilbert_neighbours_touch():
    for dims, bits in ((2, 4), (3, 3)):
        grid = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
        order = np.lexsort(hilbert_keys(grid, bits).T[::-1])
        assert (np.abs(np.diff(grid[order], axis=0)).sum(axis=1) == 1).all()


def test_vectors_recall_and_ties(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 16))
    v = {f"v{i:04}": (centres[i % 40] + 0.2 * rng.normal(size=16)) * rng.uniform(0.5, 3) for i in range(1500)}
    rows = [(k, [float(np.float32(x)) for x in a]) for k, a in v.items()]
    bad = [("n1", None), ("n2", [1.0] * 15), ("n3", [0.0] * 16), ("n4", [float("nan")] * 16), ("n5", [float("inf")] + [1.0] * 15), (None, [1.0] * 16)]
    same = [(f"e{i}", [1.0, 2.0] * 8) for i in range(9)]
    df = spark.createDataFrame(rows + bad + same + rows[:20], "id string, v array<float>").withColumn("no", F.lit(1)).withColumn("score", F.lit("clash"))
    got = nearest(df, "id", "v", 16, k=5)
    pairs = {}
    for r in got.collect():
        pairs.setdefault(r.a_id, []).append((-r.score, r.b_id))
    assert set(pairs) == {k for k, _ in rows + same} and all(len(p) == 5 for p in pairs.values())
    m = np.array([a for _, a in rows + same], dtype=np.float64)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    ids = [k for k, _ in rows + same]
    score = m @ m.T
    np.fill_diagonal(score, -9)
    hit = 0
    for i, k in enumerate(ids):
        best = {ids[j] for j in np.argsort(-np.round(score[i], 9), kind="stable")[:5]}
        hit += len(best & {b for _, b in pairs[k]})
    assert hit / (5 * len(ids)) > 0.95
    assert {b for _, b in pairs["e8"]} == {"e0", "e1", "e2", "e3", "e4"} and {b for _, b in pairs["e0"]} == {"e1", "e2", "e3", "e4", "e5"}
    assert all(r.a_id < r.b_id for r in neighbour_pairs(got).collect())
    assert nearest(df.limit(0), "id", "v", 16).count() == 0 and nearest(df.where("id = 'v0001'").limit(1), "id", "v", 16).count() == 0


@pytest.fixture(scope="module")
def bpe():
    return BytePairs(read_ranks(f"{TOKENIZERS}/byte_bpe_50k.tiktoken"))


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return t


@settings(max_examples=300, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.one_of(st.text(), st.text(alphabet="abcdeéñ 'sthe\n\t0129_-.", max_size=60)))
def test_tokens_equal_the_library(bpe, reference, text):
    assert bpe.encode([text])[0] == reference.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(0, 50_255), st.integers(0, 50_255))
def test_compatible_pairs(bpe, a, b):
    whole = bpe.exact(bpe.tokens[a] + bpe.tokens[b])
    alone = bpe.exact(bpe.tokens[a]) == [a] and bpe.exact(bpe.tokens[b]) == [b]
    if alone:
        assert bool(bpe.compatible(np.array([a]), np.array([b]))[0]) == (whole == [a, b])


@settings(max_examples=40, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(0, 10**6), st.integers(1, 4000), st.sampled_from(["ab", "abcdefghijklmnopqrstuvwxyz", "ACGT", "éßжи日", "the"]))
def test_long_words_equal_the_library(bpe, reference, seed, n, letters):
    rng = random.Random(seed)
    text = "".join(rng.choice(letters) for _ in range(n))
    want = reference.encode(text, add_special_tokens=False).ids
    assert bpe.encode([text])[0] == want and bpe.exact(text.encode()) == want


def test_a_million_letters_without_a_space(bpe, reference):
    import time

    rng = random.Random(1)
    text = "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGH") for _ in range(1_000_000))
    start = time.time()
    got = bpe.encode([text])[0]
    assert time.time() - start < 30
    assert got == reference.encode(text, add_special_tokens=False).ids and text not in bpe.words


def test_corpus(spark, bpe, reference):
    rows = [(1, "Hello world"), (2, None), (3, ""), (4, "  \n"), (5, "<|endoftext|>"), (6, "x" * 100_000), (1, "again"), (None, "no id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("clash"))
    got = encode_corpus(df, "doc_id", "text").collect()
    assert len(got) == 8 and [r.ids for r in got][1] == [] and [r.ids for r in got][2] == []
    for r, (_, t) in zip(got, rows, strict=True):
        assert r.ids == (reference.encode(t, add_special_tokens=False).ids if t else [])
        assert b"".join(bpe.tokens[i] for i in r.ids) == (t or "").encode()
    assert encode_corpus(df.limit(0), "doc_id", "text").count() == 0


@given(st.lists(st.integers(1, 30), min_size=1, max_size=80))
def test_first_fit_decreasing(sizes):
    got = first_fit_decreasing(np.array(sizes), 30)
    room, want = [], [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        k = next((k for k, r in enumerate(room) if r >= sizes[i]), len(room))
        if k == len(room):
            room.append(30)
        room[k] -= sizes[i]
        want[i] = k
    assert got.tolist() == want
    assert RoomTree(30, 1).place(30) == 0


def test_containers(spark):
    rng = random.Random(1)
    rows = [(i, rng.randrange(1, 900)) for i in range(500)] + [(1000, 2048), (1001, 5000), (1002, 4096), (1003, 0), (1004, None), (1005, -3), (None, 10), (1, 7)]
    df = spark.createDataFrame(rows, "doc_id long, size int").withColumn("piece", F.lit("clash"))
    for items in (50_000, 60):
        placed = fill_containers(df, "doc_id", "size", 2048, items)
        got = placed.collect()
        assert sum(r.n_units for r in got) == sum(n for _, n in rows if n and n > 0)
        assert sorted(r.n_units for r in got if r.doc_id == 1001) == [904, 2048, 2048] and [r.n_units for r in got if r.doc_id == 1002] == [2048, 2048]
        assert all(sum(1 for r in got if r.doc_id == i) == 1 for i in range(2, 500))
        report = fill_report(placed, 2048).first()
        assert report.fullest <= 2048 and report.n_containers >= math.ceil(report.n_units / 2048)
    assert fill_containers(df.limit(0), "doc_id", "size", 2048).count() == 0


def test_nearest_in_a_hot_bucket(spark):
    rng = np.random.default_rng(8)
    close = rng.normal(size=384) + 0.02 * rng.normal(size=(6000, 5)) @ rng.normal(size=(5, 384))
    v = np.concatenate([close, rng.normal(size=(6000, 384))])
    v = (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)
    df = spark.createDataFrame([(f"v{i:05}", x.tolist()) for i, x in enumerate(v)], "id string, v array<float>")
    got = {}
    for r in nearest(df, "id", "v", 384, k=5).collect():
        got.setdefault(int(r.a_id[1:]), set()).add(int(r.b_id[1:]))
    exact = v.astype(np.float64)
    hit = 0
    for i in range(0, 6000, 20):
        s = exact @ exact[i]
        s[i] = -9
        hit += len(got[i] & set(np.argpartition(-s, 5)[:5].tolist()))
    assert hit / (300 * 5) > 0.9


def test_borders_have_margins():
    keys = [bytes([i]) for i in range(100)]
    assert borders(keys, 4, 10) == [(keys[a - 10], keys[a], keys[a + 10]) for a in (25, 50, 75)]
    assert borders(keys, 1, 10) == [] and borders(keys, 2, 60) == [(b"", keys[50], b"\xff")]


def test_sparse_chains_stay_in_bounded_partitions(spark, monkeypatch):
    """As many keys as edges, far more than one partition holds: forests never shrink much, partitions stay bounded."""
    from tidemark.llm import groups

    plain = groups._peel

    def counted(batches):
        held = list(batches)
        n = sum(b.num_rows for b in held)
        assert n <= 3 * 2000
        yield from plain(iter(held))

    monkeypatch.setattr(groups, "_peel", counted)
    chains = spark.range(10_000).select(F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k"), "id")
    pairs = chains.select(F.concat(F.lit("c"), F.lpad("id", 6, "0"), F.lit("-"), "k").alias("a"), F.concat(F.lit("c"), F.lpad("id", 6, "0"), F.lit("-"), F.col("k") + 1).alias("b"))
    path = spark.range(3000).select(F.concat(F.lit("p"), F.lpad("id", 6, "0")).alias("a"), F.concat(F.lit("p"), F.lpad(F.col("id") + 1, 6, "0")).alias("b"))
    got = linked_groups(pairs.unionByName(path), "a", "b", 2000)
    sizes = {r.group_id: r.n for r in got.groupBy("group_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert len(sizes) == 10_001 and sizes.pop("p000000") == 3001 and set(sizes.values()) == {4} and all(k.endswith("-0") for k in sizes)
    assert got.count() == got.distinct().count()


def test_nearest_where_no_few_directions_tell(spark):
    """Groups of eight in all directions: what is found must not hang on a few of them. Beyond one cell."""
    rng = np.random.default_rng(11)
    mates = 0.85 * np.repeat(rng.normal(size=(1200, 96)), 8, axis=0) + 0.5 * rng.normal(size=(9600, 96))
    v = (mates + 0.3 * np.sqrt(96) * np.eye(96)[0]).astype(np.float32)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([(f"v{i:05}", x.tolist()) for i, x in enumerate(v)], "id string, v array<float>")
    got = {}
    for r in nearest(df, "id", "v", 96, k=5).collect():
        got.setdefault(int(r.a_id[1:]), set()).add(int(r.b_id[1:]))
    assert len(got) == 9600 and all(len(x) == 5 for x in got.values())
    hit = 0
    for i in range(0, 9600, 20):
        s = v @ v[i]
        s[i] = -9
        hit += len(got[i] & set(np.argpartition(-s, 5)[:5].tolist()))
    assert hit / (480 * 5) > 0.97
