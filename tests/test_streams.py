from datetime import datetime, timedelta

import hypothesis.strategies as st
from hypothesis import HealthCheck, given, settings
from pyspark.sql import functions as F

from tidemark.operators.streams import paired_sessions

ROWS = "id string, p string, s string, created_at timestamp_ntz, start_us int"
T = datetime(2024, 1, 1)


def brute(rows, gap):
    streams, seen = {}, set()
    for i, p, s, at, _ in rows:
        if p is None or at is None or (i is not None and i in seen):
            continue
        seen.add(i)
        streams.setdefault((p, s), []).append(at)
    out = []
    for (p, s), times in streams.items():
        times.sort()
        start, n = times[0], 0
        for k, t in enumerate(times):
            if k and (t - times[k - 1]).total_seconds() > gap:
                out.append((p, s, start, times[k - 1], n))
                start, n = t, 0
            n += 1
        out.append((p, s, start, times[-1], n))
    return sorted(out, key=str)


def run(spark, rows, gap=100, width=300):
    df = paired_sessions(spark.createDataFrame(rows, ROWS), {"project": F.col("p"), "source": F.col("s")}, gap_seconds=gap, slice_seconds=width)
    epoch = datetime(1970, 1, 1)
    return sorted([(r.project, r.source, epoch + timedelta(microseconds=r.start_us), epoch + timedelta(microseconds=r.end_us), r.n_rows) for r in df.collect()], key=str)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow])
@given(st.lists(st.tuples(st.sampled_from(["a", "b"]), st.sampled_from(["x", None]), st.integers(0, 3000)), max_size=60))
def test_same_as_brute_force(spark, drawn):
    rows = [(str(i), p, s, T + timedelta(seconds=t), 0) for i, (p, s, t) in enumerate(drawn)]
    assert run(spark, rows) == brute(rows, 100)


def test_exact_gap_stays_and_ties_join(spark):
    rows = [("1", "a", "x", T, 0), ("2", "a", "x", T + timedelta(seconds=100), 0), ("3", "a", "x", T + timedelta(seconds=100), 0), ("4", "a", "x", T + timedelta(seconds=200, microseconds=1), 0)]
    assert [r[4] for r in run(spark, rows)] == [3, 1]


def test_nulls_repeats_and_empty(spark):
    rows = [("1", "a", "x", T, 0), ("1", "a", "x", T, 0), (None, "a", "x", T, 0), (None, "a", "x", T, 0), ("5", None, "x", T, 0), ("6", "a", "x", None, 0)]
    assert [r[4] for r in run(spark, rows)] == [3]
    assert run(spark, []) == []


def test_hot_stream_over_many_slices(spark):
    rows = [(str(i), "a", "x", T + timedelta(seconds=37 * i + (500 if i > 40 else 0)), 0) for i in range(120)]
    assert run(spark, rows) == brute(rows, 100)


def test_slices_and_stretches_change_nothing(spark):
    import random
    from datetime import datetime, timedelta

    from tidemark.operators.lifecycle import frequent_sequences
    from tidemark.operators.sessions import gap_sessions

    rng, at = random.Random(3), datetime(2024, 1, 1)
    rows = [(f"e{i:03}", rng.choice(["a", "b", None]), at + timedelta(seconds=rng.randrange(40_000)), rng.choice("xyz")) for i in range(200)] + [("n1", "a", None, "x")]
    df = spark.createDataFrame(rows, "id string, project_id string, created_at timestamp, step string")
    sessions = lambda s: {(r.id, r.project_id, r.session_no) for r in gap_sessions(df, 600, slice_s=s).collect()}
    assert sessions(86_400 * 9) == sessions(900) and len(sessions(900)) == 201
    grams = lambda n: {tuple(r) for r in frequent_sequences(df, "project_id", ["created_at", "id"], "step", 3, 2, None, 4, n).collect()}
    assert grams(10_000) == grams(7) and len(grams(7)) > 10
    counts = {}
    for key in ("a", "b", None):
        mine = [r[3] for r in sorted((r for r in rows if r[1] == key), key=lambda r: (r[2] or datetime.min, r[0]))]
        for g in zip(mine, mine[1:], mine[2:], strict=False):
            counts[key, " > ".join(g)] = counts.get((key, " > ".join(g)), 0) + 1
    assert {(k, g, n) for k, g, n, _ in grams(7)} == {(k, g, n) for (k, g), n in counts.items() if n >= 2}
