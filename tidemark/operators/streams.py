"""Sessions of event streams by pairing of starts and ends.

A stream is cut into time slices, so that a stream holding a large part of all rows is spread over many tasks. Within
a slice, RANGE frames find the events with no near predecessor (starts) and no near successor (ends); only the first
and last event of a slice are compared across slices. Starts and ends are numbered separately, equal numbers joined,
and rows counted as the difference of running counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.keys import micros, normal_key
from tidemark.session import materialize
from tidemark.sources.tables import latest_copy

#: Width of a time slice in seconds.
SLICE_SECONDS = 6 * 3600


def paired_sessions(rows: DataFrame, by: dict[str, Column], id_col: str = "id", at_col: str = "created_at", gap_seconds: int = 1800, slice_seconds: int = SLICE_SECONDS) -> DataFrame:
    """Sessions of the streams given by ``by`` (output name -> expression): the keys, start_us, end_us, n_rows, duration_us.

    A session starts where an event was more than ``gap_seconds`` after the previous one of its stream; exactly the gap
    stays. Rows whose first key expression is null belong to no stream; other keys may be null and then form a stream of
    their own. Rows without a time belong to no session. Rows of the same id count once (the latest copy), rows without
    an id each count. Ties in time belong to one session. Extra columns are ignored; an empty table gives no rows.
    """
    keys = list(by)
    gap = gap_seconds * 1_000_000
    width = max(slice_seconds * 1_000_000, gap)
    events = rows.select(normal_key(F.col(id_col)).alias("__id"), micros(F.col(at_col)).alias("__us"), *[c.alias(k) for k, c in by.items()])
    events = latest_copy(events, "__id", "__us").where(F.col(keys[0]).isNotNull() & F.col("__us").isNotNull())
    events = events.select(*keys, "__us", F.floor(F.col("__us") / F.lit(width)).cast("long").alias("__slice"))
    # pre-aggregated before the shuffle: one row per stream and instant
    points = events.groupBy(*keys, "__slice", "__us").agg(F.count(F.lit(1)).alias("__n"))
    part = Window.partitionBy(*keys, "__slice")
    at = part.orderBy("__us")
    before = F.count(F.lit(1)).over(at.rangeBetween(-gap, -1))
    after = F.count(F.lit(1)).over(at.rangeBetween(1, gap))
    points = points.select(
        *keys, "__slice", "__us", "__n", before.alias("__before"), after.alias("__after"), F.row_number().over(at).alias("__rank"), F.sum("__n").over(at.rowsBetween(Window.unboundedPreceding, 0)).alias("__seen")
    )
    ends = points.select(
        *keys, "__slice", "__us", "__n", "__seen", "__before", "__after", "__rank", F.max("__rank").over(part).alias("__size")
    )
    # only border candidates leave the slice: points with a neighbour on both sides are inside a session
    edges = materialize(
        ends.where((F.col("__before") == 0) | (F.col("__after") == 0) | (F.col("__rank") == 1) | (F.col("__rank") == F.col("__size"))), "session-edges"
    )
    slices = edges.groupBy(*keys, "__slice").agg(F.min("__us").alias("__first"), F.max("__us").alias("__last"), F.max("__seen").alias("__rows"))
    # a stream has one row per slice here, whatever the number of its events
    along = Window.partitionBy(*keys).orderBy("__slice")
    slices = slices.select(
        *keys, "__slice",
        F.lag("__last").over(along).alias("__prev_last"), F.lead("__first").over(along).alias("__next_first"),
        (F.sum("__rows").over(along.rowsBetween(Window.unboundedPreceding, 0)) - F.col("__rows")).alias("__base"),
    )
    same = [F.col(f"e.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys] + [F.col("e.__slice") == F.col("s.__slice")]
    on = same[0]
    for c in same[1:]:
        on = on & c
    wide = edges.alias("e").join(slices.alias("s"), on).select(*[F.col(f"e.{k}").alias(k) for k in keys], "e.__slice", "e.__us", "e.__n", "e.__seen", "e.__before", "e.__after", "e.__rank", "e.__size", "s.__prev_last", "s.__next_first", "s.__base")
    starts_here = (F.col("__before") == 0) & ((F.col("__rank") > 1) | F.col("__prev_last").isNull() | (F.col("__us") - F.col("__prev_last") > gap))
    ends_here = (F.col("__after") == 0) & ((F.col("__rank") < F.col("__size")) | F.col("__next_first").isNull() | (F.col("__next_first") - F.col("__us") > gap))
    marks = wide.select(*keys, "__slice", "__us", (F.col("__base") + F.col("__seen")).alias("__upto"), "__n", starts_here.alias("__start"), ends_here.alias("__end")).where(F.col("__start") | F.col("__end"))
    starts = _ranked(marks.where("__start"), keys).select(*keys, "__no", F.col("__us").alias("start_us"), (F.col("__upto") - F.col("__n")).alias("__first_row"))
    stops = _ranked(marks.where("__end"), keys).select(*keys, "__no", F.col("__us").alias("end_us"), F.col("__upto").alias("__last_row"))
    pair = F.col("a.__no") == F.col("b.__no")
    for k in keys:
        pair = pair & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    return starts.alias("a").join(stops.alias("b"), pair).select(
        *[F.col(f"a.{k}").alias(k) for k in keys],
        "start_us", "end_us",
        (F.col("__last_row") - F.col("__first_row")).cast(T.LongType()).alias("n_rows"),
        (F.col("end_us") - F.col("start_us")).alias("duration_us"),
    )


def _ranked(marks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``__no``: the number of a mark within its stream, from the count of marks in earlier slices and the row number
    within the slice, so that no task ever sees a whole stream."""
    per = marks.groupBy(*keys, "__slice").agg(F.count(F.lit(1)).alias("__marks"))
    along = Window.partitionBy(*keys).orderBy("__slice")
    per = per.select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.col("__slice").alias("__k_slice"), (F.sum("__marks").over(along.rowsBetween(Window.unboundedPreceding, 0)) - F.col("__marks")).alias("__earlier"))
    on = F.col("__slice") == F.col("__k_slice")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    within = Window.partitionBy(*keys, "__slice").orderBy("__us")
    return marks.join(per, on).withColumn("__no", F.row_number().over(within) + F.col("__earlier")).drop("__earlier", "__k_slice", *[f"__k_{k}" for k in keys])


def session_totals(sessions: DataFrame, by: Sequence[str]) -> DataFrame:
    """Sessions, rows and seconds per key."""
    return sessions.groupBy(*by).agg(F.count(F.lit(1)).alias("n_sessions"), F.sum("n_rows").alias("n_rows"), (F.sum("duration_us") / 1e6).alias("seconds"))
