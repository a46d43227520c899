"""Filling containers of fixed capacity: first-fit decreasing over a tournament tree of free room, in random groups."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import materialize

#: Items of a group, about: the memory of a task, and what is lost to the last containers of each group.
GROUP_ITEMS = 50_000


class RoomTree:
    """Complete binary tree over containers; each node holds the greatest free room below it."""

    def __init__(self, capacity: int, containers: int):
        self.leaves = 1 << max(0, math.ceil(math.log2(max(containers, 1))))
        self.room = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> int:
        """Number of the first container with room for ``size``, which is then taken there."""
        room, at = self.room, 1
        while at < self.leaves:
            at *= 2
            if room[at] < size:
                at += 1
        found = at - self.leaves
        room[at] -= size
        while at > 1:
            at //= 2
            a, b = room[2 * at], room[2 * at + 1]
            room[at] = a if a > b else b
        return found


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container number of each size; ties in size keep their order."""
    order = np.argsort(-sizes, kind="stable")
    tree = RoomTree(capacity, len(sizes))
    found = np.zeros(len(sizes), np.int64)
    for i in order.tolist():
        found[i] = tree.place(int(sizes[i]))
    return found


def fill_containers(items: DataFrame, id_col: str, size_col: str, capacity: int, group_items: int = GROUP_ITEMS, seed: int = 5) -> DataFrame:
    """``<id_col>, piece, n_units, group_no, container_no``: a place for every item of positive size.

    No item is divided unless it alone exceeds ``capacity``: such an item gives full pieces and one rest (piece 0, 1, ...).
    Null, zero and negative sizes need no place and give no row. A repeated id is placed for each of its rows, a null id
    too; equal sizes change nothing. Groups are random by id and row content, so a hot source or a run of equal items
    spreads over all of them; a container belongs to one group and is named by group_no and container_no.
    """
    sized = items.select(F.col(id_col).alias("id"), F.col(size_col).cast("long").alias("size")).where("size > 0")
    sized = materialize(sized, "sizes")  # counted and packed, but computed once
    groups = max(1, math.ceil(sized.count() / group_items))
    whole = F.floor(F.col("size") / capacity).cast("int")
    rest = (F.col("size") % capacity).cast("int")
    count = whole + F.when(rest > 0, 1).otherwise(0)
    pieces = sized.select("id", F.posexplode(F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.when(i < whole, F.lit(capacity)).otherwise(rest))).alias("piece", "n_units"))
    # the random part of the group must give the same number again if a task is repeated
    grouped = pieces.withColumn("group_no", F.pmod(F.xxhash64("id", "piece", F.lit(seed)), F.lit(groups)).cast("int"))

    def fill(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["id", "piece", "n_units"], kind="stable", na_position="first")
        group["container_no"] = first_fit_decreasing(group["n_units"].to_numpy(), capacity)
        return group[["id", "piece", "n_units", "group_no", "container_no"]]

    kind = sized.schema["id"].dataType.simpleString()
    return grouped.groupBy("group_no").applyInPandas(fill, f"id {kind}, piece int, n_units int, group_no int, container_no long").withColumnRenamed("id", id_col)


def fill_report(placed: DataFrame, capacity: int) -> DataFrame:
    """Containers, units, and the share of unused space."""
    per = placed.groupBy("group_no", "container_no").agg(F.sum("n_units").alias("used"))
    return per.agg(
        F.count(F.lit(1)).alias("n_containers"), F.sum("used").alias("n_units"), F.max("used").alias("fullest"),
        F.round(1 - F.sum("used") / (F.count(F.lit(1)) * F.lit(capacity)), 6).alias("unused"),
    )

