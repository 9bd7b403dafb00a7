"""Operators over ordered events: anchored coalescing, resident sets, nearest-rank percentiles."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Milliseconds that a kept entry takes in others like it.
ANCHOR_MS = 500


def nearest_rank(values: Column, p: float) -> Column:
    """The value at round((n - 1) p) of a sorted array, halves away from zero; 0 if it is empty."""
    at = F.floor((F.size(values) - 1) * p + 0.5).cast("int")
    return F.when(F.size(values) == 0, F.lit(0.0)).otherwise(F.get(F.array_sort(values), at))


def upper_median(values: Column) -> Column:
    return F.when(F.size(values) == 0, F.lit(0.0)).otherwise(F.get(F.array_sort(values), (F.size(values) / 2).cast("int")))


def exact_sum(values: Column) -> Column:
    """The sum of doubles, the same in whatever order rows come: as decimals of 18 places where all values and their sum fit those, else as doubles."""
    exact = values.try_cast("decimal(38,18)")
    return F.coalesce(F.when(F.count(exact) == F.count(values), F.try_sum(exact).cast("double")), F.sum(values))


def one_decimal(value: Column) -> Column:
    """A double to one decimal, halves up; what has no fraction stays as it is."""
    moved = value * 10 + 0.5
    return F.when(F.abs(moved) < 2.0**53, F.floor(moved).cast("double")).otherwise(moved) / 10


KEPT = "user_id bigint, event_id bigint, label string, at_ms bigint, folded int"


def coalesce_edits(edits: pd.DataFrame, within: int = ANCHOR_MS) -> pd.DataFrame:
    """edits of one user: user_id, event_id, label, at_ms. An edit joins the last kept one if the label is the same and it comes within
    ``within`` ms of that one's own time, which stays."""
    out: list[list] = []
    for x in edits.sort_values(["at_ms", "event_id"]).itertuples():
        if out and out[-1][2] == x.label and x.at_ms - out[-1][3] <= within:
            out[-1][4] += 1
        else:
            out.append([x.user_id, x.event_id, x.label, x.at_ms, 0])
    return pd.DataFrame(out, columns=["user_id", "event_id", "label", "at_ms", "folded"])


def hysteresis(level: Column, high: float, normal: float, order: Window) -> Column:
    """high above one bound, normal below the other, between them what it was."""
    change = F.when(level > high, F.lit("high")).when(level < normal, F.lit("normal"))
    return F.coalesce(F.last(change, ignorenulls=True).over(order), F.lit("normal"))


def resident(last_use: DataFrame, owner: str, order: Column, size: str, budget: int) -> DataFrame:
    """What stays of each owner's items, newest use first, while the sizes so far fit the budget: the oldest go first."""
    w = Window.partitionBy(owner).orderBy(order.desc(), "item")
    return last_use.withColumn("held", F.sum(size).over(w)).filter(F.col("held") <= budget)
