"""Streams of page results and edits.

Files that arrive in a folder are read as a stream. What a stream keeps goes to a folder of parts, of which a batch replaces those that it has
something for.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from pagelore.operators.series import ANCHOR_MS
from pagelore.sources.scratch import stored
from pagelore.sources.versions import present


def read(spark: SparkSession, folder: str, schema: StructType | str, files_a_batch: int | None = None) -> DataFrame:
    """Files that are there or arrive, all at once or some a batch."""
    reader = spark.readStream.schema(schema)
    return (reader if files_a_batch is None else reader.option("maxFilesPerTrigger", files_a_batch)).parquet(folder)


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of the rows of each key the last one."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")


#: Parts of what a stream keeps: a batch writes those again that it has keys of.
PARTS = 32


class PageUpsert:
    """Keeps the newest results of each page under ``folder``: a page that comes again replaces its rows. Used with foreachBatch. Only the parts that
    a batch touches are read and written again (dynamic overwrite); a batch that is delivered again leaves the same rows."""

    def __init__(self, folder: str, keys: list[str], order: list[str]) -> None:
        self.folder, self.keys, self.order = folder, keys, order

    def __call__(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = stored(latest(batch, self.keys, self.order).withColumn("part", F.pmod(F.xxhash64(*self.keys), F.lit(PARTS)).cast("int")), "batch")
        held = present(spark, self.folder)
        if held is not None:
            held = held.join(F.broadcast(new.select("part").distinct()), "part", "left_semi")  # at most PARTS rows
            new = stored(latest(held.unionByName(new), self.keys, self.order), "batch")
        new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(self.folder)

    def result(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self.folder).drop("part")


KEPT = "user_id bigint, label string, at_ms bigint, folded int"
STATE = "label string, at_ms bigint, folded int"


def _fold(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState, within: int) -> Iterator[pd.DataFrame]:
    label, at, folded = state.get if state.exists else (None, 0, 0)
    rows = []
    if state.hasTimedOut:
        rows.append((key[0], label, at, folded))
        state.remove()
    else:
        for x in pd.concat(list(batches)).sort_values(["at_ms", "event_id"]).itertuples():
            if label is not None and x.label == label and x.at_ms - at <= within:
                folded += 1
                continue
            if label is not None:
                rows.append((key[0], label, at, folded))
            label, at, folded = x.label, x.at_ms, 0
        state.update((label, int(at), int(folded)))
        # nothing that comes after this can join the kept edit
        state.setTimeoutTimestamp(max(int(at) + within, state.getCurrentWatermarkMs()) + 1)
    yield pd.DataFrame(rows, columns=["user_id", "label", "at_ms", "folded"])


def coalesced(edits: DataFrame, within: int = ANCHOR_MS, late: str = "1 minute") -> DataFrame:
    """A stream of edits (user_id, event_id, label, at_ms) with those folded that come within ``within`` ms of a kept one of the same label. A kept
    edit is given out, and its state goes, once the next one or the watermark shows that it is done."""

    def run(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        return _fold(key, batches, state, within)

    rows = edits.withColumn("at", F.timestamp_millis("at_ms")).withWatermark("at", late)
    return rows.groupBy("user_id").applyInPandasWithState(run, KEPT, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def in_time(rows: DataFrame, time: str, late: str, window: str) -> DataFrame:
    """Counts by event type in windows of time; what comes later than ``late`` after the newest is dropped."""
    return rows.withWatermark(time, late).groupBy(F.window(time, window), "event_type").agg(F.count("*").alias("n"))
