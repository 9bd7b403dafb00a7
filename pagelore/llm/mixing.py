"""Mixing sources to target weights by Pfair scheduling.

A source's rows are dealt into blocks. Block j (from 0) of a source with weight w may start at slot floor(j / w), its release, and must
be done by ceil((j + 1) / w), its deadline. Slots go to the released block with the earliest deadline, so at every slot each source
has had within one block of its share. Weights are whole numbers of slots out of a period; after one period all shares are exact and
the pattern repeats. So the schedule of one period, a parameter's size, places every block of every source by arithmetic, and no
scheduler runs over the data.

Rows are numbered within a source by a digest of their key, without bringing a source together: rows are counted by digest range, the
counts are summed, and only a range is ever sorted in one task.

Weights are a target to keep: in_mix ends at the first slot whose source has no block left, so the bound holds to its end. Without given
weights ``interleaved`` keeps every row all the same: once a source has run out its slots stay empty, and the others go on in their
own slots.

Defined cases: a null source is a source of its own; rows with a null key are ordered by a digest of all their columns; repeated rows keep
their number; a source without a weight, or with weight zero, gets no slot (slot null, in_mix false); of more than MOST_SOURCES sources
the small ones share one weight; an empty table gives an empty result; a column of the input named like an added one is replaced.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelore.llm.common import stored

#: Rows of a block, slots of a period, sources that a mix may have, rows that a digest range should hold.
BLOCK, PERIOD, MOST_SOURCES, RANGE_ROWS = 4, 1000, 10_000, 20_000
ADDED, PLACED = ("block", "slot", "place", "in_mix"), ("place", "in_mix")


def shares(weights: Mapping[str | None, float], period: int = PERIOD) -> dict[str | None, int]:
    """Slots of a period for each source by largest remainders; a positive weight gets one slot at least."""
    items = sorted(((s, float(w)) for s, w in weights.items() if w and w > 0), key=lambda x: (x[0] is None, str(x[0])))
    if not items:
        return {}
    period = max(period, 4 * len(items))
    total = sum(w for _, w in items)
    exact = [(w / total * (period - len(items)), s) for s, w in items]
    out = {s: 1 + int(x) for x, s in exact}
    for x, s in sorted(exact, key=lambda e: (-(e[0] - int(e[0])), e[1] is None, str(e[1])))[: period - sum(out.values())]:
        out[s] += 1
    return out


def schedule(slots: Mapping[str | None, int]) -> list[tuple[str | None, int]]:
    """(source, its block's number) for each slot of a period. Ties of deadlines go to the earlier source in the order of ``slots``."""
    period, order = sum(slots.values()), list(slots)
    waiting = [(0, k, 0) for k in range(len(order))]  # release, source, block
    ready: list[tuple[int, int, int]] = []
    heapq.heapify(waiting)
    out = []
    for now in range(period):
        while waiting and waiting[0][0] <= now:
            _, k, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(j + 1) * period // slots[order[k]]), k, j))
        _, k, j = heapq.heappop(ready)
        out.append((order[k], j))
        if j + 1 < slots[order[k]]:
            heapq.heappush(waiting, ((j + 1) * period // slots[order[k]], k, j + 1))
    return out


#: The common name of the sources beyond MOST_SOURCES; others begin with =, a null source is the empty name.
POOLED = "+"


def named(df: DataFrame, source: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), df[source].cast("string")), F.lit(""))


def counts(df: DataFrame, source: str = "source") -> dict[str, int]:
    """Rows of each source by name, of at most MOST_SOURCES; the rows of all smaller ones count as POOLED."""
    sizes = df.groupBy(named(df, source).alias("name")).count()
    found = {r[0]: r[1] for r in sizes.orderBy(F.desc("count"), "name").limit(MOST_SOURCES).collect()}
    if len(found) == MOST_SOURCES:
        rest = sizes.agg(F.sum("count")).first()[0] - sum(found.values())
        if rest:
            found[POOLED] = rest
    return found


def softened(sizes: Mapping[str | None, int], power: float) -> dict[str | None, float]:
    """Weights from sizes: power 1 keeps proportions, 0 makes all sources equal."""
    return {s: float(n) ** power for s, n in sizes.items()}


@dataclass(frozen=True)
class Plan:
    """Of a mix: rows and slots of each source, its slots in a period, the period's length, and the slot at which the mix ends."""

    sizes: dict[str, int]
    slots: dict[str, int]
    place: dict[str, list[int]]
    length: int
    until: int

    def rows(self, block: int) -> int:
        """Rows in the mix."""
        periods, rest = divmod(self.until, self.length) if self.slots else (0, 0)
        return sum(min(self.sizes[s], block * (periods * n + bisect_left(self.place[s], rest))) for s, n in self.slots.items())


def planned(df: DataFrame, weights: Mapping[str | None, float] | None, source: str, block: int, period: int, power: float) -> Plan:
    sizes = counts(df, source)
    if weights is None:
        wanted = softened(sizes, power)
    else:
        wanted = {("" if s is None else f"={s}"): w for s, w in weights.items()}
    slots = shares({s: w for s, w in wanted.items() if s in sizes}, period)
    plan, length = schedule(slots), sum(slots.values())
    place: dict[str, list[int]] = {s: [] for s in slots}
    for t, (s, _) in enumerate(plan):
        place[s].append(t)
    until = end_of_mix({s: -(-sizes[s] // block) for s in slots}, slots, place, length) if plan else 0
    return Plan(sizes, slots, place, length, until)


def mix(df: DataFrame, weights: Mapping[str | None, float] | None = None, source: str = "source", key: str = "doc_id", block: int = BLOCK, period: int = PERIOD, power: float = 0.8) -> DataFrame:
    """All rows of ``df`` with block (its number in the source), slot, place (slot * block + row in the block: the order of the mix) and
    in_mix: whether the slot comes before the end of the mix. Without weights, they are row counts to the power ``power``."""
    spark, plan = df.sparkSession, planned(df, weights, source, block, period, power)
    sizes, slots, place, length, until = plan.sizes, plan.slots, plan.place, plan.length, plan.until

    # what comes from outside stays in one struct, so that its names meet no others
    kept = [c for c in df.columns if c not in ADDED]
    everything = F.xxhash64(*[df[c] for c in df.columns]).cast("string")
    digest = F.md5(F.coalesce(df[key].cast("string"), F.concat(F.lit("null "), everything)))
    rows = df.select(F.struct(*kept).alias("kept"), df[key].alias("key"), named(df, source).alias("s"), digest.alias("h"))
    if POOLED in sizes:
        listed = F.broadcast(spark.createDataFrame([(s, True) for s in sizes], "s string, listed boolean"))
        rows = rows.join(listed, "s", "left").withColumn("s", F.when(F.col("listed"), F.col("s")).otherwise(POOLED)).drop("listed")
    parts = max(64, -(-sum(sizes.values()) // RANGE_ROWS))
    rows = rows.withColumn("r", F.floor(F.conv(F.substring("h", 1, 8), 16, 10).cast("bigint") * parts / 2**32).cast("int"))
    ahead = Window.partitionBy("s").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    ranges = rows.groupBy("s", "r").agg(F.count("*").alias("n"))
    ranges = ranges.select("s", "r", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
    rows = rows.withColumn("k", F.row_number().over(Window.partitionBy("s", "r").orderBy("h", "key")) - 1)
    rows = rows.join(ranges, ["s", "r"], "left")
    # one row for each source, of all slots together one period: its slots in the period
    at = spark.createDataFrame([(s, place[s]) for s in slots], "s string, at array<int>")
    rows = rows.join(F.broadcast(at), "s", "left").select("kept", "at", F.size("at").alias("n"), (F.col("k") + F.col("before")).alias("nth"))
    rows = rows.withColumn("block", F.floor(F.col("nth") / block).cast("bigint"))
    rows = rows.withColumn("slot", F.when(F.col("at").isNotNull(), F.floor(F.col("block") / F.col("n")).cast("bigint") * length + F.get("at", (F.col("block") % F.col("n")).cast("int"))))
    rows = rows.withColumn("place", F.col("slot") * block + F.col("nth") % block)
    return rows.select(*[F.col("kept")[c].alias(c) for c in kept], "block", "slot", "place", F.coalesce(F.col("slot") < until, F.lit(False)).alias("in_mix"))


def end_of_mix(blocks: Mapping[str, int], slots: Mapping[str, int], place: Mapping[str, list[int]], length: int) -> int:
    """The first slot whose source has no block left."""
    return min(blocks[s] // n * length + place[s][blocks[s] % n] for s, n in slots.items())


def interleaved(df: DataFrame, weights: Mapping[str | None, float] | None = None, source: str = "source", key: str = "doc_id", **how) -> DataFrame:
    """All rows in the order of the mix, or with given weights those in the mix, with the columns of ``df``, whatever their names:
    range-partitioned by place, so files follow each other in order."""
    whole = df.select(F.struct(*df.columns).alias("whole"), df[source].alias("of_source"), df[key].alias("of_key"))
    mixed = mix(whole, weights, "of_source", "of_key", **how)
    mixed = mixed if weights is None else mixed.filter("in_mix")
    return mixed.orderBy("place").select("whole.*")


def placed(df: DataFrame, source: str = "source", block: int = BLOCK, period: int = PERIOD, power: float = 0.8) -> DataFrame:
    """``df``, which holds what ``interleaved`` gave without weights, with place, a row's number from 0 in the order of the mix, and in_mix, whether the
    mix is still at its weights there. The order is that of the files that ``df`` is read from, else that of its partitions: a reader deals
    files out by size, so the order of rows alone doesn't outlast a table. No row is moved."""
    kept = F.struct(*[df[c] for c in df.columns if c not in PLACED]).alias("kept")
    try:
        of_file = df.metadataColumn("_metadata")
        rows = df.select(kept, of_file["file_path"].alias("file"), of_file["row_index"].alias("at"))
    except AnalysisException:  # not read from files
        at = F.monotonically_increasing_id()
        rows = stored(df.select(kept, at.alias("at")), "placed")
        rows = rows.select("kept", F.lpad(F.shiftright("at", 33).cast("string"), 10, "0").alias("file"), F.col("at").bitwiseAND(F.lit((1 << 33) - 1)).alias("at"))
    # a row for each file
    number = F.regexp_extract(F.element_at(F.split("file", "/"), -1), r"part-(\d+)", 1).try_cast("bigint")
    starts = rows.groupBy("file").agg(F.count("*").alias("n"))
    ahead = Window.orderBy(number, "file").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select("file", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
    rows = rows.join(F.broadcast(starts), "file").withColumn("place", F.col("before") + F.col("at"))
    until = planned(df, None, source, block, period, power).rows(block)
    return rows.select("kept.*", "place", (F.col("place") < until).alias("in_mix"))
