"""Changed regions of two pages on a grid: tiles with enough differing cells, joined with those that touch them, also at a corner."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from pagelore.operators.graph import components

#: Cells along a tile, differing cells of a changed tile, regions of a page.
TILE, LEAST, MOST = 8, 3, 64


def differing(a: str, b: str) -> np.ndarray:
    """Places of two texts' characters that differ, from 0; beyond the shorter one's end a blank stands."""
    x, y = (np.frombuffer((t or "").encode("utf-32-le", "surrogatepass"), np.uint32) for t in (a, b))
    n = max(len(x), len(y))
    x, y = (np.pad(c, (0, n - len(c)), constant_values=32) for c in (x, y))
    return np.flatnonzero(x != y)


def text_tiles(pairs: DataFrame, across: int, tile: int = TILE, least: int = LEAST) -> DataFrame:
    """g, tx, ty of the changed tiles of two texts (g, a, b) on a grid of ``across`` characters: a text's tiles are counted where it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide = -(-across // tile)
        for batch in batches:
            row, places = [], []
            for k, (a, b) in enumerate(zip(batch["a"].to_pylist(), batch["b"].to_pylist(), strict=True)):
                at = differing(a, b)
                found, n = np.unique(at // across // tile * wide + at % across // tile, return_counts=True)
                places.append(found[n >= least])
                row.append(np.full(len(places[-1]), k))
            row, place = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (row, places))
            yield pa.RecordBatch.from_arrays([batch["g"].take(pa.array(row)), pa.array(place % wide), pa.array(place // wide)], names=["g", "tx", "ty"])

    return pairs.select("g", "a", "b").mapInArrow(run, StructType([pairs.schema["g"], StructField("tx", LongType()), StructField("ty", LongType())]))


def changed_tiles(cells: DataFrame, tile: int = TILE, least: int = LEAST) -> DataFrame:
    """g, tx, ty of the tiles with ``least`` or more of the differing cells (g, x, y)."""
    at = cells.select("g", F.floor(F.col("x") / tile).alias("tx"), F.floor(F.col("y") / tile).alias("ty"))
    return at.groupBy("g", "tx", "ty").agg(F.count("*").alias("n")).filter(F.col("n") >= least).drop("n")


def regions(tiles: DataFrame, sizes: DataFrame, tile: int = TILE, most: int = MOST) -> DataFrame:
    """g, region, x0, y0, x1, y1: boxes around what hangs together of tiles (g, tx, ty), cut at the page's size (g, w, h), in the order of
    their first tiles; of more than ``most`` the largest ones.

    Tiles side by side are a run, so the graph has a node for each run and an edge for two runs that touch in neighbouring rows."""
    row = Window.partitionBy("g", "ty").orderBy("tx")
    runs = tiles.withColumn("island", F.col("tx") - F.row_number().over(row))
    # a run is named by its first tile, in reading order
    first = F.min("tx").over(Window.partitionBy("g", "ty", "island"))
    named = runs.select("g", "tx", "ty", F.struct("ty", first.alias("tx")).alias("node"))
    below = named.select("g", F.explode(F.sequence(F.col("tx") - 1, F.col("tx") + 1)).alias("tx"), (F.col("ty") - 1).alias("ty"), F.col("node").alias("b"))
    edges = named.withColumnRenamed("node", "a").join(below, ["g", "tx", "ty"]).select("g", "a", "b")
    of = components(named.select("g", "node"), edges)
    boxes = named.join(of, ["g", "node"]).groupBy("g", "root").agg(F.min("tx").alias("x0"), F.min("ty").alias("y0"), F.max("tx").alias("x1"), F.max("ty").alias("y1"))
    boxes = boxes.join(sizes, "g").select("g", "root", (F.col("x0") * tile).alias("x0"), (F.col("y0") * tile).alias("y0"), F.least((F.col("x1") + 1) * tile, "w").alias("x1"), F.least((F.col("y1") + 1) * tile, "h").alias("y1"))
    page = Window.partitionBy("g")
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    boxes = boxes.withColumn("n", F.count("*").over(page)).withColumn("rank", F.row_number().over(page.orderBy(F.desc(area), "root")))
    order = F.when(F.col("n") > most, F.col("rank")).otherwise(F.row_number().over(page.orderBy("root")))
    return boxes.filter(F.col("rank").between(1, most) | (F.col("n") <= most)).select("g", order.cast("bigint").alias("region"), "x0", "y0", "x1", "y1")
