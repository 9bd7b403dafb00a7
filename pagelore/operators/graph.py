"""Graphs in tables: connected parts, and what roots reach. Every table has a column ``g``: graphs of different ``g`` don't touch.

Rounds are Spark jobs over tables in the shared folder; only whether a round changed anything comes to the driver. A node with many
edges is only ever aggregated or joined as a row of the table of edges, which a skew join may split."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelore.sources.scratch import stored

#: Rounds after which what was reached is written as one table again.
ROUNDS_A_TABLE = 8


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """g, node, root for nodes (g, node) and edges (g, a, b): root is the smallest node of the connected part. Each round takes the smallest root
    among a node's neighbours, then the root's own root, so chains halve."""
    both = stored(edges.select("g", "a", "b").union(edges.select("g", "b", "a")).filter("a <> b").distinct(), "edges")
    label = nodes.select("g", "node").distinct().withColumn("root", F.col("node"))
    while True:
        near = both.join(label.select("g", F.col("node").alias("b"), "root"), ["g", "b"]).groupBy("g", F.col("a").alias("node")).agg(F.min("root").alias("near"))
        moved = label.join(near, ["g", "node"], "left").select("g", "node", F.col("root").alias("before"), F.least("root", "near").alias("root"))
        above = moved.select("g", F.col("node").alias("root"), F.col("root").alias("top"))
        label = stored(moved.join(above, ["g", "root"]).select("g", "node", "before", F.col("top").alias("root")), "labels")
        if not label.filter("root <> before").head(1):
            return label.select("g", "node", "root")


def reached(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """g, node, round of all that roots (g, node) lead to along edges (g, a, b), themselves in round 0. A round follows the edges of what the
    round before found and drops what was there already, so circles end and each edge is followed once."""
    edges = stored(edges.select("g", F.col("a").alias("node"), "b").filter("b IS NOT NULL").distinct(), "edges")
    front = seen = stored(roots.select("g", "node").distinct().withColumn("round", F.lit(0)), "reached")
    k = 0
    while True:
        k += 1
        new = front.join(edges, ["g", "node"]).select("g", F.col("b").alias("node")).distinct()
        front = stored(new.join(seen, ["g", "node"], "left_anti").withColumn("round", F.lit(k)), "reached")
        if not front.head(1):
            return seen
        seen = seen.union(front)
        if k % ROUNDS_A_TABLE == 0:
            seen = stored(seen, "reached")
