"""Queries of points, boxes and tiles."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagelore.operators import layout as L
from pagelore.sources import corpus


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strokes: a user's events in order, the value against the number."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = corpus.table(spark, sf_dir, "events")
    return e.select(F.col("user_id").cast("int").alias("stroke"), (F.row_number().over(w) - 1).alias("k"), F.col("value").alias("y")).withColumn("x", F.col("k") * 2.0).select("stroke", "k", "x", "y")


def path_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("stroke").orderBy("k")
    steps = points(spark, sf_dir).withColumn("d", F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)))
    return steps.groupBy("stroke").agg(F.round(F.coalesce(F.sum("d"), F.lit(0.0)), 6).alias("length"))


def polygon_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area of the closed stroke; fewer than three points have none."""
    w = Window.partitionBy("stroke").orderBy("k")
    whole = Window.partitionBy("stroke").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    p = points(spark, sf_dir)
    p = p.withColumn("nx", F.coalesce(F.lead("x").over(w), F.first("x").over(whole))).withColumn("ny", F.coalesce(F.lead("y").over(w), F.first("y").over(whole)))
    area = F.abs(F.sum(F.col("x") * F.col("ny") - F.col("nx") * F.col("y"))) / 2
    return p.groupBy("stroke").agg(F.round(F.when(F.count("*") < 3, 0.0).otherwise(area), 4).alias("area"))


def path_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).groupBy("stroke").agg(F.min("x").alias("l"), F.min("y").alias("b"), F.max("x").alias("r"), F.max("y").alias("t"))


def path_smoothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-point smoothing; the ends stay."""
    w = Window.partitionBy("stroke").orderBy("k")
    smooth = lambda c: F.coalesce((F.lag(c).over(w) + 2 * F.col(c) + F.lead(c).over(w)) / 4, F.col(c))
    return points(spark, sf_dir).select("stroke", "k", F.round(smooth("x"), 9).alias("x"), F.round(smooth("y"), 9).alias("y"))


def path_simplify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).groupBy("stroke").applyInPandas(lambda stroke: L.simplify(stroke), L.STROKE)


def nearest_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance of the point (50, 50) from each stroke's line."""
    w = Window.partitionBy("stroke").orderBy("k")
    s = points(spark, sf_dir).withColumn("x2", F.lead("x").over(w)).withColumn("y2", F.lead("y").over(w)).filter("x2 is not null")
    dx, dy = F.col("x2") - F.col("x"), F.col("y2") - F.col("y")
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((50 - F.col("x")) * dx + (50 - F.col("y")) * dy) / (dx * dx + dy * dy)))
    far = F.hypot(50 - (F.col("x") + t * dx), 50 - (F.col("y") + t * dy))
    return s.groupBy("stroke").agg(F.round(F.min(far), 6).alias("distance"))


def tile_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles of 512 pixels for pages of 40 pixels a word by 20 a line, and how far each is from the first tile."""
    docs = corpus.documents(spark, sf_dir).select("doc_id", F.least(F.length("text"), F.lit(4000)).alias("w"), (F.size(F.split("text", "\n")) * 100).alias("h"))
    grid = docs.select("doc_id", F.greatest(F.ceil(F.col("w") / 512), F.lit(1)).alias("columns"), F.greatest(F.ceil(F.col("h") / 512), F.lit(1)).alias("rows"))
    return grid.select("doc_id", "columns", "rows", F.greatest(F.col("columns"), F.col("rows")) - 1).toDF("doc_id", "columns", "rows", "farthest")


def rect_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each stroke's box shares with the box from (10, 20) to (60, 70); none if it is empty."""
    box = path_bounds(spark, sf_dir)
    box = box.select("stroke", F.greatest("l", F.lit(10.0)).alias("l"), F.greatest("b", F.lit(20.0)).alias("b"), F.least("r", F.lit(60.0)).alias("r"), F.least("t", F.lit(70.0)).alias("t"))
    return box.filter("l < r AND b < t")


def snapped_angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directions of strokes' first steps, to the nearest 15 degrees and quarter turn."""
    w = Window.partitionBy("stroke").orderBy("k")
    s = points(spark, sf_dir).withColumn("a", F.degrees(F.atan2(F.lead("y").over(w) - F.col("y"), F.lead("x").over(w) - F.col("x")))).filter("k = 0 AND a is not null")
    return s.select("stroke", (F.floor(F.col("a") / 15 + 0.5) * 15).alias("snapped"), F.pmod(F.floor(F.col("a") / 90 + 0.5), F.lit(4)).alias("quarter"))


def marks_deduplicated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strokes' boxes that are within half a unit of no earlier one: cells of all four edges find the candidates."""
    b = path_bounds(spark, sf_dir)
    near = lambda c: F.array_distinct(F.array(F.floor(F.col(c) - 0.5), F.floor(F.col(c) + 0.5)))
    cells = b
    for c in "lbrt":
        cells = cells.withColumn(f"n_{c}", F.explode(near(c)))
    cells = cells.withColumn("cell", F.struct(*[F.col(f"n_{c}").alias(c) for c in "lbrt"]))
    close = lambda c: F.abs(F.col(f"x.{c}") - F.col(f"y.{c}")) <= 0.5
    x, y = b.withColumn("cell", F.struct(*[F.floor(c).alias(c) for c in "lbrt"])).alias("x"), cells.alias("y")
    doubled = x.join(y, (F.col("x.cell") == F.col("y.cell")) & (F.col("y.stroke") < F.col("x.stroke")) & close("l") & close("b") & close("r") & close("t")).select(F.col("x.stroke").alias("stroke")).distinct()
    return b.join(doubled, "stroke", "left_anti").select("stroke")


def boxes_mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strokes' boxes under a turn by 30 degrees and a move: bounds of the four corners."""
    a, b, c, d, e, f = math.cos(math.pi / 6), math.sin(math.pi / 6), -math.sin(math.pi / 6), math.cos(math.pi / 6), 10.0, -5.0
    xs = F.array(*[a * F.col(x) + c * F.col(y) + e for x in ("l", "r") for y in ("b", "t")])
    ys = F.array(*[b * F.col(x) + d * F.col(y) + f for x in ("l", "r") for y in ("b", "t")])
    return path_bounds(spark, sf_dir).select("stroke", *[F.round(v, 6).alias(n) for v, n in ((F.array_min(xs), "l"), (F.array_min(ys), "b"), (F.array_max(xs), "r"), (F.array_max(ys), "t"))])


def cropped_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Margins of 10, 20, 30 and 40 points as they look, taken off pages of 595 by 842 at each turn: the box in the page's own frame, and
    the scale that brings it back to the sheet."""
    rows = spark.createDataFrame([(r,) for r in (0, 90, 180, 270)], "rotation int")
    top, right, bottom, left = 10.0, 20.0, 30.0, 40.0
    pick = lambda *v: F.element_at(F.array(*map(F.lit, v)), (F.col("rotation") / 90).cast("int") + 1)
    rows = rows.select("rotation", pick(left, top, right, bottom).alias("l"), pick(bottom, left, top, right).alias("b"), (595 - pick(right, bottom, left, top)).alias("r"), (842 - pick(top, right, bottom, left)).alias("t"))
    return rows.withColumn("scale", F.round(F.least(595 / (F.col("r") - F.col("l")), 842 / (F.col("t") - F.col("b"))), 6))


def erased_strokes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a round eraser of 20 at (100, 50) leaves of each stroke: runs of two points or more outside it."""
    w = Window.partitionBy("stroke").orderBy("k")
    p = points(spark, sf_dir).withColumn("out", F.hypot(F.col("x") - 100, F.col("y") - 50) > 20)
    runs = p.withColumn("g", F.sum((~F.col("out")).cast("int")).over(w)).filter("out").groupBy("stroke", "g").agg(F.min("k").alias("first"), F.count("*").alias("n"))
    return runs.filter("n >= 2").select("stroke", "first", "n")


def measure_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths in millimetres and areas in square millimetres, to one decimal."""
    mm = 25.4 / 72
    both = path_length(spark, sf_dir).join(polygon_area(spark, sf_dir), "stroke")
    one = lambda v, unit: F.format_string(f"%.1f{unit}", F.floor(v * 10 + 0.5) / 10)
    return both.select("stroke", one(F.col("length") * mm, " mm").alias("length"), one(F.col("area") * mm * mm, " mm2").alias("area"))


QUERIES = {f.__name__: f for f in (path_length, polygon_area, path_bounds, path_smoothing, path_simplify, nearest_segment, tile_grid, rect_intersection, snapped_angles, marks_deduplicated, boxes_mapped, cropped_pages, erased_strokes, measure_labels)}

_P = "(SELECT CAST(user_id AS INTEGER) AS stroke, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS k, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) * 2e0 AS x, value AS y FROM events)"
_B = f"(SELECT stroke, min(x) AS l, min(y) AS b, max(x) AS r, max(y) AS t FROM {_P} GROUP BY stroke)"
_STEP = f"(SELECT *, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM {_P} WINDOW w AS (PARTITION BY stroke ORDER BY k))"
ORACLES = {
    "path_length": f"SELECT stroke, round(coalesce(sum(sqrt((x2 - x) * (x2 - x) + (y2 - y) * (y2 - y))), 0), 6) AS length FROM {_STEP} GROUP BY stroke",
    "polygon_area": f"SELECT stroke, round(CASE WHEN count(*) < 3 THEN 0 ELSE abs(sum(x * ny - nx * y)) / 2 END, 4) AS area FROM (SELECT stroke, x, y, coalesce(x2, first(x) OVER (PARTITION BY stroke ORDER BY k)) AS nx, coalesce(y2, first(y) OVER (PARTITION BY stroke ORDER BY k)) AS ny FROM {_STEP}) GROUP BY stroke",
    "path_bounds": f"SELECT * FROM {_B}",
    "path_smoothing": f"SELECT stroke, k, round(coalesce((lag(x) OVER w + 2 * x + lead(x) OVER w) / 4, x), 9) AS x, round(coalesce((lag(y) OVER w + 2 * y + lead(y) OVER w) / 4, y), 9) AS y FROM {_P} WINDOW w AS (PARTITION BY stroke ORDER BY k)",
    "nearest_segment": f"""
SELECT stroke, round(min(sqrt((50 - x - q * (x2 - x)) ** 2 + (50 - y - q * (y2 - y)) ** 2)), 6) AS distance
FROM (SELECT *, greatest(0e0, least(1e0, ((50 - x) * (x2 - x) + (50 - y) * (y2 - y)) / ((x2 - x) ** 2 + (y2 - y) ** 2))) AS q FROM {_STEP} WHERE x2 IS NOT NULL) GROUP BY stroke
""",
    "tile_grid": "SELECT doc_id, c AS columns, r AS rows, greatest(c, r) - 1 AS farthest FROM (SELECT doc_id, CAST(greatest(ceil(least(length(text), 4000) / 512e0), 1) AS BIGINT) AS c, CAST(greatest(ceil(len(string_split(text, chr(10))) * 100 / 512e0), 1) AS BIGINT) AS r FROM documents)",
    "rect_intersection": f"SELECT * FROM (SELECT stroke, greatest(l, 10e0) AS l, greatest(b, 20e0) AS b, least(r, 60e0) AS r, least(t, 70e0) AS t FROM {_B}) WHERE l < r AND b < t",
    "snapped_angles": f"SELECT stroke, CAST(floor(a / 15 + 0.5) * 15 AS BIGINT) AS snapped, CAST((floor(a / 90 + 0.5) + 4) % 4 AS BIGINT) AS quarter FROM (SELECT stroke, degrees(atan2(y2 - y, x2 - x)) AS a FROM {_STEP} WHERE k = 0 AND x2 IS NOT NULL)",
    "marks_deduplicated": f"SELECT stroke FROM {_B} x WHERE NOT EXISTS (SELECT 1 FROM {_B} y WHERE y.stroke < x.stroke AND abs(x.l - y.l) <= 0.5 AND abs(x.b - y.b) <= 0.5 AND abs(x.r - y.r) <= 0.5 AND abs(x.t - y.t) <= 0.5)",
    "boxes_mapped": f"""
WITH c AS (SELECT stroke, cos(pi() / 6) * x - sin(pi() / 6) * y + 10 AS u, sin(pi() / 6) * x + cos(pi() / 6) * y - 5 AS v FROM (SELECT stroke, unnest([l, l, r, r]) AS x, unnest([b, t, b, t]) AS y FROM {_B}))
SELECT stroke, round(min(u), 6) AS l, round(min(v), 6) AS b, round(max(u), 6) AS r, round(max(v), 6) AS t FROM c GROUP BY stroke
""",
    "cropped_pages": "SELECT rotation, l, b, r, t, round(least(595 / (r - l), 842 / (t - b)), 6) AS scale FROM (VALUES (0, 40e0, 30e0, 575e0, 832e0), (90, 10e0, 40e0, 565e0, 822e0), (180, 20e0, 10e0, 555e0, 812e0), (270, 30e0, 20e0, 585e0, 802e0)) x(rotation, l, b, r, t)",
    "erased_strokes": f"""
SELECT stroke, first, n FROM (SELECT stroke, g, min(k) AS first, count(*) AS n FROM (
  SELECT *, sum(CASE WHEN sqrt((x - 100) ** 2 + (y - 50) ** 2) > 20 THEN 0 ELSE 1 END) OVER (PARTITION BY stroke ORDER BY k) AS g FROM {_P}) WHERE sqrt((x - 100) ** 2 + (y - 50) ** 2) > 20 GROUP BY stroke, g) WHERE n >= 2
""",
}
ORACLES["measure_labels"] = f"""
SELECT stroke, printf('%.1f mm', floor(length * (25.4e0 / 72) * 10 + 0.5) / 10) AS length, printf('%.1f mm2', floor(area * (25.4e0 / 72) * (25.4e0 / 72) * 10 + 0.5) / 10) AS area
FROM ({ORACLES["path_length"]}) JOIN ({ORACLES["polygon_area"]}) USING (stroke)
"""
