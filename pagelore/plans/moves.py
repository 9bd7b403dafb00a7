"""Queries of what changes on pages: changed regions, paragraph flow, objects that are reached, dated notes among undated ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagelore.operators import flow, graph, regions
from pagelore.plans.glyphs import COLUMNS, glyphs
from pagelore.sources import corpus
from pagelore.sources.scratch import stored

#: Characters of a line of the grid, the word that the second page has in capitals.
ACROSS, WORD = 64, "with"


def changed_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's characters on a grid, against a page on which one word is in capitals and a tenth of the text is missing at the end."""
    docs = corpus.documents(spark, sf_dir).filter("text <> ''").withColumn("n", F.length("text"))
    other = F.replace(F.substring(F.col("text"), F.lit(1), (F.col("n") - F.floor(F.col("n") / 10)).cast("int")), F.lit(WORD), F.lit(WORD.upper()))
    tiles = stored(regions.text_tiles(docs.select(F.col("doc_id").alias("g"), F.col("text").alias("a"), other.alias("b")), ACROSS), "tiles")
    sizes = docs.select(F.col("doc_id").alias("g"), F.lit(ACROSS).cast("bigint").alias("w"), F.ceil(F.col("n") / ACROSS).alias("h"))
    return regions.regions(tiles, sizes).withColumnRenamed("g", "doc_id")


def flow_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of each benchmark item's page: its lines but the first, of which every third page has each fourth one beside the column, each fifth
    page a stamp, each seventh a form field, each second a page number at the bottom, each eleventh a frame around all."""
    line = F.floor(F.col("k") / COLUMNS)
    rows = glyphs(spark, sf_dir).groupBy("page", line.alias("item")).agg(F.min("l").alias("l"), F.min("b").alias("b"), F.max("r").alias("r"), F.max("t").alias("t")).filter("item > 0")
    aside = F.when((F.col("page") % 3 == 0) & (F.col("item") % 4 == 3), 300.0).otherwise(0.0)
    text = rows.select("page", "item", F.lit("content").alias("kind"), F.lit(True).alias("line"), (F.col("l") + aside).alias("l"), "b", (F.col("r") + aside).alias("r"), "t")
    pages = corpus.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("page"))
    box = lambda every, rest, item, kind, line, l, b, r, t: pages.filter(F.col("page") % every == rest).select("page", F.lit(item).cast("bigint").alias("item"), F.lit(kind).alias("kind"), F.lit(line).alias("line"), *[F.lit(v).alias(c) for c, v in (("l", l), ("b", b), ("r", r), ("t", t))])  # noqa: E731, E741
    return text.union(box(5, 1, 1001, "fixed", False, 0.0, 700.0, 600.0, 720.0)).union(box(7, 2, 1002, "widget", False, 30.0, 745.0, 90.0, 765.0)).union(box(2, 0, 1003, "content", True, 110.0, 30.0, 130.0, 42.0)).union(box(11, 4, 1004, "content", False, 0.0, 690.0, 260.0, 830.0))


def flow_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first line of each page is the paragraph; pages differ in how much it grows and how wide it becomes."""
    first = glyphs(spark, sf_dir).filter(F.col("k") < COLUMNS).groupBy("page").agg(F.min("l").alias("ol"), F.min("b").alias("ob"), F.max("r").alias("or"), F.max("t").alias("ot"))
    fixed = [F.lit(v).alias(c) for c, v in (("size", 12.0), ("leading", 14.0), ("cb", 0.0), ("ct", 842.0))]
    return first.select("*", F.col("ol").alias("nl"), (F.col("or") + (F.col("page") % 3) * 20.0).alias("nr"), *fixed)


def flow_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = flow.plan(flow_boxes(spark, sf_dir), flow_edits(spark, sf_dir))
    return found.withColumn("movable", F.array_join(F.col("movable").cast("array<string>"), ","))


def flow_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages push what follows, or lay the paragraph over it; growth goes from one line less to eight lines more."""
    found = flow.plan(flow_boxes(spark, sf_dir), flow_edits(spark, sf_dir))
    growth = (F.col("page") % 10 - 1) * 14.0
    names = ("shift", "blocked", "overflow", "past_bottom")
    decided = flow.decide(F.when(F.col("page") % 4 == 3, "overlap").otherwise("push"), growth, growth + 3.0)
    return found.select("page", *[c.alias(n) for c, n in zip(decided, names, strict=True)])


def object_reachability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects of a document (notes) name up to two others: several name one, some name themselves in circles, some what isn't there. What the
    first object does not lead to goes: how many stay, how many go, and how far the farthest is."""
    nodes = corpus.pages(spark, sf_dir).select(F.col("doc_id").alias("g"), F.col("page").alias("node"), F.length("text").alias("n"))
    edges = nodes.select("g", F.col("node").alias("a"), F.explode(F.array((F.col("node") * 3 + F.col("n")) % 13, F.when(F.col("n") % 3 > 0, F.floor(F.col("node") / 2)).otherwise(F.col("node") + 1))).alias("b"))
    there = edges.join(nodes.select("g", F.col("node").alias("b")), ["g", "b"], "left_semi").select("g", "a", "b")
    kept = graph.reached(there, nodes.filter("node = 0").select("g", "node"))
    rows = nodes.join(kept, ["g", "node"], "left")
    return rows.groupBy(F.col("g").alias("doc_id")).agg(F.count("round").alias("kept"), F.count(F.when(F.col("round").isNull(), 1)).alias("dropped"), F.coalesce(F.max("round"), F.lit(-1)).cast("bigint").alias("farthest"))


def dated_among_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes in order, the dated ones sorted by time in the places that dated ones have; each third note has no date and keeps its place."""
    notes = corpus.pages(spark, sf_dir).select("doc_id", F.col("page").alias("note"), F.when(F.col("page") % 3 != 1, F.length("text") % 50).alias("time"))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("note"))
    notes = notes.withColumn("place", place)
    dated = notes.filter("time IS NOT NULL")
    slots = dated.select("doc_id", "place", F.row_number().over(Window.partitionBy("doc_id").orderBy("place")).alias("k"))
    times = dated.select("doc_id", "note", F.row_number().over(Window.partitionBy("doc_id").orderBy("time", "place")).alias("k"))
    return slots.join(times, ["doc_id", "k"]).select("doc_id", "place", "note").union(notes.filter("time IS NULL").select("doc_id", "place", "note"))


QUERIES = {f.__name__: f for f in (changed_regions, flow_plan, flow_decision, object_reachability, dated_among_slots)}

_LINES = f"""
SELECT item_id AS page, CAST(k AS BIGINT) // {COLUMNS} AS item, min((k % {COLUMNS}) * 6.0) AS l, min(800.0 - (k // {COLUMNS}) * 14.0) AS b, max((k % {COLUMNS}) * 6.0 + 6.0) AS r, max(812.0 - (k // {COLUMNS}) * 14.0) AS t
FROM (SELECT item_id, unnest(range(length(text))) AS k FROM benchmark) GROUP BY ALL
"""
_D = lambda *v: ", ".join(f"CAST({x} AS DOUBLE)" for x in v)
_PLAN = f"""
WITH RECURSIVE lines AS (SELECT page, item, CAST(l AS DOUBLE) AS l, CAST(b AS DOUBLE) AS b, CAST(r AS DOUBLE) AS r, CAST(t AS DOUBLE) AS t FROM ({_LINES})),
boxes AS (
  SELECT page, item, 'content' AS kind, true AS line, l + CASE WHEN page % 3 = 0 AND item % 4 = 3 THEN 300 ELSE 0 END AS l, b, r + CASE WHEN page % 3 = 0 AND item % 4 = 3 THEN 300 ELSE 0 END AS r, t FROM lines WHERE item > 0
  UNION ALL SELECT item_id, 1001, 'fixed', false, {_D(0, 700, 600, 720)} FROM benchmark WHERE item_id % 5 = 1
  UNION ALL SELECT item_id, 1002, 'widget', false, {_D(30, 745, 90, 765)} FROM benchmark WHERE item_id % 7 = 2
  UNION ALL SELECT item_id, 1003, 'content', true, {_D(110, 30, 130, 42)} FROM benchmark WHERE item_id % 2 = 0
  UNION ALL SELECT item_id, 1004, 'content', false, {_D(0, 690, 260, 830)} FROM benchmark WHERE item_id % 11 = 4
), edits AS (SELECT page, l AS ol, b AS ob, r AS o_r, t AS ot, r + (page % 3) * 20.0 AS nr FROM lines WHERE item = 0),
grow(page, ob, cl, cr, n) AS (
  SELECT page, ob, ol, CAST(greatest(o_r, nr) AS DOUBLE), 0 FROM edits
  UNION ALL SELECT page, ob, gl, gr, n + 1 FROM (
    SELECT g.page, g.ob, g.n, g.cl, g.cr, least(g.cl, min(x.l)) AS gl, greatest(g.cr, max(x.r)) AS gr
    FROM grow g JOIN boxes x ON x.page = g.page AND x.kind = 'content' AND x.line AND x.t <= g.ob + 3 AND least(x.r, g.cr) > greatest(x.l, g.cl)
      AND NOT (least(x.r, g.cr) - greatest(x.l, g.cl) >= 0.6 * (x.r - x.l) AND x.l >= g.cl - 0.15 * (g.cr - g.cl) AND x.r <= g.cr + 0.15 * (g.cr - g.cl))
      AND (abs(x.l - g.cl) <= 30 OR abs(x.r - g.cr) <= 30 OR (x.l <= g.cl + 30 AND x.r >= g.cr - 30))
    GROUP BY g.page, g.ob, g.n, g.cl, g.cr) WHERE gl < cl OR gr > cr
), cols AS (SELECT page, ob, cl, cr FROM grow QUALIFY row_number() OVER (PARTITION BY page ORDER BY n DESC) = 1),
rows_ AS (SELECT x.*, c.ob, c.cl, c.cr, least(x.r, c.cr) - greatest(x.l, c.cl) AS o, x.t <= c.ob + 3 AS below, x.t - x.b <= 421 AND x.t > 0 AND x.b < 842 AS small FROM boxes x JOIN cols c USING (page)),
swept AS (
  SELECT *, max(CASE WHEN b - top >= need THEN 1 ELSE 0 END) OVER (PARTITION BY page ORDER BY b, item) AS split FROM (
    SELECT *, CASE WHEN right_ - left_ <= 0.25 * (cr - cl) AND top <= 72 THEN 0.75 WHEN right_ - left_ <= 0.25 * (cr - cl) THEN 1.5 ELSE 2.0 END * 14.0 AS need FROM (
      SELECT *, max(t) OVER w AS top, min(l) OVER w AS left_, max(r) OVER w AS right_ FROM rows_ WHERE kind = 'content' AND small AND o > 0 WINDOW w AS (PARTITION BY page ORDER BY b, item ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)))
), above AS (SELECT * FROM swept WHERE split = 1 QUALIFY row_number() OVER (PARTITION BY page ORDER BY b, item) = 1),
foot AS (
  SELECT s.page, s.item, a.top AS footer_top FROM swept s JOIN above a USING (page) WHERE s.split = 0 AND a.top <= 168.4 AND (a.right_ - a.left_ <= 0.25 * (a.cr - a.cl) OR a.top <= 72
    OR (a.right_ - a.left_ < 0.8 * (a.cr - a.cl) AND abs((a.left_ + a.right_) / 2 - (a.cl + a.cr) / 2) <= 0.05 * (a.cr - a.cl)))
), kinds AS (
  SELECT *, candidate OR across OR fixed_ OR footer_top IS NOT NULL AS something,
    CASE WHEN container THEN b + 3 WHEN across OR fixed_ THEN t WHEN footer_top IS NOT NULL THEN footer_top END AS stop FROM (
    SELECT *, footer_top IS NULL AND kind = 'content' AND below AND inside AS candidate, footer_top IS NULL AND kind = 'content' AND below AND NOT inside AND o > 0 AS across,
      footer_top IS NULL AND kind <> 'content' AND below AND o > 0 AS fixed_,
      footer_top IS NULL AND kind = 'content' AND NOT below AND NOT line AND b < ob - 3 AND t - b <= 421 AND o >= 0.5 * (cr - cl) AS container FROM (
      SELECT *, o >= 0.6 * (r - l) AND l >= cl - 0.15 * (cr - cl) AND r <= cr + 0.15 * (cr - cl) AS inside FROM rows_ LEFT JOIN foot USING (page, item)))
), tops AS (SELECT page, max(stop) AS y FROM kinds GROUP BY page),
raised(page, y) AS (
  SELECT page, y FROM tops WHERE y IS NOT NULL
  UNION SELECT r.page, max(k.t) FROM raised r JOIN kinds k ON k.page = r.page AND k.candidate AND k.b < r.y - 1 AND k.t > r.y GROUP BY r.page
), obstacle AS (SELECT tops.page, max(raised.y) AS y FROM tops LEFT JOIN raised USING (page) GROUP BY tops.page),
took AS (
  SELECT k.page, coalesce(string_agg(item, ',' ORDER BY item) FILTER (WHERE candidate AND (y IS NULL OR b >= y - 1)), '') AS movable, min(b) FILTER (WHERE candidate AND (y IS NULL OR b >= y - 1)) AS stack_bottom,
    max(t) FILTER (WHERE candidate AND (y IS NULL OR b >= y - 1)) AS stack_top, max(t) FILTER (WHERE candidate) AS highest, any_value(y) AS y,
    min(b) FILTER (WHERE kind = 'content' AND footer_top IS NULL AND small) AS lowest, bool_or(something) AS something
  FROM kinds k JOIN obstacle USING (page) GROUP BY k.page
), planned AS (
  SELECT page, coalesce(movable, '') AS movable, greatest(CASE WHEN y IS NOT NULL AND y >= fl THEN bottom - y ELSE bottom - fl END, 0) AS room, CASE WHEN y IS NOT NULL AND y >= fl THEN 'obstacle' ELSE 'pageBottom' END AS limited_by,
    CASE WHEN highest IS NULL AND y IS NULL THEN greatest(ob - fl, 0) ELSE least(greatest(ob - greatest(coalesce(highest, y), coalesce(y, highest)) - 2, 0), greatest(ob - fl, 0)) END AS free,
    coalesce(greatest(ob - stack_top - 2, 0), 0) AS gap, NOT coalesce(something, false) AS nothing_below
  FROM (SELECT e.page, e.ob, t.* EXCLUDE (page), greatest(least(coalesce(lowest, 18), 18), 0) AS fl, coalesce(stack_bottom, e.ob) AS bottom FROM edits e LEFT JOIN took t USING (page))
)
"""
ORACLES = {
    "changed_regions": f"""
WITH RECURSIVE chars AS (
  SELECT doc_id, length(text) AS n, unnest(range(length(text))) AS k, unnest(string_split(text, '')) AS a, unnest(string_split(rpad(replace(substr(text, 1, CAST(length(text) - length(text) // 10 AS INTEGER)), '{WORD}', '{WORD.upper()}'), CAST(length(text) AS INTEGER), ' '), '')) AS b
  FROM documents WHERE text <> ''
), tiles AS (SELECT doc_id, n, k % {ACROSS} // 8 AS tx, k // {ACROSS} // 8 AS ty FROM chars WHERE a <> b GROUP BY ALL HAVING count(*) >= 3),
reach(doc_id, ty, tx, by_, bx) AS (
  SELECT doc_id, ty, tx, ty, tx FROM tiles
  UNION SELECT r.doc_id, r.ty, r.tx, t.ty, t.tx FROM reach r JOIN tiles t ON t.doc_id = r.doc_id AND abs(t.ty - r.by_) <= 1 AND abs(t.tx - r.bx) <= 1
), rooted AS (SELECT doc_id, ty, tx, min((by_, bx)) AS root FROM reach GROUP BY ALL),
boxes AS (
  SELECT doc_id, root, min(tx) * 8 AS x0, min(ty) * 8 AS y0, least((max(tx) + 1) * 8, {ACROSS}) AS x1, least((max(ty) + 1) * 8, (max(n) + {ACROSS - 1}) // {ACROSS}) AS y1 FROM rooted JOIN tiles USING (doc_id, ty, tx) GROUP BY doc_id, root
), ranked AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS many, row_number() OVER (PARTITION BY doc_id ORDER BY (x1 - x0) * (y1 - y0) DESC, root) AS big, row_number() OVER (PARTITION BY doc_id ORDER BY root) AS nth FROM boxes)
SELECT doc_id, CASE WHEN many > 64 THEN big ELSE nth END AS region, x0, y0, x1, y1 FROM ranked WHERE many <= 64 OR big <= 64
""",
    "flow_plan": f"{_PLAN} SELECT * FROM planned",
    "flow_decision": f"""{_PLAN}, asked AS (SELECT *, page % 4 <> 3 AS push, (page % 10 - 1) * CAST(14.0 AS DOUBLE) AS growth, (page % 10 - 1) * 14.0 + 3.0 AS reach FROM planned),
kinds2 AS (SELECT *, CASE WHEN NOT push THEN 'laid' WHEN growth > 0.05 AND nothing_below THEN 'free' WHEN growth > 0.05 AND movable = '' THEN 'still' WHEN growth > 0.05 THEN 'moves' WHEN growth < -0.05 AND movable <> '' THEN 'pulled' ELSE 'none' END AS kind,
  greatest(reach - gap, 0) AS need, least(greatest(growth, greatest(reach - gap, 0)), room) AS pushed FROM asked)
SELECT page, CAST(CASE kind WHEN 'moves' THEN CASE WHEN pushed >= 0.05 THEN pushed ELSE 0 END WHEN 'pulled' THEN growth ELSE 0 END AS DOUBLE) AS shift,
  CASE WHEN kind IN ('free', 'still') AND reach - free > 0.05 OR kind = 'moves' AND need - pushed > 0.05 THEN limited_by END AS blocked,
  CAST(CASE WHEN kind = 'still' AND reach - free > 0.05 THEN reach - free WHEN kind = 'moves' AND need - pushed > 0.05 THEN need - pushed WHEN kind = 'laid' AND NOT nothing_below THEN greatest(reach - free, 0) ELSE 0 END AS DOUBLE) AS overflow,
  CAST(CASE WHEN kind = 'free' AND reach - free > 0.05 THEN reach - free WHEN kind = 'laid' AND nothing_below THEN greatest(reach - free, 0) ELSE 0 END AS DOUBLE) AS past_bottom FROM kinds2
""",
    "object_reachability": """
WITH RECURSIVE nodes AS (SELECT conv_id AS g, turn AS node, length(coalesce(text, '')) AS n FROM conversations),
edges AS (SELECT g, node AS a, (node * 3 + n) % 13 AS b FROM nodes UNION SELECT g, node, CASE WHEN n % 3 > 0 THEN node // 2 ELSE node + 1 END FROM nodes),
walk(g, node, round) AS (SELECT g, node, 0 FROM nodes WHERE node = 0 UNION SELECT w.g, e.b, w.round + 1 FROM walk w JOIN edges e ON e.g = w.g AND e.a = w.node JOIN nodes x ON x.g = e.g AND x.node = e.b WHERE w.round < 30),
found AS (SELECT g, node, min(round) AS round FROM walk GROUP BY ALL)
SELECT n.g AS doc_id, count(f.round) AS kept, count(*) - count(f.round) AS dropped, CAST(coalesce(max(f.round), -1) AS BIGINT) AS farthest FROM nodes n LEFT JOIN found f ON f.g = n.g AND f.node = n.node GROUP BY n.g
""",
    "dated_among_slots": """
WITH n AS (SELECT conv_id AS doc_id, turn AS note, CASE WHEN turn % 3 <> 1 THEN length(coalesce(text, '')) % 50 END AS time, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM conversations),
d AS (SELECT doc_id, list(note ORDER BY time, place) AS notes, list(place ORDER BY place) AS places FROM n WHERE time IS NOT NULL GROUP BY doc_id)
SELECT doc_id, CAST(unnest(places) AS INTEGER) AS place, unnest(notes) AS note FROM d UNION ALL SELECT doc_id, CAST(place AS INTEGER), note FROM n WHERE time IS NULL
""",
}
