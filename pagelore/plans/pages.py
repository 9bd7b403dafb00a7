"""Queries of page ranges, labels, order, splitting and merging."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagelore.functions import ranges as R
from pagelore.sources import corpus

#: (spec, pages of the document) and what each dialect makes of it, None for an error.
SPECS = (
    ("1-3,5,8-", 10, "0,1,2,4,7,8,9", "0,1,2,4,7,8,9", None),
    ("-3", 10, None, "0,1,2", None),
    ("5-3", 10, None, "2,3,4", "2,3,4"),
    ("1,1,2;2", 10, None, "0,1", None),
    ("", 3, "0,1,2", None, None),
    ("ALL", 3, "0,1,2", None, None),
    ("0", 10, None, None, None),
    ("11", 10, None, None, None),
    ("1-99", 10, None, None, None),
    ("a-b", 10, None, None, None),
    ("1--3", 10, None, None, None),
    ("2, 4 - 5", 9, "1,3,4", "1,3,4", "1,3,4"),
    ("1~2，4", 9, None, None, "0,1,3"),
    (",", 5, None, None, None),
)


def _parsed(spark: SparkSession, parse) -> DataFrame:
    rows = spark.createDataFrame([(s, n) for s, n, *_ in SPECS], "spec string, page_count int")
    return rows.select("spec", "page_count", F.array_join(F.transform(parse(F.col("spec"), F.col("page_count")), lambda p: p.cast("string")), ",").alias("pages"))


def range_parse_engine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, R.parse_strict)


def range_parse_dialog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, R.parse_lenient)


def range_parse_ocr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, R.parse_scan)


def islands(rows: DataFrame, key: str, page: str, between: str) -> DataFrame:
    """key, range: its distinct pages (0-based) as 1-based ranges."""
    runs = rows.select(key, page).distinct().withColumn("_g", F.col(page) - F.row_number().over(Window.partitionBy(key).orderBy(page)))
    runs = runs.groupBy(key, "_g").agg(F.min(page).alias("a"), F.max(page).alias("b"))
    text = F.when(F.col("a") == F.col("b"), (F.col("a") + 1).cast("string")).otherwise(F.concat_ws("-", F.col("a") + 1, F.col("b") + 1))
    parts = F.sort_array(F.collect_list(F.struct("a", text.alias("t"))))
    return runs.groupBy(key).agg(F.array_join(parts["t"], between).alias("range"))


def range_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return islands(corpus.pages(spark, sf_dir).filter("role = 'assistant'"), "doc_id", "page", ",")


def range_format_dialog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return islands(corpus.pages(spark, sf_dir).filter("length(text) > 300"), "doc_id", "page", ", ")


#: Ids of a range that is numbered in one task.
ID_RANGE = 20_000


def bates_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A running number over all pages of a source, in order of documents. Numbers are counted inside ranges of ids and added up over the
    ranges, so no source is sorted in one task."""
    docs = corpus.documents(spark, sf_dir).select("doc_id", "source", F.floor(F.col("doc_id") / ID_RANGE).alias("range"))
    ahead = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = docs.groupBy("source", "range").agg(F.count("*").alias("n"))
    before = ranges.select("source", "range", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
    inside = docs.withColumn("k", F.row_number().over(Window.partitionBy("source", "range").orderBy("doc_id")) - 1)
    numbered = inside.join(before, (inside["source"].eqNullSafe(before["source"])) & (inside["range"].eqNullSafe(before["range"])))
    return numbered.select("doc_id", R.bates("ABC", 4, 9990, F.col("k") + F.col("before"), "-K").alias("bates"))


#: start, style, prefix, first number
LABELS = ((0, "roman", None, 1), (2, "decimal", None, 1), (4, "alphaUpper", "App-", 2), (6, "none", "End", 1))


def page_labels_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last range that starts at or before a page labels it."""
    found = None
    for start, style, prefix, first in LABELS:
        own = F.struct(F.lit(style).alias("style"), F.lit(prefix).cast("string").alias("prefix"), (F.col("page") - start + first).cast("int").alias("n"))
        found = F.when(F.col("page") >= start, own) if found is None else F.when(F.col("page") >= start, own).otherwise(found)
    pages = corpus.pages(spark, sf_dir).select("doc_id", "page", found.alias("r"))
    return pages.select("doc_id", "page", R.label(F.col("r.style"), F.col("r.prefix"), F.col("r.n")).alias("label"))


def roman_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = spark.range(1, 4000).select(F.col("id").cast("int").alias("n"))
    return n.select("n", R.roman(F.col("n")).alias("roman"), R.letters(F.col("n")).alias("letters"))


def label_ranges_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges of several documents of five pages: the strict rule refuses a document with a bad range, the lenient one drops the range."""
    rows = spark.createDataFrame([(1, 0, 1), (1, 3, 5), (2, 0, 1), (2, 0, 2), (3, 0, 1), (3, 9, 1), (4, 2, 0), (4, 1, 1)], "doc_id int, start int, first int")
    fine = (F.col("start") < 5) & (F.col("start") >= 0) & (F.col("first") >= 1)
    rows = rows.withColumn("fine", fine).withColumn("k", F.row_number().over(Window.partitionBy("doc_id", "start").orderBy("first")))
    good = F.col("fine") & (F.col("k") == 1)
    return rows.groupBy("doc_id").agg(F.every(good).alias("strict_accepts"), F.count_if(good).alias("kept"), (F.min(F.when(good, F.col("start"))) > 0).alias("needs_first_range"))


def split_every_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = corpus.pages(spark, sf_dir).withColumn("part", F.floor(F.col("page") / 3).cast("int"))
    return parts.groupBy("doc_id", "part").agg(F.min("page").alias("first_page"), F.max("page").alias("last_page"), F.count("*").alias("pages"))


def split_by_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts begin at pages with a node (here: a user's turn); pages before the first are a part of their own."""
    pages = corpus.pages(spark, sf_dir)
    ends = pages.groupBy("doc_id").agg(F.max("page").alias("end"))
    starts = pages.filter("role = 'user'").select("doc_id", "page").union(ends.select("doc_id", F.lit(0).cast("bigint"))).distinct()
    nxt = F.lead("page").over(Window.partitionBy("doc_id").orderBy("page"))
    return starts.withColumn("n", nxt).join(ends, "doc_id").select("doc_id", F.col("page").alias("first_page"), F.coalesce(F.col("n") - 1, F.col("end")).alias("last_page"))


def booklet_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For documents of 1 to 40 pages: position on the sheets and page, null for a blank."""
    n = spark.range(1, 41).select(F.col("id").cast("int").alias("pages"))
    whole = (F.ceil(F.col("pages") / 4) * 4).cast("int")
    at = n.select("pages", whole.alias("whole"), F.explode(F.sequence(F.lit(0), whole - 1)).alias("position"))
    s, k = (F.col("position") / 4).cast("int"), F.col("position") % 4
    page = F.when(k == 0, F.col("whole") - 1 - 2 * s).when(k == 1, 2 * s).when(k == 2, 2 * s + 1).otherwise(F.col("whole") - 2 - 2 * s)
    return at.select("pages", "position", F.when(page < F.col("pages"), page).alias("page"))


def nup_down_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of 3 by 2 sheets filled column by column."""
    cols, rows = 3, 2
    at = spark.range(60).select(F.col("id").cast("int").alias("page"))
    sheet, inside = (F.col("page") / (cols * rows)).cast("int"), F.col("page") % (cols * rows)
    return at.select("page", sheet.alias("sheet"), (inside % rows * cols + (inside / rows).cast("int")).alias("cell"))


def best_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For n pages of 595 by 842 points on such a sheet, either way round: the columns and rows with the largest scale; the first wins
    unless another is larger by more than a ten thousandth."""
    n = spark.createDataFrame([(k,) for k in (1, 2, 4, 6, 8, 9, 16)], "n int")
    cells = n.select("n", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("cols")).filter("n % cols = 0").withColumn("rows", (F.col("n") / F.col("cols")).cast("int"))
    both = cells.crossJoin(spark.createDataFrame([(0, 595.0, 842.0), (1, 842.0, 595.0)], "turned int, w double, h double"))
    scale = F.least(F.col("w") / F.col("cols") / 595.0, F.col("h") / F.col("rows") / 842.0)
    ranked = both.withColumn("scale", F.round(scale, 4))
    best = ranked.groupBy("n").agg(F.min_by(F.struct("cols", "rows", "turned", "scale"), F.struct(-F.col("scale"), "turned", "cols")).alias("b"))
    return best.select("n", "b.cols", "b.rows", "b.turned", "b.scale")


def move_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages 1 and 3 are lifted and put back as a block before page 5 (or at the end)."""
    pages = corpus.pages(spark, sf_dir).select("doc_id", "page")
    group = F.when(F.col("page").isin(1, 3), 1).when(F.col("page") < 5, 0).otherwise(2)
    return pages.select("doc_id", "page", (F.row_number().over(Window.partitionBy("doc_id").orderBy(group, "page")) - 1).cast("bigint").alias("new_page"))


def page_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch on each document: page 0 goes, page 2 is turned by 90 degrees and doubled, the order is reversed."""
    pages = corpus.pages(spark, sf_dir).select("doc_id", "page", F.when(F.col("page") == 2, 90).otherwise(0).alias("rotation"))
    kept = pages.filter("page <> 0")
    copies = kept.withColumn("copy", F.explode(F.when(F.col("page") == 2, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    order = Window.partitionBy("doc_id").orderBy(F.desc("page"), F.desc("copy"))
    return copies.select("doc_id", "page", "rotation", "copy", (F.row_number().over(order) - 1).cast("bigint").alias("new_page"))


def merge_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two inputs for each document, its pages from 1 on, then all of them, as one: where each page lands."""
    pages = corpus.pages(spark, sf_dir).select("doc_id", "page")
    both = pages.filter("page >= 1").withColumn("input", F.lit(0)).unionByName(pages.withColumn("input", F.lit(1)))
    return both.select("doc_id", "input", "page", (F.row_number().over(Window.partitionBy("doc_id").orderBy("input", "page")) - 1).cast("bigint").alias("new_page"))


def merge_carry_over(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes (here: long turns) of both inputs follow their pages to the new places."""
    placed = merge_ordinal(spark, sf_dir)
    nodes = corpus.pages(spark, sf_dir).filter("length(text) > 500").select("doc_id", "page", F.substring("text", 1, 20).alias("title"))
    return nodes.join(placed, ["doc_id", "page"]).select("doc_id", "input", "new_page", "title")


def subset_and_rest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extraction of even pages: the new document's pages and what is left, renumbered."""
    pages = corpus.pages(spark, sf_dir).select("doc_id", "page", F.when(F.col("page") % 2 == 0, "extracted").otherwise("left").alias("part"))
    return pages.select("doc_id", "part", "page", (F.row_number().over(Window.partitionBy("doc_id", "part").orderBy("page")) - 1).cast("bigint").alias("new_page"))


def spread_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spreads with and without a cover page."""
    pages = corpus.pages(spark, sf_dir).select("doc_id", "page")
    return pages.select("doc_id", "page", F.floor(F.col("page") / 2).alias("spread"), F.floor((F.col("page") + 1) / 2).alias("spread_with_cover"))


def running_page_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top of each page when pages as high as their text is long are set below each other with a gap of 8, and the page at half height."""
    pages = corpus.pages(spark, sf_dir).select("doc_id", "page", F.length("text").alias("h"))
    w = Window.partitionBy("doc_id").orderBy("page")
    tops = pages.withColumn("top", F.coalesce(F.sum(F.col("h") + 8).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("bigint"))
    whole = tops.withColumn("probe", F.max(F.col("top") + F.col("h")).over(Window.partitionBy("doc_id")) / 2)
    return whole.withColumn("current", F.max(F.when(F.col("top") <= F.col("probe"), F.col("page"))).over(Window.partitionBy("doc_id"))).select("doc_id", "page", "top", "current")


def visible_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that meet the view from one and a half heights above to two and a half below a place, of pages set as above."""
    top, view = 1000, 400
    placed = running_page_position(spark, sf_dir).join(corpus.pages(spark, sf_dir).select("doc_id", "page", F.length("text").alias("h")), ["doc_id", "page"])
    return placed.filter((F.col("top") + F.col("h") > top - 1.5 * view) & (F.col("top") < top + 2.5 * view)).select("doc_id", "page")


def unique_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages' urls end in names; a name already given in a folder gets the next free number."""
    pages = corpus.table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", r"^(.*?)[^/]*$", 1).alias("folder"), F.lit("report").alias("stem"))
    k = F.row_number().over(Window.partitionBy("folder", "stem").orderBy("page_id"))
    return pages.select("page_id", "folder", F.when(k == 1, F.concat("stem", F.lit(".pdf"))).otherwise(F.format_string("%s (%d).pdf", F.col("stem"), k)).alias("name"))


def export_size_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of a source from three documents at even steps: whole bytes of a page, times the pages."""
    docs = corpus.documents(spark, sf_dir).select("source", "doc_id", F.length("text").alias("bytes"))
    w = Window.partitionBy("source").orderBy("doc_id")
    numbered = docs.select("source", "bytes", (F.row_number().over(w) - 1).alias("k"), F.count("*").over(Window.partitionBy("source")).alias("n"))
    step = F.greatest(F.floor(F.col("n") / 3), F.lit(1))
    taken = numbered.filter((F.col("k") % step == 0) & (F.col("k") < 3 * step))
    return taken.groupBy("source").agg((F.floor(F.sum("bytes") / F.count("*")) * F.max("n")).cast("bigint").alias("estimate"))


def stitch_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canvas of a document's pages under each other: offset of each page and the whole height."""
    pages = corpus.pages(spark, sf_dir).select("doc_id", "page", F.length("text").alias("h"))
    w = Window.partitionBy("doc_id").orderBy("page")
    return pages.select("doc_id", "page", (F.sum("h").over(w) - F.col("h")).alias("y"), F.sum("h").over(Window.partitionBy("doc_id")).alias("height"))


QUERIES = {f.__name__: f for f in (range_parse_engine, range_parse_dialog, range_parse_ocr, range_format, range_format_dialog, bates_labels, page_labels_asof, roman_letters, label_ranges_checked, split_every_n, split_by_outline, booklet_order, nup_down_order, best_grid, move_block, page_operations, merge_ordinal, merge_carry_over, subset_and_rest, spread_pairing, running_page_position, visible_pages, unique_names, export_size_sample, stitch_offsets)}


def _expected(k: int) -> str:
    quote = lambda x: "NULL" if x is None else f"'{x}'"
    return "SELECT * FROM (VALUES " + ", ".join(f"({quote(r[0])}, {r[1]}, {quote(r[k])})" for r in SPECS) + ") t(spec, page_count, pages)"


_ISLANDS = """
WITH runs AS (SELECT conv_id, turn, turn - row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS g FROM (SELECT DISTINCT conv_id, turn FROM conversations WHERE {where})),
spans AS (SELECT conv_id, min(turn) + 1 AS a, max(turn) + 1 AS b FROM runs GROUP BY conv_id, g)
SELECT conv_id AS doc_id, string_agg(CASE WHEN a = b THEN CAST(a AS VARCHAR) ELSE a || '-' || b END, '{between}' ORDER BY a) AS range FROM spans GROUP BY conv_id
"""
_ROMAN = "repeat('m', CAST(n // 1000 % 1000 AS INTEGER)) || ['', 'c', 'cc', 'ccc', 'cd', 'd', 'dc', 'dcc', 'dccc', 'cm'][n // 100 % 10 + 1] || ['', 'x', 'xx', 'xxx', 'xl', 'l', 'lx', 'lxx', 'lxxx', 'xc'][n // 10 % 10 + 1] || ['', 'i', 'ii', 'iii', 'iv', 'v', 'vi', 'vii', 'viii', 'ix'][n % 10 + 1]"
_LETTERS = "repeat(chr(CAST(97 + (n - 1) % 26 AS INTEGER)), CAST(((n - 1) // 26 + 1) % 1000 AS INTEGER))"
_MERGED = "(SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY input, page) - 1 AS new_page FROM (SELECT conv_id AS doc_id, turn AS page, 0 AS input FROM conversations WHERE turn >= 1 UNION ALL SELECT conv_id, turn, 1 FROM conversations))"
_TOPS = "(SELECT conv_id AS doc_id, turn AS page, length(text) AS h, CAST(coalesce(sum(length(text) + 8) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS top FROM conversations)"
ORACLES = {
    "range_parse_engine": _expected(2),
    "range_parse_dialog": _expected(3),
    "range_parse_ocr": _expected(4),
    "range_format": _ISLANDS.format(where="role = 'assistant'", between=","),
    "range_format_dialog": _ISLANDS.format(where="length(text) > 300", between=", "),
    "bates_labels": "SELECT doc_id, 'ABC' || printf('%04d', 9990 + row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) || '-K' AS bates FROM documents",
    "page_labels_asof": f"""
SELECT doc_id, page, CASE style WHEN 'roman' THEN {_ROMAN} WHEN 'decimal' THEN CAST(n AS VARCHAR) WHEN 'alphaUpper' THEN 'App-' || upper({_LETTERS}) ELSE 'End' END AS label
FROM (SELECT conv_id AS doc_id, turn AS page, turn - r.start + r.first AS n, r.style FROM conversations ASOF JOIN (VALUES (0, 'roman', 1), (2, 'decimal', 1), (4, 'alphaUpper', 2), (6, 'none', 1)) r(start, style, first) ON turn >= r.start)
""",
    "roman_letters": f"SELECT CAST(n AS INTEGER) AS n, {_ROMAN} AS roman, {_LETTERS} AS letters FROM range(1, 4000) t(n)",
    "label_ranges_checked": "SELECT * FROM (VALUES (1, true, CAST(2 AS BIGINT), false), (2, false, 1, false), (3, false, 1, false), (4, false, 1, true)) t(doc_id, strict_accepts, kept, needs_first_range)",
    "split_every_n": "SELECT conv_id AS doc_id, CAST(turn // 3 AS INTEGER) AS part, min(turn) AS first_page, max(turn) AS last_page, count(*) AS pages FROM conversations GROUP BY ALL",
    "split_by_outline": """
WITH starts AS (SELECT conv_id, turn FROM conversations WHERE role = 'user' UNION SELECT DISTINCT conv_id, 0 FROM conversations), ends AS (SELECT conv_id, max(turn) AS e FROM conversations GROUP BY conv_id)
SELECT conv_id AS doc_id, turn AS first_page, coalesce(lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) - 1, e) AS last_page FROM starts JOIN ends USING (conv_id)
""",
    "booklet_order": """
SELECT CAST(pages AS INTEGER) AS pages, CAST(p AS INTEGER) AS position, CAST(CASE WHEN x < pages THEN x END AS INTEGER) AS page FROM (
  SELECT pages, p, [w - 1 - 2 * (p // 4), 2 * (p // 4), 2 * (p // 4) + 1, w - 2 - 2 * (p // 4)][p % 4 + 1] AS x
  FROM (SELECT pages, (pages + 3) // 4 * 4 AS w, unnest(range((pages + 3) // 4 * 4)) AS p FROM range(1, 41) t(pages)))
""",
    "nup_down_order": "SELECT CAST(s * 6 + c * 2 + r AS INTEGER) AS page, CAST(s AS INTEGER) AS sheet, CAST(r * 3 + c AS INTEGER) AS cell FROM range(10) a(s), range(3) b(c), range(2) d(r)",
    "best_grid": """
SELECT n, CAST(c AS INTEGER) AS cols, CAST(n // c AS INTEGER) AS rows, turned, scale FROM (
  SELECT n, c, turned, round(least(w / c / 595.0, h / (n // c) / 842.0), 4) AS scale, row_number() OVER (PARTITION BY n ORDER BY round(least(w / c / 595.0, h / (n // c) / 842.0), 4) DESC, turned, c) AS k
  FROM (VALUES (1), (2), (4), (6), (8), (9), (16)) a(n), range(1, 17) b(c), (VALUES (0, 595e0, 842e0), (1, 842e0, 595e0)) d(turned, w, h) WHERE n % c = 0) WHERE k = 1
""",
    "move_block": "SELECT conv_id AS doc_id, turn AS page, row_number() OVER (PARTITION BY conv_id ORDER BY CASE WHEN turn IN (1, 3) THEN 4.5 ELSE turn END, turn) - 1 AS new_page FROM conversations",
    "page_operations": """
SELECT conv_id AS doc_id, turn AS page, CASE WHEN turn = 2 THEN 90 ELSE 0 END AS rotation, copy, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, copy DESC) - 1 AS new_page
FROM conversations, (VALUES (0), (1)) c(copy) WHERE turn <> 0 AND (copy = 0 OR turn = 2)
""",
    "merge_ordinal": f"SELECT doc_id, input, page, new_page FROM {_MERGED}",
    "merge_carry_over": f"SELECT m.doc_id, input, new_page, substr(text, 1, 20) AS title FROM {_MERGED} m JOIN conversations c ON c.conv_id = m.doc_id AND c.turn = m.page WHERE length(text) > 500",
    "subset_and_rest": "SELECT conv_id AS doc_id, CASE WHEN turn % 2 = 0 THEN 'extracted' ELSE 'left' END AS part, turn AS page, row_number() OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn) - 1 AS new_page FROM conversations",
    "spread_pairing": "SELECT conv_id AS doc_id, turn AS page, turn // 2 AS spread, (turn + 1) // 2 AS spread_with_cover FROM conversations",
    "running_page_position": f"SELECT doc_id, page, top, (SELECT max(x.page) FROM {_TOPS} x WHERE x.doc_id = t.doc_id AND x.top <= e.whole / 2) AS current FROM {_TOPS} t JOIN (SELECT doc_id, max(top + h) AS whole FROM {_TOPS} GROUP BY doc_id) e USING (doc_id)",
    "visible_pages": f"SELECT doc_id, page FROM {_TOPS} WHERE top + h > 400 AND top < 2000",
    "unique_names": r"""
SELECT page_id, folder, CASE WHEN k = 1 THEN 'report.pdf' ELSE 'report (' || k || ').pdf' END AS name
FROM (SELECT page_id, regexp_extract(url, '^(.*?)[^/]*$', 1) AS folder, row_number() OVER (PARTITION BY regexp_extract(url, '^(.*?)[^/]*$', 1) ORDER BY page_id) AS k FROM pages)
""",
    "export_size_sample": """
SELECT source, CAST(floor(sum(b) / count(*)) * max(n) AS BIGINT) AS estimate FROM (
  SELECT source, length(text) AS b, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS k, count(*) OVER (PARTITION BY source) AS n FROM documents)
WHERE k % greatest(n // 3, 1) = 0 AND k < 3 * greatest(n // 3, 1) GROUP BY source
""",
    "stitch_offsets": "SELECT conv_id AS doc_id, turn AS page, CAST(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) - length(text) AS BIGINT) AS y, CAST(sum(length(text)) OVER (PARTITION BY conv_id) AS BIGINT) AS height FROM conversations",
}
