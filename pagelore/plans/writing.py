"""Queries that write: HTML of documents, stamps from specifications, images on pages, resized pages, threads by chosen kinds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagelore.functions import text as T
from pagelore.operators import stamps as S
from pagelore.plans.annots import _ANNOTS, _THREADS, annotations, threaded
from pagelore.plans.glyphs import COLUMNS, glyphs
from pagelore.sources import corpus

#: Style of the page that is written.
STYLE = "body{max-width:44em;margin:2em auto;line-height:1.5}hr{margin:2em 0}"
DATE = "2026-01-31"
#: spec, group (a document's number modulo 4), role, template, ranges of pages, anchor, margin, turn, size, start, digits, prefix, suffix
SPECS = (
    (1, 0, "header", "{{filename}} - {{page}}/{{total}}", None, "top", 20.0, 0.0, 10.0, 0, 0, "", ""),
    (2, 0, "footer", "{{bates}}", ((0, 0), (2, 9)), "bottomRight", 18.0, 0.0, 8.0, 1, 6, "N-", "-X"),
    (3, 1, "watermark", "DRAFT {{date}}", ((1, 99),), "center", 0.0, 45.0, 48.0, 0, 0, "", ""),
    (4, 2, None, "{{{{page}} {{other}}", None, "bottomLeft", 12.0, 90.0, 9.0, 0, 0, "", ""),
    (5, 2, "footer", "{{bates}}", ((1, 3),), "topLeft", 12.0, 0.0, 9.0, 99_998, 3, "", ""),
)


def html_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as HTML: a paragraph for each line that isn't blank, a rule between pages; a page's first line is set large on every third page and
    a little larger on every other one, so that it is a heading, unless it is long. Digest and length."""
    rows = corpus.pages(spark, sf_dir)
    size = lambda k: F.when(k > 0, 11.0).when(F.col("page") % 3 == 0, 24.0).when(F.col("page") % 3 == 1, 14.5).otherwise(11.0)
    lines = F.filter(F.transform(F.split("text", r"\r\n|\n"), lambda x, k: F.struct(F.trim(x).alias("t"), size(k).alias("size"))), lambda x: x["t"] != "")
    level = lambda x: F.when((F.length(x["t"]) > 200) | (x["size"] / 11.0 < 1.12), 0).when(x["size"] / 11.0 >= 1.6, 1).when(x["size"] / 11.0 >= 1.3, 2).otherwise(3)
    tag = lambda x: F.when(level(x) == 0, "p").otherwise(F.concat(F.lit("h"), level(x).cast("string")))
    one = lambda x: F.concat(F.lit("<"), tag(x), F.lit(">"), T.xml_text(x["t"]), F.lit("</"), tag(x), F.lit(">\n"))
    body = rows.select("doc_id", "page", F.array_join(F.transform(lines, one), "").alias("html"))
    joined = F.array_join(F.sort_array(F.collect_list(F.struct("page", "html")))["html"], "<hr>\n")
    head = F.concat(F.lit('<!DOCTYPE html>\n<html>\n<head>\n<meta charset="utf-8">\n<title>doc-'), "doc_id", F.lit(f"</title>\n<style>{STYLE}</style>\n</head>\n<body>\n"))
    return body.groupBy("doc_id").agg(joined.alias("b")).select("doc_id", F.concat(head, "b", F.lit("</body>\n</html>\n")).alias("x")).select("doc_id", F.sha2("x", 256).alias("sha256"), F.length("x").cast("bigint").alias("length"))


def stamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stamps of all documents by the specifications of their group."""
    pages = corpus.pages(spark, sf_dir).select("doc_id", "page", F.count("*").over(Window.partitionBy("doc_id")).alias("total"), F.concat(F.lit("doc-"), "doc_id").alias("filename"), (F.col("doc_id") % 4).cast("int").alias("group"))
    pages = pages.withColumn("width", F.when(F.col("page") % 5 == 2, 842.0).otherwise(595.0)).withColumn("height", F.when(F.col("page") % 5 == 2, 595.0).otherwise(842.0))
    schema = "spec int, group int, role string, template string, ranges array<struct<first:int,last:int>>, anchor string, margin double, turn double, size double, start int, digits int, prefix string, suffix string"
    return S.add(pages, spark.createDataFrame([(*s[:4], list(s[4]) if s[4] else None, *s[5:]) for s in SPECS], schema), DATE)


def stamps_by_specification(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stamped(spark, sf_dir)


def stamps_removed_by_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Footers of the second to fourth page go, then all stamps of the sixth page on; stamps without a role go with the second removal only."""
    return S.remove(S.remove(stamped(spark, sf_dir), "footer", [(1, 3)]), None, [(5, 999)]).select("doc_id", "page", "spec")


def image_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web pages' sizes as images on pages: on their own page, on A4 or on letter, contained or as they are, with margins."""
    n = F.length("html")
    sheet = F.when(F.col("page_id") % 3 == 1, "a4").when(F.col("page_id") % 3 == 2, "letter")
    found = S.layout((50 + n % 17_000).cast("double"), (50 + n * 7 % 1500).cast("double"), sheet, F.col("page_id") % 2 == 0, (F.col("page_id") % 4) * 12.0)
    return corpus.table(spark, sf_dir, "pages").select("page_id", found.alias("p")).select("page_id", *[(F.round(F.col("p")[c], 6) + 0.0).alias(c) for c in ("page_w", "page_h", "x", "y", "w", "h")])


def resized_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of lines become A4, across if they are across: every second one scaled, the others centred. The box of each page's lines after that,
    and whether all of it is on the page."""
    lines = glyphs(spark, sf_dir).groupBy("page").agg(F.min("l").alias("l"), F.min("b").alias("b"), F.max("r").alias("r"), F.max("t").alias("t"))
    wide = F.col("page") % 3 == 0
    crop = {"left": F.lit(10.0), "bottom": F.lit(0.0), "right": F.when(wide, 900.0).otherwise(10.0 + COLUMNS * 10.0), "top": F.lit(842.0)}
    across = crop["right"] - crop["left"] > crop["top"] - crop["bottom"]
    w, h = F.when(across, S.A4[1]).otherwise(S.A4[0]), F.when(across, S.A4[0]).otherwise(S.A4[1])
    rows = lines.select("*", S.resized(*crop.values(), w, h, F.col("page") % 2 == 0).alias("m"), w.alias("w"), h.alias("h"))
    x, y = lambda c: F.col(c) * F.col("m.s") + F.col("m.tx"), lambda c: F.col(c) * F.col("m.s") + F.col("m.ty")
    inside = (x("l") >= 0) & (y("b") >= 0) & (x("r") <= F.col("w")) & (y("t") <= F.col("h"))
    return rows.select("page", F.round("m.s", 6).alias("scale"), *[(F.round(v, 4) + 0.0).alias(c) for c, v in (("l", x("l")), ("b", y("b")), ("r", x("r")), ("t", y("t")))], inside.alias("inside"))


def shrunk_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each document, how many pages are larger than the sheet by over half a point; the sheet is turned if most pages are across."""
    n = F.length("text")
    pages = corpus.pages(spark, sf_dir).select("doc_id", (400 + n % 500).cast("double").alias("w"), (400 + n * 3 % 500).cast("double").alias("h"))
    turned = F.sum((F.col("w") > F.col("h")).cast("int")).over(Window.partitionBy("doc_id")) * 2 > F.count("*").over(Window.partitionBy("doc_id"))
    rows = pages.withColumn("turned", turned)
    across, up = F.when(F.col("turned"), S.A4[1]).otherwise(S.A4[0]), F.when(F.col("turned"), S.A4[0]).otherwise(S.A4[1])
    return rows.groupBy("doc_id").agg(F.first("turned").alias("turned"), F.count_if((F.col("w") > across + 0.5) | (F.col("h") > up + 0.5)).alias("shrunk"))


def threads_of_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threads by page whose top is of a chosen kind (every third document: of any), and new notes that aren't listed yet: each sixth note of the
    document and its second, as if both were new."""
    tops = threaded(spark, sf_dir).filter("depth = 0")
    chosen = lambda: (F.col("doc_id") % 3 == 0) | F.col("kind").isin("Note", "Ink")
    listed = tops.filter(chosen()).select("doc_id", "page", F.col("note").cast("string").alias("id"), F.col("note").alias("place"))
    new = annotations(spark, sf_dir).filter(chosen())
    ghosts = new.filter("note % 6 = 0").select("doc_id", "page", F.col("note").cast("string").alias("id"), (F.col("note") + 10_000).alias("place"))
    ghosts = ghosts.union(new.filter("note % 6 = 2").select("doc_id", "page", F.concat(F.lit("g"), "note"), (F.col("note") + 10_000))).join(listed, ["doc_id", "page", "id"], "left_anti")
    rows = listed.union(ghosts.select(*listed.columns))
    return rows.groupBy("doc_id", "page").agg(F.array_join(F.sort_array(F.collect_list(F.struct("place", "id")))["id"], ",").alias("notes"))


QUERIES = {f.__name__: f for f in (html_export, stamps_by_specification, stamps_removed_by_role, image_layout, resized_pages, shrunk_pages, threads_of_kinds)}

_XML = "replace(replace(replace(replace(replace(regexp_replace({}, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', '', 'g'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;')"
_TURN = "turn % 5 = 2"
_SPEC = lambda spec, group, role, text, when, start=0: f"SELECT conv_id AS doc_id, turn AS page, {spec} AS spec, {role} AS role, {text} AS text FROM (SELECT *, count(*) OVER (PARTITION BY conv_id) AS total FROM conversations) c WHERE conv_id % 4 = {group} AND {when}"
_BATES = lambda start, digits, prefix, suffix: f"'{prefix}' || CASE WHEN length(CAST({start} + row_number() OVER (ORDER BY conv_id, turn) - 1 AS VARCHAR)) < {digits} THEN lpad(CAST({start} + row_number() OVER (ORDER BY conv_id, turn) - 1 AS VARCHAR), {digits}, '0') ELSE CAST({start} + row_number() OVER (ORDER BY conv_id, turn) - 1 AS VARCHAR) END || '{suffix}'"
_STAMPED = f"""
WITH s AS (
  {_SPEC(1, 0, "'header'", "'doc-' || conv_id || ' - ' || (turn + 1) || '/' || total", "true")}
  UNION ALL {_SPEC(2, 0, "'footer'", _BATES(1, 6, "N-", "-X"), "(turn = 0 OR turn BETWEEN 2 AND 9)")}
  UNION ALL {_SPEC(3, 1, "'watermark'", f"'DRAFT {DATE}'", "turn BETWEEN 1 AND 99")}
  UNION ALL {_SPEC(4, 2, "NULL", "'{{' || (turn + 1) || ' {{other}}'", "true")}
  UNION ALL {_SPEC(5, 2, "'footer'", _BATES(99_998, 3, "", ""), "turn BETWEEN 1 AND 3")}
), b AS (SELECT *, CASE WHEN page % 5 = 2 THEN 842.0 ELSE 595.0 END AS pw, CASE WHEN page % 5 = 2 THEN 595.0 ELSE 842.0 END AS ph, length(text) * [10, 8, 48, 9, 9][spec] * 0.5 AS w, [10, 8, 48, 9, 9][spec] * 1.2 AS h, radians([0, 0, 45, 90, 0][spec]) AS a FROM s),
t AS (SELECT *, w * abs(cos(a)) + h * abs(sin(a)) AS bw, w * abs(sin(a)) + h * abs(cos(a)) AS bh FROM b),
stamped AS (
  SELECT doc_id, page, spec, role, text, round(CAST(CASE spec WHEN 1 THEN (pw - bw) / 2 WHEN 2 THEN pw - 18 - bw WHEN 3 THEN (pw - bw) / 2 ELSE 12 END + (bw - w) / 2 AS DOUBLE), 4) + 0e0 AS x,
    round(CAST(CASE spec WHEN 1 THEN ph - 20 - bh WHEN 2 THEN 18 WHEN 3 THEN (ph - bh) / 2 WHEN 4 THEN 12 ELSE ph - 12 - bh END + (bh - h) / 2 AS DOUBLE), 4) + 0e0 AS y FROM t
)
"""
_LINES = r"""SELECT conv_id, turn, trim(x) AS t, CASE WHEN k > 0 THEN 11.0 WHEN turn % 3 = 0 THEN 24.0 WHEN turn % 3 = 1 THEN 14.5 ELSE 11.0 END AS size, k
FROM (SELECT conv_id, turn, unnest(string_split(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(10))) AS x, generate_subscripts(string_split(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(10)), 1) - 1 AS k FROM conversations)"""
ORACLES = {
    "html_export": f"""
WITH l AS (SELECT *, CASE WHEN length(t) > 200 OR size / 11.0 < 1.12 THEN 'p' WHEN size / 11.0 >= 1.6 THEN 'h1' WHEN size / 11.0 >= 1.3 THEN 'h2' ELSE 'h3' END AS tag FROM ({_LINES})),
p AS (SELECT conv_id, turn, coalesce(string_agg('<' || tag || '>' || {_XML.format("t")} || '</' || tag || '>' || chr(10), '' ORDER BY k) FILTER (WHERE t <> ''), '') AS html FROM l GROUP BY conv_id, turn),
d AS (SELECT conv_id AS doc_id, '<!DOCTYPE html>' || chr(10) || '<html>' || chr(10) || '<head>' || chr(10) || '<meta charset="utf-8">' || chr(10) || '<title>doc-' || conv_id || '</title>' || chr(10) || '<style>{STYLE}</style>' || chr(10) || '</head>' || chr(10) || '<body>' || chr(10) || string_agg(html, '<hr>' || chr(10) ORDER BY turn) || '</body>' || chr(10) || '</html>' || chr(10) AS x FROM p GROUP BY conv_id)
SELECT doc_id, sha256(x) AS sha256, length(x) AS length FROM d
""",
    "stamps_by_specification": f"{_STAMPED} SELECT * FROM stamped",
    "stamps_removed_by_role": f"{_STAMPED} SELECT doc_id, page, spec FROM stamped WHERE NOT (role IS NOT DISTINCT FROM 'footer' AND page BETWEEN 1 AND 3) AND page < 5",
    "image_layout": f"""
WITH i AS (SELECT page_id, CAST(50 + length(html) % 17000 AS DOUBLE) AS w, CAST(50 + length(html) * 7 % 1500 AS DOUBLE) AS h, CAST(page_id % 4 * 12.0 AS DOUBLE) AS m, page_id % 3 AS s FROM pages),
f AS (SELECT *, least((14400 - 2 * m) / w, (14400 - 2 * m) / h, 1) AS own, 
  CASE WHEN s = 1 THEN CASE WHEN w > h THEN {S.A4[1]} ELSE {S.A4[0]} END ELSE CASE WHEN w > h THEN 792.0 ELSE 612.0 END END AS pw, CASE WHEN s = 1 THEN CASE WHEN w > h THEN {S.A4[0]} ELSE {S.A4[1]} END ELSE CASE WHEN w > h THEN 612.0 ELSE 792.0 END END AS ph FROM i),
g AS (SELECT *, least(greatest(pw - 2 * m, 1) / w, greatest(ph - 2 * m, 1) / h) AS fit, greatest(w * own, 1) AS ow, greatest(h * own, 1) AS oh FROM f),
k AS (SELECT *, CASE WHEN page_id % 2 = 0 THEN fit ELSE least(fit, 1) END AS sc FROM g)
SELECT page_id, round(CAST(CASE WHEN s = 0 THEN ow + 2 * m ELSE pw END AS DOUBLE), 6) + 0e0 AS page_w, round(CAST(CASE WHEN s = 0 THEN oh + 2 * m ELSE ph END AS DOUBLE), 6) + 0e0 AS page_h, round(CAST(CASE WHEN s = 0 THEN m ELSE (pw - w * sc) / 2 END AS DOUBLE), 6) + 0e0 AS x,
  round(CAST(CASE WHEN s = 0 THEN m ELSE (ph - h * sc) / 2 END AS DOUBLE), 6) + 0e0 AS y, round(CAST(CASE WHEN s = 0 THEN ow ELSE w * sc END AS DOUBLE), 6) + 0e0 AS w, round(CAST(CASE WHEN s = 0 THEN oh ELSE h * sc END AS DOUBLE), 6) + 0e0 AS h FROM k
""",
    "resized_pages": f"""
WITH n AS (SELECT item_id AS page, length(text) AS n FROM benchmark WHERE text <> ''),
b AS (SELECT page, CAST(0 AS DOUBLE) AS l, CAST(least(n, {COLUMNS}) * 6 AS DOUBLE) AS r, CAST(800 - (n - 1) // {COLUMNS} * 14 AS DOUBLE) AS b, CAST(812 AS DOUBLE) AS t, CASE WHEN page % 3 = 0 THEN 890.0 ELSE {COLUMNS * 10.0} END AS cw FROM n),
s AS (SELECT *, CASE WHEN cw > 842 THEN {S.A4[1]} ELSE {S.A4[0]} END AS w, CASE WHEN cw > 842 THEN {S.A4[0]} ELSE {S.A4[1]} END AS h FROM b),
m AS (SELECT *, CAST(CASE WHEN page % 2 = 0 THEN least(w / CAST(cw AS DOUBLE), h / CAST(842 AS DOUBLE)) ELSE 1 END AS DOUBLE) AS sc FROM s),
p AS (SELECT *, (w - CAST(cw AS DOUBLE) * sc) / 2 - 10 * sc AS tx, (h - 842 * sc) / 2 AS ty FROM m)
SELECT page, round(sc, 6) AS scale, round(l * sc + tx, 4) + 0e0 AS l, round(b * sc + ty, 4) + 0e0 AS b, round(r * sc + tx, 4) + 0e0 AS r, round(t * sc + ty, 4) + 0e0 AS t, l * sc + tx >= 0 AND b * sc + ty >= 0 AND r * sc + tx <= w AND t * sc + ty <= h AS inside FROM p
""",
    "shrunk_pages": f"""
WITH p AS (SELECT conv_id AS doc_id, 400 + length(coalesce(text, '')) % 500 AS w, 400 + length(coalesce(text, '')) * 3 % 500 AS h FROM conversations),
t AS (SELECT *, sum(CASE WHEN w > h THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id) * 2 > count(*) OVER (PARTITION BY doc_id) AS turned FROM p)
SELECT doc_id, any_value(turned) AS turned, count(*) FILTER (WHERE w > CASE WHEN turned THEN {S.A4[1]} ELSE {S.A4[0]} END + 0.5 OR h > CASE WHEN turned THEN {S.A4[0]} ELSE {S.A4[1]} END + 0.5) AS shrunk FROM t GROUP BY doc_id
""",
    "threads_of_kinds": f"""{_THREADS}, listed AS (SELECT doc_id, page, CAST(note AS VARCHAR) AS id, note AS place FROM t WHERE depth = 0 AND (doc_id % 3 = 0 OR kind IN ('Note', 'Ink'))),
ghosts AS (SELECT doc_id, page, CASE WHEN note % 6 = 2 THEN 'g' ELSE '' END || note AS id, note + 10000 AS place FROM {_ANNOTS} WHERE note % 6 IN (0, 2) AND (doc_id % 3 = 0 OR kind IN ('Note', 'Ink')))
SELECT doc_id, page, string_agg(id, ',' ORDER BY place) AS notes FROM (SELECT * FROM listed UNION ALL SELECT * FROM ghosts g WHERE NOT EXISTS (SELECT 1 FROM listed l WHERE l.doc_id = g.doc_id AND l.page = g.page AND l.id = g.id)) GROUP BY doc_id, page
""",
}
