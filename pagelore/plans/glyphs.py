"""Queries over characters as boxes, marks, recognised text and page settings."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from pagelore.functions import text as T
from pagelore.operators import layout as L
from pagelore.sources import corpus

#: Characters stand in lines of this many, 6 points wide, 12 high, 14 apart.
COLUMNS = 40


def glyphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page, k, ch, l, b, r, t: the characters of each benchmark item on a page of its own."""
    found = corpus.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("page"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "")).alias("k", "ch")).filter("ch <> ''")
    left, line = (F.col("k") % COLUMNS) * 6.0, F.floor(F.col("k") / COLUMNS)
    return found.select("page", "k", "ch", left.alias("l"), (800.0 - line * 14.0).alias("b"), (left + 6.0).alias("r"), (812.0 - line * 14.0).alias("t"))


def marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page, mark, l, b, r, t: two marks on each page."""
    pages = corpus.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("page"))
    box = lambda m, l, b, r, t: F.struct(F.lit(m).alias("mark"), l.alias("l"), F.lit(b).alias("b"), r.alias("r"), F.lit(t).alias("t"))  # noqa: E731, E741
    shift = (F.col("page") % 7) * 6.0
    return pages.select("page", F.explode(F.array(box(0, shift + 12.0, 798.0, shift + 80.0, 813.0), box(1, shift + 100.0, 784.0, shift + 150.0, 799.0))).alias("m")).select("page", "m.*")


def _inside(tolerance: float):
    x, y = (F.col("g.l") + F.col("g.r")) / 2, (F.col("g.b") + F.col("g.t")) / 2
    return (x >= F.col("m.l") - tolerance) & (x <= F.col("m.r") + tolerance) & (y >= F.col("m.b") - tolerance) & (y <= F.col("m.t") + tolerance)


def quoted_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The characters whose centre is in a mark of their page, in order; what is left out between two is one space if any of it is blank."""
    g, m = glyphs(spark, sf_dir).alias("g"), marks(spark, sf_dir).alias("m")
    kept = g.join(m, (F.col("g.page") == F.col("m.page")) & _inside(1.0) & ~F.col("g.ch").rlike(r"^\s$"), "left_semi").select("page", "k", F.lit(True).alias("kept"))
    w = Window.partitionBy("page").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    rows = glyphs(spark, sf_dir).join(kept, ["page", "k"], "left").withColumn("last", F.max(F.when(F.col("kept"), F.col("k"))).over(w)).withColumn("blank", F.max(F.when(F.col("ch").rlike(r"^\s$"), F.col("k"))).over(w)).filter("kept")
    piece = F.concat(F.when(F.col("blank") > F.col("last"), " ").otherwise(""), F.col("ch"))
    return rows.groupBy("page").agg(F.array_join(F.sort_array(F.collect_list(F.struct("k", piece.alias("p"))))["p"], "").alias("quote"))


def mark_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters that a mark overlaps by more than a tenth of a point each way, and what else stands on those lines."""
    g, m = glyphs(spark, sf_dir).alias("g"), marks(spark, sf_dir).alias("m")
    over = (F.least("g.r", "m.r") - F.greatest("g.l", "m.l") > 0.1) & (F.least("g.t", "m.t") - F.greatest("g.b", "m.b") > 0.1)
    hit = g.join(m, (F.col("g.page") == F.col("m.page")) & over).select("g.page", "m.mark", "g.k", F.floor(F.col("g.k") / COLUMNS).alias("line"))
    return hit.groupBy("page", "mark").agg(F.count("*").alias("hit"), F.countDistinct("line").alias("lines"))


def range_rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters 30 to 99 of a page as one box for each line."""
    g = glyphs(spark, sf_dir).filter("k >= 30 AND k < 100 AND trim(ch) <> ''")
    return g.groupBy("page", "b").agg(F.min("l").alias("l"), F.max("r").alias("r"), F.max("t").alias("t"))


def missing_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible characters that are not there any more within half a point, after every ninth moved and every seventh went."""
    before = glyphs(spark, sf_dir).filter("trim(ch) <> ''")
    after = before.filter("k % 7 <> 0").withColumn("l", F.col("l") + F.when(F.col("k") % 9 == 0, 0.7).otherwise(0.2))
    cells = after.select("page", "ch", "b", F.col("l").alias("x"), F.explode(F.sequence(F.lit(-1), F.lit(1))).alias("d"))
    cells = cells.withColumn("cell", F.floor("x") + F.col("d")).drop("d")
    near = before.withColumn("cell", F.floor("l")).alias("g").join(cells.alias("a"), (F.col("g.page") == F.col("a.page")) & (F.col("g.ch") == F.col("a.ch")) & (F.col("g.cell") == F.col("a.cell")) & (F.abs(F.col("g.b") - F.col("a.b")) <= 0.5) & (F.abs(F.col("g.l") - F.col("a.x")) <= 0.5), "left_anti")
    return near.groupBy("page").agg(F.count("*").alias("missing"))


def upright_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of the characters in the frame where most of their page reads upright: the quarter turn of most visible ones (the smaller of two
    equal ones) is turned back. All but each fifth character of page p are turned p quarters here."""
    g = glyphs(spark, sf_dir).withColumn("turn", F.when(F.col("k") % 5 == 0, 0).otherwise((F.col("page") % 4).cast("int")))
    votes = g.filter(~F.col("ch").rlike(r"^\s$")).groupBy("page", "turn").agg(F.count("*").alias("n"))
    most = votes.groupBy("page").agg(F.max_by("turn", F.struct("n", -F.col("turn"))).alias("quarter"))
    q = F.coalesce("quarter", F.lit(0))
    turned = lambda a, b, c, d: F.when(q == 1, F.col(a)).when(q == 2, -F.col(b)).when(q == 3, -F.col(c)).otherwise(F.col(d)) + 0.0
    left, low = turned("b", "r", "t", "l"), F.when(q == 1, -F.col("r")).when(q == 2, -F.col("t")).when(q == 3, F.col("l")).otherwise(F.col("b")) + 0.0
    right, high = turned("t", "l", "b", "r"), F.when(q == 1, -F.col("l")).when(q == 2, -F.col("b")).when(q == 3, F.col("r")).otherwise(F.col("t")) + 0.0
    return g.join(most, "page", "left").select("page", "k", q.alias("quarter"), left.alias("l"), low.alias("b"), right.alias("r"), high.alias("t"))


def turned_back(q: Column, l: str = "l", b: str = "b", r: str = "r", t: str = "t") -> dict[str, Column]:  # noqa: E741
    """A box in the frame that is ``q`` quarter turns back."""
    pick = lambda *of: F.element_at(F.array(*of), q + 1)
    x0, y0, x1, y1 = (F.col(c) for c in (l, b, r, t))
    return {"l": pick(x0, y0, -x1, -y1), "b": pick(y0, -x1, -y1, x0), "r": pick(x1, y1, -x0, -y0), "t": pick(y1, -x0, -y0, x1)}


def upright_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and lines of pages that are drawn turned: in the frame where most visible characters read upright, characters are grouped to words
    and words to lines again. Page p is drawn p quarters turned, all but each fifth character; those stand apart in that frame."""
    g = glyphs(spark, sf_dir).withColumn("turn", F.when(F.col("k") % 5 == 0, 0).otherwise((F.col("page") % 4).cast("int")))
    drawn = turned_back((4 - F.col("turn")) % 4)
    g = g.select("page", "k", "ch", "turn", *[v.alias(c) for c, v in drawn.items()])
    votes = g.filter(~F.col("ch").rlike(r"^\s$")).groupBy("page", "turn").agg(F.count("*").alias("n"))
    most = votes.groupBy("page").agg(F.max_by("turn", F.struct("n", -F.col("turn"))).alias("quarter"))
    g = g.join(most, "page", "left").withColumn("quarter", F.coalesce("quarter", F.lit(0)))
    frame = turned_back(F.col("quarter"))
    chars = g.select(F.col("page").cast("int").alias("page"), F.col("k").cast("int").alias("k"), "ch", (frame["l"] + 0.0).alias("l"), (frame["r"] + 0.0).alias("r"), (frame["b"] + 0.0).alias("baseline"), F.lit(12.0).alias("size"))
    words = chars.groupBy("page").applyInPandas(L.word_boxes, f"{L.MERGED}, baseline double")
    order = Window.partitionBy("page").orderBy("k")
    fresh = F.coalesce((F.abs(F.col("baseline") - F.lag("baseline").over(order)) > 6.0).cast("int"), F.lit(1))
    return words.withColumn("fresh", fresh).select("page", (F.sum("fresh").over(order) - 1).cast("int").alias("line"), "k", "text", "l", "r", "baseline")


def layout_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The characters of a page back in lines of columns, blanks at the end cut."""
    g = glyphs(spark, sf_dir).withColumn("line", F.floor((812.0 - F.col("t")) / 14.0))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("l", "ch"))), lambda x: F.regexp_replace(x["ch"], r"\s", " ")), "")
    return g.groupBy("page", "line").agg(F.rtrim(text).alias("text"))


#: Recognised lines: text, confidence, words (text, confidence, left, right).
OCR = '{"lines":[{"text":"Hello wor ld","words":[["Hello",91.26,0,50],["wor",80.0,60,90],["ld",95.0,92,110]]},{"text":"noise","words":[["x",12.0,0,5],["yes",55.57,10,40]]},{"text":"한 글","words":[["한",70.0,0,10],["글",90.0,11,21]]}]}'
OCR_SCHEMA = "lines array<struct<text:string,words:array<array<string>>>>"


def ocr_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested recognition results as rows: words with a confidence of 30 or more, and their box."""
    lines = spark.range(1).select(F.posexplode(F.from_json(F.lit(OCR), OCR_SCHEMA)["lines"]).alias("line", "x"))
    words = lines.select("line", F.posexplode("x.words").alias("k", "w")).select("line", "k", F.col("w")[0].alias("text"), F.col("w")[1].cast("double").alias("confidence"), F.col("w")[2].cast("int").alias("l"), F.col("w")[3].cast("int").alias("r"))
    return words.filter("confidence >= 30")


def ocr_line_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidence of a line, weighted by the length of its words, to one decimal."""
    n = F.length("text")
    return ocr_words(spark, sf_dir).groupBy("line").agg((F.floor(F.sum(F.col("confidence") * n) / F.sum(n) * 10 + 0.5) / 10).alias("confidence"), F.count("*").alias("words"), F.min("l").alias("l"), F.max("r").alias("r"))


def ocr_merged_ideographs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring words of ideographs alone are one word."""
    w = Window.partitionBy("line").orderBy("k")
    alone = ocr_words(spark, sf_dir).withColumn("cjk", F.col("text").rlike(r"^[\p{IsHan}\p{IsHangul}\p{IsHiragana}\p{IsKatakana}]+$"))
    fresh = ~(F.col("cjk") & F.coalesce(F.lag("cjk").over(w), F.lit(False)))
    runs = alone.withColumn("g", F.sum(fresh.cast("int")).over(w))
    return runs.groupBy("line", "g").agg(F.array_join(F.sort_array(F.collect_list(F.struct("k", "text")))["text"], "").alias("text"), F.min("l").alias("l"), F.max("r").alias("r")).drop("g")


def utf16_word_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of items with their ranges in UTF-16 units: a code point over U+FFFF is two."""
    items = corpus.table(spark, sf_dir, "benchmark").select("item_id", F.concat(F.lit("🙂 "), "text").alias("t"))
    units = lambda s: F.length(s) + F.regexp_count(s, F.lit(r"[\x{10000}-\x{10FFFF}]"))
    found = items.select("item_id", "t", F.posexplode(T.matches(F.col("t"), f"{T.NOT_SPACE}+")).alias("k", "m"))
    start = units(F.expr("substring(t, 1, m.start)"))
    return found.select("item_id", "k", start.alias("start"), (start + units(F.col("m.text"))).alias("stop"))


@F.pandas_udf(StringType())
def nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def scoring_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as they are scored: composed, quotes and dashes made plain, soft hyphens gone, white space folded."""
    t = F.translate(F.translate(nfc("text"), "‘’‚“”„", "'''\"\"\""), "‐‑‒–—―−­", "-------")
    return corpus.documents(spark, sf_dir).select("doc_id", F.length(F.trim(F.regexp_replace(t, f"{T.SPACE}+", " "))).alias("chars"))


#: Languages asked for and installed, and the pick.
PICKS = (("kor,eng", "kor,eng,deu", "kor"), ("eng", "eng,kor", "eng"), ("fra,eng", "eng", "eng"), ("", "kor,eng", "kor"), ("deu,fra", "fra,deu", "deu"))


def language_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first language asked for that is not English and is installed, else English; nothing asked for means kor,eng."""
    rows = spark.createDataFrame([(a, b) for a, b, _ in PICKS], "asked string, installed string")
    asked = F.split(F.when(F.col("asked") == "", "kor,eng").otherwise(F.col("asked")), ",")
    found = F.filter(asked, lambda x: (x != "eng") & F.array_contains(F.split("installed", ","), x))
    return rows.select("asked", "installed", F.coalesce(F.get(found, F.lit(0)), F.lit("eng")).alias("pick"))


#: Appearance strings, their size, and their colour.
APPEARANCES = (("/Helv 12 Tf 1 0 0 rg", 12.0, "255,0,0"), ("0.5 0.5 2 rg /F1 9.5 Tf", 9.5, "128,128,255"), ("/Helv 0 Tf 0 g", 0.0, None), ("nothing", None, None))


def appearance_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The size before Tf, and the three numbers before rg as bytes."""
    rows = spark.createDataFrame([(a,) for a, *_ in APPEARANCES], "appearance string")
    number = r"([-+]?[0-9]*\.?[0-9]+)"
    size = F.regexp_extract("appearance", rf"{number}\s+Tf", 1)
    rgb = rf"{number}\s+{number}\s+{number}\s+rg"
    byte = lambda k: F.floor(F.least(F.greatest(F.nullif(F.regexp_extract("appearance", rgb, k), F.lit("")).cast("double"), F.lit(0.0)), F.lit(1.0)) * 255 + 0.5)
    colour = F.when(F.regexp_extract("appearance", rgb, 1) != "", F.concat_ws(",", byte(1), byte(2), byte(3)))
    return rows.select("appearance", F.nullif(size, F.lit("")).cast("double").alias("size"), colour.alias("colour"))


def signature_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as grey signatures of 0 to 255: similarity to the next one: 1 less a 24th of the mean difference; up to 2 is equal."""
    v = corpus.table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.round((x.cast("double") + 1) * 10)).alias("s"))
    pairs = v.alias("a").join(v.alias("b"), F.col("a.vec_id") + 1 == F.col("b.vec_id"))
    far = F.aggregate(F.zip_with("a.s", "b.s", lambda x, y: F.abs(x - y)), F.lit(0.0), lambda n, x: n + x) / F.size("a.s")
    return pairs.select("a.vec_id", F.round(F.when(far <= 2, 1.0).otherwise(F.greatest(1 - far / 24, F.lit(0.0))), 9).alias("similarity"))


#: Anchors of a stamp on a page, as parts of the free width and height.
ANCHORS = {"topLeft": (0, 1), "top": (0.5, 1), "topRight": (1, 1), "left": (0, 0.5), "center": (0.5, 0.5), "right": (1, 0.5), "bottomLeft": (0, 0), "bottom": (0.5, 0), "bottomRight": (1, 0)}


def anchor_origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lower left corners of a stamp of 100 by 40, turned by 30 degrees, at each anchor of a sheet with margins of 36."""
    rows = spark.createDataFrame([(a, float(x), float(y)) for a, (x, y) in ANCHORS.items()], "anchor string, fx double, fy double")
    angle = F.radians(F.lit(30.0))
    w, h = F.lit(100.0) * F.cos(angle) + F.lit(40.0) * F.sin(angle), F.lit(100.0) * F.sin(angle) + F.lit(40.0) * F.cos(angle)
    return rows.select("anchor", F.round(36 + F.col("fx") * (595 - 72 - w), 6).alias("x"), F.round(36 + F.col("fy") * (842 - 72 - h), 6).alias("y"))


def pixel_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pixel of a scan at 150 dots an inch as a point of the page, for each turn of a page of 595 by 842."""
    rows = spark.createDataFrame([(r, x, y) for r in (0, 90, 180, 270) for x, y in ((0, 0), (300, 150))], "rotation int, px int, py int")
    x, y = F.col("px") * 0.48, F.col("py") * 0.48
    turn = F.col("rotation")
    px = F.when(turn == 0, x).when(turn == 90, y).when(turn == 180, 595 - x).otherwise(595 - y)
    py = F.when(turn == 0, 842 - y).when(turn == 90, x).when(turn == 180, y).otherwise(842 - x)
    return rows.select("rotation", "px", "py", F.round(px, 6).alias("x"), F.round(py, 6).alias("y"))


def recovery_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sidecars (purchases) that have their file (an event of the same user and hour that is no purchase) and no living owner (the user doesn't
    click within the day after), newest first for each user."""
    e = corpus.table(spark, sf_dir, "events").withColumn("hour", F.date_trunc("hour", "ts"))
    side = e.filter("event_type = 'purchase'").alias("s")
    click = e.filter("event_type = 'click'").select("user_id", F.col("ts").alias("clicked")).alias("c")
    side = side.join(click, (F.col("s.user_id") == F.col("c.user_id")) & (F.col("clicked") > F.col("ts")) & (F.col("clicked") <= F.col("ts") + F.expr("INTERVAL 1 DAY")), "left_anti")
    files = e.filter("event_type <> 'purchase'").select("user_id", "hour").distinct()
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return side.join(files, ["user_id", "hour"], "left_semi").select("user_id", "event_id", F.row_number().over(w).cast("bigint").alias("place"))


def list_without_doubles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths added one after another: one that is there already, whatever its case and slashes, is left out."""
    pages = corpus.table(spark, sf_dir, "pages").select("page_id", T.path_key(F.regexp_replace("url", r"[?#].*$", "")).alias("key"))
    return pages.groupBy("key").agg(F.min("page_id").alias("page_id"))


def metadata_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A patch on each document's fields: absent keeps, empty clears, else replaces."""
    docs = corpus.table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    patch = F.when(F.col("doc_id") % 3 == 0, F.lit("")).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("new-"), F.col("doc_id").cast("string")))
    return docs.select("doc_id", "lang", F.when(patch.isNull(), F.col("source")).when(patch != "", patch).alias("source"))


def sanitize_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scripts and comments taken out of pages, how many, and whether the page changed at all."""
    script, comment = r"(?is)<script\b.*?</script>", r"(?s)<!--.*?-->"
    p = corpus.table(spark, sf_dir, "pages")
    clean = F.regexp_replace(F.regexp_replace("html", script, ""), comment, "")
    return p.select("page_id", F.regexp_count("html", F.lit(script)).alias("scripts"), F.length(clean).alias("left"), (clean != F.col("html")).alias("changed"))


QUERIES = {f.__name__: f for f in (quoted_text, mark_hits, range_rects, missing_characters, upright_frame, upright_words, layout_lines, ocr_words, ocr_line_confidence, ocr_merged_ideographs, utf16_word_ranges, scoring_text, language_pick, appearance_parse, signature_similarity, anchor_origins, pixel_points, recovery_entries, list_without_doubles, metadata_merge, sanitize_counts)}

_G = "(SELECT item_id AS page, k, ch, (k % 40) * 6e0 AS l, 800e0 - (k // 40) * 14 AS b, (k % 40) * 6e0 + 6 AS r, 812e0 - (k // 40) * 14 AS t FROM (SELECT item_id, unnest(string_split(text, '')) AS ch, generate_subscripts(string_split(text, ''), 1) - 1 AS k FROM benchmark))"
_M = "(SELECT item_id AS page, mark, (item_id % 7) * 6e0 + ml AS l, b, (item_id % 7) * 6e0 + mr AS r, t FROM benchmark, (VALUES (0, 12e0, 798e0, 80e0, 813e0), (1, 100e0, 784e0, 150e0, 799e0)) x(mark, ml, b, mr, t))"


def _rows(rows: tuple, names: str) -> str:
    quote = lambda x: "NULL" if x is None else f"{x!r}e0" if isinstance(x, float) else "'" + x + "'"
    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(quote, r)) + ")" for r in rows) + f") t({names})"


ORACLES = {
    "quoted_text": f"""
WITH g AS (SELECT *, NOT regexp_matches(ch, '^\\s$') AND EXISTS (SELECT 1 FROM {_M} m WHERE m.page = g.page AND (g.l + g.r) / 2 BETWEEN m.l - 1 AND m.r + 1 AND (g.b + g.t) / 2 BETWEEN m.b - 1 AND m.t + 1) AS kept FROM {_G} g),
w AS (SELECT *, max(CASE WHEN kept THEN k END) OVER x AS last, max(CASE WHEN regexp_matches(ch, '^\\s$') THEN k END) OVER x AS blank FROM g WINDOW x AS (PARTITION BY page ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT page, string_agg(CASE WHEN blank > last THEN ' ' ELSE '' END || ch, '' ORDER BY k) AS quote FROM w WHERE kept GROUP BY page
""",
    "mark_hits": f"SELECT g.page, m.mark, count(*) AS hit, count(DISTINCT g.k // 40) AS lines FROM {_G} g JOIN {_M} m ON g.page = m.page AND least(g.r, m.r) - greatest(g.l, m.l) > 0.1 AND least(g.t, m.t) - greatest(g.b, m.b) > 0.1 GROUP BY ALL",
    "range_rects": f"SELECT page, b, min(l) AS l, max(r) AS r, max(t) AS t FROM {_G} WHERE k >= 30 AND k < 100 AND trim(ch) <> '' GROUP BY page, b",
    "upright_frame": rf"""
WITH g AS (SELECT *, CAST(CASE WHEN k % 5 = 0 THEN 0 ELSE page % 4 END AS INTEGER) AS turn FROM {_G}),
v AS (SELECT page, turn, row_number() OVER (PARTITION BY page ORDER BY count(*) DESC, turn) AS place FROM g WHERE NOT regexp_matches(ch, '^\s$') GROUP BY page, turn),
u AS (SELECT page, k, coalesce(v.turn, 0) AS quarter, l, b, r, t FROM g LEFT JOIN (SELECT page, turn FROM v WHERE place = 1) v USING (page))
SELECT page, k, quarter, CASE quarter WHEN 1 THEN b WHEN 2 THEN -r WHEN 3 THEN -t ELSE l END + 0e0 AS l, CASE quarter WHEN 1 THEN -r WHEN 2 THEN -t WHEN 3 THEN l ELSE b END + 0e0 AS b,
  CASE quarter WHEN 1 THEN t WHEN 2 THEN -l WHEN 3 THEN -b ELSE r END + 0e0 AS r, CASE quarter WHEN 1 THEN -l WHEN 2 THEN -b WHEN 3 THEN r ELSE t END + 0e0 AS t FROM u
""",
    "upright_words": rf"""
WITH g AS (SELECT *, CAST(CASE WHEN k % 5 = 0 THEN 0 ELSE page % 4 END AS INTEGER) AS turn FROM {_G}),
v AS (SELECT page, turn, row_number() OVER (PARTITION BY page ORDER BY count(*) DESC, turn) AS place FROM g WHERE NOT regexp_matches(ch, '^\s$') GROUP BY page, turn),
q AS (SELECT g.*, (coalesce(v.turn, 0) - g.turn + 4) % 4 AS q FROM g LEFT JOIN (SELECT page, turn FROM v WHERE place = 1) v USING (page)),
f AS (SELECT page, k, ch, CAST(CASE q WHEN 1 THEN b WHEN 2 THEN -r WHEN 3 THEN -t ELSE l END AS DOUBLE) AS l, CAST(CASE q WHEN 1 THEN -r WHEN 2 THEN -t WHEN 3 THEN l ELSE b END AS DOUBLE) AS b, CAST(CASE q WHEN 1 THEN t WHEN 2 THEN -l WHEN 3 THEN -b ELSE r END AS DOUBLE) AS r FROM q),
n AS (SELECT *, sum(CASE WHEN p IS NULL OR regexp_matches(p, '^\s$') OR abs(b - pb) > 6 OR l - pr > 3 OR l - pr < -6 THEN 1 ELSE 0 END) OVER (PARTITION BY page ORDER BY k) AS w
  FROM (SELECT *, lag(ch) OVER o AS p, lag(b) OVER o AS pb, lag(r) OVER o AS pr FROM f WINDOW o AS (PARTITION BY page ORDER BY k))),
words AS (SELECT page, row_number() OVER (PARTITION BY page ORDER BY w) - 1 AS k, string_agg(ch, '' ORDER BY k) AS text, min(l) AS l, max(r) AS r, first(b ORDER BY k) AS baseline FROM n WHERE NOT regexp_matches(ch, '^\s$') GROUP BY page, w)
SELECT CAST(page AS INTEGER) AS page, CAST(sum(fresh) OVER (PARTITION BY page ORDER BY k) - 1 AS INTEGER) AS line, CAST(k AS INTEGER) AS k, text, l + 0e0 AS l, r + 0e0 AS r, baseline + 0e0 AS baseline
FROM (SELECT *, CASE WHEN abs(baseline - lag(baseline) OVER (PARTITION BY page ORDER BY k)) <= 6 THEN 0 ELSE 1 END AS fresh FROM words)
""",
    "missing_characters": f"""
WITH g AS (SELECT * FROM {_G} WHERE trim(ch) <> ''), a AS (SELECT page, ch, b, l + CASE WHEN k % 9 = 0 THEN 0.7e0 ELSE 0.2e0 END AS x FROM g WHERE k % 7 <> 0)
SELECT page, count(*) AS missing FROM g WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.page = g.page AND a.ch = g.ch AND abs(a.b - g.b) <= 0.5 AND abs(a.x - g.l) <= 0.5) GROUP BY page
""",
    "layout_lines": "SELECT item_id AS page, j AS line, rtrim(regexp_replace(substr(text, CAST(j * 40 + 1 AS BIGINT), 40), '\\s', ' ', 'g')) AS text FROM benchmark, range(10000) t(j) WHERE j * 40 < length(text)",
    "ocr_words": "SELECT * FROM (VALUES (0, 0, 'Hello', 91.26e0, 0, 50), (0, 1, 'wor', 80e0, 60, 90), (0, 2, 'ld', 95e0, 92, 110), (1, 1, 'yes', 55.57e0, 10, 40), (2, 0, '한', 70e0, 0, 10), (2, 1, '글', 90e0, 11, 21)) t(line, k, text, confidence, l, r)",
    "ocr_line_confidence": "SELECT * FROM (VALUES (0, 88.6e0, CAST(3 AS BIGINT), 0, 110), (1, 55.6e0, 1, 10, 40), (2, 80e0, 2, 0, 21)) t(line, confidence, words, l, r)",
    "ocr_merged_ideographs": "SELECT * FROM (VALUES (0, 'Hello', 0, 50), (0, 'wor', 60, 90), (0, 'ld', 92, 110), (1, 'yes', 10, 40), (2, '한글', 0, 21)) t(line, text, l, r)",
    "utf16_word_ranges": r"""
WITH i AS (SELECT item_id, '🙂 ' || text AS t FROM benchmark), w AS (SELECT item_id, regexp_extract_all(t, '[^\s\p{Z}\x{85}]+') AS w, string_split_regex(t, '[^\s\p{Z}\x{85}]+') AS g FROM i), r AS (SELECT item_id, w, g, unnest(range(len(w))) AS k FROM w)
SELECT item_id, CAST(k AS INTEGER) AS k, CAST(s + CASE WHEN k > 0 THEN 1 ELSE 0 END AS INTEGER) AS start, CAST(s + length(w[k + 1]) + 1 AS INTEGER) AS stop
FROM (SELECT *, coalesce(list_sum(list_transform(w[1:k], lambda x: length(x))), 0) + list_sum(list_transform(g[1:k + 1], lambda x: length(x))) AS s FROM r)
""",
    "scoring_text": r"""
SELECT doc_id, CAST(length(trim(regexp_replace(translate(translate(nfc_normalize(coalesce(text, '')), '‘’‚“”„', repeat(chr(39), 3) || repeat(chr(34), 3)), '‐‑‒–—―−' || chr(173), '-------'), '[\s\p{Z}\x{85}]+', ' ', 'g'))) AS INTEGER) AS chars FROM documents
""",
    "language_pick": _rows(PICKS, "asked, installed, pick"),
    "appearance_parse": _rows(APPEARANCES, "appearance, size, colour"),
    "signature_similarity": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: round((CAST(x AS DOUBLE) + 1) * 10)) AS s FROM embeddings), p AS (SELECT a.vec_id, list_sum(list_transform(range(1, len(a.s) + 1), lambda k: abs(a.s[k] - b.s[k]))) / len(a.s) AS far FROM v a JOIN v b ON b.vec_id = a.vec_id + 1)
SELECT vec_id, round(CASE WHEN far <= 2 THEN 1 ELSE greatest(1 - far / 24, 0) END, 9) AS similarity FROM p
""",
    "anchor_origins": "SELECT anchor, round(36 + fx * (595 - 72 - (100 * cos(radians(30)) + 40 * sin(radians(30)))), 6) AS x, round(36 + fy * (842 - 72 - (100 * sin(radians(30)) + 40 * cos(radians(30)))), 6) AS y FROM (VALUES " + ", ".join(f"('{a}', {x}e0, {y}e0)" for a, (x, y) in ANCHORS.items()) + ") t(anchor, fx, fy)",
    "pixel_points": """
SELECT rotation, px, py, CASE rotation WHEN 0 THEN x WHEN 90 THEN y WHEN 180 THEN 595 - x ELSE 595 - y END AS x, CASE rotation WHEN 0 THEN 842 - y WHEN 90 THEN x WHEN 180 THEN y ELSE 842 - x END AS y
FROM (SELECT *, px * 72e0 / 150 AS x, py * 72e0 / 150 AS y FROM (VALUES (0), (90), (180), (270)) r(rotation), (VALUES (0, 0), (300, 150)) p(px, py))
""",
    "recovery_entries": """
SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place FROM events s
WHERE event_type = 'purchase' AND NOT EXISTS (SELECT 1 FROM events c WHERE c.user_id = s.user_id AND c.event_type = 'click' AND c.ts > s.ts AND c.ts <= s.ts + INTERVAL 1 DAY) AND EXISTS (SELECT 1 FROM events f WHERE f.user_id = s.user_id AND f.event_type <> 'purchase' AND date_trunc('hour', f.ts) = date_trunc('hour', s.ts))
""",
    "list_without_doubles": "SELECT replace(lower(regexp_replace(url, '[?#].*$', '')), chr(92), '/') AS key, min(page_id) AS page_id FROM pages GROUP BY key",
    "metadata_merge": "SELECT doc_id, lang, CASE doc_id % 3 WHEN 0 THEN NULL WHEN 1 THEN 'new-' || doc_id ELSE source END AS source FROM documents",
    "sanitize_counts": r"""
SELECT page_id, CAST(len(regexp_extract_all(html, '(?is)<script\b.*?</script>')) AS INTEGER) AS scripts, CAST(length(c) AS INTEGER) AS left, c <> html AS changed
FROM (SELECT page_id, html, regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script>', '', 'g'), '(?s)<!--.*?-->', '', 'g') AS c FROM pages)
""",
}
