"""Queries of structure: threads, outlines, headings, running heads, paragraphs, sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagelore.functions import text as T
from pagelore.operators import layout as L
from pagelore.sources import corpus
from pagelore.sources.scratch import stored

#: Shapes of numbered headings and their levels, in order of trial.
NUMBERED = (
    (r"^제\s*\d+\s*[장편부]", 1),
    (r"^제\s*\d+\s*절", 2),
    (r"^[ⅠⅡⅢⅣⅤⅥⅦⅧⅨⅩⅪⅫ]+[.)\s]", 1),
    (r"^[IVX]{1,5}\.\s", 1),
    (r"^\d{1,2}\.\d{1,2}\.\d{1,2}\.?\s", 3),
    (r"^\d{1,2}\.\d{1,2}\.?\s", 2),
    (r"^\d{1,2}\.\s+\S", 1),
    (r"^[가-하]\.\s", 3),
)


def numbering_level(text: Column) -> Column:
    out = F.lit(None).cast("int")
    for shape, level in reversed(NUMBERED):
        out = F.when(F.trim(text).rlike(shape), level).otherwise(out)
    return out


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's notes: turn n answers turn (n - 1) div 2; the turns whose number is 5 answer one that isn't there."""
    turns = corpus.pages(spark, sf_dir)
    return turns.select("doc_id", F.col("page").alias("note"), F.when(F.col("page") == 5, F.lit(-1)).when(F.col("page") > 0, F.floor((F.col("page") - 1) / 2)).cast("bigint").alias("answers"), F.length("text").alias("length"))


def attached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes with the parent that is on the page, else null: those are roots."""
    own = notes(spark, sf_dir)
    there = own.select("doc_id", F.col("note").alias("answers"), F.lit(True).alias("there"))
    return own.join(there, ["doc_id", "answers"], "left").select("doc_id", "note", F.when(F.col("there") & (F.col("answers") != F.col("note")), F.col("answers")).alias("parent"), "length")


def walked(nodes: DataFrame) -> DataFrame:
    """doc_id, note, parent, ... with path, the notes from the root down to each. Each round joins what is above, so paths double: as many
    rounds as the depth has binary digits, each a table. What hangs on a circle has no root and goes."""
    kept = [c for c in nodes.columns if c not in ("doc_id", "note", "parent")]
    now = nodes.select("doc_id", "note", F.col("parent").alias("up"), F.array("note").alias("path"), *kept)
    while True:
        now = stored(now, "paths")
        if not now.filter("up IS NOT NULL").head(1):
            return now.drop("up")
        above = now.select("doc_id", F.col("note").alias("up"), F.col("up").alias("next"), F.col("path").alias("before"))
        joined = now.filter("up IS NOT NULL").join(above, ["doc_id", "up"]).filter(~F.arrays_overlap("before", "path"))
        now = now.filter("up IS NULL").unionByName(joined.select("doc_id", "note", F.col("next").alias("up"), F.concat("before", "path").alias("path"), *kept))


def thread_depth_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threads depth first, answers in order: place and depth of each note."""
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("path"))
    return walked(attached(spark, sf_dir)).select("doc_id", "note", (F.size("path") - 1).alias("depth"), place.alias("place"))


def thread_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each answer under the root of its thread, shortest first."""
    answers = walked(attached(spark, sf_dir)).filter(F.size("path") > 1).withColumn("root", F.col("path")[0])
    return answers.select("doc_id", "root", "note", F.row_number().over(Window.partitionBy("doc_id", "root").orderBy("length", "note")).alias("place"))


def thread_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that answers a note, at any depth."""
    above = walked(attached(spark, sf_dir)).select("doc_id", F.explode(F.slice("path", F.lit(1), F.size("path") - 1)).alias("note"))
    return above.groupBy("doc_id", "note").agg(F.count("*").alias("answers"))


#: node, parent, order among siblings, title, page, collapsed
OUTLINE = ((1, None, 0, "One", 0, False), (2, 1, 0, "One A", 1, False), (3, 1, 1, "One B", 2, True), (4, 3, 0, "One B i", 2, False), (5, None, 1, "Two", 5, False), (6, 5, 0, "Two A", 6, False), (7, 6, 0, "Two A i", 7, False))


def outline_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An outline in order with depths; what a collapsed node holds is hidden."""
    nodes = spark.createDataFrame(list(OUTLINE), "node int, parent int, ord int, title string, page int, collapsed boolean")
    return spark.sql(
        """
        WITH RECURSIVE walk(node, title, page, collapsed, depth, path) AS (
          SELECT node, title, page, collapsed, 0, array(ord) FROM {nodes} WHERE parent IS NULL
          UNION ALL SELECT n.node, n.title, n.page, n.collapsed, w.depth + 1, concat(w.path, array(n.ord)) FROM {nodes} n JOIN walk w ON n.parent = w.node AND NOT w.collapsed
        ) SELECT row_number() OVER (ORDER BY path) AS place, depth, title, page FROM walk
        """,
        nodes=nodes,
    )


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = corpus.documents(spark, sf_dir)
    found = docs.select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("k", "line"))
    return found.withColumn("line", F.trim(F.regexp_replace("line", f"{T.SPACE}+", " "))).filter("line <> ''")


def outline_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outline nodes as they read back: a link that isn't blank takes the place of the page; a zoom of zero or less is none; only nodes that hold
    others are open or shut, open if nothing is said. An outline with a page beyond its ten is rejected as a whole. Nodes are pages here, ten
    to an outline, each below the one of half its number."""
    n = F.col("page_id") % 10
    nodes = corpus.table(spark, sf_dir, "pages").select(
        F.floor(F.col("page_id") / 10).alias("outline"),
        n.alias("node"),
        F.when(n > 0, F.floor((n - 1) / 2)).alias("parent"),
        F.when(F.floor(F.col("page_id") / 10) % 7 == 0, n + 1).otherwise(n).alias("to"),
        F.when(n % 4 == 3, F.concat("url", F.lit(" \u00e9"))).when(n % 4 == 2, " ").alias("link"),
        (n - 2).alias("view"),
        F.when(n % 3 != 0, n % 2 == 0).alias("said"),
    )
    url = F.when(F.trim("link") != "", T.uri_7bit(F.trim("link")))
    nodes = nodes.withColumn("url", url).withColumn("page", F.when(F.col("url").isNull(), F.col("to")))
    bad = nodes.groupBy("outline").agg(F.coalesce(F.bool_or(F.col("page") >= 10), F.lit(False)).alias("rejected"))
    holds = nodes.filter("parent IS NOT NULL").select("outline", F.col("parent").alias("node"), F.lit(True).alias("holds")).distinct()
    rows = nodes.join(bad, "outline").join(holds, ["outline", "node"], "left")
    zoom = F.when(F.col("page").isNotNull() & (F.col("view") > 0), F.col("view"))
    return rows.select("outline", "node", "page", zoom.alias("zoom"), "url", F.when(F.col("holds"), F.coalesce("said", F.lit(True))).alias("open"), "rejected")


def running_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines, digits as #, that stand in three documents of a source or more, and in a fiftieth of them."""
    found = lines(spark, sf_dir).select("source", "doc_id", F.regexp_replace("line", r"\d+", "#").alias("line")).distinct()
    whole = corpus.documents(spark, sf_dir).groupBy("source").agg(F.count("*").alias("docs"))
    return found.groupBy("source", "line").agg(F.count("*").alias("on_docs")).join(whole, "source").filter("on_docs >= greatest(3, 0.02 * docs)").select("source", F.sha2("line", 256).alias("line_sha256"), "on_docs")


HEADINGS = ("제3장 결론", "제 2 절 방법", "1.2 목적", "1.2.3 세부", "2024년 실적", "Ⅳ. 끝", "IV. End", "3. Results", "가. 하나", "12", "plain text")


def numbered_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(t,) for t in HEADINGS], "title string").select("title", numbering_level(F.col("title")).alias("level"))


def sized_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their lines as an array of (k, length, size): the type size is from a line's place, the first of every tenth document is
    large. Lines without a character are left out."""
    size = lambda k: F.when((k == 0) & (F.col("doc_id") % 10 == 0), 24.0).when(k % 7 == 3, 14.0).otherwise(11.0)
    folded = F.split(F.regexp_replace("text", r"[\s\p{Z}\x{85}&&[^\n]]+", " "), "\n")
    found = F.transform(folded, lambda x, k: F.struct(k.alias("k"), F.length(F.trim(x)).alias("length"), size(k).alias("size")))
    return corpus.documents(spark, sf_dir).select("doc_id", F.filter(found, lambda x: x["length"] > 0).alias("lines"))


def body_size(lines: Column) -> Column:
    """The size with the most characters, in halves; the larger one on a tie; null without lines."""
    half = lambda x: F.floor(x["size"] * 2 + 0.5) / 2
    chars = lambda s: F.aggregate(lines, F.lit(0), lambda a, x: a + F.when(half(x) == s, x["length"]).otherwise(0))
    return F.array_max(F.transform(F.array_distinct(F.transform(lines, half)), lambda s: F.struct(chars(s).alias("chars"), s.alias("size"))))["size"]


def body_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sized_lines(spark, sf_dir).select("doc_id", body_size(F.col("lines")).alias("body")).filter("body IS NOT NULL")


def headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines over the body size by 1.12, 1.3 or 1.6 are headings of level 3, 2 or 1, if they are short. Only headings leave the document's
    array, so nothing is shuffled."""

    def level(x: Column, body: Column) -> Column:
        ratio = x["size"] / body
        return F.when(x["length"] > 200, 0).when(ratio >= 1.6, 1).when(ratio >= 1.3, 2).when(ratio >= 1.12, 3).otherwise(0)

    ranked = T.let(body_size(F.col("lines")), lambda body: F.transform("lines", lambda x: F.struct(x["k"].alias("k"), level(x, body).alias("level"), x["length"].alias("length"))))
    found = sized_lines(spark, sf_dir).select("doc_id", F.filter(ranked, lambda x: x["level"] > 0).alias("h"))
    # outer, so that no guess about the array's size works it out again
    return found.select("doc_id", F.inline_outer("h")).filter("k IS NOT NULL")


def heading_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings nested by level: the nearest one before with a smaller level is the parent."""
    h = headings(spark, sf_dir)
    w = Window.partitionBy("doc_id").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    up = [F.max(F.when(F.col("level") == v, F.col("k"))).over(w) for v in (1, 2)]
    return h.select("doc_id", "k", "level", F.when(F.col("level") == 2, up[0]).when(F.col("level") == 3, F.greatest(*up)).alias("parent"))


def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.documents(spark, sf_dir).select("doc_id", "text").mapInPandas(L.split_sentences, L.SENTENCES)


#: Lines of a page: text, size, baseline, left edge.
PAGE_LINES = (("A Title", 24.0, 700.0, 72.0), ("The first line of a para-", 11.0, 660.0, 72.0), ("graph goes on", 11.0, 646.0, 72.0), ("Another block", 11.0, 600.0, 72.0), ("far to the right", 11.0, 586.0, 300.0))


def paragraph_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(0, k, *x) for k, x in enumerate(PAGE_LINES)], "page int, k int, text string, size double, baseline double, left double")
    return rows.groupBy("page").applyInPandas(L.paragraphs, L.PARAGRAPHS)


def word_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters of items as boxes of 6 by 12 points, wider gaps after each comma, grouped to words."""
    items = corpus.table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("int").alias("page"), F.posexplode(F.split("text", "")).alias("k", "ch")).filter("ch <> ''")
    gap = F.sum(F.when(F.col("ch") == ",", 5.0).otherwise(0.0)).over(Window.partitionBy("page").orderBy("k").rowsBetween(Window.unboundedPreceding, -1))
    left = F.col("k") * 6.0 + F.coalesce(gap, F.lit(0.0))
    chars = items.select("page", "k", "ch", left.alias("l"), (left + 6.0).alias("r"), F.lit(0.0).alias("baseline"), F.lit(12.0).alias("size"))
    return chars.groupBy("page").applyInPandas(L.word_boxes, f"{L.MERGED}, baseline double").drop("baseline")


#: Marks of content runs in order, and the tree's order of marks; -1 joins what stands before.
MARKS, TREE = (-1, -1, 2, 2, 1, 1, 9), (1, 2)


def tagged_run_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of one mark, ordered by the mark's place in the tree, unknown marks last; neighbours that follow each other are one."""
    rows = spark.createDataFrame(list(enumerate(MARKS)), "at int, mark int")
    w = Window.orderBy("at")
    known = rows.withColumn("m", F.last(F.when(F.col("mark") >= 0, F.col("mark")), ignorenulls=True).over(w))
    runs = known.withColumn("g", F.sum((~F.col("m").eqNullSafe(F.lag("m").over(w))).cast("int")).over(w)).groupBy("g", "m").agg(F.min("at").alias("start"), (F.max("at") + 1).alias("stop"))
    place = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, TREE)), F.col("m")), F.lit(0)), F.lit(len(TREE) + 1))
    order = Window.orderBy("p", "start")
    runs = runs.withColumn("p", place).withColumn("fresh", (~F.col("start").eqNullSafe(F.lag("stop").over(order))).cast("int")).withColumn("k", F.sum("fresh").over(order))
    return runs.groupBy("k").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))


QUERIES = {f.__name__: f for f in (thread_depth_first, thread_flat, thread_descendants, outline_flatten, outline_normalised, running_headers, numbered_headings, body_sizes, headings, heading_parents, sentence_split, paragraph_flow, word_boxes, tagged_run_order)}

_DUCK_WALK = """
WITH RECURSIVE notes AS (
  SELECT conv_id AS doc_id, turn AS note, length(text) AS length, CASE WHEN turn = 5 OR turn = 0 THEN NULL ELSE (turn - 1) // 2 END AS p FROM conversations
), attached AS (SELECT n.doc_id, n.note, n.length, q.note AS parent FROM notes n LEFT JOIN notes q ON q.doc_id = n.doc_id AND q.note = n.p),
walk AS (
  SELECT doc_id, note, 0 AS depth, [note] AS path, note AS root, length FROM attached WHERE parent IS NULL
  UNION ALL SELECT n.doc_id, n.note, w.depth + 1, list_append(w.path, n.note), w.root, n.length FROM attached n JOIN walk w ON n.doc_id = w.doc_id AND n.parent = w.note
)
"""
_LINES = r"(SELECT doc_id, source, k, line FROM (SELECT doc_id, source, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS k, trim(regexp_replace(unnest(string_split(text, chr(10))), '[\s\p{Z}\x{85}]+', ' ', 'g')) AS line FROM documents) WHERE line <> '')"
_SIZED = f"(SELECT doc_id, k, line, CASE WHEN k = 0 AND doc_id % 10 = 0 THEN 24e0 WHEN k % 7 = 3 THEN 14e0 ELSE 11e0 END AS size FROM {_LINES})"
_BODY = f"(SELECT doc_id, size AS body FROM (SELECT doc_id, size, row_number() OVER (PARTITION BY doc_id ORDER BY sum(length(line)) DESC, size DESC) AS r FROM {_SIZED} GROUP BY doc_id, size) WHERE r = 1)"
_HEADINGS = f"(SELECT doc_id, CAST(k AS INTEGER) AS k, CAST(level AS INTEGER) AS level, CAST(length(line) AS INTEGER) AS length FROM (SELECT doc_id, k, line, CASE WHEN length(line) > 200 THEN 0 WHEN size / body >= 1.6 THEN 1 WHEN size / body >= 1.3 THEN 2 WHEN size / body >= 1.12 THEN 3 ELSE 0 END AS level FROM {_SIZED} JOIN {_BODY} USING (doc_id)) WHERE level > 0)"
ORACLES = {
    "thread_depth_first": _DUCK_WALK + "SELECT doc_id, note, depth, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY path) AS INTEGER) AS place FROM walk",
    "thread_flat": _DUCK_WALK + "SELECT doc_id, root, note, CAST(row_number() OVER (PARTITION BY doc_id, root ORDER BY length, note) AS INTEGER) AS place FROM walk WHERE depth > 0",
    "thread_descendants": _DUCK_WALK + "SELECT doc_id, a AS note, count(*) AS answers FROM (SELECT doc_id, unnest(path[:-2]) AS a FROM walk WHERE depth > 0) GROUP BY doc_id, a",
    "outline_flatten": "SELECT * FROM (VALUES (1, 0, 'One', 0), (2, 1, 'One A', 1), (3, 1, 'One B', 2), (4, 0, 'Two', 5), (5, 1, 'Two A', 6), (6, 2, 'Two A i', 7)) t(place, depth, title, page)",
    "outline_normalised": r"""
WITH n AS (SELECT page_id // 10 AS outline, page_id % 10 AS node, url AS u FROM pages),
x AS (SELECT outline, node, CASE WHEN outline % 7 = 0 THEN node + 1 ELSE node END AS goes,
  CASE WHEN node % 4 = 3 THEN array_to_string(list_transform(string_split(u || ' ' || chr(233), ''), lambda c: CASE WHEN ord(c) BETWEEN 33 AND 126 THEN c ELSE regexp_replace(hex(encode(c)), '(..)', '%\1', 'g') END), '') END AS url FROM n),
y AS (SELECT *, CASE WHEN url IS NULL THEN goes END AS page FROM x)
SELECT outline, node, page, CASE WHEN page IS NOT NULL AND node > 2 THEN node - 2 END AS zoom, url,
  CASE WHEN EXISTS (SELECT 1 FROM y c WHERE c.outline = y.outline AND c.node > 0 AND (c.node - 1) // 2 = y.node) THEN coalesce(CASE WHEN node % 3 <> 0 THEN node % 2 = 0 END, true) END AS open,
  coalesce(bool_or(page >= 10) OVER (PARTITION BY outline), false) AS rejected FROM y
""",
    "running_headers": rf"""
SELECT source, sha256(x) AS line_sha256, n AS on_docs FROM (SELECT source, x, count(*) AS n FROM (SELECT DISTINCT source, doc_id, regexp_replace(line, '\d+', '#', 'g') AS x FROM {_LINES}) GROUP BY source, x)
JOIN (SELECT source, count(*) AS docs FROM documents GROUP BY source) USING (source) WHERE n >= greatest(3, 0.02 * docs)
""",
    "numbered_headings": "SELECT * FROM (VALUES ('제3장 결론', 1), ('제 2 절 방법', 2), ('1.2 목적', 2), ('1.2.3 세부', 3), ('2024년 실적', NULL), ('Ⅳ. 끝', 1), ('IV. End', 1), ('3. Results', 1), ('가. 하나', 3), ('12', NULL), ('plain text', NULL)) t(title, level)",
    "body_sizes": f"SELECT doc_id, body FROM {_BODY}",
    "headings": f"SELECT * FROM {_HEADINGS}",
    "heading_parents": f"SELECT doc_id, k, level, (SELECT max(p.k) FROM {_HEADINGS} p WHERE p.doc_id = h.doc_id AND p.k < h.k AND p.level < h.level) AS parent FROM {_HEADINGS} h",
    "paragraph_flow": "SELECT * FROM (VALUES (0, 0, 1, 24e0, 'A Title'), (0, 1, 2, 11e0, 'The first line of a paragraph goes on'), (0, 2, 1, 11e0, 'Another block'), (0, 3, 1, 11e0, 'far to the right')) t(page, k, lines, size, text)",
    "tagged_run_order": "SELECT * FROM (VALUES (CAST(1 AS BIGINT), 4, 6), (2, 2, 4), (3, 0, 2), (4, 6, 7)) t(k, start, stop)",
    "word_boxes": r"""
WITH c AS (SELECT item_id, unnest(string_split(text, '')) AS ch, generate_subscripts(string_split(text, ''), 1) - 1 AS k FROM benchmark),
x AS (SELECT *, k * 6 + coalesce(sum(CASE WHEN ch = ',' THEN 5 ELSE 0 END) OVER (PARTITION BY item_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS l, lag(ch) OVER (PARTITION BY item_id ORDER BY k) AS p FROM c),
g AS (SELECT *, sum(CASE WHEN p IS NULL OR p IN (' ', chr(10), ',') THEN 1 ELSE 0 END) OVER (PARTITION BY item_id ORDER BY k) AS n FROM x),
w AS (SELECT item_id, n, string_agg(ch, '' ORDER BY k) AS text, min(l) AS l, max(l) + 6 AS r FROM g WHERE ch NOT IN (' ', chr(10)) GROUP BY item_id, n)
SELECT CAST(item_id AS INTEGER) AS page, CAST(row_number() OVER (PARTITION BY item_id ORDER BY n) - 1 AS INTEGER) AS k, text, CAST(l AS DOUBLE) AS l, CAST(r AS DOUBLE) AS r FROM w
""",
}
