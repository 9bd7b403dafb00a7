"""Queries that compare documents and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagelore.functions import text as T
from pagelore.operators import compare as C
from pagelore.operators import find
from pagelore.sources import corpus


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, page, words of each page, folded."""
    return corpus.pages(spark, sf_dir).select("doc_id", "page", T.tokens(T.fold(F.col("text"))).alias("words"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations 2k and 2k + 1 are the two documents of pair k."""
    return words(spark, sf_dir).select(F.floor(F.col("doc_id") / 2).alias("pair"), (F.col("doc_id") % 2).cast("int").alias("side"), F.col("page").cast("int").alias("page"), "words")


def word_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All words of each document with their spans."""
    return find.words(corpus.documents(spark, sf_dir), ["doc_id"])


def page_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity of each page's words to those of the next page; two empty pages are equal."""
    pages = words(spark, sf_dir).select("doc_id", "page", F.array_distinct("words").alias("w"))
    nxt = pages.withColumn("v", F.lead("w").over(Window.partitionBy("doc_id").orderBy("page"))).filter("v is not null")
    whole = F.size(F.array_union("w", "v"))
    return nxt.select("doc_id", "page", F.when(whole == 0, 1.0).otherwise(F.size(F.array_intersect("w", "v")) / whole).alias("similarity"))


def positional_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of both documents by place, what is left over one-sided."""
    p = pairs(spark, sf_dir).select("pair", "side", "page", F.size("words").alias("n"))
    a, b = p.filter("side = 0").select("pair", "page", F.col("n").alias("words_a")), p.filter("side = 1").select("pair", "page", F.col("n").alias("words_b"))
    return a.join(b, ["pair", "page"], "full")


def align_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir).groupBy("pair").applyInPandas(C.align_pair, C.ALIGNED)


def word_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir).groupBy("pair").applyInPandas(C.diff_pair, C.OPS)


def compare_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changed pages, inserted and deleted words of each pair; a replacement counts on both sides. A page that only one document has is
    changed even if it is empty."""
    changed = F.max((F.coalesce("kind", F.lit("")) != "equal").cast("int"))
    ops = word_diff(spark, sf_dir)
    rows = align_pages(spark, sf_dir).select("pair", "row", (F.col("page_a").isNull() | F.col("page_b").isNull()).alias("alone"))
    per = ops.groupBy("pair", "row").agg(changed.alias("c"), F.sum(F.when(F.col("kind") != "equal", F.col("words_b")).otherwise(0)).alias("ins"), F.sum(F.when(F.col("kind") != "equal", F.col("words_a")).otherwise(0)).alias("del"))
    return rows.join(per, ["pair", "row"], "left").groupBy("pair").agg(F.sum((F.col("alone") | (F.coalesce("c", F.lit(0)) == 1)).cast("int")).alias("changed_pages"), F.coalesce(F.sum("ins"), F.lit(0)).alias("inserted"), F.coalesce(F.sum("del"), F.lit(0)).alias("deleted"))


def positional_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of both documents by place: whether they differ, and the next place after each that does."""
    p = pairs(spark, sf_dir).select("pair", "side", "page", F.array_join("words", " ").alias("t"))
    a, b = p.filter("side = 0").select("pair", "page", F.col("t").alias("a")), p.filter("side = 1").select("pair", "page", F.col("t").alias("b"))
    rows = a.join(b, ["pair", "page"], "full").select("pair", "page", (~F.col("a").eqNullSafe(F.col("b"))).alias("changed"))
    w = Window.partitionBy("pair").orderBy("page").rowsBetween(1, Window.unboundedFollowing)
    return rows.select("pair", "page", "changed", F.min(F.when(F.col("changed"), F.col("page"))).over(w).alias("next_changed"))


def bag_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a page shares with the next page as bags: recall and precision."""
    counts = words(spark, sf_dir).select("doc_id", "page", F.explode("words").alias("w")).groupBy("doc_id", "page", "w").count()
    sizes = words(spark, sf_dir).select("doc_id", "page", F.size("words").alias("n"))
    before = counts.select("doc_id", (F.col("page") - 1).alias("page"), "w", F.col("count").alias("c"))
    shared = counts.join(before, ["doc_id", "page", "w"]).groupBy("doc_id", "page").agg(F.sum(F.least("count", "c")).alias("hit"))
    nxt = sizes.select("doc_id", (F.col("page") - 1).alias("page"), F.col("n").alias("m"))
    both = sizes.join(nxt, ["doc_id", "page"]).join(shared, ["doc_id", "page"], "left")
    hit = F.coalesce("hit", F.lit(0))
    return both.select("doc_id", "page", F.when(F.col("n") > 0, hit / F.col("n")).otherwise(0.0).alias("recall"), F.when(F.col("m") > 0, hit / F.col("m")).otherwise(0.0).alias("precision"))


def char_error_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edit distance of an item to itself without every second vowel e, over its length."""
    items = corpus.table(spark, sf_dir, "benchmark").select("item_id", F.trim(F.regexp_replace("text", r"\s+", " ")).alias("t"))
    read = F.regexp_replace("t", "e(.*?)e", "e$1")
    return items.select("item_id", F.levenshtein("t", read).alias("edits"), (F.levenshtein("t", read) / F.length("t")).alias("rate"))


def word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two counts: between single spaces, and between runs of any white space."""
    return corpus.documents(spark, sf_dir).select("doc_id", T.words_plain(F.col("text")).alias("plain"), T.words_trimmed(F.col("text")).alias("trimmed"))


def word_interning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A number for each distinct word of a document, in order of first appearance."""
    found = corpus.pages(spark, sf_dir).select("doc_id", "page", F.posexplode(T.tokens(T.fold(F.col("text")))).alias("k", "w"))
    first = found.groupBy("doc_id", "w").agg(F.min(F.struct("page", "k")).alias("k"), F.count("*").alias("times"))
    return first.select("doc_id", F.col("w").alias("word"), "times", (F.row_number().over(Window.partitionBy("doc_id").orderBy("k")) - 1).cast("bigint").alias("number"))


QUERIES = {f.__name__: f for f in (word_tokens, page_jaccard, positional_pairs, align_pages, word_diff, compare_report, positional_changes, bag_overlap, char_error_rate, word_counts, word_interning)}

_S = r"[^\s\p{Z}\x{85}]+"
_W = f"(SELECT conv_id AS doc_id, turn AS page, regexp_extract_all(lower(coalesce(text, '')), '{_S}') AS w FROM conversations)"
ORACLES = {
    "word_tokens": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(text, '{_S}') AS w, string_split_regex(text, '{_S}') AS g FROM documents),
r AS (SELECT doc_id, unnest(w) AS w, unnest(g[1:len(w)]) AS g, unnest(range(len(w))) AS k FROM d)
SELECT doc_id, CAST(k AS INTEGER) AS k, CAST(sum(length(g) + length(w)) OVER (PARTITION BY doc_id ORDER BY k) - length(w) AS INTEGER) AS start, CAST(length(w) AS INTEGER) AS length, lower(w) AS key FROM r
""",
    "page_jaccard": f"""
SELECT doc_id, page, CASE WHEN len(list_distinct(list_concat(w, v))) = 0 THEN 1.0 ELSE CAST(len(list_intersect(list_distinct(w), list_distinct(v))) AS DOUBLE) / len(list_distinct(list_concat(w, v))) END AS similarity
FROM (SELECT doc_id, page, w, lead(w) OVER (PARTITION BY doc_id ORDER BY page) AS v FROM {_W}) WHERE v IS NOT NULL
""",
    "positional_pairs": f"""
SELECT coalesce(a.pair, b.pair) AS pair, coalesce(a.page, b.page) AS page, words_a, words_b
FROM (SELECT doc_id // 2 AS pair, CAST(page AS INTEGER) AS page, CAST(len(w) AS INTEGER) AS words_a FROM {_W} WHERE doc_id % 2 = 0) a
FULL JOIN (SELECT doc_id // 2 AS pair, CAST(page AS INTEGER) AS page, CAST(len(w) AS INTEGER) AS words_b FROM {_W} WHERE doc_id % 2 = 1) b ON a.pair = b.pair AND a.page = b.page
""",
    "positional_changes": f"""
WITH r AS (SELECT coalesce(a.pair, b.pair) AS pair, coalesce(a.page, b.page) AS page, a.w IS DISTINCT FROM b.w AS changed
FROM (SELECT doc_id // 2 AS pair, CAST(page AS INTEGER) AS page, w FROM {_W} WHERE doc_id % 2 = 0) a
FULL JOIN (SELECT doc_id // 2 AS pair, CAST(page AS INTEGER) AS page, w FROM {_W} WHERE doc_id % 2 = 1) b ON a.pair = b.pair AND a.page = b.page)
SELECT pair, page, changed, min(CASE WHEN changed THEN page END) OVER (PARTITION BY pair ORDER BY page ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_changed FROM r
""",
    "bag_overlap": f"""
WITH c AS (SELECT doc_id, page, x, count(*) AS n FROM (SELECT doc_id, page, unnest(w) AS x FROM {_W}) GROUP BY ALL), s AS (SELECT doc_id, page, len(w) AS n FROM {_W}),
h AS (SELECT a.doc_id, a.page, sum(least(a.n, b.n)) AS hit FROM c a JOIN c b ON a.doc_id = b.doc_id AND a.page + 1 = b.page AND a.x = b.x GROUP BY ALL)
SELECT a.doc_id, a.page, CASE WHEN a.n > 0 THEN CAST(coalesce(hit, 0) AS DOUBLE) / a.n ELSE 0 END AS recall, CASE WHEN b.n > 0 THEN CAST(coalesce(hit, 0) AS DOUBLE) / b.n ELSE 0 END AS precision
FROM s a JOIN s b ON a.doc_id = b.doc_id AND a.page + 1 = b.page LEFT JOIN h ON h.doc_id = a.doc_id AND h.page = a.page
""",
    "char_error_rate": r"""
SELECT item_id, CAST(levenshtein(a, b) AS INTEGER) AS edits, CAST(length(a) - length(b) AS DOUBLE) / length(a) AS rate
FROM (SELECT item_id, regexp_replace(t, '[^\x00-\x7F]', '?', 'g') AS a, regexp_replace(regexp_replace(t, 'e(.*?)e', 'e\1', 'g'), '[^\x00-\x7F]', '?', 'g') AS b FROM (SELECT item_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM benchmark))
""",
    "word_counts": r"""
SELECT doc_id, CAST(len(list_filter(string_split(coalesce(text, ''), ' '), lambda x: x <> '')) AS INTEGER) AS plain, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\s\p{Z}\x{85}]+')) AS INTEGER) AS trimmed FROM documents
""",
    "word_interning": f"""
WITH x AS (SELECT doc_id, page, unnest(w) AS word, generate_subscripts(w, 1) AS k FROM {_W})
SELECT doc_id, word, count(*) AS times, row_number() OVER (PARTITION BY doc_id ORDER BY min((page, k))) - 1 AS number FROM x GROUP BY doc_id, word
""",
}
