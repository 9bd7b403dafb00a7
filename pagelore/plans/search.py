"""Search, personal data and page text queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagelore.functions import pii
from pagelore.functions import text as T
from pagelore.operators.find import hits, places
from pagelore.sources import corpus

#: What the queries look for.
NEEDLE, CASED, KEYWORD, FROM_PAGE, ENOUGH = "the", "The", "of the", 2, 16


def search_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits(corpus.documents(spark, sf_dir), ["doc_id"], T.literal(NEEDLE))


def search_match_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits(corpus.documents(spark, sf_dir), ["doc_id"], T.literal(CASED), match_case=True)


def search_whole_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    return places(corpus.documents(spark, sf_dir), ["doc_id"], T.literal(NEEDLE, whole_word=True))


def keyword_ws_flexible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches for each document, whatever white space stands between the words."""
    n = F.regexp_count(T.fold(F.col("text")), F.lit(T.keyword(KEYWORD)))
    return corpus.documents(spark, sf_dir).select("doc_id", n.alias("n")).filter("n > 0")


def search_totals_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = corpus.documents(spark, sf_dir)
    n = docs.select("source", F.regexp_count(T.fold(F.col("text")), F.lit(T.literal(NEEDLE))).alias("n"))
    return n.groupBy("source").agg(F.count("*").alias("docs"), F.sum("n").cast("bigint").alias("hits"), F.sum((F.col("n") > 0).cast("int")).cast("bigint").alias("docs_with_hits"))


def outward(page: F.Column, start: F.Column) -> F.Column:
    """Order of a visit outward from ``start``: itself, the next, the one before, and so on."""
    return F.abs(page - start) * 2 - (page > start).cast("int")


def search_visit_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = corpus.pages(spark, sf_dir).select("doc_id", "page")
    last = pages.groupBy("doc_id").agg(F.max("page").alias("last"))
    start = F.least(F.lit(FROM_PAGE), F.col("last"))
    order = Window.partitionBy("doc_id").orderBy(outward(F.col("page"), start))
    return pages.join(last, "doc_id").select("doc_id", "page", F.row_number().over(order).cast("bigint").alias("visit"))


def search_first_hit_from(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page from FROM_PAGE on with a match, else the first with one."""
    found = corpus.pages(spark, sf_dir).filter(T.fold(F.col("text")).contains(NEEDLE))
    return found.groupBy("doc_id").agg(F.coalesce(F.min(F.when(F.col("page") >= FROM_PAGE, F.col("page"))), F.min("page")).alias("page"))


def hits_by_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = corpus.pages(spark, sf_dir)
    n = F.regexp_count(T.fold(F.col("text")), F.lit(T.literal(NEEDLE)))
    return pages.select("doc_id", "page", n.alias("hits")).filter("hits > 0").groupBy("doc_id").agg(F.count("*").alias("pages"), F.sum("hits").cast("bigint").alias("hits"), F.array_join(F.transform(F.sort_array(F.collect_set("page")), lambda p: p.cast("string")), ",").alias("on_pages"))


def search_changed_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each page the next and the previous page with a match, without wrapping around."""
    pages = corpus.pages(spark, sf_dir).select("doc_id", "page", T.fold(F.col("text")).contains(NEEDLE).alias("hit"))
    w = Window.partitionBy("doc_id").orderBy("page")
    at = F.when(F.col("hit"), F.col("page"))
    return pages.select("doc_id", "page", F.min(at).over(w.rowsBetween(1, Window.unboundedFollowing)).alias("next_hit"), F.max(at).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("previous_hit"))


def pii_email(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = corpus.documents(spark, sf_dir).filter(F.col("text").contains("@"))
    return T.each(docs, ["doc_id"], F.regexp_extract_all("text", F.lit(pii.EMAIL), F.lit(0)), "email")


#: Texts and what has to be found in them.
PII_TEXTS = (
    (1, "주민번호: 900101-1234567 입니다"),
    (2, "901301-1234567; 900132-1234567; 900101-5234567; 1900101-12345678"),
    (3, "call +82 10-2222-3333 or 070-8888-9999"),
    (4, "110-123-456789"),
    (5, "1,234,567원"),
    (6, "홍길동@회사.한국"),
    (7, "연락처hong@example.com입니다"),
    (8, "@username, a@b, x@y.1"),
    (9, "010-1234-5678 2024-01-01 12-34-56 01012345678"),
    (10, "계좌 123456-78-901234 와 12345678901"),
)
PII_FOUND = (
    (1, "rrn", 6, 20),
    (3, "phone", 5, 21),
    (3, "phone", 25, 38),
    (4, "account", 0, 14),
    (6, "email", 0, 9),
    (7, "email", 3, 19),
    (9, "phone", 0, 13),
    (9, "phone", 34, 45),
    (10, "account", 3, 19),
    (10, "account", 22, 33),
)


def pii_all_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = spark.createDataFrame(list(PII_TEXTS), "text_id int, text string")
    found = T.each(texts, ["text_id"], pii.merge(pii.find(F.col("text"))), "s")
    return found.select("text_id", "s.kind", "s.start", F.col("s.end").alias("stop"))


def match_interval_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of a keyword and of mailboxes in documents, merged."""
    docs = corpus.documents(spark, sf_dir).filter(F.col("text").contains("@"))
    spans = pii.merge(pii.find(F.col("text"), ("email",), keyword=r"[a-z]+@[a-z]+"))
    return T.each(docs, ["doc_id"], spans, "s").select("doc_id", "s.kind", "s.start", F.col("s.end").alias("stop"))


def redact_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a mailbox: how many code points went, what is left, and that nothing survives."""
    docs = corpus.documents(spark, sf_dir).filter(F.col("text").rlike(pii.EMAIL)).withColumn("s", pii.merge(pii.find(F.col("text"), ("email",))))
    docs = docs.withColumn("redacted", pii.redact(F.col("text"), F.col("s")))
    hidden = F.aggregate("s", F.lit(0), lambda n, s: n + s["end"] - s["start"])
    return docs.select("doc_id", hidden.cast("bigint").alias("hidden"), F.sha2("redacted", 256).alias("redacted_sha256"), F.regexp_count("redacted", F.lit(pii.EMAIL)).alias("survivors"))


def redaction_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What redaction leaves of a document, run by run."""
    docs = corpus.documents(spark, sf_dir).filter(F.col("text").rlike(pii.EMAIL)).withColumn("s", pii.merge(pii.find(F.col("text"), ("email",))))
    return T.each(docs, ["doc_id"], pii.kept_runs(F.col("text"), F.col("s")), "r").select("doc_id", "r.start", F.length("r.text").alias("length"))


def page_text_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = T.visible(F.col("text"))
    return corpus.documents(spark, sf_dir).select("doc_id", n.alias("visible"), (n >= ENOUGH).alias("has_text"))


def image_only_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether none of a document's first ten pages has text."""
    first = corpus.pages(spark, sf_dir).filter("page < 10")
    return first.groupBy("doc_id").agg(F.every(T.visible(F.col("text")) < ENOUGH).alias("image_only"))


def web_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = corpus.table(spark, sf_dir, "pages")
    return T.each(pages, ["page_id"], F.regexp_extract_all("html", F.lit(r'href="([^"]*)"'), F.lit(1)), "href")


def text_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's pages as one text, form feeds between them, and its length."""
    ordered = F.sort_array(F.collect_list(F.struct("page", "text")))
    joined = corpus.pages(spark, sf_dir).groupBy("doc_id").agg(F.array_join(ordered["text"], "\f").alias("text"))
    return joined.select("doc_id", F.length("text").alias("chars"), F.sha2("text", 256).alias("sha256"))


QUERIES = {f.__name__: f for f in (search_hits, search_match_case, search_whole_word, keyword_ws_flexible, search_totals_by_source, search_visit_order, search_first_hit_from, hits_by_page, search_changed_steps, pii_email, pii_all_vectors, match_interval_merge, redact_text, redaction_runs, page_text_status, image_only_docs, web_links, text_export)}

_HITS = """
WITH parts AS (SELECT doc_id, text, string_split({hay}, '{needle}') AS p FROM documents WHERE text IS NOT NULL),
hits AS (SELECT doc_id, text, p, unnest(range(1, len(p))) AS k FROM parts),
starts AS (SELECT doc_id, text, CAST(list_sum(list_transform(p[1:k], lambda x: length(x))) + (k - 1) * {n} AS INTEGER) AS s FROM hits)
SELECT doc_id, s AS char_start, {n} AS char_length,
  translate(substr(text, greatest(s - 40, 0) + 1, s - greatest(s - 40, 0) + {n} + 40), chr(13) || chr(10), '  ') AS context, s - greatest(s - 40, 0) AS context_at
FROM starts
"""
#: Mailboxes: the look-ahead is a consumed boundary here.
_EMAIL = r"((?:[A-Za-z0-9._%+-]+|[가-힣]+)@(?:(?:[A-Za-z0-9-]+|[가-힣]+)\.)+(?:[A-Za-z]{2,}|한국))(?:[^A-Za-z0-9]|$)"
_SPACES = r"[\s\p{Z}\x{85}]"
_MAILS = rf"""
WITH found AS (SELECT doc_id, text, unnest(regexp_extract_all(text, '{_EMAIL}', 1)) AS email FROM documents),
numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id, email) AS k FROM found),
placed AS (SELECT doc_id, text, email, CAST(list_sum(list_transform(string_split(text, email)[1:k], lambda x: length(x))) + (k - 1) * length(email) AS INTEGER) AS s FROM numbered)
"""
ORACLES = {
    "search_hits": _HITS.format(hay="lower(text)", needle=NEEDLE, n=len(NEEDLE)),
    "search_match_case": _HITS.format(hay="text", needle=CASED, n=len(CASED)),
    "search_whole_word": rf"""
WITH parts AS (SELECT doc_id, lower(text) AS t, string_split(lower(text), '{NEEDLE}') AS p FROM documents WHERE text IS NOT NULL),
hits AS (SELECT doc_id, t, p, unnest(range(1, len(p))) AS k FROM parts),
starts AS (SELECT doc_id, t, CAST(list_sum(list_transform(p[1:k], lambda x: length(x))) + (k - 1) * {len(NEEDLE)} AS INTEGER) AS s FROM hits)
SELECT doc_id, s AS char_start, {len(NEEDLE)} AS char_length FROM starts
WHERE NOT regexp_matches(substr(t, s, 1), '^[\p{{L}}\p{{N}}_]$') AND NOT regexp_matches(substr(t, s + {len(NEEDLE) + 1}, 1), '^[\p{{L}}\p{{N}}_]$') OR s = 0 AND NOT regexp_matches(substr(t, s + {len(NEEDLE) + 1}, 1), '^[\p{{L}}\p{{N}}_]$')
""",
    "keyword_ws_flexible": rf"SELECT doc_id, CAST(len(regexp_extract_all(lower(text), 'of{_SPACES}+the')) AS INTEGER) AS n FROM documents WHERE len(regexp_extract_all(lower(text), 'of{_SPACES}+the')) > 0",
    "search_totals_by_source": f"""
SELECT source, count(*) AS docs, CAST(sum(n) AS BIGINT) AS hits, CAST(sum(CAST(n > 0 AS INTEGER)) AS BIGINT) AS docs_with_hits
FROM (SELECT source, len(string_split(lower(coalesce(text, '')), '{NEEDLE}')) - 1 AS n FROM documents) GROUP BY source
""",
    "search_visit_order": f"""
SELECT conv_id AS doc_id, turn AS page, row_number() OVER (PARTITION BY conv_id ORDER BY abs(turn - f) * 2 - CASE WHEN turn > f THEN 1 ELSE 0 END) AS visit
FROM conversations JOIN (SELECT conv_id, least({FROM_PAGE}, max(turn)) AS f FROM conversations GROUP BY conv_id) USING (conv_id)
""",
    "search_first_hit_from": f"""
SELECT conv_id AS doc_id, coalesce(min(turn) FILTER (WHERE turn >= {FROM_PAGE}), min(turn)) AS page FROM conversations WHERE contains(lower(text), '{NEEDLE}') GROUP BY conv_id
""",
    "hits_by_page": f"""
SELECT conv_id AS doc_id, count(*) AS pages, CAST(sum(n) AS BIGINT) AS hits, string_agg(CAST(turn AS VARCHAR), ',' ORDER BY turn) AS on_pages
FROM (SELECT conv_id, turn, len(string_split(lower(text), '{NEEDLE}')) - 1 AS n FROM conversations) WHERE n > 0 GROUP BY conv_id
""",
    "search_changed_steps": f"""
SELECT c.conv_id AS doc_id, c.turn AS page,
  (SELECT min(x.turn) FROM conversations x WHERE x.conv_id = c.conv_id AND x.turn > c.turn AND contains(lower(x.text), '{NEEDLE}')) AS next_hit,
  (SELECT max(x.turn) FROM conversations x WHERE x.conv_id = c.conv_id AND x.turn < c.turn AND contains(lower(x.text), '{NEEDLE}')) AS previous_hit
FROM conversations c
""",
    "pii_email": rf"SELECT doc_id, unnest(regexp_extract_all(text, '{_EMAIL}', 1)) AS email FROM documents",
    "pii_all_vectors": "SELECT * FROM (VALUES " + ", ".join(f"({a}, '{b}', {c}, {d})" for a, b, c, d in PII_FOUND) + ") t(text_id, kind, start, stop)",
    "match_interval_merge": rf"""{_MAILS}, keys AS (SELECT doc_id, text, word, row_number() OVER (PARTITION BY doc_id, word) AS k FROM (SELECT doc_id, text, unnest(regexp_extract_all(text, '[a-z]+@[a-z]+')) AS word FROM documents)),
spans AS (
  SELECT doc_id, 'email' AS kind, s AS start, s + length(email) AS stop FROM placed
  UNION ALL SELECT doc_id, 'keyword', CAST(list_sum(list_transform(string_split(text, word)[1:k], lambda x: length(x))) + (k - 1) * length(word) AS INTEGER), CAST(list_sum(list_transform(string_split(text, word)[1:k], lambda x: length(x))) + (k - 1) * length(word) AS INTEGER) + length(word) FROM keys
), groups AS (
  SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY start, stop DESC, kind DESC ROWS UNBOUNDED PRECEDING) AS g FROM (
    SELECT *, CASE WHEN start < max(stop) OVER (PARTITION BY doc_id ORDER BY start, stop DESC, kind DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM spans)
)
SELECT doc_id, first(kind ORDER BY start, stop DESC) AS kind, CAST(min(start) AS INTEGER) AS start, CAST(max(stop) AS INTEGER) AS stop FROM groups GROUP BY doc_id, g
""",
    "redact_text": rf"""{_MAILS}
SELECT doc_id, CAST(sum(length(email)) AS BIGINT) AS hidden, sha256(list_reduce(list_concat([first(text)], list(email)), lambda t, e: replace(t, e, repeat('█', length(e))))) AS redacted_sha256, 0 AS survivors
FROM placed GROUP BY doc_id
""",
    "redaction_runs": rf"""{_MAILS}, edges AS (
  SELECT doc_id, text, CAST(lag(s + length(email), 1, 0) OVER w AS INTEGER) AS start, s AS stop FROM placed WINDOW w AS (PARTITION BY doc_id ORDER BY s)
  UNION ALL SELECT doc_id, first(text), CAST(max(s + length(email)) AS INTEGER), length(first(text)) FROM placed GROUP BY doc_id
)
SELECT doc_id, start, CAST(stop - start AS INTEGER) AS length FROM edges WHERE trim(substr(text, start + 1, stop - start)) <> ''
""",
    "page_text_status": r"""
SELECT doc_id, CAST(n AS INTEGER) AS visible, n >= 16 AS has_text FROM (SELECT doc_id, length(regexp_replace(coalesce(text, ''), '[\s\p{Z}\p{Cc}]', '', 'g')) AS n FROM documents)
""",
    "image_only_docs": r"""
SELECT conv_id AS doc_id, bool_and(length(regexp_replace(text, '[\s\p{Z}\p{Cc}]', '', 'g')) < 16) AS image_only FROM conversations WHERE turn < 10 GROUP BY conv_id
""",
    "web_links": """SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages""",
    "text_export": "SELECT conv_id AS doc_id, CAST(length(t) AS INTEGER) AS chars, sha256(t) AS sha256 FROM (SELECT conv_id, string_agg(text, chr(12) ORDER BY turn) AS t FROM conversations GROUP BY conv_id)",
}
