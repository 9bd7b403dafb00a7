"""Queries of text formats: cells, marks, names, templates, dates, forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelore.functions import text as T
from pagelore.sources import corpus, forms


def _each(expression):
    return lambda spark, sf_dir: corpus.documents(spark, sf_dir).select("doc_id", F.sha2(expression(F.col("text")), 256).alias("sha256"), F.length(expression(F.col("text"))).alias("length"))


csv_field_guarded = _each(T.csv_guarded)
csv_cell_plain = _each(T.csv_plain)
md_escape_summary = _each(T.markdown_summary)
md_escape_flow = _each(T.markdown_flow)
link_path = _each(T.link_path)
base64_text = _each(lambda t: F.translate(F.base64(F.encode(t, "UTF-8")), "\r\n", ""))  # without the line ends of MIME


def xml_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = corpus.table(spark, sf_dir, "pages")
    return pages.select("page_id", F.sha2(T.xml_text(F.col("html")), 256).alias("sha256"), F.length(T.xml_text(F.col("html"))).alias("length"))


def safe_file_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.documents(spark, sf_dir).select("doc_id", T.file_title(F.substring_index("text", "\n", 1)).alias("title"))


def path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.table(spark, sf_dir, "pages").select("page_id", T.basename(F.col("url")).alias("name"), T.path_key(F.col("url")).alias("key"))


#: Templates, and what each rule makes of them on page 2 of 9 of a file; the two rules differ where no Bates number is set.
TEMPLATES = (
    ("{{page}} / {{total}}", "2 / 9", "2 / 9"),
    ("{{{{page}}", "{{2", "{{2"),
    ("{{filename}} {{nothing}}", "a {{page}}.pdf {{nothing}}", "a {{page}}.pdf {{nothing}}"),
    ("[{{bates}}]", "[]", "[{{bates}}]"),
    ("plain", "plain", "plain"),
)


def template_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(t,) for t, *_ in TEMPLATES], "template string")
    values = {"page": F.lit("2"), "total": F.lit("9"), "filename": F.lit("a {{page}}.pdf"), "bates": None}
    return rows.select("template", T.expand(F.col("template"), values, absent="").alias("stamped"), T.expand(F.col("template"), values).alias("preview"))


def template_per_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A footer on every page of every document."""
    pages = corpus.pages(spark, sf_dir)
    total = pages.groupBy("doc_id").agg(F.count("*").cast("string").alias("total"))
    values = {"page": (F.col("page") + 1).cast("string"), "total": F.col("total"), "filename": F.concat(F.lit("doc-"), F.col("doc_id").cast("string"))}
    return pages.join(total, "doc_id").select("doc_id", "page", T.expand(F.lit("{{filename}}: {{page}}/{{total}} {{other}}"), values).alias("footer"))


DATES = (
    ("D:20260928123456", "2026-09-28 12:34:56"),
    ("D:2026", "2026-01-01 00:00:00"),
    ("not a date", "not a date"),
    ("D:20260928123456+09'00'", "2026-09-28 03:34:56"),
    ("D:20260928123456Z", "2026-09-28 12:34:56"),
    ("2026-09-28T12:34:56+09:00", "2026-09-28 03:34:56"),
    ("D:20261399", "D:20261399"),
    ("20260102", "2026-01-02 00:00:00"),
    ("", ""),
)


def pdf_date_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(d,) for d, _ in DATES], "raw string").select("raw", T.pdf_date(F.col("raw")).alias("shown"))


def pdf_date_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event times written as PDF dates with a zone of two hours east, and read back."""
    raw = F.concat(F.lit("D:"), F.date_format("ts", "yyyyMMddHHmmss"), F.lit("+02'00'"))
    return corpus.table(spark, sf_dir, "events").select("event_id", T.pdf_date(raw).alias("shown"))


def byte_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = corpus.documents(spark, sf_dir).select("doc_id", (F.length("text").cast("bigint") * F.length("text")).alias("n"))
    return n.select("doc_id", T.byte_size(F.col("n")).alias("size"))


#: Forms as CSV text.
FORMS = (
    (1, '﻿name,value\r\nFirst,Ada\r\nCity,"Bern, CH"\r\nPet,cat\r\nPet,dog\r\n'),
    (2, 'Note,"two\nlines and ""quotes"""\n,lost\nEmpty,\n'),
    (3, ""),
)


def form_csv_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = spark.createDataFrame(list(FORMS), "form_id int, text string")
    return forms.values_of_csv(texts).select("form_id", "name", F.array_join("values", "|").alias("values"))


def form_csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forms to CSV and back: what comes back."""
    texts = spark.createDataFrame(list(FORMS), "form_id int, text string")
    again = forms.values_of_csv(forms.csv_of_values(forms.values_of_csv(texts)))
    return again.select("form_id", "name", F.array_join("values", "|").alias("values"))


def form_xfdf_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = spark.createDataFrame(list(FORMS), "form_id int, text string")
    again = forms.values_of_xfdf(forms.xfdf_of_values(forms.values_of_csv(texts)))
    return again.select("form_id", "name", F.array_join("values", "|").alias("values"))


def form_import_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imported names against a form's fields: matched, and unknown."""
    texts = spark.createDataFrame(list(FORMS), "form_id int, text string")
    fields = spark.createDataFrame([(1, "First"), (1, "Pet"), (1, "Age"), (2, "Note")], "form_id int, field string")
    got = forms.values_of_csv(texts).select("form_id", F.col("name").alias("field"), F.lit(True).alias("given"))
    both = got.join(fields.withColumn("known", F.lit(True)), ["form_id", "field"], "full")
    return both.select("form_id", "field", F.when(F.col("known").isNull(), "unknown").when(F.col("given").isNull(), "untouched").otherwise("set").alias("state"))


def annotation_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes of a document as one guarded CSV text."""
    line = F.concat_ws(",", (F.col("page") + 1).cast("string"), T.csv_guarded(F.col("role"), False), T.csv_guarded(F.col("text")))
    rows = corpus.pages(spark, sf_dir).select("doc_id", F.struct("page", line.alias("line")).alias("r"))
    text = F.concat(F.lit("page,author,text\r\n"), F.array_join(F.sort_array(F.collect_list("r"))["line"], "\r\n"), F.lit("\r\n"))
    return rows.groupBy("doc_id").agg(F.sha2(text, 256).alias("sha256"), F.length(text).alias("length"))


def markdown_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document as Markdown: roles as headings, rules between pages."""
    block = F.concat(F.lit("## "), T.markdown_flow(F.col("role")), F.lit("\n\n"), T.markdown_flow(F.col("text")))
    rows = corpus.pages(spark, sf_dir).select("doc_id", F.struct("page", block.alias("b")).alias("r"))
    text = F.array_join(F.sort_array(F.collect_list("r"))["b"], "\n\n---\n\n")
    return rows.groupBy("doc_id").agg(F.sha2(text, 256).alias("sha256"), F.length(text).alias("length"))


def uri_encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.table(spark, sf_dir, "benchmark").select("item_id", T.uri_7bit(F.col("text")).alias("uri"))


def relative_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as seen from the day of the last one."""
    e = corpus.table(spark, sf_dir, "events").select("event_id", F.to_date("ts").alias("day"))
    last = e.agg(F.max("day").alias("today"))
    return e.join(F.broadcast(last)).select("event_id", T.relative_day(F.col("day"), F.col("today")).alias("shown"))


def time_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds to read a document's pages with three workers: a third of a second and 1.6 for each page of a worker, one at least."""
    n = corpus.pages(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("pages"))
    return n.select("doc_id", F.greatest(F.lit(1), F.floor(0.3 + F.col("pages") * 1.6 / 3 + 0.5)).alias("seconds"))


_NAMES = ("csv_field_guarded", "csv_cell_plain", "md_escape_summary", "md_escape_flow", "link_path", "base64_text")
QUERIES = {n: globals()[n] for n in _NAMES} | {f.__name__: f for f in (xml_escape, safe_file_title, path_parts, template_expand, template_per_page, pdf_date_parse, pdf_date_events, byte_sizes, form_csv_source, form_csv_round_trip, form_xfdf_round_trip, form_import_matching, annotation_csv, markdown_export, uri_encoded, relative_days, time_estimates)}


def _sql(expression: str, table: str = "documents", key: str = "doc_id", text: str = "coalesce(text, '')") -> str:
    return f"SELECT {key}, sha256(x) AS sha256, CAST(length(x) AS INTEGER) AS length FROM (SELECT {key}, {expression.format(t='t')} AS x FROM (SELECT {key}, {text} AS t FROM {table}))"


_PLAIN = """CASE WHEN contains({t}, ',') OR contains({t}, '"') OR contains({t}, chr(10)) OR contains({t}, chr(13)) THEN '"' || replace({t}, '"', '""') || '"' ELSE {t} END"""


def _guarded(t: str) -> str:
    v = f"(CASE WHEN substr(replace({t}, chr(13) || chr(10), chr(10)), 1, 1) IN ('=', '+', '-', '@') THEN '''' ELSE '' END || replace({t}, chr(13) || chr(10), chr(10)))"
    return f"""CASE WHEN contains({v}, ',') OR contains({v}, '"') OR contains({v}, chr(10)) OR contains({v}, chr(13)) OR regexp_matches(substr({v}, 1, 1), '^[\\s\\p{{Z}}]') OR regexp_matches(right({v}, 1), '^[\\s\\p{{Z}}]') THEN '"' || replace({v}, '"', '""') || '"' ELSE {v} END"""


_MD_FLOW = r"regexp_replace({t}, '(^[#>\-+=|]|[\\*_\[\]<>`])', '\\\1', 'g')"
_VALUES = "SELECT * FROM (VALUES (1, 'First', 'Ada'), (1, 'City', 'Bern, CH'), (1, 'Pet', 'cat|dog'), (2, 'Note', 'two' || chr(10) || 'lines and \"quotes\"'), (2, 'Empty', '')) t(form_id, name, values)"


def _rows(rows: tuple, names: str) -> str:
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(quote, r)) + ")" for r in rows) + f") t({names})"


ORACLES = {
    "csv_field_guarded": f"SELECT doc_id, sha256(x) AS sha256, CAST(length(x) AS INTEGER) AS length FROM (SELECT doc_id, {_guarded('t')} AS x FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents))",
    "csv_cell_plain": _sql(_PLAIN),
    "md_escape_summary": _sql(r"regexp_replace({t}, '([\\`*_\[\]<>#|])', '\\\1', 'g')"),
    "md_escape_flow": _sql(_MD_FLOW),
    "link_path": _sql("replace(replace(replace({t}, ' ', '%20'), '(', '%28'), ')', '%29')"),
    "base64_text": _sql("base64(encode({t}))"),
    "xml_escape": _sql(r"""replace(replace(replace(replace(replace(regexp_replace({t}, '[\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&apos;')""", "pages", "page_id", "html"),
    "safe_file_title": r"""
SELECT doc_id, CASE WHEN t = '' THEN 'untitled' ELSE t END AS title FROM (SELECT doc_id, substr(regexp_replace(trim(regexp_replace(string_split(coalesce(text, ''), chr(10))[1], '[\\/:*?"<>|\p{Cc}]', '_', 'g')), '[.\s]+$', ''), 1, 80) AS t FROM documents)
""",
    "path_parts": r"SELECT page_id, regexp_extract(url, '([^/\\]*)[/\\]*$', 1) AS name, replace(lower(url), chr(92), '/') AS key FROM pages",
    "template_expand": _rows(TEMPLATES, "template, stamped, preview"),
    "template_per_page": "SELECT conv_id AS doc_id, turn AS page, 'doc-' || conv_id || ': ' || (turn + 1) || '/' || count(*) OVER (PARTITION BY conv_id) || ' {{other}}' AS footer FROM conversations",
    "pdf_date_parse": _rows(DATES, "raw, shown"),
    "pdf_date_events": "SELECT event_id, strftime(date_trunc('second', ts) - INTERVAL 2 HOUR, '%Y-%m-%d %H:%M:%S') AS shown FROM events",
    "byte_sizes": """
SELECT doc_id, CASE WHEN v = floor(v) THEN CAST(CAST(v AS BIGINT) AS VARCHAR) ELSE CAST(v AS VARCHAR) END || ' ' || ['B', 'KB', 'MB', 'GB'][u + 1] AS size FROM (
  SELECT doc_id, u, floor(n / pow(1024, u) * 10 + 0.5) / 10 AS v FROM (SELECT doc_id, n, CASE WHEN n < 1024 THEN 0 WHEN n < 1048576 THEN 1 WHEN n < 1073741824 THEN 2 ELSE 3 END AS u FROM (SELECT doc_id, length(coalesce(text, '')) * length(coalesce(text, '')) AS n FROM documents)))
""",
    "form_csv_source": _VALUES,
    "form_csv_round_trip": _VALUES,
    "form_xfdf_round_trip": _VALUES,
    "form_import_matching": "SELECT * FROM (VALUES (1, 'First', 'set'), (1, 'City', 'unknown'), (1, 'Pet', 'set'), (1, 'Age', 'untouched'), (2, 'Note', 'set'), (2, 'Empty', 'unknown')) t(form_id, field, state)",
    "annotation_csv": f"SELECT conv_id AS doc_id, sha256(x) AS sha256, CAST(length(x) AS INTEGER) AS length FROM (SELECT conv_id, 'page,author,text' || chr(13) || chr(10) || string_agg((turn + 1) || ',' || role || ',' || {_guarded('text')}, chr(13) || chr(10) ORDER BY turn) || chr(13) || chr(10) AS x FROM conversations GROUP BY conv_id)",
    "markdown_export": f"SELECT conv_id AS doc_id, sha256(x) AS sha256, CAST(length(x) AS INTEGER) AS length FROM (SELECT conv_id, string_agg('## ' || {_MD_FLOW.format(t='role')} || chr(10) || chr(10) || {_MD_FLOW.format(t='text')}, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY turn) AS x FROM conversations GROUP BY conv_id)",
    "uri_encoded": r"SELECT item_id, array_to_string(list_transform(string_split(text, ''), lambda c: CASE WHEN ord(c) BETWEEN 33 AND 126 THEN c ELSE regexp_replace(hex(encode(c)), '(..)', '%\1', 'g') END), '') AS uri FROM benchmark",
    "relative_days": """
SELECT event_id, CASE WHEN n <= 0 THEN 'today' WHEN n = 1 THEN 'yesterday' WHEN n < 7 THEN n || ' days ago' ELSE strftime(d, '%Y-%m-%d') END AS shown
FROM (SELECT event_id, CAST(ts AS DATE) AS d, date_diff('day', CAST(ts AS DATE), (SELECT CAST(max(ts) AS DATE) FROM events)) AS n FROM events)
""",
    "time_estimates": "SELECT conv_id AS doc_id, CAST(greatest(1, floor(0.3e0 + count(*) * 1.6e0 / 3 + 0.5e0)) AS BIGINT) AS seconds FROM conversations GROUP BY conv_id",
}
