"""Queries of jobs and files: page jobs with state, runs that replace pages, outlines published after reading back, files that may be damaged,
binary payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagelore.functions import text as T
from pagelore.plans.stream import deliver
from pagelore.sources import corpus, payload
from pagelore.sources.scratch import folder as scratch
from pagelore.sources.versions import Versions, apply_run
from pagelore.streaming import jobs as J

#: Documents of a file, levels of an outline, parts of the table of recognised pages.
IN_A_FILE, DEEPEST, PARTS = 500, 3, 16


def page_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as jobs, their pages in two deliveries; of each fifth document the last page never comes. The last delivery is a single page of
    another day, after which the timers of unfinished jobs have run out."""
    pages = corpus.pages(spark, sf_dir)
    whole = F.count("*").over(Window.partitionBy("doc_id"))
    last = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("page"))) == 1
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("page"))
    rows = pages.select("doc_id", whole.alias("total"), F.length("text").cast("bigint").alias("chars"), at.alias("at"), (F.col("page") % 2).cast("int").alias("part"), last.alias("last"))
    rows = rows.filter("NOT (last AND doc_id % 5 = 0 AND total > 1)").drop("last")
    later = spark.range(1).select(F.lit(-1).cast("bigint").alias("doc_id"), F.lit(1).cast("bigint").alias("total"), F.lit(0).cast("bigint").alias("chars"), F.timestamp_seconds(F.lit(1_800_000_000)).alias("at"))
    rows = rows.unionByName(later.withColumn("part", F.lit(2))).unionByName(later.withColumn("part", F.lit(3)))
    out = scratch(spark, "jobs")
    with J.state_store(spark):
        deliver(spark, rows, "pages", 4, lambda stream: J.page_jobs(stream, "1 minute", 60_000).writeStream.format("parquet").outputMode("append").option("path", out))
    return spark.read.schema(J.RESULT).parquet(out).filter("doc_id >= 0")


def recognised_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of pages after three runs: all pages, then again each third one in place of the first run, then each fifth one beside what is there."""
    pages = corpus.pages(spark, sf_dir).select("doc_id", "page", F.size(T.tokens(F.col("text"))).alias("words"))
    table, part = scratch(spark, "recognised"), F.pmod(F.xxhash64("doc_id", "page"), F.lit(PARTS)).cast("int")
    runs = ((None, False), ("page % 3 = 1", True), ("page % 5 = 2", False))
    for k, (which, replace) in enumerate(runs):
        rows = pages.filter(which) if which else pages
        apply_run(table, rows.withColumn("words", F.col("words") + 100 * k).withColumn("run", F.lit(k)), ["doc_id", "page"], part, replace)
    return spark.read.parquet(table).groupBy("doc_id", "page").agg(F.sum("words").cast("bigint").alias("words"), F.array_join(F.sort_array(F.collect_list("run")).cast("array<string>"), ",").alias("runs"))


def outline_published(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outlines of ten pages, replaced by deeper ones and published after they were read back. An outline with more than DEEPEST levels is refused
    and stays what it was. Node n hangs below n div 3, in each fourth outline below n - 1."""
    pages = corpus.table(spark, sf_dir, "pages").select(F.floor(F.col("page_id") / 10).alias("outline"), (F.col("page_id") % 10).alias("node"), F.coalesce("url", F.lit("")).alias("title"))
    table = Versions(scratch(spark, "outlines"))
    table.publish(pages.select("outline", "node", "title", F.lit(0).alias("depth"), F.lit("old").alias("state")))
    up = F.when(F.col("node") == 0, None).when(F.col("outline") % 4 == 3, F.col("node") - 1).otherwise(F.floor(F.col("node") / 3))
    new = pages.withColumn("depth", F.lit(0)).withColumn("up", up)
    # a node of a level more than is allowed shows that there are too many
    above = new.select("outline", F.col("node").alias("up"), F.col("up").alias("next"))
    for _ in range(DEEPEST):
        new = new.join(above, ["outline", "up"], "left").withColumn("depth", F.col("depth") + F.col("up").isNotNull().cast("int")).withColumn("up", F.col("next")).drop("next")
    refused = new.groupBy("outline").agg((F.max("depth") >= DEEPEST).alias("refused"))
    old = table.present(spark).select("outline", "node", F.col("depth").alias("old_depth"))
    rows = new.join(refused, "outline").join(old, ["outline", "node"], "left")
    keep = F.col("refused")
    table.publish(rows.select("outline", "node", F.when(keep, F.col("title")).otherwise(F.upper(F.substring("title", 1, 12))).alias("title"), F.when(keep, F.col("old_depth")).otherwise(F.col("depth")).alias("depth"), F.when(keep, "old").otherwise("new").alias("state")))
    return table.present(spark)


def folder_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run over a folder of files, each with documents of one source: place in the queue, outcome, hits. A file's last line says how many
    documents it has; where that is not so the file is damaged, and the others go on. Each third file is damaged here."""
    docs = corpus.documents(spark, sf_dir).withColumn("name", F.concat(F.regexp_replace(F.coalesce("source", F.lit("none")), r"\W", "_"), F.lit("-"), F.lpad(F.floor(F.col("doc_id") / IN_A_FILE).cast("string"), 8, "0")))
    line = F.concat(F.col("doc_id"), F.lit("\t"), F.translate("text", "\r\n ", "   "))
    body = F.array_join(F.sort_array(F.collect_list(F.struct("doc_id", line.alias("line"))))["line"], "\n")
    said = F.count("*") + F.when(F.pmod(F.max("doc_id"), F.lit(3)) == 1, 1).otherwise(0)
    files = docs.groupBy("name").agg(F.concat(body, F.lit("\nend "), said).alias("value"))
    root = scratch(spark, "files")
    files.write.partitionBy("name").text(root)
    queue = corpus.folder(spark, root, ".txt", most=None, content=True)
    name = F.regexp_extract("path", r"name=([^/]+)/", 1)
    return corpus.run_files(queue, checked_hits).select(name.alias("file"), F.row_number().over(Window.partitionBy(F.split(name, "-")[0]).orderBy("path")).alias("place"), "outcome", "reason", "hits")


def checked_hits(content: F.Column) -> tuple[F.Column, F.Column]:
    """(reason why a file can't be used or null, hits in it)."""
    text = F.decode(content, "UTF-8")
    lines = F.split(F.regexp_replace(text, r"\n\z", ""), "\n")
    said = F.regexp_extract(F.element_at(lines, -1), r"^end (\d+)$", 1)
    reason = F.when(said == "", "no last line").when(said.cast("bigint") != F.size(lines) - 1, "documents missing")
    return reason, F.regexp_count(F.lower(text), F.lit("the"))


def payload_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as binary payloads and read again; of each seventh one the last three bytes are missing, each seventh but one begins wrongly."""
    docs = corpus.documents(spark, sf_dir).select("doc_id", payload.encoded(F.col("doc_id"), F.col("text")).alias("whole"))
    short = F.substring("whole", F.lit(1), (F.length("whole") - 3).cast("int"))
    foreign = F.concat(F.encode(F.lit("X"), "UTF-8"), F.col("whole"))
    docs = docs.select("doc_id", F.when(F.col("doc_id") % 7 == 1, short).when(F.col("doc_id") % 7 == 2, foreign).otherwise(F.col("whole")).alias("buffer"))
    head = payload.header(F.col("buffer"))
    words = payload.spans_of(F.col("buffer"), "words")
    return docs.select("doc_id", head["page"].alias("page"), head["chars"].alias("chars"), head["words"].alias("words"), head["lines"].alias("lines"), payload.text_offset(head).alias("text_at"), F.try_element_at(words, F.lit(-1))["length"].alias("last_word"), F.sha2(payload.text_of(F.col("buffer")), 256).alias("sha256"))


QUERIES = {f.__name__: f for f in (page_job, recognised_pages, outline_published, folder_search, payload_round_trip)}

_TOKENS = r"regexp_extract_all(coalesce(text, ''), '[^\s\p{Z}\x{85}]+')"
ORACLES = {
    "page_job": """
WITH p AS (SELECT conv_id AS doc_id, length(coalesce(text, '')) AS n, turn, count(*) OVER (PARTITION BY conv_id) AS total, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1 AS last FROM conversations),
c AS (SELECT * FROM p WHERE NOT (last AND doc_id % 5 = 0 AND total > 1))
SELECT doc_id, CASE WHEN count(*) = max(total) THEN 'finished' ELSE 'abandoned' END AS outcome, count(*) AS pages, CAST(sum(n) AS BIGINT) AS chars FROM c GROUP BY doc_id
""",
    "recognised_pages": f"""
WITH p AS (SELECT conv_id AS doc_id, turn AS page, len({_TOKENS}) AS w FROM conversations),
r AS (SELECT doc_id, page, w + CASE WHEN page % 3 = 1 THEN 100 ELSE 0 END AS words, CASE WHEN page % 3 = 1 THEN 1 ELSE 0 END AS run FROM p UNION ALL SELECT doc_id, page, w + 200, 2 FROM p WHERE page % 5 = 2)
SELECT doc_id, page, CAST(sum(words) AS BIGINT) AS words, string_agg(run, ',' ORDER BY run) AS runs FROM r GROUP BY doc_id, page
""",
    "outline_published": f"""
WITH RECURSIVE p AS (SELECT page_id // 10 AS outline, page_id % 10 AS node, coalesce(url, '') AS title FROM pages),
n AS (SELECT *, CASE WHEN node = 0 THEN NULL WHEN outline % 4 = 3 THEN node - 1 ELSE node // 3 END AS up FROM p),
walk(outline, node, up, depth) AS (SELECT outline, node, up, 0 FROM n UNION ALL SELECT w.outline, w.node, a.up, w.depth + 1 FROM walk w LEFT JOIN n a ON a.outline = w.outline AND a.node = w.up WHERE w.up IS NOT NULL AND w.depth < {DEEPEST}),
deep AS (SELECT outline, node, max(depth) AS depth FROM walk GROUP BY ALL),
bad AS (SELECT outline, max(depth) >= {DEEPEST} AS refused FROM deep GROUP BY outline)
SELECT outline, node, CASE WHEN refused THEN title ELSE upper(substr(title, 1, 12)) END AS title, CAST(CASE WHEN refused THEN 0 ELSE depth END AS INTEGER) AS depth, CASE WHEN refused THEN 'old' ELSE 'new' END AS state FROM p JOIN deep USING (outline, node) JOIN bad USING (outline)
""",
    "folder_search": f"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(source, 'none'), '[^0-9A-Za-z_]', '_', 'g') || '-' || lpad(CAST(doc_id // {IN_A_FILE} AS VARCHAR), 8, '0') AS file, len(string_split(lower(coalesce(text, '')), 'the')) - 1 AS n FROM documents)
SELECT file, CAST(row_number() OVER (PARTITION BY string_split(file, '-')[1] ORDER BY file) AS INTEGER) AS place, CASE WHEN max(doc_id) % 3 = 1 THEN 'failed' ELSE 'done' END AS outcome, CASE WHEN max(doc_id) % 3 = 1 THEN 'documents missing' END AS reason, CASE WHEN max(doc_id) % 3 = 1 THEN 0 ELSE CAST(sum(n) AS BIGINT) END AS hits FROM d GROUP BY file
""",
    "payload_round_trip": rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_TOKENS} AS w, len(regexp_extract_all(coalesce(text, ''), '[^\n]+')) AS n FROM documents)
SELECT doc_id, CASE WHEN doc_id % 7 <> 2 THEN doc_id END AS page, CASE WHEN doc_id % 7 <> 2 THEN length(text) END AS chars, CASE WHEN doc_id % 7 <> 2 THEN len(w) END AS words, CASE WHEN doc_id % 7 <> 2 THEN n END AS lines,
  CASE WHEN doc_id % 7 <> 2 THEN 24 + 8 * len(w) + 8 * n END AS text_at, CASE WHEN doc_id % 7 <> 2 THEN length(w[-1]) END AS last_word, CASE WHEN doc_id % 7 NOT IN (1, 2) THEN sha256(text) END AS sha256 FROM d
""",
}
