"""Streaming queries, run to the end over the files that are there."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.readwriter import DataStreamWriter

from pagelore.sources import corpus
from pagelore.sources.scratch import folder as scratch
from pagelore.streaming import pages as P


def deliver(spark: SparkSession, rows: DataFrame, name: str, parts: int, start: Callable[[DataFrame], DataStreamWriter]) -> None:
    """Rows with a column ``part`` as a stream: the files of each part arrive together and are read to the end before the next part arrives,
    each as one batch over all its partitions. ``start`` makes the writer of the stream."""
    folder, log, schema = scratch(spark, name), scratch(spark, "log"), rows.drop("part").schema
    for k in range(parts):
        rows.filter(F.col("part") == k).drop("part").write.mode("append").parquet(folder)
        start(P.read(spark, folder, schema)).option("checkpointLocation", log).trigger(availableNow=True).start().awaitTermination()


def stream_page_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of each page come as they are found; even pages come a second time with the count doubled, and replace the first."""
    found = corpus.pages(spark, sf_dir).select("doc_id", "page", F.regexp_count(F.lower("text"), F.lit("the")).alias("hits"))
    again = found.filter("page % 2 = 0").select("doc_id", "page", (F.col("hits") * 2).alias("hits"), F.lit(1).alias("delivery"), F.lit(1).alias("part"))
    rows = found.select("doc_id", "page", "hits", F.lit(0).alias("delivery"), F.lit(0).alias("part")).union(again)
    keep = P.PageUpsert(scratch(spark, "upsert"), ["doc_id", "page"], ["delivery"])
    deliver(spark, rows, "pages", 2, lambda stream: stream.writeStream.foreachBatch(keep))
    return keep.result(spark).select("doc_id", "page", "hits")


def _table_of(spark: SparkSession, rows: DataFrame, name: str, parts: int, change: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What ``change`` makes of the stream of ``rows``, as a table."""
    out = scratch(spark, "out")
    deliver(spark, rows, name, parts, lambda stream: change(stream).writeStream.format("parquet").outputMode("append").option("path", out))
    return spark.read.parquet(out)


def stream_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits of a user within an hour of the kept one of their label are one. A single edit of another year ends the stream, so all are done."""
    e = corpus.table(spark, sf_dir, "events")
    rows = e.select("user_id", "event_id", F.when(F.col("event_id") % 3 == 0, "move").otherwise("edit").alias("label"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).alias("at_ms"))
    bounds = rows.agg(F.expr("percentile_approx(at_ms, 0.5)").alias("m"), F.max("at_ms").alias("last")).first()
    later = spark.range(2).select(F.lit(-1).cast("bigint").alias("user_id"), F.lit(-1).cast("bigint").alias("event_id"), F.lit("end").alias("label"), F.lit((bounds["last"] or 0) + 40_000_000_000).alias("at_ms"), (F.col("id") + 2).cast("int").alias("part"))
    rows = rows.withColumn("part", (F.col("at_ms") > F.lit(bounds["m"])).cast("int")).unionByName(later)
    return _table_of(spark, rows, "edits", 4, lambda stream: P.coalesced(stream, 3_600_000)).filter("user_id >= 0")


def stream_late_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of the first half of the time, of the second, the last one, then views of the first half again: those are too late."""
    e = corpus.table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")
    bounds = e.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).first()
    middle = F.lit(bounds["a"]) + (F.lit(bounds["b"]) - F.lit(bounds["a"])) / 2
    rows = e.withColumn("part", F.when(F.col("ts") < middle, 0).when(F.col("ts") < F.lit(bounds["b"]), 1).otherwise(2))
    late = rows.filter("part = 0 AND event_type = 'view'").withColumn("part", F.lit(3))
    closed = _table_of(spark, rows.union(late), "events", 4, lambda stream: P.in_time(stream, "ts", "1 hour", "1 day"))
    return closed.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "n")


QUERIES = {f.__name__: f for f in (stream_page_upsert, stream_coalesce, stream_late_drop)}

ORACLES = {
    "stream_page_upsert": "SELECT conv_id AS doc_id, turn AS page, CAST((len(string_split(lower(coalesce(text, '')), 'the')) - 1) * CASE WHEN turn % 2 = 0 THEN 2 ELSE 1 END AS INTEGER) AS hits FROM conversations",
    "stream_coalesce": """
WITH RECURSIVE e AS (SELECT user_id, CASE WHEN event_id % 3 = 0 THEN 'move' ELSE 'edit' END AS label, epoch_us(ts) // 1000 AS t, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS k FROM events),
walk AS (
  SELECT user_id, k, label, t AS anchor, 1 AS g FROM e WHERE k = 1
  UNION ALL SELECT user_id, k, label, CASE WHEN joins THEN anchor ELSE t END, CASE WHEN joins THEN g ELSE g + 1 END FROM (SELECT e.*, w.anchor, w.g, e.label = w.label AND e.t - w.anchor <= 3600000 AS joins FROM walk w JOIN e ON e.user_id = w.user_id AND e.k = w.k + 1)
)
SELECT user_id, label, anchor AS at_ms, CAST(count(*) - 1 AS INTEGER) AS folded FROM walk GROUP BY user_id, g, label, anchor
""",
    "stream_late_drop": "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR GROUP BY ALL",
}
