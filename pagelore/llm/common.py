"""Helpers that the training-data operators share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space separates words in every operator of this package.
WORD = r"[^\x20\x09-\x0D]+"


SEED = 42


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a new folder if all run on this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def small_batches(spark: SparkSession, rows: int) -> None:
    """Whole texts go to Python workers at most ``rows`` at once, so that a batch stays some megabytes."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a side that is broadcast; above that it is repeated for SALTS parts of each key.
MOST_BROADCAST, SALTS = 200_000, 16


def merged(side: DataFrame) -> DataFrame:
    """A side of a join that grows with the input. Spark sizes what comes out of an explosion, or of a well-packed file, too low and would
    broadcast it, so its joins are sort-merge joins by hint."""
    return side.hint("merge")


def looked_up(rows: DataFrame, found: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``found``, which has one small row for each key, where few keys may hold most rows: rows stay where they are, or if
    ``found`` is too large for a broadcast are dealt by key and salt. ``found`` is counted, so it should be stored."""
    if found.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST:
        return rows.join(F.broadcast(found), key, how)
    salted = merged(found.withColumn("salt_of_join", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))))
    return rows.withColumn("salt_of_join", F.floor(F.rand(SEED) * SALTS).cast("int")).join(salted, [key, "salt_of_join"], how).drop("salt_of_join")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(column: str | Column, modulus: int) -> Column:
    """crc32 of an id written as text, modulo ``modulus``; a null id counts as the empty text."""
    found = F.col(column) if isinstance(column, str) else column
    return F.crc32(F.coalesce(found.cast("string"), F.lit(""))) % modulus
