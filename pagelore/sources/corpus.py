"""The corpus: tables of a folder, and the views of documents and pages over them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page each; a null text is a page without text."""
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "source")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of several pages: conversations, a turn a page (from 0)."""
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), "role", F.coalesce("text", F.lit("")).alias("text"))


def folder(spark: SparkSession, path: str, suffix: str = ".pdf", most: int | None = 2000, content: bool = False) -> DataFrame:
    """path, length of the files under a folder whose name ends so (any case), without hidden ones, in order, ``most`` at most; ``content``: with
    their bytes, read where they are used. Files without a byte are not listed: the reader leaves them out."""
    columns = ["path", "length", "modificationTime", *(["content"] if content else [])]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(*columns)
    name = F.element_at(F.split("path", "/"), -1)
    files = files.filter(F.lower(name).endswith(suffix) & ~name.startswith("."))
    return files if most is None else files.orderBy("path").limit(most)


def run_files(files: DataFrame, look: Callable[[Column], tuple[Column, Column]]) -> DataFrame:
    """path, outcome (done or failed), reason, hits: what ``look`` says of each file's content. A file that can't be used is a row that says why;
    the others go on."""
    reason, hits = look(F.col("content"))
    found = files.select("path", reason.alias("reason"), hits.cast("bigint").alias("hits"))
    failed = F.col("reason").isNotNull()
    return found.select("path", F.when(failed, "failed").otherwise("done").alias("outcome"), "reason", F.when(failed, F.lit(0).cast("bigint")).otherwise(F.col("hits")).alias("hits"))
