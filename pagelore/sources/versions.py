"""Tables in folders that are replaced as a whole and only after they were read back, and tables of which single partitions are replaced."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelore.sources.scratch import stored


def digest(rows: DataFrame) -> tuple[int, int]:
    """Number of rows and the sum of their hashes: the same rows in any order."""
    found = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64(*sorted(rows.columns)).cast("decimal(20,0)")), F.lit(0)).alias("h")).first()
    return found["n"], int(found["h"])


def present(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame | None:
    """The table of a folder, or None if there is no such folder."""
    try:
        return (spark.read if schema is None else spark.read.schema(schema)).parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


class Versions:
    """Versions of a table under a folder. ``publish`` writes a new one beside the present one, reads it back and compares number and hashes of
    the rows with what was to be written; only if they agree does the new version become the present one. A failure anywhere before leaves
    the old one in place, and a version that was written twice is the same."""

    def __init__(self, folder: str, write=None) -> None:
        self.folder = folder
        self.write = write or (lambda rows, path: rows.write.mode("overwrite").parquet(path))

    def number(self, spark: SparkSession) -> int:
        """The present version, 0 if there is none."""
        found = present(spark, f"{self.folder}/present", "version int")
        return 0 if found is None else found.agg(F.coalesce(F.max("version"), F.lit(0)).alias("v")).first()["v"]

    def present(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.folder}/v{self.number(spark)}")

    def publish(self, rows: DataFrame) -> bool:
        """Whether ``rows`` are the present version now."""
        spark = rows.sparkSession
        wanted, new = digest(rows), self.number(spark) + 1
        path = f"{self.folder}/v{new}"
        self.write(rows, path)
        if digest(spark.read.schema(rows.schema).parquet(path)) != wanted:
            return False
        # files of one row are only added, so a reader sees the old or the new number
        spark.range(1).select(F.lit(new).alias("version")).coalesce(1).write.mode("append").parquet(f"{self.folder}/present")
        return True


def apply_run(folder: str, new: DataFrame, keys: list[str], part: Column, replace: bool) -> None:
    """Adds rows to a table of parts under ``folder``. With ``replace`` the rows of a key that ``new`` has go first: only the parts of such keys
    are written again (dynamic overwrite), their other keys with them; all other parts stay as they are."""
    new = new.withColumn("part", part)
    if not replace:
        new.write.mode("append").partitionBy("part").parquet(folder)
        return
    spark = new.sparkSession
    new = stored(new, "run")
    old = spark.read.parquet(folder).join(F.broadcast(new.select("part").distinct()), "part", "left_semi")  # no more rows than there are parts
    whole = stored(old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new), "parts")
    whole.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(folder)
