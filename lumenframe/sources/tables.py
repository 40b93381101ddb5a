"""Reading and writing tables: Parquet, CSV with a declared schema, JSON lines, and file hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.session import prepare


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV whose header must be the declared columns; a foreign header or extra cells are errors. An empty
    cell is null."""
    return spark.read.csv(path, header=True, schema=schema, enforceSchema=False, mode="FAILFAST", nullValue="")


def write_csv(frame: DataFrame, path: str, keys: list[str]) -> None:
    """CSV in canonical order of ``keys``: range-partitioned, so that the files in order are in order."""
    frame.repartitionByRange(*keys).sortWithinPartitions(*keys).write.csv(path, header=True, nullValue="", mode="overwrite")


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.json(path, schema=schema, mode="FAILFAST")


def write_json(frame: DataFrame, path: str) -> None:
    """One object a line, columns in order of name."""
    frame.select(*sorted(frame.columns)).write.json(path, mode="overwrite")


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """path, length, sha256 of each file below ``path``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def hash_differences(found: DataFrame, said: DataFrame) -> DataFrame:
    """Files that are missing, unexpected or changed. Both: path, sha256."""
    both = found.select("path", F.col("sha256").alias("found")).join(said.select("path", F.col("sha256").alias("said")), "path", "full")
    verdict = F.when(F.col("found").isNull(), "missing").when(F.col("said").isNull(), "unexpected").when(F.col("found") != F.col("said"), "changed")
    return both.withColumn("verdict", verdict).where("verdict is not null")
