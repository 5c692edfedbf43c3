"""Sinks: CSV, parquet and JSON tables, and a manifest of written files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str) -> None:
    """One CSV file with a header; for result tables, whose size a person can read."""
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)


def write_table(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def as_json(df: DataFrame) -> DataFrame:
    """Each row as one JSON text."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))


def write_json(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").json(path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes, sha256) of every file below path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.regexp_extract("path", "([^/]+)$", 1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def provenance(spark: SparkSession, sources: list[tuple[str, str, str]]) -> DataFrame:
    """A table of the sources that a run read: name, path, role."""
    return spark.createDataFrame(sources, "name string, path string, role string")
