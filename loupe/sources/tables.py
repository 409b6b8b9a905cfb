"""Parquet tables and written copies."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_cleaned(df: DataFrame, folder: str, stem: str, format: str = "parquet") -> str:
    """Write ``cleaned_{stem}_{time}`` beside the original, which is kept; returns the path."""
    stamp = datetime.datetime.now().strftime("%Y%m%d_%H%M%S")
    path = f"{folder.rstrip('/')}/cleaned_{stem}_{stamp}"
    writer = df.write.mode("errorifexists")
    (writer.option("header", True).csv(path) if format == "csv" else writer.parquet(path))
    return path


def materialise(df: DataFrame, path: str) -> DataFrame:
    """Write a slow source to Parquet once and read that from then on."""
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def size_mb(spark: SparkSession, path: str) -> DataFrame:
    """One row with the number and total size of the files under a path.

    Only the listing is read: the unused ``content`` column is pruned.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.agg(
        F.count("*").alias("files"), F.round(F.sum("length") / (1024 * 1024), 2).alias("size_mb")
    )
