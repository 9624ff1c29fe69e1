"""Reading the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fragment_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fragment_files with file_id: the physical place of the row, the same on every read."""
    return table(spark, sf_dir, "fragment_files").withColumn("file_id", F.concat_ws("#", "_metadata.file_path", "_metadata.row_index"))
