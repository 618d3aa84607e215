"""Reading the tables of a data directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """The parquet table `name` of `directory`, a single file or a folder of parts."""
    return spark.read.parquet(f"{directory}/{name}.parquet")
