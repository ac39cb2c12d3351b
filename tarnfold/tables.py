"""Reading the named tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of the folder; only Spark's reader opens the path, so any store Spark knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
