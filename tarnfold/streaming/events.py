"""Bounded operators in their incremental form, for Structured Streaming (an extension)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnfold.operators.dedup import upsert


def distinct_observations(stream: DataFrame, keys: list[str], time: str, delay: str = "1 day") -> DataFrame:
    """V3: the first observation of each key; state goes after the watermark."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def daily_counts(stream: DataFrame, time: str, by: list[str], delay: str = "1 day") -> DataFrame:
    """Rows a day and group in tumbling windows."""
    out = stream.withWatermark(time, delay).groupBy(F.window(time, "1 day").alias("w"), *by).agg(F.count("*").alias("n"))
    return out.select(F.to_date("w.start").alias("day"), *by, "n")


def strict_sessions(stream: DataFrame, entity: str, time: str, gap: str = "7 days", delay: str = "1 day") -> DataFrame:
    """L3, strict tier: sessions that end after a gap without rows."""
    out = stream.withWatermark(time, delay).groupBy(F.session_window(time, gap).alias("w"), entity).agg(F.count("*").alias("n"))
    return out.select(entity, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def upsert_batches(path: Callable[[int], str], keys: list[str], order: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that writes version n + 1 of a table from version n and a batch; running one again gives the same."""

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        old = spark.read.parquet(path(number - 1)) if number else batch.limit(0)
        upsert(old, batch, keys, order).write.mode("overwrite").parquet(path(number))

    return run
