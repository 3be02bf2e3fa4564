"""Batch stages: positions, resume, validation, progress, adoption."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .rollup import latest


def positions(items: DataFrame, by: str, *order: str) -> DataFrame:
    return items.withColumn("index", (F.row_number().over(Window.partitionBy(by).orderBy(*order)) - 1).cast("long"))


def ordinals(outputs: DataFrame, *by: str, order: str) -> DataFrame:
    return outputs.withColumn("ordinal", (F.row_number().over(Window.partitionBy(*by).orderBy(order)) - 1).cast("long"))


def remaining(items: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Items whose index has no valid record."""
    return items.join(done.select(*keys), keys, "left_anti")


def valid(records: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    """An index is valid while each of its artifacts still has its recorded hash."""
    now = current.select("path", F.col("content_hash").alias("_now"))
    return records.join(now, "path", "left").groupBy(*keys).agg(F.bool_and(F.col("content_hash").eqNullSafe(F.col("_now"))).alias("valid"))


def progress(records: DataFrame, *by: str) -> DataFrame:
    """Done-of-total; the total counts only if all records that name one agree."""
    agreed = F.when(F.count_distinct("total") == 1, F.min("total"))
    found = records.groupBy(*by).agg(F.count("*").alias("done"), agreed.alias("total"))
    return found.withColumn("progress", F.concat_ws("/", F.col("done").cast("string"), F.coalesce(F.col("total").cast("string"), F.lit("?"))))


def adopt(current: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Partial records of both keys under the current one; the current key's win."""
    both = current.withColumn("_p", F.lit(1)).unionByName(other.withColumn("_p", F.lit(0)))
    return latest(both, keys, ["_p"]).drop("_p")
