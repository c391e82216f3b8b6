"""Gapless numbers without one task that holds all rows of a group."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def number(df: DataFrame, keys: list[str], spread: Column, order: list[str], out: str, rows: int, per_task: int = 100_000) -> DataFrame:
    """Adds ``out``: 0, 1, 2... within each combination of ``keys``, without gaps.

    ``keys`` have few values (shards). Rows are dealt by ``spread`` (an integer hash) into
    enough buckets for ``per_task`` rows each, numbered inside their bucket, and moved by the
    counts of the buckets before it: only those counts are ever ordered in one place.
    ``df`` is read twice, so it should be a durable table.
    """
    buckets = max(1, math.ceil(rows / per_task))
    dealt = df.withColumn("__b", F.pmod(spread, F.lit(buckets)).cast("long"))
    by = [*keys, "__b"]
    before = Window.partitionBy(*keys, F.lit(0)).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy(*by).agg(F.count("*").alias("__n")).select(*by, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    inside = Window.partitionBy(*by).orderBy(*order)
    return (
        dealt.withColumn("__r", F.row_number().over(inside))
        .join(starts, by)
        .withColumn(out, (F.col("__start") + F.col("__r") - 1).cast("long"))
        .drop("__b", "__r", "__start")
    )
