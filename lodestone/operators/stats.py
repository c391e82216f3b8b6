"""Descriptive statistics, histograms and reductions, each one aggregation."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.ordered import lagged, scan


def array_sum(a: Column | str) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def array_product(a: Column | str) -> Column:
    return F.aggregate(a, F.lit(1.0), lambda s, x: s * x)


def array_weighted(a: Column | str, weights: Column | str) -> Column:
    return array_sum(F.zip_with(a, weights, lambda x, w: x * w))


def array_reduce(a: Column | str, start: Column, step) -> Column:
    return F.aggregate(a, start, step)


def dimension_stats(df: DataFrame, vector: str) -> DataFrame:
    """(dim, n, mean, variance (sample), min, max) of each component of an array column."""
    cells = df.select(F.posexplode(vector).alias("dim", "x")).withColumn("x", F.col("x").cast("double"))
    return cells.groupBy("dim").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.var_samp("x").alias("variance"), F.min("x").alias("min"), F.max("x").alias("max"))


def column_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """(name, mean, variance, min, max) of several columns: one aggregate row, then unpivoted."""
    aggs = [f(F.col(c).cast("double")).alias(f"{c}__{n}") for c in columns for n, f in (("mean", F.avg), ("variance", F.var_samp), ("min", F.min), ("max", F.max))]
    row = df.agg(*aggs)
    items = [F.struct(F.lit(c).alias("name"), *(F.col(f"{c}__{n}").alias(n) for n in ("mean", "variance", "min", "max"))) for c in columns]
    return row.select(F.explode(F.array(*items)).alias("s")).select("s.*")


def covariance(df: DataFrame, columns: list[str]) -> DataFrame:
    """Sample covariance matrix in long form (i, j, covariance), all pairs in one aggregation."""
    pairs = [(i, j) for i in range(len(columns)) for j in range(len(columns))]
    row = df.agg(*(F.covar_samp(F.col(columns[i]).cast("double"), F.col(columns[j]).cast("double")).alias(f"c{i}_{j}") for i, j in pairs if i <= j))
    items = [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"c{min(i, j)}_{max(i, j)}").alias("covariance")) for i, j in pairs]
    return row.select(F.explode(F.array(*items)).alias("s")).select("s.*")


def quickselect(df: DataFrame, column: str, k: int) -> DataFrame:
    """The k-th smallest value, counted from 1: counts by value first, so ties shrink before the order.

    The running counts are taken in blocks of positions, whatever the number of distinct values.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("__n"))
    return scan(counts, "__n", [column], out="__upto").where(F.col("__upto") >= k).agg(F.min(column).alias("value"))


def median(df: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(by or [])).agg(F.median(column).alias("median"))


def ranks(df: DataFrame, column: str, out: str = "rank", by: list[str] | None = None) -> DataFrame:
    """1-based ranks, ties averaged.

    Without groups only the distinct values with their counts are put in order, in blocks of positions.
    """
    if by:
        order = Window.partitionBy(*by).orderBy(column)
        return df.withColumn(out, F.rank().over(order) + (F.count("*").over(Window.partitionBy(*by, column)) - 1) / 2.0)
    counts = df.groupBy(column).agg(F.count("*").alias("__n"))
    placed = scan(counts, "__n", [column], out="__upto").withColumn(out, F.col("__upto") - (F.col("__n") - 1) / 2.0)
    return df.join(placed.drop("__n", "__upto"), column)


def gram(df: DataFrame, features: list[Column], target: Column) -> DataFrame:
    """One row: ``xx`` (upper triangle of XᵀX, row by row), ``xy``, ``yy``, ``n``: partial sums before the only shuffle."""
    p = len(features)
    named = df.select(*(f.cast("double").alias(f"x{i}") for i, f in enumerate(features)), target.cast("double").alias("y"))
    xx = [F.sum(F.col(f"x{i}") * F.col(f"x{j}")) for i in range(p) for j in range(i, p)]
    xy = [F.sum(F.col(f"x{i}") * F.col("y")) for i in range(p)]
    return named.agg(F.array(*xx).alias("xx"), F.array(*xy).alias("xy"), F.sum(F.col("y") ** 2).alias("yy"), F.count("*").alias("n"))


def smallest_gap(df: DataFrame, column: str) -> float:
    """The least difference of neighbours in sorted order: zero as soon as a value repeats."""
    values = df.select(F.col(column).cast("double").alias("x")).where("x is not null")
    distinct = values.distinct()
    if values.count() != distinct.count():
        return 0.0
    return lagged(distinct, "x", {"before": 1}, ["x"]).agg(F.min(F.col("x") - F.col("before"))).first()[0] or 0.0


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """(bin, label, count): bins of one width from the minimum on, empty ones with 0.

    Half the smallest gap between neighbours is added at both ends before the range is cut
    into ``bins``; so where values repeat (no gap) the maximum opens one bin more. Labels
    have two digits, more for widths under a tenth. Nulls aren't counted; no values, no bins.
    """
    spark = df.sparkSession
    x = F.col(column).cast("double")
    ends = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi")).first()
    if ends["lo"] is None:
        return spark.createDataFrame([], "bin int, label string, count long")
    lo, hi = ends["lo"], ends["hi"]
    width = (hi - lo + smallest_gap(df, column)) / bins or 1.0
    digits = min(6, max(2, int(1 - math.log10(width))))
    counts = df.where(x.isNotNull()).groupBy(F.floor((x - lo) / width).cast("int").alias("bin")).agg(F.count("*").alias("count"))
    low = F.col("bin") * width + lo
    every = spark.range(int((hi - lo) / width) + 1).select(F.col("id").cast("int").alias("bin"))
    return every.join(counts, "bin", "left").select("bin", F.format_string(f"%.{digits}f - %.{digits}f", low, low + width).alias("label"), F.coalesce("count", F.lit(0)).alias("count"))


def default_bins(df: DataFrame, column: str) -> int:
    """⌊√(number of distinct values)⌋, one at least."""
    return max(1, int(df.select(F.countDistinct(column)).first()[0] ** 0.5))


def bin_labels(*columns: str) -> Column:
    return F.concat_ws(" - ", *(F.col(c).cast("string") for c in columns))


def histogram_2d(df: DataFrame, x: str, y: str, bins: int) -> DataFrame:
    """(i, j, count) of cells with rows; bounds come from one aggregate over the frame."""
    r = df.agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1")).first()
    side = lambda c, lo, hi: F.least(F.floor((F.col(c) - lo) / ((hi - lo) / bins or 1.0)), F.lit(bins - 1)).cast("int")
    return df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(side(x, r["x0"], r["x1"]).alias("i"), side(y, r["y0"], r["y1"]).alias("j")).agg(F.count("*").alias("count"))


def line_fit(df: DataFrame, x: str, y: str) -> DataFrame:
    """Least squares line: slope, intercept and adjusted R²."""
    n = F.count("*")
    r2 = F.regr_r2(y, x)
    return df.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), (1 - (1 - r2) * (n - 1) / (n - 2)).alias("adjusted_r2"))


def expectation(samples: DataFrame, value: Column) -> DataFrame:
    return samples.agg(F.avg(value).alias("expectation"))


def entropy(samples: DataFrame, log_density: Column) -> DataFrame:
    return samples.agg(F.avg(-log_density).alias("entropy"))


def relative_entropy(samples: DataFrame, log_p: Column, log_q: Column) -> DataFrame:
    return samples.agg(F.avg(log_p - log_q).alias("kl"))
