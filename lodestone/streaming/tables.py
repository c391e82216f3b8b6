"""Streams: running metrics, time windows with watermarks, and stateful folds by key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodestone.session import new_path


def read(spark: SparkSession, path: str, like: DataFrame, files: int = 1) -> DataFrame:
    """A stream over the Parquet files of a directory, with the schema of a batch frame."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files).parquet(path)


def running_metrics(stream: DataFrame, p: str, y: str) -> DataFrame:
    """MSE and MAE so far; for the complete output mode."""
    e = F.col(p) - F.col(y)
    return stream.agg(F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.count("*").alias("n"))


def windowed(stream: DataFrame, time: str, value: str, by: list[str], length: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Count, sum and mean of tumbling or sliding windows; rows later than the watermark are let go."""
    w = F.window(time, length, slide) if slide else F.window(time, length)
    return stream.withWatermark(time, late).groupBy(w, *by).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *by, "n", "total", "mean")


def sessions(stream: DataFrame, time: str, by: list[str], gap: str, late: str = "10 minutes") -> DataFrame:
    return stream.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("s"), *by).agg(F.count("*").alias("n")).select(F.col("s.start").alias("start"), F.col("s.end").alias("end"), *by, "n")


def kalman(stream: DataFrame, by: str, order: list[str], value: str, system: float, noise: float) -> DataFrame:
    """A first-order filter for each key, its mean and variance kept as state between batches.

    ``order`` names the columns by which a batch's rows of a key are taken; they should leave no ties.
    """
    kind = dict(stream.dtypes)[by]

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState):
        mean, variance, n = state.get if state.exists else (0.0, 1.0, 0)
        rows = pd.concat(list(frames)).sort_values(order, kind="stable")
        for v in rows[value]:
            p = variance + system
            gain = p / (p + noise)
            mean, variance, n = mean + gain * (v - mean), gain * noise, n + 1
        state.update((mean, variance, n))
        yield pd.DataFrame({by: [key[0]], "mean": [mean], "variance": [variance], "n": [n]})

    return stream.select(by, *order, value).groupBy(by).applyInPandasWithState(step, f"{by} {kind}, mean double, variance double, n long", "mean double, variance double, n long", "update", GroupStateTimeout.NoTimeout)


def lag_features(stream: DataFrame, by: str, order: list[str], value: str, depth: int) -> DataFrame:
    """The last ``depth`` values before each row (oldest first), kept as state: (by, order..., features, target)."""
    kinds = dict(stream.dtypes)

    def step(key, frames, state: GroupState):
        (past,) = state.get if state.exists else ([],)
        past, out = list(past), []
        for *at, v in pd.concat(list(frames)).sort_values(order, kind="stable")[[*order, value]].itertuples(index=False):
            if len(past) == depth:
                out.append((key[0], *at, list(past), float(v)))
            past = [*past, float(v)][-depth:]
        state.update((past,))
        yield pd.DataFrame(out, columns=[by, *order, "features", "target"])

    return stream.select(by, *order, value).groupBy(by).applyInPandasWithState(step, f"{by} {kinds[by]}, {', '.join(f'{c} {kinds[c]}' for c in order)}, features array<double>, target double", "past array<double>", "append", GroupStateTimeout.NoTimeout)


def drain(result: DataFrame, name: str, mode: str) -> DataFrame:
    """Runs a stream over what is there now and gives the table it made, from the shared folder.

    Each batch is a table of its own, written by the executors; a batch that runs again overwrites it.
    In the complete mode the last batch is the whole result. State and progress lie in the shared folder too.
    """
    spark, path = result.sparkSession, new_path(result.sparkSession, "drained")
    done: list[int] = []

    def put(batch: DataFrame, k: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/{k}")
        if k not in done:
            done.append(k)

    writer = result.writeStream.outputMode(mode).queryName(name).option("checkpointLocation", new_path(spark, "progress"))
    writer.foreachBatch(put).trigger(availableNow=True).start().awaitTermination()
    if not done:
        return spark.createDataFrame([], result.schema)
    kept = done[-1:] if mode == "complete" else done
    return spark.read.schema(result.schema).parquet(*(f"{path}/{k}" for k in kept))
