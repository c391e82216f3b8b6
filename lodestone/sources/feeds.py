"""Dataset feeds: repetition, shuffles, batches, caches, tensors as structs."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.ordered import grouped
from lodestone.session import durable


def repeat(df: DataFrame, n: int) -> DataFrame:
    """n copies of each row: an exploded array, no join; n up to 0 leaves the frame as it is."""
    return df if n <= 0 else df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def shuffle(df: DataFrame, seed: int) -> DataFrame:
    return df.orderBy(F.rand(seed))


def shuffle_and_repeat(df: DataFrame, n: int, seed: int) -> DataFrame:
    return repeat(df, n).orderBy(*(["epoch"] if n > 0 else []), F.rand(seed))


def batch(df: DataFrame, value: str, n: int, order: list) -> DataFrame:
    return grouped(df, value, n, order)


def cache(df: DataFrame, where: str = "none") -> DataFrame:
    """``none``, ``memory`` or ``file`` (a table in the shared folder)."""
    return {"none": lambda: df, "memory": lambda: df.persist(StorageLevel.MEMORY_AND_DISK), "file": lambda: durable(df, "cache")}[where]()


def feed(df: DataFrame, size: int) -> Iterator[list]:
    """Batches of rows, partition after partition, for a trainer outside Spark."""
    held = []
    for row in df.toLocalIterator(prefetchPartitions=True):
        held.append(row)
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held


def unfold(spark, start: float, step, n: int) -> DataFrame:
    """(k, value): start, step(start), step(step(start))...: n rows of a recursion, which one task works out."""
    first = F.array(F.lit(float(start)))
    values = F.aggregate(F.sequence(F.lit(1), F.lit(n - 1)), first, lambda a, _: F.concat(a, F.array(step(F.element_at(a, -1))))) if n > 1 else first
    return spark.range(1 if n > 0 else 0).select(F.posexplode(values).alias("k", "value"))


def unbounded(spark, rows_per_second: int, value) -> DataFrame:
    """An endless stream (timestamp, k, value) of a function of its row number."""
    return spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load().select("timestamp", F.col("value").alias("k"), value(F.col("value")).alias("value"))


def slices(df: DataFrame, column: str, out: str = "slice") -> DataFrame:
    """Each outermost element of an array as a row."""
    return df.select(*(c for c in df.columns if c != column), F.posexplode(column).alias("index", out))


def tensor(data: Column, shape: list[int], kind: str = "double") -> Column:
    """struct<shape, data>: values row after row; a wrong number of values is null."""
    size = 1
    for s in shape:
        size *= s
    made = F.struct(F.array(*map(F.lit, shape)).alias("shape"), data.cast(f"array<{kind}>").alias("data"))
    return F.when(F.size(data) == size, made)


def filled(shape: list[int], value: float) -> Column:
    size = 1
    for s in shape:
        size *= s
    return tensor(F.array_repeat(F.lit(float(value)), size), shape)


def random_tensor(shape: list[int], seed: int) -> Column:
    size = 1
    for s in shape:
        size *= s
    return tensor(F.array(*(F.rand(seed + i) for i in range(size))), shape)


def stack(*tensors: Column) -> Column:
    """Along a new first axis."""
    return F.struct(F.concat(F.array(F.lit(len(tensors))), tensors[0]["shape"]).alias("shape"), F.concat(*(t["data"] for t in tensors)).alias("data"))


def unstack(t: Column) -> Column:
    """An array of the tensors along the first axis."""
    n = F.element_at(t["shape"], 1)
    each = (F.size(t["data"]) / n).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.slice(t["shape"], F.lit(2), F.size(t["shape"]) - 1).alias("shape"), F.slice(t["data"], i * each + 1, each).alias("data")))


def concatenate(*tensors: Column) -> Column:
    """Along the first axis."""
    first = tensors[0]["shape"]
    rows = F.element_at(first, 1)
    for t in tensors[1:]:
        rows = rows + F.element_at(t["shape"], 1)
    return F.struct(F.concat(F.array(rows), F.slice(first, F.lit(2), F.size(first) - 1)).alias("shape"), F.concat(*(t["data"] for t in tensors)).alias("data"))
