"""Composable transforms. A pipe is a plan-to-plan function; a row function works on columns."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Pipe:
    """A function with composition: ``a >> b`` runs a and then b, ``a * b`` runs both on a pair.

    Nothing is evaluated on composing; on frames Spark sees one plan for the whole chain.
    """

    run: Callable[[Any], Any]

    def __call__(self, x: Any) -> Any:
        return self.run(x)

    def __rshift__(self, after: Callable) -> Pipe:
        return Pipe(lambda x: after(self(x)))

    def __mul__(self, other: Callable) -> Pipe:
        return Pipe(lambda pair: (self(pair[0]), other(pair[1])))

    def beside(self, other: Callable) -> Pipe:
        """Two unary pipes as one function of two arguments, giving a pair."""
        return Pipe(lambda pair: (self(pair[0]), other(pair[1])))


identity = Pipe(lambda x: x)


def fork(*pipes: Callable) -> Pipe:
    """x → (f(x), g(x), ...)."""
    return Pipe(lambda x: tuple(p(x) for p in pipes))


def duplicate(pipe: Callable) -> Pipe:
    """Applies one pipe to both sides of a pair."""
    return Pipe(lambda pair: (pipe(pair[0]), pipe(pair[1])))


def merge(f: Callable) -> Pipe:
    """A function of several arguments as a pipe over a tuple."""
    return Pipe(lambda args: f(*args))


def meta(f: Callable) -> Callable[..., Pipe]:
    """A curried pipe: parameters first, then the data."""
    return lambda *params: Pipe(lambda x: f(*params, x))


def side_effect(action: Callable[[DataFrame], None]) -> Pipe:
    """Runs an action on the frame and passes it on."""

    def run(df):
        action(df)
        return df

    return Pipe(run)


def foreach(action: Callable) -> Pipe:
    """Runs an action on each row, where the rows lie, and passes the frame on."""

    def rows(part):
        for row in part:
            action(row)

    return side_effect(lambda df: df.foreachPartition(rows))


def to_rows() -> Pipe:
    """A frame as an iterator of its rows; one partition at a time reaches the driver."""
    return Pipe(lambda df: df.toLocalIterator(prefetchPartitions=True))


def to_frame(spark, schema: str) -> Pipe:
    """Rows (any iterable, bounded by the driver's memory) as a frame."""
    return Pipe(lambda rows: spark.createDataFrame([tuple(r) for r in rows], schema))


def mapped(**columns: Column | Callable[[DataFrame], Column]) -> Pipe:
    """Adds or replaces columns, row by row."""
    return Pipe(lambda df: df.withColumns({k: v(df) if callable(v) and not isinstance(v, Column) else v for k, v in columns.items()}))


def projected(*columns: Column | str) -> Pipe:
    return Pipe(lambda df: df.select(*columns))


def filtered(condition: Column, keep: bool = True) -> Pipe:
    """Rows where the condition holds (or, with ``keep`` false, doesn't); null counts as not holding."""
    sure = F.coalesce(condition, F.lit(False))
    return Pipe(lambda df: df.where(sure if keep else ~sure))


def flat_mapped(array: Column, out: str, position: str | None = None) -> Pipe:
    """One row for each element; rows with a null or empty array give none."""
    made = F.posexplode(array).alias(position, out) if position else F.explode(array).alias(out)
    return Pipe(lambda df: df.select("*", made))


def partitioned(condition: Column) -> Pipe:
    """(rows where it holds, the others); null goes to the others."""
    return fork(filtered(condition), filtered(condition, keep=False))


def split_flag(condition: Column, out: str = "split") -> Pipe:
    """Train and test as a column of one frame."""
    return mapped(**{out: F.when(F.coalesce(condition, F.lit(False)), "train").otherwise("test")})


def chain(*pipes: Callable) -> Pipe:
    return reduce(lambda a, b: a >> b, map(Pipe, pipes), identity)


def unzip(df: DataFrame, left: str = "_1", right: str = "_2", key: str = "pos") -> tuple[DataFrame, DataFrame]:
    """A frame of pairs as two frames that keep the position."""
    return df.select(key, left), df.select(key, right)


def batchwise(function: Callable, schema: str) -> Pipe:
    """A function over Arrow batches of each partition."""
    return Pipe(lambda df: df.mapInArrow(function, schema))


# -- lines of text ---------------------------------------------------------------------------


def drop_head(key: str = "pos") -> Pipe:
    """Without the first line (a header)."""
    return filtered(F.col(key) > 0)


def replaced(pattern: str, by: str, column: str = "value") -> Pipe:
    return mapped(**{column: F.regexp_replace(column, pattern, by)})


def white_to_commas(column: str = "value") -> Pipe:
    return replaced(r"\s+", ",", column)


def trimmed(column: str = "value") -> Pipe:
    return mapped(**{column: F.trim(column)})


def split_lines(column: str = "value", separator: str = ",", out: str = "fields") -> Pipe:
    """Fields of a line; trailing empty fields are dropped, as a JVM split without limit does."""
    return mapped(**{out: F.split(F.regexp_replace(column, f"(?:{separator})+$", ""), separator)})


def extract_columns(columns: list[int], missing: dict[int, str] | None = None, fields: str = "fields") -> Pipe:
    """Fields by position, in the order given, as c0, c1...; a field's missing token becomes null."""
    missing = missing or {}

    def one(k: int) -> Column:
        c = F.try_element_at(fields, F.lit(k + 1))
        return F.nullif(c, F.lit(missing[k])) if k in missing else c

    return Pipe(lambda df: df.select(*(c for c in df.columns if c not in ("value", fields)), *(one(k).alias(f"c{i}") for i, k in enumerate(columns))))


def drop_missing() -> Pipe:
    return Pipe(lambda df: df.dropna("any"))


def features_and_target(features: list[str], target: str) -> Pipe:
    """``features`` array<double> and ``target`` double; what isn't a number becomes null."""
    number = lambda c: F.col(c).try_cast("double")
    return Pipe(lambda df: df.select(*(c for c in df.columns if c not in features and c != target), F.array(*map(number, features)).alias("features"), number(target).alias("target")))


@dataclass
class ModelPipe:
    """Preprocess, fit, and later preprocess, predict and postprocess."""

    fit: Callable[[DataFrame], Any]
    before: Callable = identity
    after: Callable = identity
    model: Any = None

    def train(self, df: DataFrame) -> ModelPipe:
        return ModelPipe(self.fit, self.before, self.after, self.fit(self.before(df)))

    def predict(self, df: DataFrame) -> DataFrame:
        return self.after(self.model.predict(self.before(df)))
