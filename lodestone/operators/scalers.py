"""Reversible transforms: scalers fitted by one aggregation, and encoders."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.scalar import normal_cdf, probit


def literal(values) -> Column:
    return F.array(*(F.lit(float(v)) for v in values))


def linear(matrix, x: Column) -> Column:
    """matrix · x for a small constant matrix, as an array expression."""
    return F.array(*(F.aggregate(F.zip_with(literal(row), x, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v) for row in np.asarray(matrix)))


@dataclass
class Scaler:
    """A forward and an inverse function on columns; ``>>`` composes, the inverse in reverse."""

    forward: Callable[[Column], Column]
    backward: Callable[[Column], Column]
    state: dict = field(default_factory=dict)

    def apply(self, df: DataFrame, column: str) -> DataFrame:
        return df.withColumn(column, self.forward(F.col(column)))

    def invert(self, df: DataFrame, column: str) -> DataFrame:
        return df.withColumn(column, self.backward(F.col(column)))

    def __rshift__(self, after: Scaler) -> Scaler:
        return Scaler(lambda x: after.forward(self.forward(x)), lambda y: self.backward(after.backward(y)))

    def __mul__(self, other: Scaler) -> Scaler:
        """On a struct of two fields ``_1`` and ``_2``."""
        pair = lambda f, g: lambda x: F.struct(f(x["_1"]).alias("_1"), g(x["_2"]).alias("_2"))
        return Scaler(pair(self.forward, other.forward), pair(self.backward, other.backward))


def _moments(df: DataFrame, vector: str) -> tuple[np.ndarray, ...]:
    size = df.select(F.max(F.size(vector))).first()[0] or 0
    cells = [F.col(vector)[i].cast("double") for i in range(size)]
    row = df.agg(*(f(c).alias(f"{n}{i}") for i, c in enumerate(cells) for n, f in (("m", F.avg), ("s", F.stddev_samp), ("l", F.min), ("h", F.max)))).first()
    return tuple(np.array([row[f"{n}{i}"] for i in range(size)], float) for n in "mslh")


def covariance_of(df: DataFrame, vector: str) -> tuple[np.ndarray, np.ndarray]:
    """Mean and sample covariance of an array column, in one aggregation."""
    size = df.select(F.max(F.size(vector))).first()[0] or 0
    at = [(i, j) for i in range(size) for j in range(i, size)]
    c = lambda i: F.col(vector)[i].cast("double")
    row = df.agg(F.array(*(F.avg(c(i)) for i in range(size))).alias("m"), F.array(*(F.covar_samp(c(i), c(j)) for i, j in at)).alias("c")).first()
    cov = np.zeros((size, size))
    for (i, j), v in zip(at, row["c"], strict=True):
        cov[i, j] = cov[j, i] = v
    return np.array(row["m"]), cov


def gaussian(mean, deviation) -> Scaler:
    m, s = literal(mean), literal(deviation)
    return Scaler(
        lambda x: F.zip_with(F.zip_with(x, m, lambda a, b: a - b), s, lambda a, b: a / b),
        lambda y: F.zip_with(F.zip_with(y, s, lambda a, b: a * b), m, lambda a, b: a + b),
        {"mean": list(map(float, mean)), "deviation": list(map(float, deviation))},
    )


def univariate_gaussian(mean: float, deviation: float) -> Scaler:
    if deviation <= 0:
        raise ValueError("the deviation must be positive")
    return Scaler(lambda x: (x - mean) / deviation, lambda y: y * deviation + mean, {"mean": mean, "deviation": deviation})


def centred(mean) -> Scaler:
    m = literal(mean)
    return Scaler(lambda x: F.zip_with(x, m, lambda a, b: a - b), lambda y: F.zip_with(y, m, lambda a, b: a + b), {"mean": list(map(float, mean))})


def univariate_centred(mean: float) -> Scaler:
    return Scaler(lambda x: x - mean, lambda y: y + mean, {"mean": mean})


def min_max(low, high) -> Scaler:
    lo, span = literal(low), literal(np.asarray(high, float) - np.asarray(low, float))
    return Scaler(
        lambda x: F.zip_with(F.zip_with(x, lo, lambda a, b: a - b), span, lambda a, b: a / b),
        lambda y: F.zip_with(F.zip_with(y, span, lambda a, b: a * b), lo, lambda a, b: a + b),
        {"min": list(map(float, low)), "max": list(map(float, high))},
    )


def whitening(mean, cov) -> Scaler:
    """Rᵀ(x - µ) with R the lower Cholesky factor of the inverse covariance."""
    r = np.linalg.cholesky(np.linalg.inv(np.asarray(cov, float)))
    m = literal(mean)
    return Scaler(
        lambda x: linear(r.T, F.zip_with(x, m, lambda a, b: a - b)),
        lambda y: F.zip_with(linear(np.linalg.inv(r.T), y), m, lambda a, b: a + b),
        {"mean": list(map(float, mean)), "r": r.tolist()},
    )


def principal(mean, cov, share: float | None = None) -> Scaler:
    """Vᵀ(x - c); with ``share`` only the leading directions up to the first cumulative share above it."""
    values, vectors = np.linalg.eigh(np.asarray(cov, float))
    order = np.argsort(values)[::-1]
    values, vectors = values[order], vectors[:, order]
    if share is not None:
        reached = np.cumsum(values) / values.sum()
        vectors = vectors[:, : int(np.searchsorted(reached, share, "right")) + 1]
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])] < 0, -1, 1)
    m = literal(mean)
    return Scaler(
        lambda x: linear(vectors.T, F.zip_with(x, m, lambda a, b: a - b)),
        lambda y: F.zip_with(linear(vectors, y), m, lambda a, b: a + b),
        {"mean": list(map(float, mean)), "vectors": vectors.tolist(), "values": values.tolist()},
    )


probit_scaler = Scaler(lambda x: F.transform(x, normal_cdf), lambda y: F.transform(y, probit))


def fit(df: DataFrame, vector: str, kind: str, share: float | None = None) -> Scaler:
    """``gaussian``, ``mean``, ``minmax``, ``whitening`` or ``pca``, fitted on an array column."""
    if kind in ("whitening", "pca"):
        mean, cov = covariance_of(df, vector)
        return whitening(mean, cov) if kind == "whitening" else principal(mean, cov, share)
    mean, deviation, low, high = _moments(df, vector)
    return {"gaussian": lambda: gaussian(mean, deviation), "mean": lambda: centred(mean), "minmax": lambda: min_max(low, high)}[kind]()


def fit_split(df: DataFrame, vectors: list[str], kind: str, split: str = "split") -> tuple[DataFrame, dict[str, Scaler]]:
    """Fits on the train rows and applies to all; gives the scalers back for the inverse."""
    train = df.where(F.col(split) == "train")
    scalers = {v: fit(train, v, kind) for v in vectors}
    for v, s in scalers.items():
        df = s.apply(df, v)
    return df, scalers


def standardise(df: DataFrame, features: str, target: str, kinds: tuple[str, str] = ("gaussian", "gaussian")) -> tuple[DataFrame, tuple[Scaler, Scaler]]:
    """Array columns of features and targets scaled, each by its own kind; sample deviations (n - 1).

    Gives the scaled frame and both scalers, whose inverses lead back.
    """
    both = fit(df, features, kinds[0]), fit(df, target, kinds[1])
    return both[1].apply(both[0].apply(df, features), target), both


# -- encoders ------------------------------------------------------------------------------------


@dataclass
class Encoder:
    encode: Callable
    decode: Callable

    def __rshift__(self, after: Encoder) -> Encoder:
        return Encoder(lambda x: after.encode(self.encode(x)), lambda y: self.decode(after.decode(y)))

    def __mul__(self, other: Encoder) -> Encoder:
        both = lambda f, g: lambda x: (f(x[0]), g(x[1]))
        return Encoder(both(self.encode, other.encode), both(self.decode, other.decode))


def mixed_radix(arities: list[int]) -> Encoder:
    """Digits (array) to one number, the first digit least significant, and back."""
    if min(arities) < 2:
        raise ValueError("arities must be at least 2")
    weights = [int(np.prod(arities[:i], dtype=object)) for i in range(len(arities))]
    constants = F.array(*(F.lit(w).cast("long") for w in weights))

    def decode(n: Column) -> Column:
        return F.array(*(F.pmod(F.floor(n / F.lit(w)), F.lit(a)).cast("int") for w, a in zip(weights, arities, strict=True)))

    return Encoder(lambda d: F.aggregate(F.zip_with(d, constants, lambda a, b: a * b), F.lit(0).cast("long"), lambda s, v: s + v), decode)


def map_vector(keys: list[str]) -> Encoder:
    """Map of names to an array in the order of the names, and back."""
    names = F.array(*map(F.lit, keys))
    return Encoder(lambda m: F.transform(names, lambda k: F.try_element_at(m, k)), lambda v: F.map_from_arrays(names, v))


def replicate(n: int) -> Encoder:
    """A value n times, and the first back."""
    return Encoder(lambda x: F.array_repeat(x, n), lambda a: F.element_at(a, 1))


def replicate_vector(n: int) -> Encoder:
    """A vector repeated n times end to end, and its first copy back."""
    return Encoder(lambda x: F.flatten(F.array_repeat(x, n)), lambda a: F.slice(a, F.lit(1), (F.size(a) / n).cast("int")))


def chunked(n: int) -> Encoder:
    """A vector cut in chunks of n, and joined again."""
    return Encoder(lambda x: F.transform(F.sequence(F.lit(0), F.ceil(F.size(x) / n).cast("int") - 1), lambda i: F.slice(x, i * n + 1, F.lit(n))), F.flatten)
