"""State-space models: simulation, Kalman filters as a fold or a group function, Markov chains in parallel."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.operators.ordered import scan, with_position
from lodestone.session import durable


def simulate(spark: SparkSession, n: int, level: float = 0.0, system: float = 1.0, noise: float = 1.0, seed: int = 0) -> DataFrame:
    """(time, state, observation) of a random walk with observation noise."""
    # written out: draws must not change between the passes of the scan
    base = durable(spark.range(n).select(F.col("id").cast("double").alias("time"), (F.randn(seed) * math.sqrt(system)).alias("step"), (F.randn(seed + 1) * math.sqrt(noise)).alias("e")), "draws")
    walk = scan(base, "step", ["time"], out="walk")
    return walk.select("time", (level + F.col("walk")).alias("state"), (level + F.col("walk") + F.col("e")).alias("observation"))


def kalman(df: DataFrame, by: list[str], time: list[str], value: str, system: float, noise: float, mean: float = 0.0, variance: float = 1.0) -> DataFrame:
    """First-order filter of each series as a fold in order: (by, n, mean, variance, log_likelihood).

    Pure expressions over a sorted array of each series, which must fit a task.
    """
    start = F.struct(F.lit(mean).alias("m"), F.lit(variance).alias("c"), F.lit(0.0).alias("l"))

    def step(s: Column, r: Column) -> Column:
        predicted = s["c"] + system
        q = predicted + noise
        e = r["v"] - s["m"]
        gain = predicted / q
        return F.struct((s["m"] + gain * e).alias("m"), (gain * noise).alias("c"), (s["l"] - (F.log(2 * math.pi * q) + e * e / q) / 2).alias("l"))

    rows = df.where(F.col(value).isNotNull()).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*time, F.col(value).cast("double").alias("v")))).alias("rows"))
    return rows.select(*by, F.size("rows").alias("n"), F.aggregate("rows", start, step).alias("s")).select(*by, "n", F.col("s.m").alias("mean"), F.col("s.c").alias("variance"), F.col("s.l").alias("log_likelihood"))


def kalman_path(df: DataFrame, by: list[str], order: list[str], value: str, system: float, noise: float, mean: float = 0.0, variance: float = 1.0, block: int = 512) -> DataFrame:
    """The filtered mean and variance after each observation: (by, order..., mean, variance).

    The variance after k steps doesn't depend on the data: it is worked out once, until it stands
    still. A step is then m → a·m + b, and such steps compose: runs of ``block`` rows are one such
    map each, and the maps before a run are composed by doubling, on a row a run. So a long
    series is many tasks.
    """
    rows = df.where(F.col(value).isNotNull()).select(*by, *order, F.col(value).cast("double").alias("__v"))
    gains, c = [], variance
    while len(gains) < 10_000:
        p = c + system
        gains.append((p / (p + noise), p / (p + noise) * noise))
        if len(gains) > 1 and abs(gains[-1][1] - c) <= 1e-15 * abs(c):
            break
        c = gains[-1][1]
    known = F.array(*(F.struct(F.lit(g).alias("g"), F.lit(v).alias("c")) for g, v in gains))
    numbered = _numbered_within(rows, by, order, block)
    step = F.element_at(known, F.least(F.col("__k") + 1, F.lit(len(gains))).cast("int"))
    steps = numbered.withColumns({"__g": step["g"], "variance": step["c"], "__run": F.floor(F.col("__k") / block)})
    keys = [*by, "__run"]
    ordered = F.array_sort(F.collect_list(F.struct("__k", "__g", "__v", "variance", *order)))
    runs = durable(steps.groupBy(*keys).agg(ordered.alias("__rows")), "runs")
    start = F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b"))
    then = lambda s, r: F.struct((s["a"] * (1 - r["__g"])).alias("a"), (s["b"] * (1 - r["__g"]) + r["__g"] * r["__v"]).alias("b"))
    whole = runs.select(*keys, F.aggregate("__rows", start, then).alias("m"))
    most = whole.agg(F.max("__run")).first()[0] or 0
    at = Window.partitionBy(*by).orderBy("__run")  # a row a run
    for turn in range(int(most).bit_length()):
        before = F.lag("m", 1 << turn).over(at)
        whole = whole.withColumn("m", F.when(before.isNull(), F.col("m")).otherwise(F.struct((F.col("m.a") * before["a"]).alias("a"), (F.col("m.a") * before["b"] + F.col("m.b")).alias("b"))))
    past = F.lag("m", 1).over(at)
    into = whole.select(*keys, F.coalesce(past["a"] * F.lit(mean) + past["b"], F.lit(mean)).alias("__m"))
    joined = runs.join(into, keys)
    path = F.aggregate(
        "__rows",
        F.struct(F.col("__m").alias("m"), F.array().cast("array<double>").alias("path")),
        lambda s, r: F.struct((s["m"] + r["__g"] * (r["__v"] - s["m"])).alias("m"), F.concat(s["path"], F.array(s["m"] + r["__g"] * (r["__v"] - s["m"]))).alias("path")),
    )["path"]
    out = joined.select(*by, F.explode(F.arrays_zip(F.col("__rows").alias("r"), path.alias("p"))).alias("z"))
    return out.select(*by, *(F.col(f"z.r.{c}").alias(c) for c in order), F.col("z.p").alias("mean"), F.col("z.r.variance").alias("variance"))


def _numbered_within(df: DataFrame, by: list[str], order: list[str], block: int) -> DataFrame:
    """``__k`` from 0 in each group's order, by one range shuffle: a group's place less that of its first row."""
    placed = durable(with_position(df, [*by, *order], "__pos"), "placed")
    first = placed.groupBy(*by).agg(F.min("__pos").alias("__first"))
    return placed.join(first, by).withColumn("__k", F.col("__pos") - F.col("__first")).drop("__pos", "__first")


def metropolis(spark: SparkSession, log_density, start: list[float], steps: int, chains: int = 4, width: float = 1.0, seed: int = 0, adaptive: bool = False) -> DataFrame:
    """(chain, step, accepted, x): random-walk chains, one a task. Rejected steps repeat the old point.

    Adaptive chains propose, after 2d steps, from (1-β)²·2.38²/d times their covariance plus
    a fixed part, β = 0.05.
    """
    d = len(start)

    def run(key, pdf):
        rng = np.random.default_rng([seed, int(key[0])])
        x, at, out, beta = np.array(start, float), log_density(np.array(start, float)), [], 0.05
        for k in range(steps):
            if adaptive and k > 2 * d:
                cov = np.cov(np.array([o[3] for o in out]).T).reshape(d, d)
                l = np.linalg.cholesky(cov * ((1 - beta) * 2.38) ** 2 / d + np.eye(d) * (0.1 * beta) ** 2 / d)  # noqa: E741
            else:
                l = np.eye(d) * width  # noqa: E741
            y = x + l @ rng.standard_normal(d)
            new = log_density(y)
            ok = np.log(rng.random()) < new - at
            if ok:
                x, at = y, new
            out.append((int(key[0]), k, bool(ok), x.tolist()))
        return pd.DataFrame(out, columns=["chain", "step", "accepted", "x"])

    return spark.range(chains).select(F.col("id").alias("chain")).groupBy("chain").applyInPandas(run, "chain long, step long, accepted boolean, x array<double>")


def abc(spark: SparkSession, prior: Column, simulate_from, distance_to, tolerance: float, n: int) -> DataFrame:
    """Approximate Bayesian computation: prior draws whose simulated data come near the observed."""
    drawn = spark.range(n).select(prior.alias("theta"))
    return drawn.withColumn("data", simulate_from(F.col("theta"))).withColumn("distance", distance_to(F.col("data"))).where(F.col("distance") <= tolerance)
