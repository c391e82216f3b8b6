"""Hyper-parameter search: energies of configurations, evaluated in parallel or one after another."""

from __future__ import annotations

import itertools
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Energy = Callable[[dict[str, float]], float]


@dataclass
class Tuner:
    """Defaults that the searches share."""

    step: float = 0.3
    size: int = 3
    samples: int = 20
    iterations: int = 10
    seed: int = 0


def grid(start: dict[str, float], step: float = 0.3, size: int = 3, logarithmic: bool = False) -> list[dict[str, float]]:
    """value - (i + 1) * step for each parameter, or value / exp((i + 1) * step)."""
    axis = lambda v: [v / np.exp((i + 1) * step) if logarithmic else v - (i + 1) * step for i in range(size)]
    return [dict(zip(start, map(float, c), strict=True)) for c in itertools.product(*(axis(v) for v in start.values()))]


def landscape(spark: SparkSession, configs: list[dict[str, float]], energy: Energy) -> DataFrame:
    """(config map, energy): each configuration is a task's row; the energy runs on the executors."""
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(configs)], "i int, config map<string,double>").repartition(max(1, min(len(configs), 200)))

    def run(frames):
        for pdf in frames:
            yield pd.DataFrame({"i": pdf["i"], "config": pdf["config"], "energy": [float(energy(dict(c))) for c in pdf["config"]]})

    return rows.mapInPandas(run, "i int, config map<string,double>, energy double")


def landscape_by_group(df: DataFrame, group: str, configs: list[dict[str, float]], energy, features: str = "features", target: str = "target") -> DataFrame:
    """(i, config, energy): of each configuration the sum over the groups of ``energy`` (config, x, y).

    All rows count: a group's models are trained in its task, and the sums are combined before they move.
    """
    spark = df.sparkSession

    def run(_, pdf):
        pdf = pdf.sort_values(target, ignore_index=True)
        x, y = np.array(pdf[features].tolist(), float).reshape(len(pdf), -1), pdf[target].to_numpy(float)
        return pd.DataFrame({"i": range(len(configs)), "energy": [float(energy(c, x, y)) for c in configs]})

    sums = df.select(group, features, target).groupBy(group).applyInPandas(run, "i int, energy double").groupBy("i").agg(F.sum("energy").alias("energy"))
    names = spark.createDataFrame([(i, c) for i, c in enumerate(configs)], "i int, config map<string,double>")
    return names.join(sums, "i").select("i", "config", "energy")


def best(found: DataFrame) -> tuple[dict[str, float], float]:
    """The least energy; of equal ones the configuration that came last."""
    r = found.agg(F.min_by(F.struct("config", "energy"), F.struct("energy", (-F.col("i")).alias("i"))).alias("b")).first()["b"]
    return dict(r["config"]), r["energy"]


def grid_search(spark: SparkSession, start: dict[str, float], energy: Energy, tuner: Tuner | None = None, logarithmic: bool = False):
    t = tuner or Tuner()
    return best(landscape(spark, grid(start, t.step, t.size, logarithmic), energy))


def prior_search(spark: SparkSession, priors: dict[str, Callable[[np.random.Generator], float]], energy: Energy, tuner: Tuner | None = None):
    """Configurations drawn from priors."""
    t = tuner or Tuner()
    rng = np.random.default_rng(t.seed)
    return best(landscape(spark, [{k: float(d(rng)) for k, d in priors.items()} for _ in range(t.samples)], energy))


#: How coupled annealers accept: by the ratio to all, by blind ratio, or with a variance-steered temperature.
ACCEPTANCE = ("classic", "mutual", "modified", "blind", "variance")


def annealing(start: dict[str, float], energy: Energy, kind: str = "mutual", tuner: Tuner | None = None, width: float = 1.0) -> tuple[dict[str, float], float]:
    """Coupled simulated annealing: a population with Cauchy mutations and shared acceptance."""
    if kind not in ACCEPTANCE:
        raise ValueError(f"acceptance is one of {ACCEPTANCE}")
    t = tuner or Tuner()
    rng = np.random.default_rng(t.seed)
    names = list(start)
    population = np.array([[start[k] * (1 + 0.1 * i * (-1) ** i) for k in names] for i in range(t.samples)])
    at = lambda x: float(energy(dict(zip(names, map(float, x), strict=True))))
    energies = np.array([at(x) for x in population])
    hold, temperature = 1.0, width
    least, where = energies.min(), population[energies.argmin()].copy()
    for k in range(1, t.iterations + 1):
        moved = np.abs(population + temperature / k * rng.standard_cauchy(population.shape))
        new = np.array([at(x) for x in moved])
        term = np.exp(np.clip((energies - energies.max()) / hold, -700, 0))
        if kind == "classic":
            chance = np.exp(np.clip((energies - new) / hold, -700, 0))
        elif kind == "mutual":
            chance = np.exp(np.clip((energies - energies.max()) / hold, -700, 0)) / term.sum()
        elif kind == "modified":
            chance = term / term.sum()
        elif kind == "blind":
            chance = 1 - term / term.sum()
        else:
            chance = term / term.sum()
            goal = 0.99 * (len(term) - 1) / len(term) ** 2
            hold *= 0.95 if chance.var() < goal else 1.05
        take = (new < energies) | (rng.random(len(new)) < chance)
        population[take], energies[take] = moved[take], new[take]
        if kind != "variance":
            hold = max(hold * 0.95, 1e-6)
        if energies.min() < least:
            least, where = energies.min(), population[energies.argmin()].copy()
    return dict(zip(names, map(float, where), strict=True)), float(least)


def cma_es(start: dict[str, float], energy: Energy, tuner: Tuner | None = None, sigma: float = 0.3) -> tuple[dict[str, float], float]:
    """Covariance matrix adaptation with rank-one and rank-µ updates."""
    t = tuner or Tuner()
    rng, names = np.random.default_rng(t.seed), list(start)
    n = len(names)
    lam = max(4 + int(3 * np.log(n)), t.samples)
    mu = lam // 2
    w = np.log(mu + 0.5) - np.log(np.arange(1, mu + 1))
    w /= w.sum()
    eff = 1 / (w**2).sum()
    cc, cs = (4 + eff / n) / (n + 4 + 2 * eff / n), (eff + 2) / (n + eff + 5)
    c1 = 2 / ((n + 1.3) ** 2 + eff)
    cmu = min(1 - c1, 2 * (eff - 2 + 1 / eff) / ((n + 2) ** 2 + eff))
    damp, chi = 1 + 2 * max(0, np.sqrt((eff - 1) / (n + 1)) - 1) + cs, np.sqrt(n) * (1 - 1 / (4 * n) + 1 / (21 * n * n))
    mean, cov, pc, ps = np.array([start[k] for k in names], float), np.eye(n), np.zeros(n), np.zeros(n)
    at = lambda x: float(energy(dict(zip(names, map(float, x), strict=True))))
    least, where = at(mean), mean.copy()
    for k in range(1, t.iterations + 1):
        values, vectors = np.linalg.eigh(cov)
        root = vectors * np.sqrt(np.maximum(values, 1e-20))
        steps = rng.standard_normal((lam, n)) @ root.T
        energies = np.array([at(mean + sigma * s) for s in steps])
        order = energies.argsort()[:mu]
        if energies[order[0]] < least:
            least, where = energies[order[0]], mean + sigma * steps[order[0]]
        move = w @ steps[order]
        mean = mean + sigma * move
        ps = (1 - cs) * ps + np.sqrt(cs * (2 - cs) * eff) * (vectors @ ((vectors.T @ move) / np.sqrt(np.maximum(values, 1e-20))))
        ok = np.linalg.norm(ps) / np.sqrt(1 - (1 - cs) ** (2 * k)) < (1.4 + 2 / (n + 1)) * chi
        pc = (1 - cc) * pc + ok * np.sqrt(cc * (2 - cc) * eff) * move
        cov = (1 - c1 - cmu) * cov + c1 * np.outer(pc, pc) + cmu * (steps[order].T * w) @ steps[order]
        sigma *= np.exp(cs / damp * (np.linalg.norm(ps) / chi - 1))
    return dict(zip(names, map(float, where), strict=True)), float(least)


def gradient_search(start: dict[str, float], energy: Energy, gradient: Callable[[dict[str, float]], dict[str, float]] | None = None, rate: float = 0.1, iterations: int = 20) -> tuple[dict[str, float], float]:
    """θ ← |θ - α g|; the gradient by central differences if none is given."""
    now = dict(start)
    for _ in range(iterations):
        g = gradient(now) if gradient else {k: (energy(now | {k: v + 1e-5}) - energy(now | {k: v - 1e-5})) / 2e-5 for k, v in now.items()}
        now = {k: abs(v - rate * g[k]) for k, v in now.items()}
    return now, energy(now)
