"""Prototype selection: a working set of greatest Rényi entropy by swaps."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def entropy(x: np.ndarray, width: float) -> float:
    d2 = ((x[:, None] - x[None]) ** 2).sum(2)
    return float(-np.log(np.mean(np.exp(-d2 / (2 * width**2)) / (math.sqrt(2 * math.pi) * width) ** x.shape[1])))


def select(df: DataFrame, vector: str, size: int, width: float = 1.0, tries: int = 200, seed: int = 0) -> np.ndarray:
    """``size`` rows: a seeded draw, then candidates swapped in where they raise the entropy.

    Draw and candidates are the rows of least hash, ``size + tries`` in all: the bound of
    what reaches the driver.
    """
    drawn = df.select(F.col(vector).cast("array<double>").alias("v")).orderBy(F.rand(seed)).limit(size + tries).collect()
    rows = np.array([r["v"] for r in drawn], float)
    work, rng = rows[:size].copy(), np.random.default_rng(seed)
    now = entropy(work, width)
    for candidate in rows[size:]:
        k = rng.integers(size)
        trial = work.copy()
        trial[k] = candidate
        new = entropy(trial, width)
        if new > now:
            work, now = trial, new
    return work
