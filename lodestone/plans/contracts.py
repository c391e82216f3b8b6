"""What models and searches offer each other; any object with these methods will do."""

from __future__ import annotations

from typing import Protocol, runtime_checkable

import numpy as np
from pyspark.sql import DataFrame


@runtime_checkable
class Predictor(Protocol):
    """Answers for a frame's rows with a column more."""

    def predict(self, df: DataFrame) -> DataFrame: ...


@runtime_checkable
class Optimizable(Protocol):
    """Has an energy that a search lowers."""

    def energy(self) -> float: ...


@runtime_checkable
class Posterior(Protocol):
    """Answers for points with arrays: means, and variances where it has them."""

    def posterior(self, x: np.ndarray) -> tuple[np.ndarray, ...]: ...
