"""Models by name as pipes: what to fit, what to do before and after, ready to train and predict."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.pipes import ModelPipe
from lodestone.plans import glm, processes


@dataclass
class Fitted:
    """A trained kernel model; ``predict`` answers in Arrow batches, with ``score`` as its mean."""

    model: object
    columns: tuple[str, ...]
    answer: object = None

    def predict(self, df: DataFrame) -> DataFrame:
        return processes.predict_batches(df, self.model, columns=self.columns, answer=self.answer).withColumnRenamed(self.columns[0], "score")


def _kernel(make, columns=("mean", "variance"), answer=None):
    """A fit on all rows by their distinct points (bounded by ``processes.MOST``, refused beyond)."""

    def fit(df: DataFrame) -> Fitted:
        model = make(*processes.gather_distinct(df))
        return Fitted(model, columns, answer and (lambda z: answer(model, z)))

    return fit


def _mixture(kernels, noise):
    def make(x, y, n, s):
        return [processes.GaussianProcess(k, noise, x, y, counts=n, scatter=s) for k in kernels]

    def answer(ps, z):
        means, variances = (np.array(v) for v in zip(*(p.posterior(z) for p in ps), strict=True))
        return processes.mixture_moments(means, variances, processes.energy_weights(np.array([p.energy() for p in ps])))

    return _kernel(make, answer=answer)


#: name → fit of a frame with ``features`` (array) and ``target``; options as the models have them.
FITS = {
    "glm": lambda size, **o: lambda d: glm.ridge(d, [F.col("features")[i] for i in range(size)], F.col("target"), **o),
    "gls": lambda size, variance: lambda d: glm.weighted_least_squares(d, [F.col("features")[i] for i in range(size)], F.col("target"), F.col(variance)),
    "logistic": lambda size, **o: lambda d: glm.logistic_model(d, [F.col("features")[i] for i in range(size)], F.col("target"), glm.Options(**o)),
    "svm": lambda kernel, regularisation=1.0: _kernel(lambda x, y, n, s: processes.LeastSquaresSVM(kernel, x, y, regularisation, n), ("mean",)),
    "process": lambda kernel, noise, **o: _kernel(lambda x, y, n, s: processes.GaussianProcess(kernel, noise, x, y, counts=n, scatter=s, **o)),
    "student": lambda kernel, noise, **o: _kernel(lambda x, y, n, s: processes.StudentProcess(kernel, noise, x, y, counts=n, scatter=s, **o)),
    "skew": lambda kernel, noise, **o: _kernel(lambda x, y, n, s: processes.SkewProcess(kernel, noise, x, y, counts=n, scatter=s, **o), ("mean", "variance", "skew"), lambda m, z: m.predict(z)[:3]),
    "mixture": lambda kernels, noise: _mixture(kernels, noise),
}


def model_pipe(name: str, before=lambda d: d, after=lambda d: d, **options) -> ModelPipe:
    """A pipe that trains the named model on what ``before`` makes of its rows; ``after`` sees the predictions."""
    if name not in FITS:
        raise ValueError(f"a model is one of {sorted(FITS)}")
    return ModelPipe(FITS[name](**options), before, after)
