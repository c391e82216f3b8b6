"""Gaussian and Student-T processes, LS-SVM and their committees.

Training sets are small by nature (their cost is cubic): they are gathered to the driver
behind a bound, solved there, and the fitted model goes to the executors, which predict
whatever number of rows in Arrow batches. Many small models fit in parallel, one a group.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.plans.gram import Gram

MOST = 10_000
SLICE = 256


def gather(df: DataFrame, features: str = "features", target: str = "target", most: int = MOST) -> tuple[np.ndarray, np.ndarray]:
    """The training set as arrays, ordered by its values; more than ``most`` rows are refused, never cut off."""
    rows = df.select(features, target).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} training rows")
    rows.sort(key=lambda r: (r[0], r[1]))
    return np.array([r[0] for r in rows], float), np.array([r[1] for r in rows], float)


def gather_distinct(df: DataFrame, features: str = "features", target: str = "target", most: int = MOST) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Distinct points, the means of their targets, how many rows each has, the squared deviations from those means.

    What a kernel model needs to know of any number of rows; more than ``most`` distinct points are refused.
    """
    y = F.col(target).cast("double")
    rows = df.groupBy(F.col(features).alias("x")).agg(F.avg(y).alias("y"), F.count("*").alias("n"), (F.var_pop(y) * F.count("*")).alias("s")).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} distinct training points")
    rows.sort(key=lambda r: r["x"])
    return *(np.array([r[c] for r in rows], float) for c in "xyn"), float(sum(r["s"] for r in rows))


def predict_batches(df: DataFrame, model, features: str = "features", columns: tuple[str, ...] = ("mean", "variance"), answer=None) -> DataFrame:
    """Adds what ``model.posterior`` (or ``answer``) gives, in Arrow batches on the executors."""
    answer = answer or model.posterior

    def run(frames):
        for pdf in frames:
            x = np.array(pdf[features].tolist(), float).reshape(len(pdf), -1)
            # slices: a model may look at all pairs of the rows it is given
            parts = [answer(x[i : i + SLICE]) for i in range(0, len(x), SLICE)]
            yield pdf.assign(**{c: np.concatenate([p[k] for p in parts]) if parts else [] for k, c in enumerate(columns)})

    kinds = ", ".join(f"`{n}` {t}" for n, t in df.dtypes)
    return df.mapInPandas(run, f"{kinds}, " + ", ".join(f"{c} double" for c in columns))


def covariance_root(kernel: Gram, noise: Gram, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(covariance of noisy training points, its Cholesky factor).

    Points that repeat share what the noise kernel gives them, which may leave the matrix singular:
    then a hundred-millionth of its mean diagonal is added.
    """
    k = kernel(x, x) + noise(x, x)
    try:
        return k, np.linalg.cholesky(k)
    except np.linalg.LinAlgError:
        k = k + 1e-8 * np.trace(k) / max(1, len(k)) * np.eye(len(k))
        return k, np.linalg.cholesky(k)


@dataclass(frozen=True)
class GaussianProcess:
    kernel: Gram
    noise: Gram
    x: np.ndarray
    y: np.ndarray
    mean: object = staticmethod(lambda x: np.zeros(len(x)))
    #: Where ``x`` are distinct points and ``y`` means: rows a point, and squared deviations from the means.
    counts: np.ndarray | None = None
    scatter: float = 0.0

    @cached_property
    def _covariance(self):
        """(covariance, its Cholesky factor, what was added to a row's diagonal).

        Rows of a point share all that kernels give them: with δ on each row's diagonal the whole
        matrix acts as that of the points with δ over their counts.
        """
        if self.counts is None or (self.counts == 1).all():
            return *covariance_root(self.kernel, self.noise, self.x), 0.0
        k = self.kernel(self.x, self.x) + self.noise(self.x, self.x)
        delta = 1e-8 * float(np.diag(k) @ self.counts / self.counts.sum())
        k = k + np.diag(delta / self.counts)
        return k, np.linalg.cholesky(k), delta

    def size(self) -> float:
        return len(self.y) if self.counts is None else float(self.counts.sum())

    def quadratic(self) -> float:
        """yᵀC⁻¹y over all rows."""
        delta = self._covariance[2]
        return float((self.y - self.mean(self.x)) @ self.factor()[1]) + (self.scatter / delta if delta else 0.0)

    def half_log_determinant(self) -> float:
        _, l, delta = self._covariance  # noqa: E741
        more = ((self.size() - len(l)) * math.log(delta) + float(np.log(self.counts).sum())) / 2 if delta else 0.0
        return float(np.log(np.diag(l)).sum()) + more

    @cached_property
    def _factor(self):
        l = self._covariance[1]  # noqa: E741
        return l, np.linalg.solve(l.T, np.linalg.solve(l, self.y - self.mean(self.x)))

    def factor(self):
        """(Cholesky factor of the covariance, weights of the training points), computed once."""
        return self._factor

    def posterior(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Means and variances; the new points carry no noise."""
        l, a = self.factor()
        k = self.kernel(self.x, x)
        v = np.linalg.solve(l, k)
        return self.mean(x) + k.T @ a, np.diag(self.kernel(x, x)) - (v * v).sum(0)

    def covariance(self, x: np.ndarray) -> np.ndarray:
        l, _ = self.factor()
        v = np.linalg.solve(l, self.kernel(self.x, x))
        return self.kernel(x, x) - v.T @ v

    def bars(self, x: np.ndarray, sigmas: float = 1.0):
        m, v = self.posterior(x)
        sd = np.sqrt(np.maximum(v, 0))
        return m, m - sigmas * sd, m + sigmas * sd

    def energy(self) -> float:
        """Negative log marginal likelihood."""
        return self.quadratic() / 2 + self.half_log_determinant() + self.size() / 2 * math.log(2 * math.pi)


@dataclass(frozen=True)
class StudentProcess(GaussianProcess):
    """``mu`` gives µ + 2 degrees of freedom; n more after n observations."""

    mu: float = 4.0

    def posterior(self, x):
        m, v = super().posterior(x)
        nu, n = self.mu + 2, self.size()
        beta = self.quadratic()
        return m, v * (nu + beta - 2) / (nu + n - 2)

    def energy(self) -> float:
        nu, n = self.mu + 2, self.size()
        beta = self.quadratic()
        return -(math.lgamma((nu + n) / 2) - math.lgamma(nu / 2) - n / 2 * math.log((nu - 2) * math.pi) - self.half_log_determinant() - (nu + n) / 2 * math.log1p(beta / (nu - 2)))


@dataclass(frozen=True)
class MatrixT:
    """Several outputs with a shared kernel and a linear trend, fitted by generalised least squares."""

    kernel: Gram
    noise: Gram
    x: np.ndarray
    y: np.ndarray

    def predict(self, x: np.ndarray):
        """(means, scale matrix between outputs, degrees of freedom)."""
        h = lambda z: np.column_stack([np.ones(len(z)), z])
        _, l = covariance_root(self.kernel, self.noise, self.x)  # noqa: E741
        hx = h(self.x)
        hl, yl = np.linalg.solve(l, hx), np.linalg.solve(l, self.y)
        b = np.linalg.solve(hl.T @ hl, hl.T @ yl)
        r = yl - hl @ b
        dof = len(self.x) - hx.shape[1]
        return h(x) @ b + np.linalg.solve(l, self.kernel(self.x, x)).T @ r, r.T @ r / dof, dof


@dataclass(frozen=True)
class SkewProcess(GaussianProcess):
    """Extended skew Gaussian: moments of the Gaussian process and skewness λ, cutoff τ carried along."""

    skew: float = 1.0
    cutoff: float = 0.0

    def predict(self, x):
        k = self._covariance[0]
        lam = np.full(len(self.x), self.skew)
        beta = np.linalg.solve(k, lam)
        delta = 1 / math.sqrt(1 + lam @ beta)
        m, v = self.posterior(x)
        a = self.factor()[1]
        return m, v, (self.skew - self.kernel(self.x, x).T @ beta) * delta, (self.cutoff + lam @ a) * delta


@dataclass(frozen=True)
class Warped:
    """A process on warped targets: means and bars come back through the inverse warp."""

    inner: GaussianProcess
    warp: object
    unwarp: object
    derivative: object

    @staticmethod
    def fit(process, warp, unwarp, derivative):
        return Warped(replace(process, y=warp(process.y)), warp, unwarp, derivative)

    def bars(self, x, sigmas=1.0):
        return tuple(self.unwarp(v) for v in self.inner.bars(x, sigmas))

    def energy(self, y) -> float:
        """Shifted by the log determinant of the warp's Jacobian."""
        return self.inner.energy() - float(np.log(np.abs(self.derivative(y))).sum())


@dataclass(frozen=True)
class LaplaceClassifier:
    """Labels 1 and -1 under a logistic likelihood, around the posterior's mode."""

    kernel: Gram
    x: np.ndarray
    y: np.ndarray

    @cached_property
    def _mode(self):
        return self.search()

    def search(self, steps: int = 50):
        """(mode, gradient there, root of the curvature, Cholesky factor)."""
        k = self.kernel(self.x, self.x)
        f = np.zeros(len(self.y))
        for _ in range(steps):
            p = 1 / (1 + np.exp(-f))
            w = p * (1 - p)
            root = np.sqrt(w)
            l = np.linalg.cholesky(np.eye(len(f)) + root[:, None] * k * root[None])  # noqa: E741
            grad = (self.y + 1) / 2 - p
            b = w * f + grad
            a = b - root * np.linalg.solve(l.T, np.linalg.solve(l, root * (k @ b)))
            new = k @ a
            if np.abs(new - f).max() < 1e-10:
                break
            f = new
        return f, grad, root, l

    def posterior(self, x):
        """(probability of 1, latent variance)."""
        f, grad, root, l = self._mode  # noqa: E741
        k = self.kernel(self.x, x)
        m = k.T @ grad
        v = np.linalg.solve(l, root[:, None] * k)
        var = np.diag(self.kernel(x, x)) - (v * v).sum(0)
        return 1 / (1 + np.exp(-m / np.sqrt(1 + math.pi * var / 8))), var


@dataclass(frozen=True)
class LeastSquaresSVM:
    """Σ αₖ k(x, xₖ) + b from the bordered linear system."""

    kernel: Gram
    x: np.ndarray
    y: np.ndarray
    regularisation: float = 1.0
    #: Rows a point, where ``x`` are distinct points and ``y`` means.
    counts: np.ndarray | None = None

    @cached_property
    def _solution(self):
        n = len(self.y)
        m = np.zeros((n + 1, n + 1))
        m[0, 1:] = m[1:, 0] = 1
        m[1:, 1:] = self.kernel(self.x, self.x) + np.diag(1 / (np.ones(n) if self.counts is None else self.counts)) / self.regularisation
        out = np.linalg.solve(m, np.r_[0, self.y])
        return out[1:], out[0]

    def solve(self):
        """(α, b), computed once."""
        return self._solution

    def posterior(self, x):
        a, b = self.solve()
        return (self.kernel(x, self.x) @ a + b,)


def committee_weights(errors: np.ndarray) -> np.ndarray:
    """C⁻¹1 / (1ᵀC⁻¹1) for the errors' second moments C."""
    c = errors.T @ errors / len(errors)
    w = np.linalg.solve(c + 1e-12 * np.eye(len(c)), np.ones(len(c)))
    return w / w.sum()


def committee_weights_of(df: DataFrame, predictions: list[str], target: str) -> np.ndarray:
    """The same from prediction columns, in one aggregation."""
    d = [F.col(p) - F.col(target) for p in predictions]
    n = len(d)
    row = df.agg(F.array(*(F.avg(d[i] * d[j]) for i in range(n) for j in range(n)))).first()[0]
    w = np.linalg.solve(np.reshape(row, (n, n)) + 1e-12 * np.eye(n), np.ones(n))
    return w / w.sum()


def energy_weights(energies: np.ndarray, kind: str = "sigmoid", temperature: float = 1.0) -> np.ndarray:
    """Lower energies weigh more: a softmax, or in proportion to the distance from the worst."""
    e = np.asarray(energies, float)
    w = np.exp(-(e - e.min()) / temperature) if kind == "sigmoid" else e.max() - e + 1e-12
    return w / w.sum()


def mixture_moments(means: np.ndarray, variances: np.ndarray, weights: np.ndarray):
    """Mean and variance of a mixture of predictive distributions (a row a model)."""
    m = weights @ means
    return m, weights @ (variances + means**2) - m**2


def fit_by_group(df: DataFrame, group: str, make, features: str = "features", target: str = "target") -> DataFrame:
    """One small process a group, all in parallel: (group, n, energy). Groups must fit a task."""
    kind = dict(df.dtypes)[group]

    def run(key, pdf):
        model = make(np.array(pdf[features].tolist(), float), pdf[target].to_numpy(float))
        return pd.DataFrame({group: [key[0]], "n": [len(pdf)], "energy": [model.energy()]})

    return df.select(group, features, target).groupBy(group).applyInPandas(run, f"{group} {kind}, n long, energy double")


def by_group(df: DataFrame, group: str, order: list[str], run, schema: str, features: str = "features", target: str = "target", most: int = MOST) -> DataFrame:
    """``run`` (x, y, rows in their order) → a pandas frame for each group; ``schema`` are its columns beside the group's.

    All rows of a group train its model, in one task: a group of more than ``most`` rows is refused.
    """
    kind = dict(df.dtypes)[group]

    def each(key, pdf):
        if len(pdf) > most:
            raise ValueError(f"group {key[0]} has {len(pdf)} rows, more than {most}")
        pdf = pdf.sort_values(order, ignore_index=True)
        out = run(np.array(pdf[features].tolist(), float).reshape(len(pdf), -1), pdf[target].to_numpy(float), pdf)
        return out.assign(**{group: key[0]})[[group, *(c for c in out.columns if c != group)]]

    return df.groupBy(group).applyInPandas(each, f"{group} {kind}, {schema}")


def predict_by_group(df: DataFrame, group: str, order: list[str], make, columns: tuple[str, ...] = ("mean", "variance"), answer=None, features: str = "features", target: str = "target", train: str | None = None) -> DataFrame:
    """Each group's model answers for each of the group's rows: (group, order..., target, columns...).

    It is trained on all of them, or on those for which the boolean column ``train`` is true (a
    group without any is answered by nulls); ``train`` then comes along.
    """
    kinds = dict(df.dtypes)
    order = [*order, train] if train else order

    def run(x, y, pdf):
        known = pdf[train].to_numpy(bool) if train else np.ones(len(pdf), bool)
        if not known.any():
            return pd.DataFrame({c: pdf[c] for c in [*order, target]} | {c: np.full(len(pdf), np.nan) for c in columns})
        model = make(x[known], y[known])
        say = answer or (lambda m, z: m.posterior(z))
        return pd.DataFrame({c: pdf[c] for c in [*order, target]} | dict(zip(columns, say(model, x), strict=False)))

    schema = ", ".join([*(f"{c} {kinds[c]}" for c in [*order, target]), *(f"{c} double" for c in columns)])
    return by_group(df.select(group, *order, features, target), group, order, run, schema, features, target)


def free_run(model, start: np.ndarray, steps: int) -> np.ndarray:
    """Recursive forecast: each prediction joins the lags, the oldest leaves (newest last)."""
    lags, out = np.asarray(start, float).copy(), []
    for _ in range(steps):
        value = float(model.posterior(lags[None])[0][0])
        out.append(value)
        lags = np.r_[lags[1:], value]
    return np.array(out)
