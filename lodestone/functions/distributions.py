"""Random variables as columns: densities, distribution functions and seeded draws."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.scalar import lgamma, normal_cdf, probit

LOG_2PI = math.log(2 * math.pi)


def draws(spark: SparkSession, n: int, partitions: int | None = None, **columns: Column) -> DataFrame:
    """n independent rows (id, ...): seeded columns over a range."""
    return spark.range(0, n, 1, partitions or max(1, n // 1_000_000)).withColumns(columns)


def iid(draw, n: int, seed: int) -> Column:
    """An array of n independent draws; ``draw`` is a function of a seed."""
    return F.array(*(draw(seed + 1009 * k) for k in range(n)))


def joint(spark: SparkSession, n: int, prior: dict[str, Column], conditional) -> DataFrame:
    """Draws of a prior, then of what depends on it: ``conditional`` gives columns from the prior's."""
    return draws(spark, n, **prior).withColumns(conditional({c: F.col(c) for c in prior}))


# -- draws by inverse distribution functions ------------------------------------------------------------


def uniform(low: float, high: float, seed: int) -> Column:
    return low + (high - low) * F.rand(seed)


def gaussian(mean: float, sd: float, seed: int) -> Column:
    return mean + sd * F.randn(seed)


def binomial(n: int, p: float, seed: int) -> Column:
    out = F.lit(0)
    for k in range(n):
        out = out + (F.rand(seed + k) < p).cast("int")
    return out


def categorical(weights: list[float], seed: int) -> Column:
    """An index with the given weights: the cumulative weights below a uniform draw."""
    total, upto, edges = sum(weights), 0.0, []
    for w in weights[:-1]:
        upto += w / total
        edges.append(F.lit(upto))
    u = F.rand(seed)
    return F.size(F.filter(F.array(*edges), lambda e: e < u)) if edges else F.lit(0)


def exponential(rate: float, seed: int) -> Column:
    return -F.log(1 - F.rand(seed)) / rate


def erlang(shape: int, rate: float, seed: int) -> Column:
    out = exponential(rate, seed)
    for k in range(1, shape):
        out = out + exponential(rate, seed + k)
    return out


def kumaraswamy(a: float, b: float, seed: int) -> Column:
    return F.pow(1 - F.pow(1 - F.rand(seed), F.lit(1 / b)), F.lit(1 / a))


def truncated_gaussian(mean: float, sd: float, low: float, high: float, seed: int) -> Column:
    a, b = ((x - mean) / sd for x in (low, high))
    fa, fb = (0.5 * math.erfc(-x / math.sqrt(2)) for x in (a, b))
    return mean + sd * probit(fa + (fb - fa) * F.rand(seed))


def student_t(dof: int, seed: int) -> Column:
    """A normal over the root of a mean of ``dof`` squared normals."""
    chi = F.lit(0.0)
    for k in range(dof):
        z = F.randn(seed + 1 + k)
        chi = chi + z * z
    return F.randn(seed) / F.sqrt(chi / dof)


def skew_gaussian(alpha: float, seed: int) -> Column:
    d = alpha / math.sqrt(1 + alpha * alpha)
    return d * F.abs(F.randn(seed)) + math.sqrt(1 - d * d) * F.randn(seed + 1)


def multivariate_gaussian(mean, root, seed: int) -> Column:
    """mean + root · z, root a lower Cholesky factor."""
    z = [F.randn(seed + k) for k in range(len(mean))]
    rows = []
    for i, m in enumerate(mean):
        v = F.lit(float(m))
        for k in range(i + 1):
            v = v + float(root[i][k]) * z[k]
        rows.append(v)
    return F.array(*rows)


def matrix_gaussian(mean, row_root, column_root, seed: int) -> Column:
    """M + A·Z·Bᵀ with A, B the roots of the covariances of rows and columns, as an array of rows."""
    rows, columns = len(mean), len(mean[0])
    z = [[F.randn(seed + i * columns + j) for j in range(columns)] for i in range(rows)]

    def cell(i, j):
        out = F.lit(float(mean[i][j]))
        for k in range(rows):
            for m in range(columns):
                w = float(row_root[i][k]) * float(column_root[j][m])
                if w:
                    out = out + w * z[k][m]
        return out

    return F.array(*(F.array(*(cell(i, j) for j in range(columns))) for i in range(rows)))


def mixture(weights: list[float], parts: list[Column], seed: int) -> Column:
    return F.array(*parts)[categorical(weights, seed)]


# -- log densities ----------------------------------------------------------------------------------------


def log_gaussian(x: Column, mean: float, sd: float) -> Column:
    return -((x - mean) ** 2) / (2 * sd * sd) - (math.log(sd) + LOG_2PI / 2)


def log_laplace(x: Column, mean: float, b: float) -> Column:
    return -F.abs(x - mean) / b - math.log(2 * b)


def log_student_t(x: Column, dof: float, mean: float, sd: float) -> Column:
    z = (x - mean) / sd
    c = math.lgamma((dof + 1) / 2) - math.lgamma(dof / 2) - 0.5 * math.log(dof * math.pi) - math.log(sd)
    return F.lit(c) - (dof + 1) / 2 * F.log1p(z * z / dof)


def log_gamma(x: Column, shape: float, rate: float) -> Column:
    return F.lit(shape * math.log(rate) - math.lgamma(shape)) + (shape - 1) * F.log(x) - rate * x


def log_erlang(x: Column, shape: int, rate: float) -> Column:
    return log_gamma(x, shape, rate)


def log_beta(x: Column, a: float, b: float) -> Column:
    return (a - 1) * F.log(x) + (b - 1) * F.log(1 - x) - (math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b))


def log_binomial(k: Column, n: int, p: float) -> Column:
    return lgamma(F.lit(n + 1.0)) - lgamma(k + 1.0) - lgamma(n - k + 1.0) + k * math.log(p) + (n - k) * math.log1p(-p)


def kumaraswamy_cdf(x: Column, a: float, b: float) -> Column:
    return 1 - F.pow(1 - F.pow(x, F.lit(a)), F.lit(b))


def truncated_cdf(x: Column, mean: float, sd: float, low: float, high: float) -> Column:
    fa, fb = (0.5 * math.erfc(-(v - mean) / sd / math.sqrt(2)) for v in (low, high))
    inside = (normal_cdf((x - mean) / sd) - fa) / (fb - fa)
    return F.when(x <= low, 0.0).when(x >= high, 1.0).otherwise(inside)


def log_skew_gaussian(x: Column, alpha: float) -> Column:
    return F.log(F.lit(2.0) * normal_cdf(alpha * x)) - x * x / 2 - LOG_2PI / 2


def log_multivariate_gaussian(x: Column, mean, cov) -> Column:
    """Through the inverse Cholesky factor as constants."""
    import numpy as np

    from lodestone.operators.scalers import linear, literal

    l = np.linalg.cholesky(np.asarray(cov, float))  # noqa: E741
    z = linear(np.linalg.inv(l), F.zip_with(x, literal(mean), lambda a, b: a - b))
    return -F.aggregate(z, F.lit(0.0), lambda s, v: s + v * v) / 2 - float(np.log(np.diag(l)).sum() + len(mean) * LOG_2PI / 2)


def log_mixture(parts: list[Column], weights: list[float]) -> Column:
    total = sum(weights)
    terms = F.array(*(p + math.log(w / total) for p, w in zip(parts, weights, strict=True)))
    top = F.array_max(terms)
    return top + F.log(F.aggregate(terms, F.lit(0.0), lambda s, t: s + F.exp(t - top)))


def log_likelihood(df: DataFrame, log_density: Column) -> DataFrame:
    """Of independent rows."""
    return df.agg(F.sum(log_density).alias("log_likelihood"))


def log_sigmoid_likelihood(score: Column, label: Column) -> Column:
    """Label 1 against anything else."""
    s = F.when(label == 1, score).otherwise(-score)
    return -F.log1p(F.exp(-F.abs(s))) + F.least(s, F.lit(0.0))


def log_probit_likelihood(score: Column, label: Column) -> Column:
    return F.log(F.greatest(normal_cdf(F.when(label == 1, score).otherwise(-score)), F.lit(1e-300)))


def accepted(proposals: DataFrame, log_target: Column, log_proposal: Column, log_bound: float, seed: int) -> DataFrame:
    """Rejection sampling over a bounded number of proposals: those under the target stay."""
    return proposals.where(F.log(1 - F.rand(seed)) < log_target - log_proposal - log_bound)
