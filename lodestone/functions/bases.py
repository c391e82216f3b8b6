"""Feature maps: a scalar or a vector to an array, as column expressions."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions import scalar


def fourier(period: float, n: int):
    """1, then cosines (negative index) and sines (positive) of the n frequencies below and above zero."""
    def f(x: Column) -> Column:
        w = 2 * math.pi / period
        return F.array(F.lit(1.0), *((F.cos if i < 0 else F.sin)(x * (w * i)) for i in range(-n, n + 1) if i))

    return f


def polynomial(degree: int):
    return lambda x: F.array(*(F.pow(x, F.lit(float(i))) for i in range(degree + 1)))


def _family(function, degree: int):
    return lambda x: F.array(*(function(i, x) for i in range(degree + 1)))


def chebyshev(degree: int, kind: int = 1):
    return _family(lambda n, x: scalar.chebyshev(n, x, kind), degree)


def hermite(degree: int):
    return _family(scalar.hermite, degree)


def legendre(degree: int):
    return _family(scalar.legendre, degree)


def bernstein(degree: int):
    """1, then C(n, k) xᵏ (1-x)ⁿ⁻ᵏ for k from 0 to n on the unit interval."""
    return lambda x: F.array(F.lit(1.0), *(math.comb(degree, k) * F.pow(x, F.lit(float(k))) * F.pow(1 - x, F.lit(float(degree - k))) for k in range(degree + 1)))


def cubic_spline(knots: list[float]):
    """1, x, x², x³ and the positive cubes (x - knot)³."""
    return lambda x: F.array(F.lit(1.0), x, x**2, x**3, *(F.pow(F.greatest(x - k, F.lit(0.0)), F.lit(3.0)) for k in knots))


def b_splines(knots: list[float], degree: int):
    """Cox–de Boor on half-open knot intervals, as one expression a basis function."""
    def f(x: Column) -> Column:
        level = [F.when((x >= a) & (x < b), 1.0).otherwise(0.0) for a, b in zip(knots, knots[1:], strict=False)]
        for d in range(1, degree + 1):
            def part(i, c, flip, d=d):
                width = knots[i + d] - knots[i]
                return (knots[i + d] - x if flip else x - knots[i]) / width * c if width else F.lit(0.0)
            level = [part(i, level[i], False) + part(i + 1, level[i + 1], True) for i in range(len(level) - 1)]
        return F.array(*level)

    return f


def cardinal_spline(degree: int):
    return b_splines([float(i) for i in range(degree + 2)], degree)


def distance(x: Column, centre: list[float]) -> Column:
    c = F.array(*(F.lit(float(v)) for v in centre))
    return F.sqrt(F.aggregate(F.zip_with(x, c, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v))


def matern(p: int, r: Column) -> Column:
    """Half-integer Matérn of order p + 1/2 at distance r (in length scales)."""
    z = r * math.sqrt(2 * p + 1)
    terms = [math.factorial(p) / math.factorial(2 * p) * math.factorial(p + i) / (math.factorial(i) * math.factorial(p - i)) * F.pow(2 * z, F.lit(float(p - i))) for i in range(p + 1)]
    return F.exp(-z) * reduce(lambda a, b: a + b, terms)


RADIAL = {
    "gaussian": lambda r, _: F.exp(-r * r / 2),
    "laplacian": lambda r, _: F.exp(-r),
    "multiquadric": lambda r, _: F.sqrt(1 + r * r),
    "inverse_multiquadric": lambda r, beta: F.pow(1 + r * r, F.lit(-float(beta))),
    "matern": lambda r, p: matern(int(p), r),
}


def radial(kind: str, centres: list[list[float]], scale: float = 1.0, parameter: float = 0.5, bias: bool = False):
    """One component a centre, of r = ‖x - c‖ / scale; with ``bias`` a leading 1."""
    return lambda x: F.array(*([F.lit(1.0)] if bias else []), *(RADIAL[kind](distance(x, c) / scale, parameter) for c in centres))


def tensor(f, g):
    """The outer product of two feature maps, column after column."""
    return lambda x, y: F.flatten(F.transform(g(y), lambda b: F.transform(f(x), lambda a: a * b)))


# -- quadrature -------------------------------------------------------------------------------------


def gauss_legendre(n: int, low: float = -1.0, high: float = 1.0) -> list[tuple[float, float]]:
    """(node, weight) pairs of the n-point rule on [low, high]."""
    nodes, weights = np.polynomial.legendre.leggauss(n)
    return [((high - low) / 2 * x + (high + low) / 2, (high - low) / 2 * w) for x, w in zip(nodes.tolist(), weights.tolist(), strict=True)]


def integrate(f, rule: list[tuple[float, float]]) -> Column:
    return reduce(lambda a, b: a + b, (w * f(F.lit(x)) for x, w in rule))


# -- wavelets ----------------------------------------------------------------------------------------


def haar_matrix(order: int) -> np.ndarray:
    """Orthonormal Haar matrix of 2^order rows: the means' half over the differences' half."""
    h = np.ones((1, 1))
    for _ in range(order):
        n = len(h)
        h = np.vstack([np.kron(h, [1, 1]), np.kron(np.eye(n), [1, -1])]) / math.sqrt(2)
    return h


def _multiply(matrix: np.ndarray, x: Column) -> Column:
    rows = F.array(*(F.array(*(F.lit(float(v)) for v in r)) for r in matrix))
    return F.transform(rows, lambda r: F.aggregate(F.zip_with(r, x, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v))


def haar(x: Column, order: int) -> Column:
    """The discrete Haar transform of an array of 2^order values: log-many passes over halves."""
    def halves(a: Column, k: int) -> Column:
        """The transform of 2^k values: that of the pairs' means, then the pairs' differences."""
        if k == 0:
            return a
        at = F.sequence(F.lit(0), F.lit((1 << (k - 1)) - 1))
        means = F.transform(at, lambda i: (a[2 * i] + a[2 * i + 1]) / math.sqrt(2))
        differences = F.transform(at, lambda i: (a[2 * i] - a[2 * i + 1]) / math.sqrt(2))
        return F.concat(scalar.let(means, lambda m: halves(m, k - 1)), differences)

    return halves(x, order)


def inverse_haar(y: Column, order: int) -> Column:
    return scalar.let(y, lambda v: _multiply(haar_matrix(order).T, v))


def grouped_haar(x: Column, order: int) -> Column:
    """Coefficients as an array of levels: the mean, then details from coarse to fine."""
    return scalar.let(haar(x, order), lambda y: F.array(F.slice(y, 1, 1), *(F.slice(y, (1 << k) + 1, 1 << k) for k in range(order))))


def wavelet(mother):
    """ψ((x - shift) / scale) / √scale."""
    return lambda scale, shift: lambda x: mother((x - shift) / scale) / math.sqrt(scale)


def haar_mother(x: Column) -> Column:
    return F.when((x >= 0) & (x < 0.5), 1.0).when((x >= 0.5) & (x < 1), -1.0).otherwise(0.0)
