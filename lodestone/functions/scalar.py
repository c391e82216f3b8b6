"""Scalar functions as column expressions."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def _num(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def polynomial_value(x: Column, coefficients: list[float]) -> Column:
    """Horner's rule, the leading coefficient first."""
    out = F.lit(float(coefficients[0]))
    for c in coefficients[1:]:
        out = out * x + F.lit(float(c))
    return out


# -- ranges ----------------------------------------------------------------------------------------


def numeric_range(low, high, bins: int) -> Column:
    """bins + 1 points, both ends exact."""
    lo, hi = _num(low), _num(high)
    return F.transform(F.sequence(F.lit(0), F.lit(bins)), lambda i: F.when(i == bins, hi).otherwise(lo + i * (hi - lo) / bins))


def open_range(low, high, steps: int) -> Column:
    """steps points, the upper end left out."""
    lo, hi = _num(low), _num(high)
    return F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda i: lo + i * (hi - lo) / steps)


# -- elementary ------------------------------------------------------------------------------------


def log1p_exp(x: Column) -> Column:
    """ln(1 + eˣ), without overflow on either side."""
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def gcd(a: Column, b: Column) -> Column:
    """Greatest common divisor of whole numbers: Euclid's steps, of which 64-bit numbers need 92 at most."""
    start = F.struct(F.abs(a).cast("long").alias("a"), F.abs(b).cast("long").alias("b"))
    step = lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), F.try_mod(s["a"], s["b"]).alias("b")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(92)), start, step)["a"]


def lcm(a: Column, b: Column) -> Column:
    """Least common multiple; 0 if either is 0."""
    return F.coalesce(F.abs(a).cast("long") * F.try_divide(F.abs(b).cast("long"), gcd(a, b)).cast("long"), F.lit(0).cast("long"))


def square(x: Column) -> Column:
    return x * x


def harmonic(x: Column) -> Column:
    """Sum of 1/k up to ⌊x⌋; 0 below 1."""
    return F.when(x < 1, F.lit(0.0)).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(F.floor(x), F.lit(1)).cast("int")), F.lit(0.0), lambda s, k: s + F.lit(1.0) / k))


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = 6371.0) -> Column:
    dlat, dlon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    a = F.sin(dlat) ** 2 + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(dlon) ** 2
    return F.lit(2 * radius) * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def _recurrence(n: int, first: Column, second: Column, step: Callable[[int, Column, Column], Column]) -> Column:
    """step(k, p[k-1], p[k-2]) from p[0] = first and p[1] = second, as a fold of a pair."""
    if n <= 0:
        return first
    if n == 1:
        return second
    start = F.struct(first.alias("a"), second.alias("b"))
    return F.aggregate(F.sequence(F.lit(2), F.lit(n)), start, lambda s, k: F.struct(s["b"].alias("a"), step(k.cast("double"), s["b"], s["a"]).alias("b")), lambda s: s["b"])


def chebyshev(n: int, x: Column, kind: int = 1) -> Column:
    return _recurrence(n, F.lit(1.0), x * kind, lambda k, p, q: 2 * x * p - q)


def hermite(n: int, x: Column) -> Column:
    """The probabilists' polynomials."""
    return _recurrence(n, F.lit(1.0), x * F.lit(1.0), lambda k, p, q: x * p - (k - 1) * q)


def legendre(n: int, x: Column) -> Column:
    return _recurrence(n, F.lit(1.0), x * F.lit(1.0), lambda k, p, q: ((2 * k - 1) * x * p - (k - 1) * q) / k)


def laguerre(n: int, alpha: float, x: Column) -> Column:
    return _recurrence(n, F.lit(1.0), 1 + alpha - x, lambda k, p, q: ((2 * k - 1 + alpha - x) * p - (k - 1 + alpha) * q) / k)


# -- special functions -----------------------------------------------------------------------------


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x computed once, however often f names it."""
    return F.element_at(F.transform(F.array(x), f), 1)


def _log_scaled_erfc(y: float) -> float:
    """ln(erfc(x) exp(x²) / t) at t = (y + 1) / 2 = 1 / (1 + x / 2): smooth on the whole half line."""
    t = (y + 1) / 2
    x = 2 / t - 2
    if x < 20:
        return math.log(math.erfc(x)) + x * x - math.log(t)
    s = 1 / (2 * x * x)
    return math.log1p(-s + 3 * s * s - 15 * s**3 + 105 * s**4) - math.log(x * t * math.sqrt(math.pi))


#: Coefficients, leading first, of the polynomial through that function's values at Chebyshev nodes.
TAIL = np.polynomial.chebyshev.cheb2poly(np.polynomial.chebyshev.chebinterpolate(np.vectorize(_log_scaled_erfc), 22))[::-1].tolist()


def erf(x: Column) -> Column:
    """Absolute error about 1e-12."""
    def inner(v):
        t = 2 / (2 + F.abs(v))
        tail = let(t, lambda u: u * F.exp(-v * v + let(2 * u - 1, lambda y: polynomial_value(y, TAIL))))
        return F.signum(v) * (1 - tail)

    return let(x, inner)


def normal_cdf(x: Column) -> Column:
    return (1 + erf(x / F.lit(math.sqrt(2)))) / 2


#: The coefficients of Acklam's rational approximation to the normal quantile.
CENTRE_TOP = [-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00]
CENTRE_LOW = [-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0]
TAIL_TOP = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00]
TAIL_LOW = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0]


def probit(p: Column) -> Column:
    """The normal quantile: a rational approximation and one Halley step; null outside (0, 1)."""
    def first(u):
        q = u - 0.5
        centre = let(q * q, lambda r: q * polynomial_value(r, CENTRE_TOP) / polynomial_value(r, CENTRE_LOW))
        tail = let(F.sqrt(-2 * F.log(F.least(u, 1 - u))), lambda t: -F.signum(q) * polynomial_value(t, TAIL_TOP) / polynomial_value(t, TAIL_LOW))
        return F.when(F.abs(q) <= 0.5 - 0.02425, centre).otherwise(tail)

    def refined(u, z):
        e = (normal_cdf(z) - u) * F.lit(math.sqrt(2 * math.pi)) * F.exp(z * z / 2)
        return let(e, lambda d: z - d / (1 + z * d / 2))

    return let(F.when((p > 0) & (p < 1), p), lambda u: let(first(u), lambda z: refined(u, z)))


def inverse_erf(x: Column) -> Column:
    return probit((x + 1) / 2) / F.lit(math.sqrt(2))


#: Lanczos coefficients for g = 7.
LANCZOS = [0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7]


def lgamma(x: Column) -> Column:
    """ln Γ(x) for positive x."""
    z = x - 1
    total = F.lit(LANCZOS[0])
    for i, c in enumerate(LANCZOS[1:], 1):
        total = total + F.lit(c) / (z + i)
    t = z + 7.5
    return F.lit(0.5 * math.log(2 * math.pi)) + (z + 0.5) * F.log(t) - t + F.log(total)


def multivariate_lgamma(n: int, a: Column) -> Column:
    out = F.lit(n * (n - 1) / 4 * math.log(math.pi))
    for j in range(n):
        out = out + lgamma(a - j / 2)
    return out


# -- activations -------------------------------------------------------------------------------------

#: Scale and alpha of self-normalising units.
SELU = (1.0507009873554805, 1.6732632423543772)


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (1 + F.exp(-x))


ACTIVATIONS: dict[str, tuple[Callable[[Column], Column], Callable[[Column], Column]]] = {
    "sigmoid": (sigmoid, lambda x: sigmoid(x) * (1 - sigmoid(x))),
    "tanh": (F.tanh, lambda x: 1 - F.tanh(x) ** 2),
    "linear": (lambda x: x, lambda x: F.lit(1.0)),
    "relu": (lambda x: F.greatest(x, F.lit(0.0)), lambda x: F.when(x > 0, 1.0).otherwise(0.0)),
    "selu": (
        lambda x: F.lit(SELU[0]) * F.when(x > 0, x).otherwise(SELU[1] * (F.exp(x) - 1)),
        lambda x: F.lit(SELU[0]) * F.when(x > 0, 1.0).otherwise(SELU[1] * F.exp(x)),
    ),
}


def activation(name: str) -> Callable[[Column], Column]:
    return ACTIVATIONS[name.lower()][0]


# -- dual numbers --------------------------------------------------------------------------------------


def dual(value: Column, derivative: Column) -> Column:
    return F.struct(value.alias("a"), derivative.alias("b"))


def dual_add(x: Column, y: Column) -> Column:
    return dual(x["a"] + y["a"], x["b"] + y["b"])


def dual_subtract(x: Column, y: Column) -> Column:
    return dual(x["a"] - y["a"], x["b"] - y["b"])


def dual_multiply(x: Column, y: Column) -> Column:
    return dual(x["a"] * y["a"], x["a"] * y["b"] + x["b"] * y["a"])


# -- vectors and fields ---------------------------------------------------------------------------------


def vector_add(x: Column, y: Column) -> Column:
    return F.zip_with(x, y, lambda a, b: a + b)


def vector_subtract(x: Column, y: Column) -> Column:
    return F.zip_with(x, y, lambda a, b: a - b)


def vector_multiply(x: Column, y: Column) -> Column:
    return F.zip_with(x, y, lambda a, b: a * b)


def vector_scale(x: Column, c) -> Column:
    return F.transform(x, lambda a: a * c)


def dot(x: Column, y: Column) -> Column:
    return F.aggregate(vector_multiply(x, y), F.lit(0.0), lambda s, v: s + v)


# -- change of variables --------------------------------------------------------------------------------


class Map1:
    """A differentiable bijection: forward, inverse and the forward's derivative."""

    def __init__(self, forward, inverse, derivative):
        self.forward, self.inverse, self.derivative = forward, inverse, derivative

    def push_density(self, density: Callable[[Column], Column]) -> Callable[[Column], Column]:
        """The density of forward(X) where X has ``density``."""
        return lambda y: density(self.inverse(y)) / F.abs(self.derivative(self.inverse(y)))


# -- typed parsing of text ------------------------------------------------------------------------------

#: The date forms tried in order, ISO first, then those of each region.
US_DATES = ("yyyy-MM-dd", "yyyy/MM/dd", "MM-dd-yyyy", "MM/dd/yyyy")
STANDARD_DATES = ("yyyy-MM-dd", "yyyy/MM/dd", "dd-MM-yyyy", "dd/MM/yyyy")


def parse_date(s: Column, forms: tuple[str, ...] = US_DATES) -> Column:
    """The first form that fits; null if none does."""
    return F.coalesce(*(F.to_date(F.try_to_timestamp(s, F.lit(f))) for f in forms))


def date_text(d: Column) -> Column:
    return F.date_format(d, "yyyy-MM-dd")


def parse(s: Column, kind: str) -> Column:
    """A typed value or null; the word None stands for null."""
    return F.nullif(F.trim(s), F.lit("None")).try_cast(kind)


UNITS = {"ms": 0.001, "millis": 0.001, "s": 1.0, "seconds": 1.0, "second": 1.0, "m": 60.0, "minutes": 60.0, "minute": 60.0, "h": 3600.0, "hours": 3600.0, "hour": 3600.0, "d": 86400.0, "days": 86400.0, "day": 86400.0}


def parse_duration(s: Column) -> Column:
    """``10 seconds``, ``5m``: seconds as a double, null for another unit."""
    n, unit = F.regexp_extract(s, r"^\s*([0-9.]+)\s*([a-z]+)\s*$", 1), F.regexp_extract(s, r"^\s*([0-9.]+)\s*([a-z]+)\s*$", 2)
    factor = F.create_map(*(F.lit(x) for kv in UNITS.items() for x in kv))
    return n.try_cast("double") * F.try_element_at(factor, unit)


def parse_enum(s: Column, values: list[str]) -> Column:
    return F.when(s.isin(*values), s)


def parse_list(s: Column, kind: str = "string") -> Column:
    """Comma-separated items; a quoted item may hold commas."""
    items = F.regexp_extract_all(s, F.lit(r'\s*("[^"]*"|[^,]+)\s*'), F.lit(1))
    return F.transform(items, lambda v: F.regexp_replace(F.trim(v), '^"|"$', "").try_cast(kind))


def parse_set(s: Column, kind: str = "string") -> Column:
    return F.array_sort(F.array_distinct(parse_list(s, kind)))


def parse_map(s: Column) -> Column:
    """``a:1,b:2``; of a key twice the last counts."""
    pairs = F.transform(F.split(s, ","), lambda p: F.split(F.trim(p), ":", 2))
    keys = F.transform(pairs, lambda p: p[0])
    last = F.filter(pairs, lambda p, i: ~F.array_contains(F.slice(keys, i + 2, F.size(keys)), p[0]))
    return F.map_from_entries(F.transform(last, lambda p: F.struct(p[0], F.try_element_at(p, F.lit(2)))))
