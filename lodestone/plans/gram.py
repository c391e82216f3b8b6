"""Kernels on small NumPy matrices: what the driver-side models evaluate."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np

Gram = Callable[[np.ndarray, np.ndarray], np.ndarray]


#: Up to so many dimensions squared distances are summed from the differences.
FEW = 8


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances; those that rounding could decide (equal points above all) are taken from the differences."""
    if x.shape[1] <= FEW:
        return _summed(x, y, np.square)
    size = (x**2).sum(1)[:, None] + (y**2).sum(1)[None]
    out = np.maximum(size - 2 * x @ y.T, 0)
    i, j = np.nonzero(out <= 1e-9 * size)
    out[i, j] = ((x[i] - y[j]) ** 2).sum(1)
    return out


def _summed(x: np.ndarray, y: np.ndarray, of) -> np.ndarray:
    """Σ of(xₖ - yₖ), a dimension at a time: two arrays of all pairs, not one of pairs and dimensions."""
    out = np.zeros((len(x), len(y)))
    other = np.empty_like(out)
    for a, b in zip(x.T, y.T, strict=True):
        np.subtract(a[:, None], b, out=other)
        out += of(other, out=other)
    return out


def manhattan(x, y):
    return _summed(x, y, np.abs)


def _laplacian(beta: float) -> Gram:
    def of(x, y):
        out = manhattan(x, y)
        out /= -beta
        return np.exp(out, out=out)

    return of


def _fbm(hurst: float) -> Gram:
    def of(x, y):
        out = distances(x, y)
        np.power(out, hurst, out=out)
        np.subtract((y**2).sum(1)[None] ** hurst, out, out=out)
        out += (x**2).sum(1)[:, None] ** hurst
        out /= 2
        return out

    return of


MAKERS: dict[str, Callable[..., Gram]] = {
    "rbf": lambda b: lambda x, y: np.exp(-distances(x, y) / (2 * b * b)),
    "se": lambda b, h=1.0: lambda x, y: h * h * np.exp(-distances(x, y) / (2 * b * b)),
    "laplacian": _laplacian,
    "cauchy": lambda sigma: lambda x, y: 1 / (1 + distances(x, y) / sigma**2),
    "polynomial": lambda degree, offset: lambda x, y: (x @ y.T + offset) ** math.floor(degree),
    "linear": lambda offset=0.0: lambda x, y: x @ y.T + offset,
    "fbm": _fbm,
    "dirac": lambda noise: lambda x, y: abs(noise) * (distances(x, y) < 1e-18),
    "mlp": lambda w, b: lambda x, y: np.arcsin((w * (x @ y.T) + b) / np.sqrt((w * (x**2).sum(1)[:, None] + b + 1) * (w * (y**2).sum(1)[None] + b + 1))),
}


#: Kernels whose sums over points ``plans.sums`` knows, by the parameter that makes them.
SUMMED = {"laplacian": "beta", "fbm": "hurst", "dirac": "noise"}


def kernel(name: str, **parameters: float) -> Gram:
    of = MAKERS[name](**parameters)
    if name in SUMMED:
        of.parts = [(name, abs(parameters[SUMMED[name]]) if name == "dirac" else parameters[SUMMED[name]])]
    return of


def plus(*kernels: Gram) -> Gram:
    def of(x, y):
        out = kernels[0](x, y) + 0.0
        for k in kernels[1:]:
            out += k(x, y)
        return out

    if all(hasattr(k, "parts") for k in kernels):
        of.parts = [p for k in kernels for p in k.parts]
    return of


def times(*kernels: Gram) -> Gram:
    return lambda x, y: np.prod([k(x, y) for k in kernels], axis=0)
