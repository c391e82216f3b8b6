"""Feed-forward networks: weights on the driver, gradients summed over Arrow batches, forward pass anywhere."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.scalar import SELU, activation
from lodestone.operators.metrics import multi_regression_metrics
from lodestone.session import durable

#: name → (value, derivative from the pre-activation), on NumPy arrays.
NUMERIC = {
    "linear": (lambda z: z, lambda z: np.ones_like(z)),
    "sigmoid": (lambda z: 1 / (1 + np.exp(-np.clip(z, -500, 500))), lambda z: (s := 1 / (1 + np.exp(-np.clip(z, -500, 500)))) * (1 - s)),
    "tanh": (np.tanh, lambda z: 1 - np.tanh(z) ** 2),
    "relu": (lambda z: np.maximum(z, 0), lambda z: (z > 0).astype(float)),
    "selu": (lambda z: SELU[0] * np.where(z > 0, z, SELU[1] * (np.exp(np.minimum(z, 0)) - 1)), lambda z: SELU[0] * np.where(z > 0, 1, SELU[1] * np.exp(np.minimum(z, 0)))),
}


@dataclass
class Network:
    """Layers of (weights, bias) with an activation each."""

    layers: list[tuple[np.ndarray, np.ndarray]]
    activations: list[str]
    history: list[float] = field(default_factory=list)

    @staticmethod
    def initial(sizes: list[int], activations: list[str], seed: int = 0) -> Network:
        rng = np.random.default_rng(seed)
        return Network([(rng.standard_normal((a, b)) / np.sqrt(a), np.zeros(b)) for a, b in zip(sizes, sizes[1:], strict=False)], activations)

    def forward(self, x: np.ndarray) -> np.ndarray:
        for (w, b), a in zip(self.layers, self.activations, strict=True):
            x = NUMERIC[a][0](x @ w + b)
        return x

    def gradient(self, x: np.ndarray, y: np.ndarray) -> tuple[list[np.ndarray], float]:
        """Sums over the rows of the gradients of half the squared error, and that error."""
        held, zs = [x], []
        for (w, b), a in zip(self.layers, self.activations, strict=True):
            zs.append(held[-1] @ w + b)
            held.append(NUMERIC[a][0](zs[-1]))
        delta, out = held[-1] - y, []
        loss = float((delta**2).sum() / 2)
        for k in reversed(range(len(self.layers))):
            delta = delta * NUMERIC[self.activations[k]][1](zs[k])
            out = [held[k].T @ delta, delta.sum(0), *out]
            delta = delta @ self.layers[k][0].T
        return out, loss

    def expression(self, features: Column) -> Column:
        """The forward pass as an array expression, for small nets inside whole-stage code."""
        x = features
        for (w, b), a in zip(self.layers, self.activations, strict=True):
            f = activation(a)
            x = F.array(*(f(F.aggregate(F.zip_with(x, F.array(*(F.lit(float(v)) for v in w[:, j])), lambda p, q: p * q), F.lit(float(b[j])), lambda s, v: s + v)) for j in range(w.shape[1])))
        return x

    def predict(self, df: DataFrame, features: str = "features", out: str = "prediction") -> DataFrame:
        """In Arrow batches on the executors."""
        kinds = ", ".join(f"`{n}` {t}" for n, t in df.dtypes)

        def run(frames):
            for pdf in frames:
                x = np.array(pdf[features].tolist(), float).reshape(len(pdf), -1)
                yield pdf.assign(**{out: list(self.forward(x)) if len(pdf) else []})

        return df.mapInPandas(run, f"{kinds}, {out} array<double>")


@dataclass
class Stop:
    """When to end: steps, or how little the loss changes, absolutely or relatively."""

    steps: int = 100
    absolute: float = 0.0
    relative: float = 0.0

    def over(self, history: list[float]) -> bool:
        if len(history) < 2:
            return False
        change = abs(history[-2] - history[-1])
        return change < self.absolute or change < self.relative * abs(history[-2])


def train(df: DataFrame, network: Network, features: str = "features", target: str = "target", stop: Stop | None = None, rate: float = 0.1, momentum: float = 0.5, regularisation: float = 0.0, batch: float = 1.0, seed: int = 0) -> Network:
    """Back-propagation with momentum; a step's damping is rate / (1 + 0.5 · step).

    A step is one job: each batch of rows gives one row of gradient sums, and those rows are
    summed. ``target`` is an array. Biases aren't regularised.
    """
    stop = stop or Stop()
    rows = durable(df.select(features, target), "training")
    layers = [(w.copy(), b.copy()) for w, b in network.layers]
    net = Network(layers, network.activations, [])
    before = [np.zeros_like(p) for layer in layers for p in layer]
    for k in range(stop.steps):
        def partial(frames, net=net):
            total, loss, n = None, 0.0, 0
            for pdf in frames:
                if len(pdf):
                    x, y = (np.array(pdf[c].tolist(), float).reshape(len(pdf), -1) for c in (features, target))
                    g, e = net.gradient(x, y)
                    total = g if total is None else [a + b for a, b in zip(total, g, strict=True)]
                    loss, n = loss + e, n + len(pdf)
            if n:
                yield pd.DataFrame({"g": [np.concatenate([*(a.ravel() for a in total), [loss, n]])]})

        part = rows if batch >= 1 else rows.sample(False, batch, seed + k)
        # a row a task; summed by place, whatever the number of weights
        places = part.mapInPandas(partial, "g array<double>").select(F.posexplode("g").alias("i", "g")).groupBy("i").agg(F.sum("g").alias("g"))
        r = np.array([x["g"] for x in sorted(places.collect(), key=lambda x: x["i"])])
        if not len(r):
            continue
        n = r[-1]
        net.history.append(r[-2] / n)
        flat, at, step = r[:-2] / n, 0, rate / (1 + 0.5 * k)
        fresh = []
        for i, (w, b) in enumerate(net.layers):
            pair = []
            for j, p in enumerate((w, b)):
                g = flat[at : at + p.size].reshape(p.shape) + (regularisation * p if j == 0 else 0)
                at += p.size
                before[2 * i + j] = momentum * before[2 * i + j] - step * g
                pair.append(p + before[2 * i + j])
            fresh.append(tuple(pair))
        net = Network(fresh, net.activations, net.history)
        if stop.over(net.history):
            break
    return net


def autoencoder(df: DataFrame, sizes: list[int], activations: list[str], features: str = "features", **options) -> Network:
    """A network trained to give its input back."""
    return train(df.withColumn("__t", F.col(features)), Network.initial(sizes, activations), features, "__t", **options)


@dataclass
class Model:
    """A network with its data's columns: ``fit``, ``predict``, ``evaluate`` (each output's metrics), ``energy``."""

    sizes: list[int]
    activations: list[str]
    features: str = "features"
    target: str = "target"
    network: Network | None = None

    def fit(self, df: DataFrame, stop: Stop | None = None, **options) -> Model:
        start = Network.initial(self.sizes, self.activations, options.get("seed", 0))
        self.network = train(df, start, self.features, self.target, stop, **options)
        return self

    def predict(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        return self.network.predict(df, self.features, out)

    def evaluate(self, df: DataFrame) -> DataFrame:
        return multi_regression_metrics(self.predict(df).select(F.col("prediction").alias("scores"), F.col(self.target).alias("labels")))

    def energy(self, df: DataFrame) -> float:
        """The mean squared error over rows and outputs: what a tuner would lower."""
        return float(self.evaluate(df).agg(F.avg("efficiency")).first()[0])


# -- layers ---------------------------------------------------------------------------------------------


def apply_layer(df: DataFrame, column: str, layer, out: str, shape: list[int] | None = None) -> DataFrame:
    """A layer (array of rows → array of rows) over an array column, in Arrow batches; the outcome is flat.

    ``shape`` gives the rows their form (an image: height, width, channels). Layers that look at
    the whole batch (``batch_norm``) see an Arrow batch; over a table take ``normalised``.
    """
    kinds = ", ".join(f"`{n}` {t}" for n, t in df.dtypes)

    def run(frames):
        for pdf in frames:
            x = np.array(pdf[column].tolist(), float).reshape(len(pdf), *(shape or [-1]))
            yield pdf.assign(**{out: [np.ravel(r) for r in layer(x)] if len(pdf) else []})

    return df.mapInPandas(run, f"{kinds}, {out} array<double>")


def normalised(df: DataFrame, column: str, gamma: float = 1.0, beta: float = 0.0, epsilon: float = 1e-5) -> DataFrame:
    """Batch normalisation with the table as the batch: its means and population variances, one aggregation."""
    size = df.select(F.max(F.size(column))).first()[0] or 0
    c = lambda i: F.col(column)[i].cast("double")
    row = df.agg(F.array(*(F.avg(c(i)) for i in range(size))).alias("m"), F.array(*(F.var_pop(c(i)) for i in range(size))).alias("v")).first()
    cells = [(c(i) - F.lit(m)) / F.lit(float(np.sqrt(v + epsilon))) * gamma + beta for i, (m, v) in enumerate(zip(row["m"] or [], row["v"] or [], strict=True))]
    return df.withColumn(column, F.array(*cells))


def batch_norm(x: np.ndarray, gamma=1.0, beta=0.0) -> np.ndarray:
    """By the batch's own mean and population variance, always."""
    return (x - x.mean(0)) / np.sqrt(x.var(0) + 1e-5) * gamma + beta


RBF = {
    "gaussian": lambda d: np.exp(-d),
    "multiquadric": lambda d: np.sqrt(1 + d),
    "inverse_multiquadric": lambda d: 1 / np.sqrt(1 + d),
    "cauchy": lambda d: 1 / (1 + d),
    "sigmoid": lambda d: 1 / (1 + np.exp(-d)),
}


def rbf_layer(x: np.ndarray, centres: np.ndarray, scales: np.ndarray, kind: str = "gaussian") -> np.ndarray:
    return RBF[kind]((((x[:, None] - centres[None]) * scales[None]) ** 2).sum(2))


def ctrnn(x: np.ndarray, g: np.ndarray, b: np.ndarray, w: np.ndarray, tau: np.ndarray, dt: float, horizon: int) -> np.ndarray:
    """Euler steps of a continuous-time recurrent layer, stacked over the horizon."""
    out = []
    for _ in range(horizon):
        x = x + dt * (-x * tau + np.tanh(x @ g + b) @ w)
        out.append(x)
    return np.stack(out, 1)


def generalised_logistic(x: np.ndarray, alpha: float = 1.0, nu: float = 1.0, q: float = 1.0, c: float = 1.0) -> np.ndarray:
    """(c + q·exp(-αx))^(-1/ν)."""
    return (c + q * np.exp(-alpha * x)) ** (-1 / nu)


def finite_horizon(x: np.ndarray, w: np.ndarray, b: np.ndarray, horizon: int) -> np.ndarray:
    """A linear layer whose outputs stand for the next ``horizon`` steps: (rows, horizon, outputs).

    Sums begin with their first product and biases of zero add nothing, so that a zero keeps its sign.
    """
    z = reduce(np.add, (x[:, i, None] * w[i] for i in range(len(w))))
    return np.where(b == 0, z, z + b).reshape(len(x), horizon, -1)


def beside(*layers):
    """Layers of one input, their outputs joined."""
    return lambda x: np.concatenate([np.asarray(f(x)).reshape(len(x), -1) for f in layers], 1)


def residual_block(x: np.ndarray, inner) -> np.ndarray:
    return x + inner(x)


def conv2d(image: np.ndarray, filters: np.ndarray) -> np.ndarray:
    """(h, w, c) with (k, k, c, out), same padding."""
    k = filters.shape[0]
    padded = np.pad(image, ((k // 2, (k - 1) // 2), (k // 2, (k - 1) // 2), (0, 0)))
    windows = np.lib.stride_tricks.sliding_window_view(padded, (k, k), (0, 1))
    return np.einsum("hwckl,klco->hwo", windows, filters)


def pyramid(image: np.ndarray, stack: list[np.ndarray]) -> np.ndarray:
    """Convolutions one after another, each followed by a rectifier and a halving by maxima."""
    for filters in stack:
        image = np.maximum(conv2d(image, filters), 0)
        h, w, c = image.shape
        image = image[: h // 2 * 2, : w // 2 * 2].reshape(h // 2, 2, w // 2, 2, c).max((1, 3))
    return image


def inception(image: np.ndarray, branches: list[np.ndarray]) -> np.ndarray:
    """Convolutions beside each other, their channels joined."""
    return np.concatenate([conv2d(image, f) for f in branches], 2)


def series_loss(prediction: np.ndarray, truth: np.ndarray) -> float:
    return float(((prediction - truth) ** 2).mean(0).sum())


def weight_penalty(network: Network, reg: float, kind: str = "l2") -> float:
    return reg * sum(float(np.abs(w).sum() if kind == "l1" else (w**2).sum() / 2) for w, _ in network.layers)
