"""Kernel systems of more points than a dense matrix holds: cells are made where they are used.

Points are distinct and lie on the driver with vectors over them (some 40 bytes a point); the
matrix never exists. Either the kernel is, to rounding, a product of few features (``features_of``
shows it for every row), and sums over the rows answer exactly in linear time; or the system is
solved by conjugate gradients, each product over all pairs in tiles on the executors, or, for kernels
that ``plans.sums`` knows, by sums that need only near pairs one by one.
"""

from __future__ import annotations

import heapq
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.plans import processes, sums
from lodestone.plans.gram import Gram, plus
from lodestone.session import durable

#: Points whose dense matrix is solved in one place (128 MB).
DENSE = 4_000
#: Features that are tried before a kernel counts as one that has too many.
RANK = 1_500
#: What features may leave of a row's own kernel value, as a share of the largest.
LEFT = 1e-13
#: A tile's cells (512 KB) stay in a core's cache.
TILE, BLOCK = 256, 4096
#: Rows that are answered at a time by sums.
ROWS = 200_000
#: Cells of the preconditioner: a matrix of 72 MB.
CENTRES = 3_000
#: Numbers of the preconditioner's features on the driver (64 MB).
HELD = 1 << 23


def points(df: DataFrame, features: str = "features", target: str = "target") -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """As ``processes.gather_distinct``, through Arrow and of any number of points."""
    y = F.col(target).cast("double")
    rows = df.groupBy(F.col(features).alias("x")).agg(F.avg(y).alias("y"), F.count("*").alias("n"), (F.var_pop(y) * F.count("*")).alias("s")).toArrow().combine_chunks()
    x = rows["x"].combine_chunks()
    x = x.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(x), -1)
    at = np.lexsort(x.T[::-1]) if len(x) else []
    return x[at], *(rows[c].to_numpy().astype(float)[at] for c in "yn"), float(rows["s"].to_numpy().sum())


def own(kernel: Gram, x: np.ndarray) -> np.ndarray:
    """k(x, x) of each row."""
    return np.concatenate([np.diag(kernel(x[i : i + 64], x[i : i + 64])) for i in range(0, len(x), 64)]) if len(x) else np.zeros(0)


def pivoted(kernel: Gram, x: np.ndarray, left: float, most: int, known: np.ndarray | None = None):
    """(rows taken, features (a row each, a column a point), what they leave of k(x, x)).

    Cholesky factor with the largest rest first, until no rest exceeds ``left``; ``known`` are rests
    after other features that ``kernel`` has been rid of.
    """
    rest = own(kernel, x) if known is None else known.copy()
    phi, taken = np.zeros((min(most, len(x)), len(x))), []
    while len(taken) < len(phi):
        i = int(rest.argmax())
        if not rest[i] > left:
            break
        m = len(taken)
        phi[m] = (kernel(x[i : i + 1], x)[0] - phi[:m, i] @ phi[:m]) / np.sqrt(rest[i])
        rest = np.maximum(rest - phi[m] ** 2, 0)
        rest[i] = 0
        taken.append(i)
    return np.array(taken, int), phi[: len(taken)], rest


@dataclass(frozen=True)
class Features:
    """φ with φ(x)ᵀφ(y) = k(x, y) wherever it leaves nothing of k(x, x) and k(y, y)."""

    kernel: Gram
    x: np.ndarray
    root: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.linalg.solve(self.root, self.kernel(self.x, x)) if len(self.x) else np.zeros((0, len(x)))

    def rest(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(own(self.kernel, x) - (self(x) ** 2).sum(0), 0)


def _arrays(batch: pa.RecordBatch, k: int = 0) -> np.ndarray:
    column = batch.column(k)
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def features_of(df: DataFrame, kernel: Gram, features: str = "features", most: int = RANK, left: float = LEFT) -> Features | None:
    """Features that leave at most ``left`` of the largest k(x, x), of every row of ``df``; None if ``most`` don't.

    Each pass looks at all rows and brings the points that the features so far leave most of;
    the last one finds none.
    """
    found, scale, before = Features(kernel, np.zeros((0, 0)), np.zeros((0, 0))), 0.0, -1
    while True:
        now, least = found, scale * left

        def run(frames, now=now, least=least):
            for batch in frames:
                x = np.unique(_arrays(batch), axis=0)
                rest, largest = now.rest(x), float(own(kernel, x).max(initial=0))
                near = x[rest > max(least, largest * left)]
                if len(near) and len(now.x):
                    seen = now(near)
                    place = {p.tobytes(): k for k, p in enumerate(near)}
                    without = lambda a, b: kernel(a, b) - seen[:, [place[p.tobytes()] for p in a]].T @ seen  # noqa: B023, E731
                    near = near[pivoted(without, near, max(least, largest * left), 256, now.rest(near))[0]]
                elif len(near):
                    near = near[pivoted(kernel, near, largest * left, 256)[0]]
                yield pa.RecordBatch.from_arrays([pa.array([largest]), pa.array([near.tolist()], pa.list_(pa.list_(pa.float64())))], ["largest", "x"])

        said = df.select(features).mapInArrow(run, "largest double, x array<array<double>>").collect()
        scale = max([scale, *(r["largest"] for r in said)])
        more = [p for r in said for p in r["x"]]
        if not more or (len(now.x) and len(now.x) == before):
            return now if not more else None
        before = len(now.x)
        every = np.unique(np.array(more if not len(now.x) else [*now.x.tolist(), *more], float), axis=0)
        taken, phi, rest = pivoted(kernel, every, scale * left / 4, most + 1)
        if len(taken) > most:
            return None
        found = Features(kernel, every[taken], np.tril(phi[:, taken].T))


def support_vectors_of(df: DataFrame, of: Features, regularisation: float, features: str = "features", target: str = "target") -> tuple[np.ndarray, float]:
    """(w, b): the least-squares support vector machine's answer is wᵀφ(x) + b.

    With k = φᵀφ its bordered system is the ridge regression on φ with a free b: one pass of sums.
    """
    size = len(of.x) + 2

    def run(frames):
        total = np.zeros((size, size))
        for batch in frames:
            x, y = _arrays(batch), batch.column(1).to_numpy(zero_copy_only=False).astype(float)
            for i in range(0, len(x), BLOCK):
                rows = np.vstack([of(x[i : i + BLOCK]), np.ones(len(x[i : i + BLOCK])), y[i : i + BLOCK]])
                total += rows @ rows.T
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()])], ["v"])

    total = sum(np.reshape(r["v"], (size, size)) for r in df.select(features, target).mapInArrow(run, "v array<double>").collect())
    left = total[:-1, :-1] + np.diag(np.r_[np.full(size - 2, 1 / regularisation), 0.0])
    out = np.linalg.solve(left, total[:-1, -1])
    return out[:-1], float(out[-1])


def _products(spark: SparkSession, kernel: Gram, x: np.ndarray):
    """v → K v over all pairs, v of several columns; a pair of tiles is made once and serves both ways."""
    n, sent = len(x), spark.sparkContext.broadcast(x)
    tiles = -(-n // TILE)
    tasks = min(max(1, tiles * (tiles + 1) // 2), 2 * spark.sparkContext.defaultParallelism)

    def product(v: np.ndarray) -> np.ndarray:
        given = spark.sparkContext.broadcast(v)

        def run(frames):
            mine = [k for batch in frames for k in batch.column(0).to_pylist()]
            at, v_ = sent.value, given.value
            out = np.zeros_like(v_)
            for i in range(tiles):
                for j in range(i, tiles):
                    if (31 * i + j) % tasks in mine:
                        s, t = slice(i * TILE, (i + 1) * TILE), slice(j * TILE, (j + 1) * TILE)
                        k = kernel(at[s], at[t])
                        out[s] += k @ v_[t]
                        if i != j:
                            out[t] += k.T @ v_[s]
            yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], ["v"])

        parts = spark.range(0, tasks, 1, tasks).mapInArrow(run, "v binary").collect()
        total = sum(np.frombuffer(r["v"]).reshape(v.shape) for r in parts)
        given.destroy()
        return total

    return product, sent


def _summed(spark: SparkSession, of: sums.Sums):
    """v → K v: near pairs on the executors, the rest meanwhile on the driver."""
    tasks = 4 * spark.sparkContext.defaultParallelism
    sent = spark.sparkContext.broadcast([(sums.Distances(d.x, d.hurst, d.grid), d.shares(tasks)) for d in of.power])

    def near(v: np.ndarray) -> np.ndarray:
        given = spark.sparkContext.broadcast(v)

        def run(frames):
            for batch in frames:
                for t in batch.column(0).to_pylist():
                    for k, (d, shares) in enumerate(sent.value):
                        out = d.at(d.x[shares[t]], given.value)
                        yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([t]), pa.array([out.tobytes()], pa.binary())], ["k", "t", "v"])

        out = np.zeros(len(v))
        for r in spark.range(0, tasks, 1, tasks).mapInArrow(run, "k long, t long, v binary").collect():
            out[sent.value[r["k"]][1][r["t"]]] += np.frombuffer(r["v"])
        given.destroy()
        return out

    def product(v: np.ndarray) -> np.ndarray:
        out = np.empty_like(v)
        for c in range(v.shape[1]):
            w = np.ascontiguousarray(v[:, c])
            with ThreadPoolExecutor(2) as other:
                later = other.submit(near, w)
                smooth = other.submit(lambda w=w: of.smooth(of.x, w, of.trees(w)))
                far = sum((d.at(d.x, None, d.local(w)) for d in of.power), np.zeros(len(w)))
                out[:, c] = smooth.result() + of.dirac * w - (far + later.result()) / 2
        return out

    return product, sent


def _cells(kernel: Gram, x: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(each point's cell, a point near each cell's middle): boxes halved where rows times the kernel's change is largest."""

    def made(mine: np.ndarray):
        low, high = x[mine].min(0), x[mine].max(0)
        middle = int(mine[((x[mine] - (low + high) / 2) ** 2).sum(1).argmin()])
        ends = np.vstack([low, high])
        k = kernel(ends, ends)
        return (-len(mine) * float(k[0, 0] + k[1, 1] - 2 * k[0, 1]), middle, mine, int((high - low).argmax()))

    cells = [made(np.arange(len(x)))]
    while len(cells) < most and cells[0][0] < 0:
        _, _, mine, axis = heapq.heappop(cells)
        c = x[mine, axis]
        left = c <= (c.min() + c.max()) / 2
        for part in (mine[left], mine[~left]):
            heapq.heappush(cells, made(part))
    cell = np.empty(len(x), int)
    for k, (_, _, mine, _) in enumerate(cells):
        cell[mine] = k
    return cell, np.array([c[1] for c in cells])


def _eased(kernel: Gram, x: np.ndarray, d: np.ndarray):
    """r → about (K + diag d)⁻¹ r: pivoted features; of what they leave, what is constant in cells; the rest as a diagonal."""
    n = len(x)
    _, phi, _ = pivoted(kernel, x, 1e-10, max(1, min(512, HELD // max(1, n))))
    cell, middle = _cells(kernel, x, min(CENTRES, 1 + n // 8))
    size = own(kernel, x)
    left = lambda a, b: kernel(x[a], x[b]) - phi[:, a].T @ phi[:, b]
    d = d.copy()
    order = np.argsort(cell, kind="stable")
    for c, mine in enumerate(np.split(order, np.searchsorted(cell[order], np.arange(1, len(middle))))):
        m = middle[c]
        apart = phi[:, mine] - phi[:, [m]]
        d[mine] += np.maximum(size[mine] + size[m] - 2 * kernel(x[mine], x[m : m + 1])[:, 0] - (apart**2).sum(0), 0)
    weight = np.sqrt(np.bincount(cell, 1 / d, len(middle)))
    inner = np.empty((len(middle), len(middle)))
    for i in range(0, len(middle), TILE):
        inner[i : i + TILE] = left(middle[i : i + TILE], middle) * weight[i : i + TILE, None] * weight
    inner += np.diag(1 + 1e-9 * np.diag(inner))
    inner = np.linalg.cholesky(inner)
    inner = np.linalg.inv(inner)
    inner = inner.T @ inner
    np.negative(inner, out=inner)
    inner[np.diag_indices(len(inner))] += 1
    inner /= weight[:, None]
    inner /= weight

    def local(r):
        u = r / d[:, None]
        sums_ = np.column_stack([np.bincount(cell, c, len(middle)) for c in u.T])
        return u - (inner @ sums_)[cell] / d[:, None]

    outer = np.eye(len(phi))
    for i in range(0, len(phi), 16):
        outer[:, i : i + 16] += phi @ local(phi[i : i + 16].T)
    outer = np.linalg.inv(np.linalg.cholesky((outer + outer.T) / 2))

    def eased(r):
        u = local(r)
        return u - local(phi.T @ (outer.T @ (outer @ (phi @ u))))

    return eased


def solve(spark: SparkSession, kernel: Gram, x: np.ndarray, diagonal: np.ndarray, right: np.ndarray, smooth: Gram | None = None, tolerance: float = 1e-11, steps: int = 1_000, of: sums.Sums | None = None) -> np.ndarray:
    """(K + diag)⁻¹ right, columns at once, by conjugate gradients that what ``_eased`` makes of ``smooth`` speeds up.

    ``smooth`` is the part of ``kernel`` without what it has on the diagonal alone; ``of`` are its sums, if known.
    """
    smooth = smooth or kernel
    d = own(kernel, x) - own(smooth, x) + diagonal
    eased = _eased(smooth, x, np.maximum(d, 1e-10 * max(1.0, float(d.max()))))
    product, sent = _summed(spark, of) if of else _products(spark, kernel, x)
    z = np.zeros_like(right)
    r = right.copy()
    s = eased(r)
    p, old = s.copy(), (r * s).sum(0)
    aim = tolerance * np.linalg.norm(right, axis=0)
    for _ in range(steps):
        if (np.linalg.norm(r, axis=0) <= aim).all():
            break
        q = product(p) + diagonal[:, None] * p
        a = np.divide(old, (p * q).sum(0), out=np.zeros_like(old), where=old != 0)
        z, r = z + a * p, r - a * q
        s = eased(r)
        new = (r * s).sum(0)
        p, old = s + np.divide(new, old, out=np.zeros_like(new), where=old != 0) * p, new
    else:
        raise ValueError(f"no solution within {steps} steps")
    sent.destroy()
    return z


@dataclass(frozen=True)
class KernelSum:
    """Σ wₖ k(x, xₖ) + shift, tile by tile."""

    kernel: Gram
    x: np.ndarray
    weights: np.ndarray
    shift: float = 0.0

    def posterior(self, x: np.ndarray) -> tuple[np.ndarray]:
        out = np.full(len(x), self.shift)
        for a in range(0, len(x), TILE):
            s = slice(a, a + TILE)
            for i in range(0, len(self.x), TILE):
                out[s] += self.kernel(x[s], self.x[i : i + TILE]) @ self.weights[i : i + TILE]
        return (out,)


def process_mean(df: DataFrame, kernel: Gram, noise: Gram, features: str = "features", target: str = "target"):
    """The mean of ``processes.GaussianProcess``, trained on all rows of ``df``, however many, by their distinct points."""
    x, y, counts, scatter = points(df, features, target)
    if len(x) <= DENSE:
        m = processes.GaussianProcess(kernel, noise, x, y, counts=counts, scatter=scatter)
        return KernelSum(kernel, x, m.factor()[1])
    both = lambda a, b: kernel(a, b) + noise(a, b)
    repeat = 0.0 if (counts == 1).all() else 1e-8 * float(own(both, x) @ counts / counts.sum())
    said = sums.sums_of(kernel, x)
    of = sums.sums_of(plus(kernel, noise), x) if said and not said.dirac and said.holds() else None
    of = of and replace(said, dirac=of.dirac)
    weights = solve(df.sparkSession, both, x, repeat / counts, y[:, None], kernel, of=of)[:, 0]
    return sums.Answers(said, weights) if of else KernelSum(kernel, x, weights)


def predict_means(df: DataFrame, model, features: str = "features", column: str = "mean") -> DataFrame:
    """Adds the means of ``process_mean``, many rows at a time."""
    sent = df.sparkSession.sparkContext.broadcast(model if isinstance(model, sums.Answers) else cloudpickle.dumps(model))

    def answered(batches):
        t = pa.Table.from_batches(batches).combine_chunks()
        of = t[features].combine_chunks()
        x = of.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(of), -1)
        m = sent.value if isinstance(sent.value, sums.Answers) else cloudpickle.loads(sent.value)
        return t.append_column(column, pa.array(m.posterior(x)[0])).to_batches()

    def run(frames):
        held = []
        for batch in frames:
            if batch.num_rows:
                held.append(batch)
            if sum(b.num_rows for b in held) >= ROWS:
                yield from answered(held)
                held = []
        if held:
            yield from answered(held)

    return df.mapInArrow(run, ", ".join([*(f"`{n}` {t}" for n, t in df.dtypes), f"`{column}` double"]))


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt to more tasks than cores: small rows, long work."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism)


def support_vectors_by_group(df: DataFrame, group: str, order: list[str], kernel: Gram, regularisation: float, features: str = "features", target: str = "target", train: str | None = None, most: int = DENSE) -> DataFrame:
    """``processes.predict_by_group`` of ``LeastSquaresSVM``: (group, order..., target, train, score), groups of any size.

    Groups of up to ``most`` rows are solved densely, all in parallel. A larger one is answered through
    its kernel's features, if few leave nothing, else from all pairs by conjugate gradients.
    """
    make = lambda x, y: processes.LeastSquaresSVM(kernel, x, y, regularisation)
    rows = durable(df.select(group, *order, features, target, *([train] if train else [])), "rows")
    large = [r[0] for r in rows.groupBy(group).count().where(F.col("count") > most).collect()]
    is_ = [F.col(group).eqNullSafe(F.lit(v)) for v in large]
    small = rows.where(~reduce(lambda a, b: a | b, is_, F.lit(False)))
    out = processes.predict_by_group(small, group, order, make, ("score",), features=features, target=target, train=train)
    for mine in is_:
        some = spread(rows.where(mine))
        known = some.where(train) if train else some
        of = features_of(some, kernel, features)
        if of:
            w, b = support_vectors_of(known, of, regularisation, features, target) if known.limit(1).count() else (np.full(len(of.x), np.nan), np.nan)
            answer = lambda x, of=of, w=w, b=b: (w @ of(x) + b,)
        else:
            x, y, counts, _ = points(known, features, target)
            u, v = solve(df.sparkSession, kernel, x, 1 / (regularisation * counts), np.column_stack([y, np.ones(len(y))])).T if len(x) else (np.zeros(0), np.zeros(0))
            b = float(u.sum() / v.sum()) if len(x) else np.nan
            answer = KernelSum(kernel, x, u - b * v, b).posterior
        said = processes.predict_batches(some, None, features, ("score",), answer)
        out = out.unionByName(said.select(*out.columns))
    return out
