"""Sums of kernels over many points of the plane, in all but linear time and to rounding.

``sums_of`` takes apart what ``gram.plus`` added up. The Laplacian kernel splits in four quadrants, each a
product of powers, summed over points below and left of a place by a wavelet matrix. The kernel of
fractional Brownian motion is two products and a power of the distance: near boxes of a grid are summed
directly, others through Chebyshev nodes of boxes (a fast multipole method; no pair is left out).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np
from pyspark import cloudpickle

from lodestone.plans.gram import Gram

#: Chebyshev nodes a side of a box: the error is some 1e-12 of a box's largest value.
NODES = 14
#: The finest grid has 4 ** GRID boxes (26 MB of local values).
GRID = 7
#: Cells of a directly summed piece.
CELLS = 1 << 15
#: Widths over the Laplacian's scale up to which sums of powers hold their digits.
SPAN = 16.0
#: Points that the Dirac kernel may take for equal.
SAME = 1e-9


def _basis(t: np.ndarray) -> np.ndarray:
    """Values at t of the polynomials that are 1 at one Chebyshev node and 0 at the others: (len(t), NODES)."""
    k = np.arange(NODES)
    at = np.cos(np.outer(np.arccos(np.clip(t, -1, 1)), k))
    nodes = np.cos(np.outer((2 * k + 1) * np.pi / (2 * NODES), k))
    weight = np.where(k == 0, 1.0, 2.0) / NODES
    return (at * weight) @ nodes.T


class Corner:
    """Sums over the points below and left of places: a wavelet matrix of the ranks of x2 in the order of x1."""

    def __init__(self, x: np.ndarray):
        order = np.argsort(x[:, 0], kind="stable")
        second = np.argsort(x[:, 1], kind="stable")
        rank = np.empty(len(x), np.int64)
        rank[second] = np.arange(len(x))
        self.first, self.second, self.levels, now = x[order, 0], x[second, 1], [], order
        for bit in reversed(range(len(x).bit_length())):
            zero = (rank[now] >> bit) & 1 == 0
            self.levels.append((bit, now.astype(np.int32), zero, np.r_[0, np.cumsum(zero)].astype(np.int32)))
            now = np.concatenate([now[zero], now[~zero]])

    def weighted(self, v: np.ndarray) -> list[np.ndarray]:
        return [np.r_[0, np.cumsum(np.where(zero, v[now], 0))] for _, now, zero, _ in self.levels]

    def at(self, z: np.ndarray, weighted: list[np.ndarray], sides: tuple[str, str]) -> np.ndarray:
        b = np.searchsorted(self.second, z[:, 1], sides[1])
        out, low, high = np.zeros(len(z)), np.zeros(len(z), np.int64), np.searchsorted(self.first, z[:, 0], sides[0])
        for (bit, _, _, zeros), total in zip(self.levels, weighted, strict=True):
            up = (b >> bit) & 1 == 1
            out += np.where(up, total[high] - total[low], 0)
            low_zero, high_zero = zeros[low], zeros[high]
            low, high = np.where(up, zeros[-1] + low - low_zero, low_zero), np.where(up, zeros[-1] + high - high_zero, high_zero)
        return out


@dataclass(frozen=True)
class Quadrants:
    """Σ vₖ exp(-|z - xₖ|₁ / β): every quadrant as seen from its own corner, so that nothing large is subtracted."""

    x: np.ndarray
    beta: float

    def __reduce__(self):
        return Quadrants, (self.x, self.beta)

    @cached_property
    def _corners(self) -> list[tuple[np.ndarray, Corner]]:
        return [(turn, Corner(self.x * turn)) for turn in (np.array([i, j]) for i in (1.0, -1.0) for j in (1.0, -1.0))]

    def _power(self, z: np.ndarray, turn: np.ndarray) -> np.ndarray:
        return np.exp((z - self.x.mean(0)) @ turn / self.beta)

    def weighted(self, v: np.ndarray) -> list:
        """What answers need besides the points."""
        return [corner.weighted(v * self._power(self.x, turn)) for turn, corner in self._corners]

    def at(self, z: np.ndarray, weighted: list) -> np.ndarray:
        side = lambda s: "right" if s > 0 else "left"
        return sum(corner.at(z * turn, w, (side(turn[0]), side(turn[1]))) / self._power(z, turn) for (turn, corner), w in zip(self._corners, weighted, strict=True))


@dataclass(frozen=True)
class Distances:
    """Σ vₖ |z - xₖ|²ʰ for places z inside the square around x."""

    x: np.ndarray
    hurst: float
    grid: int

    def __reduce__(self):
        return Distances, (self.x, self.hurst, self.grid)

    @cached_property
    def square(self) -> tuple[np.ndarray, float]:
        low = self.x.min(0)
        return low, float((self.x.max(0) - low).max()) or 1.0

    def inside(self, z: np.ndarray) -> np.ndarray:
        low, side = self.square
        return ((z >= low) & (z <= low + side)).all(1)

    def place(self, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(box of each place, where in it it lies: -1 to 1)."""
        low, side = self.square
        m = 2**self.grid
        u = (z - low) / side * m
        box = np.clip(np.floor(u).astype(np.int64), 0, m - 1)
        return box[:, 0] * m + box[:, 1], 2 * (u - box) - 1

    @cached_property
    def _sorted(self):
        """(points by box, the order, first of each box)."""
        box, t = self.place(self.x)
        order = np.argsort(box, kind="stable")
        return self.x[order], order, np.searchsorted(box[order], np.arange(4**self.grid + 1)), t[order]

    @cached_property
    def _halves(self):
        """A parent's polynomials at its children's nodes, by which half they are."""
        nodes = np.cos((2 * np.arange(NODES) + 1) * np.pi / (2 * NODES))
        return [_basis((nodes - 1) / 2), _basis((nodes + 1) / 2)]

    @cached_property
    def _between(self):
        """(common basis, by offset: the power of the distance between nodes of boxes of half-width 1, in that basis)."""
        nodes = np.cos((2 * np.arange(NODES) + 1) * np.pi / (2 * NODES))
        at = np.stack(np.meshgrid(nodes, nodes, indexing="ij"), -1).reshape(-1, 2)
        apart = at[None] - at[:, None]
        far = {(i, j): (((apart + [2 * i, 2 * j]) ** 2).sum(2)) ** self.hurst for i in range(-3, 4) for j in range(-3, 4) if max(abs(i), abs(j)) > 1}
        vectors, values, _ = np.linalg.svd(np.hstack(list(far.values())), full_matrices=False)
        basis = vectors[:, values > 1e-15 * values[0]]
        return basis, {o: np.ascontiguousarray((basis.T @ k @ basis).T) for o, k in far.items()}

    def local(self, v: np.ndarray) -> np.ndarray:
        """What all boxes but a box and its neighbours give at its nodes: (boxes, NODES, NODES)."""
        p, (_, order, first, t) = NODES, self._sorted
        m = 2**self.grid
        full = np.flatnonzero(np.diff(first))
        one, two = _basis(t[:, 0]) * v[order, None], _basis(t[:, 1])
        leaf = np.zeros((m * m, p, p))
        for i in range(p):
            leaf[full, i] = np.add.reduceat(one[:, i, None] * two, first[full], 0)
        halves, up = self._halves, {self.grid: leaf.reshape(m, m, p, p)}
        for level in range(self.grid - 1, 1, -1):
            child = up[level + 1]
            up[level] = sum(halves[a].T @ child[a::2, b::2] @ halves[b] for a in (0, 1) for b in (0, 1))
        basis, between = self._between
        down = None
        for level in range(2, self.grid + 1):
            m, k = 2**level, basis.shape[1]
            given = np.zeros((m + 6, m + 6, k))
            given[3:-3, 3:-3] = up.pop(level).reshape(m, m, p * p) @ basis
            got = np.zeros((m, m, k))
            for a in (0, 1):
                for b in (0, 1):
                    mine = np.zeros((m * m // 4, k))
                    for i in range(-2 - a, 4 - a):
                        for j in range(-2 - b, 4 - b):
                            if max(abs(i), abs(j)) > 1:
                                mine += given[3 + a + i : 3 + a + i + m : 2, 3 + b + j : 3 + b + j + m : 2].reshape(-1, k) @ between[i, j]
                    got[a::2, b::2] = mine.reshape(m // 2, m // 2, k)
            half = self.square[1] / m / 2
            here = ((got * half ** (2 * self.hurst)) @ basis.T).reshape(m, m, p, p)
            if down is not None:
                for a in (0, 1):
                    for b in (0, 1):
                        here[a::2, b::2] += halves[a] @ down @ halves[b].T
            down = here
        return down.reshape(-1, p, p)

    def at(self, z: np.ndarray, v: np.ndarray | None, local: np.ndarray | None = None) -> np.ndarray:
        """Near boxes directly, if ``v`` is given; the others, if ``local`` is."""
        points, order, first, _ = self._sorted
        v, m = None if v is None else v[order], 2**self.grid
        box, t = self.place(z)
        mine = np.argsort(box, kind="stable")
        z, t, out = z[mine], t[mine], np.zeros(len(z))
        found, starts = np.unique(box[mine], return_index=True)
        one, two = (_basis(t[:, 0]), _basis(t[:, 1])) if local is not None else (None, None)
        for k, start, end in zip(found.tolist(), starts.tolist(), [*starts[1:].tolist(), len(z)], strict=True):
            if local is not None:
                out[start:end] = ((one[start:end] @ local[k]) * two[start:end]).sum(1)
            if v is None:
                continue
            parts = self._near(*divmod(k, m))
            near, weights = np.concatenate([points[s] for s in parts]), np.concatenate([v[s] for s in parts])
            step = max(1, CELLS // max(1, len(near)))
            for s in range(start, end, step):
                e = min(end, s + step)
                d = np.subtract.outer(z[s:e, 0], near[:, 0])
                d *= d
                other = np.subtract.outer(z[s:e, 1], near[:, 1])
                other *= other
                d += other
                out[s:e] += np.power(d, self.hurst, out=d) @ weights
        back = np.empty_like(out)
        back[mine] = out
        return back

    def _near(self, i: int, j: int) -> list[slice]:
        """Where the points of a box and its neighbours lie, a row of boxes each."""
        first, m = self._sorted[2], 2**self.grid
        return [slice(first[r * m + max(j - 1, 0)], first[r * m + min(j + 1, m - 1) + 1]) for r in range(max(i - 1, 0), min(i + 2, m))]

    def shares(self, parts: int) -> list[np.ndarray]:
        """The points in shares of about equal numbers of near pairs."""
        _, order, first, _ = self._sorted
        m = 2**self.grid
        count = np.pad(np.diff(first).reshape(m, m), 1)
        pairs = sum(count[a : a + m, b : b + m] for a in range(3) for b in range(3)).ravel()
        done = np.cumsum(np.repeat(pairs, np.diff(first)))
        return np.split(order, np.searchsorted(done, done[-1] * np.arange(1, parts) / parts))


@dataclass(frozen=True)
class Sums:
    """Σ vₖ k(z, xₖ) for a kernel that is a sum of known ones."""

    kernel: Gram
    x: np.ndarray
    laplacian: tuple[Quadrants, ...]
    power: tuple[Distances, ...]
    #: What a point gets from itself alone.
    dirac: float

    def smooth(self, z: np.ndarray, v: np.ndarray, trees: list) -> np.ndarray:
        """All but powers of distances and what points get from themselves alone."""
        out = sum((q.at(z, w) for q, w in zip(self.laplacian, trees, strict=True)), np.zeros(len(z)))
        for d in self.power:
            out += ((z**2).sum(1) ** d.hurst * v.sum() + v @ (self.x**2).sum(1) ** d.hurst) / 2
        return out

    def trees(self, v: np.ndarray) -> list:
        return [q.weighted(v) for q in self.laplacian]

    def holds(self, places: int = 64, share: float = 1e-12) -> bool:
        """Whether sums at some points, the outermost among them, are the direct ones up to ``share`` of their parts."""
        rng = np.random.default_rng(0)
        v = rng.normal(size=len(self.x))
        ends = [f(self.x @ c) for c in ((1, 1), (1, -1), (1, 0), (0, 1)) for f in (np.argmin, np.argmax)]
        z = self.x[np.r_[ends, rng.integers(0, len(self.x), places)]]
        k = np.vstack([self.kernel(z[i : i + 1], self.x) for i in range(len(z))])
        return bool((np.abs(Answers(self, v).posterior(z)[0] - k @ v) <= share * (np.abs(k) @ np.abs(v))).all())


@dataclass(frozen=True)
class Answers:
    """Σ vₖ k(z, xₖ) at any places."""

    sums: Sums
    v: np.ndarray

    def __reduce__(self):
        """With what far boxes give: that is worked out once, here."""
        return _answers, (cloudpickle.dumps(self.sums), self.v, self.local)

    @cached_property
    def local(self) -> list[np.ndarray]:
        return [d.local(self.v) for d in self.sums.power]

    @cached_property
    def _trees(self) -> list:
        return self.sums.trees(self.v)

    def posterior(self, z: np.ndarray) -> tuple[np.ndarray]:
        out, inside = np.zeros(len(z)), np.ones(len(z), bool)
        for d in self.sums.power:
            inside &= d.inside(z)
        for i in np.flatnonzero(~inside):
            out[i] = self.sums.kernel(z[i : i + 1], self.sums.x)[0] @ self.v
        near = z[inside]
        got = self.sums.smooth(near, self.v, self._trees)
        for d, local in zip(self.sums.power, self.local, strict=True):
            got -= d.at(near, self.v, local) / 2
        out[inside] = got
        return (out,)


def _answers(sums: bytes, v: np.ndarray, local: list[np.ndarray]) -> Answers:
    out = Answers(cloudpickle.loads(sums), v)
    out.__dict__["local"] = local
    return out


def sums_of(kernel: Gram, x: np.ndarray) -> Sums | None:
    """None where a part has no such sum, or its digits wouldn't hold; ``kernel`` without Dirac parts answers anywhere."""
    if x.ndim != 2 or x.shape[1] != 2 or not np.isfinite(x).all() or len(x) < 2:
        return None
    laplacian, power, dirac = [], [], 0.0
    grid = int(np.clip(np.ceil(np.log2(len(x) / 8) / 2), 2, GRID))
    for name, value in getattr(kernel, "parts", [("", 0.0)]):
        if name == "laplacian" and np.ptp(x, 0).max() <= SPAN / 2 * value:
            laplacian.append(Quadrants(x, value))
        elif name == "fbm" and value > 0:
            power.append(Distances(x, value, grid))
        elif name == "dirac" and all(np.diff(np.unique(c)).min(initial=np.inf) > SAME for c in x.T):
            dirac += value
        else:
            return None
    return Sums(kernel, x, tuple(laplacian), tuple(power), dirac)
