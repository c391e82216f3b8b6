"""Queries without SQL against NumPy: ridge, cross-validation, regression and process posteriors from their formulas."""

import itertools
import math
from collections import defaultdict

import numpy as np
import pytest

from lodestone import queries as library
from lodestone.queries.learning import quality, series
from lodestone.queries.registry import Tables

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def users(spark):
    """user → (event ids, features, targets), in the order of the events."""
    rows = sorted(series(Tables(spark, SF)).collect(), key=lambda r: r["event_id"])
    found = defaultdict(list)
    for r in rows:
        found[r["user_id"]].append(r)
    return {u: ([r["event_id"] for r in g], np.array([r["features"] for r in g]), np.array([r["target"] for r in g])) for u, g in found.items()}


def rows_of(spark, name, *columns):
    return {r["event_id"]: [r[c] for c in columns] for r in library.QUERIES[name](spark, SF).collect()}


def same(got, users, answer, tolerance=2e-5):
    """Every event has its row, with what ``answer`` (x, y) says."""
    assert sorted(got) == sorted(i for ids, _, _ in users.values() for i in ids)
    for ids, x, y in users.values():
        for i, expected in zip(ids, np.column_stack(answer(x, y)), strict=True):
            assert got[i] == pytest.approx(expected.tolist(), abs=tolerance)


def squares(x, z):
    return np.array([[((a - b) ** 2).sum() for b in z] for a in x])


def rbf(x, z, b):
    return np.exp(-squares(x, z) / (2 * b * b))


def mixed(x, z):
    fbm = np.array([[((a @ a) ** 0.55 + (b @ b) ** 0.55 - ((a - b) @ (a - b)) ** 0.55) / 2 for b in z] for a in x])
    return fbm + np.array([[math.exp(-np.abs(a - b).sum() / 2.5) for b in z] for a in x])


def noise(x, level):
    return level * (squares(x, x) < 1e-18)


def posterior(k, x, y, level):
    inverse = np.linalg.inv(k(x, x) + noise(x, level))
    return k(x, x).T @ inverse @ y, np.diag(k(x, x) - k(x, x).T @ inverse @ k(x, x)), inverse


def test_process_posteriors(spark, users):
    same(rows_of(spark, "M10_gaussian_process", "mean", "variance"), users, lambda x, y: posterior(mixed, x, y, 0.5)[:2])

    def student(x, y):
        m, v, inverse = posterior(mixed, x, y, 0.5)
        return m, v * (6 + y @ inverse @ y - 2) / (6 + len(y) - 2)

    same(rows_of(spark, "M13_student_process", "mean", "variance"), users, student)

    def warped(x, y):
        m, v, _ = posterior(lambda a, b: rbf(a, b, 0.5), x, np.log1p(np.abs(y)), 0.5)
        sd = np.sqrt(np.maximum(v, 0))
        return np.expm1(m), np.expm1(m - sd), np.expm1(m + sd)

    same(rows_of(spark, "M11_warped_process", "mid", "low", "high"), users, warped)

    def skewed(x, y):
        k = lambda a, b: rbf(a, b, 0.5)
        m, v, inverse = posterior(k, x, y, 0.5)
        lam = np.full(len(y), 0.5)
        return m, v, (0.5 - k(x, x).T @ inverse @ lam) / math.sqrt(1 + lam @ inverse @ lam)

    same(rows_of(spark, "M14_skew_process", "mean", "variance", "skew"), users, skewed)

    def mixture(x, y):
        parts = [posterior(lambda a, b, w=w: rbf(a, b, w), x, y, 0.5) for w in (0.3, 0.6, 1.2)]
        e = np.array([energy(x, y, w, 0.5) for w in (0.3, 0.6, 1.2)])
        p = np.exp(-(e - e.min())) / np.exp(-(e - e.min())).sum()
        m = sum(a * part[0] for a, part in zip(p, parts, strict=True))
        return m, sum(a * (part[1] + part[0] ** 2) for a, part in zip(p, parts, strict=True)) - m**2

    same(rows_of(spark, "M15_M25_mixture", "mean", "variance"), users, mixture)

    def matrix_t(x, y):
        k, both = rbf(x, x, 0.5), np.column_stack([y, 2 * y])
        inverse, h = np.linalg.inv(k + noise(x, 0.5)), np.column_stack([np.ones(len(x)), x])
        b = np.linalg.solve(h.T @ inverse @ h, h.T @ inverse @ both)
        return *(h @ b + k.T @ inverse @ (both - h @ b)).T, np.full(len(y), len(y) - 3.0)

    same(rows_of(spark, "M13_matrix_t", "first", "second", "dof"), users, matrix_t)


def energy(x, y, width, level):
    k = rbf(x, x, width) + noise(x, level)
    return float(y @ np.linalg.inv(k) @ y / 2 + np.linalg.slogdet(k)[1] / 2 + len(y) / 2 * math.log(2 * math.pi))


def svm(x, y, width):
    n = len(y)
    m = np.block([[np.zeros((1, 1)), np.ones((1, n))], [np.ones((n, 1)), rbf(x, x, width) + np.eye(n) / 2.5]])
    s = np.linalg.inv(m) @ np.r_[0, y]
    return rbf(x, x, width) @ s[1:] + s[0]


def test_support_vectors(spark, users):
    same(rows_of(spark, "M8_ls_svm", "score"), users, lambda x, y: (svm(x, y, 0.5),))
    scores = {u: np.column_stack([svm(x, y, w) for w in (0.3, 0.6, 1.2)]) for u, (_, x, y) in users.items()}
    errors = np.concatenate([scores[u] - y[:, None] for u, (_, _, y) in users.items()])
    w = np.linalg.solve(errors.T @ errors / len(errors) + 1e-12 * np.eye(3), np.ones(3))
    got = rows_of(spark, "M9_committee", "score")
    for u, (ids, _, _) in users.items():
        for i, s in zip(ids, scores[u] @ w / w.sum(), strict=True):
            assert got[i][0] == pytest.approx(s, abs=1e-3)


def test_energies_over_all_users(spark, users):
    at = lambda b, n: sum(energy(x, y, b, n) for _, x, y in users.values())
    got = library.QUERIES["M21_grid_search"](spark, SF).collect()
    assert len(got) == 9
    for r in got:
        assert r["energy"] == pytest.approx(at(r["b"], r["noise"]), rel=1e-6)
    tuned = library.QUERIES["M26_tuned_process"](spark, SF).first()
    grid = [2.0 - 0.4 * k for k in range(1, 5)]
    assert tuned["b"] == pytest.approx(min(grid, key=lambda b: at(b, 0.5)), abs=1e-6) and tuned["energy"] == pytest.approx(min(at(b, 0.5) for b in grid), rel=1e-6)
    groups = {r["user_id"]: r for r in library.QUERIES["M10_process_by_group"](spark, SF).collect()}
    assert set(groups) == set(users)
    for u, (_, x, y) in users.items():
        assert (groups[u]["n"], groups[u]["energy"]) == (len(y), pytest.approx(energy(x, y, 0.5, 0.1), abs=1e-3))


def test_free_runs(spark, users):
    got = {(r["user_id"], r["step"]): r["value"] for r in library.QUERIES["W11_free_run"](spark, SF).collect()}
    assert len(got) == 5 * len(users)
    for u, (_, x, y) in users.items():
        inverse, lags = np.linalg.inv(mixed(x, x) + noise(x, 0.5)), np.r_[x[-1, 1:], y[-1]]
        for step in range(1, 6):
            value = float(mixed(x, lags[None])[:, 0] @ inverse @ y)
            assert got[u, step] == pytest.approx(value, abs=1e-5)
            lags = np.r_[lags[1:], value]


def test_laplace_mode(spark, users):
    def classify(x, y):
        k, t = rbf(x, x, 0.5), np.where(y > np.median(y), 1.0, -1.0)
        f = np.zeros(len(y))
        for _ in range(100):  # damped steps on the log posterior
            p = 1 / (1 + np.exp(-f))
            grad = (t + 1) / 2 - p
            w = np.diag(p * (1 - p))
            f = np.linalg.solve(np.eye(len(f)) + k @ w, k @ (w @ f + grad))
        p = 1 / (1 + np.exp(-f))
        v = np.diag(k - k @ np.linalg.inv(k + np.diag(1 / (p * (1 - p)))) @ k) if np.linalg.cond(k) < 1e12 else np.diag(k - k @ np.linalg.solve(np.eye(len(f)) + np.diag(p * (1 - p)) @ k, np.diag(p * (1 - p)) @ k))
        m = k.T @ ((t + 1) / 2 - p)
        return (1 / (1 + np.exp(-m / np.sqrt(1 + math.pi * v / 8))),)

    same(rows_of(spark, "M12_laplace_classifier", "probability"), users, classify, 1e-4)


def ridge(x, y, penalty=1.0):
    z = np.column_stack([x, np.ones(len(x))])
    return np.linalg.solve(z.T @ z + penalty * np.eye(z.shape[1]), z.T @ y)


def all_metrics(score, label):
    log, r = np.log1p(np.abs(score)) - np.log1p(np.abs(label)), label - score
    return {
        "mae": np.abs(r).mean(), "rmse": math.sqrt((r**2).mean()), "rmsle": math.sqrt((log**2).mean()), "msle": (log**2).mean(), "r2": 1 - (r**2).sum() / ((label - label.mean()) ** 2).sum(),
        "pearson": np.corrcoef(score, label)[0, 1], "yield": np.ptp(score) / np.ptp(label), "efficiency": (r**2).mean(), "sigma": r.std(ddof=1), "sigma_ref": math.sqrt(r.var(ddof=1) / (len(r) - 1)), "n": len(r),
    }


def test_ridge_pipelines(spark, users):
    t = Tables(spark, SF)
    got = library.QUERIES["EX6_autoregression"](spark, SF).first()
    x = 100 * np.concatenate([x for _, x, _ in users.values()])
    y = 100 * np.concatenate([y for _, _, y in users.values()])
    w = ridge(x, y)
    for k, v in all_metrics(np.column_stack([x, np.ones(len(x))]) @ w, y).items():
        assert got[k] == pytest.approx(v, abs=1e-3, rel=1e-6), k
    from pyspark.sql import functions as F

    part = F.pmod(F.xxhash64("l_orderkey", "l_linenumber"), F.lit(10)) < 8
    d = np.array([list(map(float, r)) for r in t.lineitem.select("l_quantity", "l_discount", "l_extendedprice", part.cast("int")).collect()])
    train, test = d[d[:, 3] == 1], d[d[:, 3] == 0]
    z = lambda m: (m[:, :2] - train[:, :2].mean(0)) / train[:, :2].std(0, ddof=1)
    w = ridge(z(train), train[:, 2])
    got = library.QUERIES["entry_ridge_pipeline"](spark, SF).first()
    expected = all_metrics(np.column_stack([z(test), np.ones(len(test))]) @ w, test[:, 2])
    for k in got.asDict():
        assert got[k] == pytest.approx(expected[k], rel=1e-6, abs=1e-6), k


def test_cross_validation(spark):
    from pyspark.sql import functions as F

    t = Tables(spark, SF)
    fold = F.pmod(F.xxhash64("l_orderkey"), F.lit(5))
    d = np.array([list(map(float, r)) for r in t.lineitem.select("l_quantity", "l_discount", "l_extendedprice", fold).collect()])
    errors = []
    for k in range(5):
        train, test = d[d[:, 3] != k], d[d[:, 3] == k]
        errors.append(((np.column_stack([test[:, :2], np.ones(len(test))]) @ ridge(train[:, :2], train[:, 2]) - test[:, 2]) ** 2, len(test)))
    mean_of_folds = np.mean([math.sqrt(e.mean()) for e, _ in errors])
    over_all = math.sqrt(sum(e.sum() for e, _ in errors) / len(d))
    got = library.QUERIES["M6_cross_validation"](spark, SF).first()["rmse"]
    assert min(abs(got - mean_of_folds), abs(got - over_all)) < 1e-3


@pytest.mark.parametrize("name", ["M3_logistic", "M20_quasi_newton"])
def test_logistic_scores_order_as_the_exact_fit(spark, name):
    rows = sorted(quality(Tables(spark, SF)).collect(), key=lambda r: r["doc_id"])
    x, y = np.array([[r["a"], r["b"], 1.0] for r in rows]), np.array([r["y"] for r in rows])
    w = np.zeros(3)
    for _ in range(50):  # Newton's method, a slight penalty
        p = 1 / (1 + np.exp(-x @ w))
        w += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(3), x.T @ (y - p) - 1e-3 * w)
    got = {r["doc_id"]: r["score"] for r in library.QUERIES[name](spark, SF).collect()}
    scores = np.array([got[r["doc_id"]] for r in rows])
    assert set(got) == {r["doc_id"] for r in rows} and ((scores >= 0) & (scores <= 1)).all()
    loss = lambda p: -np.mean(np.log(np.where(y == 1, p, 1 - p).clip(1e-12)))
    assert loss(1 / (1 + np.exp(-x @ w))) - 1e-3 <= loss(scores) < loss(np.full(len(y), y.mean()))


def test_best_of_the_grid_is_listed(spark):
    found = library.QUERIES["M21_grid_search"](spark, SF).collect()
    axis = [1.5 - 0.3 * k for k in range(1, 4)]
    assert sorted((round(r["b"], 6), round(r["noise"], 6)) for r in found) == sorted((round(a, 6), round(b, 6)) for a, b in itertools.product(axis, axis))
