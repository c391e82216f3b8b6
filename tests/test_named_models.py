"""Named model pipes, network models and examples against NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone import queries as library
from lodestone.operators import pipes
from lodestone.plans import gram, models, nets, processes
from lodestone.queries.examples import suppliers
from lodestone.queries.registry import Tables

SF = "/root/testdata/sf0.01"


def rbf(x, z, b):
    return np.exp(-np.array([[((p - q) ** 2).sum() for q in z] for p in x]) / (2 * b * b))


def test_kernel_pipes(spark):
    rows = suppliers(Tables(spark, SF)).collect()
    x, y = np.array([r["features"] for r in rows]), np.array([r["target"] for r in rows])
    same = np.array([[float((p == q).all()) for q in x] for p in x])
    k = rbf(x, x, 0.5)
    mean = k @ np.linalg.pinv(k + 0.5 * same, rcond=1e-10, hermitian=True) @ y
    n = len(y)
    m = np.block([[np.zeros((1, 1)), np.ones((1, n))], [np.ones((n, 1)), k + np.eye(n)]])
    s = np.linalg.solve(m, np.r_[0, y])
    expected = {"svm": k @ s[1:] + s[0], "process": mean, "student": mean, "skew": mean}
    got = {}
    for r in library.QUERIES["M27_kernel_pipes"](spark, SF).collect():
        got.setdefault(r["model"], {})[r["s_suppkey"]] = r["score"]
    assert set(got) == {*expected, "mixture"} and all(len(v) == n for v in got.values())
    for name, values in expected.items():
        assert [got[name][r["s_suppkey"]] for r in rows] == pytest.approx(values.tolist(), abs=2e-4), name
    with pytest.raises(ValueError):
        models.model_pipe("forest")


def test_network_gradient_sums(spark):
    """One step over several tasks equals the step on all rows at once."""
    rng = np.random.default_rng(1)
    x, y = rng.standard_normal((50, 3)), rng.standard_normal((50, 2))
    df = spark.createDataFrame([(a.tolist(), b.tolist()) for a, b in zip(x, y, strict=True)], "features array<double>, target array<double>").repartition(4)
    start = nets.Network.initial([3, 4, 2], ["tanh", "linear"])
    g, loss = start.gradient(x, y)
    got = nets.train(df, start, stop=nets.Stop(1), rate=0.1, momentum=0.0)
    assert got.history == pytest.approx([loss / 50])
    for (w, b), (w0, b0), gw, gb in zip(got.layers, start.layers, g[::2], g[1::2], strict=True):
        assert w == pytest.approx(w0 - 0.1 * gw / 50) and b == pytest.approx(b0 - 0.1 * gb / 50)


def test_stops(spark):
    rows = {r["criterion"]: r for r in library.QUERIES["M31_stops"](spark, SF).collect()}
    assert rows["steps"]["steps"] == 3 and all(r["met"] for r in rows.values())
    stop = nets.Stop(10, absolute=0.1, relative=0.05)
    assert not stop.over([1.0]) and stop.over([1.0, 0.95]) and not stop.over([10.0, 8.0]) and stop.over([10.0, 9.9]) and not nets.Stop(10).over([1.0, 1.0])


def test_layers():
    image = np.arange(32.0).reshape(4, 4, 2)
    filters = np.random.default_rng(0).standard_normal((3, 3, 2, 5))
    padded = np.pad(image, ((1, 1), (1, 1), (0, 0)))
    slow = np.array([[[sum(padded[i + a, j + b, c] * filters[a, b, c, o] for a in range(3) for b in range(3) for c in range(2)) for o in range(5)] for j in range(4)] for i in range(4)])
    assert nets.conv2d(image, filters) == pytest.approx(slow)
    assert nets.inception(image, [filters, filters[:, :, :, :2]]).shape == (4, 4, 7)
    assert nets.pyramid(image, [filters]) == pytest.approx(np.maximum(slow, 0).reshape(2, 2, 2, 2, 5).max((1, 3)))
    x = np.random.default_rng(1).standard_normal((20, 3))
    out = nets.batch_norm(x)
    assert out.mean(0) == pytest.approx(np.zeros(3), abs=1e-9) and out.var(0) == pytest.approx(np.ones(3), abs=1e-3)


def test_examples_answer_for_held_out_rows(spark):
    """Each example's count is that of the rows it was not trained on; its errors stay near the targets' spread."""
    for name in ("EX2_matrix_t_outputs", "EX3_exogenous_process", "EX4_outputs_network", "EX5_support_vectors", "EX8_committee_of_networks"):
        rows = library.QUERIES[name](spark, SF).collect()
        assert all(r["n"] == 2978 and r["rmse"] < 1.0 for r in rows), name
    rows = {r["model"]: r for r in library.QUERIES["EX9_linear_and_network"](spark, SF).collect()}
    assert rows["ridge"]["r2"] > 0.99 and rows["network"]["n"] == rows["ridge"]["n"]


def test_repeated_points_are_solved():
    x = np.array([[0.0], [0.0], [1.0]])
    p = processes.GaussianProcess(gram.kernel("rbf", b=1.0), gram.kernel("dirac", noise=0.1), x, np.array([1.0, 1.0, 0.0]))
    mean, variance = p.posterior(x)
    assert np.isfinite(mean).all() and (variance > -1e-6).all() and mean[0] == pytest.approx(mean[1])


def test_rows_and_back(spark):
    seen = spark.sparkContext.accumulator(0)
    df = spark.range(10)
    assert pipes.foreach(lambda r: seen.add(r["id"]))(df).count() == 10 and seen.value == 45
    again = (pipes.to_rows() >> pipes.to_frame(spark, "id long"))(df)
    assert again.agg(F.sum("id")).first()[0] == 45


def test_options_and_contracts(tmp_path):
    from dataclasses import dataclass

    from lodestone import options
    from lodestone.plans import contracts

    @dataclass
    class Run:
        path: str = options.option(exists=True)
        step: float = options.option(0.3, positive=True)
        size: int = options.option(3, within=(1, 10))
        kind: str = options.option("grid", choices=("grid", "annealing"))
        quiet: bool = options.option(False)

    settings = tmp_path / "run.properties"
    settings.write_text(f"# a run\npath = {tmp_path}\nstep=0.5\nquiet=true\nother=1\n")
    got = options.parse(Run, ["--step", "0.25", "--size", "7"], options.properties(str(settings)))
    assert got == Run(str(tmp_path), 0.25, 7, "grid", True)
    for wrong in (["--step", "-1"], ["--size", "11"], ["--kind", "x"], ["--path", "/nowhere/at/all"]):
        with pytest.raises(ValueError):
            options.parse(Run, wrong, options.properties(str(settings)))
    with pytest.raises(ValueError, match="path"):
        options.parse(Run, [])
    p = processes.GaussianProcess(gram.kernel("rbf", b=1.0), gram.kernel("dirac", noise=0.1), np.zeros((1, 1)), np.zeros(1))
    assert isinstance(p, contracts.Optimizable) and isinstance(p, contracts.Posterior) and isinstance(nets.Model([1, 1], ["linear"]), contracts.Predictor)


def test_prior_sampling(spark):
    from test_models_numpy import energy

    from lodestone.queries.learning import series
    from lodestone.queries.registry import Tables as T

    users = {}
    for r in sorted(series(T(spark, "/root/testdata/sf0.001")).collect(), key=lambda r: r["event_id"]):
        users.setdefault(r["user_id"], []).append((r["features"], r["target"]))
    for r in library.QUERIES["M21_prior_sampling"](spark, "/root/testdata/sf0.001").collect():
        total = sum(energy(np.array([x for x, _ in g]), np.array([y for _, y in g]), r["b"], 0.5) for g in users.values())
        assert r["energy"] == pytest.approx(total, rel=1e-3)


def test_released_tables(spark):
    """Tables named inside a block go at its end, those of other blocks and threads stay."""
    from lodestone.session import durable, released

    outer, inner, kept = [], [], []
    durable(spark.range(3), "outer", outer)
    with released(spark):
        durable(spark.range(3), "kept", kept)
        with released(spark, kept):
            durable(spark.range(3), "inner", inner)
        with pytest.raises(Exception):
            spark.read.parquet(inner[0]).count()
        assert spark.read.parquet(kept[0]).count() == 3
    assert spark.read.parquet(outer[0]).count() == 3
    with pytest.raises(Exception):
        spark.read.parquet(kept[0]).count()
