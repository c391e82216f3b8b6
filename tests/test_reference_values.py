"""Golden numbers and small worked cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions import bases, kernels, scalar
from lodestone.operators import joins, linalg, metrics, ordered, pipes, scalers, stats
from lodestone.plans import glm, gram, nets, processes, sequences, tuning
from lodestone.sources import binary, feeds, text


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def vec(*xs):
    return F.array(*(F.lit(float(x)) for x in xs))


@pytest.mark.parametrize(
    "column, expected",
    [
        (lambda: scalar.hermite(2, F.lit(2.0)), 3.0),
        (lambda: scalar.chebyshev(2, F.lit(2.0), 2), 15.0),
        (lambda: scalar.legendre(2, F.lit(2.0)), 5.5),
        (lambda: scalar.harmonic(F.lit(2.5)), 1.5),
        (lambda: F.factorial(F.lit(5)), 120),
        (lambda: scalar.lgamma(F.lit(4.5)), math.lgamma(4.5)),
        (lambda: scalar.erf(F.lit(0.7)), math.erf(0.7)),
        (lambda: scalar.erf(F.lit(-5.0)), math.erf(-5.0)),
        (lambda: scalar.inverse_erf(F.lit(0.3)), 0.2724627147267543),
        (lambda: kernels.laplacian(1.0)(vec(1), vec(0)), 0.36787944117),
        (lambda: kernels.se(1.0)(vec(1), vec(0)), 0.60653065971),
        (lambda: kernels.polynomial(2, 1.0)(vec(1), vec(1.5)), 6.25),
        (lambda: kernels.cauchy(0.5 * 2)(vec(1), vec(1.5)), 0.8),
        (lambda: kernels.fbm(0.5)(vec(1), vec(0)), 0.0),
        (lambda: kernels.mlp(1.0, 0.0)(vec(1), vec(1)), math.pi / 6),
        (lambda: bases.wavelet(bases.haar_mother)(1.0, 0.5)(F.lit(1.0)), -1.0),
    ],
)
def test_values(spark, column, expected):
    assert value(spark, column()) == pytest.approx(expected, abs=1e-9)


def test_ranges(spark):
    assert value(spark, scalar.open_range(0.0, 1.0, 2)) == [0.0, 0.5]
    assert value(spark, scalar.numeric_range(0.0, 1.0, 2)) == [0.0, 0.5, 1.0]


def test_integers_one_to_ten(spark):
    df = spark.range(1, 11).select(F.col("id").alias("value"))
    assert pipes.filtered(F.col("value") % 2 == 0)(df).count() == 5
    assert pipes.flat_mapped(F.sequence(F.lit(1), "value"), "x")(df).count() == 55
    assert [r["scan"] for r in ordered.scan(df, "value", ["value"]).orderBy("value").collect()] == [k * (k + 1) // 2 for k in range(1, 11)]
    assert all(len(r["values"]) == 2 for r in ordered.grouped(df, "value", 2, ["value"]).collect())
    with pytest.raises(ValueError):
        ordered.split_by_share(df, 0.0, ["value"])


def test_blocks_of_positions(spark, monkeypatch):
    monkeypatch.setattr(ordered, "BLOCK", 7)
    df = spark.range(50).select("id", (F.col("id") * F.col("id")).alias("v"))
    out = {r["id"]: (r["a"], r["b"]) for r in ordered.lagged(df, "v", {"a": 1, "b": 3}, ["id"]).collect()}
    assert out == {i: ((i - 1) ** 2 if i else None, (i - 3) ** 2 if i >= 3 else None) for i in range(50)}
    total = {r["id"]: r["scan"] for r in ordered.scan(df, "v", ["id"], right=True).collect()}
    assert total == {i: sum(k * k for k in range(i, 50)) for i in range(50)}


def test_pipes_compose():
    half = pipes.Pipe(lambda x: x + 1) >> (lambda x: x / 2) >> pipes.identity
    assert half(0) == 0.5
    assert (half * half)((1, 3)) == (1.0, 2.0)
    assert pipes.fork(half, half)(1) == (1.0, 1.0)
    assert pipes.duplicate(half)((1, 3)) == (1.0, 2.0)
    assert pipes.chain(half, half)(1) == 1.0


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "id long, v double")
    assert ordered.with_position(empty, ["id"]).count() == 0
    assert ordered.lagged(empty, "v", {"a": 1}, ["id"]).count() == 0
    assert stats.histogram(empty, "v", 4).count() == 0
    assert joins.last_wins_join(empty, empty.withColumnRenamed("v", "w"), "id", ["w"]).count() == 0


@pytest.mark.parametrize(
    "values, bins, expected",
    [
        ([1, 2, 3, 4], 4, [("1.00 - 2.00", 1), ("2.00 - 3.00", 1), ("3.00 - 4.00", 1), ("4.00 - 5.00", 1)]),
        ([1, 2, 4], 4, [("1.00 - 2.00", 1), ("2.00 - 3.00", 1), ("3.00 - 4.00", 0), ("4.00 - 5.00", 1)]),
    ],
)
def test_histogram(spark, values, bins, expected):
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    assert [(r["label"], r["count"]) for r in stats.histogram(df, "x", bins).orderBy("bin").collect()] == expected


def test_identical_scores(spark):
    df = spark.createDataFrame([(float(i * i),) * 2 for i in range(10)], "score double, label double")
    r = metrics.regression_metrics(df).first()
    assert (r["rmse"], r["mae"], r["r2"], r["yield"]) == (0, 0, 1, 1) and r["pearson"] == pytest.approx(1)


def test_order_statistics(spark):
    df = spark.createDataFrame([(v,) for v in (2, 3, 4, 1)], "x int")
    assert stats.quickselect(df, "x", 2).first()["value"] == 2
    assert stats.median(spark.createDataFrame([(v,) for v in (4, 3, 2, 5, 1)], "x int"), "x").first()["median"] == 3


def test_mixed_radix(spark):
    e = scalers.mixed_radix([2, 2])
    digits = [[0, 0], [1, 0], [0, 1], [1, 1]]
    assert [value(spark, e.encode(F.array(*map(F.lit, d)))) for d in digits] == [0, 1, 2, 3]
    assert [value(spark, e.decode(F.lit(n))) for n in range(4)] == digits


def test_haar(spark):
    x = [1.0, 3.0, -2.0, 5.0, 0.0, 1.0, 4.0, 4.0]
    got = value(spark, bases.haar(vec(*x), 3))
    assert np.allclose(got, bases.haar_matrix(3) @ x)
    assert np.allclose(value(spark, bases.inverse_haar(vec(*got), 3)), x)


def test_solves(spark):
    assert np.allclose(linalg.solve(np.diag([1.0, 2, 4]), np.array([2.0, 4, 8])), 2)
    a = np.random.default_rng(0).standard_normal((6, 6))
    assert np.allclose(linalg.solve(a, np.ones(6)), np.linalg.solve(a, np.ones(6)))
    spd = a @ a.T + np.eye(6)
    factor = linalg.to_numpy(linalg.cholesky(linalg.from_numpy(spark, spd), 4))
    assert np.allclose(factor, np.linalg.cholesky(spd))
    assert linalg.is_symmetric(linalg.from_numpy(spark, spd)) and not linalg.is_symmetric(linalg.from_numpy(spark, a))
    assert linalg.quadratic_form(spd, np.ones(6), inverse=True) == pytest.approx(np.ones(6) @ np.linalg.solve(spd, np.ones(6)))


def test_regression_recovers_weights(spark):
    df = spark.range(5000).select(F.randn(1).alias("a"), F.randn(2).alias("b"), F.randn(3).alias("e")).withColumn("y", F.col("a") - F.col("b") + 0.05 * F.col("e"))
    model = glm.ridge(df, [F.col("a"), F.col("b")], F.col("y"))
    assert np.linalg.norm(model.weights[:2] - [1, -1]) <= 0.02
    assert glm.evaluate(model, df, F.col("y")).first()["r2"] >= 0.85
    assert glm.cross_validated_rmse(df, [F.col("a"), F.col("b")], F.col("y"), F.col("a")) == pytest.approx(0.05, abs=0.01)


def test_logistic_losses_fall(spark):
    df = spark.range(600).select(F.randn(1).alias("a"), F.randn(2).alias("e")).withColumn("y", (F.col("a") + 0.3 * F.col("e") > 0).cast("double"))
    for model in (glm.logistic_model, glm.probit_model):
        h = model(df, [F.col("a")], F.col("y"), glm.Options(0.0, 6, 1.0, 1.0)).history
        assert h[-1] < h[0]
    assert glm.quasi_newton(df, [F.col("a")], F.col("y")).history[-1] < 0.3


def test_processes():
    k, none = gram.kernel("se", b=1.0), lambda x, y: np.zeros((len(x), len(y)))
    x, y, new = np.array([[1.0]]), np.array([1.0]), np.array([[2.0]])
    m, v = processes.GaussianProcess(k, none, x, y).posterior(new)
    assert m[0] == pytest.approx(math.exp(-0.5)) and v[0] == pytest.approx(1 - math.exp(-1))
    _, v = processes.StudentProcess(k, none, x, y, mu=4.0).posterior(new)
    assert v[0] == pytest.approx((1 - math.exp(-1)) * (6 + 1 - 2) / (6 + 1 - 2))
    w = processes.committee_weights(np.random.default_rng(1).standard_normal((50, 3)))
    assert w.sum() == pytest.approx(1)
    f = processes.LaplaceClassifier(gram.kernel("rbf", b=1.0), np.array([[-1.0], [1.0]]), np.array([-1.0, 1.0]))
    p, _ = f.posterior(np.array([[-1.0], [1.0]]))
    assert p[0] < 0.5 < p[1]


def test_searches(spark):
    bowl = lambda c: (c["x"] - 2) ** 2
    assert tuning.cma_es({"x": 1.0}, bowl, tuning.Tuner(iterations=30))[1] < 1e-3
    config, energy = tuning.grid_search(spark, {"x": 3.0}, bowl, tuning.Tuner(step=0.5, size=3))
    assert config["x"] == 2.0 and energy == 0
    with pytest.raises(ValueError):
        tuning.annealing({"x": 1.0}, bowl, "none")


def test_network_gradient_and_expression(spark):
    net = nets.Network.initial([2, 3, 1], ["tanh", "linear"], 1)
    x, y = np.array([[0.3, -0.2], [1.0, 0.5]]), np.array([[0.5], [0.1]])
    g, _ = net.gradient(x, y)
    net.layers[0][0][0, 0] += 1e-6
    up = net.gradient(x, y)[1]
    net.layers[0][0][0, 0] -= 2e-6
    down = net.gradient(x, y)[1]
    net.layers[0][0][0, 0] += 1e-6
    assert g[0][0, 0] == pytest.approx((up - down) / 2e-6, rel=1e-4)
    assert value(spark, net.expression(vec(0.3, -0.2)))[0] == pytest.approx(net.forward(x)[0, 0])


def test_chain_repeats_rejected(spark):
    rows = sequences.metropolis(spark, lambda x: -float(x @ x) / 2, [0.0], 50, 2, seed=1).orderBy("chain", "step").collect()
    for a, b in zip(rows, rows[1:], strict=False):
        if a["chain"] == b["chain"] and not b["accepted"]:
            assert a["x"] == b["x"]


def test_mat_round_trip(spark, tmp_path):
    a = np.arange(6.0).reshape(2, 3)
    (tmp_path / "x.mat").write_bytes(binary.mat_bytes({"a": a}))
    r = binary.read_mat(spark, str(tmp_path / "x.mat")).first()
    assert np.allclose(np.reshape(r["data"], (2, 3), order="F"), a) and r["name"] == "a"


def test_images(spark, tmp_path):
    pixels = np.arange(4 * 6, dtype=np.uint8).reshape(4, 6, 1)
    (tmp_path / "x.pgm").write_bytes(b"P5\n# c\n6 4\n255\n" + pixels.tobytes())
    df = binary.read_images(spark, str(tmp_path / "x.pgm"))
    cut = df.select(binary.patch(F.col("pixels"), F.col("width"), F.col("channels"), 1, 2, 2, 3).alias("p")).first()["p"]
    assert bytes(cut) == pixels[1:3, 2:5].tobytes()
    assert binary.resize(pixels, 2, 3).shape == (2, 3, 1)


def test_arff_and_feeds(spark, tmp_path):
    (tmp_path / "x.arff").write_text("% c\n@relation r\n@attribute a numeric\n@attribute 'b c' {x,y}\n@data\n1.5,x\n?,y\n")
    assert [tuple(r) for r in text.arff(spark, str(tmp_path / "x.arff")).collect()] == [(1.5, "x"), (None, "y")]
    df = spark.range(5)
    assert feeds.repeat(df, 3).count() == 15 and feeds.shuffle_and_repeat(df, 2, 1).count() == 10
    assert [len(b) for b in feeds.feed(df, 2)] == [2, 2, 1]


def test_dates_and_collections(spark):
    df = spark.createDataFrame([("2020-03-04",), ("03/04/2020",), ("x",)], "s string")
    assert [r["d"] for r in df.select(scalar.date_text(scalar.parse_date(F.col("s"))).alias("d")).collect()] == ["2020-03-04", "2020-03-04", None]
    one = spark.createDataFrame([('a,"b,c",a', "k:1,k:2", "5 minutes")], "l string, m string, t string")
    r = one.select(scalar.parse_list(F.col("l")).alias("l"), scalar.parse_map(F.col("m")).alias("m"), scalar.parse_duration(F.col("t")).alias("t")).first()
    assert r["l"] == ["a", "b,c", "a"] and r["m"] == {"k": "2"} and r["t"] == 300
