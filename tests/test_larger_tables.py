"""What shows only on larger tables: zeros from below, more rows than a driver holds, all pairs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.plans import nets
from lodestone.queries.statistics import rounded_items


def signs(values):
    return [math.copysign(1, v) for v in values]


def test_rounding_to_zero_from_below(spark):
    """As DuckDB: round(-1e-9, 6) is -0.0."""
    got = spark.createDataFrame([([-1e-9, -0.0, 0.0, 1e-9, -0.5, None],)], "v array<double>").select(rounded_items("v").alias("v")).first()["v"]
    assert got == [0, 0, 0, 0, -0.5, None] and signs(got[:5]) == [-1, -1, 1, 1, -1]


def test_linear_layer_keeps_the_sign_of_zero():
    got = nets.finite_horizon(np.array([[0.0], [1.5]]), np.array([[2.0, -1.0]]), np.array([1.0, 0.0]), 2)
    assert got.tolist() == [[[1.0], [0.0]], [[4.0], [-1.5]]] and signs(got[0].ravel()) == [1, -1]


def query_on(spark, tmp_path, name, vectors):
    """A query over embeddings of these vectors of 64: its array column by vec_id."""
    from lodestone import queries as library

    rows = [(i, v) for i, v in enumerate(vectors)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    return [list(r)[1] for r in library.QUERIES[name](spark, str(tmp_path)).orderBy("vec_id").collect()]


def test_haar_inverse_gives_the_very_values(spark, tmp_path):
    """Halfway cases (odd multiples of 1/128) aren't moved by the transforms' last bits."""
    rng = np.random.default_rng(1)
    v = rng.normal(size=(200, 64)).astype(np.float32)
    v[:, 20] = (2 * np.arange(200) + 1) / 128
    v[0, 3] = -1e-9
    got = query_on(spark, tmp_path, "F24_haar_inverse", v.tolist())
    expected = np.trunc(np.abs(v.astype(float)) * 1e6 + 0.5) / 1e6 * np.sign(v)
    assert np.array_equal(got, expected) and math.copysign(1, got[0][3]) == -1


def test_batch_norm_below_zero(spark, tmp_path):
    got = query_on(spark, tmp_path, "M30_batch_norm", [[1.0] * 64, [-1.0] * 64, [-1e-7] * 64])
    assert got[2] == [0.0] * 64 and signs(got[2]) == [-1] * 64


def test_residual_below_zero(spark, tmp_path):
    got = query_on(spark, tmp_path, "M30_residual", [[-1e-7] * 64, [1.0] * 64])
    assert got[0] == [0.0] * 64 and signs(got[0]) == [-1] * 64 and got[1] == [3.0] * 64


def test_drained_streams_stay_off_the_driver(spark, tmp_path):
    from lodestone.streaming import tables

    df = spark.range(30).select((F.col("id") % 3).alias("k"), F.col("id").alias("t"), F.col("id").cast("double").alias("v"))
    df.repartition(3).write.parquet(f"{tmp_path}/in")
    lags = tables.drain(tables.lag_features(tables.read(spark, f"{tmp_path}/in", df, files=9), "k", ["t"], "v", 2), "off_driver", "append")
    assert len(lags.inputFiles()) > 0 and lags.count() == 24
    total = tables.drain(tables.running_metrics(tables.read(spark, f"{tmp_path}/in", df).withColumn("y", F.lit(0.0)), "v", "y"), "off_driver_total", "complete")
    assert [r["n"] for r in total.collect()] == [30]


def test_entropy_in_chunks(spark, monkeypatch):
    """Several chunks of all pairs, a null vector and a vector with a null left out; no rows, no entropy."""
    from lodestone.operators import joins

    monkeypatch.setattr(joins, "CHUNK", 1000)
    x = np.random.default_rng(4).normal(size=(300, 3))
    x[7] = x[8]
    df = spark.createDataFrame([(v.tolist(),) for v in x] + [(None,), ([1.0, None, 2.0],)], "e array<double>")
    density = np.exp(-((x[:, None] - x[None]) ** 2).sum(2) / 2 / 0.49) / ((2 * math.pi) ** 0.5 * 0.7) ** 3
    assert joins.renyi_entropy(df, "e", 0.7).first()["entropy"] == pytest.approx(-math.log(density.mean()), abs=1e-12)
    assert joins.renyi_entropy(df.where(F.lit(False)), "e", 0.7).first()["entropy"] is None


def test_generalised_least_squares_over_a_frame(spark):
    """A full covariance matrix in cells gives what the dense solution gives."""
    from lodestone.operators import linalg
    from lodestone.plans import glm

    rng = np.random.default_rng(5)
    x, y, root = rng.normal(size=30), rng.normal(size=30) * 100, rng.normal(size=(30, 30))
    omega = root @ root.T / 30 + np.eye(30)
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "i long, x double, y double")
    got = glm.generalised_least_squares_of(df, [F.col("x")], F.col("y"), "i", linalg.from_numpy(spark, omega)).weights
    assert got == pytest.approx(glm.generalised_least_squares(np.column_stack([x, np.ones(30)]), y, omega), rel=1e-9)


def test_labelled_figures_leave_texts_where_they_are(spark):
    """No text moves to the labels, and none is read again by the steps of a model."""
    from lodestone.queries.learning import quality
    from lodestone.queries.registry import Tables

    files = quality(Tables(spark, "/root/testdata/sf0.001")).inputFiles()
    assert not any(f.endswith("documents.parquet") for f in files)


def test_dense_kernel_matrix_in_chunks(spark, monkeypatch):
    from lodestone.functions import kernels
    from lodestone.plans import gram

    monkeypatch.setattr(kernels, "CHUNK", 1000)
    x = np.random.default_rng(6).normal(size=(70, 3))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")
    got = {(r["i"], r["j"]): r["v"] for r in kernels.dense_matrix(df, gram.kernel("rbf", b=2.0)).collect()}
    assert len(got) == 4900
    assert all(abs(v - math.exp(-((x[i] - x[j]) ** 2).sum() / 8)) < 1e-12 for (i, j), v in got.items())


def test_models_of_distinct_points(spark):
    """Repeated rows count as they do in the whole matrices, though only their distinct points are gathered."""
    from lodestone.plans import gram, models, processes

    rng = np.random.default_rng(7)
    points = rng.normal(size=(6, 2))
    x = points[rng.integers(0, 6, 40)]
    y = rng.normal(size=40)
    df = spark.createDataFrame([(a.tolist(), float(b)) for a, b in zip(x, y, strict=True)], "features array<double>, target double")
    z, means, counts, scatter = processes.gather_distinct(df)
    k, noise = gram.kernel("rbf", b=0.5), gram.kernel("dirac", noise=0.5)
    whole = k(x, x) + noise(x, x) + 1.5e-8 * np.eye(40)
    p = processes.GaussianProcess(k, noise, z, means, counts=counts, scatter=scatter)
    inverse = np.linalg.inv(whole)
    assert p.quadratic() == pytest.approx(y @ inverse @ y, rel=1e-5)
    assert p.half_log_determinant() == pytest.approx(np.linalg.slogdet(whole)[1] / 2, rel=1e-6)
    svm = processes.LeastSquaresSVM(k, x, y).posterior(points)[0]
    assert processes.LeastSquaresSVM(k, z, means, counts=counts).posterior(points)[0] == pytest.approx(svm, abs=1e-9)
    assert len(processes.gather_distinct(df, most=6)[0]) == 6
    with pytest.raises(ValueError):
        processes.gather_distinct(df, most=5)
    assert models.model_pipe("process", kernel=k, noise=noise).train(df).predict(df).count() == 40


def test_support_vectors_of_a_large_group(spark, monkeypatch):
    """More rows than are solved densely: through features, or from all pairs, the dense answers."""
    from lodestone.plans import gram, large, processes

    rng = np.random.default_rng(6)
    kernel = gram.kernel("rbf", b=0.8)
    rows = [("a" if i % 4 else None, i, [float(a), float(b)], float(np.sign(a + b - 1)), bool(i % 5)) for i, (a, b) in enumerate(rng.random((400, 2)).round(1))]
    rows += [("b", 400 + i, [0.1 * i, 1.0], float(i % 2), True) for i in range(9)]
    df = spark.createDataFrame(rows, "g string, id long, features array<double>, target double, train boolean")
    make = lambda x, y: processes.LeastSquaresSVM(kernel, x, y, 2.5)
    ask = lambda d: {r["id"]: r["score"] for r in d.collect()}
    expected = ask(processes.predict_by_group(df, "g", ["id"], make, ("score",), train="train"))
    got = lambda: ask(large.support_vectors_by_group(df, "g", ["id"], kernel, 2.5, train="train", most=50))
    assert got() == pytest.approx(expected, abs=1e-9)
    monkeypatch.setattr(large, "features_of", lambda *_: None)
    monkeypatch.setattr(large, "TILE", 32)
    assert got() == pytest.approx(expected, abs=1e-9)


def test_features_leave_nothing_of_any_row(spark):
    from lodestone.plans import gram, large

    x = np.random.default_rng(7).random((3000, 2)) * 3
    df = spark.createDataFrame([(v,) for v in x.tolist()], "features array<double>").repartition(7)
    kernel = gram.kernel("rbf", b=1.0)
    of = large.features_of(df, kernel)
    assert len(of.x) < 300 and np.abs(of(x[:500]).T @ of(x[-500:]) - kernel(x[:500], x[-500:])).max() < 1e-12
    assert large.features_of(df, gram.kernel("laplacian", beta=1.0), most=40) is None


def test_process_mean_of_all_pairs(spark, monkeypatch):
    """More points than are solved densely give the dense process's means, with and without repeats."""
    from lodestone.plans import gram, large, processes

    monkeypatch.setattr(large, "TILE", 64)
    kernel, noise = gram.plus(gram.kernel("fbm", hurst=0.55), gram.kernel("laplacian", beta=2.5)), gram.kernel("dirac", noise=0.5)
    for digits in (9, 1):
        rng = np.random.default_rng(8)
        x = rng.normal(size=(300, 2)).round(digits)
        y = np.sin(x.sum(1)) + rng.normal(size=300)
        df = spark.createDataFrame([(a, float(b)) for a, b in zip(x.tolist(), y, strict=True)], "features array<double>, target double")
        z = rng.normal(size=(40, 2))
        monkeypatch.setattr(large, "DENSE", 1000)
        dense = large.process_mean(df, kernel, noise).posterior(z)[0]
        monkeypatch.setattr(large, "DENSE", 20)
        assert large.process_mean(df, kernel, noise).posterior(z)[0] == pytest.approx(dense, abs=1e-8)
        if digits == 9:
            assert dense == pytest.approx(processes.GaussianProcess(kernel, noise, x, y).posterior(z)[0], abs=1e-9)


def test_sums_over_points_of_the_plane():
    """Without all pairs, what the kernel's matrix gives: between points, on them, and far outside."""
    from lodestone.plans import gram, sums

    rng = np.random.default_rng(9)
    x = np.unique(rng.exponential(size=(3000, 2)).round(2), axis=0)
    v = rng.normal(size=len(x))
    z = np.vstack([x[:200], rng.exponential(size=(200, 2)), [[-3.0, 1.0], [50.0, 50.0]]])
    kernel = gram.plus(gram.kernel("fbm", hurst=0.55), gram.kernel("laplacian", beta=2.5))
    of = sums.sums_of(kernel, x)
    assert of.holds() and sums.Answers(of, v).posterior(z)[0] == pytest.approx(kernel(z, x) @ v, abs=1e-8)
    assert sums.sums_of(gram.plus(kernel, gram.kernel("rbf", b=1.0)), x) is None and sums.sums_of(kernel, np.column_stack([x, x[:, 0]])) is None
    assert sums.sums_of(gram.plus(kernel, gram.kernel("dirac", noise=0.5)), np.vstack([x, x[:1] + 1e-12])) is None


def test_process_mean_without_all_pairs(spark, monkeypatch):
    """Known kernels go by sums, others by tiles; both give the dense means."""
    from lodestone.plans import gram, large, sums

    kernel, noise = gram.plus(gram.kernel("fbm", hurst=0.55), gram.kernel("laplacian", beta=2.5)), gram.kernel("dirac", noise=0.5)
    x = np.random.default_rng(10).normal(size=(600, 2)).round(2)
    rows = [(a, float(np.sin(sum(a)) + i % 3)) for i, a in enumerate(x.tolist())]
    df = spark.createDataFrame(rows, "features array<double>, target double").repartition(3)
    ask = lambda m: [r["mean"] for r in large.predict_means(df, m).orderBy("features", "target").collect()]
    dense = ask(large.process_mean(df, kernel, noise))
    monkeypatch.setattr(large, "DENSE", 20)
    monkeypatch.setattr(large, "ROWS", 70)
    products = large._products
    monkeypatch.setattr(large, "_products", lambda *_: pytest.fail("all pairs"))
    assert ask(large.process_mean(df, kernel, noise)) == pytest.approx(dense, abs=1e-8)
    monkeypatch.setattr(large, "_products", products)
    monkeypatch.setattr(sums, "sums_of", lambda *_: None)
    assert ask(large.process_mean(df, kernel, noise)) == pytest.approx(dense, abs=1e-8)


def test_dense_kernel_matrix_by_values(spark, monkeypatch):
    """Cuts deal the cells to branches, each once, what is no number too."""
    from lodestone.functions import kernels

    monkeypatch.setattr(kernels, "CHUNK", 1000)
    monkeypatch.setattr(kernels, "COLUMNS", 16)
    monkeypatch.setattr(kernels, "FIRST", 40)
    x = np.random.default_rng(11).normal(size=(150, 3))
    x[7] = np.nan
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")
    ask = lambda **k: sorted((r["i"], r["j"], repr(r["v"])) for r in kernels.dense_matrix(df, lambda a, b: np.floor(a @ b.T), **k).collect())
    got = ask(cuts=(-1.0, 0.0, 2.0))
    assert got == ask() and len(got) == len({(i, j) for i, j, _ in got}) == 150**2 and sum(v == "nan" for _, _, v in got) == 299


def test_kernel_matrix_takes_little_disk(spark, tmp_path):
    """Values of six digits go to dictionaries: 8 bytes each before."""
    import pyarrow.parquet as pq

    from lodestone import queries as library

    v = np.random.default_rng(12).normal(size=(4000, 64)) / 8
    spark.createDataFrame([(i, a.tolist()) for i, a in enumerate(v)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    library.QUERIES["N27_kernel_matrix"](spark, str(tmp_path)).write.parquet(f"{tmp_path}/out")
    groups = [m.row_group(k) for m in (pq.ParquetFile(f).metadata for f in (tmp_path / "out").glob("*.parquet")) for k in range(m.num_row_groups)]
    assert sum(g.num_rows for g in groups) == 4000**2 and sum(g.column(2).total_compressed_size for g in groups) < 5 * 4000**2
