"""Queries over the remaining operators of the inventory."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.functions import bases, kernels, scalar
from lodestone.functions import distributions as dist
from lodestone.operators import linalg, metrics, ordered, pipes, scalers, stats
from lodestone.plans import glm, gram, large, processes, sequences, tuning
from lodestone.queries.learning import KALMAN, answers, process_energy, quality, series
from lodestone.queries.library import X, register, x
from lodestone.queries.registry import Tables, query
from lodestone.queries.statistics import METRICS, rounded, rounded_items, rounded_metrics, scores
from lodestone.session import durable, new_path
from lodestone.sources import binary, feeds, text

# -- sources -----------------------------------------------------------------------------------------


def put(t: Tables, name: str, data: bytes) -> str:
    """A small file in the shared folder, written through Spark's own file system."""
    path = f"{new_path(t.spark, 'file')}/{name}"
    jvm, conf = t.spark._jvm, t.spark._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(conf).create(target, True)
    out.write(bytearray(data))
    out.close()
    return path


@query("S5_mat", "SELECT 'm' AS name, CAST(2 AS INTEGER) AS rows, CAST(3 AS INTEGER) AS columns, [0.0, 3.0, 1.0, 4.0, 2.0, 5.0]::DOUBLE[] AS data")
def _(t: Tables):
    return binary.read_mat(t.spark, put(t, "a.mat", binary.mat_bytes({"m": np.arange(6.0).reshape(2, 3)}))).select("name", "rows", "columns", "data")


@query("S10_images", "SELECT CAST(2 AS INTEGER) AS height, CAST(2 AS INTEGER) AS width, CAST(1 AS INTEGER) AS channels, '0A14' AS pixels")
def _(t: Tables):
    path = put(t, "a.pgm", b"P5\n4 4\n255\n" + bytes([10, 10, 20, 20] * 4))
    d = binary.read_images(t.spark, path, (2, 2))
    return d.select("height", "width", "channels", F.hex(F.substring("pixels", 1, 2)).alias("pixels"))


@query("S11_image_patch", "SELECT '0506090A' AS patch")
def _(t: Tables):
    d = binary.read_images(t.spark, put(t, "b.pgm", b"P5\n4 4\n255\n" + bytes(range(16))))
    return d.select(F.hex(binary.patch(F.col("pixels"), F.col("width"), F.col("channels"), 1, 1, 2, 2)).alias("patch"))


@query("S12_gzip", "SELECT n_name AS value FROM nation")
def _(t: Tables):
    path = new_path(t.spark, "gz")
    t.nation.select(F.col("n_name").alias("value")).write.option("compression", "gzip").text(path)
    return text.lines(t.spark, path).select("value")


@query("S16_feed", "SELECT n_name, n_regionkey, CAST(least(10, 25 - 10 * floor(b / 10)) AS BIGINT) AS size FROM (SELECT *, row_number() OVER (ORDER BY n_nationkey) - 1 AS b FROM nation)")
def _(t: Tables):
    rows = [(*r, len(b)) for b in feeds.feed(t.nation.orderBy("n_nationkey").select("n_name", "n_regionkey"), 10) for r in b]
    return t.spark.createDataFrame(rows, "n_name string, n_regionkey int, size long")


@query("S18_shuffle", "SELECT n_nationkey FROM nation")
def _(t: Tables):
    return feeds.shuffle(t.nation.select("n_nationkey"), 7)


# -- pipes ---------------------------------------------------------------------------------------------


@query("P6_then_basis", f"SELECT event_id, [round(v, 6) for v in [1.0, 2 * x, 4 * x * x]] AS phi FROM {X}")
def _(t: Tables):
    p = pipes.Pipe(lambda c: c * 2) >> bases.polynomial(2) >> rounded_items
    return x(t).select("event_id", p(F.col("x")).alias("phi"))


@query("P7_side_effect", "SELECT n_name, (SELECT sum(n_nationkey) FROM nation)::BIGINT AS seen FROM nation")
def _(t: Tables):
    seen = []
    out = pipes.side_effect(lambda d: seen.append(d.agg(F.sum("n_nationkey")).first()[0]))(t.nation)
    return out.select("n_name", F.lit(seen[0]).cast("long").alias("seen"))


@query("P23_duplicate", "SELECT upper(r_name) AS v FROM region UNION ALL SELECT upper(n_name) FROM nation")
def _(t: Tables):
    a, b = pipes.duplicate(pipes.mapped(v=F.upper("v")))((t.region.select(F.col("r_name").alias("v")), t.nation.select(F.col("n_name").alias("v"))))
    return a.union(b)


@query("P25_map_flat_map", "SELECT n_nationkey, CAST(i AS INTEGER) AS i FROM nation, range(3) r(i)")
def _(t: Tables):
    return pipes.flat_mapped(F.array(F.lit(0), F.lit(1), F.lit(2)), "i")(t.nation.select("n_nationkey"))


RIDGE = """
    WITH g AS (SELECT sum(x * x) + 1 AS a, sum(x) AS b, count(*) + 1 AS c, sum(x * y) AS p, sum(y) AS q FROM (SELECT l_quantity / 50 AS x, l_extendedprice AS y FROM lineitem))
    SELECT l_orderkey, l_linenumber, round((c * p - b * q) / (a * c - b * b) * l_quantity / 50 + (a * q - b * p) / (a * c - b * b), 2) AS score FROM lineitem, g"""


@query("P31_model_pipe", RIDGE)
def _(t: Tables):
    fit = lambda d: glm.ridge(d, [F.col("x")], F.col("l_extendedprice"))
    m = pipes.ModelPipe(fit, pipes.mapped(x=F.col("l_quantity") / 50), lambda d: d.where("score is not null")).train(t.lineitem)
    return rounded(m.predict(t.lineitem).select("l_orderkey", "l_linenumber", "score"), 2)


# -- aggregates, metrics -------------------------------------------------------------------------------


@query("A8_vector_sum", "SELECT CAST(d AS INTEGER) AS index, round(sum(x), 5) AS v FROM (SELECT unnest(range(64)) AS d, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) GROUP BY d")
def _(t: Tables):
    s = feeds.slices(t.embeddings.select(F.col("embedding").cast("array<double>").alias("e")), "e", "x")
    return s.groupBy("index").agg(F.round(F.sum("x"), 5).alias("v"))


@query("A10_group_to_block", "SELECT n_regionkey, list(n_nationkey ORDER BY n_nationkey) AS block FROM nation GROUP BY n_regionkey")
def _(t: Tables):
    return t.nation.groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_nationkey")).alias("block"))


@query("A18_named_regression", "SELECT round(regr_slope(l_tax, l_discount), 5) AS slope FROM lineitem")
def _(t: Tables):
    w = glm.least_squares(t.lineitem, [F.col("l_discount")], F.col("l_tax")).weights
    return t.spark.createDataFrame([(round(float(w[0]), 5),)], "slope double")


@query("A19_entropies", "SELECT round(avg(x * x / 2 + ln(2 * pi()) / 2), 5) AS entropy, round(avg(-x * x / 2 + (x - 1) * (x - 1) / 2), 5) AS kl FROM (SELECT sin(value) AS x FROM events)")
def _(t: Tables):
    p, q = dist.log_gaussian(F.sin("value"), 0.0, 1.0), dist.log_gaussian(F.sin("value"), 1.0, 1.0)
    return rounded(t.events.agg(F.avg(-p).alias("entropy"), F.avg(p - q).alias("kl")), 5)


@query("E23_task_dispatch", METRICS)
def _(t: Tables):
    return rounded_metrics(metrics.metrics_for("regression")(scores(t)))


@query("W10_neighbour_areas", "SELECT round(sum((l_quantity - p) * (c + n) / 2), 2) AS area FROM (SELECT l_quantity, n, lag(l_quantity) OVER (ORDER BY l_quantity) AS p, lag(n) OVER (ORDER BY l_quantity) AS c FROM (SELECT l_quantity, count(*) AS n FROM lineitem GROUP BY 1))")
def _(t: Tables):
    curve = t.lineitem.groupBy("l_quantity").agg(F.count("*").alias("n"))
    return rounded(metrics.area_under(curve, "l_quantity", "n"), 2)


@query("W15_ranking", "SELECT event_id, ntile(4) OVER w AS quarter, dense_rank() OVER w AS place FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def _(t: Tables):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return t.events.select("event_id", F.ntile(4).over(w).cast("long").alias("quarter"), F.dense_rank().over(w).cast("long").alias("place"))


PATH = KALMAN.replace("value / 100 AS v", "event_id, value / 100 AS v")
PATH = PATH[: PATH.rindex("SELECT user_id")] + "SELECT event_id, user_id, round(m, 6) AS mean, round(c, 6) AS variance FROM f JOIN e USING (user_id, k)"


@query("W13_kalman_path", PATH)
def _(t: Tables):
    e = t.events.withColumn("v", F.col("value") / 100)
    return rounded(sequences.kalman_path(e, ["user_id"], ["ts", "event_id"], "v", 0.1, 0.5, block=16).drop("ts"))


@query("U4_scaler_concatenation", "SELECT event_id, round((value - 1) / 2, 6) AS a, round((value - 3) / 4, 6) AS b FROM events")
def _(t: Tables):
    s = scalers.gaussian([1.0] + [3.0], [2.0] + [4.0])
    d = s.apply(t.events.select("event_id", F.array("value", "value").alias("v")), "v")
    return rounded(d.select("event_id", F.col("v")[0].alias("a"), F.col("v")[1].alias("b")))


@query("L14_quadratic_form", "SELECT round(sum(a.v * g.v * b.v), 3) AS v FROM (SELECT i, j, sum(p.e[i + 1] * p.e[j + 1]) AS v FROM (SELECT CAST(embedding AS DOUBLE[]) AS e FROM embeddings) p, range(64) r(i), range(64) s(j) GROUP BY i, j) g JOIN (SELECT i, i + 1.0 AS v FROM range(64) r(i)) a ON a.i = g.i JOIN (SELECT i, i + 1.0 AS v FROM range(64) r(i)) b ON b.i = g.j")
def _(t: Tables):
    g = linalg.to_numpy(linalg.gram_of(t.embeddings, "embedding", 64))
    return t.spark.createDataFrame([(round(linalg.quadratic_form(g, np.arange(1.0, 65.0)), 3),)], "v double")


@query("L11_triangular_solve", "SELECT CAST(i AS INTEGER) AS i, 2.0::DOUBLE AS v FROM range(3) r(i)")
def _(t: Tables):
    v = linalg.solve(np.diag([1.0, 2, 4]), np.array([2.0, 4, 8]))
    return t.spark.createDataFrame([(i, float(a)) for i, a in enumerate(v)], "i int, v double")


@query("L16_persist", "SELECT n_regionkey, sum(n_nationkey)::BIGINT AS total FROM nation GROUP BY 1")
def _(t: Tables):
    return linalg.persist(t.nation).groupBy("n_regionkey").agg(F.sum("n_nationkey").alias("total"))


# -- kernels, bases ---------------------------------------------------------------------------------------

HAAR = "list_product([CASE WHEN abs(p) / 2 < 0.5 THEN 1 WHEN abs(p) / 2 < 1 THEN -1 ELSE 0 END for p in dl])"
SPLINE = "list_product([CASE WHEN u < 0.5 THEN 1 - 6 * u * u + 6 * u * u * u WHEN u < 1 THEN 2 * pow(1 - u, 3) ELSE 0 END for u in [abs(p) / 9 for p in dl]])"
for _name, _kernel, _sql in (
    ("N13_wavelet", kernels.wavelet(bases.haar_mother, 2.0), HAAR),
    ("N14_anova", kernels.anova(0.5, 1.0, 2.0), "list_sum([exp(-p * p) for p in dl])"),
    ("N17_neural", kernels.neural([1.0] * 33), "2 / pi() * asin(2 * (d + 1) / sqrt((1 + 2 * (xx + 1)) * (1 + 2 * (yy + 1))))"),
    ("N21_cubic_spline", kernels.cubic_spline(9.0), SPLINE),
    ("N22_spectral", kernels.gaussian_spectral([0.1] * 32, [0.05] * 32), "cos(2 * pi() * 0.1 * list_sum(dl)) * exp(-2 * pi() * pi() * 0.0025 * s2)"),
    ("N25_separable", kernels.separable(kernels.norm2), "xx * yy"),
    ("N25_decomposed", kernels.decomposed([(0, 32)], kernels.rbf(2.0)), "exp(-s2 / 8)"),
    ("N25_locally_stationary", kernels.locally_stationary(kernels.rbf(2.0), kernels.norm2), "exp(-s2 / 8) * (xx + yy + 2 * d) / 4"),
    ("N20_matern_ard", kernels.matern_ard([2.0] * 32, 1), "(1 + sqrt(3) * sqrt(s2) / 2) * exp(-sqrt(3) * sqrt(s2) / 2)"),
    ("N26_laplacian_gradient", kernels.GRADIENTS["laplacian"](3.0)["beta"], "exp(-s1 / 3) * s1 / 9"),
    ("N26_cauchy_gradient", kernels.GRADIENTS["cauchy"](2.0)["sigma"], "2 * s2 / 8 / pow(1 + s2 / 4, 2)"),
):
    register(_name, _kernel, _sql)


@query("N4_scalar_and_tasks", "SELECT n_nationkey, round(exp(-pow(n_regionkey - 2, 2) / 3), 6) AS k, round(1 - pow(n_regionkey - 2, 2) / (pow(n_regionkey - 2, 2) + 5), 6) AS r FROM nation")
def _(t: Tables):
    a = F.col("n_regionkey").cast("double")
    return rounded(t.nation.select("n_nationkey", kernels.coregional_rbf(3.0)(a, F.lit(2.0)).alias("k"), kernels.rational_scalar(5.0)(a, F.lit(2.0)).alias("r")))


@query("N24_graph", "SELECT n_nationkey, CASE WHEN n_regionkey = n_nationkey % 5 THEN 2.0 ELSE -0.5 END::DOUBLE AS k FROM nation")
def _(t: Tables):
    g = np.full((5, 5), -0.5) + 2.5 * np.eye(5)
    return t.nation.select("n_nationkey", kernels.graph(g)(F.col("n_regionkey"), F.col("n_nationkey") % 5).alias("k"))


@query("N28_nystroem", """
    SELECT vec_id, round(exp(-list_sum([pow(z[1] - z[2], 2) for z in list_zip(CAST(embedding AS DOUBLE[]), o)]) / 128), 6) AS k
    FROM embeddings, (SELECT CAST(embedding AS DOUBLE[]) AS o FROM embeddings ORDER BY vec_id LIMIT 1)""")
def _(t: Tables):
    """Features kᵀV/√λ of five landmarks, as array expressions: a vector's and a landmark's give their kernel."""
    e = F.col("embedding").cast("array<double>")
    marks = [r["v"] for r in ordered.take(t.embeddings, 5, ["vec_id"]).select(e.alias("v")).collect()]
    k = gram.kernel("rbf", b=8.0)(np.array(marks), np.array(marks))
    values, vectors = np.linalg.eigh(k)
    maps = (vectors / np.sqrt(np.maximum(values, 1e-12))).T
    row = F.array(*(kernels.rbf(8.0)(e, F.array(*map(F.lit, m))) for m in marks))
    first = maps @ k[0]
    return rounded(t.embeddings.select("vec_id", F.aggregate(F.zip_with(scalers.linear(maps, row), F.array(*(F.lit(float(v)) for v in first)), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v).alias("k")))


@query("C3_univariate_scaler", "SELECT event_id, round((value - 5) / 3, 6) AS z FROM events")
def _(t: Tables):
    return rounded(scalers.univariate_gaussian(5.0, 3.0).apply(t.events.select("event_id", F.col("value").alias("z")), "z"))


@query("C13_composed_encoders", "SELECT n_nationkey, [n_regionkey, n_nationkey % 7, n_regionkey, n_nationkey % 7] AS v FROM nation")
def _(t: Tables):
    e = scalers.mixed_radix([5, 7]) >> scalers.replicate(2)
    digits = F.array("n_regionkey", F.col("n_nationkey") % 7)
    code = e.encode(digits)
    back = scalers.mixed_radix([5, 7]).decode
    return t.nation.select("n_nationkey", F.flatten(F.array(e.decode(code), back(code[1]))).alias("v"))


@query("F29_matrix_predicates", """
    WITH c AS (SELECT vec_id AS i, CAST(d AS BIGINT) AS j, CAST(embedding[d + 1] AS DOUBLE) AS v FROM embeddings, range(64) r(d)),
    g AS (SELECT a.j AS i, b.j, sum(a.v * b.v) AS v FROM c a JOIN c b ON a.i = b.i GROUP BY a.j, b.j)
    SELECT 'gram' AS matrix, (SELECT max(i) = max(j) FROM g) AS square, (SELECT max(abs(a.v - b.v)) < 1e-6 FROM g a JOIN g b ON a.i = b.j AND a.j = b.i) AS symmetric
    UNION ALL SELECT 'rows', (SELECT max(i) = max(j) FROM c), (SELECT count(*) = 0 FROM c a JOIN c b ON a.i = b.j AND a.j = b.i WHERE abs(a.v - b.v) > 1e-9)""")
def _(t: Tables):
    rows = t.embeddings.select(F.col("vec_id").alias("i"), F.posexplode("embedding").alias("j", "v")).select("i", F.col("j").cast("long").alias("j"), F.col("v").cast("double").alias("v"))
    tell = lambda name, a: (name, linalg.is_square(a), linalg.is_symmetric(a, 1e-6))
    return t.spark.createDataFrame([tell("gram", linalg.gram_of(t.embeddings, "embedding", 64)), tell("rows", rows)], "matrix string, square boolean, symmetric boolean")


@query("F18_activation_names", f"SELECT event_id, round(x, 6) AS linear FROM {X}")
def _(t: Tables):
    return rounded(x(t).select("event_id", scalar.activation("Linear")(F.col("x")).alias("linear")))


# -- models ------------------------------------------------------------------------------------------------


@query("M7_model_by_name", RIDGE.replace("l_quantity / 50", "l_quantity"))
def _(t: Tables):
    m = glm.model_for("regression")(t.lineitem, [F.col("l_quantity")], F.col("l_extendedprice"))
    return rounded(m.predict(t.lineitem).select("l_orderkey", "l_linenumber", "score"), 2)


def rbf_process(x, y, width=0.5, kind=processes.GaussianProcess, **more):
    return kind(gram.kernel("rbf", b=width), gram.kernel("dirac", noise=0.5), x, y, **more)


@query("M11_warped_process")
def _(t: Tables):
    """Targets warped by ln(1 + |y|): the middle and the bars come back in the targets' own units."""
    make = lambda x, y: processes.Warped.fit(rbf_process(x, y), lambda v: np.log1p(np.abs(v)), np.expm1, lambda v: 1 / (1 + np.abs(v)))
    return answers(t, make, ("mid", "low", "high"), lambda m, z: m.bars(z))


@query("M13_matrix_t")
def _(t: Tables):
    make = lambda x, y: processes.MatrixT(gram.kernel("rbf", b=0.5), gram.kernel("dirac", noise=0.5), x, np.column_stack([y, 2 * y]))

    def say(m, z):
        means, _, dof = m.predict(z)
        return *means.T, np.full(len(z), float(dof))

    return answers(t, make, ("first", "second", "dof"), say)


@query("M14_skew_process")
def _(t: Tables):
    return answers(t, lambda x, y: rbf_process(x, y, kind=processes.SkewProcess, skew=0.5), ("mean", "variance", "skew"), lambda m, z: m.predict(z)[:3])


@query("M15_M25_mixture")
def _(t: Tables):
    def say(ps, z):
        means, variances = (np.array(v) for v in zip(*(p.posterior(z) for p in ps), strict=True))
        return processes.mixture_moments(means, variances, processes.energy_weights(np.array([p.energy() for p in ps])))

    return answers(t, lambda x, y: [rbf_process(x, y, w) for w in (0.3, 0.6, 1.2)], ("mean", "variance"), say)


@query("M18_M19_losses_and_updates")
def _(t: Tables):
    rows = []
    for name, loss, update in (("squared", glm.squared, glm.simple), ("hinge", glm.hinge, glm.l1), ("logistic", glm.logistic, glm.l2)):
        y = 2 * F.col("y") - 1 if name == "hinge" else F.col("y")
        m = glm.gradient_descent(quality(t), [F.col("a")], y, loss, update, glm.Options(0.001, 5, 1.0, 0.5))
        rows.append((name, bool(m.history[-1] <= m.history[0])))
    return t.spark.createDataFrame(rows, "loss string, falls boolean")


@query("M26_tuned_process")
def _(t: Tables):
    c, e = tuning.best(tuning.landscape_by_group(series(t), "user_id", tuning.grid({"b": 2.0}, 0.4, 4), process_energy))
    return t.spark.createDataFrame([(round(c["b"], 6), round(e, 3))], "b double, energy double")


@query("EX1_process_regression")
def _(t: Tables):
    """Scale on the training rows, fit a process, predict the rest, evaluate."""
    split = durable(ordered.split_by_share(durable(series(t).select("event_id", "features", "target"), "series"), 0.02, ["event_id"]).select("features", "target", "split"), "split").withColumn("y", F.array("target"))
    scaled, fitted = scalers.fit_split(split, ["features", "y"], "gaussian")
    train = scaled.where("split = 'train'").select("features", F.col("y")[0].alias("target"))
    m = large.process_mean(train, gram.plus(gram.kernel("fbm", hurst=0.55), gram.kernel("laplacian", beta=2.5)), gram.kernel("dirac", noise=0.5))
    test = large.predict_means(large.spread(scaled.where("split = 'test'").select("features", "target")), m)
    back = fitted["y"].backward(F.array("mean"))[0]
    return rounded(metrics.regression_metrics(test.select(back.alias("score"), F.col("target").alias("label"))))


@query("EX10_logistic_quality")
def _(t: Tables):
    d = quality(t)
    m = glm.logistic_model(d, [F.col("a"), F.col("b")], F.col("y"), glm.Options(0.001, 10, 1.0, 2.0))
    s = m.predict(d).select("score", F.col("y").cast("int").alias("label"))
    return rounded(metrics.binary_kpi(s, metrics.thresholds(s)))


@query("R10_prior", "SELECT event_id, round(-x * x / 2 - ln(2 * pi()) / 2 - abs(x) - ln(2), 6) AS log_prior FROM (SELECT event_id, sin(value) AS x FROM events)")
def _(t: Tables):
    c = F.sin("value")
    return rounded(t.events.select("event_id", (dist.log_gaussian(c, 0.0, 1.0) + dist.log_laplace(c, 0.0, 1.0)).alias("log_prior")))


@query("A14_default_bins", "SELECT CAST(floor(sqrt(count(DISTINCT l_quantity))) AS INTEGER) AS bins FROM lineitem")
def _(t: Tables):
    return t.spark.createDataFrame([(stats.default_bins(t.lineitem, "l_quantity"),)], "bins int")
