"""Queries over named models, layers, draws and recursions, and worked examples from source to metrics."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lodestone.functions import distributions as dist
from lodestone.functions import kernels, scalar
from lodestone.operators import metrics, ordered, pipes, scalers
from lodestone.plans import fields, glm, gram, large, models, nets, processes, tuning
from lodestone.queries.learning import BY, name, process_energy, quality, series, stream
from lodestone.queries.library import X, x
from lodestone.queries.more import RIDGE
from lodestone.queries.registry import Tables, query
from lodestone.queries.statistics import rounded, rounded_items, rounded_metrics
from lodestone.session import durable, new_path
from lodestone.sources import feeds, text
from lodestone.streaming import tables as streams

# -- scaling, pipes, sources -----------------------------------------------------------------------


@query("C11_standardisation", """
    SELECT l_orderkey, l_linenumber, round((l_quantity - m) / s, 6) AS f, round((l_extendedprice - lo) / (hi - lo), 6) AS t
    FROM lineitem, (SELECT avg(l_quantity) AS m, stddev_samp(l_quantity) AS s, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem)""")
def _(t: Tables):
    d = t.lineitem.select("l_orderkey", "l_linenumber", F.array("l_quantity").alias("f"), F.array("l_extendedprice").alias("t"))
    scaled, _ = scalers.standardise(d, "f", "t", ("gaussian", "minmax"))
    return rounded(scaled.select("l_orderkey", "l_linenumber", F.col("f")[0].alias("f"), F.col("t")[0].alias("t")))


@query("C11_inverse", "SELECT l_orderkey, l_linenumber, round(l_quantity, 6) AS f, round(l_extendedprice, 6) AS t FROM lineitem")
def _(t: Tables):
    d = t.lineitem.select("l_orderkey", "l_linenumber", F.array("l_quantity").alias("f"), F.array("l_extendedprice").alias("t"))
    scaled, (f, y) = scalers.standardise(d, "f", "t", ("minmax", "gaussian"))
    back = y.invert(f.invert(scaled, "f"), "t")
    return rounded(back.select("l_orderkey", "l_linenumber", F.col("f")[0].alias("f"), F.col("t")[0].alias("t")))


@query("P15_foreach", "SELECT n_regionkey, sum(n_nationkey)::BIGINT AS total, (SELECT sum(n_nationkey) FROM nation)::BIGINT AS seen FROM nation GROUP BY 1")
def _(t: Tables):
    seen = t.spark.sparkContext.accumulator(0)
    out = pipes.foreach(lambda r: seen.add(r["n_nationkey"]))(t.nation)
    return out.groupBy("n_regionkey").agg(F.sum("n_nationkey").alias("total")).withColumn("seen", F.lit(seen.value).cast("long"))


@query("P16_rows_and_back", "SELECT n_nationkey, n_name FROM nation")
def _(t: Tables):
    return (pipes.to_rows() >> pipes.to_frame(t.spark, "n_nationkey int, n_name string"))(t.nation.select("n_nationkey", "n_name"))


@query("F31_json", "SELECT event_id, event_type, value FROM events")
def _(t: Tables):
    lines = t.events.select(text.json_rows(t.events.select("event_id", "event_type", "value")).alias("value"))
    return text.parse_json(lines, "event_id long, event_type string, value double")


@query("F4_replaced_lines", "SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS pos, replace(n_name, 'A', '-') AS value FROM nation")
def _(t: Tables):
    path = new_path(t.spark, "lines")
    t.nation.orderBy("n_nationkey").coalesce(1).select(F.col("n_name").alias("value")).write.text(path)
    return text.replaced_lines(t.spark, path, "A", "-")


@query("B6_divisors", "SELECT o_orderkey, o_custkey, gcd(o_orderkey, o_custkey)::BIGINT AS g, lcm(o_orderkey, o_custkey)::BIGINT AS l FROM orders")
def _(t: Tables):
    a, b = F.col("o_orderkey"), F.col("o_custkey")
    return t.orders.select("o_orderkey", "o_custkey", scalar.gcd(a, b).alias("g"), scalar.lcm(a, b).alias("l"))


@query("X6_batch_function", f"SELECT event_id, round(exp(-x * x) * cos(3 * x), 6) AS y FROM {X}")
def _(t: Tables):
    """A NumPy function over Arrow batches, where no expression would do."""
    def run(frames):
        for batch in frames:
            v = batch.column(1).to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.exp(-(v**2)) * np.cos(3 * v))], ["event_id", "y"])

    return rounded(pipes.batchwise(run, "event_id long, y double")(x(t).select("event_id", "x")))


@query("X2_unfold", "WITH RECURSIVE r AS (SELECT 0 AS k, 0.3::DOUBLE AS value UNION ALL SELECT k + 1, 2.5 * value * (1 - value) FROM r WHERE k < 199) SELECT k, round(value, 6) AS value FROM r")
def _(t: Tables):
    return rounded(feeds.unfold(t.spark, 0.3, lambda v: 2.5 * v * (1 - v), 200))


# -- draws -----------------------------------------------------------------------------------------


@query("R2_iid_and_joint", "SELECT true AS size, true AS iid_mean, true AS iid_uncorrelated, true AS joint_mean, true AS joint_slope")
def _(t: Tables):
    d = dist.joint(t.spark, 40_000, {"theta": dist.gaussian(2.0, 1.0, 7)}, lambda p: {"y": 3.0 * p["theta"] + F.randn(8), "z": dist.iid(lambda s: dist.uniform(0.0, 2.0, s), 4, 9)})
    z = lambda i: F.col("z")[i]
    return durable(d, "draws").agg(
        (F.min(F.size("z")) == 4).alias("size"), (F.abs(F.avg(z(0) + z(1) + z(2) + z(3)) - 4) < 0.05).alias("iid_mean"), (F.abs(F.corr(z(0), z(3))) < 0.03).alias("iid_uncorrelated"),
        (F.abs(F.avg("y") - 6) < 0.06).alias("joint_mean"), (F.abs(F.regr_slope("y", "theta") - 3) < 0.03).alias("joint_slope"),
    )


@query("R3_matrix_draws", "SELECT true AS binomial, true AS mean, true AS rows, true AS columns")
def _(t: Tables):
    root = [[1.0, 0.0], [0.6, 0.8]]
    d = dist.draws(t.spark, 40_000, 4, b=dist.binomial(8, 0.25, 21), m=dist.matrix_gaussian([[1.0, 2.0], [3.0, 4.0]], root, [[2.0, 0.0], [0.0, 1.0]], 40))
    c = lambda i, j: F.col("m")[i][j]
    return durable(d, "draws").agg(
        ((F.abs(F.avg("b") - 2) < 0.03) & (F.abs(F.var_samp("b") - 1.5) < 0.05)).alias("binomial"), ((F.abs(F.avg(c(0, 0)) - 1) < 0.05) & (F.abs(F.avg(c(1, 1)) - 4) < 0.03)).alias("mean"),
        (F.abs(F.corr(c(0, 0), c(1, 0)) - 0.6) < 0.02).alias("rows"), ((F.abs(F.corr(c(0, 0), c(0, 1))) < 0.02) & (F.abs(F.stddev_samp(c(0, 0)) - 2) < 0.05)).alias("columns"),
    )


# -- kernels of operators --------------------------------------------------------------------------


@query("N30_operator_kernel", f"""
    SELECT event_id, round(-(x - 0.2) / 4 * k, 6) AS slope, round((0.25 - (x - 0.2) * (x - 0.2) / 16) * k, 6) AS slopes, round(k * 9 + 4 * (0.25 - (x - 0.2) * (x - 0.2) / 16) * k, 6) AS whole
    FROM (SELECT event_id, x, exp(-(x - 0.2) * (x - 0.2) / 8) AS k FROM {X})""")
def _(t: Tables):
    a, b = F.array("x"), F.array(F.lit(0.2))
    return rounded(x(t).select("event_id", kernels.rbf_partial(2.0, 0)(a, b).alias("slope"), kernels.rbf_mixed(2.0, 0, 0)(a, b).alias("slopes"), kernels.operated(2.0, 3.0, [2.0])(a, b).alias("whole")))


# -- models by name --------------------------------------------------------------------------------


def suppliers(t: Tables):
    return t.supplier.select("s_suppkey", F.array(F.col("s_nationkey") / 10.0, F.col("s_suppkey") % 7 / 7.0).alias("features"), (F.col("s_acctbal") / 1000).alias("target"))


@query("M27_glm_pipe", RIDGE)
def _(t: Tables):
    before = lambda d: d.withColumns({"features": F.array(F.col("l_quantity") / 50), "target": F.col("l_extendedprice")})
    p = models.model_pipe("glm", before, lambda d: d.select("l_orderkey", "l_linenumber", "score"), size=1).train(t.lineitem)
    return rounded(p.predict(t.lineitem), 2)


@query("M27_kernel_pipes")
def _(t: Tables):
    """Support vectors, processes and their mixture on all suppliers, trained and answered through pipes."""
    k, n = gram.kernel("rbf", b=0.5), gram.kernel("dirac", noise=0.5)
    options = {"svm": {"kernel": k}, "process": {"kernel": k, "noise": n}, "student": {"kernel": k, "noise": n}, "skew": {"kernel": k, "noise": n}, "mixture": {"kernels": [k, gram.kernel("rbf", b=1.5)], "noise": n}}
    out = None
    for name, o in options.items():
        p = models.model_pipe(name, after=lambda d, name=name: d.select("s_suppkey", F.lit(name).alias("model"), "score"), **o).train(suppliers(t))
        one = p.predict(suppliers(t))
        out = one if out is None else out.union(one)
    return rounded(out, 5)


@query("M21_prior_sampling")
def _(t: Tables):
    """Widths drawn from a prior, each judged by the energies of all users' processes."""
    rng = np.random.default_rng(3)
    found = tuning.landscape_by_group(series(t), "user_id", [{"b": float(rng.gamma(2.0, 0.5))} for _ in range(6)], process_energy)
    return rounded(found.select(F.col("config")["b"].alias("b"), "energy"), 3)


@query("E24_spearman_outputs", """
    WITH r AS (SELECT output, rank() OVER (PARTITION BY output ORDER BY p) + (count(*) OVER (PARTITION BY output, p) - 1) / 2 AS a, rank() OVER (PARTITION BY output ORDER BY y) + (count(*) OVER (PARTITION BY output, y) - 1) / 2 AS b
               FROM (SELECT unnest([0, 1]) AS output, unnest([l_quantity, l_discount]) AS p, unnest([l_extendedprice, l_tax]) AS y FROM lineitem))
    SELECT CAST(output AS INTEGER) AS output, round(corr(a, b), 6) AS spearman FROM r GROUP BY output""")
def _(t: Tables):
    d = t.lineitem.select(F.array("l_quantity", "l_discount").alias("scores"), F.array("l_extendedprice", "l_tax").alias("labels"))
    return rounded(metrics.multi_spearman(d, 2))


@query("M5_generalised_least_squares", """
    WITH d AS (SELECT s_nationkey::DOUBLE AS x, s_acctbal AS y, 1.0 + s_suppkey % 3 AS v FROM supplier),
    g AS (SELECT sum(x * x / v) AS a, sum(x / v) AS b, sum(1 / v) AS c, sum(x * y / v) AS p, sum(y / v) AS q FROM d)
    SELECT round((c * p - b * q) / (a * c - b * b), 4) AS slope, round((a * q - b * p) / (a * c - b * b), 4) AS intercept FROM g""")
def _(t: Tables):
    """The errors' covariance matrix in cells (here a diagonal one), over all rows."""
    omega = t.supplier.select(F.col("s_suppkey").alias("i"), F.col("s_suppkey").alias("j"), (F.lit(1.0) + F.col("s_suppkey") % 3).alias("v"))
    w = glm.generalised_least_squares_of(t.supplier, [F.col("s_nationkey")], F.col("s_acctbal"), "s_suppkey", omega).weights
    return t.spark.createDataFrame([(round(float(w[0]), 4), round(float(w[1]), 4))], "slope double, intercept double")


GRID = "(SELECT CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, sin(i) * j::DOUBLE AS u FROM range(12) a(i), range(10) b(j))"


def grid(t: Tables):
    d = t.spark.range(120).select(F.floor(F.col("id") / 10).alias("i"), (F.col("id") % 10).alias("j"))
    return d.withColumn("u", F.sin("i") * F.col("j"))


@query("M32_heat_step", f"""
    SELECT i, j, round(coalesce(u + 0.05 * ((a + b - 2 * u) / 1.0 + (c + d - 2 * u) / 0.25), u), 6) AS u FROM (
        SELECT *, lag(u) OVER x AS a, lead(u) OVER x AS b, lag(u) OVER y AS c, lead(u) OVER y AS d FROM {GRID} WINDOW x AS (PARTITION BY j ORDER BY i), y AS (PARTITION BY i ORDER BY j))""")
def _(t: Tables):
    return rounded(fields.heat_step(grid(t), ["i", "j"], "u", [1.0, 0.5], 0.05))


def timed(t: Tables):
    """The stream of events with instants, as watermarks want them."""
    return stream(t).withColumn("ts", F.col("ts").cast("timestamp"))


@query("X1_streaming_windows", "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def _(t: Tables):
    done = streams.drain(streams.windowed(timed(t), "ts", "value", ["event_type"], "1 day", late="1000 days"), name(), "complete")
    return rounded(done.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total"), 4)


@query("X1_streaming_sessions", """
    WITH s AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 1 DAY THEN 0 ELSE 1 END AS begins FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    g AS (SELECT user_id, ts, sum(begins) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM s)
    SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 1 DAY AS "end", count(*) AS n FROM g GROUP BY user_id, k""")
def _(t: Tables):
    done = streams.drain(streams.sessions(timed(t), "ts", ["user_id"], "1 day", late="1000 days"), name(), "complete")
    return done.select("user_id", *(F.col(c).cast("timestamp_ntz").alias(c) for c in ("start", "end")), "n")


# -- networks and layers ---------------------------------------------------------------------------


def net_rows(t: Tables):
    return series(t).select("event_id", "features", F.array("target", F.col("target") * 2).alias("target"))


@query("M29_network_model")
def _(t: Tables):
    """Two outputs: trained, evaluated output by output."""
    m = nets.Model([2, 4, 2], ["tanh", "linear"]).fit(net_rows(t), nets.Stop(4), rate=0.05)
    return rounded(m.evaluate(net_rows(t)), 5)


@query("M31_stops")
def _(t: Tables):
    """Steps taken under each criterion, and whether the last change of loss meets it."""
    rows = durable(net_rows(t), "rows")
    out = []
    for name, stop in (("steps", nets.Stop(3)), ("absolute", nets.Stop(12, absolute=0.05)), ("relative", nets.Stop(12, relative=0.2))):
        h = nets.Model([2, 2], ["linear"]).fit(rows, stop, rate=0.1).network.history
        change = abs(h[-2] - h[-1])
        met = len(h) == stop.steps or change < stop.absolute or change < stop.relative * abs(h[-2])
        out.append((name, len(h), bool(met)))
    return t.spark.createDataFrame(out, "criterion string, steps int, met boolean")


E64 = "(SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)"


@query("M30_rbf_layer", f"SELECT vec_id, [round(exp(-list_sum([pow((v - c) * 0.25, 2) for v in e])), 6) for c in [0.0, 0.5]] AS out FROM {E64}")
def _(t: Tables):
    centres, scales = np.array([[0.0] * 64, [0.5] * 64]), np.full((2, 64), 0.25)
    d = nets.apply_layer(t.embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("e")), "e", lambda z: nets.rbf_layer(z, centres, scales), "out")
    return d.select("vec_id", rounded_items("out").alias("out"))


@query("M30_batch_norm", "SELECT vec_id, [round((z[1] - z[2]) / sqrt(z[3] + 1e-5), 5) for z in list_zip(CAST(embedding AS DOUBLE[]), m, v)] AS out FROM embeddings, (SELECT list(m ORDER BY d) AS m, list(v ORDER BY d) AS v FROM (SELECT d, avg(x) AS m, var_pop(x) AS v FROM (SELECT unnest(range(64)) AS d, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) GROUP BY d))")
def _(t: Tables):
    d = nets.normalised(t.embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("out")), "out")
    return d.select("vec_id", rounded_items("out", 5).alias("out"))


@query("M30_ctrnn", f"SELECT event_id, [round(a, 6), round(a + 0.1 * (0.75 * tanh(2 * a + 0.5) - a / 2), 6)] AS out FROM (SELECT event_id, x + 0.1 * (0.75 * tanh(2 * x + 0.5) - x / 2) AS a FROM {X})")
def _(t: Tables):
    one = lambda v: np.array([[v]])
    layer = lambda z: nets.ctrnn(z, one(2.0), np.array([0.5]), one(0.75), np.array([0.5]), 0.1, 2)
    d = nets.apply_layer(x(t).select("event_id", F.array("x").alias("e")), "e", layer, "out")
    return d.select("event_id", rounded_items("out").alias("out"))


@query("B14_layers", f"SELECT event_id, [round(1 / sqrt(0.5 + 2 * exp(-1.5 * x)), 6), round(tanh(x), 6), round(2 * x + 1, 6), round(-x, 6)] AS out FROM {X}")
def _(t: Tables):
    """A generalised logistic, tanh, and a linear layer of two steps, beside each other."""
    layer = nets.beside(lambda z: nets.generalised_logistic(z, 1.5, 2.0, 2.0, 0.5), np.tanh, lambda z: nets.finite_horizon(z, np.array([[2.0, -1.0]]), np.array([1.0, 0.0]), 2))
    d = nets.apply_layer(x(t).select("event_id", F.array("x").alias("e")), "e", layer, "out")
    return d.select("event_id", rounded_items("out").alias("out"))


@query("M30_residual", f"SELECT vec_id, [round(v + greatest(v * 2, 0), 6) for v in e] AS out FROM {E64}")
def _(t: Tables):
    layer = lambda z: nets.residual_block(z, lambda y: np.maximum(2 * y, 0))
    d = nets.apply_layer(t.embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("e")), "e", layer, "out")
    return d.select("vec_id", rounded_items("out").alias("out"))


@query("M30_convolution", f"""
    SELECT vec_id, CAST(i AS INTEGER) AS i, round(list_sum([CASE WHEN i // 8 + a BETWEEN 0 AND 7 AND i % 8 + b BETWEEN 0 AND 7 THEN e[i + 8 * a + b + 1] * (2 + a + 3 * b) ELSE 0 END for b in [-1, 0, 1] for a in [-1, 0, 1]]), 5) AS v
    FROM {E64}, range(64) r(i)""".replace("list_sum([CASE", "list_sum([list_sum([CASE").replace("ELSE 0 END for b in [-1, 0, 1] for a in [-1, 0, 1]])", "ELSE 0 END for b in [-1, 0, 1]]) for a in [-1, 0, 1]])"))
def _(t: Tables):
    """Each vector as an 8 x 8 image under one 3 x 3 filter."""
    filters = np.array([[2 + a + 3 * b for b in (-1, 0, 1)] for a in (-1, 0, 1)], float).reshape(3, 3, 1, 1)
    layer = lambda z: [nets.conv2d(image, filters) for image in z]
    d = nets.apply_layer(t.embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("e")), "e", layer, "out", [8, 8, 1])
    return d.select("vec_id", F.posexplode("out").alias("i", "v")).select("vec_id", "i", F.round("v", 5).alias("v"))


@query("M16_autoencoder")
def _(t: Tables):
    """Vectors through two numbers and back: the loss falls, every row comes back."""
    e = t.embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("features"))
    net = nets.autoencoder(e, [64, 2, 64], ["tanh", "linear"], stop=nets.Stop(6), rate=0.05)
    back = net.predict(e)
    error = F.aggregate(F.zip_with("prediction", "features", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
    return back.agg(F.count("*").alias("n"), F.round(F.avg(error) / 2, 4).alias("loss")).withColumn("falls", F.lit(bool(net.history[-1] < net.history[0])))


# -- worked examples -------------------------------------------------------------------------------
# Each goes from rows to metrics; users of ``events`` stand for plants, stars or satellites.


def in_time(d, share: float = 0.7):
    """``train``: the first rows of each user, the given share of them, by one window in a user."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id")
    place = F.row_number().over(w.orderBy("ts", "event_id"))
    return d.withColumn("train", place <= F.floor(F.count("*").over(w) * share))


def judged(d):
    """Metrics of the rows that no model was trained on."""
    return rounded_metrics(metrics.regression_metrics(d.where("not train and score is not null").select("score", F.col("target").alias("label"))))


def two_series(t: Tables, targets=None):
    e = t.events.withColumns({"a": F.col("value") / 100, "b": F.sin("value")})
    return in_time(ordered.delta_features_vector(e, ["a", "b"], [2, 1], ["ts", "event_id"], ["user_id"], targets))


@query("EX2_matrix_t_outputs")
def _(t: Tables):
    """Lags of two series predict both at once, by matrix-T processes a user."""
    d = two_series(t, ["a", "b"]).select("user_id", "event_id", "ts", "train", "features", F.col("a").alias("target"), "b")
    kinds = dict(d.dtypes)

    def run(x_, y, pdf):
        known = pdf["train"].to_numpy(bool)
        both = pdf[["target", "b"]].to_numpy(float)
        m = processes.MatrixT(gram.kernel("rbf", b=0.5), gram.kernel("dirac", noise=0.5), x_[known], both[known])
        means = m.predict(x_)[0]
        return pdf[["event_id", "train"]].assign(scores=list(means), labels=list(both))

    out = processes.by_group(d, "user_id", ["ts", "event_id"], run, f"event_id {kinds['event_id']}, train boolean, scores array<double>, labels array<double>")
    return rounded(metrics.multi_regression_metrics(out.where("not train").select("scores", "labels")), 4)


def process(kernel):
    return lambda x_, y: processes.GaussianProcess(kernel, gram.kernel("dirac", noise=0.5), x_, y)


@query("EX3_exogenous_process")
def _(t: Tables):
    """Lags of a series and of another predict the first, by a Gaussian process a user."""
    d = two_series(t).withColumn("target", F.col("target").cast("double"))
    p = processes.predict_by_group(d, *BY, process(gram.plus(gram.kernel("rbf", b=0.5), gram.kernel("linear", offset=1.0))), train="train")
    return judged(p.withColumnRenamed("mean", "score"))


@query("EX4_outputs_network")
def _(t: Tables):
    """The same two outputs by one network over all users, scaled on the training rows."""
    d = two_series(t, ["a", "b"]).withColumn("split", F.when(F.col("train"), "train").otherwise("test"))
    scaled, fitted = scalers.fit_split(d.select("event_id", "split", "features", "target"), ["features", "target"], "gaussian")
    m = nets.Model([3, 5, 2], ["tanh", "linear"]).fit(scaled.where("split = 'train'"), nets.Stop(8), rate=0.1)
    test = m.predict(scaled.where("split = 'test'"))
    back = fitted["target"]
    return rounded(metrics.multi_regression_metrics(test.select(back.backward(F.col("prediction")).alias("scores"), back.backward(F.col("target")).alias("labels"))), 4)


@query("EX5_support_vectors")
def _(t: Tables):
    """Two lags, a polynomial kernel, least-squares support vectors a user."""
    make = lambda x_, y: processes.LeastSquaresSVM(gram.kernel("polynomial", degree=2, offset=0.5), x_, y, 2.5)
    return judged(processes.predict_by_group(in_time(series(t)), *BY, make, ("score",), train="train"))


@query("EX7_light_curves")
def _(t: Tables):
    """Irregular times: each user's values over the hours since the first, by a rough process."""
    hours = (F.unix_micros(F.col("ts").cast("timestamp")) - F.min(F.unix_micros(F.col("ts").cast("timestamp"))).over(_by_user())) / 3.6e9
    d = in_time(t.events.select("user_id", "event_id", "ts", F.array(hours / 24).alias("features"), (F.col("value") / 100).alias("target")))
    k = gram.plus(gram.kernel("laplacian", beta=2.0), gram.kernel("fbm", hurst=0.3))
    return judged(processes.predict_by_group(d, *BY, process(k), train="train").withColumnRenamed("mean", "score"))


def _by_user():
    from pyspark.sql import Window

    return Window.partitionBy("user_id")


@query("EX8_committee_of_networks")
def _(t: Tables):
    """Three networks of their own seeds and widths; weights from the training errors' second moments."""
    d = in_time(series(t)).select("user_id", "event_id", "train", "features", "target", F.array("target").alias("y"))
    d = durable(d, "rows")
    out, names = d, []
    for k, width in enumerate((3, 4, 5)):
        names.append(f"s{k}")
        m = nets.Model([2, width, 1], ["tanh", "linear"], target="y").fit(d.where("train"), nets.Stop(4), rate=0.05, seed=k)
        out = m.predict(out, names[-1]).withColumn(names[-1], F.col(names[-1])[0])
    out = durable(out, "answers")
    w = processes.committee_weights_of(out.where("train"), names, "target")
    return judged(out.withColumn("score", sum(F.col(n) * float(v) for n, v in zip(names, w, strict=True))))


def parts(t: Tables):
    """Prices of parts from size, brand and key, split by a hash."""
    d = t.part.select("p_partkey", F.array(F.col("p_size") / 50.0, F.regexp_extract("p_brand", r"(\d+)", 1).cast("double") / 55, F.col("p_partkey") % 1000 / 1000.0).alias("features"), F.array(F.col("p_retailprice")).alias("target"))
    flagged = pipes.split_flag(F.pmod(F.xxhash64("p_partkey"), F.lit(10)) < 7)(d)
    return scalers.fit_split(flagged, ["features", "target"], "gaussian")


def back(d, scaler):
    """Metrics in the targets' own units."""
    return rounded_metrics(metrics.regression_metrics(d.select(scaler.backward(F.array("score"))[0].alias("score"), scaler.backward(F.array("label"))[0].alias("label"))))


@query("EX9_linear_and_network")
def _(t: Tables):
    """The same rows by ridge regression and by a network."""
    d, fitted = parts(t)
    train, test = d.where("split = 'train'"), d.where("split = 'test'")
    m = glm.ridge(train, [F.col("features")[i] for i in range(3)], F.col("target")[0])
    linear = back(m.predict(test).select("score", F.col("target")[0].alias("label")), fitted["target"])
    net = nets.Model([3, 6, 1], ["tanh", "linear"]).fit(train, nets.Stop(8), rate=0.1)
    other = back(net.predict(test).select(F.col("prediction")[0].alias("score"), F.col("target")[0].alias("label")), fitted["target"])
    return linear.withColumn("model", F.lit("ridge")).unionByName(other.withColumn("model", F.lit("network")))


@query("EX11_logistic_segments")
def _(t: Tables):
    """Whether an order is large, from its month, status and priority: recoded, scaled, judged at all thresholds."""
    d = t.orders.select(
        "o_orderkey", F.array(F.month("o_orderdate") / 12.0, (F.col("o_orderstatus") == "F").cast("double"), F.substring("o_orderpriority", 1, 1).cast("double") / 5).alias("features"), (F.col("o_totalprice") > 200_000).cast("double").alias("y"),
    )
    split, _ = scalers.fit_split(pipes.split_flag(F.pmod(F.xxhash64("o_orderkey"), F.lit(10)) < 8)(d), ["features"], "gaussian")
    m = glm.logistic_model(split.where("split = 'train'"), [F.col("features")[i] for i in range(3)], F.col("y"), glm.Options(0.001, 8, 1.0, 1.0))
    s = durable(m.predict(split.where("split = 'test'")).select("score", F.col("y").cast("int").alias("label")), "scores")
    return rounded(metrics.binary_kpi(s, metrics.thresholds(s)), 4)


@query("EX12_network_prices")
def _(t: Tables):
    """Scale on the training rows, train with momentum until the loss stands, judge in the targets' units."""
    d, fitted = parts(t)
    m = nets.Model([3, 5, 1], ["sigmoid", "linear"]).fit(d.where("split = 'train'"), nets.Stop(8, relative=0.001), rate=0.2, momentum=0.7, regularisation=0.001)
    test = m.predict(d.where("split = 'test'"))
    return back(test.select(F.col("prediction")[0].alias("score"), F.col("target")[0].alias("label")), fitted["target"])


@query("EX13_preprocessing", "SELECT o_orderkey, o_totalprice, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE -1 END AS label FROM orders")
def _(t: Tables):
    """Labels recoded, rows dealt 9 to 1 at random into two sets of lines; read back, none is lost or doubled."""
    d = t.orders.select(F.col("o_orderkey").cast("string"), F.col("o_totalprice").cast("string"), F.when(F.col("o_orderstatus") == "F", "1").otherwise("-1").alias("label"))
    dealt = durable(d.withColumn("__r", F.rand(5)), "dealt")
    read = None
    for cut in (F.col("__r") < 0.9, F.col("__r") >= 0.9):
        path = new_path(t.spark, "lines")
        text.write_values(dealt.where(cut).drop("__r"), path)
        one = text.csv(t.spark, path, "o_orderkey long, o_totalprice double, label int")
        read = one if read is None else read.union(one)
    return read


@query("EX10_wine_by_support_vectors")
def _(t: Tables):
    """Labelled documents of each language by support vectors, judged at all thresholds."""
    d = quality(t).join(t.documents.select("doc_id", "lang"), "doc_id").select(F.coalesce("lang", F.lit("")).alias("lang"), "doc_id", F.array("a", "b").alias("features"), (2 * F.col("y") - 1).alias("target"))
    d = d.withColumn("train", F.pmod(F.xxhash64("doc_id"), F.lit(10)) < 8)
    said = large.support_vectors_by_group(d, "lang", ["doc_id"], gram.kernel("rbf", b=1.0), 2.5, train="train")
    s = durable(said.where("not train").select("score", (F.col("target") > 0).cast("int").alias("label")), "scores")
    return rounded(metrics.binary_kpi(s, metrics.thresholds(s)), 4)
