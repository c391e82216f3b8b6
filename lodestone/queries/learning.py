"""Queries over models, tuners, probability, and streams."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from lodestone.functions import distributions as dist
from lodestone.operators import metrics, ordered, pipes, scalers
from lodestone.plans import fields, glm, gram, nets, processes, prototypes, sequences, tuning
from lodestone.queries.registry import Tables, query
from lodestone.queries.statistics import rounded
from lodestone.session import durable, new_path
from lodestone.streaming import tables as streams

FEATURES = ["l_quantity", "l_discount"]


def columns():
    return [F.col(c) for c in FEATURES]


@query("entry_ridge_pipeline")
def flagship(t: Tables):
    """Scale two features, fit ridge on the train split, score the test split, evaluate."""
    rows = t.lineitem.select("l_orderkey", "l_linenumber", F.array("l_quantity", "l_discount").alias("x"), F.col("l_extendedprice").alias("y"))
    split, _ = scalers.fit_split(pipes.split_flag(F.pmod(F.xxhash64("l_orderkey", "l_linenumber"), F.lit(10)) < 8)(rows), ["x"], "gaussian")
    model = glm.ridge(split.where("split = 'train'"), [F.col("x")[0], F.col("x")[1]], F.col("y"))
    return glm.evaluate(model, split.where("split = 'test'"), F.col("y"))


@query("M1_least_squares", "SELECT round(regr_slope(l_extendedprice, l_quantity), 3) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 2) AS intercept FROM lineitem")
def _(t: Tables):
    w = glm.least_squares(t.lineitem, [F.col("l_quantity")], F.col("l_extendedprice")).weights
    return t.spark.createDataFrame([(round(float(w[0]), 3), round(float(w[1]), 2))], "slope double, intercept double")


@query("M2_ridge_predictions", """
    WITH g AS (SELECT sum(x * x) + 1 AS a, sum(x) AS b, count(*) + 1 AS c, sum(x * y) AS p, sum(y) AS q FROM (SELECT l_quantity AS x, l_extendedprice AS y FROM lineitem))
    SELECT l_orderkey, l_linenumber, round((c * p - b * q) / (a * c - b * b) * l_quantity + (a * q - b * p) / (a * c - b * b), 2) AS score FROM lineitem, g""")
def _(t: Tables):
    return rounded(glm.ridge(t.lineitem, [F.col("l_quantity")], F.col("l_extendedprice")).predict(t.lineitem).select("l_orderkey", "l_linenumber", "score"), 2)


def quality(t: Tables):
    """Figures of the labelled documents; texts are read once and stay where they are."""
    bad = F.length(F.regexp_replace("text", "[^#$%&*|!]+", "")) / F.greatest(F.length("text"), F.lit(1))
    found = durable(t.documents.select("doc_id", (bad * 10).alias("a"), F.log1p(F.col("n_chars").cast("double")).alias("b")), "figures")
    return found.join(t.labels, "doc_id").select("doc_id", "a", "b", F.col("quality").cast("double").alias("y"))


@query("M3_logistic")
def _(t: Tables):
    m = glm.logistic_model(quality(t), [F.col("a"), F.col("b")], F.col("y"), glm.Options(0.001, 15, 1.0, 2.0))
    return rounded(m.predict(quality(t)).select("doc_id", "score"))


@query("M3_probit")
def _(t: Tables):
    m = glm.probit_model(quality(t), [F.col("a"), F.col("b")], F.col("y"), glm.Options(0.001, 8, 1.0, 1.0))
    return rounded(m.predict(quality(t)).select("doc_id", "score"))


@query("M5_weighted_least_squares", """
    WITH g AS (SELECT sum(x * x / v) AS a, sum(x / v) AS b, sum(1 / v) AS c, sum(x * y / v) AS p, sum(y / v) AS q FROM (SELECT l_quantity AS x, l_extendedprice AS y, 1 + l_tax AS v FROM lineitem))
    SELECT round((c * p - b * q) / (a * c - b * b), 3) AS slope, round((a * q - b * p) / (a * c - b * b), 2) AS intercept FROM g""")
def _(t: Tables):
    w = glm.weighted_least_squares(t.lineitem, [F.col("l_quantity")], F.col("l_extendedprice"), 1 + F.col("l_tax")).weights
    return t.spark.createDataFrame([(round(float(w[0]), 3), round(float(w[1]), 2))], "slope double, intercept double")


@query("M6_cross_validation")
def _(t: Tables):
    e = glm.cross_validated_rmse(t.lineitem, columns(), F.col("l_extendedprice"), F.col("l_orderkey"))
    return t.spark.createDataFrame([(round(e, 4),)], "rmse double")


@query("M20_quasi_newton")
def _(t: Tables):
    m = glm.quasi_newton(quality(t), [F.col("a"), F.col("b")], F.col("y"), options=glm.Options(0.0001, 10))
    return rounded(m.predict(quality(t)).select("doc_id", "score"), 4)


def series(t: Tables):
    rows = ordered.delta_features(t.events, "value", 2, 0, ["ts", "event_id"], ["user_id"])
    return rows.select("event_id", "user_id", "ts", F.transform("features", lambda v: v / 100).alias("features"), (F.col("target") / 100).alias("target"))


BY = ("user_id", ["event_id"])


def answers(t: Tables, make, columns, answer=None):
    """A model a user, trained on all its rows, answers for each of them; every user of the table has one."""
    return rounded(processes.predict_by_group(series(t), *BY, make, columns, answer).select("event_id", *columns))


def svm(width: float):
    return lambda x, y: processes.LeastSquaresSVM(gram.kernel("rbf", b=width), x, y, 2.5)


@query("M8_ls_svm")
def _(t: Tables):
    return answers(t, svm(0.5), ("score",))


@query("M9_committee")
def _(t: Tables):
    out = None
    names = []
    for b in (0.3, 0.6, 1.2):
        names.append(f"s{len(names)}")
        one = processes.predict_by_group(series(t), *BY, svm(b), (names[-1],))
        out = one if out is None else out.join(one.select("event_id", names[-1]), "event_id")
    out = durable(out, "committee")
    w = processes.committee_weights_of(out, names, "target")
    return rounded(out.select("event_id", sum(F.col(n) * float(v) for n, v in zip(names, w, strict=True)).alias("score")), 5)


def gp(x, y, kind=processes.GaussianProcess):
    return kind(gram.plus(gram.kernel("fbm", hurst=0.55), gram.kernel("laplacian", beta=2.5)), gram.kernel("dirac", noise=0.5), x, y)


@query("M10_gaussian_process")
def _(t: Tables):
    return answers(t, gp, ("mean", "variance"))


@query("M10_process_by_group")
def _(t: Tables):
    k, n = gram.kernel("rbf", b=0.5), gram.kernel("dirac", noise=0.1)
    return rounded(processes.fit_by_group(series(t), "user_id", lambda x, y: processes.GaussianProcess(k, n, x, y)), 4)


@query("M13_student_process")
def _(t: Tables):
    return answers(t, lambda x, y: gp(x, y, processes.StudentProcess), ("mean", "variance"))


@query("M12_laplace_classifier")
def _(t: Tables):
    make = lambda x, y: processes.LaplaceClassifier(gram.kernel("rbf", b=0.5), x, np.where(y > np.median(y), 1.0, -1.0))
    return answers(t, make, ("probability",))


@query("M16_network")
def _(t: Tables):
    net = nets.train(series(t).withColumn("target", F.array("target")), nets.Network.initial([2, 4, 1], ["tanh", "linear"]), stop=nets.Stop(5), rate=0.05)
    return rounded(net.predict(series(t)).select("event_id", F.col("prediction")[0].alias("score")))


def process_energy(c, x, y):
    return processes.GaussianProcess(gram.kernel("rbf", b=c["b"]), gram.kernel("dirac", noise=c.get("noise", 0.5)), x, y).energy()


@query("M21_grid_search")
def _(t: Tables):
    found = tuning.landscape_by_group(series(t), "user_id", tuning.grid({"b": 1.5, "noise": 1.5}, 0.3, 3), process_energy)
    return rounded(found.select(F.col("config")["b"].alias("b"), F.col("config")["noise"].alias("noise"), "energy"), 3)


@query("M22_M24_searches")
def _(t: Tables):
    bowl = lambda c: (c["x"] - 2) ** 2 + (c["y"] - 1) ** 2
    start, rows = {"x": 1.0, "y": 3.0}, []
    for kind in tuning.ACCEPTANCE:
        rows.append((kind, tuning.annealing(start, bowl, kind, tuning.Tuner(iterations=40))[1]))
    rows.append(("cma", tuning.cma_es(start, bowl, tuning.Tuner(iterations=40))[1]))
    rows.append(("gradient", tuning.gradient_search(start, bowl, iterations=60)[1]))
    return t.spark.createDataFrame([(k, bool(e < 0.5)) for k, e in rows], "search string, near boolean")


@query("M28_prototypes")
def _(t: Tables):
    rows = prototypes.select(t.embeddings, "embedding", 10)
    return t.spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rows)], "i int, x array<double>")


@query("M32_divergence", "SELECT CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, CASE WHEN i BETWEEN 1 AND 6 AND j BETWEEN 1 AND 6 THEN 2.0 * i + 3.0 END AS divergence FROM range(8) a(i), range(8) b(j)")
def _(t: Tables):
    grid = t.spark.range(64).select(F.floor(F.col("id") / 8).alias("i"), (F.col("id") % 8).alias("j"))
    field = grid.select("i", "j", (F.col("i") * F.col("i")).cast("double").alias("u"), (3.0 * F.col("j")).alias("w"))
    return fields.divergence(field, ["i", "j"], ["u", "w"], [1.0, 1.0]).select("i", "j", "divergence")


@query("W11_free_run")
def _(t: Tables):
    def run(x, y, pdf):
        path = processes.free_run(gp(x, y), np.r_[x[-1, 1:], y[-1]], 5)
        return pd.DataFrame({"step": range(1, 6), "value": path})

    rows = series(t).select("user_id", "event_id", "ts", "features", "target")
    return rounded(processes.by_group(rows, "user_id", ["ts", "event_id"], run, "step int, value double"))


#: The first-order filter, written as a recursion over each user's numbered events.
KALMAN = """
    WITH RECURSIVE e AS (SELECT user_id, value / 100 AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
    f AS (SELECT user_id, 0 AS k, 0.0::DOUBLE AS m, 1.0::DOUBLE AS c FROM e WHERE k = 1
          UNION ALL SELECT f.user_id, f.k + 1, f.m + (f.c + 0.1) / (f.c + 0.6) * (e.v - f.m), (f.c + 0.1) / (f.c + 0.6) * 0.5 FROM f JOIN e ON e.user_id = f.user_id AND e.k = f.k + 1)
    SELECT user_id, CAST(max(k) AS BIGINT) AS n, round(arg_max(m, k), 6) AS mean, round(arg_max(c, k), 6) AS variance FROM f GROUP BY user_id"""


@query("W12_kalman", KALMAN)
def _(t: Tables):
    e = t.events.withColumn("v", F.col("value") / 100)
    return rounded(sequences.kalman(e, ["user_id"], ["ts", "event_id"], "v", 0.1, 0.5).select("user_id", F.col("n").cast("long").alias("n"), "mean", "variance"))


@query("W14_simulate")
def _(t: Tables):
    return rounded(sequences.simulate(t.spark, 200, seed=3))


# -- probability -----------------------------------------------------------------------------------------


@query("R1_R4_draws", "SELECT CAST(20000 AS BIGINT) AS n, true AS gaussian, true AS uniform, true AS categorical, true AS erlang, true AS kumaraswamy, true AS truncated, true AS student")
def _(t: Tables):
    d = dist.draws(
        t.spark, 20000, 4, g=dist.gaussian(1.0, 2.0, 1), u=dist.uniform(2.0, 4.0, 2), c=dist.categorical([1.0, 3.0], 3), e=dist.erlang(3, 2.0, 4),
        k=dist.kumaraswamy(2.0, 3.0, 9), q=dist.truncated_gaussian(0.0, 1.0, -0.5, 2.0, 11), s=dist.student_t(6, 20),
    )
    near = lambda c, m, e: (F.abs(F.avg(c) - m) < e)
    return d.agg(
        F.count("*").alias("n"), near("g", 1.0, 0.06).alias("gaussian"), near("u", 3.0, 0.03).alias("uniform"), near("c", 0.75, 0.02).alias("categorical"), near("e", 1.5, 0.03).alias("erlang"),
        near("k", 0.457, 0.01).alias("kumaraswamy"), (F.min("q") >= -0.5).alias("truncated"), near("s", 0.0, 0.05).alias("student"),
    )


@query("R4_densities", "SELECT event_id, round(-x * x / 8 - ln(2) - ln(2 * pi()) / 2, 6) AS gaussian, round(-abs(x) / 2 - ln(4), 6) AS laplace, round(lgamma(3) - lgamma(2.5) - ln(5 * pi()) / 2 - 3 * ln(1 + x * x / 5), 6) AS student FROM (SELECT event_id, sin(value) AS x FROM events)")
def _(t: Tables):
    x = F.sin("value")
    return rounded(t.events.select("event_id", dist.log_gaussian(x, 0.0, 2.0).alias("gaussian"), dist.log_laplace(x, 0.0, 2.0).alias("laplace"), dist.log_student_t(x, 5, 0.0, 1.0).alias("student")))


@query("R5_mixture_density", "SELECT event_id, round(ln(0.25 * exp(-x * x / 2) / sqrt(2 * pi()) + 0.75 * exp(-(x - 1) * (x - 1) / 8) / (2 * sqrt(2 * pi()))), 6) AS log_density FROM (SELECT event_id, sin(value) AS x FROM events)")
def _(t: Tables):
    x = F.sin("value")
    return rounded(t.events.select("event_id", dist.log_mixture([dist.log_gaussian(x, 0.0, 1.0), dist.log_gaussian(x, 1.0, 2.0)], [1.0, 3.0]).alias("log_density")))


@query("R7_likelihood", "SELECT round(sum(CASE WHEN quality = 1 THEN -ln(1 + exp(-s)) ELSE -ln(1 + exp(s)) END), 4) AS log_likelihood FROM (SELECT quality, ln(1 + n_chars) / 10 AS s FROM documents JOIN labels USING (doc_id))")
def _(t: Tables):
    d = t.documents.join(t.labels, "doc_id")
    s = F.log1p(F.col("n_chars").cast("double")) / 10
    return rounded(dist.log_likelihood(d, dist.log_sigmoid_likelihood(s, F.col("quality"))), 4)


@query("R8_metropolis")
def _(t: Tables):
    return sequences.metropolis(t.spark, lambda x: -float(x @ x) / 2, [0.0, 0.0], 200, 4, adaptive=True).select("chain", "step", "accepted")


@query("R8_rejection")
def _(t: Tables):
    p = dist.draws(t.spark, 2000, 2, x=dist.uniform(-4.0, 4.0, 5))
    return rounded(dist.accepted(p, dist.log_gaussian(F.col("x"), 0.0, 1.0), F.lit(-np.log(8.0)), float(np.log(8.0 * 0.4)), 6).select("id", "x"))


@query("R8_abc")
def _(t: Tables):
    return rounded(sequences.abc(t.spark, dist.uniform(0.0, 10.0, 1), lambda m: m + F.randn(2), lambda d: F.abs(d - 5), 0.5, 2000).select("theta"))


# -- streams ---------------------------------------------------------------------------------------------


def stream(t: Tables):
    """The events as a stream of three files that follow each other in time, so that each user's rows come in several batches."""
    path = new_path(t.spark, "stream")
    cuts = t.events.agg(F.percentile_approx(F.unix_micros(F.col("ts").cast("timestamp")), [1 / 3, 2 / 3])).first()[0] or [0, 0]
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    part = F.when(at <= cuts[0], 0).when(at <= cuts[1], 1).otherwise(2)
    for k in range(3):
        # written one after another: the stream takes files by their times
        t.events.where(part == k).coalesce(1).write.mode("append").parquet(path)
    return streams.read(t.spark, path, t.events)


def name() -> str:
    return f"t{uuid.uuid4().hex}"


@query("X4_streaming_metrics", "SELECT round(avg(value * value), 3) AS mse, round(avg(abs(value)), 4) AS mae, count(*) AS n FROM events")
def _(t: Tables):
    s = stream(t).withColumn("zero", F.lit(0.0))
    return rounded(streams.drain(streams.running_metrics(s, "value", "zero"), name(), "complete"), 4, mse=3)


@query("X5_streaming_kalman", KALMAN.replace("value / 100 AS v", "value AS v"))
def _(t: Tables):
    s = stream(t)
    done = streams.drain(streams.kalman(s, "user_id", ["ts", "event_id"], "value", 0.1, 0.5), name(), "update")
    last = done.groupBy("user_id").agg(F.max_by(F.struct("n", "mean", "variance"), "n").alias("l"))
    return rounded(last.select("user_id", "l.n", "l.mean", "l.variance"))


@query("X3_streaming_lags", """
    SELECT event_id, user_id, [a, b] AS features, value AS target FROM (
        SELECT event_id, user_id, value, lag(value, 2) OVER w AS a, lag(value) OVER w AS b, row_number() OVER w AS r FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE r > 2""")
def _(t: Tables):
    return streams.drain(streams.lag_features(stream(t), "user_id", ["ts", "event_id"], "value", 2), name(), "append").drop("ts")


@query("EX6_autoregression")
def _(t: Tables):
    rows = ordered.delta_features(t.events, "value", 2, 0, ["ts", "event_id"], ["user_id"])
    m = glm.ridge(rows, [F.col("features")[0], F.col("features")[1]], F.col("target"))
    return rounded(metrics.regression_metrics(m.predict(rows).select("score", F.col("target").alias("label"))), 4)
