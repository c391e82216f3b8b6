"""Queries over scalar functions, bases, scalers, encoders and kernels."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import bases, kernels, scalar
from lodestone.operators import pipes, scalers
from lodestone.plans import gram
from lodestone.queries.registry import Tables, query
from lodestone.queries.statistics import rounded, rounded_items

# -- text --------------------------------------------------------------------------------------------


@query("F1_replace", "SELECT c_custkey, regexp_replace(c_name, '0+', 'x', 'g') AS value FROM customer")
def _(t: Tables):
    return pipes.replaced("0+", "x")(t.customer.select("c_custkey", F.col("c_name").alias("value")))


@query("F2_white_space", "SELECT doc_id, length(regexp_replace(text, '[ \\t\\n\\v\\f\\r]+', ',', 'g')) AS n FROM documents")
def _(t: Tables):
    return pipes.white_to_commas()(t.documents.select("doc_id", F.col("text").alias("value"))).select("doc_id", F.length("value").cast("long").alias("n"))


@query("F3_trim_split", "SELECT n_nationkey, [n_name, CAST(n_regionkey AS VARCHAR)] AS fields FROM nation")
def _(t: Tables):
    raw = t.nation.select("n_nationkey", F.concat(F.lit("  "), F.concat_ws(",", "n_name", "n_regionkey"), F.lit(",, ")).alias("value"))
    return (pipes.trimmed() >> pipes.split_lines())(raw).select("n_nationkey", "fields")


@query("F32_dates", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS text FROM orders")
def _(t: Tables):
    form = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "MM/dd/yyyy")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    d = scalar.parse_date(form)
    return t.orders.select("o_orderkey", scalar.date_text(d).alias("text"))


@query("F33_typed_values", "SELECT p_partkey, p_size AS n, CAST(NULL AS DOUBLE) AS bad, p_size * 60.0 AS seconds FROM part")
def _(t: Tables):
    s = F.col("p_size").cast("string")
    return t.part.select("p_partkey", scalar.parse(s, "int").alias("n"), scalar.parse(F.col("p_name"), "double").alias("bad"), scalar.parse_duration(F.concat(s, F.lit(" minutes"))).alias("seconds"))


@query("F34_collections", "SELECT n_nationkey, [n_nationkey, n_regionkey, n_nationkey] AS items, list_sort(list_distinct([n_nationkey, n_regionkey])) AS distinct_items, n_name AS name FROM nation")
def _(t: Tables):
    text = F.concat_ws(",", "n_nationkey", "n_regionkey", "n_nationkey")
    named = F.concat(F.lit("k:"), F.col("n_name"), F.lit(",z:1"))
    return t.nation.select("n_nationkey", scalar.parse_list(text, "int").alias("items"), scalar.parse_set(text, "int").alias("distinct_items"), scalar.parse_map(named)["k"].alias("name"))


# -- numbers -----------------------------------------------------------------------------------------


@query("F5_F6_ranges", "SELECT n_nationkey, round(n_nationkey / 4, 6) AS step, CAST(5 AS BIGINT) AS closed, CAST(4 AS BIGINT) AS half_open FROM nation")
def _(t: Tables):
    n = F.col("n_nationkey").cast("double")
    closed, half = scalar.numeric_range(F.lit(0.0), n, 4), scalar.open_range(F.lit(0.0), n, 4)
    return t.nation.select("n_nationkey", F.round(half[1], 6).alias("step"), F.size(closed).cast("long").alias("closed"), F.size(half).cast("long").alias("half_open"))


X = "(SELECT event_id, sin(value) AS x FROM events)"


def x(t: Tables):
    return t.events.select("event_id", F.sin("value").alias("x"))


@query("F7_F15_elementary", f"SELECT event_id, round(x + ln(1 + exp(-x)), 6) AS soft, round(x * x, 6) AS square, CASE WHEN x < -0.5 THEN 0 ELSE 1.5 END AS harmonic FROM {X}")
def _(t: Tables):
    c = F.col("x")
    return rounded(x(t).select("event_id", scalar.log1p_exp(c).alias("soft"), scalar.square(c).alias("square"), scalar.harmonic(F.when(c < -0.5, 0.0).otherwise(2.5)).alias("harmonic")))


@query("F8_F10_polynomials", f"""
    SELECT event_id, round(4 * x * x * x - 3 * x, 6) AS chebyshev_t, round(8 * x * x * x - 4 * x, 6) AS chebyshev_u, round(x * x * x - 3 * x, 6) AS hermite,
           round((5 * x * x * x - 3 * x) / 2, 6) AS legendre, round(x * x / 2 - 2.5 * x + 1.875, 4) AS laguerre FROM {X}""")
def _(t: Tables):
    c = F.col("x")
    return rounded(x(t).select("event_id", scalar.chebyshev(3, c).alias("chebyshev_t"), scalar.chebyshev(3, c, 2).alias("chebyshev_u"), scalar.hermite(3, c).alias("hermite"), scalar.legendre(3, c).alias("legendre"), scalar.laguerre(2, 0.5, c).alias("laguerre")), laguerre=4)


@query("F12_factorial", "SELECT n_nationkey, CAST(factorial(n_nationkey % 20) AS BIGINT) AS f FROM nation")
def _(t: Tables):
    return t.nation.select("n_nationkey", F.factorial(F.col("n_nationkey") % 20).alias("f"))


@query("F13_probit_round_trip", "SELECT event_id, round((sin(value) + 1.2) / 2.4, 6) AS p FROM events")
def _(t: Tables):
    p = (F.sin("value") + 1.2) / 2.4
    return rounded(t.events.select("event_id", scalar.normal_cdf(scalar.probit(p)).alias("p")))


@query("F14_multivariate_lgamma", "SELECT n_nationkey, round(0.5 * ln(pi()) + lgamma(n_nationkey + 2) + lgamma(n_nationkey + 1.5), 6) AS v FROM nation")
def _(t: Tables):
    return rounded(t.nation.select("n_nationkey", scalar.multivariate_lgamma(2, F.col("n_nationkey") + F.lit(2.0)).alias("v")))


@query("F16_haversine", "SELECT n_nationkey, round(2 * 6371 * atan2(sqrt(a), sqrt(1 - a)), 4) AS km FROM (SELECT n_nationkey, pow(sin(radians(n_nationkey - 10) / 2), 2) + cos(radians(10)) * cos(radians(n_nationkey)) * pow(sin(radians(n_regionkey * 10) / 2), 2) AS a FROM nation)")
def _(t: Tables):
    d = scalar.haversine(F.lit(10.0), F.lit(0.0), F.col("n_nationkey").cast("double"), F.col("n_regionkey") * 10.0)
    return rounded(t.nation.select("n_nationkey", d.alias("km")), 4)


@query("F17_activations", f"""
    SELECT event_id, round(1 / (1 + exp(-x)), 6) AS sigmoid, round(tanh(x), 6) AS tanh, round(greatest(x, 0), 6) AS relu,
           round(1.0507009873554805 * CASE WHEN x > 0 THEN x ELSE 1.6732632423543772 * (exp(x) - 1) END, 6) AS selu, round(1 - pow(tanh(x), 2), 6) AS tanh_slope FROM {X}""")
def _(t: Tables):
    c = F.col("x")
    named = [scalar.activation(k)(c).alias(k) for k in ("sigmoid", "tanh", "relu", "selu")]
    return rounded(x(t).select("event_id", *named, scalar.ACTIVATIONS["tanh"][1](c).alias("tanh_slope")))


@query("F26_dual_numbers", f"SELECT event_id, round(x * (x + 3), 6) AS value, round(2 * x + 3, 6) AS slope FROM {X}")
def _(t: Tables):
    d = scalar.dual(F.col("x"), F.lit(1.0))
    p = scalar.dual_multiply(d, scalar.dual_add(d, scalar.dual(F.lit(3.0), F.lit(0.0))))
    return rounded(x(t).select("event_id", p["a"].alias("value"), p["b"].alias("slope")))


@query("F27_vector_field", "SELECT vec_id, round(list_dot_product(CAST(embedding AS DOUBLE[]), list_transform(CAST(embedding AS DOUBLE[]), lambda v: 2 * v + v * v)), 6) AS v FROM embeddings")
def _(t: Tables):
    e = F.col("embedding").cast("array<double>")
    return rounded(t.embeddings.select("vec_id", scalar.dot(e, scalar.vector_add(scalar.vector_scale(e, 2), scalar.vector_multiply(e, e))).alias("v")))


@query("F28_push_forward", f"SELECT event_id, round(exp(-pow(ln(x + 2), 2) / 2) / sqrt(2 * pi()) / (x + 2), 6) AS density FROM {X}")
def _(t: Tables):
    lognormal = scalar.Map1(F.exp, F.log, F.exp).push_density(lambda v: F.exp(-v * v / 2) / (2 * 3.141592653589793) ** 0.5)
    return rounded(x(t).select("event_id", lognormal(F.col("x") + 2).alias("density")))


# -- bases -------------------------------------------------------------------------------------------


@query("F19_fourier", f"SELECT event_id, [round(v, 6) + 0.0 for v in [1.0, cos(-2 * pi() * x), sin(2 * pi() * x)]] AS phi FROM {X}")
def _(t: Tables):
    return x(t).select("event_id", rounded_items(bases.fourier(1.0, 1)(F.col("x"))).alias("phi"))


@query("F19_polynomial_bernstein", f"SELECT event_id, round(list_sum([1.0, x, x * x, x * x * x]), 6) AS polynomial, round(2.0, 6) AS bernstein, round(1 + x + 2 * x * x - 1, 6) AS chebyshev FROM {X}")
def _(t: Tables):
    c = F.col("x")
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    return rounded(x(t).select("event_id", total(bases.polynomial(3)(c)).alias("polynomial"), total(bases.bernstein(4)(c)).alias("bernstein"), total(bases.chebyshev(2)(c)).alias("chebyshev")))


@query("F20_b_splines", f"SELECT event_id, CASE WHEN v >= 2 AND v < 3 THEN 1.0 END AS unity, round(CASE WHEN v < 1 THEN v ELSE 0 END, 6) AS first FROM (SELECT event_id, (x + 1) / 2 * 2.999 AS v FROM {X})")
def _(t: Tables):
    v = (F.col("x") + 1) / 2 * 2.999
    linear, square = bases.b_splines([0.0, 0.0, 1.0, 2.0, 3.0, 3.0], 1)(v), bases.cardinal_spline(0)(v)
    total = F.aggregate(linear, F.lit(0.0), lambda s, b: s + b)
    return rounded(x(t).select("event_id", F.when((v >= 2) & (v < 3), total).alias("unity"), F.when(v < 1, linear[1]).otherwise(F.lit(0.0) * square[0]).alias("first")))


@query("F21_radial", "SELECT vec_id, round(exp(-r * r / 2), 6) AS gaussian, round(exp(-r), 6) AS laplacian, round(sqrt(1 + r * r), 6) AS multiquadric, round((1 + sqrt(3) * r) * exp(-sqrt(3) * r), 6) AS matern FROM (SELECT vec_id, sqrt(list_sum([pow(v, 2) for v in CAST(embedding AS DOUBLE[])]) - embedding[1]::DOUBLE + 0.25) / 2 AS r FROM embeddings)")
def _(t: Tables):
    e = F.col("embedding").cast("array<double>")
    one = lambda k, p=0.5: bases.radial(k, [[0.5, *[0.0] * 63]], 2.0, p)(e)[0].alias(k)
    return rounded(t.embeddings.select("vec_id", one("gaussian"), one("laplacian"), one("multiquadric"), one("matern", 1)))


@query("F22_tensor_basis", f"SELECT event_id, [round(v, 6) for v in [1.0, x, x, x * x]] AS phi FROM {X}")
def _(t: Tables):
    p = bases.polynomial(1)
    return x(t).select("event_id", rounded_items(bases.tensor(p, p)(F.col("x"), F.col("x"))).alias("phi"))


@query("F23_quadrature", f"SELECT event_id, round(2 * x / 3 + 2, 6) AS integral FROM {X}")
def _(t: Tables):
    return rounded(x(t).select("event_id", bases.integrate(lambda u: F.col("x") * u * u + 1, bases.gauss_legendre(4)).alias("integral")))


@query("F24_haar", "SELECT vec_id, round(list_sum(CAST(embedding AS DOUBLE[])) / 8, 6) AS mean, round(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda v: v * v)), 6) AS energy, round((embedding[63]::DOUBLE - embedding[64]::DOUBLE) / sqrt(2), 6) AS last FROM embeddings")
def _(t: Tables):
    w = t.embeddings.select("vec_id", bases.haar(F.col("embedding").cast("array<double>"), 6).alias("y"))
    return rounded(w.select("vec_id", F.col("y")[0].alias("mean"), scalar.dot(F.col("y"), F.col("y")).alias("energy"), F.col("y")[63].alias("last")))


@query("F24_haar_inverse", "SELECT vec_id, [round(v, 6) for v in CAST(embedding AS DOUBLE[])] AS back FROM embeddings")
def _(t: Tables):
    e = F.col("embedding").cast("array<double>")
    y = t.embeddings.select("vec_id", F.flatten(bases.grouped_haar(e, 6)).alias("y"))
    # back in the precision of the input, which leaves the very values that came in
    return y.select("vec_id", rounded_items(bases.inverse_haar(F.col("y"), 6).cast("array<float>").cast("array<double>")).alias("back"))


@query("F25_wavelet", f"SELECT event_id, round(CASE WHEN u >= 0 AND u < 0.5 THEN 1 WHEN u >= 0.5 AND u < 1 THEN -1 ELSE 0 END / sqrt(2), 6) AS psi FROM (SELECT event_id, (x + 1) / 2 AS u FROM {X})")
def _(t: Tables):
    return rounded(x(t).select("event_id", bases.wavelet(bases.haar_mother)(2.0, -1.0)(F.col("x")).alias("psi")))


# -- scalers and encoders ------------------------------------------------------------------------------

V = "(SELECT l_orderkey, l_linenumber, l_quantity AS a, l_extendedprice AS b FROM lineitem)"


def v(t: Tables):
    return t.lineitem.select("l_orderkey", "l_linenumber", F.array("l_quantity", "l_extendedprice").alias("x"))


def cells(df):
    return rounded(df.select("l_orderkey", "l_linenumber", F.col("x")[0].alias("a"), F.col("x")[1].alias("b")), 5)


@query("C1_gaussian_scaler", f"SELECT l_orderkey, l_linenumber, round((a - avg(a) OVER ()) / stddev_samp(a) OVER (), 5) AS a, round((b - avg(b) OVER ()) / stddev_samp(b) OVER (), 5) AS b FROM {V}")
def _(t: Tables):
    return cells(scalers.fit(v(t), "x", "gaussian").apply(v(t), "x"))


@query("C1_gaussian_round_trip", f"SELECT l_orderkey, l_linenumber, round(a, 5) AS a, round(b, 2) AS b FROM {V}")
def _(t: Tables):
    s = scalers.fit(v(t), "x", "gaussian")
    return rounded(s.invert(s.apply(v(t), "x"), "x").select("l_orderkey", "l_linenumber", F.col("x")[0].alias("a"), F.col("x")[1].alias("b")), 5, b=2)


@query("C2_whitening", "SELECT 1.0 AS v0, 1.0 AS v1, 0.0 AS c")
def _(t: Tables):
    w = scalers.fit(v(t), "x", "whitening").apply(v(t), "x")
    a, b = F.col("x")[0], F.col("x")[1]
    return w.agg(F.round(F.var_samp(a), 6).alias("v0"), F.round(F.var_samp(b), 6).alias("v1"), F.abs(F.round(F.covar_samp(a, b), 6)).alias("c"))


@query("C4_mean_scaler", f"SELECT l_orderkey, l_linenumber, round(a - avg(a) OVER (), 2) AS a, round(b - avg(b) OVER (), 1) AS b FROM {V}")
def _(t: Tables):
    s = scalers.fit(v(t), "x", "mean").apply(v(t), "x")
    return rounded(s.select("l_orderkey", "l_linenumber", F.col("x")[0].alias("a"), F.col("x")[1].alias("b")), 2, b=1)


@query("C5_min_max_scaler", f"SELECT l_orderkey, l_linenumber, round((a - min(a) OVER ()) / (max(a) OVER () - min(a) OVER ()), 5) AS a, round((b - min(b) OVER ()) / (max(b) OVER () - min(b) OVER ()), 5) AS b FROM {V}")
def _(t: Tables):
    return cells(scalers.fit(v(t), "x", "minmax").apply(v(t), "x"))


@query("C6_pca", "SELECT CAST(2 AS BIGINT) AS components, 0.0 AS correlation")
def _(t: Tables):
    p = scalers.fit(v(t), "x", "pca").apply(v(t), "x")
    return p.agg(F.max(F.size("x")).cast("long").alias("components"), F.abs(F.round(F.corr(F.col("x")[0], F.col("x")[1]), 5)).alias("correlation"))


@query("C6_compressed_pca", "SELECT CAST(1 AS BIGINT) AS components")
def _(t: Tables):
    return scalers.fit(v(t), "x", "pca", share=0.5).apply(v(t), "x").agg(F.max(F.size("x")).cast("long").alias("components"))


@query("C7_probit_scaler", "SELECT event_id, round(sin(value), 5) AS back FROM events")
def _(t: Tables):
    s = scalers.probit_scaler
    return rounded(s.invert(s.apply(x(t).select("event_id", F.array("x").alias("x")), "x"), "x").select("event_id", F.col("x")[0].alias("back")), 5)


@query("C9_train_test_scaling", "WITH s AS (SELECT avg(value) AS m, stddev_samp(value) AS d FROM events WHERE event_id % 5 < 4) SELECT event_id, round((value - m) / d, 5) AS z FROM events, s")
def _(t: Tables):
    split = pipes.split_flag(F.col("event_id") % 5 < 4)(t.events.select("event_id", F.array("value").alias("x")))
    return rounded(scalers.fit_split(split, ["x"], "gaussian")[0].select("event_id", F.col("x")[0].alias("z")), 5)


@query("C12_composed_scalers", "SELECT event_id, round(((value - 50) / 10 + 1) / 2, 6) AS z FROM events")
def _(t: Tables):
    s = scalers.univariate_gaussian(50.0, 10.0) >> scalers.univariate_centred(-1.0) >> scalers.univariate_gaussian(0.0, 2.0)
    return rounded(s.apply(t.events.select("event_id", F.col("value").alias("z")), "z"))


@query("C14_mixed_radix", "SELECT n_nationkey, CAST(n_regionkey + 5 * (n_nationkey % 7) AS BIGINT) AS code, [n_regionkey, n_nationkey % 7] AS digits FROM nation")
def _(t: Tables):
    e = scalers.mixed_radix([5, 7])
    code = e.encode(F.array("n_regionkey", F.col("n_nationkey") % 7))
    return t.nation.select("n_nationkey", code.alias("code")).withColumn("digits", e.decode(F.col("code")))


@query("C15_map_vector", "SELECT n_nationkey, [CAST(n_nationkey AS DOUBLE), n_regionkey] AS v FROM nation")
def _(t: Tables):
    e = scalers.map_vector(["b", "a"])
    m = F.create_map(F.lit("a"), F.col("n_regionkey").cast("double"), F.lit("b"), F.col("n_nationkey").cast("double"))
    return t.nation.select("n_nationkey", e.encode(e.decode(e.encode(m))).alias("v"))


@query("C16_replication", "SELECT n_nationkey, [n_nationkey, n_nationkey, n_nationkey] AS r, [n_nationkey, n_regionkey, 1] AS back FROM nation")
def _(t: Tables):
    three, two = scalers.replicate(3), scalers.chunked(2)
    a = F.array("n_nationkey", "n_regionkey", F.lit(1))
    return t.nation.select("n_nationkey", three.encode(F.col("n_nationkey")).alias("r"), two.decode(two.encode(a)).alias("back"))


# -- kernels -------------------------------------------------------------------------------------------

#: The first half of each vector against the second; s2, s1, d, xx, yy as the SQL sees them.
PAIRS = """(SELECT vec_id, list_sum([p * p for p in dl]) AS s2, list_sum([abs(p) for p in dl]) AS s1, list_dot_product(a, b) AS d, list_dot_product(a, a) AS xx, list_dot_product(b, b) AS yy, dl FROM (
    SELECT vec_id, a, b, [z[1] - z[2] for z in list_zip(a, b)] AS dl FROM (SELECT vec_id, CAST(embedding[1:32] AS DOUBLE[]) AS a, CAST(embedding[33:64] AS DOUBLE[]) AS b FROM embeddings)))"""

KERNELS = {
    "N1_rbf": (kernels.rbf(2.0), "exp(-s2 / 8)"),
    "N2_se": (kernels.se(2.0, 1.5), "2.25 * exp(-s2 / 8)"),
    "N3_mahalanobis": (kernels.mahalanobis([2.0] * 32), "exp(-s2 / 8)"),
    "N5_laplacian": (kernels.laplacian(3.0), "exp(-s1 / 3)"),
    "N6_cauchy": (kernels.cauchy(2.0), "1 / (1 + s2 / 4)"),
    "N7_rational_quadratic": (kernels.rational_quadratic(2.0, 3.0), "pow(1 + s2 / 12, -17.5)"),
    "N8_student_t": (kernels.student_t(3.0), "1 / (1 + pow(sqrt(s2), 3))"),
    "N9_polynomial": (kernels.polynomial(2.0, 0.5), "pow(d + 0.5, 2)"),
    "N10_linear": (kernels.linear(1.0), "d + 1"),
    "N11_periodic": (kernels.periodic(2.0, 0.25), "exp(-2 * pow(sin(pi() * 0.25 * s1), 2) / 4)"),
    "N12_wave": (kernels.wave(2.0), "CASE WHEN s2 = 0 THEN 1 ELSE sin(sqrt(s2) / 2) * 2 / sqrt(s2) END"),
    "N15_fbm": (kernels.fbm(0.55), "(pow(xx, 0.55) + pow(yy, 0.55) - pow(s2, 0.55)) / 2"),
    "N16_mlp": (kernels.mlp(0.5, 1.0), "asin((0.5 * d + 1) / sqrt((0.5 * xx + 2) * (0.5 * yy + 2)))"),
    "N18_exponential": (kernels.exponential(0.7), "exp(0.7 * d / sqrt(xx * yy))"),
    "N19_generalised_exponential": (kernels.generalised_exponential(2.0), "exp(-sqrt(s2) / 4)"),
    "N20_matern": (kernels.matern(2.0, 1), "(1 + sqrt(3) * sqrt(s2) / 2) * exp(-sqrt(3) * sqrt(s2) / 2)"),
    "N23_dirac": (kernels.dirac(0.3), "CASE WHEN s2 = 0 THEN 0.3 ELSE 0 END"),
    "N25_sum": (kernels.plus(kernels.rbf(2.0), kernels.linear()), "exp(-s2 / 8) + d"),
    "N25_product": (kernels.times(kernels.rbf(2.0), kernels.laplacian(3.0)), "exp(-s2 / 8) * exp(-s1 / 3)"),
    "N25_scaled": (kernels.scaled(kernels.cauchy(2.0), 3.0), "3 / (1 + s2 / 4)"),
    "N25_rbf_of_linear": (kernels.rbf_of(kernels.linear(), 2.0), "exp(-(xx + yy - 2 * d) / 8)"),
    "N25_feature_map": (kernels.mapped(lambda c: F.transform(c, lambda a: 2 * a)), "4 * d"),
    "N26_rbf_gradient": (kernels.GRADIENTS["rbf"](2.0)["b"], "exp(-s2 / 8) * s2 / 8"),
}


def vectors(t: Tables):
    return t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("x"))


def register(name, kernel, sql):
    @query(name, f"SELECT vec_id, round({sql}, 6) AS k FROM {PAIRS}")
    def _(t: Tables):
        e = F.col("embedding").cast("array<double>")
        return t.embeddings.select("vec_id", F.round(kernel(F.slice(e, 1, 32), F.slice(e, 33, 32)), 6).alias("k"))


for _name, (_kernel, _sql) in KERNELS.items():
    register(_name, _kernel, _sql)


@query("N27_kernel_matrix", "SELECT x.vec_id AS i, y.vec_id AS j, round(exp(-list_sum([pow(z[1] - z[2], 2) for z in list_zip(CAST(x.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[]))]) / 8), 6) AS v FROM embeddings x, embeddings y")
def _(t: Tables):
    # an eighth holds 125,000 values of six digits: a Parquet dictionary of 1 MB has room for 131,072
    return rounded(kernels.dense_matrix(vectors(t), gram.kernel("rbf", b=2.0), cuts=tuple(k / 8 for k in range(1, 8))))


@query("J5_cross_matrix", "SELECT x.vec_id AS i, y.n_nationkey AS j, round(exp(-list_sum([pow(v - y.n_regionkey / 10, 2) for v in CAST(x.embedding AS DOUBLE[])]) / 128), 6) AS v FROM embeddings x, nation y")
def _(t: Tables):
    a = t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("x"))
    b = t.nation.select(F.col("n_nationkey").alias("id"), F.array_repeat(F.col("n_regionkey") / 10.0, 64).alias("x"))
    return rounded(kernels.cross_matrix(a, b, kernels.rbf(8.0)))


@query("N25_kronecker", "SELECT n_nationkey, round(exp(-pow(n_nationkey, 2)) * exp(-pow(n_regionkey, 2) / 2), 6) AS k FROM nation")
def _(t: Tables):
    k = kernels.kronecker(kernels.coregional_rbf(1.0), kernels.rbf(1.0))
    s = lambda a, b: F.struct(a.alias("_1"), F.array(b).alias("_2"))
    left = s(F.col("n_nationkey").cast("double"), F.col("n_regionkey").cast("double"))
    return rounded(t.nation.select("n_nationkey", k(left, s(F.lit(0.0), F.lit(0.0))).alias("k")))


@query("N29_density", f"SELECT event_id, round(exp(-x * x / 2) / sqrt(2 * pi()), 6) AS k, round(-x * exp(-x * x / 2) / sqrt(2 * pi()), 6) AS slope FROM {X}")
def _(t: Tables):
    c = F.col("x")
    return rounded(x(t).select("event_id", kernels.density(1.0)(c).alias("k"), kernels.density(1.0, 1)(c).alias("slope")))
