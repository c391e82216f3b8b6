"""Queries over aggregates, histograms and evaluation metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import metrics, stats
from lodestone.queries.registry import Tables, query


def rounded(df, digits: int = 6, **special: int):
    """Floating columns rounded, so that both engines' last bits don't matter."""
    return df.select(*(F.round(c, special.get(c, digits)).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes))


def rounded_items(c, digits: int = 6):
    """An array's numbers rounded; as in DuckDB, those that round to zero from below are -0.0."""

    def one(v):
        r = F.round(v, digits)
        return F.when((r == 0) & v.cast("string").startswith("-"), F.lit(-0.0)).otherwise(r)

    return F.transform(c, one)


# -- aggregates ------------------------------------------------------------------------------------


@query("A1_reduce", "SELECT round(sum(value), 4) AS total, max(value) AS top FROM events")
def _(t: Tables):
    return t.events.agg(F.round(F.sum("value"), 4).alias("total"), F.max("value").alias("top"))


@query("A2_reducers", "SELECT vec_id, round(list_sum(e), 6) AS total, round(list_product([1 + x / 10 for x in e]), 6) AS product, round(list_sum([z[1] * z[2] for z in list_zip(e, [i + 1.0 for i in range(64)])]), 6) AS weighted FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)")
def _(t: Tables):
    e = F.col("embedding").cast("array<double>")
    return rounded(t.embeddings.select("vec_id", stats.array_sum(e).alias("total"), stats.array_product(F.transform(e, lambda x: 1 + x / 10)).alias("product"), stats.array_weighted(e, F.array(*(F.lit(k + 1.0) for k in range(64)))).alias("weighted")))


@query("A3_dimension_stats", "SELECT CAST(d AS INTEGER) AS dim, count(x) AS n, round(avg(x), 6) AS mean, round(var_samp(x), 6) AS variance, min(x) AS min, max(x) AS max FROM (SELECT unnest(range(64)) AS d, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) GROUP BY d")
def _(t: Tables):
    d = stats.dimension_stats(t.embeddings, "embedding")
    return d.select("dim", "n", F.round("mean", 6).alias("mean"), F.round("variance", 6).alias("variance"), "min", "max")


@query("A4_covariance", """
    SELECT i, j, round(c, 4) AS covariance FROM (
        SELECT 0 AS i, 0 AS j, covar_samp(l_quantity, l_quantity) AS c FROM lineitem UNION ALL SELECT 0, 1, covar_samp(l_quantity, l_discount) FROM lineitem
        UNION ALL SELECT 1, 0, covar_samp(l_quantity, l_discount) FROM lineitem UNION ALL SELECT 1, 1, covar_samp(l_discount, l_discount) FROM lineitem)""")
def _(t: Tables):
    return rounded(stats.covariance(t.lineitem, ["l_quantity", "l_discount"]), 4)


@query("A5_min_max", """
    SELECT 'l_quantity' AS name, round(avg(l_quantity), 6) AS mean, round(var_samp(l_quantity), 6) AS variance, min(l_quantity) AS min, max(l_quantity) AS max FROM lineitem
    UNION ALL SELECT 'l_discount', round(avg(l_discount), 6), round(var_samp(l_discount), 6), min(l_discount), max(l_discount) FROM lineitem""")
def _(t: Tables):
    return rounded(stats.column_stats(t.lineitem, ["l_quantity", "l_discount"]))


@query("A6_quickselect", "SELECT l_extendedprice AS value FROM (SELECT l_extendedprice, row_number() OVER (ORDER BY l_extendedprice) AS r FROM lineitem) WHERE r = 1000")
def _(t: Tables):
    return stats.quickselect(t.lineitem, "l_extendedprice", 1000)


@query("A7_median", "SELECT event_type, median(value) AS median FROM events GROUP BY event_type")
def _(t: Tables):
    return stats.median(t.events, "value", ["event_type"])


@query("A11_tied_ranks", "SELECT l_quantity, round(avg(r), 1) AS rank FROM (SELECT l_quantity, row_number() OVER (ORDER BY l_quantity) AS r FROM lineitem) GROUP BY l_quantity")
def _(t: Tables):
    return stats.ranks(t.lineitem.select("l_quantity"), "l_quantity").distinct().select("l_quantity", F.round("rank", 1).alias("rank"))


@query("A12_distinct", "SELECT count(DISTINCT user_id) AS users, count(*) AS rows FROM events")
def _(t: Tables):
    return t.events.agg(F.countDistinct("user_id").alias("users"), F.count("*").alias("rows"))


@query("A13_gram", "SELECT round(sum(l_quantity * l_quantity), 2) AS xx, round(sum(l_quantity * l_discount), 2) AS xz, round(sum(l_discount * l_discount), 2) AS zz, round(sum(l_quantity * l_tax), 2) AS xy, round(sum(l_discount * l_tax), 2) AS zy, count(*) AS n FROM lineitem")
def _(t: Tables):
    g = stats.gram(t.lineitem, [F.col("l_quantity"), F.col("l_discount")], F.col("l_tax"))
    r = lambda c: F.round(c, 2)
    return g.select(r(F.col("xx")[0]).alias("xx"), r(F.col("xx")[1]).alias("xz"), r(F.col("xx")[2]).alias("zz"), r(F.col("xy")[0]).alias("xy"), r(F.col("xy")[1]).alias("zy"), "n")


@query("A14_histogram", """
    WITH b AS (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi, (max(l_quantity) - min(l_quantity)) / 7 AS w FROM lineitem),
    c AS (SELECT CAST(floor((l_quantity - lo) / w) AS INTEGER) AS bin, count(*) AS n FROM lineitem, b GROUP BY 1)
    SELECT CAST(i AS INTEGER) AS bin, printf('%.2f - %.2f', i * w + lo, i * w + lo + w) AS label, coalesce(n, 0) AS count
    FROM b, range(8) r(i) LEFT JOIN c ON c.bin = i""")
def _(t: Tables):
    return stats.histogram(t.lineitem, "l_quantity", 7)


@query("A15_bin_labels", "SELECT n_regionkey || ' - ' || n_nationkey AS label, n_name FROM nation")
def _(t: Tables):
    return t.nation.select(stats.bin_labels("n_regionkey", "n_nationkey").alias("label"), "n_name")


@query("A16_histogram_2d", """
    WITH b AS (SELECT min(l_quantity) AS x0, (max(l_quantity) - min(l_quantity)) / 5 AS xw, min(l_discount) AS y0, (max(l_discount) - min(l_discount)) / 5 AS yw FROM lineitem)
    SELECT CAST(least(floor((l_quantity - x0) / xw), 4) AS INTEGER) AS i, CAST(least(floor((l_discount - y0) / yw), 4) AS INTEGER) AS j, count(*) AS count
    FROM lineitem, b GROUP BY 1, 2""")
def _(t: Tables):
    return stats.histogram_2d(t.lineitem, "l_quantity", "l_discount", 5)


@query("A17_line_fit", "SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept, round(1 - (1 - regr_r2(l_extendedprice, l_quantity)) * (count(*) - 1) / (count(*) - 2), 6) AS adjusted_r2 FROM lineitem")
def _(t: Tables):
    f = stats.line_fit(t.lineitem, "l_quantity", "l_extendedprice")
    return f.select(F.round("slope", 4).alias("slope"), F.round("intercept", 3).alias("intercept"), F.round("adjusted_r2", 6).alias("adjusted_r2"))


@query("A19_expectation", "SELECT round(avg(value * value), 4) AS expectation FROM events")
def _(t: Tables):
    return rounded(stats.expectation(t.events, F.col("value") ** 2), 4)


@query("A20_cube", "SELECT event_type, CAST(month(ts) AS INTEGER) AS month, count(*) AS n FROM events GROUP BY CUBE (event_type, CAST(month(ts) AS INTEGER))")
def _(t: Tables):
    return t.events.select("event_type", F.month("ts").alias("month")).cube("event_type", "month").agg(F.count("*").alias("n"))


# -- metrics ---------------------------------------------------------------------------------------

SCORES = "(SELECT l_orderkey, l_quantity * 1500 AS score, l_extendedprice AS label FROM lineitem)"


def scores(t: Tables):
    return t.lineitem.select("l_orderkey", (F.col("l_quantity") * 1500).alias("score"), F.col("l_extendedprice").alias("label"))


METRICS = f"""
    SELECT round(avg(abs(score - label)), 3) AS mae, round(sqrt(avg(pow(score - label, 2))), 3) AS rmse,
           round(sqrt(avg(pow(ln(1 + abs(score)) - ln(1 + abs(label)), 2))), 6) AS rmsle, round(avg(pow(ln(1 + abs(score)) - ln(1 + abs(label)), 2)), 6) AS msle,
           round(1 - sum(pow(label - score, 2)) / sum(pow(label - m, 2)), 6) AS r2, round(corr(score, label), 6) AS pearson,
           round((max(score) - min(score)) / (max(label) - min(label)), 6) AS yield, round(avg(pow(score - label, 2)), 0) AS efficiency,
           round(sqrt(var_samp(label - score) / (count(*) - 1)), 4) AS sigma_ref, round(stddev_samp(label - score), 3) AS sigma, count(*) AS n
    FROM {SCORES}, (SELECT avg(label) AS m FROM {SCORES})"""


def rounded_metrics(df):
    return rounded(df, mae=3, rmse=3, efficiency=0, sigma_ref=4, sigma=3)


@query("E1_E9_regression_metrics", METRICS)
def _(t: Tables):
    return rounded_metrics(metrics.regression_metrics(scores(t)))


@query("E6_spearman", f"SELECT round(corr(a, b), 6) AS spearman FROM (SELECT rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS a, rank() OVER (ORDER BY label) + (count(*) OVER (PARTITION BY label) - 1) / 2 AS b FROM {SCORES})")
def _(t: Tables):
    return rounded(metrics.spearman(scores(t)))


@query("E10_residuals", f"SELECT round(label - score, 4) AS residual, round(score, 4) AS prediction FROM {SCORES}")
def _(t: Tables):
    return rounded(metrics.residuals(scores(t)), 4)


@query("E11_merge_and_json", f"SELECT '{{\"n\":' || 2 * count(*) || '}}' AS json FROM {SCORES}")
def _(t: Tables):
    return metrics.as_json(metrics.regression_metrics(metrics.merge_scores(scores(t), scores(t))).select("n"))


@query("E12_multi_output", """
    SELECT CAST(output AS INTEGER) AS output, round(avg(abs(p - y)), 6) AS mae, round(sqrt(avg(pow(p - y, 2))), 6) AS rmse, round(corr(p, y), 6) AS pearson, count(*) AS n FROM (
        SELECT unnest([0, 1]) AS output, unnest([l_quantity, l_discount]) AS p, unnest([l_quantity + l_tax, l_tax]) AS y FROM lineitem) GROUP BY output""")
def _(t: Tables):
    both = t.lineitem.select(F.array("l_quantity", "l_discount").alias("scores"), F.array(F.col("l_quantity") + F.col("l_tax"), F.col("l_tax")).alias("labels"))
    return rounded(metrics.multi_regression_metrics(both).select("output", "mae", "rmse", "pearson", "n"))


JUDGED = "(SELECT CAST(n_chars AS DOUBLE) / 1000 AS score, quality AS label FROM documents JOIN labels USING (doc_id))"


def judged(t: Tables):
    return t.documents.join(t.labels, "doc_id").select((F.col("n_chars").cast("double") / 1000).alias("score"), F.col("quality").alias("label"))


CURVE = f"""
    WITH s AS (SELECT * FROM {JUDGED}), b AS (SELECT min(score) AS lo, (trunc(max(score)) - trunc(min(score)) + 1) / 100 AS w FROM s),
    th AS (SELECT lo + i * w AS threshold FROM b, range(100) r(i)),
    c AS (SELECT threshold, count(*) FILTER (score > threshold AND label = 1) AS tp, count(*) FILTER (score > threshold AND label <> 1) AS fp,
                 count(*) FILTER (score <= threshold AND label <> 1) AS tn, count(*) FILTER (score <= threshold AND label = 1) AS fn FROM th, s GROUP BY threshold),
    r AS (SELECT *, tp / (tp + fn) AS tpr, fp / (fp + tn) AS fpr FROM c)"""


@query("E14_E16_rates", CURVE + " SELECT round(threshold, 6) AS threshold, tp, fp, tn, fn, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr, round(1 - fpr, 6) AS tnr, round(1 - tpr, 6) AS fnr FROM r")
def _(t: Tables):
    d = judged(t)
    return rounded(metrics.rates(d, metrics.thresholds(d)))


@query("E17_E21_curves", CURVE + """
    SELECT round(threshold, 6) AS threshold, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision, round(tpr, 6) AS recall,
           round(CASE WHEN 2 * tp + fn + fp > 0 THEN 2 * tp / (2 * tp + fn + fp) ELSE 0 END, 6) AS f,
           round(CASE WHEN tpr + fpr > 0 THEN tpr / (tpr + fpr) ELSE 0 END, 6) AS precision_ref,
           round(CASE WHEN 2 * tpr + 1 - tpr + fpr > 0 THEN 2 * tpr / (2 * tpr + 1 - tpr + fpr) ELSE 0 END, 6) AS f_ref,
           round((tp + tn) / (tp + fp + tn + fn), 6) AS accuracy,
           round(CASE WHEN CAST(tp + fp AS DOUBLE) * (tp + fn) * (tn + fp) * (tn + fn) > 0 THEN (tp * tn - fp * fn) / sqrt(CAST(tp + fp AS DOUBLE) * (tp + fn) * (tn + fp) * (tn + fn)) ELSE 0 END, 6) AS mcc
    FROM r""")
def _(t: Tables):
    d = judged(t)
    return rounded(metrics.binary_curve(d, metrics.thresholds(d)).select("threshold", "precision", "recall", "f", "precision_ref", "f_ref", "accuracy", "mcc"))


@query("E19_area_under_roc", CURVE + " SELECT round(sum(a), 6) AS area FROM (SELECT (fpr - lag(fpr) OVER w) * (tpr + lag(tpr) OVER w) / 2 AS a FROM r WINDOW w AS (ORDER BY fpr, tpr))")
def _(t: Tables):
    d = judged(t)
    return rounded(metrics.area_under(metrics.rates(d, metrics.thresholds(d)), "fpr", "tpr"))


@query("E20_binary_kpi", CURVE + """ SELECT (SELECT round(max((tp + tn) / (tp + fp + tn + fn)), 6) FROM r) AS accuracy, (SELECT round(max(CASE WHEN 2 * tp + fn + fp > 0 THEN 2 * tp / (2 * tp + fn + fp) ELSE 0 END), 6) FROM r) AS f,
    (SELECT round(sum(a), 6) FROM (SELECT (fpr - lag(fpr) OVER w) * (tpr + lag(tpr) OVER w) / 2 AS a FROM r WINDOW w AS (ORDER BY fpr, tpr))) AS auc""")
def _(t: Tables):
    d = judged(t)
    return rounded(metrics.binary_kpi(d, metrics.thresholds(d)))


@query("E22_supplied_bounds", f"SELECT round(threshold, 6) AS threshold, count(*) FILTER (score > threshold AND label = 1) AS tp FROM (SELECT i * 0.31e0 AS threshold FROM range(100) r(i)), {JUDGED} GROUP BY threshold")
def _(t: Tables):
    d = judged(t)
    return metrics.rates(d, metrics.thresholds(d, bounds=(0.0, 30.0))).select(F.round("threshold", 6).alias("threshold"), "tp")


@query("E25_confusion", "SELECT quality, toxic, count(*) AS weight FROM labels GROUP BY quality, toxic")
def _(t: Tables):
    return metrics.confusion(t.labels, "quality", "toxic")


@query("E25_fidelity", "SELECT round(count(*) FILTER (quality = toxic) / count(*), 6) AS fidelity FROM labels")
def _(t: Tables):
    return rounded(metrics.fidelity(t.labels, "quality", "toxic"))


DIST = "(SELECT list_transform(p, lambda x: x / list_sum(p)) AS p, list_transform(q, lambda x: x / list_sum(q)) AS q FROM (SELECT list_transform(CAST(embedding[1:32] AS DOUBLE[]), lambda x: x * x + 0.01) AS p, list_transform(CAST(embedding[33:64] AS DOUBLE[]), lambda x: x * x + 0.01) AS q FROM embeddings))"


@query("E27_divergences", f"""
    SELECT round(avg(list_sum(list_transform(z, lambda v: v[1] * ln(v[1] / v[2])))), 6) AS kl,
           round(avg(list_sum(list_transform(z, lambda v: (v[1] * ln(2 * v[1] / (v[1] + v[2])) + v[2] * ln(2 * v[2] / (v[1] + v[2]))) / 2))), 6) AS js,
           round(avg(sqrt(list_sum(list_transform(z, lambda v: pow(sqrt(v[1]) - sqrt(v[2]), 2)))) / sqrt(2)), 6) AS hellinger,
           round(avg(list_sum(list_transform(z, lambda v: -v[1] * ln(v[2])))), 6) AS cross_entropy
    FROM (SELECT list_zip(p, q) AS z FROM {DIST})""")
def _(t: Tables):
    e = F.transform(F.col("embedding").cast("array<double>"), lambda x: x * x + 0.01)
    unit = lambda c: F.transform(c, lambda x: x / stats.array_sum(c))
    d = t.embeddings.select(F.slice(e, 1, 32).alias("p"), F.slice(e, 33, 32).alias("q")).select(unit(F.col("p")).alias("p"), unit(F.col("q")).alias("q"))
    return rounded(metrics.divergences(d, "p", "q"))
