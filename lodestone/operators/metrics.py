"""Evaluation: regression, binary and multi-class metrics over (score, label) rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.ordered import lagged
from lodestone.operators.stats import ranks


def regression_metrics(df: DataFrame, p: str = "score", y: str = "label", by: list[str] | None = None) -> DataFrame:
    """All scalar metrics in one pass: R² from moments, so no second scan for the mean.

    ``msle`` is ``rmsle`` without its root. ``sigma_ref`` divides the sample variance of the residuals by n - 1 once more; ``sigma``
    is their standard deviation.
    """
    p_, y_ = F.col(p).cast("double"), F.col(y).cast("double")
    sse = F.sum((y_ - p_) ** 2)
    sst = F.var_pop(y_) * F.count(y_)
    log = F.log1p(F.abs(p_)) - F.log1p(F.abs(y_))
    return df.groupBy(*(by or [])).agg(
        F.avg(F.abs(p_ - y_)).alias("mae"),
        F.sqrt(F.avg((p_ - y_) ** 2)).alias("rmse"),
        F.sqrt(F.avg(log**2)).alias("rmsle"),
        F.avg(log**2).alias("msle"),
        F.when(sst > 0, 1 - sse / sst).alias("r2"),
        F.corr(p_, y_).alias("pearson"),
        F.try_divide(F.max(p_) - F.min(p_), F.max(y_) - F.min(y_)).alias("yield"),
        F.avg((p_ - y_) ** 2).alias("efficiency"),
        F.sqrt(F.try_divide(F.var_samp(y_ - p_), F.count("*") - 1)).alias("sigma_ref"),
        F.stddev_samp(y_ - p_).alias("sigma"),
        F.count("*").alias("n"),
    )


def residuals(df: DataFrame, p: str = "score", y: str = "label") -> DataFrame:
    return df.select((F.col(y) - F.col(p)).alias("residual"), F.col(p).alias("prediction"))


def spearman(df: DataFrame, p: str = "score", y: str = "label") -> DataFrame:
    """Pearson correlation of tie-averaged ranks."""
    return ranks(ranks(df.select(p, y), p, "__rp"), y, "__ry").agg(F.corr("__rp", "__ry").alias("spearman"))


def multi_regression_metrics(df: DataFrame, p: str = "scores", y: str = "labels") -> DataFrame:
    """The metrics of each output of array-valued predictions: (output, ...)."""
    long = df.select(F.posexplode(F.arrays_zip(F.col(p).alias("p"), F.col(y).alias("y"))).alias("output", "v"))
    return regression_metrics(long.select("output", F.col("v.p").alias("score"), F.col("v.y").alias("label")), by=["output"])


def multi_spearman(df: DataFrame, outputs: int, p: str = "scores", y: str = "labels") -> DataFrame:
    """(output, spearman) of array-valued predictions: each output's ranks are taken over all rows, in blocks."""
    out = None
    for k in range(outputs):
        one = spearman(df.select(F.col(p)[k].alias("score"), F.col(y)[k].alias("label"))).select(F.lit(k).alias("output"), "spearman")
        out = one if out is None else out.unionByName(one)
    return out


def merge_scores(a: DataFrame, b: DataFrame) -> DataFrame:
    """Metrics over both sets of scores are metrics of the union."""
    return a.unionByName(b)


def as_json(metrics: DataFrame) -> DataFrame:
    return metrics.select(F.to_json(F.struct("*")).alias("json"))


# -- binary ------------------------------------------------------------------------------------


def thresholds(df: DataFrame, score: str = "score", points: int = 100, bounds: tuple[float, float] | None = None) -> list[float]:
    """min + i * (⌊max⌋ - ⌊min⌋ + 1) / points, with truncation toward zero."""
    lo, hi = bounds or tuple(df.agg(F.min(score), F.max(score)).first())
    if lo is None:
        return []
    step = (int(hi) - int(lo) + 1) / points
    return [float(lo) + i * step for i in range(points)]


def rates(df: DataFrame, at: list[float], score: str = "score", label: str = "label") -> DataFrame:
    """Counts and rates at each threshold (score strictly above it is positive).

    Rows fall into the gaps between thresholds first, so the frame is read and shuffled once
    whatever their number; anything but label 1 is negative; rates of an empty class are 0.
    """
    spark = df.sparkSession
    edges = F.array(*map(F.lit, at)) if at else F.array().cast("array<double>")
    above = F.size(F.filter(edges, lambda t: F.col(score) > t))
    y = F.coalesce(F.col(label) == 1, F.lit(False))
    gaps = df.where(F.col(score).isNotNull()).groupBy(above.alias("k")).agg(F.count_if(y).alias("p"), F.count_if(~y).alias("n"))
    levels = spark.createDataFrame(list(enumerate(at)), "i int, threshold double")
    w = Window.partitionBy(F.lit(0)).orderBy(F.desc("k"))
    everything = Window.partitionBy(F.lit(0))
    base = levels.withColumn("k", F.col("i") + 1).select("k", "threshold").unionByName(spark.createDataFrame([(0, None)], "k int, threshold double"))
    counts = base.join(gaps, "k", "left").na.fill(0, ["p", "n"])
    counts = counts.withColumns({"tp": F.sum("p").over(w), "fp": F.sum("n").over(w), "pos": F.sum("p").over(everything), "neg": F.sum("n").over(everything)}).where("k > 0")
    rate = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    out = counts.withColumns({"tn": F.col("neg") - F.col("fp"), "fn": F.col("pos") - F.col("tp")})
    out = out.withColumns({"tpr": rate("tp", "pos"), "fpr": rate("fp", "neg"), "tnr": rate("tn", "neg"), "fnr": rate("fn", "pos")})
    return out.select("threshold", "tp", "fp", "tn", "fn", "tpr", "fpr", "tnr", "fnr")


def binary_curve(df: DataFrame, at: list[float], score: str = "score", label: str = "label", beta: float = 1.0) -> DataFrame:
    """``rates`` with precision, recall, F, accuracy and Matthews' coefficient.

    ``precision_ref`` and ``f_ref`` are built from rates (tpr / (tpr + fpr)); ``precision``
    and ``f`` from counts.
    """
    b2 = beta * beta
    tp, fp, tn, fn = (F.col(c).cast("double") for c in ("tp", "fp", "tn", "fn"))
    over = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tpr, fpr = F.col("tpr"), F.col("fpr")
    product = (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)
    return rates(df, at, score, label).withColumns(
        {
            "precision": over(tp, tp + fp),
            "recall": tpr,
            "f": over((1 + b2) * tp, (1 + b2) * tp + b2 * fn + fp),
            "precision_ref": over(tpr, tpr + fpr),
            "f_ref": over((1 + b2) * tpr, (1 + b2) * tpr + b2 * (1 - tpr) + fpr),
            "accuracy": over(tp + tn, tp + fp + tn + fn),
            "mcc": F.when(product > 0, (tp * tn - fp * fn) / F.sqrt(product)).otherwise(0.0),
        }
    )


def area_under(curve: DataFrame, x: str, y: str) -> DataFrame:
    """Trapezoids between neighbours of the points in the order of (x, y), in blocks of positions."""
    point = F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    pairs = lagged(curve.select(x, y), point, {"__before": 1}, [x, y])
    step = (F.col(x) - F.col("__before.x")) * (F.col(y) + F.col("__before.y")) / 2
    return pairs.agg(F.sum(step).alias("area"))


def binary_kpi(df: DataFrame, at: list[float], score: str = "score", label: str = "label") -> DataFrame:
    """(max accuracy, max F, area under the ROC curve)."""
    curve = binary_curve(df, at, score, label)
    best = curve.agg(F.max("accuracy").alias("accuracy"), F.max("f").alias("f"))
    # one row each
    return best.join(F.broadcast(area_under(curve, "fpr", "tpr").withColumnRenamed("area", "auc")), F.lit(True))


# -- classes and distributions -----------------------------------------------------------------


def confusion(df: DataFrame, target: str, prediction: str, weight: Column | None = None) -> DataFrame:
    return df.groupBy(target, prediction).agg(F.sum(weight if weight is not None else F.lit(1)).alias("weight"))


def fidelity(df: DataFrame, target: str, prediction: str, weight: Column | None = None) -> DataFrame:
    w = weight if weight is not None else F.lit(1.0)
    return df.agg((F.sum(F.when(F.col(target) == F.col(prediction), w).otherwise(0.0)) / F.sum(w)).alias("fidelity"))


def _rows(p: str, q: str, term) -> Column:
    return F.aggregate(F.zip_with(p, q, term), F.lit(0.0), lambda s, x: s + x)


def _log_ratio(a: Column, b: Column) -> Column:
    return F.when(a > 0, a * F.log(a / b)).otherwise(0.0)


def divergences(df: DataFrame, p: str, q: str) -> DataFrame:
    """Means over rows of KL, Jensen–Shannon, Hellinger and cross entropy of two distributions."""
    kl = _rows(p, q, _log_ratio)
    js = _rows(p, q, lambda a, b: (_log_ratio(a, (a + b) / 2) + _log_ratio(b, (a + b) / 2)) / 2)
    hellinger = F.sqrt(_rows(p, q, lambda a, b: (F.sqrt(a) - F.sqrt(b)) ** 2)) / F.sqrt(F.lit(2.0))
    cross = _rows(p, q, lambda a, b: F.when(a > 0, -a * F.log(b)).otherwise(0.0))
    return df.agg(F.avg(kl).alias("kl"), F.avg(js).alias("js"), F.avg(hellinger).alias("hellinger"), F.avg(cross).alias("cross_entropy"))


def metrics_for(task: str):
    """``regression`` or ``classification`` to the function that evaluates it."""
    known = {"regression": regression_metrics, "classification": binary_kpi}
    if task not in known:
        raise ValueError(f"no metrics for {task}")
    return known[task]
