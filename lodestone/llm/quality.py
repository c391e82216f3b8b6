"""Document quality: a classifier's evidence under host and path posteriors (hierarchical empirical Bayes)."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.warc import PARTS
from lodestone.session import durable

SYMBOLS = "#$%&*|!"
FEATURES = ("letters", "upper", "symbols", "repeats", "distinct", "lines", "length")


def features(text: Column) -> dict[str, Column]:
    """What the classifier sees of a whole text, as column expressions; null counts as empty.

    Shares of letters, of upper case among letters, of odd symbols, of words equal to the one
    before, of distinct words and lines; and the logarithm of the number of words.
    """
    t = F.coalesce(text, F.lit(""))
    n = F.greatest(F.length(t), F.lit(1))
    letters = F.length(F.regexp_replace(t, r"[^\p{L}]+", ""))
    words = F.col("__words")
    count = F.greatest(F.size(words), F.lit(1))
    lines = F.split(t, "\n")
    return {
        "letters": letters / n,
        "upper": F.length(F.regexp_replace(t, r"[^\p{Lu}]+", "")) / F.greatest(letters, F.lit(1)),
        "symbols": F.sqrt((F.length(t) - F.length(F.translate(t, SYMBOLS, ""))) / n),
        "repeats": F.size(F.filter(F.zip_with(words, F.slice(words, 2, count), lambda a, b: a == b), lambda same: same)) / count,
        "distinct": F.size(F.array_distinct(words)) / F.sqrt(count.cast("double") * F.greatest(F.least(count, F.lit(400)), F.lit(1))),
        "lines": F.size(F.array_distinct(lines)) / F.size(lines),
        "length": F.log1p(F.size(words).cast("double")),
    }


def with_features(docs: DataFrame, text_col: str) -> DataFrame:
    split = docs.withColumn("__words", F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), r"\s+"), lambda w: w != ""))
    return split.withColumns({f"__f_{k}": v for k, v in features(F.col(text_col)).items()}).drop("__words")


def site_of(url: Column) -> tuple[Column, Column]:
    """(host, path) of a URL for ``classify``: the host in lower case, and the first part of the path; null without a host."""
    host = F.lower(F.regexp_extract(F.trim(url), PARTS, 1))
    first = F.regexp_extract(F.regexp_extract(F.trim(url), PARTS, 2), "^/([^/]*)", 1)
    return F.when(host != "", host), F.when(host != "", first)


@dataclass
class Classifier:
    """Logistic regression on standardised features; without weights it knows nothing (0.5)."""

    mean: list[float] = field(default_factory=list)
    scale: list[float] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    bias: float = 0.0

    def probability(self) -> Column:
        z = F.lit(self.bias)
        for name, m, s, w in zip(FEATURES, self.mean, self.scale, self.weights, strict=False):
            z = z + F.lit(w) * (F.col(f"__f_{name}") - F.lit(m)) / F.lit(s)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0))))


def train(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 50) -> Classifier:
    """Newton's method on the ridge-penalised likelihood; one class alone teaches nothing."""
    if len(y) == 0 or y.min() == y.max():
        return Classifier()
    mean, scale = x.mean(0), x.std(0)
    scale[scale < 1e-9] = 1.0
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w, penalty = np.zeros(z.shape[1]), np.r_[np.full(x.shape[1], ridge), 1e-6]
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty), z.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return Classifier(mean.tolist(), scale.tolist(), w[:-1].tolist(), float(w[-1]))


def fit(docs: DataFrame, labels: DataFrame, sample: int = 20_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Classifier:
    """Fits on at most ``sample`` labelled documents, chosen by a hash of their ids.

    The bound is on what is fitted alone: every document is then scored. Null labels and ids
    teach nothing; of an id labelled twice the higher label counts.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("__label_id")).agg(F.max(label_col).alias("__y"))
    chosen = known.orderBy(F.xxhash64("__label_id"), "__label_id").limit(sample)
    # at most `sample` rows of an id and a label
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col)).join(F.broadcast(chosen), F.col("__id") == F.col("__label_id"))
    found = with_features(rows, text_col).select(*(f"__f_{n}" for n in FEATURES), F.col("__y").cast("double").alias("y"), F.xxhash64("__id").alias("h"))
    # repeated ids may bring more rows than labels
    table = np.array([list(r)[:-1] for r in found.orderBy("h").limit(sample).collect()], float).reshape(-1, len(FEATURES) + 1)
    return train(table[:, :-1], (table[:, -1] > 0).astype(float))


def _strength(groups: DataFrame, mean: float) -> float:
    """Prior rows that a level's groups are worth, by moments: how little their means differ.

    Between groups the variance of means exceeds what the spread inside them explains by
    tau; the beta prior with that variance weighs mean * (1 - mean) / tau - 1 rows.
    """
    row = groups.where("n > 1").agg(
        F.sum("n").alias("n"),
        F.sum(F.col("n") * (F.col("s") / F.col("n") - mean) ** 2).alias("between"),
        F.sum(F.greatest(F.col("q") / F.col("n") - (F.col("s") / F.col("n")) ** 2, F.lit(0.0))).alias("inside"),
    ).first()
    if not row["n"]:
        return 10.0
    tau = max((row["between"] - row["inside"]) / row["n"], 1e-6)
    return min(max(mean * (1 - mean) / tau - 1, 1.0), 1e6)


def classify(docs: DataFrame, labels: DataFrame, carry: list[str], id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang", threshold: float = 0.5, weight: float = 0.5, sample: int = 20_000) -> DataFrame:
    """``carry`` columns of every row, with ``score``, ``host_posterior``, ``path_posterior``, ``quality`` and ``keep``.

    ``score`` is the classifier's probability from the text alone. Sums of scores by host and
    by path within host (grouped, combined before the shuffle, so a host with a third of all
    rows is a few sums) give posteriors: a host's mean is drawn to the global mean and a
    path's to its host's, each by a strength estimated from how far the groups differ, and
    without the row's own score. ``quality`` moves the score's log odds by ``weight`` times
    what the site's differ from the global ones; rows under ``threshold`` aren't kept. Null
    hosts and paths are groups of their own. Without labels of both classes every score is
    0.5 and all rows are kept. Empty tables give no rows.
    """
    model = fit(docs, labels, sample, id_col, text_col)
    host, path = F.coalesce(F.col(host_col).cast("string"), F.lit("")), F.coalesce(F.col(path_col).cast("string"), F.lit(""))
    wide = with_features(docs.withColumns({"__host": host, "__path": path, "__no_host": F.col(host_col).isNull(), "__no_path": F.col(path_col).isNull()}), text_col)
    site = ["__host", "__no_host"]
    place = [*site, "__path", "__no_path"]
    scored = durable(wide.select(*carry, *place, model.probability().alias("__p")), "scores")
    paths = durable(scored.groupBy(*place).agg(F.count("*").alias("n"), F.sum("__p").alias("s"), F.sum(F.col("__p") ** 2).alias("q")), "paths")
    hosts = paths.groupBy(*site).agg(*(F.sum(c).alias(c) for c in ("n", "s", "q")))
    total = hosts.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    mean = min(max(total["s"] / total["n"], 1e-6), 1 - 1e-6) if total["n"] else 0.5
    k_host, k_path = _strength(hosts, mean), _strength(paths, mean)
    sums = durable(paths.select(*place, F.col("n").alias("__pn"), F.col("s").alias("__ps")).join(hosts.select(*site, F.col("n").alias("__hn"), F.col("s").alias("__hs")), site), "sites")
    joined = scored.join(sums, place)
    host_mean = (F.lit(k_host * mean) + F.col("__hs") - F.col("__p")) / (F.lit(k_host) + F.col("__hn") - 1)
    path_mean = (F.lit(k_path) * F.col("__hm") + F.col("__ps") - F.col("__p")) / (F.lit(k_path) + F.col("__pn") - 1)
    near = lambda c: F.greatest(F.least(c, F.lit(1 - 1e-9)), F.lit(1e-9))
    odds = lambda c: F.log(near(c) / (1 - near(c)))
    out = joined.withColumn("__hm", host_mean).withColumn("__pm", path_mean)
    z = odds(F.col("__p")) + F.lit(weight) * (odds(F.col("__pm")) - F.lit(math.log(mean / (1 - mean))))
    out = out.withColumn("__q", F.lit(1.0) / (1 + F.exp(-z)))
    # scores of 0.5 throughout leave rounding to decide: a whisker is granted
    return out.select(
        *carry,
        F.round("__p", 6).alias("score"),
        F.round("__hm", 6).alias("host_posterior"),
        F.round("__pm", 6).alias("path_posterior"),
        F.round("__q", 6).alias("quality"),
        (F.col("__q") >= F.lit(threshold - 1e-9)).alias("keep"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """``docs``, all columns, without the rows that ``classify`` rejects."""
    names = docs.columns
    inner = docs.select(*(F.col(c).alias(f"__c{i}") for i, c in enumerate(names)))
    at = {c: f"__c{i}" for i, c in enumerate(names)}
    keys = {k: at[options.pop(k, d)] for k, d in (("id_col", "doc_id"), ("text_col", "text"), ("host_col", "source"), ("path_col", "lang"))}
    renamed = labels.withColumnRenamed("doc_id", keys["id_col"])
    kept = classify(inner, renamed, list(at.values()), **keys, **options).where("keep")
    return kept.select(*(F.col(f"__c{i}").alias(c) for i, c in enumerate(names)))
