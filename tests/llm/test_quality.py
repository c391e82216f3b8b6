"""Scores, strengths and posteriors against a recomputation in plain Python; accuracy on held-out labels."""

import math
import random

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from lodestone.llm import quality

SF = "/root/testdata/sf0.01"


def slow_features(text):
    t = text or ""
    n, words, lines = max(len(t), 1), regex.split(r"[ \t\n\x0b\f\r]+", t), t.split("\n")
    words = [w for w in words if w]
    letters, count = len(regex.findall(r"\p{L}", t)), max(len(words), 1)
    return [
        letters / n, len(regex.findall(r"\p{Lu}", t)) / max(letters, 1), math.sqrt(sum(c in quality.SYMBOLS for c in t) / n), sum(a == b for a, b in zip(words, words[1:])) / count,
        len(set(words)) / math.sqrt(count * max(min(count, 400), 1)), len(set(lines)) / len(lines), math.log1p(len(words)),
    ]


def slow_strength(groups, mean):
    many = [g for g in groups if len(g) > 1]
    if not many:
        return 10.0
    between = sum(len(g) * (sum(g) / len(g) - mean) ** 2 for g in many)
    inside = sum(max(sum(p * p for p in g) / len(g) - (sum(g) / len(g)) ** 2, 0.0) for g in many)
    tau = max((between - inside) / sum(map(len, many)), 1e-6)
    return min(max(mean * (1 - mean) / tau - 1, 1.0), 1e6)


def slow_quality(rows, model, weight=0.5):
    """rows: (id, text, host, path) -> {position: (score, host posterior, path posterior, quality)}."""
    hosts, paths, scores = {}, {}, []
    for _, text, host, path in rows:
        z = model.bias + sum(w * (x - m) / s for w, x, m, s in zip(model.weights, slow_features(text), model.mean, model.scale)) if model.weights else 0.0
        scores.append(1 / (1 + math.exp(-min(max(z, -30), 30))))
    for (_, _, host, path), p in zip(rows, scores):
        hosts.setdefault(host, []).append(p)
        paths.setdefault((host, path), []).append(p)
    mean = min(max(sum(scores) / len(scores), 1e-6), 1 - 1e-6)
    k_host, k_path = slow_strength(hosts.values(), mean), slow_strength(paths.values(), mean)
    odds = lambda p: math.log(min(max(p, 1e-9), 1 - 1e-9) / (1 - min(max(p, 1e-9), 1 - 1e-9)))
    out = []
    for (_, _, host, path), p in zip(rows, scores):
        h = (k_host * mean + sum(hosts[host]) - p) / (k_host + len(hosts[host]) - 1)
        q = (k_path * h + sum(paths[host, path]) - p) / (k_path + len(paths[host, path]) - 1)
        out.append((p, h, q, 1 / (1 + math.exp(-(odds(p) + weight * (odds(q) - odds(mean)))))))
    return out


def test_all_rows_equal_brute_force(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    r = random.Random(4)
    odd = [(10**6 + i, r.choice([None, "", "one two two", "##", "É été ÇA", "a\nb\na"]), r.choice([None, "", "src0", "rare"]), r.choice([None, "", "en"])) for i in range(60)]
    both = docs.select("doc_id", "text", "source", "lang").union(spark.createDataFrame(odd, "doc_id long, text string, source string, lang string"))
    model = quality.fit(both, labels)
    rows = [tuple(x) for x in both.collect()]
    got = {x["doc_id"]: x for x in quality.classify(both, labels, ["doc_id"]).collect()}
    assert len(got) == len(rows)
    for row, (score, host, path, q) in zip(rows, slow_quality(rows, model)):
        x = got[row[0]]
        assert (x["score"], x["host_posterior"], x["path_posterior"], x["quality"]) == pytest.approx((score, host, path, q), abs=2e-6)
        assert abs(q - 0.5) < 1e-6 or x["keep"] == (q >= 0.5)


def test_held_out_area_under_curve(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2))
    got = quality.classify(docs, labels.where(half == 0), ["doc_id"]).join(labels.where(half == 1).withColumnRenamed("quality", "truth"), "doc_id").collect()
    good, bad = (np.array([x["quality"] for x in got if x["truth"] == k]) for k in (1, 0))
    area = np.mean((good[:, None] > bad[None, :]) + (good[:, None] == bad[None, :]) / 2)
    assert area >= 0.99
    # calibration: of the rows in a half of the scale about as many are good as the mean says
    for low, high in ((0.0, 0.5), (0.5, 1.01)):
        part = [x for x in got if low <= x["quality"] < high]
        assert abs(np.mean([x["quality"] for x in part]) - np.mean([x["truth"] for x in part])) < 0.1


def test_sites_of_urls(spark):
    rows = [(1, "http://A.org/news/x?q", "a.org", "news"), (2, "https://b.de", "b.de", ""), (3, None, None, None), (4, "nothing", None, None), (5, "//c.fr/", "c.fr", "")]
    host, path = quality.site_of(F.col("url"))
    df = spark.createDataFrame([r[:2] for r in rows], "id long, url string").withColumns({"h": host, "p": path})
    assert [(x["id"], x["h"], x["p"]) for x in df.orderBy("id").collect()] == [(r[0], r[2], r[3]) for r in rows]
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    host, path = quality.site_of(F.col("url"))
    docs = pages.select(F.col("page_id").alias("doc_id"), F.col("html").alias("text"), host.alias("host"), path.alias("path"))
    labels = pages.select(F.col("page_id").alias("doc_id"), (F.length("html") > 500).cast("int").alias("quality"))
    model = quality.fit(docs, labels)
    rows = [tuple(x) for x in docs.collect()]
    got = {x["doc_id"]: x for x in quality.classify(docs, labels, ["doc_id"], host_col="host", path_col="path").collect()}
    for row, (score, h, p, q) in zip(rows, slow_quality(rows, model)):
        x = got[row[0]]
        assert (x["score"], x["host_posterior"], x["path_posterior"], x["quality"]) == pytest.approx((score, h, p, q), abs=2e-6)
