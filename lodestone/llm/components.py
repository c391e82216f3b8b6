"""Connected components by distributed label lowering with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.session import durable, remove

#: Edge rows beyond which no side of a join is sent to all: tables of few values are far smaller on disk than in memory.
SENT = 500_000


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node that has an edge; component is the smallest node reached.

    ``edges`` has ``a`` and ``b`` (long). Each round a node takes the smallest label among its
    neighbours' and its own, then the label that its label has (pointer jumping), so a path
    of n nodes ends after about log n rounds. Labels stay in tables of the shared folder; the
    driver sees only how many changed. Nulls on either side carry no link and are left out;
    an empty input gives an empty table.
    """
    spark = edges.sparkSession
    links = edges.where("a is not null and b is not null and a <> b")
    both = durable(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    n = both.count()
    side = (lambda d: d.hint("merge")) if n > SENT else (lambda d: d)
    paths: list[str] = []
    labels = durable(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).select(F.col("a").alias("node"), "label"), "labels", paths, n)
    while True:
        seen = side(both).join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("near"))
        lower = side(labels).join(seen, labels.node == seen.a).select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        # a label is itself a node: follow it once
        lower = durable(lower, "lower", paths, n)
        up = lower.select(F.col("node").alias("__of"), F.col("label").alias("__up"))
        jumped = side(lower).join(up, lower.label == up["__of"], "left").select("node", "was", F.least(F.col("label"), F.coalesce("__up", "label")).alias("label"))
        new = durable(jumped, "labels", paths, n)
        changed = new.where("label <> was").limit(1).count()
        for old in paths[:-1]:
            remove(spark, old)
        del paths[:-1]
        labels = new.select("node", "label")
        if not changed:
            return labels.select("node", F.col("label").alias("component"))
