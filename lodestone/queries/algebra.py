"""Queries over matrices and vectors in frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import linalg
from lodestone.queries.registry import Tables, query
from lodestone.queries.statistics import rounded

#: All components of every vector as cells, and a vector over the components.
M = "(SELECT vec_id AS i, CAST(d AS BIGINT) AS j, CAST(embedding[d + 1] AS DOUBLE) AS v FROM embeddings, range(64) r(d))"
X = "(SELECT CAST(d AS BIGINT) AS i, d + 1.0::DOUBLE AS v FROM range(64) r(d))"


def m(t: Tables):
    e = t.embeddings.select(F.col("vec_id").alias("i"), F.posexplode("embedding").alias("j", "v"))
    return e.select("i", F.col("j").cast("long").alias("j"), F.col("v").cast("double").alias("v"))


def x(t: Tables):
    return linalg.vector(t.spark, 64, lambda i: i + 1)


@query("L1_transpose", f"SELECT j AS i, i AS j, v FROM {M}")
def _(t: Tables):
    return linalg.transpose(m(t))


@query("L2_triangles", f"SELECT 'd' AS part, i, j, CASE WHEN i = j THEN v ELSE 0 END AS v FROM {M} UNION ALL SELECT 'l', i, j, CASE WHEN i >= j THEN v ELSE 0 END FROM {M} UNION ALL SELECT 'u', i, j, CASE WHEN i <= j THEN v ELSE 0 END FROM {M}")
def _(t: Tables):
    tag = lambda p, a: a.select(F.lit(p).alias("part"), "i", "j", "v")
    return tag("d", linalg.diagonal(m(t))).union(tag("l", linalg.lower(m(t)))).union(tag("u", linalg.upper(m(t))))


@query("L3_add_subtract", f"SELECT i, j, round(3 * v, 6) AS v FROM {M}")
def _(t: Tables):
    a = m(t)
    return rounded(linalg.subtract(linalg.add(linalg.add(a, a), linalg.add(a, a)), a))


@query("L5_matrix_product", f"SELECT a.j AS i, b.j, round(sum(a.v * b.v), 6) AS v FROM {M} a JOIN {M} b ON a.i = b.i GROUP BY a.j, b.j")
def _(t: Tables):
    return rounded(linalg.multiply(linalg.transpose(m(t)), m(t)))


@query("L5_matrix_vector", f"SELECT a.i, round(sum(a.v * x.v), 6) AS v FROM {M} a JOIN {X} x ON a.j = x.i GROUP BY a.i")
def _(t: Tables):
    return rounded(linalg.apply(m(t), x(t)))


@query("L6_outer", f"SELECT a.i, b.i AS j, a.v * b.v AS v FROM {X} a, {X} b")
def _(t: Tables):
    return linalg.outer(x(t), x(t))


@query("L6_inner", f"SELECT sum(v * v) AS v FROM {X}")
def _(t: Tables):
    return linalg.inner(x(t), x(t))


@query("L7_L8_scale_axpy", f"SELECT i, -0.5 * v AS v FROM {X}")
def _(t: Tables):
    return linalg.axpy(x(t), -0.75, linalg.scale(x(t), 2.0))


@query("L9_block_product", f"SELECT a.j AS i, b.j, round(sum(a.v * b.v), 6) AS v FROM {M} a JOIN {M} b ON a.i = b.i GROUP BY a.j, b.j")
def _(t: Tables):
    b = linalg.to_blocks(m(t), 32)
    return rounded(linalg.from_blocks(linalg.block_multiply(linalg.block_transpose(b), b), 32))


@query("L9_block_add", f"SELECT i, j, round(2 * v, 6) AS v FROM {M}")
def _(t: Tables):
    b = linalg.to_blocks(m(t), 32)
    return rounded(linalg.from_blocks(linalg.block_add(b, b), 32))


@query("L10_hadamard", f"SELECT i, j, round(v * v, 6) AS v FROM {M}")
def _(t: Tables):
    return rounded(linalg.hadamard(m(t), m(t)))


@query("L12_blocked_cholesky", f"SELECT a.j AS i, b.j, round(sum(a.v * b.v) + CASE WHEN a.j = b.j THEN 1 ELSE 0 END, 6) AS v FROM {M} a JOIN {M} b ON a.i = b.i GROUP BY a.j, b.j")
def _(t: Tables):
    gram = linalg.multiply(linalg.transpose(m(t)), m(t)).withColumn("v", F.col("v") + F.when(F.col("i") == F.col("j"), 1.0).otherwise(0.0))
    factor = linalg.cholesky(gram, 32)
    return rounded(linalg.multiply(factor, linalg.transpose(factor)))


@query("L11_conjugate_gradient", "SELECT CAST(d AS BIGINT) AS i, 2.0::DOUBLE AS v FROM range(12) r(d)")
def _(t: Tables):
    a = linalg.tabulate(t.spark, 12, 12, lambda i, j: F.when(i == j, 0.5).otherwise(0.0))
    return rounded(linalg.conjugate_gradient(a, linalg.vector(t.spark, 12, lambda i: F.lit(1.0))))


@query("L13_totals", f"SELECT round(sum(v), 6) AS total, round(sum(CASE WHEN i = j THEN v END), 6) AS trace, round(sqrt(sum(v * v)), 6) AS norm FROM {M}")
def _(t: Tables):
    a = m(t)
    return rounded(a.agg(F.sum("v").alias("total"), F.sum(F.when(F.col("i") == F.col("j"), F.col("v"))).alias("trace"), F.sqrt(F.sum(F.col("v") ** 2)).alias("norm")))


@query("L13_norm", f"SELECT round(pow(sum(pow(abs(v), 3)), 1 / 3), 6) AS v FROM {M}")
def _(t: Tables):
    return rounded(linalg.norm(m(t), 3.0))


@query("L15_tabulate", "SELECT CAST(a AS BIGINT) AS i, CAST(b AS BIGINT) AS j, a + 10.0::DOUBLE * b AS v FROM range(7) r(a), range(5) s(b)")
def _(t: Tables):
    return linalg.tabulate(t.spark, 7, 5, lambda i, j: i + 10 * j)


@query("L15_block_round_trip", f"SELECT i, j, v FROM {M}")
def _(t: Tables):
    return linalg.from_blocks(linalg.to_blocks(m(t), 7), 7)


@query("J4_gram", "SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(sum(e[i + 1] * e[j + 1]), 5) AS v FROM (SELECT CAST(embedding AS DOUBLE[]) AS e FROM embeddings), range(64) r(i), range(64) s(j) GROUP BY 1, 2")
def _(t: Tables):
    return rounded(linalg.gram_of(t.embeddings, "embedding", 64), 5)


@query("J6_mirror", f"SELECT i, j, v FROM {M} WHERE i >= j UNION ALL SELECT j, i, v FROM {M} WHERE i > j")
def _(t: Tables):
    return linalg.mirror(m(t).where("i >= j"))


@query("K4_sub_matrix", f"SELECT i - 10 AS i, j - 2 AS j, v FROM {M} WHERE i BETWEEN 10 AND 20 AND j BETWEEN 2 AND 4")
def _(t: Tables):
    return linalg.block_range(m(t), (10, 20), (2, 4))


@query("U2_stack", f"SELECT i, j, v FROM {M} UNION ALL SELECT i + (SELECT count(*) FROM embeddings), j, v FROM {M} UNION ALL SELECT i, j + 64, v FROM {M}")
def _(t: Tables):
    a = m(t)
    return linalg.stack_rows(a, a, t.embeddings.count()).unionByName(linalg.stack_columns(a.where(F.lit(False)), a, 64))


@query("U3_block_stack", f"SELECT i, j, v FROM {M} UNION ALL SELECT i, j + 64, v FROM {M}")
def _(t: Tables):
    b = linalg.to_blocks(m(t), 32)
    return linalg.from_blocks(linalg.block_stack_columns(b, b), 32)


@query("U3_block_stack_rows", f"SELECT j AS i, i AS j, v FROM {M} UNION ALL SELECT j + 64, i, v FROM {M}")
def _(t: Tables):
    b = linalg.to_blocks(linalg.transpose(m(t)), 32)
    return linalg.from_blocks(linalg.block_stack_rows(b, b), 32)


@query("K2_block_order", f"SELECT CAST(floor(i / 32) AS BIGINT) AS bi, CAST(floor(j / 32) AS BIGINT) AS bj, round(sum(v), 5) AS total FROM {M} GROUP BY 1, 2")
def _(t: Tables):
    total = F.aggregate("block", F.lit(0.0), lambda s, v: s + v)
    return linalg.block_sorted(linalg.to_blocks(m(t), 32)).select("bi", "bj", F.round(total, 5).alias("total"))


@query("K5_block_filter", f"SELECT i - 32 AS i, j, v FROM {M} WHERE floor(i / 32) BETWEEN 1 AND 3 AND floor(j / 32) = 0 AND floor(i / 32) % 2 = 1")
def _(t: Tables):
    odd = linalg.block_filter(linalg.to_blocks(m(t), 32), F.col("bi") % 2 == 1)
    return linalg.from_blocks(linalg.block_window(odd, (1, 3), (0, 0)), 32)


@query("J3b_block_zip", f"SELECT i, CAST(0 AS BIGINT) AS j, v + w AS v FROM (SELECT i, v FROM {X}) JOIN (SELECT (i + 32) % 64 AS i, 2 * v AS w FROM {X}) USING (i)")
def _(t: Tables):
    column = lambda a: a.select("i", F.lit(0).cast("long").alias("j"), "v")
    a, b = linalg.to_blocks(column(x(t)), 32), linalg.to_blocks(column(linalg.scale(x(t), 2.0)), 32)
    # the second vector's blocks change places: the pairing is by place alone
    turned = b.withColumn("bi", (F.col("bi") + 1) % 2)
    return linalg.from_blocks(linalg.block_zip_add(a, turned), 32)
