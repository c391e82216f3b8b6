"""Matrices and vectors as frames: cells (i, j, v) and (i, v), or dense blocks for products.

Products are equi joins with partial sums, never all pairs. A blocked matrix holds blocks as
arrays (row after row) and multiplies them in Arrow batches.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.ordered import with_position
from lodestone.session import durable

BLOCKS = "bi long, bj long, nr int, nc int, block array<double>"
#: Sums of blocks that a task holds at once.
HELD = 256


def transpose(a: DataFrame) -> DataFrame:
    return a.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def _masked(a: DataFrame, keep: Column) -> DataFrame:
    return a.withColumn("v", F.when(keep, F.col("v")).otherwise(0.0))


def diagonal(a: DataFrame) -> DataFrame:
    return _masked(a, F.col("i") == F.col("j"))


def lower(a: DataFrame) -> DataFrame:
    return _masked(a, F.col("i") >= F.col("j"))


def upper(a: DataFrame) -> DataFrame:
    return _masked(a, F.col("i") <= F.col("j"))


def add(a: DataFrame, b: DataFrame, sign: int = 1) -> DataFrame:
    """Cell by cell; a cell that one side lacks counts as zero. One sum over the union, no join."""
    keys = [c for c in a.columns if c != "v"]
    return a.select(*keys, "v").unionByName(b.select(*keys, (F.col("v") * sign).alias("v"))).groupBy(*keys).agg(F.sum("v").alias("v"))


def subtract(a: DataFrame, b: DataFrame) -> DataFrame:
    return add(a, b, -1)


def scale(a: DataFrame, c: float) -> DataFrame:
    return a.withColumn("v", F.col("v") * c)


def axpy(x: DataFrame, alpha: float, y: DataFrame) -> DataFrame:
    """x + α·y."""
    return add(x, scale(y, alpha))


def hadamard(a: DataFrame, b: DataFrame) -> DataFrame:
    keys = [c for c in a.columns if c != "v"]
    return a.join(b.withColumnRenamed("v", "w"), keys).select(*keys, (F.col("v") * F.col("w")).alias("v"))


def multiply(a: DataFrame, b: DataFrame) -> DataFrame:
    """Σ over the inner index; sums combine before their shuffle."""
    left = a.select("i", F.col("j").alias("k"), F.col("v").alias("x"))
    right = b.select(F.col("i").alias("k"), "j", F.col("v").alias("y"))
    return left.join(right, "k").groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("v"))


def apply(a: DataFrame, x: DataFrame) -> DataFrame:
    """A·x as (i, v), for each row of A."""
    return a.join(x.select(F.col("i").alias("j"), F.col("v").alias("w")), "j").groupBy("i").agg(F.sum(F.col("v") * F.col("w")).alias("v"))


def inner(x: DataFrame, y: DataFrame) -> DataFrame:
    return x.join(y.withColumnRenamed("v", "w"), "i").agg(F.sum(F.col("v") * F.col("w")).alias("v"))


def outer(x: DataFrame, y: DataFrame) -> DataFrame:
    from lodestone.operators.joins import pairs

    return pairs(x.select("i", F.col("v").alias("a")), y.select(F.col("i").alias("j"), F.col("v").alias("b"))).select("i", "j", (F.col("a") * F.col("b")).alias("v"))


def gram_of(vectors: DataFrame, vector: str, size: int) -> DataFrame:
    """XᵀX of array rows as cells: each task sums its rows' products to one matrix, and those are summed."""
    i, j = np.indices((size, size))

    def partial(frames):
        total = np.zeros((size, size))
        for pdf in frames:
            x = np.array(pdf["x"].tolist(), float).reshape(len(pdf), -1)[:, :size]
            total += x.T @ x
        yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "v": total.ravel()})

    parts = vectors.select(F.col(vector).cast("array<double>").alias("x")).mapInPandas(partial, "i int, j int, v double")
    return parts.groupBy("i", "j").agg(F.sum("v").alias("v"))


def block_range(a: DataFrame, rows: tuple[int, int], columns: tuple[int, int] | None = None) -> DataFrame:
    """The cells of a range of rows (and columns), both ends in, indices from 0 again."""
    out = a.where(F.col("i").between(*rows)).withColumn("i", F.col("i") - rows[0])
    return out if columns is None else out.where(F.col("j").between(*columns)).withColumn("j", F.col("j") - columns[0])


def stack_rows(a: DataFrame, b: DataFrame, rows_of_a: int) -> DataFrame:
    return a.unionByName(b.withColumn("i", F.col("i") + rows_of_a))


def stack_columns(a: DataFrame, b: DataFrame, columns_of_a: int) -> DataFrame:
    return a.unionByName(b.withColumn("j", F.col("j") + columns_of_a))


def mirror(lower_cells: DataFrame) -> DataFrame:
    return lower_cells.unionByName(transpose(lower_cells.where("i <> j")).select(*lower_cells.columns))


def is_symmetric(a: DataFrame, tolerance: float = 1e-9) -> bool:
    """Each cell against its mirror image, by one sum for each unordered pair."""
    odd = F.when(F.col("i") < F.col("j"), F.col("v")).otherwise(-F.col("v"))
    pair = a.where("i <> j").groupBy(F.least("i", "j").alias("p"), F.greatest("i", "j").alias("q")).agg(F.sum(odd).alias("d"))
    return pair.where(F.abs("d") > tolerance).limit(1).count() == 0


def shape(a: DataFrame) -> tuple[int, int]:
    r = a.agg(F.max("i").alias("i"), F.max("j").alias("j")).first()
    return tuple(0 if r[c] is None else r[c] + 1 for c in "ij")


def is_square(a: DataFrame) -> bool:
    rows, columns = shape(a)
    return rows == columns


def tabulate(spark, rows: int, columns: int, value) -> DataFrame:
    """value(i, j) for every cell: a range of the cells' numbers, no product of two ranges."""
    i, j = F.floor(F.col("id") / columns), F.col("id") % columns
    return spark.range(rows * columns).select(i.alias("i"), j.alias("j"), value(i, j).cast("double").alias("v"))


def vector(spark, rows: int, value) -> DataFrame:
    return spark.range(rows).select(F.col("id").alias("i"), value(F.col("id")).cast("double").alias("v"))


# -- totals -----------------------------------------------------------------------------------------


def total(a: DataFrame) -> DataFrame:
    return a.agg(F.sum("v").alias("v"))


def product(a: DataFrame) -> DataFrame:
    return a.agg(F.product("v").alias("v"))


def trace(a: DataFrame) -> DataFrame:
    return a.where("i = j").agg(F.sum("v").alias("v"))


def log(a: DataFrame) -> DataFrame:
    return a.withColumn("v", F.log("v"))


def norm(a: DataFrame, p: float = 2.0) -> DataFrame:
    return a.agg(F.pow(F.sum(F.pow(F.abs("v"), F.lit(float(p)))), F.lit(1 / p)).alias("v"))


# -- blocks -----------------------------------------------------------------------------------------


def to_blocks(a: DataFrame, size: int) -> DataFrame:
    """(bi, bj, nr, nc, block): dense blocks, cells that lack are zero. A block has at most size² cells."""
    rows, columns = shape(a)
    bi, bj = F.floor(F.col("i") / size), F.floor(F.col("j") / size)
    cell = F.struct((F.col("i") % size).cast("int").alias("r"), (F.col("j") % size).cast("int").alias("c"), "v")
    grouped = a.groupBy(bi.alias("bi"), bj.alias("bj")).agg(F.collect_list(cell).alias("cells"))
    nr = F.least(F.lit(size), F.lit(rows) - F.col("bi") * size).cast("int")
    nc = F.least(F.lit(size), F.lit(columns) - F.col("bj") * size).cast("int")
    at = F.map_from_entries(F.transform("cells", lambda c: F.struct(c["r"] * size + c["c"], c["v"])))
    keys = F.transform(F.sequence(F.lit(0), F.col("nr") * F.col("nc") - 1), lambda k: F.coalesce(F.try_element_at(F.col("at"), (F.floor(k / F.col("nc")) * size + k % F.col("nc")).cast("int")), F.lit(0.0)))
    return grouped.select("bi", "bj", nr.alias("nr"), nc.alias("nc"), at.alias("at")).select("bi", "bj", "nr", "nc", keys.alias("block"))


def from_blocks(b: DataFrame, size: int) -> DataFrame:
    k = b.select("bi", "bj", "nc", F.posexplode("block").alias("k", "v"))
    return k.select((F.col("bi") * size + F.floor(F.col("k") / F.col("nc"))).alias("i"), (F.col("bj") * size + F.col("k") % F.col("nc")).alias("j"), "v")


def block_transpose(b: DataFrame) -> DataFrame:
    def turn(frames):
        for pdf in frames:
            pdf["block"] = [np.reshape(x, (r, c)).T.ravel() for x, r, c in zip(pdf["block"], pdf["nr"], pdf["nc"], strict=True)]
            yield pdf.rename(columns={"bi": "bj", "bj": "bi", "nr": "nc", "nc": "nr"})[["bi", "bj", "nr", "nc", "block"]]

    return b.mapInPandas(turn, "bi long, bj long, nr int, nc int, block array<double>")


def block_add(a: DataFrame, b: DataFrame, sign: int = 1) -> DataFrame:
    joined = a.join(b.select("bi", "bj", F.col("block").alias("other")), ["bi", "bj"])
    return joined.withColumn("block", F.zip_with("block", "other", lambda x, y: x + sign * y)).drop("other")


def block_multiply(a: DataFrame, b: DataFrame) -> DataFrame:
    """Join on the inner block, dense products in Arrow batches, then sums of equal blocks."""
    left = a.select("bi", F.col("bj").alias("bk"), "nr", F.col("nc").alias("nk"), F.col("block").alias("x"))
    right = b.select(F.col("bi").alias("bk"), "bj", "nc", F.col("block").alias("y"))

    def gemm(frames):
        for pdf in frames:
            z = [(np.reshape(x, (r, k)) @ np.reshape(y, (k, c))).ravel() for x, y, r, k, c in zip(pdf["x"], pdf["y"], pdf["nr"], pdf["nk"], pdf["nc"], strict=True)]
            yield pd.DataFrame({"bi": pdf["bi"], "bj": pdf["bj"], "nr": pdf["nr"], "nc": pdf["nc"], "block": z})

    return block_sum(left.join(right, "bk").mapInPandas(gemm, BLOCKS))


def block_sum(parts: DataFrame) -> DataFrame:
    """Equal blocks added whole: a task's own first, then what the tasks have for a place."""

    def combine(frames):
        total: dict[tuple, np.ndarray] = {}
        for pdf in frames:
            for key, x in zip(pdf[["bi", "bj", "nr", "nc"]].itertuples(index=False, name=None), pdf["block"], strict=True):
                total[key] = total[key] + x if key in total else np.array(x, float)
                if len(total) >= HELD:
                    yield _frame(total)
                    total = {}
        if total:
            yield _frame(total)

    def add(key, pdf):
        return _frame({key: sum(np.array(x, float) for x in pdf["block"])})

    return parts.mapInPandas(combine, BLOCKS).groupBy("bi", "bj", "nr", "nc").applyInPandas(add, BLOCKS)


def _frame(blocks: dict[tuple, np.ndarray]) -> pd.DataFrame:
    keys = list(blocks)
    return pd.DataFrame({c: [k[n] for k in keys] for n, c in enumerate(("bi", "bj", "nr", "nc"))} | {"block": list(blocks.values())})


def block_sorted(b: DataFrame) -> DataFrame:
    """Blocks in the order of their rows, then columns: a range shuffle, each range sorted."""
    return b.orderBy("bi", "bj")


def block_zip_add(a: DataFrame, b: DataFrame, sign: int = 1) -> DataFrame:
    """Blocked vectors whose blocks are paired by their place in the order, whatever their indices; the left's stay."""
    left = with_position(a, ["bi", "bj"], "__pos")
    right = with_position(b.select("bi", "bj", F.col("block").alias("other")), ["bi", "bj"], "__pos").select("__pos", "other")
    return left.join(right, "__pos").withColumn("block", F.zip_with("block", "other", lambda x, y: x + sign * y)).select("bi", "bj", "nr", "nc", "block")


def block_stack_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """``b`` below ``a``: whole blocks move up by the number of ``a``'s block rows, which must be full."""
    rows = (a.agg(F.max("bi")).first()[0] + 1) if a.limit(1).count() else 0
    return a.unionByName(b.withColumn("bi", F.col("bi") + rows))


def block_stack_columns(a: DataFrame, b: DataFrame) -> DataFrame:
    columns = (a.agg(F.max("bj")).first()[0] + 1) if a.limit(1).count() else 0
    return a.unionByName(b.withColumn("bj", F.col("bj") + columns))


def block_filter(b: DataFrame, keep: Column) -> DataFrame:
    """Blocks for whose indices ``keep`` (of bi, bj) holds."""
    return b.where(keep)


def block_window(b: DataFrame, rows: tuple[int, int], columns: tuple[int, int] | None = None) -> DataFrame:
    """Blocks of a range of block rows (and columns), both ends in, indices from 0 again."""
    out = b.where(F.col("bi").between(*rows)).withColumn("bi", F.col("bi") - rows[0])
    return out if columns is None else out.where(F.col("bj").between(*columns)).withColumn("bj", F.col("bj") - columns[0])


# -- solves --------------------------------------------------------------------------------------------


def to_numpy(a: DataFrame, most: int = 5000) -> np.ndarray:
    """A small matrix on the driver; beyond ``most`` rows the call is refused."""
    rows, columns = shape(a)
    if max(rows, columns) > most:
        raise ValueError(f"{rows} x {columns} is too large for the driver")
    pdf = a.select("i", "j", "v").toPandas()
    out = np.zeros((rows, columns))
    out[pdf["i"], pdf["j"]] = pdf["v"]
    return out


def from_numpy(spark, m: np.ndarray) -> DataFrame:
    i, j = np.indices(m.shape)
    return spark.createDataFrame(pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "v": m.ravel().astype(float)}))


def conjugate_gradient(a: DataFrame, b: DataFrame, tolerance: float = 1e-9, most: int = 100) -> DataFrame:
    """x with A·x = b for a positive definite A in cells: two jobs an iteration, vectors as tables.

    Only scalars (inner products) reach the driver.
    """
    cells = durable(a.select("i", "j", "v"), "matrix")
    state = durable(b.select("i", F.lit(0.0).alias("x"), F.col("v").alias("r"), F.col("v").alias("p")), "cg")
    rr = state.agg(F.sum(F.col("r") ** 2)).first()[0] or 0.0
    for _ in range(most):
        if rr <= tolerance**2:
            break
        ap = apply(cells, state.select("i", F.col("p").alias("v"))).withColumnRenamed("v", "ap")
        both = durable(state.join(ap, "i"), "cg")
        alpha = rr / both.agg(F.sum(F.col("p") * F.col("ap"))).first()[0]
        moved = both.select("i", (F.col("x") + alpha * F.col("p")).alias("x"), (F.col("r") - alpha * F.col("ap")).alias("r"), "p")
        new = moved.agg(F.sum(F.col("r") ** 2)).first()[0]
        state = durable(moved.withColumn("p", F.col("r") + new / rr * F.col("p")), "cg")
        rr = new
    return state.select("i", F.col("x").alias("v"))


def cholesky(a: DataFrame, block: int = 256) -> DataFrame:
    """The lower factor L of a positive definite matrix in cells, block column by block column.

    Each step factors one diagonal block on the driver, solves the block column below it in
    Arrow batches and updates the rest by a join; states are cut by tables.
    """
    spark = a.sparkSession
    rows, _ = shape(a)
    schema = "bi long, bj long, nr int, nc int, block array<double>"
    rest = durable(to_blocks(a, block).where("bi >= bj"), "chol")
    done = []
    for k in range((rows + block - 1) // block):
        head = rest.where(f"bi = {k} and bj = {k}").first()
        n = head["nr"]
        l = np.linalg.cholesky(np.reshape(head["block"], (n, n)))  # noqa: E741
        top = spark.createDataFrame([(k, k, n, n, l.ravel().tolist())], schema)

        def below(frames, l=l):
            for pdf in frames:
                pdf["block"] = [np.linalg.solve(l, np.reshape(x, (r, c)).T).T.ravel() for x, r, c in zip(pdf["block"], pdf["nr"], pdf["nc"], strict=True)]
                yield pdf

        column = durable(rest.where(f"bi > {k} and bj = {k}").select("bi", "bj", "nr", "nc", "block").mapInPandas(below, schema), "chol")
        done += [top, column]
        left = column.select("bi", "nr", F.col("nc").alias("nk"), F.col("block").alias("x"))
        right = column.select(F.col("bi").alias("bj"), F.col("block").alias("y"))

        def update(frames):
            for pdf in frames:
                pdf["block"] = [(np.reshape(z, (r, c)) - np.reshape(x, (r, k)) @ np.reshape(y, (c, k)).T).ravel() for z, x, y, r, c, k in zip(pdf["block"], pdf["x"], pdf["y"], pdf["nr"], pdf["nc"], pdf["nk"], strict=True)]
                yield pdf[["bi", "bj", "nr", "nc", "block"]]

        joined = rest.where(f"bi > {k} and bj > {k}").join(left.drop("nr"), "bi").join(right, "bj")
        rest = durable(joined.select("bi", "bj", "nr", "nc", "block", "x", "y", "nk").mapInPandas(update, schema), "chol")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return from_blocks(out, block)


def solve_triangular(t: np.ndarray, b: np.ndarray, is_lower: bool = True) -> np.ndarray:
    """Forward or backward substitution on the driver, for vectors or several right sides."""
    x = np.array(b, float)
    order = range(len(t)) if is_lower else reversed(range(len(t)))
    for i in order:
        s = slice(0, i) if is_lower else slice(i + 1, None)
        x[i] = (x[i] - t[i, s] @ x[s]) / t[i, i]
    return x


def lu(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(P, L, U) with partial pivoting: P·A = L·U."""
    u, n = np.array(m, float), len(m)
    p, l = np.eye(n), np.eye(n)  # noqa: E741
    for k in range(n):
        at = k + int(np.abs(u[k:, k]).argmax())
        for x, width in ((u, n), (p, n), (l, k)):
            x[[k, at], :width] = x[[at, k], :width]
        l[k + 1 :, k] = u[k + 1 :, k] / u[k, k]
        u[k + 1 :] -= np.outer(l[k + 1 :, k], u[k])
    return p, l, u


def solve(m: np.ndarray, b: np.ndarray) -> np.ndarray:
    p, l, u = lu(m)  # noqa: E741
    return solve_triangular(u, solve_triangular(l, p @ b), is_lower=False)


def quadratic_form(m: np.ndarray, x: np.ndarray, y: np.ndarray | None = None, inverse: bool = False) -> float:
    """xᵀA y, or xᵀA⁻¹y through the Cholesky factor."""
    y = x if y is None else y
    if not inverse:
        return float(x @ m @ y)
    l = np.linalg.cholesky(m)  # noqa: E741
    return float(solve_triangular(l, x) @ solve_triangular(l, y))


def log_determinant(m: np.ndarray) -> float:
    return float(2 * np.log(np.diag(np.linalg.cholesky(m))).sum())


def persist(a: DataFrame) -> DataFrame:
    return a.persist(StorageLevel.MEMORY_AND_DISK)
