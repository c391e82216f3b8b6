"""Operators whose meaning depends on the order of rows.

Inside groups (``by``) they are window functions. Without groups a window would put all rows
in one task; these operators then number the rows once, by a range partitioning, and work in
blocks of positions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.session import durable

MASK = (1 << 33) - 1
BLOCK = 1 << 16


def with_position(df: DataFrame, order: list[str | Column], out: str = "pos") -> DataFrame:
    """Adds 0, 1, 2... in the order of ``order``: one range shuffle, no global window.

    Each range is sorted by itself and numbered as it stands; only the ranges' sizes are
    summed up, a row for each range.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    stored = durable(ranged.withColumn("__m", F.monotonically_increasing_id()), "ordered")
    sizes = stored.groupBy(F.shiftright("__m", 33).alias("__p")).agg(F.count("*").alias("__n"))
    before = Window.partitionBy(F.lit(0)).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__p", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__s"))
    joined = stored.withColumn("__p", F.shiftright("__m", 33)).join(F.broadcast(starts), "__p")  # a row a partition
    return joined.withColumn(out, F.col("__s") + F.col("__m").bitwiseAND(F.lit(MASK))).drop("__p", "__m", "__s")


def _numbered(df: DataFrame, order: list, by: list[str] | None) -> tuple[DataFrame, list[str], list]:
    """The frame, the keys of windows that stay small, and the order inside them."""
    if by:
        return df, by, order
    return with_position(df, order, "__pos").withColumn("__block", F.floor(F.col("__pos") / BLOCK)), ["__block"], ["__pos"]


def take(df: DataFrame, n: int, order: list, by: list[str] | None = None, last: bool = False) -> DataFrame:
    """The first (or last) n rows in the order; a sort with a limit when there are no groups."""
    turned = [_reverse(o) for o in order] if last else order
    if not by:
        return df.orderBy(*turned).limit(n)
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy(*turned))).where(F.col("__r") <= n).drop("__r")


def _reverse(o: str | Column) -> Column:
    return F.desc(o) if isinstance(o, str) else o.desc()


def split_by_share(df: DataFrame, share: float, order: list, from_end: bool = False, out: str = "split") -> DataFrame:
    """Train: the first floor(share * size) rows, or the last ones with ``from_end``."""
    total = df.count()
    n = int(share * total)
    if not 0 < n < total:
        raise ValueError("the share must leave rows on both sides")
    placed = with_position(df, order, "__pos")
    train = F.col("__pos") >= total - n if from_end else F.col("__pos") < n
    return placed.withColumn(out, F.when(train, "train").otherwise("test")).drop("__pos")


def zip_frames(left: DataFrame, right: DataFrame, left_order: list, right_order: list) -> DataFrame:
    """Pairs rows by position; the longer side's rest has no partner and goes."""
    a, b = with_position(left, left_order), with_position(right, right_order)
    return a.join(b, "pos")


def collect_frames(frames: list[tuple[DataFrame, str, list]]) -> DataFrame:
    """k frames of equal size as rows of arrays: (pos, values)."""
    sizes = {df.count() for df, _, _ in frames}
    if len(sizes) > 1:
        raise ValueError(f"sizes differ: {sorted(sizes)}")
    placed = [with_position(df.select(F.col(c).alias(f"v{i}"), *[o for o in order if o != c]), [f"v{i}" if o == c else o for o in order]).select("pos", f"v{i}") for i, (df, c, order) in enumerate(frames)]
    joined = placed[0]
    for df in placed[1:]:
        joined = joined.join(df, "pos")
    return joined.select("pos", F.array(*(f"v{i}" for i in range(len(frames)))).alias("values"))


def lagged(df: DataFrame, value: Column | str, lags: dict[str, int], order: list, by: list[str] | None = None) -> DataFrame:
    """Adds earlier values: ``lags`` maps a new column to how many rows back it looks.

    Without groups each block of positions gets the last rows of the block before it, so its
    window is complete.
    """
    value = F.col(value) if isinstance(value, str) else value
    frame, keys, inner = _numbered(df, order, by)
    deepest = max(lags.values(), default=0)
    if not by:
        if deepest >= BLOCK:
            raise ValueError("a lag must be shorter than a block")
        frame = frame.withColumn("__own", F.lit(True))
        tail = frame.where(F.col("__pos") % BLOCK >= BLOCK - deepest).withColumn("__block", F.col("__block") + 1).withColumn("__own", F.lit(False))
        frame = frame.unionByName(tail)
    w = Window.partitionBy(*keys).orderBy(*inner)
    out = frame.withColumns({name: F.lag(value, k).over(w) for name, k in lags.items()})
    return out if by else out.where("__own").drop("__own", "__block", "__pos")


def delta_features(df: DataFrame, value: str, length: int, time_lag: int, order: list, by: list[str] | None = None) -> DataFrame:
    """``features``: ``length`` values, oldest first; ``target``: the value ``time_lag`` + 1 after the newest.

    A window has length + time_lag + 1 rows; rows with a shorter past are left out.
    """
    names = {f"__l{k}": k for k in range(time_lag + 1, time_lag + length + 1)}
    out = lagged(df.withColumn("__known", F.lit(True)), F.struct(F.col(value).alias("v")), names, order, by)
    ordered = [F.col(f"__l{k}.v") for k in range(time_lag + length, time_lag, -1)]
    whole = F.col(f"__l{time_lag + length}").isNotNull()
    return out.where(whole).withColumn("features", F.array(*ordered)).withColumn("target", F.col(value)).drop(*names, "__known")


def delta_features_vector(df: DataFrame, values: list[str], depths: list[int], order: list, by: list[str] | None = None, targets: list[str] | None = None) -> DataFrame:
    """Autoregressive features of several series, grouped by series and oldest first within each.

    ``depths`` gives each series its own depth; ``targets``: the series to predict (the first
    alone by default, as a number; several make an array).
    """
    deepest = max(depths)
    whole = F.struct(*(F.col(v).alias(f"v{i}") for i, v in enumerate(values)))
    names = {f"__l{k}": k for k in range(1, deepest + 1)}
    out = lagged(df, whole, names, order, by).where(F.col(f"__l{deepest}").isNotNull())
    features = [F.col(f"__l{k}.v{i}") for i, depth in enumerate(depths) for k in range(depth, 0, -1)]
    target = F.col(values[0]) if targets is None else F.array(*targets)
    return out.withColumn("features", F.array(*features)).withColumn("target", target).drop(*names)


def scan(df: DataFrame, value: str, order: list, by: list[str] | None = None, how: str = "sum", right: bool = False, out: str = "scan") -> DataFrame:
    """Running sum, min, max or product up to each row (from each row on with ``right``).

    The seed row of a fold is left to the caller (``with_seed``). Without groups: inside
    blocks, then across the blocks' totals.
    """
    functions = {"sum": F.sum, "min": F.min, "max": F.max, "product": F.product}
    f = functions[how]
    frame, keys, inner = _numbered(df, order, by)
    span = (0, Window.unboundedFollowing) if right else (Window.unboundedPreceding, 0)
    local = f(F.col(value)).over(Window.partitionBy(*keys).orderBy(*inner).rowsBetween(*span))
    if by:
        return frame.withColumn(out, local)
    beyond = (1, Window.unboundedFollowing) if right else (Window.unboundedPreceding, -1)
    totals = frame.groupBy("__block").agg(f(F.col(value)).alias("__t"))
    carried = totals.select("__block", f(F.col("__t")).over(Window.partitionBy(F.lit(0)).orderBy("__block").rowsBetween(*beyond)).alias("__c"))
    join = {"sum": lambda a, b: a + F.coalesce(b, F.lit(0)), "product": lambda a, b: a * F.coalesce(b, F.lit(1)), "min": F.least, "max": F.greatest}[how]
    return frame.withColumn("__own", local).join(carried, "__block").withColumn(out, join(F.col("__own"), F.col("__c"))).drop("__block", "__pos", "__own", "__c")


def fold(df: DataFrame, value: str, seed: Column, step, order: list[str], by: list[str], finish=None) -> DataFrame:
    """A fold in order inside each group, by any step (accumulator, element) → accumulator.

    For groups that fit a task; sums and the like have ``scan``.
    """
    rows = F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("__v"))))
    return df.groupBy(*by).agg(F.aggregate(rows, seed, lambda a, r: step(a, r["__v"]), finish).alias("fold"))


def grouped(df: DataFrame, value: str, n: int, order: list, by: list[str] | None = None) -> DataFrame:
    """Runs of n values in order, the last maybe shorter: (group, values)."""
    if by:
        numbered = df.withColumn("__pos", F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)
    else:
        numbered = with_position(df, order, "__pos")
    keys = [*(by or []), "group"]
    pairs = F.array_sort(F.collect_list(F.struct("__pos", F.col(value).alias("v"))))
    return numbered.withColumn("group", F.floor(F.col("__pos") / n)).groupBy(*keys).agg(F.transform(pairs, lambda p: p["v"]).alias("values"))


def concatenate(left: DataFrame, right: DataFrame, side: str = "side") -> DataFrame:
    """Both frames' rows, duplicates kept; ``side`` (0, 1) keeps left before right."""
    return left.withColumn(side, F.lit(0)).unionByName(right.withColumn(side, F.lit(1)))
