"""Rows of a stored table are found again by their place: bitmaps move, texts stay where they are."""

from __future__ import annotations

import atexit
import contextlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.session import new_path

#: Rows that share a bitmap (4,096 bytes), as ``bitmap_construct_agg`` has them.
SPAN = 1 << 15
#: Spark's own bound (``spark.sql.sources.bucketing.maxBuckets``), as it is set by default.
MOST_BUCKETS = 100_000


def _forget(spark: SparkSession, name: str) -> None:
    with contextlib.suppress(Exception):  # the session may have ended
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def placed(df: DataFrame, kind: str = "placed") -> DataFrame:
    """``df`` written to the shared folder, with ``__at`` (a long, unique) and ``__block``.

    ``__at`` counts the rows of a writing task, so 32,768 of them make a block and a task has few
    blocks. The table is bucketed by block without any shuffle; what is joined to it by block
    comes to the rows. As many buckets as the session has shuffle partitions.
    """
    spark = df.sparkSession
    path, name = new_path(spark, kind), f"lodestone_{kind}_{uuid.uuid4().hex}"
    atexit.register(_forget, spark, name)
    buckets = min(int(spark.conf.get("spark.sql.shuffle.partitions")), MOST_BUCKETS)
    rows = df.withColumn("__at", F.monotonically_increasing_id()).withColumn("__block", F.shiftright("__at", 15))
    rows.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(buckets, "__block").saveAsTable(name)
    return spark.table(name)


def _bit(bits: Column, at: Column) -> Column:
    place = at.bitwiseAND(F.lit(SPAN - 1)).cast("int")
    byte = F.conv(F.hex(F.substring(bits, F.shiftright(place, 3) + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.getbit(byte, place.bitwiseAND(F.lit(7))) == 1, F.lit(False))


def marked(stored: DataFrame, rows: DataFrame, name: str = "__marked") -> DataFrame:
    """``stored`` (of ``placed``) with ``name``: whether ``rows`` has the row's ``__at``.

    ``rows`` are narrow and meet by block, a bitmap each; only the bitmaps go to the table's buckets.
    """
    place = F.col("__at").bitwiseAND(F.lit(SPAN - 1))
    # by block first: no task may build a bitmap of each block
    dealt = rows.select(F.shiftright("__at", 15).alias("__block"), place.alias("__place")).repartition("__block")
    bits = dealt.groupBy("__block").agg(F.bitmap_construct_agg("__place").alias("__bits"))
    joined = stored.join(bits.hint("shuffle_hash"), "__block", "left")
    return joined.withColumn(name, _bit(F.col("__bits"), F.col("__at"))).drop("__bits")
