"""Rows found again by their places: several blocks a task, no rows, marks from several tasks."""

from pyspark.sql import functions as F

from lodestone.llm.places import SPAN, marked, placed


def test_marks(spark):
    df = spark.range(0, 3 * SPAN, 1, 2).select(F.col("id").alias("k"), F.lit("x").alias("__bits"), F.lit("y").alias("text"))
    stored = placed(df.withColumnRenamed("__bits", "bits"))
    assert stored.select("__at").distinct().count() == 3 * SPAN and stored.select("__block").distinct().count() >= 3
    some = stored.where("k % 7 = 2 or k in (0, 32767, 32768, 98303)").select("__at").repartition(5)
    got = marked(stored, some.union(some))
    assert got.count() == 3 * SPAN
    assert got.where("__marked <> (k % 7 = 2 or k in (0, 32767, 32768, 98303))").count() == 0
    assert marked(stored, some.where(F.lit(False))).where("__marked").count() == 0


def test_no_text_moves(spark):
    stored = placed(spark.range(1000).withColumn("text", F.lit("x")))
    plan = marked(stored, stored.where("id % 3 = 0").select("__at"))._jdf.queryExecution().executedPlan().toString()
    shuffles = [line for line in plan.splitlines() if "Exchange" in line]
    assert shuffles and all("__block" in line for line in shuffles) and "Bucketed: true" in plan


def test_empty(spark):
    stored = placed(spark.range(0).withColumn("text", F.lit("x")))
    assert stored.count() == 0 and marked(stored, stored.select("__at")).count() == 0
