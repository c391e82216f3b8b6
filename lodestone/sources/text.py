"""Lines, delimited values and ARFF files, in and out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.operators.ordered import with_position


def lines(spark: SparkSession, path: str, numbered: bool = True) -> DataFrame:
    """(pos, value): a file's lines in order, from 0; gzip by its suffix.

    Unnumbered lines keep only a number that rises with the order.
    """
    raw = spark.read.text(path).select(F.monotonically_increasing_id().alias("__at"), "value")
    return with_position(raw, ["__at"]).drop("__at") if numbered else raw.withColumnRenamed("__at", "pos")


def csv(spark: SparkSession, path: str, schema: str | T.StructType, separator: str = ",", header: bool = False, quote: str = '"', missing: str = "") -> DataFrame:
    """Typed by the given schema, never inferred; what doesn't fit becomes null."""
    return spark.read.csv(path, schema=schema, sep=separator, header=header, quote=quote, nullValue=missing, mode="PERMISSIVE")


def numbered_schema(columns: int, kind: str = "double") -> str:
    return ", ".join(f"c{i} {kind}" for i in range(columns))


def write_lines(df: DataFrame, path: str, column: str = "value") -> None:
    df.select(F.col(column).cast("string").alias("value")).write.mode("overwrite").text(path)


def write_values(df: DataFrame, path: str, separator: str = ",") -> None:
    """Rows as joined lines; null is empty."""
    joined = F.concat_ws(separator, *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns))
    df.select(joined.alias("value")).write.mode("overwrite").text(path)


def json_rows(df: DataFrame) -> Column:
    return F.to_json(F.struct(*df.columns))


def replaced_lines(spark: SparkSession, path: str, find: str, by: str) -> DataFrame:
    """(pos, value): a file's lines in order, with every match of a pattern replaced."""
    return lines(spark, path).withColumn("value", F.regexp_replace("value", find, by))


def parse_json(df: DataFrame, schema: str, column: str = "value") -> DataFrame:
    """The fields of JSON lines by a given schema; a line that doesn't fit gives nulls."""
    return df.select(F.from_json(column, schema).alias("__j")).select("__j.*")


# -- ARFF ---------------------------------------------------------------------------------------------------


def arff_attributes(head: list[str]) -> list[tuple[str, str]]:
    """(name, kind) of the declared attributes: numeric, string or the nominal values in braces."""
    found = []
    for line in head:
        word, _, rest = line.strip().partition(" ")
        if word.lower() == "@attribute":
            rest = rest.strip()
            quote = rest[0] if rest[0] in "'\"" else None
            name, _, kind = rest[1:].partition(quote) if quote else rest.partition(" ")
            found.append((name, kind.strip()))
    return found


def arff(spark: SparkSession, path: str) -> DataFrame:
    """Typed rows: numbers as double, strings and nominal values as string, ``?`` as null.

    Only one file's head, up to ``@data``, is read on the driver; data lines are parsed where
    they lie. Each file of a directory has a head of its own, and all must declare the same;
    a file without ``@data`` is refused.
    """
    lines = spark.read.text(path, wholetext=False).select(F.monotonically_increasing_id().alias("at"), F.input_file_name().alias("file"), F.trim("value").alias("value"))
    raw = lines.where((F.col("value") != "") & ~F.col("value").startswith("%"))
    starts = raw.groupBy("file").agg(F.min(F.when(F.lower("value") == "@data", F.col("at"))).alias("start"))
    headless = starts.where("start is null").first()
    first = starts.agg(F.min_by(F.struct("file", "start"), "file").alias("f")).first()["f"]
    if headless or first is None:
        raise ValueError(f"no @data in {headless['file'] if headless else path}")
    placed = raw.join(starts, "file")
    heads = placed.where(F.col("at") < F.col("start"))
    head = [r["value"] for r in heads.where(F.col("file") == first["file"]).orderBy("at").collect()]
    declared = F.array_sort(F.collect_list(F.when(F.lower("value").startswith("@attribute"), F.struct("at", F.regexp_replace("value", r"\s+", " ").alias("v")))))
    if heads.groupBy("file").agg(F.transform(declared, lambda s: s["v"]).alias("d")).select("d").distinct().limit(2).count() > 1:
        raise ValueError(f"the files of {path} declare different attributes")
    fields = F.split("value", r"\s*,\s*")
    columns = []
    for i, (name, kind) in enumerate(arff_attributes(head)):
        cell = F.regexp_replace(F.try_element_at(fields, F.lit(i + 1)), r"^['\"]|['\"]$", "")
        cell = F.when(cell != "?", cell)
        columns.append((cell.try_cast("double") if kind.lower() in ("numeric", "real", "integer") else cell).alias(name))
    return placed.where(F.col("at") > F.col("start")).select(*columns)


def write_arff(df: DataFrame, path: str, relation: str = "data", nominal: dict[str, list[str]] | None = None) -> None:
    nominal = nominal or {}
    kind = lambda n, t: "{" + ",".join(nominal[n]) + "}" if n in nominal else "numeric" if t in ("double", "float", "int", "bigint", "smallint", "tinyint") else "string"
    head = [f"@relation {relation}", *(f"@attribute {n} {kind(n, t)}" for n, t in df.dtypes), "@data"]
    cells = [F.coalesce(F.col(n).cast("string"), F.lit("?")) for n in df.columns]
    body = df.select(F.lit(1).alias("o"), F.concat_ws(",", *cells).alias("value"))
    top = df.sparkSession.createDataFrame([(0, "\n".join(head))], "o int, value string")
    # one file: the head must stand before the rows
    top.unionByName(body).coalesce(1).sortWithinPartitions("o").select("value").write.mode("overwrite").text(path)
