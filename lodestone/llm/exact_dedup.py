"""Exact duplicates: a 128-bit content hash groups, a byte comparison decides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.places import marked, placed
from lodestone.session import durable

WHITE = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    """Null counts as empty; each run of ASCII white space becomes one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, " ")


def content_hash(text: Column) -> Column:
    return F.unhex(F.md5(text))


def _groups(stored: DataFrame, key: Column, text: Column, hashed) -> DataFrame:
    """(__at, __id, __keep, __size, __kept, __sha) of each row of ``stored``, a table of ``placed``.

    1. A narrow pass (id, 128-bit hash) finds the hashes that more than one row has. Rows of
       a group are summed before the shuffle, so a group with a third of all rows is small.
    2. Only texts under such a hash move, one for each hash and task: the least and the greatest
       of a hash are the same bytes exactly if all its texts are. The other texts are told apart
       by their places, without a shuffle.
    3. Under a hash of several texts (a collision of ``hashed``) rows are grouped by text.
    """
    narrow = durable(stored.select("__at", key.alias("__id"), hashed(text).alias("__h"), F.sha2(text, 256).alias("__sha")), "hashes")
    # the first row of a hash is its representative; the struct orders null ids last
    first = F.min(F.struct(F.col("__id").isNull().alias("n"), F.col("__id").alias("id"), F.col("__at").alias("at"))).alias("__first")
    shared = durable(narrow.groupBy("__h").agg(F.count("*").alias("__n"), first).where("__n > 1"), "shared", rows=narrow.count())
    # written out, so that the join has shuffles of its own, which Spark may split
    rows = durable(narrow.join(shared, "__h", "left"), "rows")
    copied = marked(stored.select("__at", "__block", text.alias("__text")), rows.where("__n is not null").select("__at")).where("__marked").select("__at", hashed(F.col("__text")).alias("__h"), "__text")
    mixed = durable(copied.groupBy("__h").agg(F.min("__text").alias("least"), F.max("__text").alias("most")).where("least <> most").select("__h"), "collisions")

    def told(of: DataFrame) -> DataFrame:
        alone = F.col("__n").isNull()
        return of.select(
            "__at", "__id", F.when(alone, F.col("__id")).otherwise(F.col("__first.id")).alias("__keep"), F.coalesce("__n", F.lit(1).cast("long")).alias("__size"),
            (alone | (F.col("__at") == F.col("__first.at"))).alias("__kept"), "__sha",
        )

    if not mixed.limit(1).count():
        return told(rows)
    by = ["__h", "__text"]
    torn = durable(copied.join(mixed, "__h", "left_semi").join(narrow.select("__at", "__id", "__sha"), "__at"), "torn")
    parts = durable(torn.groupBy(*by).agg(F.count("*").alias("__n"), first), "parts")
    return told(rows.join(mixed, "__h", "left_anti")).unionByName(told(torn.join(parts, by)))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hashed=content_hash) -> DataFrame:
    """One row per document: id, keep id, group size, kept, hash of the normalised text.

    Equal are texts of the same bytes after ``normalised``; of each group the row with the
    smallest id stays. Null texts count as empty, null ids sort last (a group of null ids only
    keeps a null id), repeated ids stay as rows of their own, of which one is ``kept``. Long
    texts are taken whole. An empty table gives an empty result; other columns are not read.
    """
    stored = placed(docs.select(F.col(id_col).alias("__id"), normalised(F.col(text_col)).alias("__text")), "texts")
    found = _groups(stored, F.col("__id"), F.col("__text"), hashed)
    return found.select(F.col("__id").alias(id_col), F.col("__keep").alias("keep_id"), F.col("__size").alias("group_size"), F.col("__kept").alias("kept"), F.col("__sha").alias("text_sha256"))


def drop_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the row that ``exact_groups`` keeps of each group of equal texts; all columns stay.

    Nulls, repeats and empty tables are as there; columns may have any names.
    """
    names = docs.columns
    stored = placed(docs.select(*(F.col(f"`{c}`").alias(f"__c{i}") for i, c in enumerate(names))), "documents")
    key, text = F.col(f"__c{names.index(id_col)}"), normalised(F.col(f"__c{names.index(text_col)}"))
    gone = _groups(stored, key, text, content_hash).where("not __kept").select("__at")
    return marked(stored, gone).where(~F.col("__marked")).select(*(F.col(f"__c{i}").alias(c) for i, c in enumerate(names)))
