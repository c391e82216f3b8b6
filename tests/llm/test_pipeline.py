"""The pipeline's stages against brute force, each on its own input, corner cases included."""

from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F
from test_operators import slow_groups
from test_quality import slow_quality
from test_similar import slow_kept
from tests_support import plain_rows
from tokenizers import Tokenizer

import corpus_pipeline
from conftest import path
from lodestone.llm import quality, queries
from lodestone.session import shared_root

SF = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def odd(spark, corner):
    """Documents with nulls in all columns, equal and near texts, repeated ids, a very long text, clashing columns."""
    near = " ".join(f"word{i}" for i in range(60))
    more = [(30, near, "en", "a"), (31, near.replace("word7 ", "other "), "en", "a"), (32, near, None, None), (33, None, None, None)]
    extra = spark.createDataFrame(more, "doc_id long, text string, lang string, source string")
    return corner.unionByName(extra, allowMissingColumns=True).withColumns({"__at": F.lit(1), "__marked": F.lit("m"), "a": F.lit(2), "order": F.lit(None).cast("string")})


def test_order_of_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "packing"]
    assert corpus_pipeline.ORACLE_SQL is None


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def test_quality_stage(spark, documents):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept = STAGES["quality"](spark, documents, SF)
    rows = [(r["doc_id"], r["text"], r["source"], r["lang"]) for r in documents.collect()]
    expected = [row[0] for row, (*_, q) in zip(rows, slow_quality(rows, quality.fit(documents, labels)), strict=True) if q >= 0.5]
    assert kept.columns == documents.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(expected)
    good = {r["doc_id"] for r in labels.where("quality = 1").collect()}
    assert good & {k for k, *_ in rows} <= set(expected)


def test_exact_stage(spark, documents, odd):
    for docs in (documents.union(documents.withColumn("doc_id", F.col("doc_id") + 100_000)), odd):
        kept = STAGES["exact_dedup"](spark, docs, SF)
        groups = slow_groups(rows_of(docs))
        expected = [min(g, key=lambda k: (k is None, k or 0)) for g in groups.values()]
        order = lambda ids: sorted(ids, key=lambda k: (k is None, k or 0))
        assert kept.columns == docs.columns and order(k for k, _ in rows_of(kept)) == order(expected)


def test_near_stage(spark, documents, odd):
    twice = documents.union(documents.withColumn("doc_id", F.col("doc_id") + 100_000))
    kept = STAGES["near_dedup"](spark, twice, SF)
    assert kept.columns == documents.columns and sorted(k for k, _ in rows_of(kept)) == slow_kept(rows_of(twice))
    kept = STAGES["near_dedup"](spark, odd, SF)
    unique = [(k, t) for k, t in dict(sorted(((k, t) for k, t in rows_of(odd) if k is not None), reverse=True)).items()]
    assert kept.columns == odd.columns and sorted(k for k, _ in rows_of(kept) if k is not None) == slow_kept(unique)
    assert {30} == {k for k, _ in rows_of(kept)} & {30, 31, 32}


def test_packing_stage(spark, odd):
    library = Tokenizer.from_file(path("word_bpe_49k.json"))
    pieces = STAGES["packing"](spark, odd, SF)
    sizes = sorted(len(library.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in rows_of(odd))
    whole = pieces.where("start = 0").collect()
    assert sorted(r["doc_tokens"] for r in whole) == sizes
    assert pieces.agg(F.sum("length")).first()[0] == sum(sizes)


def test_stages_on_empty_and_odd_tables(spark, odd, nothing):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, SF).count() == 0, name
    docs = odd
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == odd.columns, name
    assert corpus_pipeline.packed(spark, docs, SF).count() >= docs.count()


def test_run(spark):
    folder = Path(shared_root(spark).removeprefix("file://").removeprefix("file:")) / "lodestone"
    before = set(folder.iterdir()) if folder.exists() else set()
    out = corpus_pipeline.run(spark, SF)
    # of all that the stages have written only the last result stays
    assert [p.name.partition("-")[0] for p in set(folder.iterdir()) - before] == ["stage"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for stage in (corpus_pipeline.quality, corpus_pipeline.exact, corpus_pipeline.near):
        docs = stage(spark, docs, SF)
    assert sorted({r["doc_id"] for r in out.collect()}) == sorted(k for k, _ in rows_of(docs))


def test_sql(spark):
    duck = duckdb.connect()
    for n in ("documents", "pages", "conversations"):
        duck.execute(f"CREATE VIEW {n} AS SELECT * FROM '{SF}/{n}.parquet'")
    for name, sql in queries.SQL.items():
        df = queries.QUERIES[name](spark, SF)
        columns = sorted(df.columns)
        cursor = duck.execute(sql)
        at = [d[0] for d in cursor.description]
        assert sorted(at) == columns
        assert plain_rows([[r[c] for c in columns] for r in df.collect()]) == plain_rows([[r[at.index(c)] for c in columns] for r in cursor.fetchall()])
