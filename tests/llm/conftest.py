import pytest
from pyspark.sql import functions as F


@pytest.fixture(scope="session")
def corner(spark):
    """Nulls, empty and long texts, ties, repeated rows, extra and clashing columns."""
    long = " ".join(f"word{i % 97}." for i in range(30_000))
    rows = [
        (1, "Alpha beta  gamma.\n", "en", "a"), (2, "Alpha beta gamma. ", None, "a"), (3, None, "en", None), (4, "", "de", "b"),
        (5, long, "en", "a"), (6, long, "en", "a"), (7, "  two  spaces ▁ mark ", "fr", "b"), (8, "É 漢字 😀 <|endoftext|> \t tab", None, None),
        (8, "É 漢字 😀 <|endoftext|> \t tab", None, None), (9, "x", "en", "a"), (None, "no id", "en", "a"), (11, "Alpha beta gamma.", "en", "c"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return df.withColumns({"id": F.lit("clash"), "fp": F.lit(1.5), "shard": F.lit("s"), "n_chars": F.length("text").cast("long"), "keep": F.lit(False), "node": F.lit(0)})


@pytest.fixture(scope="session")
def nothing(corner):
    return corner.where(F.lit(False))


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


def path(name):
    import public_tokenizers

    return public_tokenizers.path(name)
