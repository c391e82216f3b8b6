"""Process queries answer for every row of their table."""

import pytest

from lodestone import queries as library
from lodestone.queries.learning import series
from lodestone.queries.registry import Tables

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["M11_warped_process", "M13_matrix_t", "M14_skew_process", "M15_M25_mixture"])
def test_every_row(spark, name):
    ids = sorted(r["event_id"] for r in series(Tables(spark, SF)).select("event_id").collect())
    rows = library.QUERIES[name](spark, SF).collect()
    assert sorted(r["event_id"] for r in rows) == ids
    assert all(v is not None for r in rows for v in r)
