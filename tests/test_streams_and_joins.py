"""Streams over files, joins with bounds, and corner cases of grouped operators."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lodestone.operators import joins, ordered, pipes, scalers
from lodestone.plans import fields, prototypes
from lodestone.sources import feeds
from lodestone.streaming import tables


@pytest.fixture
def events(spark, tmp_path):
    start = datetime(2024, 1, 1)
    rows = [(i, start + timedelta(minutes=7 * i), i % 3, float(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, value double")
    df.repartition(2).write.parquet(str(tmp_path / "events"))
    return df, tables.read(spark, str(tmp_path / "events"), df)


def test_time_windows(spark, events):
    batch, stream = events
    got = tables.drain(tables.windowed(stream, "ts", "value", ["user_id"], "1 hour", late="1 day"), "w1", "complete")
    plain = batch.groupBy(F.window("ts", "1 hour"), "user_id").agg(F.sum("value").alias("total"))
    key = lambda r: (r["start"], r["user_id"], r["total"])
    assert sorted(map(key, got.collect())) == sorted(map(key, plain.select(F.col("window.start").alias("start"), "user_id", "total").collect()))


def test_sessions(spark, events):
    _, stream = events
    got = tables.drain(tables.sessions(stream, "ts", ["user_id"], "30 minutes", late="1 day"), "s1", "complete")
    assert sorted(r["n"] for r in got.collect()) == [20, 20, 20]


def test_as_of_with_and_without_spans(spark):
    left = spark.createDataFrame([("a", 5.0), ("a", 1.0), ("b", 9.0)], "k string, t double")
    right = spark.createDataFrame([("a", 2.0, "x"), ("a", 4.0, "y"), ("b", 10.0, "z")], "k string, t double, v string")
    for span in (None, 1.5, 100.0):
        got = {(r["k"], r["t"]): r["r_v"] for r in joins.as_of(left, right, ["k"], "t", span).collect()}
        assert got == {("a", 5.0): "y", ("a", 1.0): None, ("b", 9.0): None}


def test_all_pairs_are_refused_beyond_the_bound(spark):
    with pytest.raises(ValueError):
        joins.pairs(spark.range(5), spark.range(11), most=10)


def test_last_right_row_wins(spark):
    left = spark.createDataFrame([(1, "l"), (1, "m"), (2, "n")], "k long, a string")
    right = spark.createDataFrame([(1, 1, "old"), (1, 2, "new"), (3, 1, "none")], "k long, pos long, b string")
    got = joins.last_wins_join(left, right, "k", ["pos"]).select("a", "b").collect()
    assert sorted(map(tuple, got)) == [("l", "new"), ("m", "new")]


def test_nulls_go_to_the_other_side(spark):
    df = spark.createDataFrame([(1,), (None,), (3,)], "v int")
    yes, no = pipes.partitioned(F.col("v") > 2)(df)
    assert (yes.count(), no.count()) == (1, 2)


def test_sizes_must_match(spark):
    with pytest.raises(ValueError):
        ordered.collect_frames([(spark.range(3), "id", ["id"]), (spark.range(4), "id", ["id"])])


def test_tensors(spark):
    t = feeds.tensor(F.array(*(F.lit(float(i)) for i in range(6))), [2, 3])
    r = spark.range(1).select(feeds.unstack(t).alias("u"), feeds.tensor(F.array(F.lit(1.0)), [2]).alias("bad"), feeds.filled([2, 2], 3.0).alias("f")).first()
    assert [u["data"] for u in r["u"]] == [[0.0, 1.0, 2.0], [3.0, 4.0, 5.0]] and r["bad"] is None and r["f"]["data"] == [3.0] * 4


def test_scalers_invert(spark):
    df = spark.createDataFrame([([float(i), float(i * i % 7)],) for i in range(20)], "x array<double>")
    for kind in ("gaussian", "mean", "minmax", "whitening", "pca"):
        s = scalers.fit(df, "x", kind)
        back = s.invert(s.apply(df, "x"), "x").collect()
        for a, b in zip(df.collect(), back, strict=True):
            assert a["x"] == pytest.approx(b["x"], abs=1e-9)


def test_heat_flows_down(spark):
    df = spark.range(5).select(F.col("id").alias("i"), F.when(F.col("id") == 2, 1.0).otherwise(0.0).alias("u"))
    got = {r["i"]: r["u"] for r in fields.heat_step(df, ["i"], "u", [1.0], 0.1).collect()}
    assert got == pytest.approx({0: 0.0, 1: 0.1, 2: 0.8, 3: 0.1, 4: 0.0})


def test_prototypes_gain_entropy(spark):
    df = spark.range(200).select(F.array(F.randn(1), F.randn(2)).alias("x"))
    few, more = (prototypes.entropy(prototypes.select(df, "x", 8, tries=n), 1.0) for n in (0, 100))
    assert more >= few


def test_ranks_over_several_blocks(spark, monkeypatch):
    """Ranks and order statistics carry over block borders."""
    import random

    from lodestone.operators import ordered, stats

    monkeypatch.setattr(ordered, "BLOCK", 7)
    r = random.Random(1)
    values = [r.randrange(40) for _ in range(200)]
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    at = sorted(values)
    expected = {v: sum(i + 1 for i, w in enumerate(at) if w == v) / at.count(v) for v in set(values)}
    assert {x["v"]: x["rank"] for x in stats.ranks(df, "v").distinct().collect()} == expected
    for k in (1, 50, 200):
        assert stats.quickselect(df, "v", k).first()["value"] == at[k - 1]
    assert stats.quickselect(df, "v", 201).first()["value"] is None


def test_kalman_path_over_runs(spark):
    """A series cut in many runs gives what one fold gives; one series holds a third of all rows."""
    import random

    from lodestone.plans import sequences

    r = random.Random(2)
    rows = [(k, t, r.gauss(0, 1)) for k in range(20) for t in range(300 if k == 0 else 30)]
    df = spark.createDataFrame(rows, "k int, t int, v double").repartition(5)
    expected = {}
    for k, t, v in rows:
        m, c = expected.get((k, t - 1), (0.5, 2.0))
        g = (c + 0.1) / (c + 0.6)
        expected[k, t] = m + g * (v - m), g * 0.5
    for block in (1, 7, 4096):
        got = {(x["k"], x["t"]): (x["mean"], x["variance"]) for x in sequences.kalman_path(df, ["k"], ["t"], "v", 0.1, 0.5, 0.5, 2.0, block).collect()}
        assert set(got) == set(expected)
        assert all(abs(got[key][i] - expected[key][i]) < 1e-9 for key in got for i in (0, 1))


def test_state_lives_across_batches(spark, tmp_path):
    """A key's rows come in three files; equal times inside a file are told apart by the second column."""
    from lodestone.streaming import tables

    rows = [(k, t // 2, t, float(t * 10 + k)) for t in range(12) for k in range(3)]
    df = spark.createDataFrame(rows, "k int, t int, i int, v double")
    for part in range(3):
        df.where(F.floor(F.col("i") / 4) == part).orderBy(F.desc("i")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    got = tables.drain(tables.lag_features(tables.read(spark, str(tmp_path / "in"), df), "k", ["t", "i"], "v", 3), "lags_of_batches", "append").collect()
    assert sorted((x["k"], x["i"], x["features"], x["target"]) for x in got) == sorted((k, i, [float((i - d) * 10 + k) for d in (3, 2, 1)], v) for k, _, i, v in rows if i >= 3)
    done = tables.drain(tables.kalman(tables.read(spark, str(tmp_path / "in"), df), "k", ["t", "i"], "v", 0.1, 0.5), "kalman_of_batches", "update")
    assert done.count() == 9
    for k in range(3):
        m, c = 0.0, 1.0
        for t in range(12):
            g = (c + 0.1) / (c + 0.6)
            m, c = m + g * (t * 10 + k - m), g * 0.5
        last = done.where(f"k = {k} and n = 12").first()
        assert abs(last["mean"] - m) < 1e-9 and abs(last["variance"] - c) < 1e-12


def test_arff_directories(spark, tmp_path):
    import pytest

    from lodestone.sources import text

    for name, row in (("a", "1,x"), ("b", "2,?")):
        (tmp_path / f"{name}.arff").write_text(f"% c\n@relation r\n@attribute n numeric\n@attribute  s string\n@data\n{row}\n")
    assert sorted(tuple(r) for r in text.arff(spark, str(tmp_path)).collect()) == [(1.0, "x"), (2.0, None)]
    (tmp_path / "c.arff").write_text("@relation r\n@attribute n numeric\n")
    with pytest.raises(ValueError):
        text.arff(spark, str(tmp_path))
    (tmp_path / "c.arff").write_text("@relation r\n@attribute z numeric\n@data\n3\n")
    with pytest.raises(ValueError):
        text.arff(spark, str(tmp_path))
