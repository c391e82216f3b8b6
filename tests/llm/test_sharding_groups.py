"""Large groups of equal texts stay whole."""

from collections import Counter

from lodestone.llm import sharding


def spread(spark, sizes, total=1600):
    texts = [f"group {k}" for k, n in enumerate(sizes) for _ in range(n)]
    texts += [f"single {k}" for k in range(total - len(texts))]
    rows = sharding.shard_equal_texts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(total))
    counts = Counter(r["shard"] for r in rows)
    assert set(counts.values()) == {total // 8}
    for j in counts:
        assert sorted(r["slot"] for r in rows if r["shard"] == j) == list(range(counts[j]))
    return [len({r["shard"] for r in rows if texts[r["doc_id"]] == f"group {k}"}) for k in range(len(sizes))]


def test_groups_take_the_fewest_shards(spark):
    assert spread(spark, [180, 120, 110, 90, 60]) == [1] * 5
    assert spread(spark, [530, 150]) == [3, 1]


def test_small_tables_lose_no_link(spark):
    """As many groups stay whole as shards of seven and eight rows can hold."""
    for sizes, total, whole in (([6] * 10, 60, 8), ([2] * 30, 60, 28), ([3] * 20, 61, 16), ([5] * 3 + [2] * 40, 200, 43)):
        texts = [f"group {k}" for k, n in enumerate(sizes) for _ in range(n)]
        texts += [f"single {k}" for k in range(total - len(texts))]
        rows = sharding.shard_equal_texts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()
        counts = Counter(r["shard"] for r in rows)
        assert sum(counts.values()) == total and max(counts.values()) - min(counts.values()) <= 1 and len(counts) == 8
        assert sum(len({r["shard"] for r in rows if texts[r["doc_id"]] == f"group {k}"}) == 1 for k in range(len(sizes))) >= whole


def test_cut_links_of_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    shard = {r["doc_id"]: r["shard"] for r in sharding.shard_equal_texts(docs).collect()}
    groups = {}
    for r in docs.collect():
        groups.setdefault(r["text"] or "", []).append(shard[r["doc_id"]])
    links = [(a, b) for g in groups.values() for i, a in enumerate(g) for b in g[:i]]
    assert len(links) > 20 and all(a == b for a, b in links)
