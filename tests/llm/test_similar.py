"""The near-duplicate stage against brute force: five words, Jaccard similarity of 0.8 or more."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodestone.llm import similar, simhash
from lodestone.llm.similar import drop_similar
from test_operators import components_of


def slow_sets(rows):
    words = {k: (t or "").encode().lower().split() for k, t in rows}
    return {k: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for k, w in words.items()}


def slow_kept(rows):
    sets = slow_sets(rows)
    near = lambda a, b: len(a & b) * 5 >= len(a | b) * 4
    links = [(a, b) for a in sets for b in sets if a < b and near(sets[a], sets[b])]
    return sorted(k for k, c in components_of(links, sets).items() if k == c)


def test_stage_keeps_one_of_similar(spark, documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    near = dict(corpus_pipeline.STAGES)["near_dedup"](spark, documents, "")
    assert near.columns == documents.columns
    assert sorted(r["doc_id"] for r in near.collect()) == slow_kept(rows)


def test_chains_and_groups(spark):
    """Copies that are similar only by a chain, unlike texts of a common passage, a text without words."""
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    base, passage = [word() for _ in range(150)], [word() for _ in range(40)]
    texts = [" ".join(base)]
    for _ in range(150):
        copy = list(base)
        for _ in range(r.randrange(6)):
            copy[r.randrange(150)] = word()
        texts.append(" ".join(copy))
    texts += [" ".join(passage + [word() for _ in range(r.randrange(30))]) for _ in range(60)]
    for _ in range(12):
        base[r.randrange(150)] = word()
        texts.append(" ".join(base))
    r.shuffle(texts)
    rows = list(enumerate([*texts, "", None, " \n", "a b", "A  b", texts[0]]))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(x["doc_id"] for x in drop_similar(df).collect()) == slow_kept(rows)


def test_corners(corner, nothing):
    kept = drop_similar(corner)
    assert kept.columns == corner.columns and sorted(x["doc_id"] for x in kept.collect() if x["doc_id"]) == [1, 3, 5, 7, 8, 9]
    assert drop_similar(nothing).count() == 0
    with pytest.raises(ValueError):
        drop_similar(corner.where(F.lit(True)), similarity=0.0)


def test_segments_meet(spark):
    """Per 32-bit segment rows of one value meet its first row, and the first rows of values one bit apart meet."""
    r = random.Random(5)
    fps = [[r.getrandbits(64), r.getrandbits(64)] for _ in range(60)]
    for f in list(fps):
        fps.append([f[0] ^ sum(1 << b for b in r.sample(range(64), 3)), f[1] ^ sum(1 << b for b in r.sample(range(64), 4))])
    fps += [[7, r.getrandbits(64)] for _ in range(20)] + [[6, r.getrandbits(64)]]  # values of many rows, and a neighbour
    near = set()
    for w, s in ((w, s) for w in (0, 1) for s in (0, 32)):
        parts = [(f[w] >> s) & 0xFFFFFFFF for f in fps]
        first = {p: parts.index(p) for p in parts}
        near |= {(first[p], i) for i, p in enumerate(parts) if first[p] != i}
        near |= {(min(first[p], first[q]), max(first[p], first[q])) for p in first for q in first if (p ^ q).bit_count() == 1}
    rows = [(i, np.array(f, np.uint64).view(np.int64).tolist()) for i, f in enumerate(fps)]
    df = spark.createDataFrame(rows, "at long, fp array<long>").repartition(3)
    assert sorted((x["a"], x["b"]) for x in simhash.meetings(df, 2).collect()) == sorted(near)
    assert {(i, i + 60) for i in range(60)} | {(120, 139), (120, 140)} <= near


def test_majority_of_bits():
    hashes = np.array([random.Random(i).getrandbits(64) for i in range(301)], np.uint64)
    first, second = (int(x) for x in simhash.majority(hashes, 2).view(np.uint64))
    assert first == sum(1 << b for b in range(64) if sum(int(h) >> b & 1 for h in hashes) * 2 > len(hashes))
    assert int(simhash.majority(hashes, 1).view(np.uint64)[0]) == first != second


def test_stage_goes_by_fingerprints(spark, monkeypatch):
    """The stage takes its near copies from the segments' tables; without these the same rows stay."""
    r = random.Random(7)
    base = [[f"w{r.randrange(5000)}" for _ in range(300)] for _ in range(12)]
    rows = [(i, " ".join(b)) for i, b in enumerate(base)] + [(100 + i, " ".join([*b[:-1], "last"])) for i, b in enumerate(base)]
    # similar, but further apart than most that the segments find
    rows += [(200 + i, " ".join([*b[:280], *(f"v{i}-{k}" for k in range(30))])) for i, b in enumerate(base)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    stage, seen = dict(corpus_pipeline.STAGES)["near_dedup"], []

    def watched(prints, words):
        seen.append({(x["a"], x["b"]) for x in simhash.meetings(prints, words).collect()})
        return simhash.meetings(prints, words)

    def blind(prints, words):
        return simhash.meetings(prints.where(F.lit(False)), words)

    for instead in (watched, blind):
        monkeypatch.setattr(similar, "meetings", instead)
        assert sorted(x["doc_id"] for x in stage(spark, df, "").collect()) == slow_kept(rows) == list(range(12))
    assert len(seen) == 1 and len(seen[0]) >= 12
