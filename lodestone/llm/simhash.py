"""SimHash fingerprints and their links, found by multi-index hashing."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.components import components
from lodestone.llm.words import spans
from lodestone.session import durable

SEED = 42
#: Row v: the eight bits of byte v, lowest first.
BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
#: Hashes held at once: the memory of a text doesn't grow with its length beyond its words.
BLOCK = 1 << 18


def fingerprint(text: bytes, words_per: int = 3) -> int:
    """64 bits; a bit is 1 if set in over half the hashes of the word shingles, repeats included."""
    line, starts, ends = spans(text, words_per)
    if not starts:
        return 0
    total, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(starts), BLOCK):
        s, e = starts[at : at + BLOCK], ends[at : at + BLOCK]
        hashes = np.fromiter((digest(line[a:b], SEED) for a, b in zip(s, e, strict=True)), np.uint64, len(s))
        octets = hashes.view(np.uint8).reshape(-1, 8)
        total += np.concatenate([np.bincount(octets[:, k], minlength=256) @ BITS for k in range(8)])
    on = np.packbits(total * 2 > len(starts), bitorder="little")
    return int(on.view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): each document's whole text as one signed 64-bit number; null counts as empty."""
    kind = dict(docs.dtypes)[id_col]

    def batches(frames):
        for batch in frames:
            values = batch.column(1).cast(pa.binary())
            found = np.fromiter((fingerprint(v.as_py() or b"") for v in values), np.uint64, len(values))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["id", "fp"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(batches, f"id {kind}, fp long")


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _balls(rows: DataFrame, value: Column, bits: int, tag: list[Column]) -> DataFrame:
    """Probes into a segment's table: the value, and each one-bit neighbour reached by setting a bit.

    Of two values one bit apart, only the one with the 0 reaches out, so each pair meets once.
    """
    ball = F.array(value, *[F.when(value.bitwiseAND(F.lit(1 << b)) == 0, value.bitwiseOR(F.lit(1 << b))) for b in range(bits)])
    return rows.select(*tag, F.explode(F.array_compact(ball)).alias("key"), "fp")


def links(distinct: DataFrame, bound: int = 3, crowded: int = 512) -> DataFrame:
    """Pairs (a, b), a < b, of distinct fingerprints ``fp`` that differ in at most 3 bits.

    A pair at distance 3 differs in at most one bit in one of its two 32-bit halves. Each
    half of each fingerprint is a row of that half's table; each also enumerates the Hamming
    ball of radius 1 around it, fetches the table's matches and verifies all 64 bits. Where
    more than ``crowded`` fingerprints share a half, the same is done again with the other
    half's two 16-bit parts (at distance 3, one of them has at most one differing bit), so
    that no bucket emits all its pairs; nothing is left out. Null fingerprints link nothing.
    """
    if bound != 3:
        raise ValueError("the segments are made for 3 differing bits")
    fps = distinct.where("fp is not null").select("fp")
    low, high = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("fp", 32)
    table = fps.select(F.lit(0).alias("seg"), low.alias("key"), "fp").union(fps.select(F.lit(1).alias("seg"), high.alias("key"), "fp"))
    full = durable(table.groupBy("seg", "key").count().where(F.col("count") > crowded).select("seg", "key"), "crowded")
    probes = _balls(fps, low, 32, [F.lit(0).alias("seg")]).union(_balls(fps, high, 32, [F.lit(1).alias("seg")]))
    near = lambda x, y: (distance(x, y) <= bound) & (x != y)
    pair = [F.least("t.fp", "p.fp").alias("a"), F.greatest("t.fp", "p.fp").alias("b")]

    def meet(t: DataFrame, p: DataFrame, on: list[str]) -> DataFrame:
        same = [F.col(f"t.{c}") == F.col(f"p.{c}") for c in on]
        # an unflipped probe meets both ways round; a flipped one only once
        once = (F.col("p.home") != F.col("t.home")) | (F.col("p.fp") < F.col("t.fp"))
        cond = near(F.col("t.fp"), F.col("p.fp")) & once
        for s in same:
            cond = cond & s
        # both sides are many times what the optimiser takes them for (it doesn't count exploded rows): never sent
        return t.alias("t").hint("merge").join(p.alias("p"), cond).select(*pair)

    def half(seg: str = "seg") -> Column:
        return F.when(F.col(seg) == 0, low).otherwise(high)

    table, probes = table.withColumn("home", half()), probes.withColumn("home", half())
    if not full.limit(1).count():
        return meet(table, probes, ["seg", "key"]).distinct()
    thin_t, thin_p = (x.join(full, ["seg", "key"], "left_anti") for x in (table, probes))
    found = meet(thin_t, thin_p, ["seg", "key"])
    # the other half, cut in two parts of 16 bits
    rest = F.when(F.col("seg") == 0, high).otherwise(low)
    parts = [(0, rest.bitwiseAND(F.lit(0xFFFF))), (1, F.shiftright(rest, 16))]
    dense_t, dense_p = (x.join(full, ["seg", "key"], "left_semi") for x in (table, probes))
    inner_t = None
    inner_p = None
    for j, part in parts:
        t = dense_t.select("seg", "key", "home", "fp", F.lit(j).alias("part"), part.alias("sub"))
        ball = F.array(part, *[part.bitwiseXOR(F.lit(1 << b)) for b in range(16)])
        p = dense_p.select("seg", "key", "home", "fp", F.lit(j).alias("part"), F.explode(ball).alias("sub"))
        inner_t, inner_p = (t, p) if inner_t is None else (inner_t.union(t), inner_p.union(p))
    return found.union(meet(inner_t, inner_p, ["seg", "key", "part", "sub"])).distinct()


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component_id): the smallest id that links of at most 3 bits reach, itself included.

    Equal fingerprints are one vertex, so thousands of copies cost one row of the search. Ids
    may repeat (each row comes back); a null id is returned with the smallest id of its
    group, or null if the group has no other. Empty tables give an empty result.
    """
    prints = durable(fingerprints(docs, id_col, text_col), "prints")
    vertex = durable(prints.groupBy("fp").agg(F.min("id").alias("first")), "vertices")
    groups = components(links(vertex))
    of = vertex.join(groups, vertex.fp == groups.node, "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
    least = of.groupBy("component").agg(F.min("first").alias("component_id"))
    owner = durable(of.join(least, "component").select("fp", "component_id"), "owners")
    return prints.join(owner, "fp").select("id", "fp", "component_id")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``near_groups`` with the fingerprint as 16 lowercase hex digits."""
    text = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return near_groups(docs, id_col, text_col).select(F.col("id").alias(id_col), text.alias("fingerprint"), "component_id")


def majority(hashes: np.ndarray, words: int) -> np.ndarray:
    """64 bits a word: a bit is 1 if set in over half the ``hashes``, which each word after the first mixes anew."""
    total = np.zeros((words, 64), np.int64)
    for at in range(0, len(hashes), BLOCK):
        some = hashes[at : at + BLOCK]
        for w in range(words):
            if w:  # the finaliser of SplitMix64, one to one
                some = some + np.uint64(0x9E3779B97F4A7C15)
                some = (some ^ (some >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                some = (some ^ (some >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                some = some ^ (some >> np.uint64(31))
            octets = some.view(np.uint8).reshape(-1, 8)
            total[w] += np.concatenate([np.bincount(octets[:, k], minlength=256) @ BITS for k in range(8)])
    return np.packbits(total * 2 > len(hashes), axis=1, bitorder="little").view(np.int64).ravel()


def reach(similarity: float, bits: int) -> int:
    """Differing bits of fingerprints of two sets of that Jaccard similarity: the mean and four deviations.

    For sets of one size; a bit differs with the angle between them as a share of the half turn.
    """
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return math.floor(bits * share + 4 * math.sqrt(bits * share * (1 - share)))


def meetings(prints: DataFrame, words: int) -> DataFrame:
    """Pairs (a, b), a < b, of rows ``at`` whose fingerprints ``fp`` (arrays of ``words`` longs) come within one bit in a segment.

    Each 32-bit segment of each fingerprint is a row of that segment's table; each value in it also
    enumerates the Hamming ball of radius 1 around it and fetches the table's matches. All rows of a
    value meet its first row, and the first rows of values one bit apart meet, so that a large group
    of near copies costs a row a text. Two fingerprints of fewer than four differing bits a word are
    so joined by a path, each step of which comes near in a segment; where a step is too far in all
    bits the caller has to find the pair in another way.
    """
    values = [v for w in range(words) for v in (F.col("fp")[w].bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(F.col("fp")[w], 32))]
    keys = F.array(*[v.bitwiseOR(F.lit(k << 32)) for k, v in enumerate(values)])
    table = prints.select("at", F.explode(keys).alias("key")).withColumn("first", F.min("at").over(Window.partitionBy("key")))
    table = durable(table, "segments")
    held = table.where("at = first").select("at", "key")
    probes = _balls(held.withColumn("fp", F.col("at")), F.col("key"), 32, []).withColumnRenamed("fp", "at")
    # as in ``links`` the optimiser doesn't count exploded rows
    found = held.alias("t").hint("merge").join(probes.alias("p"), (F.col("t.key") == F.col("p.key")) & (F.col("t.at") != F.col("p.at")))
    stars = table.where("at <> first").select(F.col("first").alias("a"), F.col("at").alias("b"))
    return found.select(F.least("t.at", "p.at").alias("a"), F.greatest("t.at", "p.at").alias("b")).union(stars).distinct()


def drop_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float | None = None, words_per: int = 5) -> DataFrame:
    """``docs`` with one document of each group of near copies: the one of the smallest id.

    Without ``similarity`` copies are linked by fingerprints of at most 3 differing bits. With it
    they are those whose sets of ``words_per`` words reach that Jaccard similarity: fingerprints of
    the sets meet in segments, all their bits are verified and the sets compared; as no number of
    bits is sure to hold that similarity, the sets' own tables find what lies further apart
    (``lodestone.llm.similar``). Nulls, repeats and empty tables are as in ``near_groups``.
    """
    if similarity is not None:
        from lodestone.llm.similar import drop_similar  # it is built on this module

        return drop_similar(docs, similarity, words_per, id_col, text_col)
    stored = durable(docs.withColumn("__at", F.monotonically_increasing_id()), "documents")
    order = F.struct(F.col(id_col).isNull().alias("n"), F.col(id_col).alias("id"), F.col("__at").alias("at"))
    groups = near_groups(stored.select(order.alias("__order"), F.col(text_col)), "__order", text_col)
    kept = groups.where(F.col("id") == F.col("component_id")).select(F.col("id.at").alias("__at"))
    return stored.join(kept, "__at", "left_semi").drop("__at")
