"""Shards by balanced label propagation, in DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.numbering import number
from lodestone.session import durable, remove

UNIT = float(1 << 32)


def capacities(rows: int, shards: int) -> list[int]:
    """How many rows each shard takes: counts at most one apart."""
    return [rows // shards + (j < rows % shards) for j in range(shards)]


def quotas(sizes: list[int], room: list[int], wanted: dict[tuple[int, int], int]) -> dict[tuple[int, int], int]:
    """How many of the wanted moves (from, to) may happen so that no shard passes its room.

    Starts with all and lowers the moves into each overfull shard in proportion until none
    is; a shard that began overfull takes none in. Works on shards x shards numbers.
    """
    moves = dict(wanted)
    while True:
        tight = True
        for j, most in enumerate(room):
            out = sum(n for (a, _), n in moves.items() if a == j)
            into = {k: n for k, n in moves.items() if k[1] == j and n}
            allowed = max(0, most - sizes[j] + out)
            total = sum(into.values())
            if total > allowed:
                tight = False
                left = allowed
                for k, n in sorted(into.items()):
                    moves[k] = min(n * allowed // total, left)
                    left -= moves[k]
                for k, n in sorted(into.items()):
                    extra = min(left, n - moves[k])
                    moves[k] += extra
                    left -= extra
        if tight:
            return {k: n for k, n in moves.items() if n}


def pack_groups(groups: list[tuple], room: list[int]) -> list[tuple]:
    """(group, shard, from, upto): places of each (group, size), the largest first, whole where they fit.

    A group takes the fullest shard that still holds it; if none does, it fills the emptiest
    one whole and goes on with the rest.
    """
    free, out = list(room), []
    for name, size in sorted(groups, key=lambda g: (-g[1], g[0])):
        at = 0
        while at < size:
            fits = [(n, j) for j, n in enumerate(free) if n >= size - at]
            j = min(fits)[1] if fits else free.index(max(free))
            n = min(free[j], size - at)
            out.append((name, j, at, at + n))
            free[j] -= n
            at += n
    return out


def _priority(node: Column, degree: Column, turn: int) -> Column:
    """Nodes of few links give way to those of many; among equals a hash decides anew each round."""
    return F.pmod(F.xxhash64(node, F.lit(turn)), F.lit(1 << 32)) / F.lit(UNIT) / degree


def propagate(links: DataFrame, room: list[int], rounds: int = 8) -> DataFrame:
    """(node, shard) for the nodes of ``links`` (a, b: long), linked ones gathered within ``room``.

    Labels start from a hash of the node. In each round a node counts its neighbours' labels
    (a join and two sums, both combined before their shuffles, so a node with a third of all
    links is no task of its own) and wants the label that most of them have. It may move if
    that gains links and no neighbour has a higher priority, so that two neighbours never
    swap; the driver sets quotas on the shards x shards counts of wanted moves and the rows
    up to each quota move. Labels stay in tables of the shared folder. Ends when nobody
    wants to move, or after ``rounds``. No shard ever grows past its room; one whose first labels
    were too many only loses rows here.
    """
    spark, shards = links.sparkSession, len(room)
    sound = links.where("a is not null and b is not null and a <> b")
    both = sound.select("a", "b").union(sound.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = durable(both, "edges")
    n = edges.count()
    degrees = edges.groupBy("a").agg(F.count("*").alias("degree"))
    first = F.pmod(F.xxhash64("a"), F.lit(shards)).cast("int")
    if max(room) - min(room) > 1:
        # in proportion to the room
        first, upto, place = F.lit(shards - 1), sum(room), F.pmod(F.xxhash64("a"), F.lit(sum(room)))
        for j in reversed(range(shards)):
            first = F.when(place < upto, F.lit(j)).otherwise(first)
            upto -= room[j]
    nodes = durable(degrees.select(F.col("a").alias("node"), "degree", first.alias("shard")), "nodes", rows=n)
    paths: list[str] = []
    state = nodes
    for turn in range(rounds):
        about = state.select(F.col("node").alias("b"), F.col("shard").alias("near"), F.struct(_priority(F.col("node"), F.col("degree"), turn).alias("p"), F.col("node").alias("node")).alias("rank"))
        votes = edges.join(about, "b").groupBy("a", "near").agg(F.count("*").alias("n"), F.max("rank").alias("rank"))
        best = F.max_by("near", F.struct("n", (-F.col("near")).alias("near")))
        polled = votes.groupBy("a").agg(best.alias("to"), F.max("n").alias("n"), F.max("rank").alias("rank"), F.collect_list(F.struct("near", "n")).alias("counts"))
        own = F.aggregate("counts", F.lit(0).cast("long"), lambda t, c: t + F.when(c["near"] == F.col("shard"), c["n"]).otherwise(F.lit(0)))
        mine = F.struct(_priority(F.col("node"), F.col("degree"), turn).alias("p"), F.col("node").alias("node"))
        wants = polled.join(state, polled.a == state.node).where((F.col("to") != F.col("shard")) & (F.col("n") > own))
        wants = durable(wants.select("node", F.col("shard").alias("from"), "to", F.col("rank.node").alias("towards"), (mine > F.col("rank")).alias("first")), "wants", paths, n)
        counts = wants.groupBy("from", "to").agg(F.count_if("first").alias("n")).collect()
        if not counts:
            break
        wants = wants.where("first")
        wanted = {(r["from"], r["to"]): r["n"] for r in counts if r["n"]}
        if not wanted:
            continue
        sizes = {r["shard"]: r["count"] for r in state.groupBy("shard").count().collect()}
        allowed = quotas([sizes.get(j, 0) for j in range(shards)], room, wanted)
        if allowed == wanted:
            going = wants
        else:
            # those that follow the same neighbour stand together
            placed = number(wants, ["from", "to"], F.xxhash64("towards"), ["towards", "node"], "place", sum(wanted.values()))
            limit = F.create_map(*[F.lit(x) for (a, b), n in allowed.items() for x in (a * shards + b, n)]) if allowed else F.create_map(F.lit(-1), F.lit(0))
            going = placed.where(F.col("place") < F.coalesce(F.try_element_at(limit, F.col("from") * shards + F.col("to")), F.lit(0)))
        moved = state.join(going.select("node", "to"), "node", "left").select("node", "degree", F.coalesce("to", "shard").alias("shard"))
        state = durable(moved, "nodes", paths, n)
        for old in paths[:-1]:
            remove(spark, old)
        del paths[:-1]
    return state.select("node", "shard")


def shard_rows(nodes: DataFrame, links: DataFrame, shards: int, rounds: int = 8, fixed: DataFrame | None = None, taken: dict[int, int] | None = None) -> DataFrame:
    """``nodes`` (a unique long ``node`` and other columns) with ``shard`` and ``slot``; law ``rows``.

    Linked nodes take the shards of ``propagate``; where first labels left a shard too full,
    the excess joins the nodes without links, which fill what room is left. So the shards'
    counts are at most one apart. ``slot`` runs from 0 without gaps in each shard. ``fixed``
    (the same columns and ``shard``) are further rows that have their shards, ``taken`` their counts.
    """
    taken = taken or {}
    total = nodes.count() + sum(taken.values())
    room = [n - taken.get(j, 0) for j, n in enumerate(capacities(total, shards))]
    labels = propagate(links, room, rounds)
    held = durable(nodes.join(labels, "node", "left"), "labelled", rows=total)
    sizes = {r["shard"]: r["count"] for r in held.where("shard is not null").groupBy("shard").count().collect()}
    over = {j: n for j, n in sizes.items() if n > room[j]}
    if over:
        placed = number(held.where(F.col("shard").isin(*over)).select("node", "shard"), ["shard"], F.xxhash64("node"), ["node"], "place", sum(over.values()))
        limit = F.create_map(*[F.lit(x) for j in over for x in (j, room[j])])
        out = placed.where(F.col("place") >= F.element_at(limit, F.col("shard"))).select("node", F.lit(True).alias("out"))
        held = durable(held.join(out, "node", "left").withColumn("shard", F.when(F.col("out").isNull(), F.col("shard"))).drop("out"), "labelled", rows=total)
        sizes = {j: min(n, room[j]) for j, n in sizes.items()}
    free = held.where("shard is null").drop("shard")
    waiting = sum(room) - sum(sizes.values())
    ranked = number(free.withColumn("all", F.lit(0)), ["all"], F.xxhash64("node"), ["node"], "place", waiting).drop("all")
    shard, upto = F.lit(shards - 1), sum(room[j] - sizes.get(j, 0) for j in range(shards))
    for j in reversed(range(shards)):
        shard = F.when(F.col("place") < upto, F.lit(j)).otherwise(shard)
        upto -= room[j] - sizes.get(j, 0)
    filled = ranked.withColumn("shard", shard).drop("place")
    full = held.where("shard is not null").unionByName(filled)
    full = durable(full if fixed is None else full.unionByName(fixed), "shards", rows=total)
    return number(full, ["shard"], F.xxhash64("node"), ["node"], "slot", total)


def shard_equal_texts(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc id, size, text_crc32, law, shard, slot and grown_shard (null) of every row.

    Equal texts, null counting as empty, go together. A text with more rows than a quarter of
    a shard moves as one weighted node: the driver packs these, fewer than four a shard, largest
    first, so that a group takes one shard where one still holds it and else fills few whole.
    Of the others each row is linked to the first of its text. Rows with repeated or null ids
    are rows like any other; an empty table gives no row.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("crc"), F.unhex(F.md5(text)).alias("hash"), F.octet_length(text).alias("bytes"))
    base = durable(rows.withColumn("node", F.monotonically_increasing_id()), "rows")
    total = base.count()
    large = total // (4 * shards)
    # written out, so that the join has shuffles of its own, which Spark may split
    same = durable(base.groupBy("hash", "bytes").agg(F.count("*").alias("n"), F.min("node").alias("head")).where("n > 1"), "same", rows=total)
    spokes = base.join(same.where(F.col("n") <= large), ["hash", "bytes"]).where("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b"))
    groups = [((bytes(r["hash"]), r["bytes"]), r["n"]) for r in same.where(F.col("n") > large).collect()]
    columns, rest, fixed, taken = ["node", "id", "size", "crc"], base, None, {}
    if groups:
        places = pack_groups(groups, capacities(total, shards))
        for _, j, a, b in places:
            taken[j] = taken.get(j, 0) + b - a
        keys = base.sparkSession.createDataFrame([(bytearray(h), n) for (h, n), _ in groups], "hash binary, bytes int")
        plan = base.sparkSession.createDataFrame([(bytearray(g[0]), g[1], j, a, b, b - a < dict(groups)[g]) for g, j, a, b in places], "hash binary, bytes int, shard int, from long, upto long, cut boolean")
        # fewer rows than five a shard
        rest = base.join(F.broadcast(keys), ["hash", "bytes"], "left_anti")
        sizes = dict(groups)
        split = {g for g, _, a, b in places if b - a < sizes[g]}
        fixed = base.join(F.broadcast(plan.where(~F.col("cut"))), ["hash", "bytes"]).select(*columns, "shard")
        if split:
            parts = F.broadcast(plan.where("cut"))
            big = durable(base.join(parts.select("hash", "bytes").distinct(), ["hash", "bytes"], "left_semi"), "split", rows=total)
            big = number(big, ["hash", "bytes"], F.xxhash64("node"), ["node"], "place", sum(sizes[g] for g in split))
            within = (F.col("place") >= F.col("from")) & (F.col("place") < F.col("upto"))
            fixed = fixed.unionByName(big.join(parts, ["hash", "bytes"]).where(within).select(*columns, "shard"))
    placed = shard_rows(rest.select(*columns), spokes, shards, fixed=fixed, taken=taken)
    return placed.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
