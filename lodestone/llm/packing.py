"""Order-preserving packing of token streams into windows, by dynamic programming."""

from __future__ import annotations

import zlib
from collections import deque

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.tokenizing import WordBPE, loaded, read_vocabulary, slices, texts_of

#: What a cut costs, in tokens of padding: at a document's end, a sentence's end, elsewhere.
AT_DOCUMENT, AT_SENTENCE, ELSEWHERE = 0, 16, 128
#: Stretches longer than GAP without a sentence's end may be cut every STEP tokens.
GAP, STEP = 128, 64
SENTENCE = r"[.!?…。！？][\"'”’)\]]*$"


def best_cuts(places: np.ndarray, costs: np.ndarray, width: int) -> list[int]:
    """The cuts (positions, the last included) with the least padding plus cut costs.

    ``places`` ascend from 0, no two neighbours further apart than ``width``. With best[0] = 0,
    best[j] = min over i with places[j] - places[i] <= width of
    best[i] + width - (places[j] - places[i]) + costs[j]. What depends on i is best[i] +
    places[i] alone, so a queue that keeps those values rising gives each minimum at once.
    """
    at, cost = places.tolist(), costs.tolist()
    origin, value = [0] * len(at), [0] * len(at)
    queue: deque[int] = deque([0])
    for j in range(1, len(at)):
        p = at[j]
        while p - at[queue[0]] > width:
            queue.popleft()
        i = queue[0]
        v = value[i] + width - p + cost[j]
        # value holds best + place
        value[j], origin[j] = v + p, i
        while queue and value[queue[-1]] >= value[j]:
            queue.pop()
        queue.append(j)
    cuts, j = [], len(at) - 1
    while j:
        cuts.append(at[j])
        j = origin[j]
    return cuts[::-1]


def _distinct(places: np.ndarray) -> np.ndarray:
    """Sorted without repeats; runs that are sorted already merge quickly."""
    places = np.sort(places, kind="stable")
    return places[np.concatenate([[True], places[1:] != places[:-1]])]


def candidates(ends: np.ndarray, sentences: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Where cuts may fall in ``total`` tokens, and what each costs."""
    places = _distinct(np.concatenate([[0], ends, sentences, [total]]))
    gaps = np.diff(places)
    wide = np.flatnonzero(gaps > GAP)
    if len(wide):
        inner = [np.arange(places[k] + STEP, places[k + 1], STEP) for k in wide]
        places = _distinct(np.concatenate([places, *inner]))
    costs = np.full(len(places), ELSEWHERE)
    costs[np.searchsorted(places, sentences)] = AT_SENTENCE
    costs[np.searchsorted(places, ends)] = AT_DOCUMENT
    costs[-1] = AT_DOCUMENT
    return places, costs


class Packer:
    """Takes documents in order and gives pieces; holds one block of tokens, not the task's."""

    def __init__(self, width: int, block: int):
        self.width, self.block = width, block
        self.ids = np.zeros(0, np.int32)
        self.docs: list[list] = []  # document, ids of it before this block, its ids in all, its end here
        self.sentences = np.zeros(0, np.int64)
        self.sequence = 0

    def add(self, ids: np.ndarray, docs: list, sizes: np.ndarray, sentences: np.ndarray):
        base = len(self.ids)
        self.ids = np.concatenate([self.ids, ids])
        self.sentences = np.concatenate([self.sentences, sentences + base])
        self.docs += [[d, 0, n, e] for d, n, e in zip(docs, sizes.tolist(), (base + np.cumsum(sizes)).tolist(), strict=True)]
        if len(self.ids) >= self.block:
            yield from self._pack(False)

    def finish(self):
        if len(self.ids):
            yield from self._pack(True)

    def _pack(self, last: bool):
        total = len(self.ids)
        places, costs = candidates(np.array([d[3] for d in self.docs]), self.sentences, total)
        cuts = best_cuts(places, costs, self.width)
        if last:
            # a sequence of a power of two isn't padded: the rest goes into such runs
            start = cuts[-2] if len(cuts) > 1 else 0
            rest, cuts = total - start, cuts[:-1]
            for bit in reversed(range(rest.bit_length())):
                if rest >> bit & 1:
                    start += 1 << bit
                    cuts.append(start)
        else:
            cuts = cuts[:-1]  # the last window waits for what comes next
        at, k = 0, 0
        for cut in cuts:
            offset = 0
            while at < cut:
                doc, before, size, end = self.docs[k]
                n = min(cut, end) - at
                yield doc, before, n, self.ids[at : at + n], size, self.sequence, offset
                self.docs[k][1] += n
                at, offset = at + n, offset + n
                if at == end:
                    k += 1
            self.sequence += 1
        self.ids = self.ids[at:].copy()
        self.docs = [[d, b, n, e - at] for d, b, n, e in self.docs[k:]]
        self.sentences = self.sentences[self.sentences > at] - at


def pack(docs: DataFrame, vocabulary: str, width: int = 4096, end_id: int = 2, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text", block: int = 1 << 20) -> DataFrame:
    """Pieces of documents in sequences of at most ``width`` tokens, in the order of the input.

    A document is its ids and then ``end_id``; a null text counts as empty and has that id
    alone. Each task packs its own rows in blocks of about ``block`` tokens: the windows of a
    block are cut at ends of documents or sentences by ``best_cuts``; its last window is left
    open and leads the next block. What remains at a task's end is laid in sequences whose
    lengths are powers of two, which need no padding. ``sequence_id`` holds the partition's
    number above bit 33. There is no shuffle; a repeated task gives the same rows. Repeated or
    null ids are documents of their own; an empty table gives no piece.
    """
    content = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))
    kind = dict(docs.dtypes)[id_col]

    def batches(frames):
        words = loaded(WordBPE, content.value)
        first = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 33
        packer = Packer(width, block)
        for whole in frames:
            for batch in slices(whole, 1):
                ids, sizes, distinct, codes, offsets, tokens = words.encode(texts_of(batch, 1))
                n = len(batch)
                ids = np.insert(ids, tokens[1:], end_id).astype(np.int32)
                ended = pc.match_substring_regex(distinct, SENTENCE).to_numpy(zero_copy_only=False)[codes]
                document = np.repeat(np.arange(n), np.diff(offsets))
                sentences = (np.cumsum(sizes) + document)[ended]
                yield from rows(packer.add(ids, batch.column(0).to_pylist(), np.diff(tokens) + 1, sentences), batch.schema.field(0).type, first)
                held = batch.schema.field(0).type
        if packer.docs:
            yield from rows(packer.finish(), held, first)

    def rows(pieces, id_type, first):
        found = list(pieces)
        if not found:
            return
        doc, start, length, ids, size, sequence, offset = zip(*found, strict=True)
        columns = [pa.array(doc, id_type), *(pa.array(x, pa.int64()) for x in (start, length)), pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()), *(pa.array(x, pa.int64()) for x in (size, [first + s for s in sequence], offset))]
        names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        if with_ids:
            columns.append(pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(length)]).astype(np.int32), pa.array(np.concatenate(ids))))
            names.append("ids")
        yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(batches, schema).withColumnRenamed("id", id_col)
