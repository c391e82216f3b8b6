"""SentencePiece encoding and decoding by a table of distinct marked words."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.tokenizing import Pieces, loaded, read_vocabulary, slices, texts_of


def encode_pieces(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", emit: tuple[str, ...] = ("ids",)) -> DataFrame:
    """Each whole text's ids, with begin and end ids, and what ``emit`` asks for beside them.

    ``ids``: array<int>. ``decoded``: the library's decode(ids). ``digests``: n_tokens,
    ids_sha256 (ids as little-endian unsigned 32-bit) and decoded_sha256. No piece of the
    model holds a marker after another character (checked on loading), so the text falls
    into marked words; each distinct one is segmented once per worker and its ids are put
    back at every position where it stood. Null texts count as empty; rows, ids repeated or
    null, come back one for one.
    """
    fields = {"ids": ["ids array<int>"], "decoded": ["decoded string"], "digests": ["n_tokens long", "ids_sha256 string", "decoded_sha256 string"]}
    content = docs.sparkSession.sparkContext.broadcast(read_vocabulary(model))

    def batches(frames):
        pieces = loaded(Pieces, content.value)
        for whole in frames:
            for batch in slices(whole, 1):
                ids = pieces.encode(texts_of(batch, 1))
                columns, names = [batch.column(0)], ["id"]
                if "ids" in emit:
                    columns.append(pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32), pa.array(np.concatenate(ids))))
                    names.append("ids")
                if "decoded" in emit:
                    columns.append(pa.array(["".join(pieces.decode(x)) for x in ids], pa.string()))
                    names.append("decoded")
                if "digests" in emit:
                    digests = []
                    for x in ids:
                        text = hashlib.sha256()
                        for part in pieces.decode(x):
                            text.update(part.encode())
                        digests.append(text.hexdigest())
                    columns += [pa.array([len(x) for x in ids], pa.int64()), pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids]), pa.array(digests)]
                    names += ["n_tokens", "ids_sha256", "decoded_sha256"]
                yield pa.RecordBatch.from_arrays(columns, names)

    kind = dict(docs.dtypes)[id_col]
    schema = ", ".join([f"id {kind}", *(f for e in ("ids", "decoded", "digests") if e in emit for f in fields[e])])
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(batches, schema).withColumnRenamed("id", id_col)


def decode_pieces(encoded: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) from arrays of ids as the library's decode gives it; a null array gives a null text."""
    content = encoded.sparkSession.sparkContext.broadcast(read_vocabulary(model))

    def batches(frames):
        pieces = loaded(Pieces, content.value)
        for batch in frames:
            texts = [None if not x.is_valid else "".join(pieces.decode(np.array(x.as_py(), np.int32))) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["id", "text"])

    kind = dict(encoded.dtypes)[id_col]
    return encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(batches, f"id {kind}, text string").withColumnRenamed("id", id_col)
