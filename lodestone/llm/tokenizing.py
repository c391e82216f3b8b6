"""Distinct-chunk tables: each distinct chunk of text is tokenised once, ids are joined back by position.

A chunk is a stretch of text that the tokenizer can't look across: white space for the word
BPE, a run of word markers with what follows for SentencePiece. The functions here run inside
Arrow batches on the executors.
"""

from __future__ import annotations

import contextlib
import ctypes
import hashlib
import os
import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MARK = "▁"
#: A word of Latin letters (without the dotted capital I, which lowers to two characters), whose lower case the tokenizer takes anyway, and marks that are no part of it.
PLAIN = "^(?P<word>[A-Za-zÀ-ÖØ-öø-įı-ɏ]+)(?P<marks>[.,;:!?*%&$#|]*)$"
_LOADED: dict = {}


class ChunkTable:
    """chunk → ids (32-bit, as bytes), for as many distinct chunks as ``limit`` allows; then it starts afresh.

    Memory is bounded by the limit and the chunks of one slice of texts, not by the corpus.
    """

    def __init__(self, encode: Callable[[list[str]], list[bytes]], limit: int = 600_000):
        self.encode, self.limit = encode, limit
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.starts, self.sizes = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.int32)

    def rows(self, distinct: list[str]) -> np.ndarray:
        get = self.index.get
        at = np.fromiter((get(c, -1) for c in distinct), np.int64, len(distinct))
        new = np.flatnonzero(at < 0)
        if len(new) and self.index and len(self.index) + len(new) > self.limit:
            self.clear()
            return self.rows(distinct)
        if len(new):
            fresh = [distinct[i] for i in new]
            ids = self.encode(fresh)
            sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
            first = len(self.index)
            self.index.update(zip(fresh, range(first, first + len(fresh)), strict=True))
            self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(sizes) - sizes])
            self.sizes = np.concatenate([self.sizes, sizes])
            self.flat = np.concatenate([self.flat, np.frombuffer(b"".join(ids), np.int32)])
            at[new] = np.arange(first, first + len(fresh))
        return at

    def gather(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of these chunks, one after another, and each chunk's number of ids."""
        sizes = self.sizes[rows]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.repeat(self.starts[rows] - (ends - sizes), sizes) + np.arange(total)], sizes


def give_back() -> None:
    """An idle worker must not hold what its largest slice once took."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc keeps and trims
        ctypes.CDLL(None).malloc_trim(0)


def forget() -> None:
    """A worker that turns to work without a tokenizer drops the tables of those before."""
    if _LOADED:
        _LOADED.clear()
        give_back()


def slices(batch: pa.RecordBatch, column: int, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts have about ``most`` bytes; a longer text is alone."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    at, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > at and held + n > most:
            yield batch.slice(at, i - at)
            at, held = i, 0
        held += n
    if at < batch.num_rows:
        yield batch.slice(at)
    give_back()


def texts_of(batch: pa.RecordBatch, column: int) -> pa.Array:
    """Null texts count as empty. 64-bit offsets: a slice may be one very long text."""
    return pc.fill_null(batch.column(column).cast(pa.large_string()), "")


class WordBPE:
    """A ``tokenizers`` file whose pre-tokenizer drops white space, without added special tokens.

    No token, normalisation (canonical composition, lower case by code point) or special
    string reaches over ASCII white space, so a text's ids are those of its chunks in order.
    """

    def __init__(self, content: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(content.decode())
        self.table = ChunkTable(self._encode)

    def _encode(self, new: list[str]) -> list[bytes]:
        return [array("i", e.ids).tobytes() for e in self.library.encode_batch_fast(new, add_special_tokens=False)]

    def split(self, texts: pa.Array, single: bool = False) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Distinct chunks, each chunk's place among them, and the texts' offsets into the chunks.

        ``single``: each white space character ends a chunk, so that places can be counted.
        """
        lists = pc.split_pattern_regex(texts, r"[ \t\n\v\f\r]") if single else pc.ascii_split_whitespace(texts)
        coded = lists.flatten().dictionary_encode()
        offsets = lists.offsets.to_numpy().astype(np.int64)
        return coded.dictionary, coded.indices.to_numpy(), offsets - offsets[0]

    @staticmethod
    def parts(distinct: pa.Array) -> tuple[list[str], np.ndarray]:
        """Distinct parts of chunks, and each chunk's two: a word in lower case and the marks behind it.

        These are pre-tokens of their own; of any other chunk the first part is the whole, the
        second empty. A word's entry serves whatever marks it meets.
        """
        found = pc.extract_regex(distinct, PLAIN)
        plain = found.is_valid()
        word = pc.if_else(plain, pc.utf8_lower(pc.struct_field(found, "word")), distinct)
        marks = pc.if_else(plain, pc.struct_field(found, "marks"), pa.scalar("", distinct.type))
        coded = pa.concat_arrays([word, marks]).dictionary_encode()
        return coded.dictionary.to_pylist(), coded.indices.to_numpy().reshape(2, -1).T

    def encode(self, texts: pa.Array, single: bool = False) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray, np.ndarray, np.ndarray]:
        """ids; ids per chunk; distinct chunks; codes; chunk offsets; id offsets of the texts."""
        distinct, codes, offsets = self.split(texts, single)
        names, pairs = self.parts(distinct)
        ids, sizes = self.table.gather(self.table.rows(names)[pairs][codes].ravel())
        sizes = sizes.reshape(-1, 2).sum(1)
        before = np.concatenate([[0], np.cumsum(sizes)])
        return ids, sizes, distinct, codes, offsets, before[offsets]


class Pieces:
    """A SentencePiece model none of whose pieces has a word marker after another character."""

    def __init__(self, content: bytes):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_proto=content)
        lib = self.library
        crossing = [p for p in map(lib.id_to_piece, range(lib.vocab_size())) if MARK in p.lstrip(MARK)]
        if crossing:
            raise ValueError(f"pieces cross word markers: {crossing[:5]}")
        self.bos, self.eos, self.lone = lib.bos_id(), lib.eos_id(), lib.piece_to_id(MARK)
        # the library puts a marker before each text it is given: a chunk goes in without its first
        self.table = ChunkTable(lambda new: [array("i", i if c else [self.lone]).tobytes() for c, i in zip(new, lib.encode(new, num_threads=1), strict=True)])
        self._check()

    #: Texts whose chunks would meet under a normaliser, another marker rule or symbols of the user's.
    PROBES = (" a", "a ", "a  b", "a b", "▁a ▁", "\ta\n b", "ﬁ Å", "e\u0301 \u0301e", "　a\xa0b", "<s> </s>", "1 2", "A. B", "<unk> <0x0A>", "漢 字")

    def _check(self) -> None:
        """Refuses a model under which a text isn't the sequence of its chunks."""
        for text in self.PROBES:
            (ids,) = self.encode(pa.array([text], pa.large_string()))
            if ids.tolist() != self.library.encode(text, add_bos=True, add_eos=True):
                raise ValueError(f"this model's chunks interact: {text!r}")

    @staticmethod
    def chunks(text: str) -> list[str]:
        """The text's chunks, each without its first marker."""
        return [c[1:] for c in re.findall(f"{MARK}+[^{MARK}]*", MARK + text.replace(" ", MARK))] if text else []

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Each text's ids as the library gives them, with the begin and end ids."""
        plain = pc.invert(
            pc.or_(
                pc.match_substring_regex(texts, f"(?s)^ |  | $|{MARK}"),
                pc.equal(texts, ""),
            )
        ).to_numpy(zero_copy_only=False)
        lists = pc.split_pattern(texts.filter(pa.array(plain)), " ")
        other = [self.chunks(t) for t in texts.filter(pa.array(~plain)).to_pylist()]
        chunks = pa.concat_arrays([lists.flatten(), pa.array([c for one in other for c in one], pa.large_string())])
        counts = np.zeros(len(texts), np.int64)
        counts[plain] = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        counts[~plain] = [len(c) for c in other]
        order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])
        coded = chunks.dictionary_encode()
        ids, sizes = self.table.gather(self.table.rows(coded.dictionary.to_pylist())[coded.indices.to_numpy()])
        before = np.concatenate([[0], np.cumsum(sizes)])
        ends = np.cumsum(counts[order])
        out: list = [None] * len(texts)
        for i, a, b in zip(order.tolist(), (ends - counts[order]).tolist(), ends.tolist(), strict=True):
            out[i] = np.concatenate([[self.bos], ids[before[a] : before[b]], [self.eos]]).astype(np.int32)
        return out

    def decode(self, ids: np.ndarray, block: int = 1 << 20) -> Iterator[str]:
        """The library's decode(ids), in parts for a very long text: parts begin at a marker."""
        at = 0
        while len(ids) - at > block:
            end = at + block
            while end < len(ids) and not self.library.id_to_piece(int(ids[end])).startswith(MARK):
                end += 1
            yield self._part(ids[at:end], at)
            at = end
        yield self._part(ids[at:], at)

    def _part(self, ids: np.ndarray, at: int) -> str:
        # the library drops the first marker it meets; later parts keep theirs
        return (" " if at and len(ids) and self.library.id_to_piece(int(ids[0])).startswith(MARK) else "") + self.library.decode(ids.tolist())


def loaded(kind: type, content: bytes, make: Callable | None = None):
    """One tokenizer for each worker process and file; its chunk table lives on from task to task."""
    key = kind.__name__, hashlib.sha256(content).digest()
    if key not in _LOADED:
        _LOADED[key] = (make or kind)(content)
    return _LOADED[key]


def read_vocabulary(path: str) -> bytes:
    """The driver reads the file and sends it along: executors need no copy of their own."""
    with open(path, "rb") as file:
        return file.read()
