"""Exact token counts at every prefix of a text, by dynamic programming."""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.tokenizing import ChunkTable, WordBPE, loaded, read_vocabulary, slices, texts_of

END = "</w>"
# What the pre-tokenizer takes as one piece after an apostrophe, and its white space.
SHORT = frozenset({"s", "t", "m", "d"})
LONG = {"r": "e", "v": "e", "l": "l"}
#: What ``WordBPE.parts`` makes of a plain chunk: one pre-token, nothing to compose.
PART = re.compile("[a-zß-öø-įı-ɏ]+|[.,;:!?*%&$#|]+")
CONTROLS = frozenset("\t\n\v\f\r\x85")


@lru_cache(1 << 16)
def kind_of(c: str) -> str:
    """L(etter), N(umber), S(pace) or P: how the pre-tokenizer sees a character."""
    first = unicodedata.category(c)[0]
    return "S" if c in CONTROLS or first == "Z" else first if first in "LN" else "P"


@lru_cache(1)
def joining() -> frozenset[str]:
    """Characters that canonical composition may join to what stands before them."""
    found = {chr(c) for c in (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3))}
    for c in map(chr, range(0x110000)):
        parts = unicodedata.decomposition(c).split()
        if parts and parts[0][0] != "<":
            # of a pair the second joins; a character that only decomposes is never left as it is
            found.add(chr(int(parts[1], 16)) if len(parts) == 2 else c)
            if unicodedata.normalize("NFC", c) != c:
                found.add(c)
    return frozenset(found)


@lru_cache(1 << 16)
def opens(c: str) -> bool:
    """Whether nothing before ``c`` changes with it under canonical composition."""
    return c < "\u0300" or (unicodedata.combining(c) == 0 and c not in joining())


SHORTEST = (2, 1)


def _sizes(table: dict[str, int]) -> dict[str, tuple[int, ...]]:
    """By their last three letters the lengths of tokens, the longest first; then two letters and one."""
    found: dict[str, set[int]] = {}
    for s in table:
        if len(s) > 2:
            found.setdefault(s[-3:], set()).add(len(s))
    return {tail: (*sorted(n, reverse=True), *SHORTEST) for tail, n in found.items()}


class Merges:
    """The merge rules of a byte-level BPE: which token may follow which, and counts of all prefixes.

    A sequence of tokens is the encoding of its bytes exactly if each neighbouring pair is that
    of the pair's own bytes. So the last token of a prefix is the one that ends there and fits
    the last token of the prefix it leaves: a single one does, and counts follow by adding 1.
    """

    def __init__(self, library):
        model = json.loads(library.to_str())["model"]
        self.ids: dict[str, int] = {}
        number = lambda s: self.ids.setdefault(s, len(self.ids))
        for s, _ in sorted(model["vocab"].items(), key=lambda kv: kv[1]):
            number(s)
        n = len(self.ids)
        self.rank, self.left, self.right, self.joined = [-1] * n, list(range(n)), list(range(n)), {}
        for r, m in enumerate(model["merges"]):
            a, b = m if not isinstance(m, str) else m.split(" ")
            u, v, t = number(a), number(b), number(a + b)
            self.joined[u, v] = r
            if self.rank[t] < 0:
                self.rank[t], self.left[t], self.right[t] = r, u, v
        self.open = {s: i for s, i in self.ids.items() if not s.endswith(END)}
        self.closed = {s.removesuffix(END): i for s, i in self.ids.items() if s.endswith(END)}
        self.open_sizes, self.closed_sizes = _sizes(self.open), _sizes(self.closed)
        self.bytes = library.pre_tokenizer[1]
        self.known: dict[int, bool] = {}
        self.spelled: dict[str, str] = {}

    def letters(self, c: str) -> str:
        """The characters that stand for a character's bytes."""
        if c not in self.spelled:
            self.spelled[c] = "".join(p for p, _ in self.bytes.pre_tokenize_str(c))
        return self.spelled[c]

    def find(self, table: dict[str, int], sizes: dict[str, tuple[int, ...]], word: str, i: int, last: list[int]) -> tuple[int, int]:
        """(id, letters) of the token of ``table`` that ends at letter i and fits what is before it."""
        known = self.known
        for n in sizes.get(word[i - 3 : i] if i > 2 else "", SHORTEST):
            t = table.get(word[i - n : i]) if n <= i else None
            if t is None:
                continue
            u = last[i - n]
            if u < 0:
                return t, n
            pair = u << 20 | t
            fit = known.get(pair)
            if fit is None:
                if len(known) > 1 << 18:
                    known.clear()
                fit = known[pair] = self._fits(u, t)
            if fit:
                return t, n
        raise ValueError("no token ends here: the vocabulary lacks a byte")

    def _fits(self, u: int, t: int) -> bool:
        """No merge reaches across the border of u and t at any time.

        Backwards in time from the whole tokens: in each state the pair at the border would
        have merged if its rule ranks before the merge that ended the state; of equal ranks
        the one further left goes first.
        """
        rank, joined = self.rank, self.joined
        before_u = before_t = 1 << 60
        while True:
            r = joined.get((u, t))
            if r is not None and r < before_u and r <= before_t:
                return False
            if rank[u] < 0 and rank[t] < 0:
                return True
            if rank[u] > rank[t]:
                before_u, u = rank[u], self.right[u]
            else:
                before_t, t = rank[t], self.left[t]


class Run:
    """Counts of a growing pre-token: ``add`` takes characters, ``count`` closes at any length reached."""

    __slots__ = ("rules", "word", "last", "opened", "ends")

    def __init__(self, rules: Merges):
        self.rules, self.word, self.last, self.opened, self.ends = rules, "", [-1], [0], [0]

    def cut(self, size: int) -> None:
        """Back to the first ``size`` characters."""
        if size + 1 < len(self.ends):
            del self.ends[size + 1 :]
            at = self.ends[-1]
            self.word = self.word[:at]
            del self.last[at + 1 :], self.opened[at + 1 :]

    def add(self, letters: str) -> None:
        rules, i = self.rules, len(self.word)
        self.word += letters
        for i in range(i + 1, len(self.word) + 1):
            t, n = rules.find(rules.open, rules.open_sizes, self.word, i, self.last)
            self.last.append(t)
            self.opened.append(self.opened[i - n] + 1)
        self.ends.append(len(self.word))

    def count(self) -> int:
        """Tokens of the run as a whole pre-token."""
        rules, i = self.rules, len(self.word)
        return self.opened[i - rules.find(rules.closed, rules.closed_sizes, self.word, i, self.last)[1]] + 1 if i else 0


def run_counts(rules: Merges, run: str) -> list[int]:
    """Token counts of the prefixes of one pre-token (normalised characters), the empty one left out."""
    return next(all_run_counts(rules, [run]))[1]


def all_run_counts(rules: Merges, runs: list[str]):
    """(run, ``run_counts``) of all, in order: what a run shares with the one before is worked out once."""
    find, letters, spelled = rules.find, rules.letters, rules.spelled
    opened_by, open_sizes, closed_by, closed_sizes = rules.open, rules.open_sizes, rules.closed, rules.closed_sizes
    before, word, last, opened, ends, counts = "", "", [-1], [0], [0], []
    for run in sorted(runs):
        same, most = 0, min(len(run), len(before))
        while same < most and run[same] == before[same]:
            same += 1
        i = ends[same]
        del counts[same:], ends[same + 1 :], last[i + 1 :], opened[i + 1 :]
        word = word[:i]
        for c in run[same:]:
            word += spelled.get(c) or letters(c)
            for i in range(i + 1, len(word) + 1):
                t, n = find(opened_by, open_sizes, word, i, last)
                last.append(t)
                opened.append(opened[i - n] + 1)
            ends.append(i)
            counts.append(opened[i - find(closed_by, closed_sizes, word, i, last)[1]] + 1)
        before = run
        yield run, list(counts)


class Reader:
    """Token counts of a text without special strings, character by character.

    The state after a character is (tokens of what is complete, the open run, its length, its
    kind); a character that composition joins to those before it takes the state back to where
    these began. A run of combining marks is normalised anew with each of them.
    """

    def __init__(self, rules: Merges):
        self.rules = rules
        self.state: tuple[int, Run | None, int, str] = (0, None, 0, "")
        self.cluster, self.before = "", self.state

    def add(self, c: str) -> int:
        """Tokens of the text up to ``c``, as a text of its own."""
        if opens(c):
            self.cluster, self.before = c, self.state
        else:
            self.cluster += c
            self.state = self.before
        norm = self.cluster if c < "\u0300" else unicodedata.normalize("NFC", self.cluster)
        for x in norm:
            for y in x.lower():
                self._step(y)
        return self.total()

    def total(self) -> int:
        done, run, size, kind = self.state
        if run is None:
            return done
        run.cut(size)
        if kind == "'":  # an apostrophe and a letter that may yet become one piece
            return done + sum(run_counts(self.rules, "'")) + run_counts(self.rules, run.word[1:])[-1]
        return done + run.count()

    def _fresh(self, done: int, c: str, kind: str) -> None:
        run = Run(self.rules)
        run.add(self.rules.letters(c))
        self.state = (done, run, 1, kind)

    def _step(self, c: str) -> None:
        done, run, size, kind = self.state
        if run is not None:
            run.cut(size)
        new = kind_of(c)
        lone = kind == "P" and run.word == "'"
        if kind == "'" and LONG[run.word[1:]] == c or lone and c in SHORT:
            self.state = (done + run_counts(self.rules, run.word + c)[-1], None, 0, "")
        elif lone and c in LONG:
            pair = Run(self.rules)
            pair.add("'")
            pair.add(c)
            self.state = (done, pair, 2, "'")
        elif kind == "'":
            letter = run.word[1:]
            self._fresh(done + run_counts(self.rules, "'")[-1], letter, "L")
            self._step(c)
        elif new == kind:
            if len(run.ends) != size + 1:
                raise AssertionError("a run was not cut")
            run.add(self.rules.letters(c))
            self.state = (done, run, size + 1, kind)
        elif new in "LP":
            self._fresh(self.total(), c, new)
        else:
            self.state = (self.total() + (run_counts(self.rules, c)[-1] if new == "N" else 0), None, 0, "")


class PrefixTable:
    """Part of a chunk → token counts after each of its characters; each distinct part is worked out once.

    A special string counts as one token once it is whole; till then its characters are text.
    """

    def __init__(self, words: WordBPE):
        self.words, self.rules = words, Merges(words.library)
        self.special = [t.content for t in words.library.get_added_tokens_decoder().values()]
        self.table = ChunkTable(self._encode)

    def _encode(self, new: list[str]) -> list[bytes]:
        """Counts of new parts of chunks.

        What may hold characters that the library's Unicode tables know otherwise (all but plain
        words and marks) is held against the library's own count, and takes its counts if they differ.
        """
        library = self.words.library
        found = dict(all_run_counts(self.rules, [p for p in new if PART.fullmatch(p)]))
        other = [p for p in new if p not in found]
        for part, whole in zip(other, library.encode_batch_fast(other, add_special_tokens=False), strict=True):
            found[part] = self.counts(part)
            if part and found[part][-1] != len(whole.ids):
                found[part] = [len(library.encode(part[: n + 1], add_special_tokens=False).ids) for n in range(len(part))]
        return [array("i", found[p]).tobytes() for p in new]

    def counts(self, chunk: str) -> list[int]:
        out, at, base = [], 0, 0
        while at < len(chunk):
            found = [(i, s) for s in self.special if (i := chunk.find(s, at)) >= 0]
            start, name = min(found) if found else (len(chunk), "")
            reader, whole = Reader(self.rules), 0
            stop = start + len(name)
            for k in range(at, stop - bool(name)):
                out.append(base + reader.add(chunk[k]))
                if k + 1 == start:
                    whole = out[-1] - base
            if name:
                base += whole + 1
                out.append(base)
            at = stop
        return out

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """For each character of the texts the tokens up to it in its text; and the texts' offsets.

        White space stands for itself and adds nothing; chunks between it don't interact, so a
        prefix has the tokens of its whole chunks and those of its last one so far.
        """
        distinct, codes, offsets = self.words.split(texts, True)
        names, pairs = self.words.parts(distinct)
        # the two parts of a chunk follow each other, then white space, but for a text's last chunk
        inside, sizes = self.table.gather(self.table.rows(names)[pairs][codes].ravel())
        white = np.tile(np.array([0, 1]), len(codes))
        white[2 * offsets[1:][np.diff(offsets) > 0] - 1] = 0
        ends = np.cumsum(sizes)
        last = np.concatenate([[0], inside])[np.where(sizes > 0, ends, 0)]
        before = np.concatenate([[0], np.cumsum(last)])
        first = np.repeat(before[2 * offsets[:-1]], 2 * np.diff(offsets))
        out = np.empty(int(sizes.sum() + white.sum()), np.int32)
        at = np.cumsum(sizes + white) - white
        held = np.ones(len(out), bool)
        held[at[white > 0]] = False
        out[held] = inside + np.repeat((before[:-1] - first).astype(np.int32), sizes)
        out[~held] = (before[1:] - first).astype(np.int32)[white > 0]
        lengths = np.concatenate([[0], np.cumsum(sizes + white)])
        return out, lengths[2 * offsets]


class PrefixCounts:
    """Answers questions about one text from its stored counts; nothing is encoded again."""

    def __init__(self, counts):
        self.counts = np.concatenate([[0], np.asarray(counts, np.int64)])

    def upto(self, n: int) -> int:
        """Tokens of ``text[:n]``."""
        return int(self.counts[max(0, min(n, len(self.counts) - 1))])

    def longest(self, budget: int) -> int:
        """The largest n such that ``text[:n]`` has at most ``budget`` tokens.

        Counts may fall as a prefix grows, so a shorter one may have more; below 0: 0.
        """
        fit = np.flatnonzero(self.counts <= budget)
        return int(fit[-1]) if len(fit) else 0


def tokens_upto(counts: Column, n: Column | int) -> Column:
    """``PrefixCounts.upto`` of a column of counts."""
    n = F.lit(n) if isinstance(n, int) else n
    size = F.size(counts)
    return F.when((n <= 0) | (size <= 0), F.lit(0)).otherwise(F.element_at(counts, F.greatest(F.least(n, size), F.lit(1)).cast("int")))


def longest_prefix(counts: Column, budget: int) -> Column:
    """``PrefixCounts.longest`` of a column of counts."""
    places = F.filter(F.transform(counts, lambda c, i: F.when(c <= budget, i + 1)), lambda i: i.isNotNull())
    return F.coalesce(F.array_max(places), F.lit(0)).cast("long")


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 2048, with_table: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit, fits) of each whole text; with all prefixes' counts if asked for.

    All is read off the table of ``PrefixTable``: ``n_tokens`` is its last entry, ``fits`` the
    characters of the longest prefix of at most ``limit`` tokens, ``counts`` (array of int) the
    tokens up to each character. Null texts count as empty (no bytes, no tokens); repeated or
    null ids come back row for row; a text without white space is one chunk, whose counts take
    time and memory in proportion to its length; an empty table gives no row.
    """
    content = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))

    def batches(frames):
        table = loaded(PrefixTable, content.value, lambda c: PrefixTable(loaded(WordBPE, c)))
        for whole in frames:
            for batch in slices(whole, 1):
                texts = texts_of(batch, 1)
                counts, offsets = table.of(texts)
                some = offsets[1:] > offsets[:-1]
                total = np.zeros(len(batch), np.int64)
                total[some] = counts[offsets[1:][some] - 1]
                # the last character up to which the budget holds
                place = np.where(counts <= limit, np.arange(1, len(counts) + 1), 0)
                fits = np.zeros(len(batch), np.int64)
                if some.any():
                    fits[some] = np.maximum(np.maximum.reduceat(place, offsets[:-1][some]) - offsets[:-1][some], 0)
                columns = [batch.column(0), pc.binary_length(texts).cast(pa.int64()), pa.array(total), pa.array(total > limit), pa.array(fits)]
                names = ["id", "n_bytes", "n_tokens", "over_limit", "fits"]
                if with_table:
                    columns.append(pa.ListArray.from_arrays(offsets.astype(np.int32), pa.array(counts)))
                    names.append("counts")
                yield pa.RecordBatch.from_arrays(columns, names)

    kind = dict(docs.dtypes)[id_col]
    schema = f"id {kind}, n_bytes long, n_tokens long, over_limit boolean, fits long" + ", counts array<int>" * with_table
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(batches, schema).withColumnRenamed("id", id_col)
