"""Words of a text and the shingles over them."""

from __future__ import annotations

import numpy as np

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def spans(text: bytes, words_per: int) -> tuple[bytes, list[int], list[int]]:
    """The words in lower case (ASCII) with single blanks, and where each shingle starts and ends."""
    words = text.translate(LOWER).split()
    line = b" ".join(words)
    n = len(words)
    lengths = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths).tolist()
    ends = ends.tolist()
    if n > words_per:
        return line, starts[: n - words_per + 1], ends[words_per - 1 :]
    return line, starts[:1], ends[-1:]
