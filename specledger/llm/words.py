"""Words and shingles of whole texts, shared by the operators that run Python in tasks.

A word is a run of bytes other than space and the ASCII controls 9-13; a null text has no words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd

# Texts handled at once inside a task, so that very long ones do not pile up in memory.
CHUNK_BYTES = 2_000_000


def words(text: str | None, lower: bool = False) -> list[bytes]:
    """``bytes.split`` cuts at exactly the six separators, and ``bytes.lower`` changes A-Z only."""
    if not isinstance(text, str):
        return []
    data = text.encode("utf-8", "surrogatepass")
    return (data.lower() if lower else data).split()


def shingles(text: str | None, size: int, lower: bool = True) -> list[bytes]:
    """Space-joined runs of ``size`` words, repeats included; a shorter text is one shingle, an empty one none."""
    tokens = words(text, lower)
    if not tokens:
        return []
    if len(tokens) <= size:
        return [b" ".join(tokens)]
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return [joined[a:b] for a, b in zip(starts[: len(tokens) - size + 1].tolist(), ends[size - 1:].tolist())]


def bounded(texts: pd.Series, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about ``limit`` characters each (a longer text is a range of its own)."""
    start = size = 0
    for i, text in enumerate(texts):
        length = len(text) if isinstance(text, str) else 0
        if i > start and size + length > limit:
            yield start, i
            start, size = i, 0
        size += length
    if len(texts) > start:
        yield start, len(texts)
