"""Words of many texts at once: each distinct word of a bounded chunk is looked at once."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np

#: Characters of a chunk; one text above stands alone.
CHUNK_CHARS = 2_000_000


def text_chunks(texts: Iterable[str | None]) -> Iterator[list[str]]:
    """Consecutive texts (null: empty) of about CHUNK_CHARS together."""
    held, size = [], 0
    for text in texts:
        held.append(text or "")
        size += len(held[-1])
        if size >= CHUNK_CHARS:
            yield held
            held, size = [], 0
    if held:
        yield held


def indexed_words(texts: list[str], words_of: Callable[[str], list[str]]) -> tuple[list[np.ndarray], list[str]]:
    """Each text's words as numbers, and the words by number."""
    index: dict[str, int] = {}
    numbers = []
    for text in texts:
        words = words_of(text)
        numbers.append(np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, len(words)))
    return numbers, list(index)


def code_points(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the words joined by single spaces (one before, one after), and the word each belongs to.

    A space belongs to the word before it, the first one to word 0.
    """
    joined = " " + " ".join(words) + " "
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.uint64)
    owner = np.cumsum(points == 32) - 1
    owner = np.where(points == 32, owner - 1, owner)
    return points, np.maximum(owner, 0)
