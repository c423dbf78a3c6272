"""Words of a text as integers, for a whole Arrow batch at once."""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np

#: A word is a longest run of letters or numbers; in Python's classes that is \w without the underscore.
WORD = re.compile(r"[^\W_]+")


def word_ids(texts, intern: defaultdict | None = None):
    """(ids, starts): the word ids of all texts one after another, and where each text begins.

    ``starts`` has one entry more than there are texts. Equal words have equal ids within ``intern``;
    None counts as a text without words.
    """
    if intern is None:
        intern = defaultdict()
        intern.default_factory = intern.__len__
    counts, parts = [0], []
    for text in texts:
        words = WORD.findall(text.lower()) if text else ()
        counts.append(len(words))
        parts.append(np.fromiter(map(intern.__getitem__, words), dtype=np.int64, count=len(words)))
    return np.concatenate(parts) if parts else np.zeros(0, np.int64), np.cumsum(counts)


def mix64(x: np.ndarray) -> np.ndarray:
    """The finishing step of splitmix64: spreads small integers over 64 bits."""
    x = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def batches_of(iterator, max_chars: int, column: str = "text"):
    """Pandas batches cut so that none holds much more than ``max_chars`` characters of text.

    A batch of ten thousand rows may hold gigabytes where texts are long; a single row is never cut.
    """
    for pdf in iterator:
        size = pdf[column].str.len().fillna(0).to_numpy().cumsum()
        at = 0
        while at < len(pdf):
            end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + max_chars, "right")))
            yield pdf.iloc[at:end]
            at = end
