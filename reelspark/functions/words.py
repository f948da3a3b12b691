"""Which lists of words a text holds, found in one walk over the text instead of one a word."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def held(text: Column, lists: Sequence[Sequence[str]]) -> Column:
    """A number whose bit k says whether the text holds a word of lists[k], of which there are 63 at most; null of null."""
    if len(lists) > 63:
        raise ValueError("a long has bits for 63 lists")
    bits: dict[str, int] = {}
    for k, words in enumerate(lists):
        for w in words:
            bits[w] = bits.get(w, 0) | 1 << k

    @F.arrow_udf("long")
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        words = ahocorasick.Automaton()
        for w, b in bits.items():
            words.add_word(w, b)
        words.make_automaton()

        def one(text):
            n = 0
            for _, b in words.iter(text.decode("utf-8", "replace")):
                n |= b
            return n

        for texts in batches:
            yield pa.array([None if t is None else one(t) for t in texts.to_pylist()], pa.int64())

    return found(text.cast("binary"))
