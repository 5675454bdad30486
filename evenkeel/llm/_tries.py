"""Numbers for the nodes of a trie over very many words, given in parallel.

Words are dealt into ranges of their order. Words that share a beginning are neighbours, so a node whose
words lie on both sides of a bound is a beginning of that bound. The nodes of the bounds are numbered by
every task alike; all other nodes lie within one range, and the task of the range numbers them as it reads
its words in order. So a node has one number, whichever words it is met in, without a table of nodes.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenkeel.llm._frames import map_arrow
from evenkeel.llm._text import to_batch

#: Words of a range, about.
RANGE_WORDS = 100_000
#: Ranges at most, and letters of a bound: what goes to every task is bounded by their product.
MAX_RANGES = 16_384
_BOUND_LETTERS = 32
_SAMPLES = 20
#: Low bits of a number count nodes (or words) in a range; the bits above name the range.
_RANGE_SHIFT = 42


def shared(a: str, b: str) -> int:
    """Length of the common beginning."""
    if a == b:
        return len(a)
    n, low = min(len(a), len(b)), 0
    while low < n:  # whole halves are compared, for words of any length
        middle = (low + n + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            n = middle - 1
    return low


class Nodes:
    """Numbers of the nodes along each of several words, which come in order."""

    def __init__(self, start: int):
        self.next = start
        self.word, self.path = "", [start]
        self.next += 1

    def along(self, word: str) -> list[int]:
        """Numbers of all beginnings of `word`, the empty one first."""
        depth = shared(word, self.word)
        new = len(word) - depth
        self.path = self.path[: depth + 1] + list(range(self.next, self.next + new))
        self.word, self.next = word, self.next + new
        return self.path


def bounds(words: DataFrame, count: int, range_words: int = RANGE_WORDS) -> list[str]:
    """Sorted beginnings of sampled words that cut the words into ranges. They steer the work only."""
    ranges = min(MAX_RANGES, -(-count // range_words))
    if ranges <= 1:
        return []
    fraction = min(1.0, _SAMPLES * ranges / count)
    sample = words.select(F.substring("word", 1, _BOUND_LETTERS).alias("w")).sample(fraction, seed=7)
    found = sorted(sample.toArrow().column("w").to_pylist())
    return sorted({found[i * len(found) // ranges] for i in range(1, ranges)}) if found else []


def numbered(words: DataFrame, cuts: list[str]) -> DataFrame:
    """(word, id, nodes) of the distinct `words(word)`.

    `nodes` numbers the beginnings of the word, from the empty one to the whole; `id` orders the words by
    their code points.
    """
    held = pa.schema([("range", pa.int32()), ("word", pa.string())])
    schema = pa.schema([("word", pa.string()), ("id", pa.int64()), ("nodes", pa.list_(pa.int64()))])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column("word")
            yield to_batch(held, [[bisect_right(cuts, w) for w in found.to_pylist()], found])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = Nodes(0)
        of_cut = [common.along(c) for c in cuts]
        current, nodes, at = -1, Nodes(0), 0
        for batch in batches:
            ids, paths = [], []
            for r, word in zip(batch.column("range").to_pylist(), batch.column("word").to_pylist()):
                if r != current:
                    # Numbers of the bounds' nodes are below the first range's.
                    current, nodes, at = r, Nodes((r + 1) << _RANGE_SHIFT), 0
                path = nodes.along(word)
                for k in (r - 1, r):
                    if 0 <= k < len(cuts):
                        depth = shared(word[: len(cuts[k])], cuts[k])
                        path = of_cut[k][: depth + 1] + path[depth + 1 :]
                ids.append(r << _RANGE_SHIFT | at)
                paths.append(path)
                at += 1
            yield to_batch(schema, [batch.column("word"), ids, paths])

    ranged = map_arrow(words.select("word"), place, "range int, word string")
    in_order = ranged.repartition(len(cuts) + 1, "range").sortWithinPartitions("range", "word")
    return map_arrow(in_order, number, "word string, id long, nodes array<long>")
