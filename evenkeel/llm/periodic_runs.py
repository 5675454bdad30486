"""Periodic runs of words, found with longest common extensions on a recompressed text.

A run is a stretch of words that repeats itself with a smallest period, at least `MIN_REPEATS` times and
over at least `MIN_WORDS` words, and that can't be extended on either side. Every run of period q has three
words on the grid 0, q, 2q, ... in a row that are equal. So for all periods the grid points (n log n of
them: the harmonic sum) are tested for that, and those that pass give the exact run by one extension
forwards and one backwards from (i, i + q), answered by the grammar of the text (`_recompression`).
A period that is a multiple of a smaller one gives the same stretch and is dropped.

The texts of a chunk share one grammar; a symbol of its own stands between any two. Texts are read whole:
memory and time grow in proportion to the longest text (time by its logarithm more). A null, empty or blank
text has no words and no runs. Repeated rows are treated each alike, and no order among rows matters; an
empty table gives no rows. Of runs with equal exponent the first start and then the smallest period counts
as the greatest. Only the named columns are read, so clashing names do no harm.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenkeel.llm._frames import map_arrow
from evenkeel.llm._recompression import extensions, grammar, mirrored
from evenkeel.llm._text import chunks

MIN_WORDS = 24
MIN_REPEATS = 3
#: Grid points that are tested at a time.
_BLOCK = 1 << 20
#: Extension queries that are asked at a time.
_QUERIES = 1 << 16


def _grid(first: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of (place, period): the grid points of every period in every text."""
    longest = np.where(sizes >= MIN_WORDS, sizes // MIN_REPEATS, 0)
    text = np.repeat(np.arange(len(sizes)), longest)
    period = np.arange(len(text)) - np.repeat(np.cumsum(longest) - longest, longest) + 1
    points = (sizes[text] - 1) // np.maximum(period, 1) - 1 if len(text) else period
    total = np.concatenate([[0], np.cumsum(points)])
    i = 0
    while i < len(text):
        j = max(i + 1, int(np.searchsorted(total, total[i] + _BLOCK, side="right")) - 1)
        q = np.repeat(period[i:j], points[i:j])
        k = np.arange(total[j] - total[i]) - np.repeat(total[i:j] - total[i], points[i:j])
        yield np.repeat(first[text[i:j]], points[i:j]) + k * q, q
        i = j


def _uncovered(place: np.ndarray, q: np.ndarray, found: np.ndarray, size: int) -> np.ndarray:
    """Which grid points are in no run of their period in `found`, rows of (start, end, period)."""
    if not len(found):
        return np.ones(len(place), dtype=bool)
    key = found[:, 2] * size + found[:, 0]
    order = np.argsort(key)
    at = np.searchsorted(key[order], q * size + place, side="right") - 1
    nearest = found[order[np.maximum(at, 0)]]
    return (at < 0) | (nearest[:, 2] != q) | (place + 2 * q >= nearest[:, 1])


def runs_of(symbols: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """(start, end, period) of all runs, by start and period; text t has `sizes[t]` words from `first[t]` on.

    The texts lie in `symbols` one after another, with a symbol found nowhere else before, between and
    after them.
    """
    forward = backward = None
    parts: list[np.ndarray] = []

    def extend(place: np.ndarray, q: np.ndarray) -> np.ndarray:
        nonlocal forward, backward
        if forward is None:
            forward = grammar(symbols)
            backward = mirrored(forward)
        rows = []
        for k in range(0, len(place), _QUERIES):
            i, step = place[k : k + _QUERIES], q[k : k + _QUERIES]
            end = i + step + extensions(forward, i, i + step)
            start = i - extensions(backward, len(symbols) - i, len(symbols) - i - step)
            rows.append(np.stack([start, end, step], axis=1))
        found = np.unique(np.concatenate(rows), axis=0) if rows else np.zeros((0, 3), dtype=np.int64)
        length = found[:, 1] - found[:, 0]
        return found[length >= MIN_REPEATS * found[:, 2]]

    for place, q in _grid(first, sizes):
        for ahead in (1, 2):
            equal = symbols[place] == symbols[place + ahead * q]
            place, q = place[equal], q[equal]
        # The first of a chain of grid points mostly settles the whole chain.
        follows = np.zeros(len(place), dtype=bool)
        follows[1:] = (q[1:] == q[:-1]) & (place[1:] - place[:-1] == q[1:])
        found = extend(place[~follows], q[~follows])
        left = np.flatnonzero(follows)
        left = left[_uncovered(place[left], q[left], found, len(symbols))]
        parts += [found, extend(place[left], q[left])]
    runs = np.concatenate([np.zeros((0, 3), dtype=np.int64), *parts])
    runs = runs[runs[:, 1] - runs[:, 0] >= MIN_WORDS]
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    smallest = np.ones(len(runs), dtype=bool)
    smallest[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)
    runs = runs[smallest]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _numbered(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All words of the texts as numbers, with symbols of their own around the texts; first and sizes."""
    names: dict[bytes, int] = {}
    sizes = np.array([len(w) for w in texts], dtype=np.int64)
    first = np.cumsum(sizes + 1) - sizes
    symbols = np.zeros(int(sizes.sum()) + len(texts) + 1, dtype=np.int64)
    for start, words in zip(first.tolist(), texts):
        symbols[start : start + len(words)] = [names.setdefault(w, len(names)) for w in words]
    around = np.append(first - 1, len(symbols) - 1)
    symbols[around] = len(names) + np.arange(len(around))
    return symbols, first, sizes


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def find_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_words, runs (start, length, period; by start and period), and the collapsed text.

    `collapsed` has the words that no run repeats, joined by one space: of each run only its first period stays.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(_RUN)), ("collapsed", pa.string())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches):
            # bytes.split() cuts at space and U+0009 to U+000D.
            texts = [t.as_buffer().to_pybytes().split() if t.is_valid else [] for t in chunk.column("text")]
            symbols, first, sizes = _numbered(texts)
            runs = runs_of(symbols, first, sizes)
            cuts = np.searchsorted(runs[:, 0], np.append(first, len(symbols)))
            of = np.repeat(np.arange(len(texts)), np.diff(cuts))
            change = np.zeros(len(symbols) + 1, dtype=np.int64)
            np.add.at(change, runs[:, 0] + runs[:, 2], 1)
            np.add.at(change, runs[:, 1], -1)
            kept = np.cumsum(change) == 0
            collapsed = []
            for k, words in enumerate(texts):
                if cuts[k] < cuts[k + 1]:
                    words = compress(words, kept[first[k] : first[k] + sizes[k]].tolist())
                collapsed.append(b" ".join(words).decode())
            rows = pa.StructArray.from_arrays(
                [pa.array(c) for c in (runs[:, 0] - first[of], runs[:, 1] - runs[:, 0], runs[:, 2])], fields=list(_RUN)
            )
            listed = pa.ListArray.from_arrays(pa.array(cuts, type=pa.int32()), rows)
            columns = [chunk.column("doc_id"), pa.array(sizes), listed.cast(schema.field("runs").type)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(collapsed, type=pa.string())], schema=schema)

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    ddl = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    return map_arrow(rows, work, ddl)


def greatest_run(runs: str = "runs"):
    """The run with the greatest length / period, compared exactly; the first of equal ones, null if none."""
    kind = "struct<start: bigint, length: bigint, period: bigint>"
    return F.aggregate(
        runs,
        F.lit(None).cast(kind),
        lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r)
        .otherwise(best)
        .cast(kind),
    )


# The query's rows ------------------------------------------------------------------------------------


def periodic_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text) where a tenth of the texts, told by a checksum of the id, end in a periodic stretch.

    The rule is the contract of `op13`. A null id has no checksum and its text stays.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def changed(number: int | None, content: str | None) -> str | None:
        h = zlib.crc32(str(number).encode()) if number is not None else 1
        if h % 10 or content is None:
            return content
        words, g = content.encode().split(), h // 10
        if not words:
            return content
        a = g % len(words)
        p = 1 + (len(words) - a) // (3 + g % 8)
        rest = len(words) - a
        # The last period may go beyond the words; then nothing is repeated.
        return b" ".join(words[:a] + (words[a : a + p] * -(-rest // p))[:rest]).decode()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches):
            pairs = zip(chunk.column("doc_id").to_pylist(), chunk.column("text").to_pylist())
            texts = pa.array([changed(n, t) for n, t in pairs], type=pa.string())
            yield pa.RecordBatch.from_arrays([chunk.column("doc_id"), texts], schema=schema)

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return map_arrow(rows, work, "doc_id long, text string")


def digest(found: DataFrame) -> DataFrame:
    rows = found.withColumn("best", greatest_run())
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col("best")[c].alias(c) for c in ("start", "length", "period")],
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
