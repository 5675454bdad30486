"""Substring dedup: windows of words that occur twice, found behind a count-min prefilter.

A window of 35 words is named by its anchor, the run of eight words in it with the smallest hash. Equal
windows have equal anchors at equal places, so the number of places at which an anchor stands is at least
the number of its windows. A first pass counts anchors (a fourteenth of the windows) in a count-min
sketch for each partition; merged, the sketches tell which anchors may stand at two places or more.
A second pass over the texts takes the windows of these anchors only and groups them by a 64-bit hash of
the whole window, which decides. So the sketch saves work and never loses a window, whatever its size.

Windows travel packed, dealt by their hash. A window met twice in one task's buffer is known to be
repeated and only one of its places is looked up for others, so that a window that a third of the
documents share gives each slice as many rows as there are buffers.

A word is removed if a repeated window covers it; windows are judged on the input. Null and empty texts
have no words. Texts under 35 words stay whole. Repeated rows are copies of each other. Rows are told
apart by a 64-bit hash of id and text. Of runs with the same smallest hash the first names the window, in
every text alike. A very long text is a chunk of its own and read whole. An empty table gives no rows.
Columns other than the id and the text are not read, so clashing names do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenkeel.llm import _sketch
from evenkeel.llm._frames import bounded_batches, map_arrow, row_key, text_bytes
from evenkeel.llm._text import (
    Words,
    by_slice,
    chunks,
    ngram_ranges,
    range_hashes,
    to_batch,
    unpack,
    word_hashes,
    words,
)

#: Words in a window.
WINDOW = 35
#: Words in an anchor.
_ANCHOR = 8
#: Text for each slice, and suspect windows that a task gathers before it packs them.
_SLICE_TEXT = 4 << 20
_FLUSH = 1 << 20
_SKETCH_ROWS = 2


def _anchors(hashes: np.ndarray, first: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with the same anchor: the anchor's hash, first window, one past the last, text."""
    grams = range_hashes(hashes, np.arange(max(0, len(hashes) - _ANCHOR + 1)), np.arange(_ANCHOR, len(hashes) + 1))
    best = np.arange(len(grams))
    span, want = 1, window - _ANCHOR + 1
    # The place of the smallest hash among `want` neighbours, the leftmost of equal ones, by doubling.
    while span < want and len(best):
        step = min(span, want - span)
        left, right = best[:-step], best[step:]
        best = np.where(grams[right] < grams[left], right, left)
        span += step
    starts, _, text = ngram_ranges(first, window)
    place = best[starts]
    new = (np.diff(place, prepend=-1) != 0) | (np.diff(text, prepend=-1) != 0)
    begins = np.flatnonzero(new)
    last = np.append(begins[1:], len(starts)) - 1
    return grams[place[begins]], starts[begins], starts[last] + 1, text[begins]


def suspect_maps(docs: DataFrame, window: int, bits: int) -> list[np.ndarray]:
    """The merged count-min sketch: which cells have a count of two or more, one bit map a row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells: list[list[np.ndarray]] = [[] for _ in range(_SKETCH_ROWS)]
        for chunk in chunks(batches):
            w = words(chunk.column("text"))
            found, *_ = _anchors(word_hashes(w), w.first, window)
            for row, held in enumerate(cells):
                held.append(_sketch.cells_of(found, row, bits))
        for row, held in enumerate(cells):
            if held:
                yield from _sketch.sparse_rows(np.concatenate(held), row, bits)

    return _sketch.merge(map_arrow(docs, work, _sketch.SPARSE_DDL), bits, 2, _SKETCH_ROWS)


def _suspects(docs: DataFrame, window: int, bits: int, maps: list[np.ndarray], slices: int) -> DataFrame:
    """Windows with suspect anchors, packed by slice: hash, row key, start, and whether already decided."""
    shared = docs.sparkSession.sparkContext.broadcast(maps)
    schema = pa.schema([("slice", pa.int32())] + [(c, pa.binary()) for c in ("hashes", "keys", "starts", "known")])

    def pack(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        hashes, keys, starts = (np.concatenate(c) for c in zip(*held))
        order = np.argsort(hashes, kind="stable")
        hashes, keys, starts = hashes[order], keys[order], starts[order]
        new = np.diff(hashes, prepend=~hashes[:1]) != 0
        counts = np.diff(np.append(np.flatnonzero(new), len(hashes)))
        # 0: others decide; 1: repeated here, and others should know; 2: repeated here, nothing to look up.
        known = np.where(np.repeat(counts, counts) == 1, 0, np.where(new, 1, 2)).astype(np.uint8)
        place = np.where(known == 2, keys, hashes) % np.uint64(slices)
        rows = list(by_slice(place.astype(np.int64), hashes, keys, starts, known))
        yield to_batch(schema, [list(c) for c in zip(*rows)])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        gathered = 0
        for chunk in chunks(batches):
            w = words(chunk.column("text"))
            hashes = word_hashes(w)
            found, begins, ends, text = _anchors(hashes, w.first, window)
            suspect = _sketch.holds(shared.value, found, bits)
            begins, counts, text = begins[suspect], (ends - begins)[suspect], text[suspect]
            if not len(begins):
                continue
            starts = np.repeat(begins - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
            keys = chunk.column("key").to_numpy().view(np.uint64)[text]
            held.append(
                (
                    range_hashes(hashes, starts, starts + window),
                    np.repeat(keys, counts),
                    (starts - np.repeat(w.first[text], counts)).astype(np.uint32),
                )
            )
            gathered += len(starts)
            if gathered >= _FLUSH:
                yield from pack(held)
                held, gathered = [], 0
        if held:
            yield from pack(held)

    return map_arrow(docs, work, "slice int, hashes binary, keys binary, starts binary, known binary")


def _marks(suspects: DataFrame, parts: int) -> DataFrame:
    """Starts of repeated windows, packed by part of the row keys."""
    schema = pa.schema([("part", pa.int32()), ("keys", pa.binary()), ("starts", pa.binary())])

    def work(table: pa.Table) -> pa.Table:
        if table.num_rows == 0:
            return schema.empty_table()
        hashes, keys = unpack(table.column("hashes"), np.uint64), unpack(table.column("keys"), np.uint64)
        starts, known = unpack(table.column("starts"), np.uint32), unpack(table.column("known"), np.uint8)
        asked = np.flatnonzero(known < 2)
        order = asked[np.argsort(hashes[asked], kind="stable")]
        sorted_hashes = hashes[order]
        begins = np.flatnonzero(np.diff(sorted_hashes, prepend=~sorted_hashes[:1]) != 0)
        counts = np.diff(np.append(begins, len(order)))
        marked = known > 0
        marked[order[np.repeat(counts > 1, counts)]] = True
        keys, starts = keys[marked], starts[marked]
        # In order of the document, so that the packed numbers compress.
        order = np.lexsort((starts, keys))
        keys, starts = keys[order], starts[order]
        rows = list(by_slice((keys % np.uint64(parts)).astype(np.int64), keys, starts))
        return pa.Table.from_batches([to_batch(schema, [list(c) for c in zip(*rows)])] if rows else [], schema)

    return suspects.groupBy("slice").applyInArrow(work, "part int, keys binary, starts binary")


def _kept(w: Words, i: int, starts: np.ndarray, window: int) -> tuple[list[tuple[int, int]], int]:
    """Runs of words (numbers in `w`) of text i that no marked window covers, and their count."""
    begin, n = int(w.first[i]), int(w.first[i + 1] - w.first[i])
    edge = np.zeros(n + 1, dtype=np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    free = np.flatnonzero(np.cumsum(edge)[:n] == 0)
    if not len(free):
        return [], 0
    cuts = np.flatnonzero(np.diff(free) > 1)
    firsts, lasts = np.append(free[:1], free[cuts + 1]), np.append(free[cuts], free[-1])
    return [(begin + int(a), begin + int(b) + 1) for a, b in zip(firsts, lasts)], len(free)


def _joined(w: Words, runs: list[tuple[int, int]]) -> bytes:
    """The words of the runs, one space between them."""
    data = w.data.tobytes()
    return b" ".join(
        b" ".join(data[s:e] for s, e in zip(w.starts[a:b].tolist(), w.ends[a:b].tolist())) for a, b in runs
    )


def remove_repeats(
    docs: DataFrame, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Per row of `docs`: `doc_id`, `n_words`, `n_removed` and the kept words as `text`."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")
    ).withColumn("key", row_key("doc_id", "text"))
    volume = text_bytes(docs, text)
    # About six bytes a word, an anchor for fourteen windows.
    bits = _sketch.bits_for(volume // 84)
    slices = max(8, volume // _SLICE_TEXT)
    maps = suspect_maps(rows.select("text"), window, bits)
    marks = _marks(_suspects(rows, window, bits, maps, slices), slices)
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("text", pa.string())]
    )

    def work(texts: pa.Table, marked: pa.Table) -> pa.Table:
        keys, starts = unpack(marked.column("keys"), np.uint64), unpack(marked.column("starts"), np.uint32)
        order = np.argsort(keys, kind="stable")
        keys, starts = keys[order], starts[order].astype(np.int64)
        out = []
        for chunk in chunks(texts.to_batches()):
            w = words(chunk.column("text"))
            wanted = chunk.column("key").to_numpy().view(np.uint64)
            low, high = np.searchsorted(keys, wanted), np.searchsorted(keys, wanted, side="right")
            sizes, kept, left = np.diff(w.first), [], []
            for i in range(chunk.num_rows):
                runs, count = _kept(w, i, starts[low[i] : high[i]], window)
                kept.append(_joined(w, runs).decode())
                left.append(count)
            out.append(to_batch(schema, [chunk.column("doc_id"), sizes, sizes - left, kept]))
        return pa.Table.from_batches(out, schema)

    part = F.pmod(F.col("key"), F.lit(slices))
    # The row keys are unsigned in the tasks; the same remainder is taken here.
    unsigned = F.pmod(part + F.when(F.col("key") < 0, F.lit(pow(2, 64, slices))).otherwise(F.lit(0)), F.lit(slices))
    dealt = rows.withColumn("part", unsigned.cast("int"))
    return (
        dealt.groupBy("part")
        .cogroup(marks.groupBy("part"))
        .applyInArrow(work, "doc_id long, n_words long, n_removed long, text string")
    )


def digest(kept: DataFrame) -> DataFrame:
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))
