"""Words and hashes of Arrow text columns, whole arrays at a time.

Texts are read as UTF-8 bytes. All characters that separate words are ASCII, so that a byte decides.
A hash of a word or of a word sequence has 64 bits: a polynomial over its bytes (or over its words'
hashes) modulo 2**64, then mixed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A task works on so many bytes of text at a time, or on one longer text.
CHUNK_BYTES = 2 << 20
#: Bytes whose polynomials share one table of powers.
_BLOCK_BYTES = 1 << 20

_BASE = 0x9E3779B97F4A7C55
_INVERSE = pow(_BASE, -1, 1 << 64)


def byte_table(*ranges: tuple[int, int]) -> np.ndarray:
    """Which bytes belong to a word."""
    table = np.zeros(256, dtype=bool)
    for first, last in ranges:
        table[first : last + 1] = True
    return table


#: All bytes except space and U+0009 to U+000D.
NOT_BLANK = byte_table((0x00, 0x08), (0x0E, 0x1F), (0x21, 0xFF))
#: Digits, lower-case letters and everything beyond ASCII.
LETTER_OR_DIGIT = byte_table((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))


@dataclass
class Words:
    """Words of the texts of one chunk; `first[i]:first[i + 1]` are those of text i."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray


def chunks(
    batches: Iterable[pa.RecordBatch], column: str = "text", max_bytes: int = CHUNK_BYTES
) -> Iterator[pa.RecordBatch]:
    """Cut batches into runs of rows with at most `max_bytes` of text, or one row."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        total = np.cumsum(lengths, dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            before = total[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(total, before + max_bytes, side="right")))
            yield batch.slice(start, end - start)
            start = end


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, one after another, and where each begins. Null is an empty text."""
    texts = pc.fill_null(texts, "")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    if len(texts) == 0 or offsets is None:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(texts) + 1, dtype=np.int64)
    at = np.frombuffer(offsets, dtype=kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, dtype=np.uint8), at - at[0]
    return np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]], at - at[0]


def words(texts: pa.Array, inside: np.ndarray = NOT_BLANK, lower: bool = False) -> Words:
    """Split texts into words; `lower` turns A-Z into a-z first."""
    data, at = utf8(texts)
    if lower and len(data):
        data = np.where((data >= 0x41) & (data <= 0x5A), data + 32, data).astype(np.uint8)
    member = np.zeros(len(data) + 2, dtype=bool)
    member[1:-1] = inside[data]
    before, after = member[:-2].copy(), member[2:].copy()
    edges = at[(at > 0) & (at < len(data))]
    before[edges] = False
    after[edges - 1] = False
    member = member[1:-1]
    starts = np.flatnonzero(member & ~before)
    return Words(data, starts, np.flatnonzero(member & ~after) + 1, np.searchsorted(starts, at))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values; a bijection."""
    x = x.astype(np.uint64)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    table = _powers.get(base)
    if table is None or len(table) < n:
        table = np.full(max(n, 1 << 12), base, dtype=np.uint64)
        table[0] = 1
        table = np.cumprod(table, dtype=np.uint64)
        if n <= 1 << 21:
            _powers[base] = table
    return table[:n]


def _sums(values: np.ndarray) -> np.ndarray:
    """Running sums of the values times powers, from which each range's polynomial is a difference."""
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * _power_table(_BASE, len(values)), dtype=np.uint64, out=sums[1:])
    return sums


def _from_sums(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    found = (sums[ends] - sums[starts]) * _power_table(_INVERSE, len(sums))[starts]
    return mix(found ^ ((ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


def range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of values[start:end] for each range; ranges may overlap."""
    if len(starts) == 0:
        return np.zeros(0, dtype=np.uint64)
    return _from_sums(_sums(values), starts, ends)


def beginning_hashes(w: Words, lengths: tuple[int, ...]) -> list[np.ndarray]:
    """For each length, a hash of each word's first so many bytes; 0 is the whole word.

    The power tables stay small, however long a text is.
    """
    out = [np.empty(len(w.starts), dtype=np.uint64) for _ in lengths]
    i = 0
    while i < len(w.starts):
        base = w.starts[i]
        j = max(i + 1, int(np.searchsorted(w.ends, base + _BLOCK_BYTES, side="right")))
        starts, ends = w.starts[i:j] - base, w.ends[i:j] - base
        sums = _sums(w.data[base : w.ends[j - 1]].astype(np.uint64) + np.uint64(1))
        for hashes, length in zip(out, lengths):
            hashes[i:j] = _from_sums(sums, starts, np.minimum(starts + length, ends) if length else ends)
        i = j
    return out


def word_hashes(w: Words) -> np.ndarray:
    """A hash of each word."""
    return beginning_hashes(w, (0,))[0]


def ngram_ranges(first: np.ndarray, n: int, short: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of every run of `n` words inside one text.

    With `short`, a text of fewer words, but not none, gives one run of all its words.
    """
    sizes = np.diff(first)
    counts = np.maximum(sizes - n + 1, 0)
    if short:
        counts = np.where((sizes > 0) & (sizes < n), 1, counts)
    text = np.repeat(np.arange(len(sizes)), counts)
    within = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
    starts = first[text] + within
    return starts, np.minimum(starts + n, first[text + 1]), text


def by_slice(slices: np.ndarray, *arrays: np.ndarray) -> Iterator[tuple]:
    """Packed rows: each slice number with the bytes of its part of the arrays, in their order."""
    order = np.argsort(slices, kind="stable")
    slices = slices[order]
    cuts = np.flatnonzero(np.diff(slices, prepend=slices[:1] - 1)) if len(slices) else []
    sorted_arrays = [a[order] for a in arrays]
    for start, end in zip(cuts, [*cuts[1:], len(slices)]):
        yield int(slices[start]), *(a[start:end].tobytes() for a in sorted_arrays)


def unpack(column: pa.Array | pa.ChunkedArray, kind: type) -> np.ndarray:
    """The values of all packed rows of a column."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind)


def to_batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)


def per_chunk(
    work: Callable[[pa.RecordBatch], pa.RecordBatch], column: str = "text"
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`work` for each chunk of the batches, as `mapInArrow` calls it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, column):
            yield work(chunk)

    return run
