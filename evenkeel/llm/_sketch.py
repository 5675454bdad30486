"""Bit maps over hashed cells, built from sketches of the partitions and merged slice by slice.

A partition's sketch is sparse: the cells that it met once, and those that it met more often. Merging
streams these lists into two bit maps a slice, so that its memory is that of the slice. The merged map
has at most 2**MAX_BITS bits and so a fixed bound; it goes through the driver to the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from evenkeel.llm._frames import map_arrow
from evenkeel.llm._text import by_slice, to_batch

#: 64 MB at most for one map.
MAX_BITS = 29
_SLICE_BITS = 6

SPARSE_DDL = "row int, slice int, once binary, more binary"
_SPARSE = pa.schema([("row", pa.int32()), ("slice", pa.int32()), ("once", pa.binary()), ("more", pa.binary())])
_MERGED = pa.schema([("row", pa.int32()), ("slice", pa.int32()), ("bits", pa.binary())])


def bits_for(cells: int, per_cell: int = 4) -> int:
    """Bits of an address so that a map has `per_cell` places for each expected cell."""
    return int(min(MAX_BITS, max(12, np.ceil(np.log2(max(1, cells * per_cell))))))


def cells_of(hashes: np.ndarray, row: int, bits: int) -> np.ndarray:
    """The cell of each hash in a row of the sketch; rows read different bits of the hash."""
    turned = hashes if row == 0 else (hashes << np.uint64(32)) | (hashes >> np.uint64(32))
    return (turned >> np.uint64(64 - bits)).astype(np.uint32)


def sparse_rows(cells: np.ndarray, row: int, bits: int) -> Iterator[pa.RecordBatch]:
    """A partition's sketch of one row, as packed lists by slice."""
    unique, counts = np.unique(cells, return_counts=True)
    shift = np.uint32(bits - _SLICE_BITS)
    parts: dict[int, list[bytes]] = {}
    for which, chosen in ((0, unique[counts == 1]), (1, unique[counts > 1])):
        for number, packed in by_slice((chosen >> shift).astype(np.int64), chosen):
            parts.setdefault(number, [b"", b""])[which] = packed
    if parts:
        once, more = zip(*parts.values())
        yield to_batch(_SPARSE, [[row] * len(parts), list(parts), list(once), list(more)])


def merge(sparse: DataFrame, bits: int, often: int, rows: int) -> list[np.ndarray]:
    """One packed bit map a row: the cells met at least `often` (1 or 2) times over all partitions."""
    width = 1 << (bits - _SLICE_BITS)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for r in batch.to_pylist():
                key = (r["row"], r["slice"])
                if key not in state:
                    state[key] = (np.zeros(width, dtype=bool), np.zeros(width, dtype=bool))
                seen, again = state[key]
                once = np.frombuffer(r["once"], dtype=np.uint32) & np.uint32(width - 1)
                more = np.frombuffer(r["more"], dtype=np.uint32) & np.uint32(width - 1)
                again[once] |= seen[once]
                seen[once] = True
                seen[more] = True
                again[more] = True
        for (row, number), maps in state.items():
            yield to_batch(_MERGED, [[row], [number], [np.packbits(maps[often - 1]).tobytes()]])

    dealt = sparse.repartition(min(rows << _SLICE_BITS, 64), "row", "slice")
    out = [np.zeros((1 << bits) // 8, dtype=np.uint8) for _ in range(rows)]
    for r in map_arrow(dealt, work, "row int, slice int, bits binary").collect():
        begin = r["slice"] * width // 8
        out[r["row"]][begin : begin + width // 8] = np.frombuffer(r["bits"], dtype=np.uint8)
    return out


def holds(maps: list[np.ndarray], hashes: np.ndarray, bits: int) -> np.ndarray:
    """Which hashes have their cell set in every row."""
    ok = np.ones(len(hashes), dtype=bool)
    for row, packed in enumerate(maps):
        cell = cells_of(hashes, row, bits)
        ok &= (packed[cell >> np.uint32(3)] >> (np.uint32(7) - (cell & np.uint32(7))).astype(np.uint8)) & 1 > 0
    return ok
