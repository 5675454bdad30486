"""SimHash near duplicates by Golay-code fuzzy hashing.

A text's fingerprint has 64 bits: each is set if it is set in over half of the hashes of its word shingles.
Fingerprints with at most three differing bits are linked, and documents get the smallest id that they can
reach over links.

A fingerprint is cut into three segments. Three errors or fewer leave one of these cases (pigeonhole):
two segments without errors, one without and another with exactly one, or exactly one in each. A segment
without errors is a key as it stands. One with a single error meets its partner in a codeword of the Golay
code; as a single error changes the parity, only odd segments give all their one to six codewords, and even
ones their own. So a fingerprint has about 54 keys, and any two that are linked share one.

Rows are shuffled by key and sorted; a task sees the fingerprints of a key, tests them bit by bit, and
returns one link for each that is not the first of its component there, never all pairs. Groups of up to
`_DENSE` are compared directly; larger ones are cut again by a quarter of the bits (three errors leave one
of four quarters alone). A key of more than `MAX_GROUP` fingerprints is left to a second round, which cuts
it by quarters before the shuffle, so that no task holds more.

Equal fingerprints are one, however many documents have it. A null, empty or blank text has fingerprint
zero, which is linked like any other; a text of fewer words than a shingle has one shingle. Rows with the
same id stay separate rows, repeated rows too. A null id is never a `component_id` unless all ids of the
component are null; ties can't arise. An empty table gives no rows. Only the two named columns are read, so
clashing names do no harm. Very long texts are hashed block by block.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, permutations, product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenkeel.llm._frames import join_counted, map_arrow, stored
from evenkeel.llm._golay import codewords
from evenkeel.llm._text import chunks, to_batch
from evenkeel.llm.components import connected

SHINGLE = 3
SEED = 42
#: Differing bits up to which fingerprints are linked. The keys are made for this number.
MAX_DISTANCE = 3
#: Lowest bit and width of each segment.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Fingerprints of one key that a task holds; 8 MB.
MAX_GROUP = 1 << 20
#: Shingles whose bits are counted at a time.
_BLOCK = 1 << 16
_DENSE = 1024
_SMALL = 16
#: Rows that a task gathers before it compares them.
_GATHER = 1 << 17
#: Four masks of 16 bits for each of three cuts.
_QUARTERS = [
    [sum(1 << b for b in range(64) if b // 4**depth % 4 == part) for part in range(4)] for depth in range(3)
]


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The fingerprint of one text, unsigned. Only A-Z are lowered."""
    words = text.lower().split()  # of bytes: ASCII letters, and space and U+0009 to U+000D
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: max(1, len(words) - shingle + 1)]
    ends = ends[min(shingle, len(words)) - 1 :]
    hashed, ones = xxhash.xxh64_intdigest, np.zeros(64, dtype=np.int64)
    for at in range(0, len(starts), _BLOCK):
        pairs = zip(starts[at : at + _BLOCK].tolist(), ends[at : at + _BLOCK].tolist())
        hashes = np.array([hashed(joined[s:e], seed) for s, e in pairs], dtype="<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    chosen = (2 * ones > len(starts)).astype(np.uint8)
    return int(np.packbits(chosen, bitorder="little").view("<u8")[0])


def fingerprints(
    docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc_id, fp) of every row; `fp` has the 64 bits as a signed number."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches):
            found = [fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"", shingle, seed) for t in chunk.column("text")]
            yield to_batch(schema, [chunk.column("doc_id"), np.array(found, dtype=np.uint64).view(np.int64)])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return map_arrow(rows, work, "doc_id long, fp long")


# Keys ------------------------------------------------------------------------------------------------


def keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All keys of each fingerprint, and which fingerprint they are of. The top four bits name the kind."""
    parts = [(fps >> np.uint64(low)) & np.uint64((1 << width) - 1) for low, width in SEGMENTS]
    odd = [np.bitwise_count(p) & 1 == 1 for p in parts]
    # Without a codeword -1; even segments give their own only.
    codes = [codewords(p) for p in parts]
    usable = [(c >= 0) & (o[:, None] | (np.arange(6) == 0)) for c, o in zip(codes, odd)]
    codes = [c.astype(np.uint64) for c in codes]
    found: list[np.ndarray] = []
    owner: list[np.ndarray] = []

    def add(kind: int, key: np.ndarray, rows: np.ndarray) -> None:
        found.append(key[rows] | np.uint64(kind << 60))
        owner.append(rows)

    every = np.arange(len(fps))
    for kind, (i, j) in enumerate(combinations(range(3), 2)):
        add(kind, parts[i] << np.uint64(22) | parts[j], every)
    for kind, (i, j) in enumerate(permutations(range(3), 2), 3):
        for c in range(6):
            add(kind, parts[i] << np.uint64(12) | codes[j][:, c], np.flatnonzero(usable[j][:, c]))
    # One error in each segment turns all three parities round.
    pattern = (odd[0] + 2 * odd[1] + 4 * odd[2]).astype(np.uint64)
    either = np.minimum(pattern, np.uint64(7) - pattern) << np.uint64(36)
    for a, b, c in product(range(6), repeat=3):
        key = either | codes[0][:, a] << np.uint64(24) | codes[1][:, b] << np.uint64(12) | codes[2][:, c]
        add(9, key, np.flatnonzero(usable[0][:, a] & usable[1][:, b] & usable[2][:, c]))
    return np.concatenate(found), np.concatenate(owner)


# Links -----------------------------------------------------------------------------------------------


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect the same nodes: each node with the smallest of its component."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while len(x):
        low, high = np.minimum(label[x], label[y]), np.maximum(label[x], label[y])
        apart = low != high
        x, y = x[apart], y[apart]
        np.minimum.at(label, high[apart], low[apart])
        while (label != label[label]).any():
            label = label[label]
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _is_near(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x ^ y) <= MAX_DISTANCE


def group_links(key: np.ndarray, fp: np.ndarray, depth: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect all near fingerprints with equal keys. Rows come sorted by key."""
    if not len(key):
        return fp, fp
    begins = np.flatnonzero(np.diff(key, prepend=~key[:1]) != 0)
    sizes = np.diff(np.append(begins, len(key)))
    left, right = [], []
    small = np.repeat((sizes > 1) & (sizes <= _SMALL), sizes)
    k, f = key[small], fp[small]
    for step in range(1, min(_SMALL, len(k))):
        same = np.flatnonzero(k[step:] == k[:-step])
        if not len(same):
            break
        near = same[_is_near(f[same], f[same + step])]
        left.append(f[near])
        right.append(f[near + step])
    for g in np.flatnonzero(sizes > _SMALL):
        members = np.unique(fp[begins[g] : begins[g] + sizes[g]])
        if len(members) > _DENSE and depth < len(_QUARTERS):
            for mask in _QUARTERS[depth]:
                part = members & np.uint64(mask)
                order = np.argsort(part, kind="stable")
                a, b = group_links(part[order], members[order], depth + 1)
                left.append(a)
                right.append(b)
            continue
        for i in range(0, len(members), _DENSE):
            for j in range(i, len(members), _DENSE):
                x, y = members[i : i + _DENSE], members[j : j + _DENSE]
                p, q = np.nonzero(_is_near(x[:, None], y[None, :]))
                a, b = forest(x[p], y[q])
                left.append(a)
                right.append(b)
    if not left:
        return fp[:0], fp[:0]
    return forest(np.concatenate(left), np.concatenate(right))


_FOUND = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _found(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return to_batch(_FOUND, [a.view(np.int64), b.view(np.int64)])


def _compare(limit: int | None):
    """Links within the keys of sorted rows (key, fp). A key of over `limit` rows comes as (key, null)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        hot: int | None = None  # a key that is passed over
        rows = 0

        def settle(last: bool) -> Iterator[pa.RecordBatch]:
            """Compare all keys that are complete and keep the rows of the newest one."""
            nonlocal held, hot, rows
            key, fp = (np.concatenate(x) for x in zip(*held))
            if hot is not None:
                rest = key != np.uint64(hot)
                key, fp = key[rest], fp[rest]
                if len(key):
                    hot = None
            end = len(key) if last or not len(key) else int(np.searchsorted(key, key[-1]))
            yield _found(*group_links(key[:end], fp[:end]))
            key, fp = key[end:], fp[end:]
            if limit is not None and len(key) > limit:
                hot = int(key[0])
                yield to_batch(_FOUND, [key[:1].view(np.int64), [None]])
                key, fp = key[:0], fp[:0]
            held, rows = [(key, fp)], len(key)

        due = _GATHER
        for batch in batches:
            pair = tuple(batch.column(c).to_numpy().view(np.uint64) for c in ("key", "fp"))
            held.append(pair)
            rows += len(pair[0])
            if rows >= due:
                yield from settle(False)
                due = 2 * rows + _GATHER  # a large key is gathered in few copies
        if held:
            yield from settle(True)

    return work


def near_links(fps: DataFrame, max_group: int = MAX_GROUP) -> DataFrame:
    """(a, b): links over which all near fingerprints of `fps(fp)`, which has each once, are connected."""
    schema = pa.schema([("key", pa.int64()), ("fp", pa.int64())])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column("fp").to_numpy().view(np.uint64)
            found, owner = keys(values)
            yield to_batch(schema, [found.view(np.int64), values[owner].view(np.int64)])

    keyed = map_arrow(fps.select("fp"), emit, "key long, fp long")
    links = None
    for depth in range(len(_QUARTERS) + 1):
        # Signed order keeps equal keys together, which is all that is needed; tasks compare them unsigned.
        in_order = keyed.repartition("key").sortWithinPartitions(F.col("key").bitwiseXOR(F.lit(-(1 << 63))))
        limit = max_group if depth < len(_QUARTERS) else None
        found = stored(map_arrow(in_order, _compare(limit), "a long, b long"), "fingerprint-links")
        more = found.where("b IS NOT NULL")
        links = more if links is None else links.union(more)
        hot = found.where("b IS NULL").select(F.col("a").alias("key"))
        if limit is None or hot.isEmpty():
            return links
        masks = [m - (1 << 64) if m >> 63 else m for m in _QUARTERS[depth]]
        cut = [F.xxhash64("key", F.lit(i), F.col("fp").bitwiseAND(F.lit(m))) for i, m in enumerate(masks)]
        keyed = keyed.join(hot, "key", "left_semi").select(F.explode(F.array(*cut)).alias("key"), "fp")
    return links


def near_duplicates(
    docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc_id, fp, component_id) of every row of `docs`."""
    members = stored(fingerprints(docs, shingle, seed, doc_id, text), "fingerprints")
    distinct = members.groupBy("fp").agg(F.min("doc_id").alias("smallest"), F.count("*").alias("n"))
    distinct = stored(distinct, "distinct-fingerprints")
    labels = connected(near_links(distinct))
    classes = distinct.join(labels.withColumnRenamed("node", "fp"), "fp", "left")
    classes = classes.select("fp", "n", "smallest", F.coalesce("label", "fp").alias("label"))
    roots = classes.groupBy("label").agg(F.min("smallest").alias("component_id"))
    named = stored(classes.join(roots, "label").select("fp", "n", "component_id"), "classes")
    return join_counted(members, named, "fp", "n").select("doc_id", "fp", "component_id")


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
