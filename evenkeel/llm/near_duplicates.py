"""Near-duplicate documents: n-gram Jaccard join over parity sketches.

Sets of word shingles are compared by their sketches. A sketch has one 64-bit word for each of P ranges
of the hash space, into which the hashes of the set's shingles in that range are XORed. A shingle that
only one of two sets has changes one word at most, so the number of differing words is at most the
symmetric difference. That is bounded for two similar sets by their sizes: at most D. With P > D some
word is equal in both (pigeonhole), and with P = D + t at least t words are.

The join runs per size band. Words that no other set has can't be equal to any, so a first shuffle counts
in how many sets each word occurs. A set's words are then put in order of that number; two similar sets
must share one of their first D + 1, so only these are joined, and words of common passages are hardly
ever among them. A set with D + 1 words of its own has no similar set and leaves at this point.

Sets that share such a word are candidates. Groups are not expanded into pairs: in the first rounds each
set is tested against one set that it shares a word with; groups whose sets are then in one component are
done. Of the others, blocks of sets are compared by 1,024-bit parity sketches, whose Hamming distance
bounds the symmetric difference from below; only pairs of different components that pass become rows.
All pairs are verified on the sets themselves.

Shingles are 64-bit hashes, sets of equal hashes are one set. Documents without words have an empty set
and are linked with nothing. Rows with the same id stay separate rows, repeated rows too; a null id is never
a `component_id` unless it stands alone. A very long text is a chunk of its own and read whole. Of sets that
are equally near the middle of a group the one with the smaller id is tested first, which changes no result.
An empty table gives no rows. Columns other than the id and the text are not read, so clashing names do no
harm.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenkeel.llm import _sketch
from evenkeel.llm._frames import bounded_batches, map_arrow, stored, text_bytes
from evenkeel.llm._text import by_slice, chunks, mix, ngram_ranges, range_hashes, to_batch, unpack, word_hashes, words
from evenkeel.llm.components import connected

#: Words in a shingle.
SHINGLE = 5
#: Two sets are similar if 100 * intersection >= PERCENT * union.
PERCENT = 80
#: Text for each slice of the sketch words.
_SLICE_TEXT = 8 << 20
#: Sketch words that a task gathers before it packs them.
_FLUSH = 1 << 20
#: Ratio of the bounds of a size band. Similar sets are in the same or in neighbouring bands.
_BAND_RATIO = 1.6
_PARITY_WORDS = 16
#: Sets in a block of a group, about.
_BLOCK_SETS = 128
#: Rounds in which each set is tested once.
_TURNS = (0, 1)


class Bands:
    """Size bands and what follows from the threshold for each of them."""

    def __init__(self, percent: int = PERCENT):
        self.percent = percent
        highs = [1]
        while highs[-1] < 1 << 40:
            reach = highs[-1] * 100 // percent
            highs.append(max(highs[-1] + 1, reach, int(highs[-1] * _BAND_RATIO)))
        self.high = np.array(highs, dtype=np.int64)
        self.distance = self._distance(self.high + self.high * 100 // percent)
        spare = -(-self.distance * 15 // 100)
        self.parts = self.distance + 1 + spare
        # Sizes in eight bits, rounded up: exact below 64, then in steps of 8 %.
        self.size_steps = np.concatenate([np.arange(64), np.ceil(64 * 1.08 ** np.arange(192))]).astype(np.int64)

    def _distance(self, sizes: np.ndarray) -> np.ndarray:
        """Largest symmetric difference of two similar sets with so many shingles together."""
        return sizes * (100 - self.percent) // (100 + self.percent)

    def of(self, size: int) -> list[int]:
        """The bands in which a set is joined: its own, and the one below if a similar set may be there."""
        own = int(np.searchsorted(self.high, size))
        if own and self.high[own - 1] * 100 >= size * self.percent:
            return [own, own - 1]
        return [own]

    def step(self, size: int) -> int:
        return int(np.searchsorted(self.size_steps, size))

    def reach(self, step: np.ndarray) -> np.ndarray:
        """Largest symmetric difference between a set of that size and any similar one."""
        size = self.size_steps[step]
        return self._distance(size + size * 100 // self.percent)


def _sets(texts: pa.Array, n: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(row, id, sorted shingles) of every text with words. The id is a 64-bit hash of all of them."""
    w = words(texts, lower=True)
    hashes = word_hashes(w)
    starts, ends, _ = ngram_ranges(w.first, n, short=True)
    shingles = range_hashes(hashes, starts, ends)
    sizes = np.diff(w.first)
    counts = np.where(sizes > 0, np.maximum(sizes - n + 1, 1), 0)
    at = np.concatenate([[0], np.cumsum(counts)])
    for row in np.flatnonzero(counts):
        found = np.unique(shingles[at[row] : at[row + 1]])
        both = np.array([found.sum(dtype=np.uint64), np.bitwise_xor.reduce(mix(found))], dtype=np.uint64)
        yield int(row), int(mix(mix(both[:1]) * np.uint64(3) + both[1:])[0]), found


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def sketch_words(found: np.ndarray, band: int, parts: int) -> np.ndarray:
    """The words of a sketch, each mixed with its place and band, so that equal words are equal keys."""
    part = ((found >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    begins = np.flatnonzero(np.diff(part, prepend=np.uint64(parts)))
    values = np.zeros(parts, dtype=np.uint64)
    values[part[begins].astype(np.int64)] = np.bitwise_xor.reduceat(mix(found), begins)
    return mix(values ^ mix(np.arange(parts, dtype=np.uint64) + np.uint64((band + 1) << 40)))


def parity_sketch(found: np.ndarray) -> np.ndarray:
    """1,024 parity bits: each shingle flips one."""
    bit = (mix(found) >> np.uint64(54)).astype(np.int64)
    bits = (np.bincount(bit, minlength=64 * _PARITY_WORDS) & 1).astype(np.uint8)
    return np.packbits(bits).view(np.int64)


# Steps ---------------------------------------------------------------------------------------------


def shingle_sets(docs: DataFrame, n: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, sid) of every row; `sid` stands for the set and is null for an empty one."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("sid", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches):
            sizes = [0] * chunk.num_rows
            ids: list[int | None] = [None] * chunk.num_rows
            for row, sid, found in _sets(chunk.column("text"), n):
                sizes[row], ids[row] = len(found), _signed(sid)
            yield to_batch(schema, [chunk.column("doc_id"), sizes, ids])

    return map_arrow(docs, work, "doc_id long, n_shingles long, sid long")


def _packed_words(docs: DataFrame, n: int, percent: int, slices: int) -> DataFrame:
    """Sketch words of all sets by slice: 32 bits of the word, the set, the band and the size step."""
    bands = Bands(percent)
    schema = pa.schema([("slice", pa.int32())] + [(c, pa.binary()) for c in ("words", "sids", "bands", "steps")])

    def pack(held: dict[int, list]) -> Iterator[pa.RecordBatch]:
        flat = [(sid, band, step, k) for sid, pairs in held.items() for band, step, k in pairs]
        keys = np.concatenate([k for *_, k in flat])
        lengths = [len(k) for *_, k in flat]
        sids = np.repeat(np.array([s for s, *_ in flat], dtype=np.uint64), lengths)
        in_band, steps = (np.repeat(np.array([x[i] for x in flat], dtype=np.uint8), lengths) for i in (1, 2))
        place = ((keys >> np.uint64(32)) % np.uint64(slices)).astype(np.int64)
        rows = list(by_slice(place, keys.astype(np.uint32), sids, in_band, steps))
        yield to_batch(schema, [list(c) for c in zip(*rows)])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        gathered = 0
        for chunk in chunks(batches):
            for _, sid, found in _sets(chunk.column("text"), n):
                if sid not in held:
                    step = bands.step(len(found))
                    held[sid] = [(b, step, sketch_words(found, b, int(bands.parts[b]))) for b in bands.of(len(found))]
                    gathered += sum(len(k) for *_, k in held[sid])
            if gathered >= _FLUSH:
                yield from pack(held)
                held, gathered = {}, 0
        if held:
            yield from pack(held)

    return map_arrow(docs, work, "slice int, words binary, sids binary, bands binary, steps binary")


def _repeated_words(packed: DataFrame, slices: int) -> DataFrame:
    """Words that two or more sets have, with the number of these sets, packed by set."""
    schema = pa.schema(
        [("part", pa.int32()), ("slice", pa.int32())]
        + [(c, pa.binary()) for c in ("words", "sids", "bands", "steps", "counts")]
    )

    def work(table: pa.Table) -> pa.Table:
        if table.num_rows == 0:
            return schema.empty_table()
        number = table.column("slice")[0].as_py()
        keys, sids = unpack(table.column("words"), np.uint32), unpack(table.column("sids"), np.uint64)
        in_band, steps = (unpack(table.column(c), np.uint8) for c in ("bands", "steps"))
        order = np.lexsort((sids, keys))
        keys, sids, in_band, steps = keys[order], sids[order], in_band[order], steps[order]
        new_key = np.diff(keys, prepend=~keys[:1]) != 0
        first = new_key | (np.diff(sids, prepend=~sids[:1]) != 0)
        keys, sids, in_band, steps, new_key = keys[first], sids[first], in_band[first], steps[first], new_key[first]
        begins = np.flatnonzero(new_key)
        counts = np.diff(np.append(begins, len(keys)))
        counts = np.repeat(counts, counts).astype(np.uint32)
        often = counts > 1
        keys, sids, in_band, steps, counts = keys[often], sids[often], in_band[often], steps[often], counts[often]
        place = (sids % np.uint64(slices)).astype(np.int64)
        rows = [(p, number, *c) for p, *c in by_slice(place, keys, sids, in_band, steps, counts)]
        return pa.Table.from_batches([to_batch(schema, [list(c) for c in zip(*rows)])] if rows else [], schema)

    ddl = "part int, slice int, words binary, sids binary, bands binary, steps binary, counts binary"
    return packed.groupBy("slice").applyInArrow(work, ddl)


def _joined_words(repeated: DataFrame, percent: int) -> DataFrame:
    """(key, sid): the words of each set that the join needs."""
    schema = pa.schema([("key", pa.int64()), ("sid", pa.int64())])
    bands = Bands(percent)

    def work(table: pa.Table) -> pa.Table:
        if table.num_rows == 0:
            return schema.empty_table()
        low, sids = unpack(table.column("words"), np.uint32), unpack(table.column("sids"), np.uint64)
        in_band, steps = (unpack(table.column(c), np.uint8) for c in ("bands", "steps"))
        counts = unpack(table.column("counts"), np.uint32)
        lengths = [len(x.as_py()) // 4 for x in table.column("words")]
        high = np.repeat(np.array(table.column("slice").to_pylist(), dtype=np.uint64), lengths)
        keys = (high << np.uint64(32)) | low
        order = np.lexsort((keys, counts, in_band, sids))
        keys, sids, in_band, steps = keys[order], sids[order], in_band[order], steps[order]
        new = (np.diff(sids, prepend=~sids[:1]) != 0) | (np.diff(in_band.astype(np.int16), prepend=-1) != 0)
        begins = np.flatnonzero(new)
        found = np.diff(np.append(begins, len(keys)))
        band, step = in_band[begins].astype(np.int64), steps[begins].astype(np.int64)
        prefix = np.minimum(bands.reach(step), bands.distance[band]) + 1
        own = bands.parts[band] - found
        take = np.maximum(prefix - own, 0)
        rank = np.arange(len(keys)) - np.repeat(begins, found)
        chosen = rank < np.repeat(take, found)
        return pa.Table.from_batches(
            [to_batch(schema, [keys[chosen].view(np.int64), sids[chosen].view(np.int64)])], schema
        )

    return repeated.groupBy("part").applyInArrow(work, "key long, sid long")


def candidate_groups(docs: DataFrame, n: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(key, sid): sets that share a key are candidates. Keys with the same sets are kept once."""
    slices = max(8, text_bytes(docs) // _SLICE_TEXT)
    bounded_batches(docs.sparkSession)
    joined = stored(
        _joined_words(_repeated_words(_packed_words(docs, n, percent, slices), slices), percent), "sketch-words"
    )
    groups = joined.groupBy("key").agg(
        F.count("*").alias("size"), F.sum(F.hash("sid").cast("long")).alias("x"), F.bit_xor(F.xxhash64("sid")).alias("y")
    )
    kept = groups.where("size > 1").groupBy("size", "x", "y").agg(F.min("key").alias("key"))
    return stored(joined.join(kept.select("key", "size"), "key"), "groups")


def candidate_sets(docs: DataFrame, groups: DataFrame, n: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(sid, n, parity, shingles) of every set in `groups`, and of a few others (a bit map finds them)."""
    sids = groups.select("sid").distinct()
    bits = _sketch.bits_for(sids.count(), 16)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = mix(batch.column("sid").to_numpy().view(np.uint64))
            yield from _sketch.sparse_rows(_sketch.cells_of(hashes, 0, bits), 0, bits)

    maps = _sketch.merge(map_arrow(sids, cells, _sketch.SPARSE_DDL), bits, 1, 1)
    shared = docs.sparkSession.sparkContext.broadcast(maps)
    schema = pa.schema(
        [("sid", pa.int64()), ("n", pa.int64()), ("parity", pa.list_(pa.int64())), ("shingles", pa.binary())]
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches):
            found = {sid: s for _, sid, s in _sets(chunk.column("text"), n)}
            ids = np.fromiter(found, dtype=np.uint64, count=len(found))
            chosen = ids[_sketch.holds(shared.value, mix(ids), bits)]
            sets = [found[int(i)] for i in chosen]
            yield to_batch(
                schema,
                [
                    chosen.view(np.int64),
                    [len(s) for s in sets],
                    [parity_sketch(s) for s in sets],
                    [s.tobytes() for s in sets],
                ],
            )

    every = map_arrow(docs, work, "sid long, n long, parity array<long>, shingles binary")
    once = every.groupBy("sid").agg(*[F.first(c).alias(c) for c in ("n", "parity", "shingles")])
    return stored(once, "sets")


def similar_pairs(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Those pairs (a, b) of sets that are similar."""
    slim = sets.select("sid", "n", "parity")
    left, right = (slim.select([F.col(c).alias(f"{c}_{side}") for c in slim.columns]) for side in "ab")
    distance = F.aggregate(
        F.zip_with("parity_a", "parity_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))),
        F.lit(0).cast("long"),
        lambda total, x: total + x,
    )
    close = (
        pairs.join(left, F.col("a") == F.col("sid_a"))
        .join(right, F.col("b") == F.col("sid_b"))
        .where(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent)
        .where(distance * (100 + percent) <= (F.col("n_a") + F.col("n_b")) * (100 - percent))
        .select("a", "b")
    )
    full = sets.select("sid", "shingles")
    close = close.join(full.select(F.col("sid").alias("b"), F.col("shingles").alias("of_b")), "b")
    close = close.join(full.select(F.col("sid").alias("a"), F.col("shingles").alias("of_a")), "a")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for of_a, of_b in zip(batch.column("of_a"), batch.column("of_b")):
                x, y = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (of_a, of_b))
                place = np.minimum(np.searchsorted(x, y), len(x) - 1)
                both = int((x[place] == y).sum())
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, type=pa.bool_())).cast(schema)

    return map_arrow(close.select("a", "b", "of_a", "of_b"), work, "a long, b long")


def _open_groups(groups: DataFrame, labels: DataFrame | None) -> DataFrame:
    """The groups whose sets are in two or more components, with the component of each set as `label`."""
    named = groups.withColumn("label", F.col("sid"))
    if labels is not None:
        known = labels.select(F.col("node").alias("sid"), F.col("label").alias("known"))
        named = named.join(known, "sid", "left").withColumn("label", F.coalesce("known", "label")).drop("known")
    split = named.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y"))
    return stored(named.join(split.where("x <> y").select("key"), "key", "left_semi"), "open-groups")


def _star_pairs(members: DataFrame, turn: int) -> DataFrame:
    """One pair for each set: with the first set of its groups.

    First come sets with many keys. They have few words of their own, so they are close to what the group
    has in common. The next turn passes over the sets that were first before.
    """
    keys = members.groupBy("sid").agg(F.count("*").alias("n_keys"))
    ordered = members.join(keys, "sid").withColumn("place", F.struct(-F.col("n_keys"), "sid", "label"))
    for _ in range(turn):
        first = ordered.groupBy("key").agg(F.min("place").alias("first"))
        ordered = ordered.join(first, "key").withColumn("later", F.col("place") > F.col("first")).drop("first")
        ordered = ordered.withColumn("place", F.when(F.col("later"), F.col("place"))).drop("later")
    first = ordered.groupBy("key").agg(F.min("place").alias("first")).where("first IS NOT NULL")
    mine = members.join(first, "key").groupBy("sid", "label").agg(F.min("first").alias("first"))
    pairs = mine.select("sid", "label", F.col("first.sid").alias("pivot"), F.col("first.label").alias("other"))
    pairs = pairs.where("label <> other")
    return pairs.select(F.least("sid", "pivot").alias("a"), F.greatest("sid", "pivot").alias("b")).distinct()


def _block_pairs(members: DataFrame, sets: DataFrame, percent: int, best: bool) -> DataFrame:
    """Pairs of sets of one group and different components that their sketches let pass.

    Sets of a group are packed into blocks, and blocks are joined; only the pairs that pass become rows.
    With `best`, a set gives one pair at most with each component of the other block.
    """
    blocks = F.ceil(F.col("size") / _BLOCK_SETS)
    packed = (
        members.withColumn("block", F.pmod(F.xxhash64("sid"), blocks))
        .join(sets.select("sid", "n", "parity"), "sid")
        .groupBy("key", "block")
        .agg(F.collect_list(F.struct("sid", "n", "label", "parity")).alias("of"))
    )
    left, right = (packed.select("key", F.col("block").alias(x), F.col("of").alias(f"of_{x}")) for x in "xy")
    both = left.join(right, "key").where("x <= y").select(F.expr("x = y").alias("same"), "of_x", "of_y")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def columns(block: list[dict]) -> tuple[np.ndarray, ...]:
        sid, n, label = (np.array([r[c] for r in block], dtype=np.int64) for c in ("sid", "n", "label"))
        return sid, n, label, np.array([r["parity"] for r in block], dtype=np.int64).view(np.uint64)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                same, of_x, of_y = (c[i].as_py() for c in batch.columns)
                (sid, n, label, bits), (sid_y, n_y, label_y, bits_y) = columns(of_x), columns(of_y)
                apart = label[:, None] != label_y[None, :]
                if same:
                    apart &= np.arange(len(sid))[:, None] < np.arange(len(sid))[None, :]
                total = n[:, None] + n_y[None, :]
                apart &= np.minimum(n[:, None], n_y[None, :]) * 100 >= np.maximum(n[:, None], n_y[None, :]) * percent
                if not apart.any():
                    continue
                distance = np.zeros(apart.shape, dtype=np.int64)
                for k in range(bits.shape[1]):
                    distance += np.bitwise_count(bits[:, k, None] ^ bits_y[None, :, k])
                at, at_y = np.nonzero(apart & (distance * (100 + percent) <= total * (100 - percent)))
                if best and len(at):
                    order = np.lexsort((distance[at, at_y], label_y[at_y], at))
                    at, at_y = at[order], at_y[order]
                    new = (np.diff(at, prepend=-1) != 0) | (np.diff(label_y[at_y], prepend=~label_y[at_y[:1]]) != 0)
                    at, at_y = at[new], at_y[new]
                pair = np.sort(np.stack([sid[at], sid_y[at_y]]), axis=0)
                yield to_batch(schema, [pair[0], pair[1]])

    return map_arrow(both, work, "a long, b long").distinct()


def link_sets(groups: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(node, label): the component of every set that is linked with another.

    Groups whose sets are all in one component need no more tests. First a few rounds in which each set is
    tested once, which unite most copies; then, for the groups still open, the most alike pairs of every
    two components; last all pairs of different components that the sketches let pass.
    """
    links, labels = None, None
    for turn in (*_TURNS, "best", "all"):
        members = _open_groups(groups, labels)
        if members.isEmpty():
            break
        if isinstance(turn, int):
            pairs = _star_pairs(members, turn)
        else:
            pairs = _block_pairs(members, sets, percent, turn == "best")
        found = stored(similar_pairs(pairs, sets, percent), "links")
        if labels is None or not found.isEmpty():
            links = found if links is None else links.union(found)
            labels = stored(connected(links), "components")
    if labels is None:
        empty = groups.select(F.col("sid").alias("node"), F.col("sid").alias("label"))
        return empty.limit(0)
    return labels


def near_duplicates(
    docs: DataFrame, n: int = SHINGLE, percent: int = PERCENT, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of `docs`.

    `component_id` is the smallest id reachable over links (100 * intersection >= percent * union of the
    sets of distinct shingles), the own one included. Other columns are not read.
    """
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    members = stored(shingle_sets(docs, n, percent), "shingle-sets")
    groups = candidate_groups(docs, n, percent)
    labels = link_sets(groups, candidate_sets(docs, groups, n, percent), percent)
    classes = members.where("sid IS NOT NULL").groupBy("sid").agg(F.min("doc_id").alias("smallest"))
    classes = classes.join(labels.withColumnRenamed("node", "sid"), "sid", "left")
    classes = classes.select("sid", "smallest", F.coalesce("label", "sid").alias("label"))
    roots = classes.groupBy("label").agg(F.min("smallest").alias("component_id"))
    named = classes.join(roots, "label").select("sid", "component_id")
    return members.join(named, "sid", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")
    )
