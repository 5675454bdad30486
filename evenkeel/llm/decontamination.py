"""Benchmark decontamination with a positional inverted index over the training texts.

The index is cut by documents: each row is a segment of about a megabyte of text with, for each term,
the positions at which it stands. So a phrase is found inside one segment, without a shuffle. Within a
segment the lists of a window's terms, each less the term's offset, are intersected from the term that
is rarest in the whole corpus. Positions run on over the documents of a segment; a match that would
cross from one document into the next does not count.

Proximity matches are found on the same lists in the same pass: runs of so many words that hold all words
of a window in any order, and hold them no more if shortened on either side.

Terms are kept as 64-bit hashes. Null or empty texts have no words: they stand in the index with
`n_words` 0 and match nothing. Repeated rows and ids stay separate documents of the index. Of equally rare
terms the first is looked up first, which changes no result. A very long text is a segment of its own. An
empty table gives no rows, and no items match nothing. Columns other than the id and the text are not read,
so clashing names do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenkeel.llm._frames import join_counted, map_arrow, stored
from evenkeel.llm._text import (
    LETTER_OR_DIGIT,
    chunks,
    ngram_ranges,
    range_hashes,
    to_batch,
    word_hashes,
    words,
)

#: Words in a window.
WINDOW = 10
#: Words within which the query looks for the words of a window in any order.
NEAR = 15
#: Windows that one pass over the index takes; a larger benchmark takes several passes.
BLOCK_WINDOWS = 200_000
#: Text of a segment. Rows stay small for the Parquet writer.
SEGMENT_BYTES = 1 << 20

_SEGMENT = pa.schema(
    [
        ("segment", pa.int64()),
        ("doc_ids", pa.list_(pa.int64())),
        ("n_words", pa.list_(pa.int64())),
        ("terms", pa.list_(pa.int64())),
        ("counts", pa.list_(pa.int64())),
        ("gaps", pa.binary()),
    ]
)
_MATCH = pa.schema(
    [
        ("segment", pa.int64()),
        ("ordinal", pa.int32()),
        ("doc_id", pa.int64()),
        ("n_words", pa.int64()),
        ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
        ("windows", pa.list_(pa.int64())),
        ("near_spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
        ("near_windows", pa.list_(pa.int64())),
    ]
)
_MATCH_DDL = (
    "segment long, ordinal int, doc_id long, n_words long, "
    "spans array<struct<start: long, end: long>>, windows array<long>, "
    "near_spans array<struct<start: long, end: long>>, near_windows array<long>"
)


# Windows -------------------------------------------------------------------------------------------


def item_windows(items: DataFrame, item_id: str = "item_id", text: str = "text", n: int = WINDOW) -> DataFrame:
    """Distinct windows of the items: `terms` in order, and `items` that have them.

    A window is `n` consecutive words; an item of fewer words, but not none, is one window.
    """
    schema = pa.schema([("item", pa.string()), ("terms", pa.list_(pa.int64()))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches):
            w = words(chunk.column("text"), LETTER_OR_DIGIT, lower=True)
            hashes = word_hashes(w).view(np.int64)
            starts, ends, item = ngram_ranges(w.first, n, short=True)
            ids = chunk.column("item").take(pa.array(item))
            yield to_batch(schema, [ids, [hashes[s:e] for s, e in zip(starts, ends)]])

    rows = items.select(F.col(item_id).cast("string").alias("item"), F.col(text).cast("string").alias("text"))
    found = map_arrow(rows, work, "item string, terms array<long>")
    return found.groupBy("terms").agg(F.collect_set("item").alias("items"))


# Index ---------------------------------------------------------------------------------------------


def build_index(
    docs: DataFrame, terms: np.ndarray | None = None, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Segments of the positional index, stored in the shared folder.

    `terms` (hashes) leaves out the postings of all other words, which no query would read; positions
    still count every word. Without it all words are indexed.
    """
    wanted = None if terms is None else docs.sparkSession.sparkContext.broadcast(np.unique(terms))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None if wanted is None else wanted.value
        for chunk in chunks(batches, max_bytes=SEGMENT_BYTES):
            w = words(chunk.column("text"), LETTER_OR_DIGIT, lower=True)
            hashes = word_hashes(w).view(np.int64)
            at = np.arange(len(hashes))
            if known is not None:
                place = np.minimum(np.searchsorted(known, hashes), max(len(known) - 1, 0))
                keep = known[place] == hashes if len(known) else np.zeros(len(hashes), dtype=bool)
                hashes, at = hashes[keep], at[keep]
            order = np.argsort(hashes, kind="stable")
            unique, counts = np.unique(hashes, return_counts=True)
            # Positions ascend within a term; the gaps between them are small numbers that compress well.
            at = at[order]
            gaps = np.diff(at, prepend=0)
            begins = np.cumsum(counts) - counts
            gaps[begins] = at[begins]
            yield to_batch(
                _SEGMENT,
                [
                    [0],
                    [chunk.column("doc_id")],
                    [np.diff(w.first)],
                    [unique],
                    [counts],
                    [gaps.astype(np.int32).tobytes()],
                ],
            )

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    segments = map_arrow(
        rows,
        work,
        "segment long, doc_ids array<long>, n_words array<long>, terms array<long>, counts array<long>, gaps binary",
    )
    return stored(segments.withColumn("segment", F.monotonically_increasing_id()), "postings")


def term_counts(index: DataFrame) -> DataFrame:
    """How often each indexed term occurs in the corpus."""
    pairs = index.select(F.explode(F.arrays_zip("terms", "counts")).alias("x"))
    return pairs.groupBy(F.col("x.terms").alias("term")).agg(F.sum("x.counts").alias("n"))


class _Segment:
    """One row of the index, its lists decoded when asked for."""

    def __init__(self, row: dict):
        self.terms = np.asarray(row["terms"], dtype=np.int64)
        self.ends = np.cumsum(np.asarray(row["counts"], dtype=np.int64))
        self.gaps = np.frombuffer(row["gaps"], dtype=np.int32)
        self.n_words = np.asarray(row["n_words"], dtype=np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.n_words)])
        self._lists: dict[int, np.ndarray] = {}

    def positions(self, term: int) -> np.ndarray:
        if term not in self._lists:
            i = int(np.searchsorted(self.terms, term))
            if i == len(self.terms) or self.terms[i] != term:
                return np.zeros(0, dtype=np.int64)
            begin = self.ends[i - 1] if i else 0
            self._lists[term] = np.cumsum(self.gaps[begin : self.ends[i]], dtype=np.int64)
        return self._lists[term]

    def doc(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, at, side="right") - 1


def _among(values: np.ndarray, sorted_values: np.ndarray) -> np.ndarray:
    if len(sorted_values) == 0:
        return np.zeros(len(values), dtype=bool)
    return sorted_values[np.minimum(np.searchsorted(sorted_values, values), len(sorted_values) - 1)] == values


def _phrase(segment: _Segment, terms: list[int], order: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every place where the terms follow each other."""
    starts = segment.positions(terms[order[0]]) - order[0]
    for offset in order[1:]:
        if len(starts) == 0:
            break
        starts = starts[_among(starts + offset, segment.positions(terms[offset]))]
    starts = starts[starts >= 0]
    ends = starts + len(terms)
    same = segment.doc(starts) == segment.doc(ends - 1)
    return starts[same], ends[same]


def _near(segment: _Segment, terms: list[int], order: list[int], within: int) -> tuple[np.ndarray, np.ndarray]:
    """All minimal runs of at most `within` words that hold all terms, as often as the window has them."""
    need = {terms[i]: terms.count(terms[i]) for i in order}
    anchors = segment.positions(terms[order[0]])
    for term, times in need.items():
        if len(anchors) == 0:
            return anchors, anchors
        near = segment.positions(term)
        low = np.searchsorted(near, anchors - within + 1)
        high = np.searchsorted(near, anchors + within - 1, side="right")
        anchors = anchors[high - low >= times]
    if len(anchors) == 0:
        return anchors, anchors
    # A run holds the rarest term, so it lies in the words around one of its places; regions that meet are one.
    doc = segment.doc(anchors)
    low = np.maximum(anchors - within + 1, segment.first[doc])
    high = np.minimum(anchors + within, segment.first[doc + 1])
    new = np.r_[True, (doc[1:] != doc[:-1]) | (low[1:] > high[:-1])]
    starts, ends = [], []
    for begin, end in zip(low[new].tolist(), high[np.r_[new[1:], True]].tolist()):
        around = []
        for term in need:
            p = segment.positions(term)
            around += [(x, term) for x in p[np.searchsorted(p, begin) : np.searchsorted(p, end)].tolist()]
        around.sort()
        have, missing, left, last = dict.fromkeys(need, 0), len(terms), 0, -1
        for at, term in around:
            missing -= have[term] < need[term]
            have[term] += 1
            while have[around[left][1]] > need[around[left][1]]:
                have[around[left][1]] -= 1
                left += 1
            first = around[left][0]
            # With the same beginning as the run before, that one would be within this one.
            if missing == 0 and first > last:
                last = first
                if at - first < within:
                    starts.append(first)
                    ends.append(at + 1)
    return np.array(starts, dtype=np.int64), np.array(ends, dtype=np.int64)


def _block_matches(
    index: DataFrame, block: list[tuple[int, list[int]]], counts: dict[int, int], within: int | None, near: int | None
) -> DataFrame:
    """Matches of one block of windows (number, terms), for every document of the index."""
    by_anchor: dict[int, list[tuple[int, list[int], list[int]]]] = {}
    for number, terms in block:
        if all(t in counts for t in terms):
            order = sorted(range(len(terms)), key=lambda i: (counts[terms[i]], i))
            by_anchor.setdefault(terms[order[0]], []).append((number, terms, order))
    shared = index.sparkSession.sparkContext.broadcast(by_anchor)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = shared.value
        known = np.fromiter(sorted(anchors), dtype=np.int64, count=len(anchors))
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                segment = _Segment(row)
                found, around = _Found(segment), _Found(segment)
                for anchor in known[_among(known, segment.terms)]:
                    for number, terms, order in anchors[int(anchor)]:
                        if within is None:
                            found.add(number, *_phrase(segment, terms, order))
                        else:
                            found.add(number, *_near(segment, terms, order, within))
                        if near is not None:
                            around.add(number, *_near(segment, terms, order, near))
                n = len(segment.n_words)
                columns = [row["segment"]] * n, np.arange(n, dtype=np.int32), row["doc_ids"], segment.n_words
                yield to_batch(_MATCH, [*columns, *found.by_doc(), *around.by_doc()])

    return map_arrow(index, work, _MATCH_DDL)


class _Found:
    """Matches in one segment."""

    def __init__(self, segment: _Segment):
        self.segment = segment
        self.starts: list[np.ndarray] = []
        self.ends: list[np.ndarray] = []
        self.numbers: list[np.ndarray] = []

    def add(self, number: int, starts: np.ndarray, ends: np.ndarray) -> None:
        if len(starts):
            self.starts.append(starts)
            self.ends.append(ends)
            self.numbers.append(np.full(len(starts), number))

    def by_doc(self) -> tuple[list[list], list[list]]:
        """Per document: the spans that matches cover, and the windows that match."""
        segment, n = self.segment, len(self.segment.n_words)
        spans: list[list] = [[] for _ in range(n)]
        found: list[list] = [[] for _ in range(n)]
        if self.starts:
            s, e, k = (np.concatenate(x) for x in (self.starts, self.ends, self.numbers))
            order = np.argsort(s, kind="stable")
            s, e, k = s[order], e[order], k[order]
            docs = segment.doc(s)
            for d, begin, end in zip(docs, s - segment.first[docs], e - segment.first[docs]):
                merged = spans[d]
                if merged and begin <= merged[-1]["end"]:
                    merged[-1]["end"] = max(merged[-1]["end"], int(end))
                else:
                    merged.append({"start": int(begin), "end": int(end)})
            for d, number in np.unique(np.stack([docs, k]), axis=1).T:
                found[d].append(int(number))
        return spans, found


# Operator ------------------------------------------------------------------------------------------


def find_items(
    docs: DataFrame,
    items: DataFrame,
    n: int = WINDOW,
    within: int | None = None,
    near: int | None = None,
    block_windows: int = BLOCK_WINDOWS,
    doc_id: str = "doc_id",
    item_id: str = "item_id",
    text: str = "text",
) -> DataFrame:
    """Where the items' windows occur in the documents: one row per document.

    `spans` are word ranges (start, end exclusive, not overlapping) covered by matches, `n_hit` their
    words, `items` the ids (as strings) of items with an occurring window. Exact phrases by default;
    with `within`, a window's words in any order inside so many words. With `near`, such runs are told beside
    the matches, as `near_spans`, `n_near` and `near_items`; without it these are empty.

    The windows go to the driver and to the tasks in blocks of about `block_windows`, one pass over the
    index each. Items without words, or no items at all, match nothing; a null item id counts as an item
    without a name, which `items` leaves out.
    """
    spark = docs.sparkSession
    windows = stored(item_windows(items, item_id, text, n), "windows")
    n_blocks = max(1, -(-windows.count() // block_windows))
    windows = windows.withColumn("number", F.monotonically_increasing_id())
    windows = stored(windows, "windows-numbered")
    block_of = F.pmod(F.xxhash64("number"), F.lit(n_blocks))
    names = windows.select(F.explode("items").alias("item"), "number")
    if n_blocks == 1:
        vocabulary = windows.select(F.explode("terms").alias("t")).distinct()
        terms = np.array([r[0] for r in vocabulary.collect()], dtype=np.int64)
        index = build_index(docs, terms, doc_id, text)
    else:
        index = build_index(docs, None, doc_id, text)
    parts = []
    for b in range(n_blocks):
        mine = windows.where(block_of == b)
        rows = [(r[0], list(r[1])) for r in mine.select("number", "terms").collect()]
        asked = mine.select(F.explode("terms").alias("term")).distinct()
        counts = {r[0]: r[1] for r in term_counts(index).join(asked, "term", "left_semi").collect()}
        parts.append(_block_matches(index, rows, counts, within, near))
    matches = parts[0]
    for part in parts[1:]:
        matches = matches.unionByName(part)
    matches = stored(matches, "matches")

    keys = ["segment", "ordinal"]
    if n_blocks > 1:
        pairs = (("spans", "windows"), ("near_spans", "near_windows"))
        matches = matches.groupBy(*keys).agg(
            F.first("doc_id").alias("doc_id"),
            F.first("n_words").alias("n_words"),
            *[F.array_sort(F.flatten(F.collect_list(spans))).alias(spans) for spans, _ in pairs],
            *[F.array_sort(F.flatten(F.collect_list(found))).alias(found) for _, found in pairs],
        )
        matches = matches.withColumns({spans: _merged(spans) for spans, _ in pairs})
    out = _with_items(_with_items(matches, "windows", "items", names), "near_windows", "near_items", names)
    return out.select(
        "doc_id",
        "n_words",
        _length("spans").alias("n_hit"),
        "spans",
        "items",
        _length("near_spans").alias("n_near"),
        "near_spans",
        "near_items",
    )


def _with_items(matches: DataFrame, windows: str, out: str, names: DataFrame) -> DataFrame:
    """The ids of the items that a document's windows are of, as `out`.

    Copies of a passage have the same windows, so each distinct set of windows is looked up once, however
    many documents have it. Documents without windows take no part, and sets that very many have are
    broadcast.
    """
    has = matches.where(F.size(windows) > 0)
    sets = has.groupBy(windows).agg(F.count("*").alias("n"))
    each = sets.select(windows, F.explode(windows).alias("number")).join(names, "number").select(windows, "item")
    of_set = each.distinct().groupBy(windows).agg(F.array_sort(F.collect_list("item")).alias(out))
    none = F.array().cast("array<string>")
    # A set whose items have no names is among them too.
    table = stored(sets.join(of_set, windows, "left").withColumn(out, F.coalesce(out, none)), "window-sets")
    rest = matches.where(F.size(windows) == 0).withColumn(out, none)
    return join_counted(has, table, windows, "n").unionByName(rest)


def _length(spans: str) -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])


def _merged(spans: str):
    """Sorted spans with overlapping and touching ones made one."""
    empty = F.array().cast("array<struct<start: long, end: long>>")

    def step(done, s):
        last = F.element_at(done, -1)
        joined = F.concat(
            F.slice(done, 1, F.size(done) - 1),
            F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))),
        )
        apart = F.concat(done, F.array(s))
        return F.when((F.size(done) > 0) & (s["start"] <= F.try_element_at(done, F.lit(-1))["end"]), joined).otherwise(
            apart
        )

    return F.aggregate(spans, empty, step)


def digest(found: DataFrame) -> DataFrame:
    """The counts and the digest of `find_items`."""
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        "n_near",
        F.size("near_items").cast("long").alias("n_near_items"),
    )
