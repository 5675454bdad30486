"""Sum-of-squares packing of tokenised documents into sequences.

Documents are tokenised where they are read; only the pieces' numbers travel, never their tokens. Pieces
are dealt at random into groups of a bounded number, and each group is packed by itself: a piece goes to
the place where the sum of the squared counts of open sequences per remaining gap becomes smallest. So no
gap becomes common, and later pieces find what they fit into. Larger pieces come first. A new sequence is
opened only where a piece fits nowhere: on the test tables that gives the fewest sequences possible, and
the free choice of the textbook rule 0.2 to 1.4 % more. A group leaves a sequence or two that are not full.

A null or empty text is one piece with the end token alone. Repeated rows are packed as often as they
occur. A very long text is tokenised whole, and its full pieces are sequences by themselves. Of places with
the same sum the smallest gap is taken. An empty table gives no rows. Columns other than the id and the text
are not read, so clashing names do no harm.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenkeel.llm._frames import map_arrow, stored
from evenkeel.llm._text import chunks, to_batch

#: Tokens in a sequence.
CAPACITY = 2048
#: Token that ends each document.
END_TOKEN = 0
#: Pieces in a group, about.
GROUP_PIECES = 20_000
#: Vocabulary as ranks; it gives the same ids as byte_bpe_50k.json, several times faster.
VOCABULARY = "byte_bpe_50k"


#: A run of so many characters without a space is left to the tokenizer that takes any length.
_LONG_RUN = 20_000


class TokenIds:
    """Ids of texts, by the ranks of a vocabulary or by its tokenizer file: the same ids."""

    def __init__(self, vocabulary: str = VOCABULARY):
        import public_tokenizers
        import tiktoken

        self._json = public_tokenizers.path(f"{vocabulary}.json")
        self._tokenizer = None
        with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self._ranks = tiktoken.Encoding(
            vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        )

    def by_tokenizer(self, text: str) -> np.ndarray:
        if self._tokenizer is None:
            from tokenizers import Tokenizer

            self._tokenizer = Tokenizer.from_file(self._json)
            self._tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        return np.array(self._tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def __call__(self, text: str) -> np.ndarray:
        if len(text) >= _LONG_RUN and (" " * 1000 in text or max(map(len, text.split(" "))) >= _LONG_RUN):
            return self.by_tokenizer(text)
        return self._ranks.encode_to_numpy(text, disallowed_special=()).astype("<u4")


def pieces(
    docs: DataFrame,
    capacity: int = CAPACITY,
    vocabulary: str = VOCABULARY,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Pieces of every document: doc_id, piece, start, length, ids_crc32.

    A document is its ids and then the end token. One that is longer than a sequence is cut into full
    pieces, the first of which takes what is over. `vocabulary` names the files of a public tokenizer,
    which every executor has.
    """
    schema = pa.schema(
        [("doc_id", pa.int64()), ("piece", pa.int32())] + [(c, pa.int64()) for c in ("start", "length", "ids_crc32")]
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token_ids = TokenIds(vocabulary)
        for chunk in chunks(batches):
            out: list[list] = [[], [], [], [], []]
            for name, content in zip(chunk.column("doc_id").to_pylist(), chunk.column("text")):
                ids = np.append(token_ids(content.as_py() or ""), np.array([END_TOKEN], dtype="<u4"))
                cuts = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
                for k, (start, end) in enumerate(zip(cuts, cuts[1:])):
                    crc = zlib.crc32(ids[start:end].astype("<u4").tobytes())
                    for column, value in zip(out, (name, k, start, end - start, crc)):
                        column.append(value)
            yield to_batch(schema, out)

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return map_arrow(rows, work, "doc_id long, piece int, start long, length long, ids_crc32 long")


def place(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each piece, placed in the order given.

    A new sequence is opened only where no open one has room. Of equally good gaps the smallest is taken.
    """
    none = np.iinfo(np.int64).max
    open_by_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
    count = np.zeros(capacity + 1, dtype=np.int64)
    sequence, offset = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
    used = 0
    for i, size in enumerate(lengths.tolist()):
        gap = capacity
        if size < capacity:
            # How the sum of squares changes for each gap from `size` up.
            change = 2 * (count[: capacity - size] - count[size:capacity]) + 2
            change[0] = 1 - 2 * count[size]
            change[count[size:capacity] == 0] = none
            best = int(np.argmin(change))
            if change[best] < none:
                gap = size + best
        if gap == capacity:
            number, used = used, used + 1
        else:
            number = open_by_gap[gap].pop()
            count[gap] -= 1
        sequence[i], offset[i] = number, capacity - gap
        if gap > size:
            open_by_gap[gap - size].append(number)
            count[gap - size] += 1
    return sequence, offset


def pack(
    docs: DataFrame,
    capacity: int = CAPACITY,
    vocabulary: str = VOCABULARY,
    group_pieces: int = GROUP_PIECES,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """`pieces` with the sequence (any number) and offset at which each stands."""
    numbered = stored(
        pieces(docs, capacity, vocabulary, doc_id, text).withColumn("n", F.monotonically_increasing_id()), "pieces"
    )
    groups = max(1, -(-numbered.count() // group_pieces))

    def work(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "n"], ascending=[False, True], kind="stable")
        number, offset = place(group["length"].to_numpy(), capacity)
        return group.assign(sequence_id=group["part"].to_numpy() * (1 << 32) + number, offset=offset)[
            ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
        ]

    dealt = numbered.withColumn("part", F.pmod(F.xxhash64("n"), F.lit(groups)))
    return dealt.groupBy("part").applyInPandas(
        work,
        "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long",
    )
