"""Spelling variants: words one letter apart, by a trie-node pair dictionary.

All frequent words are entered into a trie and, reversed, into a second one, and the nodes are numbered
(`_tries`). A word with the letter at place i left out is then a pair of numbers: the node of what comes
before it and the node (of the second trie) of what follows. A word itself is such a pair too, split before
place i with nothing left out. Joined on the pair, words that both leave one letter out differ by a replaced
letter; a word that leaves one out meets the word that is whole there, and they differ by an inserted one.
Equal pairs are equal strings, so what meets is near, without any further test, and all that is near meets.

A pair stands for one string around one open place, so only as many words share it as there are letters:
no group is larger than the alphabet and one. A letter within a run of equal letters is left out at the
run's first place only for insertions, so two words meet once.

Each word takes the near word that occurs most as its form, if that occurs `RATIO` times as often, and the
form of that in turn. Counts rise fivefold on each step, so the roots are found by a few rounds of pointer
jumping. Ties of counts go to the smaller word. Letters are code points of any length of word. Null, empty
and letterless texts have no words; repeated rows count each; an empty table gives no rows. Only the named
columns are read, so clashing names do no harm. A very long text is read whole, by blocks.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenkeel.llm import _tries
from evenkeel.llm._frames import map_arrow, stored
from evenkeel.llm._text import chunks, to_batch
from evenkeel.llm.components import _flatten

#: A maximal run of these is a word, after A-Z were lowered.
LETTERS = re.compile("[a-zÀ-ÿ]+")
MIN_LETTERS = 6
MIN_COUNT = 5
#: How much more often a form occurs than its variant.
RATIO = 5
#: The contract of `op12`: one run in so many loses a letter.
SLIP_EVERY = 199
#: Distinct words that a task counts before it hands them on.
_FLUSH = 1 << 17
#: Letters of words whose places are made at a time.
_DICTIONARY_LETTERS = 1 << 16
#: Characters of a text that are cut into words at a time.
_BLOCK = 1 << 20


def _runs(text: str) -> Iterator[list[str]]:
    """The runs of letters of a text, block by block; a run at the end of a block goes to the next one."""
    at = 0
    while at < len(text):
        end = at + _BLOCK
        while end < len(text) and LETTERS.match(text[end].lower() if text[end].isascii() else text[end]):
            end += 1
        # bytes.lower() lowers A-Z only.
        yield LETTERS.findall(text[at:end].encode().lower().decode())
        at = end


def slipped(word: str, n: int, before: int) -> list[tuple[str, int]]:
    """A run's n occurrences in a text after slips; `before` is the checksum of the text's id and a colon."""
    h = zlib.crc32(word.encode(), before)
    if h % SLIP_EVERY:
        return [(word, n)]
    k = h % len(word)
    return [(word[:k] + word[k + 1 :], n)]


def word_counts(
    docs: DataFrame, min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT, slips: bool = False,
    doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """(word, n) of the words with so many letters and occurrences.

    With `slips`, a letter is left out of some runs first, told by a checksum of the id and the run; a null
    id counts as an empty one.
    """
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()
        for chunk in chunks(batches):
            for number, content in zip(chunk.column("doc_id").to_pylist(), chunk.column("text").to_pylist()):
                here: Counter[str] = Counter()
                for found in _runs(content or ""):
                    here.update(found)
                if slips:
                    before = zlib.crc32(f"{'' if number is None else number}:".encode())
                    for word, n in here.items():
                        for result, m in slipped(word, n, before):
                            total[result] += m
                else:
                    total.update(here)
                if len(total) > _FLUSH:
                    yield to_batch(schema, [list(total), list(total.values())])
                    total.clear()
        yield to_batch(schema, [list(total), list(total.values())])

    rows = docs.select(F.col(doc_id).cast("string").alias("doc_id"), F.col(text).cast("string").alias("text"))
    counted = map_arrow(rows, work, "word string, n long").where(F.char_length("word") >= min_letters)
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


#: What a row of the dictionary says of its word at the open place: a letter is left out there (which is, or
#: is not, the first of equal ones), or none.
_SKIPS, _SKIPS_FIRST, _WHOLE = range(3)


def numbered_words(words: DataFrame, range_words: int = _tries.RANGE_WORDS) -> DataFrame:
    """(word, n, id, prefixes, suffixes) of the distinct `words(word, n)`, stored.

    `prefixes` numbers the beginnings of the word in a trie, `suffixes` its ends in the trie of the reversed
    words; both start with the empty one. `id` orders by word.
    """
    words = stored(words.select("word", "n"), "words")
    count = words.count()
    back = words.select(F.reverse("word").alias("word"))
    forward = _tries.numbered(words, _tries.bounds(words, count, range_words))
    backward = _tries.numbered(back, _tries.bounds(back, count, range_words))
    forward = forward.select("word", "id", F.col("nodes").alias("prefixes"))
    backward = backward.select(F.reverse("word").alias("word"), F.col("nodes").alias("suffixes"))
    return stored(words.join(forward, "word").join(backward, "word"), "numbered-words")


def pair_dictionary(numbered: DataFrame) -> DataFrame:
    """(prefix, suffix, kind, id, n): every open place of every word as a pair of nodes."""
    schema = pa.schema([(c, pa.int64()) for c in ("prefix", "suffix", "kind", "id", "n")])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for few in chunks([batch], "word", _DICTIONARY_LETTERS):
                before, after = few.column("prefixes").flatten().to_numpy(), few.column("suffixes").flatten().to_numpy()
                # Places per word: one for each letter and one at the end.
                places = np.diff(few.column("prefixes").offsets.to_numpy()).astype(np.int64)
                ends = np.cumsum(places)
                of = np.repeat(np.arange(len(places)), places)
                at = np.arange(len(of)) - (ends - places)[of]
                # What follows place i has the other letters; the suffixes begin with the shortest.
                follows = after[ends[of] - 1 - at]
                inner = np.flatnonzero(at < places[of] - 1)
                letters = np.zeros(len(of), dtype=np.uint32)
                letters[inner] = np.frombuffer("".join(few.column("word").to_pylist()).encode("utf-32-le"), dtype=np.uint32)
                first = (at[inner] == 0) | (letters[inner] != letters[inner - 1])
                kinds = np.concatenate([np.where(first, _SKIPS_FIRST, _SKIPS), np.full(len(of), _WHOLE)])
                rows = np.concatenate([of[inner], of])
                ids, n = (few.column(c).to_numpy() for c in ("id", "n"))
                yield to_batch(
                    schema,
                    [
                        np.concatenate([before[inner], before]),
                        np.concatenate([follows[inner + 1], follows]),
                        kinds,
                        ids[rows],
                        n[rows],
                    ],
                )

    rows = numbered.select("word", "id", "n", "prefixes", "suffixes")
    return map_arrow(rows, work, "prefix long, suffix long, kind long, id long, n long")


def neighbours(pairs: DataFrame) -> DataFrame:
    """(id, n_near, best) of each word with a near one; `best` is (rank, id) of the greatest, rank being -n.

    A group has at most a row for each letter and one more, so lists of it are short.
    """
    member = F.struct((-F.col("n")).alias("rank"), "id", "kind")
    groups = pairs.groupBy("prefix", "suffix").agg(F.sort_array(F.collect_list(member)).alias("of"))
    each = groups.where(F.size("of") > 1).select("of", F.explode("of").alias("m"))

    def meets(x):
        kind = F.col("m")["kind"]
        here = F.when(kind == _WHOLE, x["kind"] == _SKIPS_FIRST).otherwise((x["kind"] != _WHOLE) | (kind == _SKIPS_FIRST))
        return here & (x["id"] != F.col("m")["id"])

    near = each.select(F.col("m")["id"].alias("id"), F.filter("of", meets).alias("near")).where(F.size("near") > 0)
    first = F.struct(F.col("near")[0]["rank"].alias("rank"), F.col("near")[0]["id"].alias("id"))
    return near.groupBy("id").agg(F.sum(F.size("near")).alias("n_near"), F.min(first).alias("best"))


def variants(words: DataFrame, ratio: int = RATIO, range_words: int = _tries.RANGE_WORDS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the distinct `words(word, n)`."""
    numbered = numbered_words(words, range_words)
    found = numbered.select("id", "word", "n").join(neighbours(pair_dictionary(numbered)), "id", "left")
    takes = -F.col("best")["rank"] >= ratio * F.col("n")
    found = found.select(
        "id",
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(takes, F.col("best")["id"]).alias("form_id"),
        F.when(takes, -F.col("best")["rank"]).alias("form_n"),
    )
    found = stored(found, "variants")
    links = found.where("form_id IS NOT NULL").select(F.col("id").alias("node"), F.col("form_id").alias("label"))
    roots = _flatten(stored(links, "forms")).select(F.col("node").alias("id"), F.col("label").alias("root_id"))
    named = numbered.select("id", "word")
    forms, tops = (named.select(F.col("id").alias(f"{c}_id"), F.col("word").alias(c)) for c in ("form", "root"))
    rows = found.join(roots, "id", "left").join(forms, "form_id", "left").join(tops, "root_id", "left")
    return rows.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
