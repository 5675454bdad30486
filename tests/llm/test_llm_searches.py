"""Operators 1, 2 and 9 against brute force."""

import random

import brute
import numpy as np
import pytest
from brute import SMALL

from evenkeel.llm import components, decontamination, near_duplicates, substring_dedup
from evenkeel.llm._frames import read
from evenkeel.llm._text import Words, words

HITS = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
KEPT = ("doc_id", "n_words", "n_removed", "kept_sha256")
NEAR = ("doc_id", "n_shingles", "component_id")


@pytest.fixture(scope="module")
def items(pairs):
    texts = [t for _, t in pairs if t and len(t.split()) > 30]
    some = [" ".join(texts[k].split()[5:25]) for k in range(6)]
    return [(k, t) for k, t in enumerate(some)] + [(0, some[1]), (70, some[0].upper()), (8, "one two"), (9, None), (10, "")]


@pytest.mark.parametrize("block_windows", [200_000, 25])
def test_decontamination(spark, docs, pairs, items, same, block_windows):
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = decontamination.find_items(docs, benchmark, block_windows=block_windows)
    expected = brute.contamination(pairs, items)
    assert sum(r[-1] for r in expected) > 10
    same(decontamination.digest(found), expected, *HITS)


def test_decontamination_of_nothing(spark, docs, no_docs, pairs, same):
    none = spark.createDataFrame([], "item_id long, text string")
    same(decontamination.digest(decontamination.find_items(docs, none)), brute.contamination(pairs, []), *HITS)
    assert decontamination.find_items(no_docs, none).count() == 0


def test_proximity(spark):
    docs = spark.createDataFrame(
        [(1, "x a y b z c x"), (2, "c b a"), (3, "a x x x x b x c"), (4, "a b"), (5, "c"), (6, "a b a c")],
        "doc_id long, text string",
    )
    items = spark.createDataFrame([(9, "A b C")], "item_id long, text string")
    found = decontamination.find_items(docs, items, within=5).orderBy("doc_id").collect()
    assert [(r.doc_id, r.n_hit, r["items"]) for r in found] == [
        (1, 5, ["9"]), (2, 3, ["9"]), (3, 0, []), (4, 0, []), (5, 0, []), (6, 3, ["9"]),
    ]


@pytest.mark.parametrize("block_windows", [3, 100_000])
def test_proximity_beside_phrases(spark, same, block_windows):
    """Shuffled and stretched passages, repeated words, shared windows, and copies of all of it."""
    rng = random.Random(block_windows)
    items = [(k, " ".join(rng.choices("abcdefgh", k=rng.randint(2, 7)))) for k in range(12)] + [(3, "a b a"), (None, "c c"), (5, None)]
    docs = []
    for k in range(60):
        w = rng.choices("abcdefghxyz", k=rng.randint(0, 30))
        docs.append((k, " ".join(w)))
        if k % 4 == 0:
            docs += [(100 + k, docs[-1][1])] * 2
    docs += [(None, "a b a"), (900, None), (901, "")]
    found = decontamination.find_items(
        spark.createDataFrame(docs, "doc_id long, text string"),
        spark.createDataFrame(items, "item_id long, text string"),
        n=4, near=7, block_windows=block_windows,
    )
    got = decontamination.digest(found)
    same(got, brute.near_words(docs, items, 7, 4), "doc_id", "n_near", "n_near_items")
    expected = brute.contamination(docs, items, 4)
    assert sum(r[2] > 0 for r in expected) > 10
    same(got, expected, *HITS)


def test_substring_dedup(docs, pairs, same):
    expected = brute.repeats(pairs)
    assert sum(r[2] > 0 for r in expected) > 30 and sum(0 < r[2] < r[1] for r in expected) > 10
    same(substring_dedup.digest(substring_dedup.remove_repeats(docs)), expected, *KEPT)


def test_substring_dedup_loses_nothing_behind_a_full_sketch(docs, pairs, same, monkeypatch):
    monkeypatch.setattr(substring_dedup._sketch, "bits_for", lambda *a: 12)
    monkeypatch.setattr(substring_dedup, "_FLUSH", 500)
    same(substring_dedup.digest(substring_dedup.remove_repeats(docs)), brute.repeats(pairs), *KEPT)


def test_near_duplicates(docs, pairs, same):
    expected = brute.near(pairs)
    assert sum(r[2] != r[0] for r in expected) > 30
    same(near_duplicates.near_duplicates(docs), expected, *NEAR)


def test_near_duplicates_with_a_large_group(spark, same):
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(220):
        copy = list(base)
        for at in rng.choice(150, size=rng.integers(0, 7), replace=False):
            copy[at] = f"e{rng.integers(10_000)}"
        rows.append((i, " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    expected = brute.near(rows)
    assert 10 < sum(r[0] == r[2] for r in expected) < 200
    same(near_duplicates.near_duplicates(docs), expected, *NEAR)


@pytest.mark.parametrize("operator", [substring_dedup.remove_repeats, near_duplicates.near_duplicates])
def test_empty_tables(no_docs, operator):
    assert operator(no_docs).count() == 0


def test_equal_sketch_words_bound_the_difference():
    rng = np.random.default_rng(5)
    for size in (5, 40, 300):
        a = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64) * np.uint64(2))
        b = np.unique(np.concatenate([a[: size - size // 9], rng.integers(0, 1 << 63, size // 9, dtype=np.uint64)]))
        apart = len(np.setxor1d(a, b))
        x, y = (near_duplicates.sketch_words(s, 3, 64) for s in (a, b))
        assert (x != y).sum() <= apart
        p, q = (near_duplicates.parity_sketch(s).view(np.uint64) for s in (a, b))
        assert np.bitwise_count(p ^ q).sum() <= apart


def test_bands_join_all_similar_sizes():
    bands = near_duplicates.Bands()
    for a in range(1, 600):
        for b in range(a, a * 100 // 80 + 1):
            shared = set(bands.of(a)) & set(bands.of(b))
            own = int(np.searchsorted(bands.high, a))
            assert own in shared
            apart = (a + b) * 20 // 180
            assert bands.parts[own] > bands.distance[own] >= apart
            assert bands.reach(np.array([bands.step(a)]))[0] >= apart
            assert bands.reach(np.array([bands.step(b)]))[0] >= apart


def test_components(spark):
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 120, (90, 2))] + [(200 + i, 201 + i) for i in range(30)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    got = {r.node: r.label for r in components.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: root(x) for x in linked}


def test_words_of_sliced_arrays():
    import pyarrow as pa

    texts = pa.array(["skip me", "a b", None, "", "abéc d"])[1:]
    w: Words = words(texts)
    assert [bytes(w.data[s:e]).decode() for s, e in zip(w.starts, w.ends)] == ["a", "b", "abéc", "d"]
    assert w.first.tolist() == [0, 2, 2, 2, 4]


def test_small_tables(spark, same):
    docs, benchmark = read(spark, SMALL, "documents"), read(spark, SMALL, "benchmark")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    found = decontamination.digest(decontamination.find_items(docs, benchmark))
    same(found, brute.contamination(rows, [tuple(r) for r in benchmark.collect()]), *HITS)
    same(substring_dedup.digest(substring_dedup.remove_repeats(docs)), brute.repeats(rows), *KEPT)
    same(near_duplicates.near_duplicates(docs), brute.near(rows), *NEAR)
