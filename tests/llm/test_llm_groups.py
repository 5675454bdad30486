"""Operators 11 to 13 against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
import xxhash
from brute import NOT_BLANK, lower, sha
from pyspark.sql import functions as F

from evenkeel.llm import _golay, _recompression, _tries, periodic_runs, simhash, spelling_variants


def least_ids(ids: list, near) -> list:
    """Smallest id (null last) that each row reaches over near rows."""
    parent = list(range(len(ids)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in combinations(range(len(ids)), 2):
        if near(i, j):
            parent[root(i)] = root(j)
    least = {}
    for i, x in enumerate(ids):
        known = least.get(root(i))
        least[root(i)] = x if known is None else known if x is None else min(known, x)
    return [least[root(i)] for i in range(len(ids))]


# 11 --------------------------------------------------------------------------------------------------


def plain_fingerprint(text: str | None) -> int:
    words = NOT_BLANK.findall(lower(text))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[k : k + 3]), 42) for k in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_golay_code_is_perfect_and_near_vectors_meet():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 1 << 23, 3000)
    found = _golay.codewords(x)
    remainder = _golay._tables()[0]
    words = (np.arange(4096) << 11) ^ remainder
    away = np.bitwise_count(x[:, None] ^ words[None, :])
    assert (away.argmin(axis=1) == found[:, 0]).all() and away.min(axis=1).max() == 3
    for row, codes, own in zip(away, found, away.min(axis=1)):
        assert sorted(codes[codes >= 0]) == sorted([codes[0], *np.flatnonzero(row == 4)] if own == 3 else [codes[0]])
    for bits in (1, 2):
        for _ in range(40):
            y = x.copy()
            for k in range(bits):
                y ^= 1 << rng.integers(0, 23, len(x))
            other = _golay.codewords(y)
            assert all(set(a[a >= 0]) & set(b[b >= 0]) for a, b in zip(found, other))


def test_linked_fingerprints_share_a_key():
    rng = np.random.default_rng(5)
    x = rng.integers(0, 1 << 64, 4000, dtype=np.uint64)
    y = x.copy()
    for k in range(3):
        y ^= np.where(rng.random(len(x)) < 0.8, np.uint64(1) << rng.integers(0, 64, len(x), dtype=np.uint64), np.uint64(0))
    of = []
    for fps in (x, y):
        keys = defaultdict(set)
        for key, row in zip(*simhash.keys(fps)):
            keys[int(row)].add(int(key))
        of.append(keys)
    assert all(of[0][i] & of[1][i] for i in range(len(x)))
    assert sum(map(len, of[0].values())) / len(x) < 60


@pytest.mark.parametrize("spread", [6, 12, 64])
def test_links_within_a_large_group(spread):
    """Groups beyond the directly compared size give the same components."""
    rng = np.random.default_rng(spread)
    fps = np.unique(rng.integers(0, 1 << 64, 1, dtype=np.uint64) ^ rng.integers(0, 1 << min(spread, 63), 2500, dtype=np.uint64))
    a, b = simhash.group_links(np.zeros(len(fps), dtype=np.uint64), fps)
    linked = {int(f): int(f) for f in fps}
    linked |= dict(zip(a.tolist(), b.tolist()))
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3
    i, j = simhash.forest(fps[np.nonzero(near)[0]], fps[np.nonzero(near)[1]])
    assert linked == {int(f): int(f) for f in fps} | dict(zip(i.tolist(), j.tolist()))


def test_simhash_on_messy_rows(docs, pairs, same):
    fps = [plain_fingerprint(t) for _, t in pairs]
    least = least_ids([d for d, _ in pairs], lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 3)
    expected = [(d, f"{fp:016x}", c) for (d, _), fp, c in zip(pairs, fps, least)]
    same(simhash.digest(simhash.near_duplicates(docs)), expected, "doc_id", "fingerprint", "component_id")


def test_simhash_of_no_rows(no_docs):
    assert simhash.near_duplicates(no_docs).count() == 0


def test_hot_keys_are_cut_before_the_shuffle(spark):
    rng = np.random.default_rng(8)
    fps = np.unique(np.uint64(0xABCDEF0123456789) ^ rng.integers(0, 1 << 20, 400, dtype=np.uint64))
    links = simhash.near_links(spark.createDataFrame([(int(f),) for f in fps.view(np.int64)], "fp long"), max_group=50)
    a, b = (np.array([r[k] for r in links.collect()], dtype=np.int64).view(np.uint64) for k in (0, 1))
    near = np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3)
    assert [x.tolist() for x in simhash.forest(a, b)] == [x.tolist() for x in simhash.forest(fps[near[0]], fps[near[1]])]
    assert np.bitwise_count(a ^ b).max() > 3 or len(a)


# 12 --------------------------------------------------------------------------------------------------


def plain_counts(pairs, slips: bool) -> Counter:
    total = Counter()
    for doc, text in pairs:
        for word in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = lower(word)
            h = zlib.crc32(f"{'' if doc is None else doc}:{word}".encode())
            if slips and h % 199 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            total[word] += 1
    return Counter({w: n for w, n in total.items() if len(w) >= 6 and n >= 5})


def is_near(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(counts: dict) -> list[tuple]:
    near = defaultdict(list)
    for a, b in combinations(counts, 2):
        if is_near(a, b):
            near[a].append(b)
            near[b].append(a)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-counts[x], x))
        if counts[best] >= 5 * counts[w]:
            form[w] = best
    out = []
    for w in counts:
        root = w
        while root in form:
            root = form[root]
        f = form.get(w)
        out.append((w, f, root, counts[w], len(near[w]), counts[f] if f else None))
    return out


COLUMNS = ("word", "form", "root", "n", "n_near", "form_n")


@pytest.mark.parametrize("range_words", [7, 100_000])
def test_variants(spark, same, range_words):
    rng = random.Random(range_words)
    counts = {}
    for _ in range(60):
        word = "".join(rng.choices("abé", k=rng.randint(6, 9)))
        counts[word] = n = rng.choice([5, 5, 30, 400, 9000])
        for _ in range(4):
            k = rng.randrange(len(word))
            word = word[:k] + rng.choice(["", "a", "ÿ", word[k] * 2]) + word[k + rng.randint(0, 1) :]
            n = max(5, n // rng.choice([1, 5, 6]))
            counts.setdefault(word, n)
    counts |= {"x" * 4000: 5, "x" * 4001: 30, "x" * 2000 + "y" + "x" * 2000: 6}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    expected = plain_variants(counts)
    assert sum(r[1] is not None and r[2] != r[1] for r in expected) > 5
    same(spelling_variants.variants(words, range_words=range_words), expected, *COLUMNS)


@pytest.mark.parametrize("slips", [True, False])
def test_variants_of_messy_rows(spark, same, slips, docs):
    rng = random.Random(2)
    vocabulary = ["Straße", "straßen", "Küchen", "kuchen", "küchen", "letters", "lettres", "a×b÷ca", "ÀLLER", "aller", "counts", "count"]
    rows = [(rng.randrange(40), " ".join(rng.choices(vocabulary, k=rng.randint(0, 60)))) for _ in range(150)]
    rows += [(None, "letters " * 9), (1, None), (2, ""), (3, "12 34"), (4, "letters-" * 9), (5, "w" * 3_000_000)]
    frame = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id long, text string, word int, n int")
    got = spelling_variants.variants(spelling_variants.word_counts(frame, slips=slips))
    same(got, plain_variants(plain_counts(rows, slips)), *COLUMNS)


def test_variants_of_no_words(no_docs):
    assert spelling_variants.variants(spelling_variants.word_counts(no_docs)).count() == 0


def test_tries_number_beginnings_alike(spark):
    rng = random.Random(9)
    words = sorted({"".join(rng.choices("ab", k=rng.randint(1, 12))) for _ in range(500)})
    frame = spark.createDataFrame([(w,) for w in words], "word string")
    cuts = sorted({rng.choice(words)[: rng.randint(1, 6)] for _ in range(9)})
    numbers, ids = {}, []
    for r in _tries.numbered(frame, cuts).collect():
        ids.append((r.id, r.word))
        for k, node in enumerate(r.nodes):
            assert numbers.setdefault(r.word[:k], node) == node
    assert len(set(numbers.values())) == len(numbers)
    assert [w for _, w in sorted(ids)] == words


# 13 --------------------------------------------------------------------------------------------------


def plain_runs(words: list) -> list[tuple[int, int, int]]:
    """(start, length, period): every stretch with a period is walked over."""
    least: dict = {}
    for q in range(1, len(words) // 3 + 1):
        i = 0
        while i + q < len(words):
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i - start + q >= max(24, 3 * q):
                least.setdefault((start, i + q), q)
            i += 1
    return sorted((s, e - s, q) for (s, e), q in least.items())


def plain_periodic(doc, words: list) -> list:
    h = zlib.crc32(str(doc).encode()) if doc is not None else 1
    if h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def plain_digest(doc, text) -> tuple:
    words = plain_periodic(doc, NOT_BLANK.findall(text or ""))
    runs = plain_runs(words)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    tail = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    return (doc, len(runs), *tail, sha(lines), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


RUN_COLUMNS = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def periodic_rows(rng, count: int) -> list[tuple]:
    rows = []
    for i in range(count):
        letters = rng.choice([1, 2, 3, 40])
        words = [f"w{rng.randrange(letters)}" for _ in range(rng.randint(0, 90))]
        for _ in range(rng.randint(0, 3)):
            unit = [f"w{rng.randrange(letters)}" for _ in range(rng.randint(1, 12))]
            at = rng.randint(0, len(words))
            words[at:at] = (unit * 14)[: rng.randint(20, 60)]
        rows.append((i, rng.choice([" ", "\n", "  \t"]).join(words)))
    return rows


def test_runs_against_brute_force(spark, same):
    rows = periodic_rows(random.Random(3), 400) + [(None, "a " * 30), (1, None), (2, ""), (2, ""), (7, "one two"), (7, "é " * 24)]
    expected = [plain_digest(*r) for r in rows]
    assert sum(r[1] > 0 for r in expected) > 150 and sum(r[1] > 2 for r in expected) > 10
    frame = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id long, text string, runs int, start int")
    same(periodic_runs.digest(periodic_runs.find_runs(periodic_runs.periodic_texts(frame))), expected, *RUN_COLUMNS)


def test_runs_on_messy_rows(docs, pairs, same):
    same(periodic_runs.digest(periodic_runs.find_runs(periodic_runs.periodic_texts(docs))),
         [plain_digest(d, t if len(t or "") < 50_000 else t) for d, t in pairs if len(t or "") < 50_000]
         + [long_digest(d, t) for d, t in pairs if len(t or "") >= 50_000], *RUN_COLUMNS)


def long_digest(doc, text) -> tuple:
    """A random text of 20,000 words, too long for the walk over all periods, has no run if its id plants none."""
    words = NOT_BLANK.findall(text)
    assert zlib.crc32(str(doc).encode()) % 10
    return (doc, 0, None, None, None, None, sha(""), sha(" ".join(words)))


def test_runs_of_very_long_texts(spark):
    rows = [(1, "a b c " * 200_000 + "x"), (2, "z " * 300_000), (3, " ".join(map(str, range(300_000))))]
    got = {r.doc_id: r for r in periodic_runs.find_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [tuple(map(tuple, got[i].runs)) for i in (1, 2, 3)] == [((0, 600_000, 3),), ((0, 300_000, 1),), ()]
    assert (got[1].collapsed, got[2].collapsed, got[3].n_words) == ("a b c x", "z", 300_000)


def test_runs_of_no_rows(no_docs):
    assert periodic_runs.find_runs(no_docs).count() == 0


@pytest.mark.parametrize("letters", [1, 2, 5])
def test_extensions(letters):
    rng = np.random.default_rng(letters)
    words = rng.integers(0, letters, 700)
    words[300:500] = words[:200]
    symbols = np.concatenate([[1000], words, [1001]])
    levels = _recompression.grammar(symbols)
    back = _recompression.mirrored(levels)
    x, y = rng.integers(1, 701, (2, 3000))
    x, y = np.minimum(x, y)[x != y], np.maximum(x, y)[x != y]

    def plain(i, j, step):
        n = 0
        while symbols[i] == symbols[j]:
            n, i, j = n + 1, i + step, j + step
        return n

    assert _recompression.extensions(levels, x, y).tolist() == [plain(i, j, 1) for i, j in zip(x, y)]
    last = len(symbols) - 1
    assert _recompression.extensions(back, last - x, last - y).tolist() == [plain(i, j, -1) for i, j in zip(x, y)]
