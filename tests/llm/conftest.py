import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    # Names that operators use themselves.
    "key long, part int, quality string, n_words long, hits string, label long, size long, shard int, piece int"
)


def make_docs(seed: int = 1) -> list[tuple]:
    """Nulls, empty and long texts, repeated rows and ids, exact and near copies, shared passages."""
    rng = random.Random(seed)
    vocabulary = ["the", "of", "and", "to"] + ["".join(rng.choices("abcdeélm", k=rng.randint(2, 7))) for _ in range(400)]

    def text(n: int) -> str:
        words = rng.choices(vocabulary, k=n)
        return " ".join(w + rng.choice(["", "", "", ",", ".\n"]) for w in words)

    base = [text(rng.randint(3, 160)) for _ in range(40)]
    passage = text(60)
    texts = base + [t for t in base[:8] for _ in range(3)]
    for t in base[8:20]:
        for edits in (1, 3, 8):
            w = t.split(" ")
            for _ in range(edits):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            texts.append(" ".join(w))
    texts += [f"{text(20)} {passage} {text(25)}" for _ in range(12)]
    texts += [None, "", " \t\n", "one", "One two", "one two", "a b c d", "the the " * 60, text(20_000), passage * 2]
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, base[9]), (None, None), (None, None), (5, base[20]), (7, base[21])]
    rng.shuffle(rows)
    out = []
    for i, (doc, t) in enumerate(rows):
        site = None if i % 17 == 0 else f"s{i % 13}"
        out.append((doc, t, ["en", "de", None][i % 3], site, None if t is None else len(t), 1, 2, "q", 3, "h", 4, 5, 6, 7))
    return out


@pytest.fixture(scope="session")
def rows_in():
    return make_docs()


@pytest.fixture(scope="session")
def docs(spark, rows_in):
    return spark.createDataFrame(rows_in, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def pairs(rows_in):
    return [(r[0], r[1]) for r in rows_in]


@pytest.fixture
def same():
    from collections import Counter

    def check(df, expected, *columns):
        got = Counter(tuple(r) for r in df.select(*columns).collect())
        assert got == Counter(expected)

    return check
