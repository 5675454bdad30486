"""Operators 3, 4, 5, 6, 7, 8 and 10, and the pipeline."""

import math
import os
import random
import textwrap
import time
import zlib
from collections import Counter, defaultdict

import brute
import duckdb
import numpy as np
import pytest
from brute import SMALL
from compare import compare
from pyspark.sql import functions as F

import corpus_pipeline
from evenkeel.llm import catalog, licenses, line_dedup, packing, quality, secrets, sharding, toxicity
from evenkeel.llm._frames import read


@pytest.mark.parametrize("name", catalog.SQL)
def test_query_matches_sql(spark, name):
    assert compare(spark, SMALL, catalog.QUERIES[name], catalog.SQL[name]) is None


@pytest.mark.parametrize("name", catalog.QUERIES)
def test_queries_have_rows(spark, name):
    got = catalog.QUERIES[name](spark, SMALL)
    assert got.count() >= (100 if name == "pipeline" else 200)


@pytest.mark.parametrize("digest, sql", [(quality.digest, quality.SQL), (licenses.digest, licenses.SQL)])
def test_messy_rows_match_sql(docs, rows_in, digest, sql, same, tmp_path):
    """Ids are made distinct here, as the SQL tells rows by id."""
    import pandas as pd

    frame = pd.DataFrame([(i, r[1], r[3]) for i, r in enumerate(rows_in)], columns=["doc_id", "text", "source"])
    extra = " Licensed under CC BY-NC 4.0. All rights reserved.\nReleased under the MIT License."
    frame.loc[5, "text"] = (frame.loc[5, "text"] or "") + extra
    db = duckdb.connect()
    db.register("documents", frame)
    result = db.sql(sql)
    spark_frame = docs.sparkSession.createDataFrame(
        [(i, None if t is None or t != t else t, s) for i, t, s in frame.itertuples(index=False)],
        "doc_id long, text string, source string",
    )
    same(digest(spark_frame), result.fetchall(), *result.columns)


def test_line_dedup_on_messy_rows(spark, same):
    import pandas as pd

    rng = random.Random(4)
    menu = ["home | about | contact", "all rights reserved", "- -"]
    rows = []
    for i in range(120):
        own = [f"line {rng.randrange(10**6)} of document {i}" for _ in range(rng.randint(0, 6))]
        lines = own + rng.sample(menu, rng.randint(0, 3)) + ["", "  "][: i % 3]
        rng.shuffle(lines)
        rows.append((i, "\n".join(lines), f"site{i % 14}" if i % 9 else None))
    rows += [(200, None, "site1"), (201, "", None), (202, "home | about | contact", "site2")]
    db = duckdb.connect()
    db.register("documents", pd.DataFrame(rows, columns=["doc_id", "text", "source"]).astype(object))
    result = db.sql(line_dedup.SQL)
    expected = result.fetchall()
    assert sum(r[result.columns.index("n_removed")] > 0 for r in expected) > 20
    same(line_dedup.digest(spark.createDataFrame(rows, "doc_id long, text string, source string")), expected, *result.columns)


def test_line_dedup_keeps_columns_and_copies(docs, rows_in):
    cleaned = line_dedup.remove_boilerplate(docs)
    assert cleaned.columns[: len(docs.columns)] == docs.columns
    assert cleaned.count() == len(rows_in)


def test_line_dedup_cleans_short_pages_and_keeps_copies(spark):
    """Pages that are mostly boilerplate lose it, in the operator and the stage; documents without an own line stay."""
    menu = [f"home | about | contact | section {k} of the site" for k in range(6)]
    rows = [(i, "\n".join([*menu[: i % 7], f"own {i}", "All rights reserved."]), f"site{i % 12}") for i in range(84)]
    rows += [(100 + i, "a copied text\nof two lines", f"site{i}") for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    cleaned = {r.doc_id: r for r in line_dedup.remove_boilerplate(docs).collect()}
    assert all(cleaned[i].text == f"own {i}" and cleaned[i].n_removed == i % 7 + 1 for i in range(84))
    assert all(cleaned[100 + i].text == "a copied text\nof two lines" and cleaned[100 + i].n_removed == 0 for i in range(12))
    stage = {r.doc_id: r.text for r in corpus_pipeline.line_dedup_stage(spark, docs, SMALL).collect()}
    assert stage == {i: r.text for i, r in cleaned.items()}


def test_quality_keeps_columns(docs, rows_in):
    assessed = quality.assess(docs)
    assert assessed.columns == [*docs.columns, "quality_"]
    kept = assessed.where("quality_.kept").count()
    assert 0 < kept < len(rows_in)


def test_sharding(docs, rows_in):
    places = sharding.digest(sharding.assign(docs)).collect()
    sizes = Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows_in)
    assert Counter((p.doc_id, p["size"], p.text_crc32) for p in places) == sizes
    slots = defaultdict(list)
    for p in places:
        slots[p.shard].append(p.slot)
    assert sorted(slots) == list(range(16))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    runs = sorted(((p.shard, p.slot), p.curve) for p in places)
    assert [c for _, c in runs] == sorted(c for _, c in runs)


def plain_curve(rows: list[tuple], bits: int) -> list[int]:
    """Curve indices of rows by quantiles counted over sorted values."""
    steps = []
    for values in zip(*rows):
        known = sorted(v for v in values if v is not None)
        count, upto, cuts = Counter(known), 0, []
        for v in sorted(count):
            before, upto = upto, upto + count[v]
            if (upto << bits) // len(known) > (before << bits) // len(known) and upto < len(known):
                cuts.append(v)
        steps.append([0 if v is None else ((sum(c < v for c in cuts) + 1) << bits) // (len(cuts) + 2) for v in values])
    return sharding.hilbert_index(np.array(steps).T, bits).tolist()


def test_curve_of_a_table(spark):
    rng = random.Random(12)
    rows = [
        (i, rng.choice([None, "de", "en", "é"]), rng.choice(["same", f"https://www.site{rng.randrange(40)}", f"u{i}"]),
         rng.choice([None, rng.randrange(50), rng.randrange(10**6)]), None)
        for i in range(500)
    ]
    df = spark.createDataFrame(rows, "id long, lang string, source string, n_chars long, nothing string").repartition(5)
    got = sharding.curve(df, ("lang", "source", "n_chars", "nothing"), bits=4)
    expected = plain_curve([r[1:4] + (None,) for r in rows], 4)
    assert dict(got.select("id", "curve").collect()) == dict(zip((r[0] for r in rows), expected))


def test_long_common_beginnings_are_told_apart(spark):
    """Sources that differ late only lie as those with short names do: a shard has a part of them."""
    shards = []
    for name in ("https://www.site{:02}.example.org", "{:02}"):
        rows = [(i, "t" * (i % 7 + 1), "en", name.format(i % 60), i % 7 + 1) for i in range(6000)]
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
        placed = sharding.assign(docs).join(docs.select("doc_id", "source"), "doc_id")
        counted = placed.groupBy("shard").agg(F.count_distinct("source").alias("n"))
        shards.append(sorted((r.shard, r.n) for r in counted.collect()))
    assert shards[0] == shards[1]
    assert len(shards[0]) == 16 and max(n for _, n in shards[0]) < 30


def test_shard_files(spark, tmp_path):
    docs = read(spark, SMALL, "documents")
    path = os.path.join(tmp_path, "shards")
    sharding.write_shards(docs, sharding.assign(docs), path)
    back = spark.read.parquet(path)
    assert back.count() == docs.count() and back.select("shard").distinct().count() == 16
    assert back.drop("shard").exceptAll(docs).count() == 0
    langs = back.groupBy("shard").agg(F.count_distinct("lang").alias("n")).agg(F.avg("n")).first()[0]
    assert langs < docs.select("lang").distinct().count()


@pytest.mark.parametrize("axes, bits", [(2, 4), (3, 3), (4, 2)])
def test_hilbert_curve(axes, bits):
    points = np.stack(np.meshgrid(*[np.arange(1 << bits)] * axes, indexing="ij"), -1).reshape(-1, axes)
    index = sharding.hilbert_index(points, bits)
    order = np.argsort(index)
    assert sorted(index) == list(range(len(points)))
    assert (np.abs(np.diff(points[order], axis=0)).sum(axis=1) == 1).all()


def test_packing(docs, rows_in):
    ids = packing.TokenIds()
    texts = Counter()
    for doc, text, *_ in rows_in:
        tokens = np.append(ids.by_tokenizer(text or ""), 0).astype("<u4")
        first = len(tokens) % 2048 or 2048
        cuts = [0, *range(first, len(tokens) + 1, 2048)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            texts[(doc, k, a, b - a, zlib.crc32(tokens[a:b].tobytes()))] += 1
    packed = packing.pack(docs).collect()
    assert Counter((p.doc_id, p.piece, p.start, p.length, p.ids_crc32) for p in packed) == texts
    sequences = defaultdict(list)
    for p in packed:
        sequences[p.sequence_id].append((p.offset, p.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(sequences) <= -(-sum(p.length for p in packed) // 2048) + 1


@pytest.mark.parametrize("text", ["a" * 30_000, " " * 30_000, "x\n" * 9000, "<|endoftext|> a", "é" * 25_000, ""])
def test_token_ids_are_those_of_the_tokenizer(text):
    ids = packing.TokenIds()
    assert np.array_equal(ids(text), ids.by_tokenizer(text))


def test_secrets(spark, same):
    rng = random.Random(6)
    parts = ["Password = ", 'api_key:"', "apikey=", "TOKEN : '", "AKIA", "ſecret=abcdefghijklmnop", "é ", "\n", " bearer "]
    rows = []
    for i in range(200):
        text = "".join(
            rng.choice(parts) + "".join(rng.choices("abcdef0123456789XYZ", k=rng.randint(1, 30))) for _ in range(rng.randint(0, 8))
        )
        rows.append((i // 2, text, f"s{i % 5}"))
    rows += [(1, None, None), (None, "", "s1"), (3, "password=EXAMPLEEXAMPLE", None)]
    rows += [(500 + i, "password=EXAMPLEEXAMPLE", f"s{i}") for i in range(4)] + [(9, "token=onlymineonlymine", "s0")] * 2
    found = secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    got = secrets.digest(found)
    expected = brute.secrets([r[:2] for r in rows])
    assert sum(sum(r[1:4]) for r in expected) > 100
    same(got, expected, "doc_id", "n_assign", "n_access", "n_hex", "base_sha256")
    verdicts = {r.doc_id: (r.n_live, r.n_shared) for r in got.where("doc_id = 9 OR doc_id >= 500").collect() if r.doc_id != 9}
    assert set(verdicts.values()) == {(0, 1)}
    mine = [s for r in found.where("doc_id = 9").collect() for s in r.secrets if s.n_owners == 1 and s.kind == "assign"]
    assert [s.verdict for s in mine if s.end - s.start == 22] == ["live", "live"]


def plain_verdicts(rows: list[tuple]) -> list[tuple]:
    """(doc_id, kind, start, end, n_repositories, n_owners, verdict) of all kinds, by counting."""
    found, repositories, owners = [], defaultdict(set), defaultdict(set)
    unowned = defaultdict(set)
    with_owner = {str(doc) for doc, _, owner in rows if doc is not None and owner is not None}
    for doc, text, owner in rows:
        for kind, start, end, value in secrets.find_spans(text or "", secrets.compiled()):
            found.append((doc, kind, start, end, value))
            repositories[value].add(doc)
            owners[value].add(owner)
            unowned[value].add((doc, owner))
    out = []
    for doc, kind, start, end, value in found:
        n_repositories = len(repositories[value] - {None})
        n_owners = len(owners[value] - {None})
        owned = {d for d, o in unowned[value] if o is not None}
        loose = {d for d, o in unowned[value] if d not in owned}
        verdict = "shared" if n_owners > 2 or n_repositories > 50 else "unknown" if not n_owners or loose else "live"
        out.append((doc, kind, start, end, n_repositories, n_owners, verdict))
    return out


def test_secret_verdicts_by_both_counts(spark):
    rng = random.Random(16)
    values = [f"{'abcdef0123456789' * 2}{k:02}" for k in range(30)]
    rows = []
    for i in range(300):
        owner = rng.choice([None, "s0", "s1", "s2", "s3"]) if rng.random() < 0.5 else "s0"
        picked = [v for k, v in enumerate(values) if rng.random() < 0.3 ** (k % 6) and (k % 5 or owner in ("s0", "s1"))]
        rows.append((rng.choice([i, i // 2, None]), f"x bearer {'Z' * 22}{rng.randrange(9)} " + " ".join(picked), owner))
    rows += [(1000 + k, "token=half-owned-secret", "s1" if k % 2 else None) for k in range(40)]
    rows += [(2000 + k, "token=one-owner-in-many", "s1") for k in range(60)] + [(3000, "token=mine-and-only-mine", "s9")] * 3
    found = secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    got = Counter((r.doc_id, *s) for r in found.collect() for s in r.secrets)
    expected = plain_verdicts(rows)
    assert got == Counter(expected)
    assert Counter(r[-1] for r in expected).keys() == {"live", "shared", "unknown"}
    assert {r[-1] for r in expected if r[0] and 1000 <= r[0] < 2000} == {"unknown"}


def test_very_many_secrets_in_one_text(spark):
    rows = [(1, " ".join(f"{k:016x}" for k in range(200_000)), "a"), (2, f"{7:016x}", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    started = time.perf_counter()
    got = {r.doc_id: (r.n_hex, r.n_live) for r in secrets.digest(secrets.find_secrets(docs)).collect()}
    assert time.perf_counter() - started < 30
    assert got == {1: (200_000, 200_000), 2: (1, 1)}


def test_licence_rules(spark):
    long = " ".join(licenses.SENTENCES[k] + "." for k in (11, 12, 13, 14))
    rows = [(1, long), (2, " ".join(licenses.SENTENCES[k] + "." for k in (11, 12, 13))), (3, "Released under the mit licence."),
            (4, "x. Licensed under CC BY-NC 4.0.\ny"), (5, None), (5, None)]
    got = licenses.digest(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect()
    assert [(r.doc_id, r.licenses) for r in got] == [
        (1, "BSD-3-Clause"), (2, "BSD-2-Clause"), (3, ""), (4, "CC-BY-NC-4.0"), (5, ""), (5, ""),
    ]


@pytest.mark.parametrize("leader", ["", " * ", "# ", "// ", "    "])
def test_wrapped_licences(spark, leader):
    """Texts as they stand in files: wrapped, with comment leaders, list items and blank lines."""
    bsd = ["Copyright (c) 2020, A. Holder. All rights reserved.", licenses.SENTENCES[11]]
    bsd += [f"{k}. {licenses.SENTENCES[n]}." for k, n in enumerate((12, 13, 14), 1)]
    apache = [licenses.SENTENCES[5] + ". You may obtain a copy of the License at", "    http://www.apache.org/licenses/LICENSE-2.0",
              "Unless required by applicable law or agreed to in writing, software is distributed on an AS IS basis."]
    cases = {
        "MIT": ["The MIT License", licenses.SENTENCES[2], licenses.SENTENCES[3] + ".", 'THE SOFTWARE IS PROVIDED "AS IS".'],
        "BSD-3-Clause": bsd,
        "BSD-2-Clause": bsd[:-1],
        "GPL-3.0-or-later": [f"{licenses.SENTENCES[8]}.", f"{licenses.SENTENCES[9]}.  See the GNU General Public License for more."],
        "Apache-2.0": apache,
        "": ["Licensed under CC BY-NC. 4.0", "It was not released under the MIT License.", "Released under. The MIT License"],
    }
    rows = []
    for width in (50, 72, 80):
        for name, paragraphs in cases.items():
            lines = [x for p in paragraphs for x in [*textwrap.wrap(p, width, break_on_hyphens=False), ""]]
            rows.append((len(rows), "first line\n" + "".join(f"{leader}{x}\n" for x in lines) + "int main() {}", name))
    rows.append((len(rows), f"{leader}Licensed under the Apache License, Version 2.0\n{leader}and more", "Apache-2.0"))
    got = licenses.digest(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")).collect()
    assert {r.doc_id: r.licenses for r in got} == {r[0]: r[2] for r in rows}
    assert {(r.doc_id, r.n_sentences, r.licenses) for r in got} == set(licences_by_sql([r[:2] for r in rows]))


def licences_by_sql(rows):
    import pandas as pd

    db = duckdb.connect()
    db.register("documents", pd.DataFrame(rows, columns=["doc_id", "text"]).astype({"text": "object"}))
    return [tuple(r) for r in db.sql(licenses.SQL).fetchall()]


def test_every_licence_rule_on_wrapped_text(spark):
    """Each rule's sentences, in a file of their own, between other text."""
    rng = random.Random(3)
    rows, expected = [], {}
    for i, rule in enumerate(licenses.ALL_RULES):
        leader, width = rng.choice(["", " * ", "# ", "// ", "    "]), rng.choice([40, 60, 72, 80])
        paragraphs = ["Copyright 2020 A", *(licenses.ALL_SENTENCES[k] + "." for k in rule.sentences), "int main() {}"]
        lines = [x for p in paragraphs for x in [*textwrap.wrap(p, width, break_on_hyphens=False, break_long_words=False), ""]]
        rows.append((i, "".join(f"{leader}{x}\n" for x in lines)))
        expected[i] = (len(rule.sentences), rule.licence)
    got = {
        r.doc_id: (r.n_sentences, r.licenses)
        for r in licenses.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    }
    assert got == expected
    assert {k: (n, names) for k, n, names in licences_by_sql(rows)} == expected
    assert len({r.licence for r in licenses.ALL_RULES}) >= 40


def test_licence_sentences_against_every_run_of_words(spark):
    """Short sentences that overlap and hold each other, against all runs of words of random texts."""
    rng = random.Random(8)
    known = {1: "a b", 2: "a b c", 3: "b c", 4: "c a", 5: "a b c a", 6: "b"}
    gaps = [" ", " ", " ", "\n", "\n * ", ". ", ".", "!\n", "  ", ", ", "\n\n", "?\t", " .x "]
    rows = [(i, "".join(rng.choice("aAbBcC") + rng.choice(gaps) for _ in range(rng.randint(0, 30)))) for i in range(400)]
    rows += [(400, None), (401, ""), (402, " . "), (403, "a b\u00e9c"), (404, "\u212a a\nb c")]

    def plain(text):
        import re

        found, words, gap, at = [], [], [""], 0
        for m in re.finditer("[a-zA-Z0-9]+", text or ""):
            gap[-1] = text[at : m.start()]
            words.append(m.group().lower())
            gap.append("")
            at = m.end()
        n = len(words)
        mark = [re.search(r"[.!?][\x20\x09-\x0d]", g) is not None for g in gap]
        edge = [i in (0, n) or mark[i] or "\n" in gap[i] for i in range(n + 1)]
        contents = {v: k for k, v in known.items()}
        for i in range(n):
            for j in range(i + 1, n + 1):
                k = contents.get(" ".join(words[i:j]))
                if k and edge[i] and edge[j] and not any(mark[i + 1 : j]):
                    found.append((k, i, j))
        return [x for x in found if not any(y != x and y[1] <= x[1] and y[2] >= x[2] for y in found)]

    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    rules = (licenses.Rule("both", (2, 6)), licenses.Rule("one", (5,)))
    got = {r.doc_id: ([tuple(x) for x in r.found], r.licenses) for r in licenses.find_licenses(docs, known, rules).collect()}
    for i, text in rows:
        expected = plain(text)
        assert got[i] == (expected, licenses.match_rules([k for k, _, _ in expected], rules)), text
    assert sum(len(x) > 1 for x, _ in got.values()) > 100
    assert {n for _, names in got.values() for n in names} == {"both", "one"}


def test_licence_rules_take_longer_runs_out():
    rules = (licenses.Rule("short", (1,)), licenses.Rule("long", (1, 2)), licenses.Rule("short", (3,)))
    cases = {(1, 2): ["long"], (1, 2, 1): ["long", "short"], (2, 1): ["short"], (3, 1): ["short"], (): [], (1, 9, 2): ["short"]}
    assert {k: licenses.match_rules(k, rules) for k in cases} == cases


def test_very_long_texts(spark):
    """Texts of a few megabytes, with what is looked for at both ends."""
    menu = "home | about | contact"
    middle = "\n".join(f"line {k} of a very long text" for k in range(120_000))
    long = f"{menu}\nReleased under the MIT License.\n{middle}\nLicensed under CC BY-NC 4.0.\n{menu}"
    rows = [(0, long, "site0")] + [(k, f"{menu}\nown {k}", f"site{k}") for k in range(1, 12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    cleaned = line_dedup.remove_boilerplate(docs).where("doc_id = 0").first()
    assert cleaned.n_removed == 2 and cleaned.n_lines == 120_004
    assert cleaned.text == long.removeprefix(menu + "\n").removesuffix("\n" + menu)
    assert licenses.digest(docs).where("doc_id = 0").first().licenses == "MIT,CC-BY-NC-4.0"
    labels = spark.createDataFrame([(k, k % 2) for k in range(12)], "doc_id long, toxic int")
    scored = {r.doc_id: r.score for r in toxicity.digest(toxicity.score(docs, toxicity.fit(docs, labels))).collect()}
    assert len(scored) == 12 and all(0 <= x <= 1 for x in scored.values())


def test_maximal_segments_against_all_segments():
    rng = random.Random(7)

    def recursive(s, a, b):
        """The maximal segments by their definition: the best one, then those on either side of it."""
        best, span = 0, None
        for i in range(a, b):
            for j in range(i + 1, b + 1):
                total = sum(s[i:j])
                if total > best or (total == best and span and j - i < span[1] - span[0]):
                    best, span = total, (i, j)
        if span is None:
            return []
        i, j = span
        return recursive(s, a, i) + [(i, j)] + recursive(s, j, b)

    for _ in range(150):
        scores = [rng.choice([-3, -2, -1, 1, 2, 4]) + rng.random() / 97 for _ in range(rng.randint(0, 14))]
        got = toxicity.maximal_segments(np.array(scores, dtype=float))
        assert [(i, j) for i, j, _ in got] == recursive(scores, 0, len(scores))
        assert all(math.isclose(x, sum(scores[i:j]), abs_tol=1e-9) for i, j, x in got)


def test_toxicity_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = read(spark, folder, "documents"), read(spark, folder, "labels")
    own = labels.select("doc_id")
    docs = docs.join(own, "doc_id")  # labelled documents are enough for the test
    scored = toxicity.digest(toxicity.score(docs, toxicity.fit(docs, labels))).join(labels, "doc_id").where("held_out")
    rows = scored.collect()
    toxic = [r.predicted for r in rows if r.toxic == 1]
    harmless = [r.predicted for r in rows if r.toxic == 0]
    assert sum(toxic) >= 0.9 * len(toxic) and sum(harmless) <= 0.02 * len(harmless)


def test_maximal_segments_of_scattered_words_in_linear_time():
    scores = np.full(40 * 20_000, -0.1)
    scores[::40] = 3.0
    started = time.process_time()
    assert len(toxicity.maximal_segments(scores)) == 20_000
    assert time.process_time() - started < 5


@pytest.mark.parametrize("share, copied", [(0.4, False), (0.5, False), (0.5, True)])
def test_toxicity_with_many_toxic_labels(spark, share, copied):
    """Balanced labels, and a third of all rows as copies of one toxic text."""
    rng = random.Random(11)
    plain, telling = [f"plain{rng.randrange(10**6)}" for _ in range(2000)], [f"{c}{d}oxic" for c in "abcdefgh" for d in "vwxyz"]

    def text(toxic: bool) -> str:
        w = rng.choices(plain, k=80)
        return " ".join(w[:40] + (rng.choices(telling, k=6) if toxic else []) + w[40:])

    one, rows = text(True), []
    for i in range(900):
        copy = copied and i % 3 == 0
        toxic = copy or rng.random() < ((share - 1 / 3) * 1.5 if copied else share)
        rows.append((i, one if copy else text(toxic), int(toxic)))
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    scored = toxicity.digest(toxicity.score(table, toxicity.fit(table, table))).where("held_out").collect()
    right = {i: (kind, t == one) for i, t, kind in rows}
    for kind, copy in set(right.values()):
        flags = [r.predicted for r in scored if right[r.doc_id] == (kind, copy)]
        assert len(flags) > 20 and (sum(flags) >= 0.9 * len(flags) if kind else sum(flags) <= 0.02 * len(flags))


def test_toxicity_against_plain_definitions(spark):
    """Counts, log-odds, passages, calibration, choice of the setting and scores of 260 texts."""
    rng = random.Random(21)
    plain = ["".join(rng.choices("abcdefghé", k=rng.randint(2, 8))) for _ in range(300)]
    telling, weak = [f"{c}rotx{d}" for c in "pqrs" for d in "yz"], [f"weak{c}" for c in "abcdef"]

    def text(toxic):
        w = rng.choices(plain, k=rng.randint(10, 90))
        for _ in range(rng.randint(1, 5) if toxic else rng.random() < 0.05):
            w.insert(rng.randrange(len(w)), rng.choice(telling))
        for _ in range(rng.randint(0, 4 if toxic else 1)):
            w.insert(rng.randrange(len(w)), rng.choice(weak).upper())
        return " ".join(w)

    kinds = [int(rng.random() < 0.35) for _ in range(260)]
    rows = [(i, text(k)) for i, k in enumerate(kinds)] + [(260, None), (261, ""), (262, " - ")]
    labels = {i: k for i, k in enumerate(kinds) if i % 7} | {260: 0, 261: 1}
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    ids = docs.select("doc_id", (F.pmod(F.xxhash64(F.lit("judge"), "doc_id"), F.lit(4)) == 0).alias("judge")).collect()
    held = {i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0}

    def curve(x, y):
        a, b = toxicity._logistic(np.array(x), np.array(y, dtype=float), np.ones(len(x)))
        # The penalised, balanced likelihood is at rest there.
        p = 1 / (1 + np.exp(-(a * np.array(x) + b)))
        wide = np.where(np.array(y) == 1, 0.5 / sum(y), 0.5 / (len(y) - sum(y))) * (p - np.array(y))
        assert abs((wide * np.array(x)).sum() + 1e-3 * a) < 1e-5 and abs(wide.sum()) < 1e-5
        return a, b

    setting, expected = brute.toxicity(
        rows, labels, {r.doc_id for r in ids if r.judge}, held, toxicity.SETTINGS, toxicity.REACH, toxicity.BACKGROUND,
        toxicity.MIN_COUNT, toxicity.EXPECTED, curve,
    )
    model = toxicity.fit(docs, spark.createDataFrame(list(labels.items()), "doc_id long, toxic int"))
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    for i, (n_words, passages, evidence, score) in expected.items():
        r = got[i]
        assert (r.n_words, [(x.start, x.end) for x in r.passages]) == (n_words, passages), (i, setting)
        assert math.isclose(r.evidence, evidence, rel_tol=1e-6, abs_tol=1e-6) and math.isclose(r.score, score, abs_tol=1e-4)
    assert sum(bool(x[1]) for x in expected.values()) > 40


def test_toxicity_without_labels_and_on_messy_rows(spark, docs, no_docs, rows_in):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit(docs, none)
    scored = toxicity.digest(toxicity.score(docs, model)).collect()
    assert len(scored) == len(rows_in) and all(0 <= r.score < 0.5 for r in scored)
    assert toxicity.score(no_docs, toxicity.fit(no_docs, none)).count() == 0
    some = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    assert toxicity.digest(toxicity.score(docs, toxicity.fit(docs, some))).count() == len(rows_in)


@pytest.mark.parametrize(
    "operator",
    [quality.assess, line_dedup.remove_boilerplate, sharding.assign, packing.pack, secrets.find_secrets, licenses.digest],
)
def test_empty_tables(no_docs, operator):
    assert operator(no_docs).count() == 0


def test_repeated_and_null_rows_everywhere(docs, rows_in):
    for operator in (quality.digest, line_dedup.digest, licenses.digest, secrets.find_secrets):
        assert operator(docs).count() == len(rows_in), operator


def test_pipeline(spark):
    docs = read(spark, SMALL, "documents")
    kept = docs
    before = {r.doc_id: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, kept, SMALL)
        assert after.columns == docs.columns
        rows_before, rows = kept.collect(), after.collect()
        ids, ids_before = {r.doc_id for r in rows}, {r.doc_id for r in rows_before}
        assert ids <= ids_before and len(rows) == len(ids)
        pairs = [(r.doc_id, r.text) for r in rows_before]
        if name == "quality rules":
            verdicts = {r.doc_id: r.kept for r in quality.digest(kept).collect()}
            assert ids == {d for d in ids_before if verdicts[d]}
        elif name == "line dedup":
            assert ids == ids_before and all(r.n_chars == len(r.text) for r in rows)
        elif name == "n-gram Jaccard join":
            groups = {d: c for d, _, c in brute.near(pairs)}
            assert Counter(groups[d] for d in ids) == Counter(set(groups.values()))
        else:
            items = [tuple(r) for r in read(spark, SMALL, "benchmark").select("item_id", "text").collect()]
            assert ids == {r[0] for r in brute.contamination(pairs, items) if not r[-1]}
        kept = after.cache()
    packed = corpus_pipeline.run(spark, SMALL)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == {r.doc_id for r in kept.collect()}
    assert set(before) > {r.doc_id for r in kept.collect()}


def test_pipeline_stages_on_messy_rows(spark, docs, no_docs):
    for start in (docs, no_docs):
        kept = start
        for _, stage in corpus_pipeline.STAGES[:-1]:
            kept = stage(spark, kept, SMALL)
            assert kept.columns == docs.columns
        corpus_pipeline.STAGES[-1][1](spark, kept, SMALL).count()
