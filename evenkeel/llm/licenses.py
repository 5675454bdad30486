"""License scan by sentence rules.

Texts are cut into words (runs of ASCII letters and digits, A-Z in lower case). Known sentences are a table
by the hash of their words. A sentence may stand on one line or be wrapped over several, with comment
leaders before each and blank lines between: every run of words from the beginning of a line or sentence
to the end of one is looked up, if its first words begin any known sentence. A known sentence inside a
longer one does not count. The identifiers of a text, in order, are matched against rules: a rule is an
ordered run of identifiers that must follow each other, with nothing known in between. Longer rules come
first and a rule inside a matched longer one does not count by itself.

Each text is scanned where it is, so nothing is shuffled. The look-up takes one hash for each beginning of a
line or sentence, and one for each length of known sentences where that is found, so that tables of
thousands of sentences cost little more. A null or empty text has no sentences. Repeated rows are matched
each. A very long text is a chunk of its own. Of rules with equally many sentences the earlier one comes
first. An empty table gives no rows. Only the id and the text are read, so clashing names do no harm.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenkeel.llm._frames import map_arrow
from evenkeel.llm._text import Words, byte_table, chunks, range_hashes, to_batch, word_hashes, words

_MIT_RIGHTS = (
    "without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, "
    "sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"
)
_ANY_PERSON = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    'documentation files (the "Software"), '
)
_FREE = "is free software{} you can redistribute it and/or modify it under the terms of the"
_LATER = "as published by the Free Software Foundation{} either version {} of the License, or (at your option) any later version"

# Sentences of public licences and notices, each with its identifier.
SENTENCES = {
    1: "Released under the MIT License",
    2: f"{_ANY_PERSON}to deal in the Software {_MIT_RIGHTS}, subject to the following conditions:",
    3: "The above copyright notice and this permission notice shall be included in all copies or substantial "
    "portions of the Software",
    4: "Licensed under the Apache License, Version 2.0",
    5: 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in '
    "compliance with the License",
    6: "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    7: "This work is licensed under the GNU General Public License, version 3",
    8: f"This program {_FREE.format(':')} GNU General Public License {_LATER.format(',', '3')}",
    9: "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even "
    "the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    10: "Licensed under CC BY-NC 4.0",
    11: "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
    "that the following conditions are met:",
    12: "Redistributions of source code must retain the above copyright notice, this list of conditions and the "
    "following disclaimer",
    13: "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
    "the following disclaimer in the documentation and/or other materials provided with the distribution",
    14: "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
    "promote products derived from this software without specific prior written permission",
    15: "All rights reserved",
    16: "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
    "hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    17: "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
    "hereby granted",
    18: "This is free and unencumbered software released into the public domain",
    19: "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source "
    "code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means",
    20: "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software "
    'and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, '
    "execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties "
    "to whom the Software is furnished to do so, all subject to the following:",
    21: "Distributed under the Boost Software License, Version 1.0",
    22: "This Source Code Form is subject to the terms of the Mozilla Public License, v",
    23: "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/",
    24: "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/",
    25: 'The contents of this file are subject to the Mozilla Public License Version 1.1 (the "License"); you may not '
    "use this file except in compliance with the License",
    26: f"This library {_FREE.format(';')} GNU Lesser General Public License {_LATER.format(';', '2.1')}",
    27: f"This library {_FREE.format(';')} GNU Library General Public License {_LATER.format(';', '2')}",
    28: f"This program {_FREE.format(':')} GNU Lesser General Public License {_LATER.format(',', '3')}",
    29: f"This library {_FREE.format(':')} GNU Lesser General Public License {_LATER.format(',', '3')}",
    30: f"This program {_FREE.format(';')} GNU General Public License {_LATER.format(';', '2')}",
    31: f"This program {_FREE.format(';')} GNU General Public License version 2 as published by the Free Software "
    "Foundation",
    32: f"This program {_FREE.format(':')} GNU Affero General Public License {_LATER.format(',', '3')}",
    33: f"This program {_FREE.format(':')} Server Side Public License, version 1, as published by MongoDB, Inc",
    34: f"This program {_FREE.format(';').removesuffix(' the')} the same terms as Perl itself",
    35: "This program and the accompanying materials are made available under the terms of the Eclipse Public License "
    "v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html",
    36: "This program and the accompanying materials are made available under the terms of the Eclipse Public License "
    "2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    37: "The contents of this file are subject to the terms of the Common Development and Distribution License (the "
    '"License")',
    38: "Permission is granted to anyone to use this software for any purpose, including commercial applications, and "
    "to alter it and redistribute it freely, subject to the following restrictions:",
    39: "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and "
    "changing it is allowed as long as the name is changed",
    40: "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring "
    "rights to this software to the public domain worldwide",
    41: "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without "
    "fee, and without a written agreement is hereby granted, provided that the above copyright notice and this "
    "paragraph and the following two paragraphs appear in all copies",
    42: "Permission to use, copy, modify, and distribute this software and its documentation for any purpose and "
    "without fee is hereby granted, provided that the above copyright notice appear in all copies and that both that "
    "copyright notice and this permission notice appear in supporting documentation",
    43: "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby "
    "granted, provided that the above copyright notice and this permission notice appear in all copies",
    44: "Except as contained in this notice, the name of a copyright holder shall not be used in advertising or "
    "otherwise to promote the sale, use or other dealings in this Software without prior written authorization of "
    "the copyright holder",
    45: "Except as contained in this notice, the name of the X Consortium shall not be used in advertising or "
    "otherwise to promote the sale, use or other dealings in this Software without prior written authorization from "
    "the X Consortium",
    46: "All advertising materials mentioning features or use of this software must display the following "
    "acknowledgement:",
    47: 'Licensed under the Apache License 2.0 (the "License")',
    48: "This Font Software is licensed under the SIL Open Font License, Version 1.1",
    49: "Licensed under the EUPL, Version 1.2",
    50: "Licensed under the Educational Community License, Version 2.0",
    51: "Licensed under the Academic Free License version 3.0",
    52: "Licensed under the Open Software License version 3.0",
    53: "Licensed under the Universal Permissive License v 1.0 as shown at https://oss.oracle.com/licenses/upl",
    54: "This software is governed by the CeCILL license under French law and abiding by the rules of distribution of "
    "free software",
    55: "This software is governed by the CeCILL-B license under French law and abiding by the rules of distribution "
    "of free software",
    56: "This software is governed by the CeCILL-C license under French law and abiding by the rules of distribution "
    "of free software",
    57: "As long as you retain this notice you can do whatever you want with this stuff",
    58: "The Software shall be used for Good, not Evil",
    59: f"{_ANY_PERSON}to deal in the Software {_MIT_RIGHTS}",
    60: f"{_ANY_PERSON}to deal with the Software {_MIT_RIGHTS}, subject to the following conditions:",
    61: "Use of this software is governed by the Business Source License included in the LICENSE file",
    62: "This database is made available under the Open Database License: http://opendatacommons.org/licenses/odbl/1.0/",
    63: "This data is made available under the Public Domain Dedication and License v1.0 whose full text can be found "
    "at: http://opendatacommons.org/licenses/pddl/1.0/",
    64: "Use of this source code is governed by an MIT-style license that can be found in the LICENSE file",
    65: "Licensed under the MIT License",
    66: "This work is licensed under the GNU Free Documentation License, Version 1.3",
    67: "This file is licensed to you under the Artistic License 2.0",
}


@dataclass(frozen=True)
class Rule:
    licence: str
    sentences: tuple[int, ...]


# Which runs of sentences stand for which licence.
RULES = (
    Rule("BSD-3-Clause", (11, 12, 13, 14)),
    Rule("BSD-4-Clause", (11, 12, 13, 46)),
    Rule("BSD-2-Clause", (11, 12, 13)),
    Rule("JSON", (2, 3, 58)),
    Rule("X11", (2, 3, 45)),
    Rule("MIT", (2, 3)),
    Rule("GPL-3.0-or-later", (8, 9)),
    Rule("GPL-2.0-or-later", (30, 9)),
    Rule("GPL-2.0-only", (31, 9)),
    Rule("AGPL-3.0-or-later", (32, 9)),
    Rule("LGPL-3.0-or-later", (28, 9)),
    Rule("Apache-2.0", (5, 6)),
    Rule("MPL-2.0", (22, 23)),
    Rule("MPL-2.0", (22, 24)),
    Rule("Unlicense", (18, 19)),
    Rule("curl", (43, 44)),
    Rule("MIT", (1,)),
    Rule("Apache-2.0", (4,)),
    Rule("GPL-3.0", (7,)),
    Rule("CC-BY-NC-4.0", (10,)),
    Rule("ISC", (16,)),
    Rule("0BSD", (17,)),
    Rule("Unlicense", (18,)),
    Rule("BSL-1.0", (20,)),
    Rule("BSL-1.0", (21,)),
    Rule("MPL-1.1", (25,)),
    Rule("LGPL-2.1-or-later", (26,)),
    Rule("LGPL-2.0-or-later", (27,)),
    Rule("LGPL-3.0-or-later", (29,)),
    Rule("SSPL-1.0", (33,)),
    Rule("Artistic-1.0-Perl OR GPL-1.0-or-later", (34,)),
    Rule("EPL-1.0", (35,)),
    Rule("EPL-2.0", (36,)),
    Rule("CDDL-1.0", (37,)),
    Rule("Zlib", (38,)),
    Rule("WTFPL", (39,)),
    Rule("CC0-1.0", (40,)),
    Rule("PostgreSQL", (41,)),
    Rule("HPND", (42,)),
    Rule("ISC", (43,)),
    Rule("Apache-2.0", (47,)),
    Rule("OFL-1.1", (48,)),
    Rule("EUPL-1.2", (49,)),
    Rule("ECL-2.0", (50,)),
    Rule("AFL-3.0", (51,)),
    Rule("OSL-3.0", (52,)),
    Rule("UPL-1.0", (53,)),
    Rule("CECILL-2.1", (54,)),
    Rule("CECILL-B", (55,)),
    Rule("CECILL-C", (56,)),
    Rule("Beerware", (57,)),
    Rule("MIT-0", (59,)),
    Rule("NCSA", (60,)),
    Rule("BUSL-1.1", (61,)),
    Rule("ODbL-1.0", (62,)),
    Rule("PDDL-1.0", (63,)),
    Rule("MIT", (64,)),
    Rule("MIT", (65,)),
    Rule("GFDL-1.3", (66,)),
    Rule("Artistic-2.0", (67,)),
)

# The Creative Commons licences, from which their notices are made.
_COMMONS = {
    "CC-BY": "Attribution",
    "CC-BY-SA": "Attribution-ShareAlike",
    "CC-BY-ND": "Attribution-NoDerivatives",
    "CC-BY-NC": "Attribution-NonCommercial",
    "CC-BY-NC-SA": "Attribution-NonCommercial-ShareAlike",
    "CC-BY-NC-ND": "Attribution-NonCommercial-NoDerivatives",
}
_COMMONS_VERSIONS = {"3.0": "Unported", "4.0": "International"}


def _with_notices() -> tuple[dict[int, str], tuple[Rule, ...]]:
    """Sentences and rules with the notices that follow from a licence's name."""
    notices = [
        (f"{short}-{version}", f"This work is licensed under a Creative Commons {name} {version} {where} License")
        for short, name in _COMMONS.items()
        for version, where in _COMMONS_VERSIONS.items()
    ]
    names = dict.fromkeys([*(r.licence for r in RULES), *(licence for licence, _ in notices)])
    notices += [(licence, f"SPDX-License-Identifier: {licence}") for licence in names]
    numbered = list(enumerate(notices, max(SENTENCES) + 1))
    sentences = SENTENCES | {k: sentence for k, (_, sentence) in numbered}
    return sentences, RULES + tuple(Rule(licence, (k,)) for k, (licence, _) in numbered)


ALL_SENTENCES, ALL_RULES = _with_notices()

# A sentence ends at a mark before white space; it may begin and end at a line's end.
_INSIDE = byte_table((0x30, 0x39), (0x61, 0x7A))
_MARK = byte_table((0x21, 0x21), (0x2E, 0x2E), (0x3F, 0x3F))
_BLANK = byte_table((0x09, 0x0D), (0x20, 0x20))


def content(sentence: str) -> str:
    """The words of a sentence."""
    return " ".join(re.findall("[a-z0-9]+", sentence.lower()))


class Known:
    """The hashed table of known sentences."""

    def __init__(self, sentences: Mapping[int, str]) -> None:
        w = words(pa.array([content(x) for x in sentences.values()], pa.string()), _INSIDE)
        hashes, begins, ends = word_hashes(w), w.first[:-1], w.first[1:]
        whole = range_hashes(hashes, begins, ends)
        if len(np.unique(whole)) < len(whole) or (ends == begins).any():
            raise ValueError("a known sentence is empty or there twice")
        order = np.argsort(whole)
        self.hashes, self.ids = whole[order], np.array(list(sentences), dtype=np.int64)[order]
        self.lengths = np.unique(ends - begins)
        self.shortest = int(self.lengths[0]) if len(self.lengths) else 0
        self.beginnings = np.unique(range_hashes(hashes, begins, begins + self.shortest))


def _is_in(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    return table[np.minimum(np.searchsorted(table, values), len(table) - 1)] == values


def _breaks(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Whether a sentence ends before each word (and past the last), and how many marks stand before it."""

    def between(places: np.ndarray) -> np.ndarray:
        before = np.concatenate([[0], w.ends])
        after = np.append(w.starts, len(w.data))
        return np.searchsorted(places, after) - np.searchsorted(places, before)

    marks = np.flatnonzero(_MARK[w.data[:-1]] & _BLANK[w.data[1:]])
    has_mark = between(marks) > 0
    ends = has_mark | (between(np.flatnonzero(w.data == 0x0A)) > 0)
    ends[w.first] = True
    return ends, np.cumsum(has_mark)


def find_sentences(w: Words, known: Known) -> list[tuple[int, int, int, int]]:
    """(text, first word, one past the last, identifier) of the known sentences, in order.

    Words are numbered within their text.
    """
    if not len(known.ids) or not len(w.starts):
        return []
    ends, marks = _breaks(w)
    hashes = word_hashes(w)
    begins = np.flatnonzero(ends[:-1])
    stop = w.first[np.searchsorted(w.first, begins, side="right")]
    fits = begins + known.shortest <= stop
    begins, stop = begins[fits], stop[fits]
    chosen = _is_in(range_hashes(hashes, begins, begins + known.shortest), known.beginnings)
    begins, stop = np.repeat(begins[chosen], len(known.lengths)), np.repeat(stop[chosen], len(known.lengths))
    past = begins + np.tile(known.lengths, len(begins) // len(known.lengths))
    fits = past <= stop
    begins, past = begins[fits], past[fits]
    fits = ends[past] & (marks[past - 1] == marks[begins])
    begins, past = begins[fits], past[fits]
    found = range_hashes(hashes, begins, past)
    fits = _is_in(found, known.hashes)
    begins, past, found = begins[fits], past[fits], found[fits]
    order = np.lexsort((-past, begins))
    begins, past, found = begins[order], past[order], found[order]
    # Of those that begin no later, none may end as late.
    reach = np.maximum.accumulate(np.concatenate([[0], past]))[:-1]
    outer = past > reach
    begins, past, found = begins[outer], past[outer], found[outer]
    text = np.searchsorted(w.first, begins, side="right") - 1
    ids = known.ids[np.searchsorted(known.hashes, found)]
    return list(zip(text.tolist(), (begins - w.first[text]).tolist(), (past - w.first[text]).tolist(), ids.tolist()))


def match_rules(sequence: Sequence[int], rules: Sequence[Rule]) -> list[str]:
    """Names of the licences whose rules a sequence of identifiers has, longer rules first.

    Each matched run is taken out, so that shorter rules see only the rest.
    """
    rest = "".join(f";{k};" for k in sequence)
    names = []
    for rule in sorted(rules, key=lambda r: -len(r.sentences)):
        run = "".join(f";{k};" for k in rule.sentences)
        if run in rest:
            names.append(rule.licence)
            rest = rest.replace(run, "|")
    return list(dict.fromkeys(names))


_FOUND = pa.list_(pa.struct([("sentence", pa.int64()), ("start", pa.int64()), ("end", pa.int64())]))


def find_licenses(
    docs: DataFrame,
    sentences: Mapping[int, str] = ALL_SENTENCES,
    rules: Sequence[Rule] = ALL_RULES,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Per row of `docs`: doc_id, `found` (known sentences and their word ranges), `licenses`."""
    schema = pa.schema([("doc_id", pa.int64()), ("found", _FOUND), ("licenses", pa.list_(pa.string()))])
    known, rules = Known(sentences), tuple(rules)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches):
            found: list[list[tuple[int, int, int]]] = [[] for _ in range(chunk.num_rows)]
            for i, start, end, k in find_sentences(words(chunk.column("text"), _INSIDE, lower=True), known):
                found[i].append((k, start, end))
            named = [match_rules([k for k, _, _ in x], rules) if x else [] for x in found]
            each = [[dict(zip(("sentence", "start", "end"), f)) for f in x] for x in found]
            yield to_batch(schema, [chunk.column("doc_id"), each, named])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return map_arrow(
        rows, work, "doc_id long, found array<struct<sentence: long, start: long, end: long>>, licenses array<string>"
    )


def digest(docs: DataFrame) -> DataFrame:
    return find_licenses(docs).select(
        "doc_id",
        F.size("found").cast("long").alias("n_sentences"),
        F.array_join("licenses", ",").alias("licenses"),
    )


def _sql() -> str:
    """Lines of each stretch between marks; known sentences are compared where a line begins."""
    known = ", ".join(f"({k}, '{content(v)}')" for k, v in ALL_SENTENCES.items())
    shortest = min(len(content(v)) for v in ALL_SENTENCES.values())
    ordered = list(enumerate(sorted(ALL_RULES, key=lambda r: -len(r.sentences))))
    runs = [(i, r, "".join(f";{k};" for k in r.sentences)) for i, r in ordered if len(r.sentences) > 1]
    single = ", ".join(f"({i}, ';{r.sentences[0]};', '{r.licence}')" for i, r in ordered if len(r.sentences) == 1)
    rests = ", ".join(f"replace(r{n}, '{run}', '|') AS r{n + 1}" for n, (_, _, run) in enumerate(runs))
    hits = " UNION ALL ".join(
        f"SELECT row, {i} AS place, '{r.licence}' AS licence FROM rests WHERE contains(r{n}, '{run}')"
        for n, (i, r, run) in enumerate(runs)
    )
    letters = "abcdefghijklmnopqrstuvwxyz"
    return rf"""
WITH known AS (SELECT id, content FROM (VALUES {known}) v(id, content)),
rows AS (SELECT doc_id, text, row_number() OVER () AS row FROM documents),
marked AS (
  SELECT row, regexp_replace(translate(text, '{letters.upper()}', '{letters}'), '[.!?]+[\x20\x09-\x0D]+', 'S', 'g') AS t
  FROM rows WHERE text IS NOT NULL),
spaced AS (
  SELECT row, string_split(regexp_replace(regexp_replace(concat(chr(10), t, chr(10)), '[^a-z0-9S\n]+', ' ', 'g'),
    ' ?([S\n])[ \n]*', '\1', 'g'), 'S') AS s FROM marked),
parts AS (SELECT row, unnest(s) AS part, generate_subscripts(s, 1) AS number FROM spaced),
lines AS (
  SELECT row, number, part, unnest(string_split(part, chr(10))) AS line,
    generate_subscripts(string_split(part, chr(10)), 1) AS i FROM parts),
begins AS (
  SELECT row, number, part, CAST(sum(length(line) + 1) OVER (PARTITION BY row, number ORDER BY i) AS BIGINT)
    - length(line) AS start FROM lines),
found AS (
  SELECT row, number, start, start + length(content) AS past, id FROM (
    SELECT *, replace(part, chr(10), ' ') AS plain FROM begins) b
  JOIN known ON substr(plain, start, {shortest}) = substr(content, 1, {shortest})
  WHERE substr(plain, start, length(content)) = content
    AND (start + length(content) > length(part) OR substr(part, start + length(content), 1) = chr(10))),
outer_ones AS (
  SELECT * FROM found f WHERE NOT EXISTS (
    SELECT 1 FROM found g WHERE g.row = f.row AND g.number = f.number AND g.start <= f.start AND g.past >= f.past
      AND (g.start < f.start OR g.past > f.past))),
sequences AS (
  SELECT row, count(*) AS n, string_agg(';' || id || ';', '' ORDER BY number, start) AS r0 FROM outer_ones GROUP BY row),
rests AS (SELECT row, n, r0, {rests} FROM sequences),
hits AS (
  {hits}
  UNION ALL SELECT row, place, licence FROM rests JOIN (VALUES {single}) v(place, run, licence)
    ON contains(r{len(runs)}, run)),
named AS (
  SELECT row, string_agg(licence, ',' ORDER BY place) AS licenses
  FROM (SELECT row, licence, min(place) AS place FROM hits GROUP BY row, licence) GROUP BY row)
SELECT doc_id, coalesce(n, 0) AS n_sentences, coalesce(licenses, '') AS licenses
FROM rows LEFT JOIN sequences USING (row) LEFT JOIN named USING (row)"""


SQL = _sql()
