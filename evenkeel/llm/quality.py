"""Quality rules: a table of thresholds compiled into one Spark projection.

Every measure is a column expression over the whole text; no user function runs. A text is split into
words and lines once and the measures are read off these arrays. A null or empty text has no words and
fails the length rule. Rows stay rows: repeated ids and texts each get their verdict. Columns of the
input are kept where asked for, under their names; measures come in one struct column, under a free name. A
very long text is measured whole, in one row of its task. A measure equal to its threshold passes. An empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenkeel.llm._frames import fresh

# Frequent function words of the four languages.
STOP_WORDS = (
    "the be to of and that have with in is it for as was this are from by or an "
    "der die das und den von zu mit nicht ein eine ist des dem im auf für sich auch "
    "le la les de et un une est en que qui pour dans sur pas avec plus "
    "el los las y del se por con para no su al lo como"
).split()

_BLANKS = "[\\x20\\x09-\\x0D]+"
_HAS_WORD = "[^\\x20\\x09-\\x0D]"


@dataclass(frozen=True)
class Rule:
    """A text passes if `part` is at least `low` and at most `high` hundredths of `whole` (1 without)."""

    name: str
    part: str
    whole: str | None = None
    low: int | None = None
    high: int | None = None


#: The base rules: too few words, or too many of them in repeated three-word windows.
BASE_RULES = (
    Rule("length", "n_words", low=5000),
    Rule("repeated words", "n_repeat_words", "n_words", high=50),
)
#: The production table. Bounds are hundredths.
RULES = (
    Rule("mean word length", "word_chars", "n_words", low=300, high=1000),
    Rule("symbols", "n_symbols", "n_words", high=10),
    Rule("stop words", "n_stop_words", low=200),
    Rule("words with letters", "n_letter_words", "n_words", low=60),
    Rule("bullet lines", "n_bullet_lines", "n_lines", high=90),
    Rule("cut-off lines", "n_ellipsis_lines", "n_lines", high=30),
    Rule("repeated lines", "n_dup_lines", "n_lines", high=50),
    Rule("capitals", "n_capitals", "word_chars", high=50),
)


def _bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with the value computed once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def _size(array: Column) -> Column:
    return F.size(array).cast("long")


def _repeat_words(words: Column) -> Column:
    """Words inside three-word windows that are found twice or more in the text, the first included."""

    def covered(at: Column) -> Column:
        # Each window start covers the words up to the next start, three at most.
        steps = F.transform(at, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(at, i + 1) - x, F.lit(3))))
        return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

    def starts(pairs: Column) -> Column:
        def twin(x: Column, i: Column) -> Column:
            before = (i > 0) & (F.get(pairs, i - 1)["h"] == x["h"])
            return F.coalesce(before | (F.get(pairs, i + 1)["h"] == x["h"]), F.lit(False))

        return F.sort_array(F.transform(F.filter(pairs, twin), lambda x: x["i"]))

    def among(windows: Column) -> Column:
        pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        found = _bind(pairs, lambda p: _bind(starts(p), covered))
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(found)

    windows = F.transform(
        F.sequence(F.lit(0), F.size(words) - 3),
        lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)),
    )
    return F.when(F.size(words) < 4, F.lit(0)).otherwise(_bind(windows, among)).cast("long")


def measures(text: Column) -> Column:
    """All measures of a text as one struct."""

    def of_words(w: Column) -> dict[str, Column]:
        return {
            "n_words": _size(w),
            "word_chars": F.aggregate(w, F.lit(0).cast("long"), lambda a, x: a + F.char_length(x)),
            "n_stop_words": _size(F.filter(w, lambda x: F.lower(x).isin(STOP_WORDS))),
            "n_letter_words": _size(F.filter(w, lambda x: x.rlike("\\p{L}"))),
            "n_repeat_words": _repeat_words(w),
        }

    def of_lines(lines: Column) -> dict[str, Column]:
        return {
            "n_lines": _size(lines),
            "n_dup_lines": _size(lines) - _size(F.array_distinct(lines)),
            "n_bullet_lines": _size(F.filter(lines, lambda x: x.rlike("^[ \\t]*[-*•]"))),
            "n_ellipsis_lines": _size(F.filter(lines, lambda x: x.rlike("(\\.\\.\\.|…)[ \\t\\r]*$"))),
        }

    def named(columns: dict[str, Column]) -> Column:
        return F.struct(*[c.alias(n) for n, c in columns.items()])

    def of_text(t: Column) -> Column:
        split = F.filter(F.split(t, _BLANKS), lambda x: x != "")
        lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(_HAS_WORD))
        return F.struct(
            _bind(split, lambda w: named(of_words(w))).alias("words"),
            _bind(lines, lambda x: named(of_lines(x))).alias("lines"),
            F.regexp_count(t, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
            F.char_length(F.regexp_replace(t, "[^A-Z]+", "")).cast("long").alias("n_capitals"),
        )

    return _bind(F.coalesce(text, F.lit("")), of_text)


def passes(rule: Rule, value: Callable[[str], Column]) -> Column:
    part = value(rule.part) * 100
    whole = value(rule.whole) if rule.whole else F.lit(1)
    ok = F.lit(True)
    if rule.low is not None:
        ok = ok & (part >= rule.low * whole)
    if rule.high is not None:
        ok = ok & (part <= rule.high * whole)
    return ok


def assess(
    docs: DataFrame, rules: Iterable[Rule] = RULES, base: Iterable[Rule] = BASE_RULES, text: str = "text"
) -> DataFrame:
    """All columns of `docs` and a struct `quality`.

    It has every measure, `base_failed`, `failed` (names of the rules that a row fails) and `kept` (no
    rule fails).
    """
    raw, out = fresh(docs, "measured", "quality")
    rows = docs.withColumn(raw, measures(F.col(text)))

    def value(name: str) -> Column:
        place = raw
        if name in ("n_symbols", "n_capitals"):
            return F.col(f"{place}.{name}")
        return F.col(f"{place}.{'lines' if name.endswith('lines') else 'words'}.{name}")

    names = (
        "n_words word_chars n_symbols n_dup_lines n_repeat_words n_stop_words n_letter_words n_lines "
        "n_bullet_lines n_ellipsis_lines n_capitals"
    ).split()
    base, rules = list(base), list(rules)
    base_failed = ~F.coalesce(_all([passes(r, value) for r in base]), F.lit(True))
    failed = F.filter(
        F.array(*[F.when(~passes(r, value), F.lit(r.name)) for r in [*base, *rules]]), lambda x: x.isNotNull()
    )
    kept = _all([passes(r, value) for r in [*base, *rules]])
    quality = F.struct(
        *[value(n).alias(n) for n in names],
        base_failed.alias("base_failed"),
        failed.alias("failed"),
        kept.alias("kept"),
    )
    return rows.withColumn(out, quality).drop(raw)


def _all(conditions: list[Column]) -> Column:
    result = F.lit(True)
    for c in conditions:
        result = result & c
    return result


def digest(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: the base measures and the verdict."""
    q = assess(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")))
    fields = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return q.select("doc_id", *[F.col(f"quality.{f}").alias(f) for f in fields])


def _condition(rule: Rule) -> str:
    whole = rule.whole or "1"
    sides = [f"100 * {rule.part} >= {rule.low} * {whole}"] if rule.low is not None else []
    sides += [f"100 * {rule.part} <= {rule.high} * {whole}"] if rule.high is not None else []
    return "(" + " AND ".join(sides) + ")"


_STOPS = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))

#: SQL tables up to `measured`, from a table `docs`.
MEASURES_SQL = rf"""
split AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM docs),
windows AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM (
    SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM split) x) y),
repeats AS (
  SELECT doc_id, count(DISTINCT i + j) AS n FROM windows, (SELECT unnest([0, 1, 2]) AS j) x
  WHERE n > 1 GROUP BY doc_id),
measured AS (
  SELECT s.doc_id, len(w) AS n_words,
    CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
    len(l) - len(list_distinct(l)) AS n_dup_lines,
    CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words,
    len(list_filter(w, lambda x: lower(x) IN ({_STOPS}))) AS n_stop_words,
    len(list_filter(w, lambda x: regexp_matches(x, '\p{{L}}'))) AS n_letter_words,
    len(l) AS n_lines,
    len(list_filter(l, lambda x: regexp_matches(x, '^[ \t]*[-*•]'))) AS n_bullet_lines,
    len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…)[ \t\r]*$'))) AS n_ellipsis_lines,
    length(regexp_replace(text, '[^A-Z]+', '', 'g')) AS n_capitals
  FROM split s LEFT JOIN repeats r ON r.doc_id = s.doc_id)"""
BASE_SQL = " AND ".join(_condition(r) for r in BASE_RULES)
KEPT_SQL = " AND ".join(_condition(r) for r in (*BASE_RULES, *RULES))
SQL = f"""
WITH docs AS (SELECT doc_id, text FROM documents), {MEASURES_SQL}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  NOT ({BASE_SQL}) AS base_failed, {KEPT_SQL} AS kept
FROM measured"""
