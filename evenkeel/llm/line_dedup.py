"""Line dedup: lines that stand on many sites are boilerplate and go.

Sites per line are counted with HyperLogLog sketches, which merge in the map-side and then in the final
aggregation, so that a line on every page costs a sketch per task and not a row per page. Lines whose
estimate is near the threshold get an exact distinct count, so the sketch decides only where its error
cannot matter.

Occurrences are then looked up in the table of boilerplate lines. A line may stand in a third of all
documents, so the lines with much of all occurrences are broadcast (`join_counted`) and not shuffled.

A line is told by a 64-bit hash of its exact text; lines without a word are never boilerplate. A document
with no line of its own (every line with a word is boilerplate) is a copy of others rather than a page; it
stays whole, for the near-duplicate step. Every other document loses its boilerplate, however much of it
that is. A null site counts as none, a null or empty text has no lines. Repeated rows are each cleaned alike,
and a line counts once for a site however often it stands there; ties can't arise. A very long text is one
row with all its lines. An empty table gives no rows. Columns of `docs` keep their names; added ones take
free names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenkeel.llm._frames import fresh, join_counted, row_key, stored

#: Sites from which on a line is boilerplate.
MIN_SITES = 10
#: Estimates within so many hundredths of the threshold are counted exactly; about eight standard errors.
NEAR = 25
_LG_K = 10
_HAS_WORD = "[^\\x20\\x09-\\x0D]"


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def site_lines(docs: DataFrame, text: str = "text", site: str = "source") -> DataFrame:
    """(key, pos, line, site) for every line with a word; `line` is a hash, `key` one of the row."""
    rows = docs.select(row_key(*docs.columns).alias("key"), F.col(site).cast("string").alias("site"), _lines(F.col(text)).alias("lines"))
    each = rows.select("key", "site", F.posexplode("lines").alias("pos", "content"))
    return each.where(F.col("content").rlike(_HAS_WORD)).select("key", "pos", F.xxhash64("content").alias("line"), "site")


def widespread(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """(line, n): the lines with at least `min_sites` distinct sites, and their occurrences with a site."""
    sketched = (
        lines.where("site IS NOT NULL")
        .groupBy("line")
        .agg(F.hll_sketch_agg("site", F.lit(_LG_K)).alias("sketch"), F.count("*").alias("n"))
        # No line can have more sites than occurrences.
        .where(F.col("n") >= min_sites)
        .select("line", "n", F.hll_sketch_estimate("sketch").alias("sites"))
    )
    low, high = min_sites * (100 - NEAR) / 100, min_sites * (100 + NEAR) / 100
    near = sketched.where(F.col("sites").between(low, high)).select("line")
    exact = (
        # A row for each line and site and task at most is shuffled.
        lines.select("line", "site").distinct().join(near, "line", "left_semi")
        .groupBy("line")
        .agg(F.count_distinct("site").alias("sites"))
        .where(F.col("sites") >= min_sites)
    )
    exact = sketched.select("line", "n").join(exact.select("line"), "line")
    return sketched.where(F.col("sites") > high).select("line", "n").union(exact)


def remove_boilerplate(
    docs: DataFrame,
    min_sites: int = MIN_SITES,
    text: str = "text",
    site: str = "source",
) -> DataFrame:
    """`docs` with cleaned texts, and `n_lines` (with a word) and `n_removed`, under free names."""
    n_lines, n_removed, key, hits, kept = fresh(docs, "n_lines", "n_removed", "key", "hits", "kept")
    lines = stored(site_lines(docs, text, site), "lines")
    wide = stored(widespread(lines, min_sites), "widespread")
    found = (
        join_counted(lines.select("key", "pos", "line"), wide, "line", "n")
        .groupBy(F.col("key").alias(key))
        .agg(F.collect_set("pos").alias(hits))
    )
    rows = docs.withColumn(key, row_key(*docs.columns)).join(found, key, "left")

    def clean(every: Column) -> Column:
        here = F.coalesce(F.col(hits), F.array().cast("array<int>"))
        places = F.sequence(F.lit(0), F.size(every) - 1)
        worded = F.filter(places, lambda i: F.get(every, i).rlike(_HAS_WORD))
        takes = F.size(here) < F.size(worded)
        rest = F.transform(F.array_except(places, here), lambda i: F.get(every, i))
        return F.struct(
            F.size(worded).cast("long").alias("n_lines"),
            F.when(takes, F.size(here)).otherwise(0).cast("long").alias("n_removed"),
            F.when(takes & (F.size(here) > 0), F.array_join(rest, "\n")).otherwise(F.col(text)).alias("text"),
        )

    rows = rows.withColumn(kept, F.transform(F.array(_lines(F.col(text))), clean)[0])
    columns = [F.col(f"{kept}.text").alias(c) if c == text else F.col(c) for c in docs.columns]
    return rows.select(*columns, F.col(f"{kept}.n_lines").alias(n_lines), F.col(f"{kept}.n_removed").alias(n_removed))


def digest(docs: DataFrame) -> DataFrame:
    rows = remove_boilerplate(docs.select("doc_id", "text", "source"))
    return rows.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


SQL = rf"""
WITH split AS (SELECT doc_id, source, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS l
  FROM documents),
each AS (SELECT doc_id, source, unnest(l) AS line, generate_subscripts(l, 1) AS pos FROM split),
worded AS (SELECT *, regexp_matches(line, '[^\x20\x09-\x0D]') AS has FROM each),
wide AS (SELECT line FROM worded WHERE has GROUP BY line HAVING count(DISTINCT source) >= {MIN_SITES}),
marked AS (SELECT w.*, wide.line IS NOT NULL AS hit FROM worded w LEFT JOIN wide ON wide.line = w.line),
counted AS (
  SELECT doc_id, count(*) FILTER (has) AS n_lines, count(*) FILTER (hit) AS n_hit,
    count(*) FILTER (hit) < count(*) FILTER (has) AS takes,
    coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT hit), '') AS rest
  FROM marked GROUP BY doc_id)
SELECT c.doc_id, n_lines, CASE WHEN takes THEN n_hit ELSE 0 END AS n_removed,
  sha256(CASE WHEN takes AND n_hit > 0 THEN rest ELSE text END) AS text_sha256
FROM counted c JOIN split s ON s.doc_id = c.doc_id"""
