"""Secret scan with corpus-wide ownership of what it finds.

Patterns mark candidates in every text. Each candidate's value, as a hash, is then counted over the whole
corpus: in how many repositories and under how many owners it stands. A value that many owners or very many
repositories have is `shared`, an example copied from documentation. One that few have looks `live`, if the
owners of all its repositories are known; else it is `unknown` whose it is. The counts decide on the verdict
only; spans are never dropped.

A null or empty text has no spans. A null repository or owner is not counted, but a repository without an
owner leaves its values `unknown`. Repeated rows are scanned each and count once as a repository. Spans that
start together come in the order of their kinds. A very long text is scanned whole, in a time that grows with
its length and its spans. An empty table gives no rows. Only the named columns are read, so clashing names do
no harm.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenkeel.llm._frames import join_counted, map_arrow, stored
from evenkeel.llm._text import chunks, to_batch

#: Owners, and repositories, up to which a value counts as theirs.
MAX_OWNERS = 2
MAX_REPOSITORIES = 50

# Kind, pattern (ASCII only), group of the value, characters that the value needs.
KINDS = (
    ("assign", r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]+", 0, 16),
    ("bearer", r"(?i:bearer)\x20+([A-Za-z0-9._~+/=-]+)", 1, 20),
    ("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    ("url_login", r"[a-z][a-z0-9+.-]*://[A-Za-z0-9._%+-]{1,64}:([^\x00-\x20@/:]+)@", 1, 6),
)
#: The first kinds are the base; the others are added to it.
BASE_KINDS = 3
# Hex runs are everywhere in words; asking for the length at once finds the same matches faster.
_FASTER = {"hex": r"[0-9a-f]{16,}"}


def find_spans(text: str, patterns: list[tuple[str, re.Pattern, int, int]]) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, value) by start and then in the order of the kinds; places are code points."""
    found = []
    for order, (kind, pattern, group, least) in enumerate(patterns):
        for m in pattern.finditer(text):
            if len(m[group]) >= least:
                found.append((m.start(), order, m.end(), kind, m[group]))
    return [(kind, start, end, value) for start, _, end, kind, value in sorted(found)]


def compiled() -> list[tuple[str, re.Pattern, int, int]]:
    return [(kind, re.compile(_FASTER.get(kind, p), re.ASCII), group, least) for kind, p, group, least in KINDS]


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("slot", pa.int32())]))


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", repository: str = "doc_id", owner: str = "source") -> DataFrame:
    """(doc_id, repository, owner, row, spans, found) of every row, stored.

    `found` has the hash of each secret of the row once; a span's `slot` is its place there.
    """
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.col(repository).cast("string").alias("repository"),
        F.col(owner).cast("string").alias("owner"),
        F.col(text).cast("string").alias("text"),
    )
    schema = pa.schema(
        [("doc_id", pa.int64()), ("repository", pa.string()), ("owner", pa.string())]
        + [("spans", _SPANS), ("found", pa.list_(pa.int64()))]
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = compiled()
        for chunk in chunks(batches):
            spans, found = [], []
            for content in chunk.column("text").to_pylist():
                slots: dict[int, int] = {}
                here = []
                for kind, start, end, value in find_spans(content or "", patterns):
                    digest = hashlib.blake2b(value.encode(), digest_size=8).digest()
                    slot = slots.setdefault(int.from_bytes(digest, signed=True), len(slots))
                    here.append({"kind": kind, "start": start, "end": end, "slot": slot})
                spans.append(here)
                found.append(list(slots))
            yield to_batch(schema, [*(chunk.column(c) for c in ("doc_id", "repository", "owner")), spans, found])

    ddl = (
        "doc_id long, repository string, owner string, "
        "spans array<struct<kind: string, start: long, end: long, slot: int>>, found array<long>"
    )
    return stored(map_arrow(rows, work, ddl).withColumn("row", F.monotonically_increasing_id()), "secrets")


def ownership(scanned: DataFrame) -> DataFrame:
    """(value, n, n_repositories, n_owners, n_unowned) over the corpus.

    `n` are the rows with the value, `n_unowned` the repositories of which no owner is known.
    """
    each = scanned.select("repository", "owner", F.explode("found").alias("value"))
    once = each.groupBy("value", "repository", "owner").agg(F.count("*").alias("n"))
    per_repository = once.groupBy("value", "repository").agg(
        F.sum("n").alias("n"), F.count("owner").alias("owners")
    )
    repositories = per_repository.groupBy("value").agg(
        F.sum("n").alias("n"),
        F.count("repository").alias("n_repositories"),
        F.count_if(F.col("owners") == 0).alias("n_unowned"),
    )
    owners = once.groupBy("value", "owner").agg(F.lit(1).alias("x")).groupBy("value").agg(F.count("owner").alias("n_owners"))
    return repositories.join(owners, "value")


def find_secrets(
    docs: DataFrame, max_owners: int = MAX_OWNERS, max_repositories: int = MAX_REPOSITORIES, **columns: str
) -> DataFrame:
    """Per row: doc_id and `secrets`, each with kind, start, end, n_repositories, n_owners and verdict."""
    scanned = scan(docs, **columns)
    known = stored(ownership(scanned), "owners")
    # Values of a row once each, and the hottest values not shuffled at all.
    values = scanned.select("row", F.posexplode("found").alias("slot", "value"))
    verdict = (
        F.when((F.col("n_owners") > max_owners) | (F.col("n_repositories") > max_repositories), "shared")
        .when((F.col("n_owners") == 0) | (F.col("n_unowned") > 0), "unknown")
        .otherwise("live")
    )
    counts = F.struct("slot", "n_repositories", "n_owners", verdict.alias("verdict"))
    # By slot, so that a span finds its counts by their place.
    by_row = join_counted(values, known, "value", "n").groupBy("row").agg(F.sort_array(F.collect_list(counts)).alias("counts"))
    secrets = F.transform(
        "spans",
        lambda s: F.struct(
            s["kind"].alias("kind"),
            s["start"].alias("start"),
            s["end"].alias("end"),
            *[F.get("counts", s["slot"])[c].alias(c) for c in ("n_repositories", "n_owners", "verdict")],
        ),
    )
    return scanned.join(by_row, "row", "left").select("doc_id", secrets.alias("secrets"))


def _has(field: str, value: str):
    return lambda s: s[field] == value


def digest(found: DataFrame) -> DataFrame:
    base = [k for k, *_ in KINDS[:BASE_KINDS]]

    def joined(kinds: list[str] | None):
        chosen = F.filter("secrets", lambda s: s["kind"].isin(kinds)) if kinds else F.col("secrets")
        return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(condition):
        return F.size(F.filter("secrets", condition)).cast("long")

    return found.select(
        "doc_id",
        *[count(_has("kind", k)).alias(f"n_{k}") for k in base],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(None).alias("spans"),
        *[count(_has("verdict", v)).alias(f"n_{v}") for v in ("live", "shared", "unknown")],
    )
