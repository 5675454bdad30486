"""The corpus pipeline: five stages over `documents`, each reading what the one before has kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as Parquet to the
shared folder and read again as the next stage's `docs`. All stages but the last return the columns of
their input. Null ids, empty and very long texts and ties pass through as each operator says; rows that are
equal in id and text are one document from the near-duplicate stage on. An empty table gives no rows. Names of
columns that the stages add for a while are chosen free of those of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evenkeel.llm import decontamination, line_dedup, near_duplicates, packing, quality
from evenkeel.llm._frames import fresh, read, row_key, stored


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a quality rule go."""
    (verdict,) = fresh(docs, "quality")
    return quality.assess(docs).where(F.col(verdict)["kept"]).select(*docs.columns)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines go from the texts; `n_chars` follows. No document goes."""
    cleaned = line_dedup.remove_boilerplate(docs).select(*docs.columns)
    if "n_chars" not in docs.columns:
        return cleaned
    kind = docs.schema["n_chars"].dataType
    return cleaned.withColumn("n_chars", F.char_length("text").cast(kind)).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates stays."""
    key, stays = fresh(docs, "key", "stays")
    keyed = docs.withColumn(key, row_key("doc_id", "text"))
    found = near_duplicates.near_duplicates(keyed.select(F.col(key).alias("doc_id"), "text"))
    chosen = found.where("doc_id = component_id").select(F.col("doc_id").alias(stays)).distinct()
    kept = keyed.join(chosen, F.col(key) == F.col(stays), "left_semi")
    return kept.dropDuplicates([key]).select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of a benchmark item go."""
    key, hit = fresh(docs, "key", "hit")
    keyed = docs.withColumn(key, row_key("doc_id", "text"))
    found = decontamination.find_items(
        keyed.select(F.col(key).alias("doc_id"), "text"), read(spark, sf_dir, "benchmark")
    )
    contaminated = found.where("n_hit > 0").select(F.col("doc_id").alias(hit)).distinct()
    return keyed.join(contaminated, F.col(key) == F.col(hit), "left_anti").select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as pieces in token sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("best-fit packing", packing_stage),
]

#: Tokenising and the similarity join are beyond SQL; tests/llm compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
