"""The queries of this subpackage, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from evenkeel.llm import (
    decontamination,
    licenses,
    line_dedup,
    near_duplicates,
    packing,
    periodic_runs,
    quality,
    secrets,
    sharding,
    simhash,
    spelling_variants,
    substring_dedup,
    toxicity,
)
from evenkeel.llm._frames import read

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(build: Query) -> Query:
    QUERIES[build.__name__] = build
    return build


@query
def op1_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    docs, items = read(spark, folder, "documents"), read(spark, folder, "benchmark")
    return decontamination.digest(decontamination.find_items(docs, items, near=decontamination.NEAR))


@query
def op6_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality.digest(read(spark, folder, "documents"))


SQL["op6_quality_rules"] = quality.SQL


@query
def op9_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates.near_duplicates(read(spark, folder, "documents"))


@query
def op2_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substring_dedup.digest(substring_dedup.remove_repeats(read(spark, folder, "documents")))


@query
def op4_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.digest(sharding.assign(read(spark, folder, "documents")))


@query
def op5_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(read(spark, folder, "documents"))


@query
def op10_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents")
    return toxicity.digest(toxicity.score(docs, toxicity.fit(docs, read(spark, folder, "labels"))))


@query
def op3_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.digest(read(spark, folder, "documents"))


SQL["op3_line_dedup"] = line_dedup.SQL


@query
def op7_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.digest(secrets.find_secrets(read(spark, folder, "documents")))


@query
def op8_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.digest(read(spark, folder, "documents"))


SQL["op8_license_scan"] = licenses.SQL


@query
def op11_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.digest(simhash.near_duplicates(read(spark, folder, "documents")))


@query
def op12_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling_variants.variants(spelling_variants.word_counts(read(spark, folder, "documents"), slips=True))


@query
def op13_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    docs = periodic_runs.periodic_texts(read(spark, folder, "documents"))
    return periodic_runs.digest(periodic_runs.find_runs(docs))


QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL:
    SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
