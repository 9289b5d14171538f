"""The corpus operators as registered queries, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .decontamination import ORACLE as DECONTAMINATION_SQL
from .decontamination import decontaminate
from .fingerprints import fingerprint_documents
from .licenses import oracle as licenses_sql
from .licenses import scan_licenses
from .line_dedup import ORACLE as LINES_SQL
from .line_dedup import dedup_lines
from .merkle import ORACLE as MERKLE_SQL
from .merkle import manifest
from .mixing import mix_documents
from .near_duplicates import near_duplicates
from .quality_rules import quality_rules
from .sharding import shard_documents
from .toxicity import toxicity
from .urls import filter_urls
from .warc import ORACLE as WARC_SQL
from .warc import archive_pages
from .whitening import whitened

Query = Callable[[SparkSession, str], DataFrame]


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_documents(table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=3, num=85, den=100)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(table(spark, sf_dir, "pages"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents"))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(table(spark, sf_dir, "documents"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(table(spark, sf_dir, "embeddings"))


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(table(spark, sf_dir, "documents"))


_ALL = (
    op1_sharding, op2_mixing, op3_url_filter, op4_decontamination, op5_toxicity,
    op6_line_dedup, op7_fingerprints, op8_licenses, op9_near_duplicates, op10_warc,
    op11_quality_rules, op12_whitening, op13_manifest,
)
QUERIES: dict[str, Query] = {f.__name__: f for f in _ALL}
ORACLE_SQL: dict[str, str] = {
    "op4_decontamination": DECONTAMINATION_SQL,
    "op6_line_dedup": LINES_SQL,
    "op8_licenses": licenses_sql(),
    "op10_warc": WARC_SQL,
    "op13_manifest": MERKLE_SQL,
}
