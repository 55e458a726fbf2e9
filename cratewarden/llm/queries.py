"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import oracles
from .codes import code_report
from .common import table
from .decontaminate import contaminated
from .lexical import rank_documents
from .mixing import mix_report
from .pii import pii_report
from .quality import quality_report
from .runindex import suffix_report
from .secrets import secret_report
from .sharding import shard_documents
from .simhash import simhash_report
from .substrings import substring_report
from .toolcalls import toolcall_report
from .warc import archive_report


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_report(table(spark, sf_dir, "documents"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_report(table(spark, sf_dir, "pages"))


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_report(table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_report(table(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_report(table(spark, sf_dir, "documents"))


def op8_toolcalls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toolcall_report(table(spark, sf_dir, "conversations"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_report(table(spark, sf_dir, "documents"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_report(table(spark, sf_dir, "documents"))


def op12_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_report(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_sharding": op2_sharding,
    "op3_warc": op3_warc,
    "op4_substrings": op4_substrings,
    "op5_quality": op5_quality,
    "op6_mixing": op6_mixing,
    "op7_simhash": op7_simhash,
    "op8_toolcalls": op8_toolcalls,
    "op9_secrets": op9_secrets,
    "op10_decontaminate": op10_decontaminate,
    "op11_suffixes": op11_suffixes,
    "op12_lexical": op12_lexical,
    "op13_codes": op13_codes,
}

ORACLE_SQL: dict[str, str] = dict(oracles.SQL)
