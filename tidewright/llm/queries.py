"""The text queries, bound to their whole tables, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewright.llm import bpe, mixture, subjects
from tidewright.session import table


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode(table(spark, d, "documents"))


def p6_counts(spark: SparkSession, d: str) -> DataFrame:
    return bpe.token_counts(table(spark, d, "documents"))


def p7_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixture.mix(table(spark, d, "documents"), table(spark, d, "source_targets"))[0]


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixture.mix(table(spark, d, "documents"), table(spark, d, "source_targets"))[1]



def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return subjects.treated(table(spark, d, "documents"), table(spark, d, "doc_labels"), table(spark, d, "subjects"))


def p8_composition(spark: SparkSession, d: str) -> DataFrame:
    return subjects.composition(table(spark, d, "documents"), table(spark, d, "doc_labels"), table(spark, d, "subjects"))


QUERIES = {f.__name__: f for f in (p6_ids, p6_counts, p7_mixture, p7_shares, p8_found, p8_composition)}

ORACLES: dict[str, str] = {}
