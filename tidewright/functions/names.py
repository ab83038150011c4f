"""Names that are written in several ways."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidewright.session import small

#: Words that stand for "no value" in text columns. Fixed values.
NULL_WORDS = ("", "null", "none", "nan", "na", "n/a", "nil", "unknown", "-", "--", "?")


def squeezed(c: Column) -> Column:
    """``c`` without surrounding white space of any kind, in lower case."""
    return F.lower(F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))


def source_name(c: Column) -> Column:
    """A source's name: case, blanks and the kind of separator do not count."""
    return F.regexp_replace(squeezed(c), r"[\s\p{Z}_\-./]+", "_")


def is_null_word(c: Column) -> Column:
    """Whether text is null, blank or a word for null."""
    return F.coalesce(squeezed(c).isin(*NULL_WORDS), F.lit(True))


def register_names(register: DataFrame, key: str = "vessel_id") -> DataFrame:
    """One row per entity of a register: ``_key`` (squeezed) and ``_name`` (as spelled there)."""
    return (
        register.where(F.col(key).isNotNull())
        .groupBy(squeezed(F.col(key)).alias("_key"))
        .agg(F.min(key).alias("_name"))
        .where("_key <> ''")
    )


def with_registered(df: DataFrame, register: DataFrame, key: str = "vessel_id", out: str = "_vessel") -> DataFrame:
    """``df`` plus ``out``: the register's spelling of ``key``; null if it names no entity."""
    names = register_names(register, key).withColumnRenamed("_key", "_reg_key").withColumnRenamed("_name", out)
    return df.withColumn("_reg_key", squeezed(F.col(key))).join(small(names), "_reg_key", "left").drop("_reg_key")
