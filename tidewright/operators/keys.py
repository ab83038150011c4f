"""Duplicates, keys, order and membership."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F


def exact_duplicates(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row for each distinct row, with ``n_copies``. Null equals null, NaN equals NaN."""
    return df.groupBy(*[F.col(f"`{c}`") for c in columns or df.columns]).agg(F.count("*").alias("n_copies"))


def removed_duplicates(df: DataFrame, by: str, columns: list[str] | None = None) -> DataFrame:
    """Surplus copies by ``by``."""
    return exact_duplicates(df, columns).groupBy(by).agg(F.sum(F.col("n_copies") - 1).alias("n_removed"))


def key_conflicts(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys borne by more than one row."""
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows")).where("n_rows > 1")


def require_unique(df: DataFrame, keys: list[str], what: str = "key") -> None:
    bad = key_conflicts(df, keys).limit(1).collect()
    if bad:
        raise ValueError(f"conflicting {what}: {tuple(bad[0][k] for k in keys)}")


def key_report(df: DataFrame, key: str) -> DataFrame:
    """n_rows, n_null, n_distinct and n_surplus of a key, from one aggregation by the key."""
    per = df.groupBy(key).agg(F.count("*").alias("n"))
    named = F.col(key).isNotNull()
    return per.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
        F.coalesce(F.sum(F.when(~named, F.col("n"))), F.lit(0)).alias("n_null"),
        F.count(F.when(named, 1)).alias("n_distinct"),
        F.coalesce(F.sum(F.when(named, F.col("n") - 1)), F.lit(0)).alias("n_surplus"),
    )


def order_violations(df: DataFrame, entity: str, position: str, value: str, width: int = 8192) -> DataFrame:
    """Rows whose ``value`` does not exceed that of the row before it by ``position``, a whole number.

    Windows run within stretches of ``width`` positions; the last row of a
    stretch is handed to the next one there is, so a hot entity is compared by
    many tasks.
    """
    d = df.select(entity, position, value, F.expr(f"`{position}` div {width}").alias("_s"))
    ends = d.groupBy(entity, "_s").agg(F.max(F.struct(position, value)).alias("_e"))
    carried = ends.select(F.col(entity).alias("_n"), F.col("_s").alias("_m"), F.lag("_e").over(Window.partitionBy(entity).orderBy("_s")).alias("_before"))
    d = d.join(carried, F.col(entity).eqNullSafe(F.col("_n")) & (F.col("_s") == F.col("_m")))
    before = F.coalesce(F.lag(F.struct(value)).over(Window.partitionBy(entity, "_s").orderBy(position)), F.when(F.col("_before").isNotNull(), F.struct(F.col(f"_before.{value}").alias(value))))
    return d.select(entity, position, value, before[value].alias("before")).where(F.col("before") >= F.col(value))


def differs(a: str, b: str, columns: list[str]) -> Column:
    """Whether any column differs between two aliases; null equals null."""
    return reduce(lambda x, y: x | y, [~F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in columns])


def conflicts(source: DataFrame, target: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows present on both sides under one key with other values."""
    return source.alias("s").join(target.alias("t"), F.col(f"s.{key}") == F.col(f"t.{key}")).where(differs("s", "t", columns)).select(f"s.{key}")


def extras(source: DataFrame, target: DataFrame, key: str) -> DataFrame:
    return target.join(source.select(key), key, "left_anti")


def matched(source: DataFrame, target: DataFrame, key: str) -> DataFrame:
    return source.join(target.select(key), key, "left_semi")


def overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys in both; empty for disjoint sets."""
    return a.select(key).intersect(b.select(key))


def misaligned(a: DataFrame, b: DataFrame, position: str, columns: list[str]) -> DataFrame:
    """Positions at which two datasets do not hold the same identity."""
    j = a.alias("a").join(b.alias("b"), F.col(f"a.{position}") == F.col(f"b.{position}"), "full")
    return j.where(F.col(f"a.{position}").isNull() | F.col(f"b.{position}").isNull() | differs("a", "b", columns)).select(
        F.coalesce(f"a.{position}", f"b.{position}").alias(position)
    )


def unknown_entities(df: DataFrame, entity: str, allowed: list[str]) -> DataFrame:
    return df.where(F.col(entity).isNull() | ~F.col(entity).isin(allowed)).select(entity).distinct()


def column_difference(df: DataFrame, required: list[str]) -> tuple[list[str], list[str]]:
    """(missing, unexpected) columns, in order."""
    return [c for c in required if c not in df.columns], [c for c in df.columns if c not in required]
