"""Loading a target table: insert-if-absent, replace, preflight and verification."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidewright.functions.parse import finite
from tidewright.operators import keys


def one_per_key(df: DataFrame, key: str) -> DataFrame:
    """The least row of each key in the order of the columns; rows without a key are left out."""
    rest = [c for c in df.columns if c != key]
    least = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*[F.col(f"`{c}`") for c in rest])).alias("_r"))
    return least.select(*[F.col(key) if c == key else F.col(f"_r.`{c}`").alias(c) for c in df.columns])


def insert_absent(source: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """``target`` plus the source rows whose key it lacks; rows it has stay as they are.

    A key that the source holds several times is inserted once (its least row);
    source rows without a key are not inserted. Inserting again changes nothing,
    so a load that broke off is simply run again.
    """
    fresh = one_per_key(source.join(target.select(key), key, "left_anti"), key)
    return target.unionByName(fresh, allowMissingColumns=True)


def insert_counts(source: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """One row: what insert_absent does. source_rows, keyless, repeated (surplus rows of a key), matched and inserted keys; nothing is modified."""
    s = source.groupBy(key).agg(F.count("*").alias("n"))
    there = target.where(F.col(key).isNotNull()).groupBy(key).agg(F.lit(True).alias("there"))
    j = s.join(there, key, "left")
    named, found = F.col(key).isNotNull(), F.coalesce("there", F.lit(False))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return j.agg(
        total(F.col("n")).alias("source_rows"), total(F.when(~named, F.col("n"))).alias("keyless"), total(F.when(named, F.col("n") - 1)).alias("repeated"),
        F.count(F.when(named & found, 1)).alias("matched"), F.lit(0).cast("long").alias("modified"), F.count(F.when(named & ~found, 1)).alias("inserted"),
    )


def replace(source: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """``source`` plus the target rows whose key it lacks."""
    keys.require_unique(source, [key])
    if not source.where(F.col(key).isNull()).isEmpty():
        raise ValueError("the key must not be null")
    return target.join(source.select(key), key, "left_anti").unionByName(source, allowMissingColumns=True)


def null_nonfinite(df: DataFrame) -> DataFrame:
    """NaN and infinities as null in every floating column."""
    return df.withColumns({c: finite(F.col(f"`{c}`")) for c, t in df.dtypes if t in ("double", "float")})


def preflight(source: DataFrame, target: DataFrame, key: str, columns: list[str], entity: str, version: str) -> DataFrame:
    """One row of counts that tell whether a load may run; nothing is written.

    Source and target are brought to one row a key first, so a repeated key
    counts once in ``matched``, ``conflicts`` (any of its target rows differs)
    and ``extras``; repeats are counted by themselves, and so are active rows
    of the target that share entity and time under other keys.
    """
    active = [r[0] for r in source.select(version).distinct().limit(2).collect()]
    if len(active) > 1:
        raise ValueError("a source holds one version")
    mine = F.lit(active[0] if active else None)
    s = source.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*columns)).alias("s"))
    t = target.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.min(F.struct(*columns)).alias("t"), F.max(F.struct(*columns)).alias("t2"), F.max(F.col(version).eqNullSafe(mine)).alias("active"), F.count("*").alias("k")
    )
    both = F.col("s").isNotNull() & F.col("t").isNotNull()
    other = ~F.col("s").eqNullSafe(F.col("t")) | ~F.col("s").eqNullSafe(F.col("t2"))
    sums = s.join(t, key, "full").agg(
        F.count("s").alias("source_rows"), F.count(F.when(both, 1)).alias("matched"), F.count(F.when(both & other, 1)).alias("conflicts"),
        F.count(F.when(F.col("s").isNull() & F.col("active"), 1)).alias("extras"), F.count(F.when(F.col("t").isNull(), 1)).alias("to_insert"),
        F.coalesce(F.sum(F.col("k") - 1), F.lit(0)).alias("duplicate_ids"),
    )
    nulls = target.agg(F.count(F.when(F.col(key).isNull(), 1)).alias("null_ids"))
    return sums.join(F.broadcast(nulls))  # one row each


def inspect(target: DataFrame, key: str, entity: str, time: str, version: str, active: str) -> DataFrame:
    """A store before a load, by entity: active rows, their ids, and active rows whose entity and time another one has."""
    mine = target.where(F.col(version) == active)
    per_key = mine.groupBy(entity, time).agg(F.count("*").alias("n"), F.count_distinct(key).alias("ids"))
    return per_key.groupBy(entity).agg(F.sum("n").alias("active_rows"), F.sum("ids").alias("active_ids"), F.sum(F.col("n") - 1).alias("duplicate_active_keys"))


#: Counts of a preflight that forbid a load.
BLOCKING = ("conflicts", "extras", "null_ids", "duplicate_ids")


def blocking_reasons(report: DataFrame, inspected: DataFrame | None = None) -> DataFrame:
    """(reason, n) of what forbids the load; empty if it may run."""
    parts = report.select(F.explode(F.array(*[F.struct(F.lit(c).alias("reason"), F.col(c).cast("long").alias("n")) for c in BLOCKING])).alias("r")).select("r.*")
    if inspected is not None:
        parts = parts.unionByName(inspected.agg(F.lit("duplicate_active_keys").alias("reason"), F.coalesce(F.sum("duplicate_active_keys"), F.lit(0)).cast("long").alias("n")))
    return parts.where("n > 0")


def loaded_by_entity(source: DataFrame, target: DataFrame, key: str, entity: str) -> DataFrame:
    """After a load, by entity: source rows, those found in the target, and whether all are there."""
    s = source.select(key, entity).join(target.select(key).distinct().withColumn("_there", F.lit(1)), key, "left")
    return s.groupBy(entity).agg(F.count("*").alias("source_rows"), F.count("_there").alias("loaded_rows"), (F.count("*") == F.count("_there")).alias("complete"))


def verify_loaded(source: DataFrame, target: DataFrame, key: str, columns: list[str], entity: str, version: str) -> None:
    """After a load: every source row is there with its values and nothing else of its version is."""
    r = preflight(source, target, key, columns, entity, version).first()
    if r["to_insert"] or r["conflicts"] or r["extras"] or r["null_ids"] or r["duplicate_ids"] or r["matched"] != r["source_rows"]:
        raise RuntimeError("the loaded table does not hold exactly the source's rows")
    short = loaded_by_entity(source, target, key, entity).where("not complete").limit(1).collect()
    if short:
        raise RuntimeError(f"rows of {short[0][0]} are missing")


def index_plan(wanted: DataFrame, existing: DataFrame) -> DataFrame:
    """(name, action, uses) of each index a store needs, for a store that has indexes.

    Both tables hold name, fields (array of strings, descending ones with a
    leading minus) and is_unique; ``existing`` also plain: no condition, expiry
    or other option. An index on the same fields serves if it is plain and as
    unique; one that is not, or another index under the wanted name, is a
    conflict; without any, the index is to be created.
    """
    w, e = wanted.alias("w"), existing.withColumnRenamed("name", "has").alias("e")
    alike = F.col("e.fields") == F.col("w.fields")
    serves = alike & (F.col("e.is_unique") == F.col("w.is_unique")) & F.col("e.plain")
    touch = w.join(e, alike | (F.col("e.has") == F.col("w.name")), "left")
    per = touch.groupBy("w.name").agg(F.max(F.col("has").isNotNull() & ~serves).alias("clash"), F.min(F.when(serves, F.col("has"))).alias("uses"))
    action = F.when(F.col("clash"), "conflict").when(F.col("uses").isNotNull(), "reuse").otherwise("create")
    return per.select("name", action.alias("action"), F.when(action == "reuse", F.col("uses")).alias("uses"))
