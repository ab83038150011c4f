"""Contracts between stages: what a table must hold before the next stage may read it.

A contract is a table (rule, n_violations), one row a rule, also for rules that
hold; ``require`` turns breaches into an error. Rules on single rows are counted
together in one pass; rules on keys, parts and metrics are aggregations whose
results are a few rows. Nothing is collected but these counts.

A null breaks every rule that speaks of a value unless the rule says otherwise;
an empty table breaks ``not_empty`` only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tidewright.functions import angles, identity, parse
from tidewright.operators import keys, metrics
from tidewright.operators.badrows import FEATURES
from tidewright.operators.canonical import CANONICAL_COLUMNS, TARGET

#: Texts of a whole number as it is written back, and of names that need no quoting. Fixed patterns.
WHOLE, SAFE_NAME, HEX40, HEX64 = r"^(0|[1-9][0-9]*)$", r"^[A-Za-z0-9_.-]{1,64}$", r"^[0-9a-f]{40}$", r"^[0-9a-f]{64}$"

#: Most missing cells of a legacy frame, in per cent.
MISSING_PCT = 5.0


def broken(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, n_violations) of rules that hold where their column is true; null counts as broken. One pass."""
    counts = df.agg(*[F.count(F.when(~F.coalesce(ok, F.lit(False)), 1)).alias(r) for r, ok in rules.items()])
    return _long(counts)


def _long(counts: DataFrame) -> DataFrame:
    return counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("rule"), F.col(f"`{c}`").cast("long").alias("n_violations")) for c in counts.columns])).alias("r")).select("r.*")


def _number(df: DataFrame, rule: str) -> DataFrame:
    """(rule, number of rows of ``df``)."""
    return df.agg(F.count("*").alias(rule)).transform(_long)


def together(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def require(contract: DataFrame) -> None:
    bad = sorted(f"{r[0]}: {r[1]}" for r in contract.where("n_violations > 0").collect())
    if bad:
        raise ValueError(f"contract broken: {', '.join(bad)}")


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))


# ---- canonical rows ----------------------------------------------------------------------------


def canonical(df: DataFrame, version: str, entities: list[str] | None = None) -> DataFrame:
    """Canonical rows: ids derived anew, one version, known entities, times from 0, finite targets from 0, features null or in range, keys unique."""
    f = lambda c: F.col(c).isNull() | (~F.isnan(c) & (F.abs(F.col(c)) != F.lit(float("inf"))) & ~parse.out_of_range(c, F.col(c)))
    rules = {
        "record_id": F.col("record_id") == identity.record_id(F.col("dataset_version"), F.col("vessel_id"), F.col("time_index")),
        "dataset_version": F.col("dataset_version") == version,
        "vessel_id": F.col("vessel_id").isin(entities) if entities is not None else F.col("vessel_id").isNotNull(),
        "time_index": F.col("time_index") >= 0,
        TARGET: finite(F.col(TARGET)) & (F.col(TARGET) >= 0),
        **{c: f(c) for c in FEATURES},
    }
    return together(
        broken(df, rules),
        _number(keys.key_conflicts(df, ["record_id"]), "record_id_unique"),
        _number(keys.key_conflicts(df, ["vessel_id", "time_index"]), "vessel_time_unique"),
        df.agg((F.count("*") == 0).cast("long").alias("not_empty")).transform(_long),
    )


def canonical_text(df: DataFrame) -> DataFrame:
    """Canonical rows as text, before they are typed: blank features are allowed, all other numbers must be finite, and a time is written as it is read back."""
    t = lambda c: parse.trimmed(F.col(c))
    number = lambda c: finite(parse.number_value(t(c)))
    rules = {
        "record_id": F.col("record_id").rlike(HEX64), "dataset_version": F.col("dataset_version").rlike(HEX40), "vessel_id": t("vessel_id") != "",
        "time_index": F.col("time_index").rlike(WHOLE) & F.col("time_index").try_cast("bigint").isNotNull(), TARGET: number(TARGET) & (parse.number_value(t(TARGET)) >= 0),
        **{c: F.col(c).isNull() | (t(c) == "") | number(c) for c in FEATURES},
    }
    return broken(df, rules)


def canonical_columns(df: DataFrame) -> list[str]:
    """What is wrong with the columns: they must be the canonical ones in order."""
    missing, extra = keys.column_difference(df, list(CANONICAL_COLUMNS))
    return [f"missing {c}" for c in missing] + [f"unexpected {c}" for c in extra] + (["order"] if not missing and not extra and list(df.columns) != list(CANONICAL_COLUMNS) else [])


# ---- saved splits ------------------------------------------------------------------------------


def part_summary(split: DataFrame, entity: str = "vessel_id", time: str = "time_index") -> DataFrame:
    """What a manifest holds of each part of each entity: rows, first and last time, digest of the ordered ids."""
    per = split.groupBy(entity, "split").agg(F.count("*").alias("n_rows"), F.min(time).alias("first_time"), F.max(time).alias("last_time"))
    return per.join(identity.list_digest(split, [entity, "split"], time, "record_id"), [entity, "split"])


def saved_split(split: DataFrame, manifest: DataFrame, columns: list[str], entity: str = "vessel_id", time: str = "time_index") -> DataFrame:
    """A saved split against its manifest (``part_summary`` at the time of writing), by rule.

    Values finite; each time of an entity once; parts of an entity one after
    the other; no id in two parts; rows, bounds and ids as in the manifest.
    """
    got, want = part_summary(split, entity, time).alias("g"), manifest.alias("w")
    both = got.join(want, (F.col(f"g.{entity}") == F.col(f"w.{entity}")) & (F.col("g.split") == F.col("w.split")), "full")
    same = {c: F.col(f"g.{c}").eqNullSafe(F.col(f"w.{c}")) for c in ("n_rows", "first_time", "last_time", "digest")}
    w = got.groupBy(f"g.{entity}").pivot("split", ["train", "validation", "test"]).agg(F.first("first_time").alias("a"), F.first("last_time").alias("b"))
    in_order = {
        "parts_present": F.col("train_a").isNotNull() & F.col("validation_a").isNotNull() & F.col("test_a").isNotNull(),
        "parts_in_order": (F.coalesce(F.col("train_b") < F.col("validation_a"), F.lit(True))) & (F.coalesce(F.col("validation_b") < F.col("test_a"), F.lit(True))),
    }
    per_id = split.groupBy("record_id").agg(F.count_distinct("split").alias("parts"), F.count("*").alias("n"))
    return together(
        broken(split, {f"finite_{c}": finite(F.col(c)) for c in columns} | {"part_name": F.col("split").isin("train", "validation", "test")}),
        _number(keys.key_conflicts(split, [entity, time]), "times_rise"),
        broken(per_id, {"ids_unique": F.col("n") == 1, "parts_disjoint": F.col("parts") == 1}),
        broken(w, in_order), broken(both, {f"manifest_{c}": ok for c, ok in same.items()}),
    )


def angle_ranges(df: DataFrame, prefix: str = "a_") -> DataFrame:
    """Rotation angles: five in [0, pi], the direction in [0, 2 pi]."""
    top = lambda c: 2 * F.pi() if c == "wind_direction" else F.pi()
    return broken(df, {prefix + c: finite(F.col(prefix + c)) & (F.col(prefix + c) >= 0) & (F.col(prefix + c) <= top(c) + 1e-12) for c in FEATURES})


def scaled_target(df: DataFrame, low: float, high: float, scaled: str, tolerance: float = 1e-12) -> DataFrame:
    """The saved scaled target is the target scaled anew, and the scaling does not collapse."""
    again = angles.scaled(F.col(TARGET), F.lit(low), F.lit(high), -1.0, 1.0, False)
    one = df.sparkSession.range(1).select(F.lit(int(not high > low)).alias("scale_not_constant"))
    return together(broken(df, {scaled: angles.close(F.col(scaled), again, tolerance, tolerance)}), _long(one))


def same_partitions(a: DataFrame, b: DataFrame, part: str = "split", tolerance: float = 0.0) -> DataFrame:
    """Two saved splits hold the same ids with the same targets in the same parts."""
    j = a.select("record_id", F.col(part).alias("p"), F.col(TARGET).alias("y")).alias("a").join(b.select("record_id", F.col(part).alias("p"), F.col(TARGET).alias("y")).alias("b"), "record_id", "full")
    both = F.col("a.p").isNotNull() & F.col("b.p").isNotNull()
    return broken(j, {"ids": both, "parts": ~both | (F.col("a.p") == F.col("b.p")), "targets": ~both | angles.close(F.col("a.y"), F.col("b.y"), tolerance, tolerance)})


# ---- candidates and inference ------------------------------------------------------------------


def candidate(predictions: DataFrame, truth: DataFrame, reported: DataFrame, entity: str = "vessel_id", rtol: float = 1e-7, again: DataFrame | None = None) -> DataFrame:
    """A candidate before it may be ranked, by rule.

    ``predictions`` holds record_id and p, ``truth`` record_id, entity and y,
    ``reported`` the metrics the candidate claims (entity null for all rows):
    n_rows, mae, rmse, r2. Every row predicted once, finitely; the metrics
    recomputed as reported; ``again``, the predictions of the reloaded model,
    the same as the saved ones.
    """
    p = predictions.groupBy("record_id").agg(F.count("*").alias("n"), F.first("p").alias("p"))
    j = truth.select("record_id", entity, "y").join(p, "record_id", "full")
    rows = {"predicted_once": F.col("n") == 1, "known_rows": F.col("y").isNotNull(), "finite": F.col("n").isNull() | finite(F.col("p"))}
    made = metrics.grouped_metrics(j.where(F.col("p").isNotNull() & F.col("y").isNotNull()), [entity]).drop("is_total").alias("m")
    both = made.join(reported.alias("r"), F.col(f"m.{entity}").eqNullSafe(F.col(f"r.{entity}")), "full")
    claims = {f"metric_{c}": angles.close(F.col(f"m.{c}").cast("double"), F.col(f"r.{c}").cast("double"), rtol, 1e-12) for c in ("n_rows", "mae", "rmse", "r2")}
    parts = [broken(j, rows), broken(both, claims)]
    if again is not None:
        k = predictions.select("record_id", "p").join(again.select("record_id", F.col("p").alias("q")), "record_id", "full")
        parts.append(broken(k, {"reloaded_model": angles.close(F.col("p"), F.col("q"), rtol, 1e-9) & F.col("p").isNotNull()}))
    return together(*parts)


def inference_input(df: DataFrame, features: tuple[str, ...] = FEATURES, null_allowed: bool = True) -> DataFrame:
    """Rows a model may be asked about: exactly the features in order, none infinite; null and NaN only where allowed."""
    if list(df.columns) != list(features):
        raise ValueError(f"the columns must be exactly {', '.join(features)}")
    ok = lambda c: finite(F.col(c)) | ((F.col(c).isNull() | F.isnan(c)) if null_allowed else F.lit(False))
    return broken(df, {c: ok(c) for c in features})


def inference_output(given: DataFrame, predicted: DataFrame, key: str, prediction: str = "prediction") -> DataFrame:
    """Every row answered once and finitely."""
    p = predicted.groupBy(key).agg(F.count("*").alias("n"), F.first(prediction).alias("p"))
    j = given.select(key, F.lit(1).alias("asked")).join(p, key, "full")
    return broken(j, {"answered_once": F.col("n") == 1, "asked": F.col("asked") == 1, "finite": F.col("n").isNull() | finite(F.col("p"))})


# ---- legacy frames -----------------------------------------------------------------------------


def frame_problems(df: DataFrame, required: list[str], target: str | None = None) -> list[str]:
    """What keeps a legacy frame from being read at all."""
    out = [f"column twice: {c}" for c in sorted({c for c in df.columns if df.columns.count(c) > 1})]
    out += [f"column missing: {c}" for c in required if c not in df.columns]
    if target in df.columns and not isinstance(df.schema[target].dataType, T.NumericType):
        out.append(f"not numeric: {target}")
    return out if out or not df.isEmpty() else ["no rows"]


def validation_report(df: DataFrame, required: list[str], target: str | None = None, most_missing: float = MISSING_PCT) -> DataFrame:
    """(level, finding, subject, n) of a legacy frame: errors stop the next stage, warnings do not.

    Missing are null and NaN. Errors: no rows, required columns missing, a
    target that is not numeric, more than ``most_missing`` per cent of all
    cells missing. Warnings: other columns, fewer missing cells, columns with
    missing cells, surplus copies of equal rows.
    """
    spark = df.sparkSession
    missing, extra = keys.column_difference(df, required)
    fixed = [("error", "column_missing", c, 1) for c in missing] + [("warning", "column_unexpected", c, 1) for c in extra]
    if target is not None and target in df.columns and not isinstance(df.schema[target].dataType, T.NumericType):
        fixed.append(("error", "target_not_numeric", target, 1))
    gone = lambda c: F.col(f"`{c}`").isNull() | (F.isnan(f"`{c}`") if dict(df.dtypes)[c] in ("double", "float") else F.lit(False))
    per = keys.exact_duplicates(df)
    n = F.col("n_copies")
    total = F.coalesce(F.sum(n), F.lit(0))
    a = per.agg(total.alias("rows"), F.coalesce(F.sum(n - 1), F.lit(0)).alias("surplus"), *[F.coalesce(F.sum(F.when(gone(c), n)), F.lit(0)).alias(f"m{i}") for i, c in enumerate(df.columns)])
    cells = sum((F.col(f"m{i}") for i in range(len(df.columns))), F.lit(0))
    pct = F.when(F.col("rows") > 0, 100.0 * cells / (F.col("rows") * len(df.columns))).otherwise(100.0)
    row = lambda level, finding, subject, k: F.struct(level.alias("level"), F.lit(finding).alias("finding"), F.lit(subject).alias("subject"), k.cast("long").alias("n"))
    warning = F.lit("warning")
    found = a.select(F.explode(F.array(
        row(F.lit("error"), "no_rows", "*", F.when(F.col("rows") == 0, 1).otherwise(0)),
        row(F.when(pct > most_missing, "error").otherwise("warning"), "cells_missing", "*", F.when(F.col("rows") > 0, cells).otherwise(0)),
        row(warning, "rows_repeated", "*", F.col("surplus")),
        *[row(warning, "column_has_missing", c, F.col(f"m{i}")) for i, c in enumerate(df.columns)],
    )).alias("f")).select("f.*").where("n > 0")
    return found.unionByName(spark.createDataFrame(fixed, "level string, finding string, subject string, n long")) if fixed else found


def passed(report: DataFrame) -> bool:
    """Whether the next stage may start."""
    return report.where("level = 'error'").isEmpty()


# ---- files -------------------------------------------------------------------------------------


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """name, length and sha256 of each file at a path, for comparison with a manifest; a file is read by one task."""
    f = spark.read.format("binaryFile").load(path)
    return f.select(F.element_at(F.split("path", "/"), -1).alias("name"), "length", F.sha2("content", 256).alias("sha256"))


def same_files(spark: SparkSession, path: str, expected: dict[str, str]) -> DataFrame:
    """(rule, n_violations): files that are missing, unknown, or of another content than the manifest says."""
    want = spark.createDataFrame(sorted(expected.items()), "name string, want string")
    j = file_hashes(spark, path).join(want, "name", "full")
    known = F.col("sha256").isNotNull() & F.col("want").isNotNull()
    return broken(j, {"present": F.col("sha256").isNotNull(), "known": F.col("want").isNotNull(), "content": ~known | (F.col("sha256") == F.col("want"))})
