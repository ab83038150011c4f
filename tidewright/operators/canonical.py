"""Raw text rows to canonical typed records, with a cleaning audit that adds up."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidewright.functions import identity, parse
from tidewright.operators.badrows import FEATURES, SNAPSHOT_COLUMNS
from tidewright.operators.keys import require_unique
from tidewright.session import stage

TARGET = "fuel_consumption_kg_s"
CANONICAL_COLUMNS = ("record_id", "dataset_version", "vessel_id", "time_index", *FEATURES, TARGET)
RENAMED = dict(zip(SNAPSHOT_COLUMNS[2:], (*FEATURES, TARGET)))

TARGET_REASONS = ("missing", "nonnumeric", "nonfinite", "negative")
TIME_REASONS = ("missing", "nonnumeric", "nonfinite", "negative", "nonintegral")
FEATURE_REASONS = ("missing", "nonnumeric", "nonfinite", "range")


def classified(raw: DataFrame) -> DataFrame:
    """Each distinct raw row once (``n_copies``): vessel_id, typed time_index, target and features with a reason each, and its fate.

    ``fate`` is ``kept``, ``target_<reason>`` or ``time_<reason>``; the reason
    of a feature is also ``range``, and its value null then. Copies are merged
    before validity, on the text as it is.
    """
    rows = raw.groupBy(*SNAPSHOT_COLUMNS).agg(F.count("*").alias("n_copies"))
    rows = rows.withColumnRenamed("time_index", "_time_text")
    d = parse.parsed(rows, {f: r for r, f in RENAMED.items()}, {"time_index": "_time_text"})
    target = F.when(F.col(TARGET) < 0, "negative").otherwise(F.col(f"{TARGET}_error"))
    d = d.withColumns({f"{TARGET}_error": target} | {f"{f}_error": F.when(parse.out_of_range(f, F.col(f)), "range").otherwise(F.col(f"{f}_error")) for f in FEATURES})
    fate = F.concat(F.lit("target_"), F.col(f"{TARGET}_error")), F.concat(F.lit("time_"), F.col("time_index_error")), F.lit("kept")
    return d.select(
        "vessel_id", "n_copies", "time_index", TARGET, *[F.when(F.col(f"{f}_error").isNull(), F.col(f)).alias(f) for f in FEATURES], *[f"{f}_error" for f in FEATURES],
        F.coalesce(*fate).alias("fate"),
    )


def clean_rows(rows: DataFrame, version: str) -> DataFrame:
    """Canonical rows of the kept ones; a feature out of range is null."""
    return rows.where("fate = 'kept'").select(
        identity.record_id(F.lit(version), F.col("vessel_id"), F.col("time_index")).alias("record_id"), F.lit(version).alias("dataset_version"),
        "vessel_id", "time_index", *FEATURES, TARGET,
    )


def audit(rows: DataFrame) -> DataFrame:
    """One row for each entity and one for all (vessel_id null): every count of the cleaning.

    Rows are counted by entity, fate and reasons first; the columns of the
    report are sums over those few counts.
    """
    reasons = [f"{f}_error" for f in FEATURES]
    kept_only = [F.when(F.col("fate") == "kept", F.col(c)).alias(c) for c in reasons]
    few = stage(rows.select("vessel_id", "fate", "n_copies", *kept_only).groupBy("vessel_id", "fate", *reasons).agg(F.count("*").alias("m"), F.sum("n_copies").alias("n")))
    by = few.groupBy("vessel_id", "fate").agg(F.sum("m").alias("m"), F.sum("n").alias("n"))
    one = lambda cond, c="m": F.coalesce(F.sum(F.when(cond, F.col(c))), F.lit(0)).cast("long")
    total = F.grouping("vessel_id").cast("int").alias("is_total")
    fates = by.rollup("vessel_id").agg(
        total, F.sum("n").cast("long").alias("input_rows"), one(F.col("fate") == "kept").alias("output_rows"), F.sum(F.col("n") - F.col("m")).cast("long").alias("exact_duplicates"),
        *[one(F.col("fate") == f"{k}_{r}").alias(f"{k}_{r}") for k, rs in (("target", TARGET_REASONS), ("time", TIME_REASONS)) for r in rs],
    )
    # one row for each entity, feature and reason, then a column for each of the two
    each = few.where("fate = 'kept'").select("vessel_id", "m", F.explode(F.array(*[F.concat(F.lit(f"{f}_"), F.col(f"{f}_error")) for f in FEATURES])).alias("what")).where("what is not null")
    wanted = [f"{f}_{r}" for f in FEATURES for r in FEATURE_REASONS]
    wide = each.groupBy("vessel_id").pivot("what", wanted).agg(F.sum("m"))
    wide = wide.rollup("vessel_id").agg(total, *[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in wanted])
    wide = wide.withColumnsRenamed({"vessel_id": "_v", "is_total": "_t"})
    out = fates.join(wide, fates.vessel_id.eqNullSafe(wide._v) & (fates.is_total == wide._t), "left").drop("_v", "_t")
    out = out.na.fill(0, wanted)
    return out.withColumns({f"{f}_null": sum((F.col(f"{f}_{r}") for r in FEATURE_REASONS), F.lit(0)).cast("long") for f in FEATURES})


def reconcile(audit_rows: DataFrame) -> None:
    """Raise unless every row read is kept or counted as removed."""
    removed = sum((F.col(f"target_{r}") for r in TARGET_REASONS), F.col("exact_duplicates")) + sum((F.col(f"time_{r}") for r in TIME_REASONS), F.lit(0))
    bad = audit_rows.where(F.col("input_rows") != removed + F.col("output_rows")).limit(1).collect()
    if bad:
        raise AssertionError(f"cleaning counts of {bad[0]['vessel_id']} do not add up")


def canonicalize(raw: DataFrame, version: str, entities: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(clean, audit) of raw text rows.

    Fails, and yields nothing, on an unknown entity, on two kept rows with one
    (entity, time), or on an entity left without rows.
    """
    from tidewright.operators.keys import unknown_entities

    if entities is not None and (bad := unknown_entities(raw, "vessel_id", entities).limit(1).collect()):
        raise ValueError(f"unexpected vessel_id: {bad[0][0]!r}")
    rows = stage(classified(raw))
    clean = clean_rows(rows, version)
    require_unique(clean, ["vessel_id", "time_index"], "vessel and time")
    counts = audit(rows)
    reconcile(counts)
    empty = counts.where("is_total = 0 and output_rows = 0").limit(1).collect()
    if empty:
        raise ValueError(f"{empty[0]['vessel_id']} has no valid rows")
    return clean.orderBy("vessel_id", "time_index"), counts


def legacy_clean(df: DataFrame, numeric: list[str], categorical: list[str], times: list[str] = ()) -> DataFrame:
    """Wide frames of mixed origin: merge, normalise, fill and flag.

    Categories are normalised before equal rows are merged. Numbers are filled
    with the column's median over merged rows (0 where all are missing), with a
    ``_was_missing`` flag for every numeric column; timestamps that fit no
    format become null.
    """
    from tidewright.operators.features import exact_medians

    cols = [*[parse.finite(F.col(f"`{c}`").try_cast("double")).alias(c) for c in numeric], *[parse.category(F.col(f"`{c}`")).alias(c) for c in categorical]]
    cols += [parse.timestamp(F.col(f"`{c}`")).alias(c) for c in times]
    rows = df.select(*cols).distinct()
    mid = exact_medians(rows, numeric)
    filled = [F.coalesce(F.col(c), F.lit(float(mid.get(c) or 0.0))).alias(c) for c in numeric]
    flags = [F.col(c).isNull().cast("tinyint").alias(f"{c}_was_missing") for c in numeric]
    out = rows.select(*filled, *flags, *categorical, *times)
    return out.select(identity.row_id(out).alias("record_id"), *out.columns)
