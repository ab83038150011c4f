"""Canonical rows from a stream of raw rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidewright.functions import identity, parse
from tidewright.operators import badrows
from tidewright.operators.badrows import FEATURES, SNAPSHOT_COLUMNS
from tidewright.operators.canonical import RENAMED, TARGET


def canonical_stream(raw: DataFrame, version: str, arrived: str = "arrived_at", delay: str = "2 days") -> DataFrame:
    """Typed rows of a raw stream; copies within ``delay`` of each other are dropped."""
    once = raw.withWatermark(arrived, delay).dropDuplicatesWithinWatermark(list(SNAPSHOT_COLUMNS))
    d = parse.parsed(once.withColumnRenamed("time_index", "_time_text"), {f: r for r, f in RENAMED.items()}, {"time_index": "_time_text"})
    kept = d.where(F.col(TARGET).isNotNull() & (F.col(TARGET) >= 0) & F.col("time_index").isNotNull())
    return kept.select(
        identity.record_id(F.lit(version), F.col("vessel_id"), F.col("time_index")).alias("record_id"), "vessel_id", "time_index",
        *[F.when(~parse.out_of_range(f, F.col(f)), F.col(f)).alias(f) for f in FEATURES], TARGET, arrived,
    )


def faulty_stream(lines: DataFrame) -> DataFrame:
    """Faulty lines of a stream, each with its reason: the batch operator as it is."""
    return badrows.faulty_lines(lines)


def hourly_fuel(canonical: DataFrame, arrived: str = "arrived_at", delay: str = "2 days") -> DataFrame:
    """Mean fuel of each vessel by hour of arrival, closed once ``delay`` has passed."""
    return canonical.withWatermark(arrived, delay).groupBy(F.window(arrived, "1 hour").alias("w"), "vessel_id").agg(F.count("*").alias("n_rows"), F.avg(TARGET).alias("fuel"))
