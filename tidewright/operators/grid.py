"""Irregular readings onto a regular grid.

Method: ``lead`` pairs each occupied slot with the next one, only the slots
between the two are exploded, each is interpolated or marked by the length of
its gap, and the series is extended explicitly to given boundaries.

A hot source is split: slots are windowed within (source, block of slots), and
the first occupied slot of the next block is handed back as a sentinel row, so
no task holds more than ``block_slots`` slots of a source.

Defined results: readings with a null time, a negative time, or a value that is
null, NaN or negative are none; several readings of a slot give their mean;
a source without readings gives no rows; an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewright.functions.names import with_registered


def usable(time: str, value: str) -> Column:
    """Whether a row is a reading."""
    t, v = F.col(time), F.col(value)
    return t.isNotNull() & (t >= 0) & v.isNotNull() & ~F.isnan(v) & (v >= 0)


def regular_series(
    readings: DataFrame, *, source: str, time: str, value: str, step: int = 300, max_gap: int = 12,
    block_slots: int = 4096, bounds: tuple[int, int] | None = None,
) -> DataFrame:
    """One row per slot of each source: (source, slot, value, n_readings, how).

    ``how`` is ``reading``, ``filled`` (linear between the neighbours, gaps of
    at most ``max_gap`` slots) or ``marked`` (longer gaps; value null). With
    ``bounds`` = (first, last slot) the series of each source is extended to
    them with ``marked`` rows; else it runs from its first to its last reading.
    """
    slots = (
        readings.where(usable(time, value))
        .groupBy(F.col(source).alias("_s"), F.expr(f"`{time}` div {step}").alias("slot"))
        .agg(F.avg(value).alias("v"), F.count("*").alias("n_readings"))
        .withColumn("_b", F.expr(f"slot div {block_slots}"))
    )
    # the first slot of each block, handed to the block before it as the end of its last gap
    heads = slots.groupBy("_s", "_b").agg(F.min(F.struct("slot", "v")).alias("h"))
    by_source = Window.partitionBy("_s").orderBy("_b")
    sentinels = heads.select(
        "_s", F.col("h.slot").alias("slot"), F.col("h.v").alias("v"), F.lit(0).cast("long").alias("n_readings"),
        F.lag("_b").over(by_source).alias("_b"),
    ).where("_b is not null")
    in_block = Window.partitionBy("_s", "_b").orderBy("slot")
    paired = slots.unionByName(sentinels).select(
        "*", F.lead("slot").over(in_block).alias("next"), F.lead("v").over(in_block).alias("next_v")
    ).where("n_readings > 0")
    last = F.coalesce(F.col("next") - 1, F.col("slot"))
    # a long gap comes out block by block: no array holds more than ``block_slots`` slots
    pieces = paired.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(coalesce(next - 1, slot) - slot) div {block_slots}"))).alias("_p"))
    start = F.col("slot") + F.col("_p") * block_slots
    series = pieces.select(
        "*", F.explode(F.sequence(start, F.least(last, start + block_slots - 1))).alias("at"),
    ).select(
        F.col("_s").alias(source), F.col("at").alias("slot"),
        F.when(F.col("at") == F.col("slot"), F.col("v"))
        .when(F.col("next") - F.col("slot") - 1 <= max_gap, F.col("v") + (F.col("next_v") - F.col("v")) * (F.col("at") - F.col("slot")) / (F.col("next") - F.col("slot")))
        .alias(value),
        F.when(F.col("at") == F.col("slot"), F.col("n_readings")).otherwise(0).alias("n_readings"),
        F.when(F.col("at") == F.col("slot"), "reading").when(F.col("next") - F.col("slot") - 1 <= max_gap, "filled").otherwise("marked").alias("how"),
    )
    if bounds is None:
        return series
    first, final = bounds
    ends = slots.groupBy("_s").agg(F.min("slot").alias("a"), F.max("slot").alias("b"))
    outside = ends.select(
        F.col("_s").alias(source),
        F.explode(F.concat(
            F.when(F.col("a") > first, F.sequence(F.lit(first).cast("long"), F.col("a") - 1)).otherwise(F.array().cast("array<bigint>")),
            F.when(F.col("b") < final, F.sequence(F.col("b") + 1, F.lit(final).cast("long"))).otherwise(F.array().cast("array<bigint>")),
        )).alias("slot"),
        F.lit(None).cast("double").alias(value), F.lit(0).cast("long").alias("n_readings"), F.lit("marked").alias("how"),
    )
    return series.unionByName(outside)


def vessel_of_leg(rows: DataFrame, vessels: DataFrame) -> DataFrame:
    """The vessel of each leg: the one most of its rows name (ties: the first by name).

    Counts are combined before the shuffle, so a leg with many rows arrives as
    one row for each of its spellings.
    """
    named = rows.groupBy("leg_id", "vessel_id").agg(F.count("*").alias("n"))
    known = with_registered(named, vessels).where("_vessel is not null")
    per = known.groupBy("leg_id", "_vessel").agg(F.sum("n").alias("n"))
    return per.groupBy("leg_id").agg(F.min_by("_vessel", F.struct(-F.col("n"), F.col("_vessel"))).alias("vessel_id"))


def leg_series(partition_rows: DataFrame, vessels: DataFrame, max_gap: int = 12) -> DataFrame:
    """The regular fuel series of each leg, with the leg's vessel."""
    series = regular_series(partition_rows, source="leg_id", time="time_index", value="total_momentary_fuel", max_gap=max_gap)
    return series.join(vessel_of_leg(partition_rows, vessels), "leg_id", "left").select(
        "leg_id", "vessel_id", "slot", "total_momentary_fuel", "n_readings", "how"
    )


def empty_slots(partition_rows: DataFrame, vessels: DataFrame) -> DataFrame:
    """(leg_id, vessel_id, slot) of each slot of a leg that holds no reading."""
    return leg_series(partition_rows, vessels).where("how <> 'reading'").select("leg_id", "vessel_id", "slot")
