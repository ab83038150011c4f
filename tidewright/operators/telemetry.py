"""What several operators need to know of telemetry records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidewright.functions.names import register_names, squeezed
from tidewright.session import small

#: A stand-in is a value no sea can have that makes up at least this share of a
#: logger model's impossible readings and comes at least so often.
STAND_IN_SHARE, STAND_IN_COUNT = 0.1, 3

#: Wave heights outside this range (m) are no measurement. Fixed value.
WAVE_RANGE = (0.0, 25.0)


def null_nan(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def with_vessel(records: DataFrame, vessels: DataFrame) -> DataFrame:
    """``records`` plus _vessel (the register's spelling or null), _source (it, or
    the squeezed id as it came), _logger and _design_speed."""
    reg = register_names(vessels).join(
        vessels.groupBy(squeezed(F.col("vessel_id")).alias("_key")).agg(F.min("logger_model").alias("_logger"), F.max("design_speed").alias("_design_speed")), "_key"
    )
    reg = reg.select(F.col("_key").alias("_reg_key"), F.col("_name").alias("_vessel"), "_logger", "_design_speed")
    out = records.withColumn("_reg_key", squeezed(F.col("vessel_id"))).join(small(reg), "_reg_key", "left")
    return out.withColumn("_source", F.coalesce("_vessel", "_reg_key", F.lit(""))).drop("_reg_key")


def stand_in_codes(records: DataFrame, value: str = "wave_height", plausible: tuple[float, float] = WAVE_RANGE) -> DataFrame:
    """(_logger, _code): the fixed values a logger model sends for "no reading".

    Only impossible values are counted, each record once however often it was
    sent, so the shuffle carries the few impossible rows. A code makes up a
    tenth of its model's impossible readings, so a model has at most ten.
    """
    v = F.col(value)
    odd = records.where(v.isNotNull() & ~F.isnan(v) & ((v < plausible[0]) | (v > plausible[1])))
    once = odd.groupBy("_logger", F.col(value).alias("_code"), "_source", "time_index").agg(F.lit(1).alias("one"))
    by_code = once.groupBy("_logger", "_code").agg(F.count("*").alias("n"))
    by_logger = by_code.groupBy("_logger").agg(F.sum("n").alias("total"))
    return by_code.join(by_logger, "_logger").where((F.col("n") >= STAND_IN_COUNT) & (F.col("n") >= STAND_IN_SHARE * F.col("total"))).select("_logger", "_code")


def coded(records: DataFrame, codes: list[tuple[str, float]], value: str = "wave_height") -> Column:
    """Whether ``value`` is its logger's stand-in; ``codes`` are collected stand_in_codes."""
    by: dict[str, list[float]] = {}
    for logger, code in codes:
        by.setdefault(logger, []).append(code)
    hit = F.lit(False)
    for logger, values in by.items():
        hit = hit | ((F.col("_logger") == logger) & F.col(value).isin(values))
    return F.coalesce(hit, F.lit(False))


def collect_codes(records: DataFrame, **kw) -> list[tuple[str, float]]:
    """stand_in_codes on the driver: at most ten for each logger model."""
    return [(r[0], r[1]) for r in stand_in_codes(records, **kw).where("_logger is not null").collect()]
