"""Rows that fail to parse: typed rows and faulty lines, each with its reason.

Method: records are assembled quote-aware, each record is parsed by Python's
strict ``csv`` reader inside ``mapInArrow`` (the Arrow form of mapPartitions),
structural exceptions become reasons, and only what is structurally sound
reaches the typed constructors of the fields.

Defined results: a null text is an empty line (``column_count``); a file's
header line (line_no 1) is neither typed nor faulty, a header repeated further
down fails at ``time_index``; repeated lines count each time; an empty table
gives empty results; other columns of the input are not carried.
"""

from __future__ import annotations

import csv
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

#: Column order of a snapshot line and of a canonical record. Fixed values.
SNAPSHOT_COLUMNS = (
    "vessel_id", "time_index", "Ship_SpeedOverGround", "Weather_WindSpeed10M", "Weather_WindDirection10M",
    "Weather_WaveHeight", "Weather_WavePeriod", "Weather_OceanCurrentVelocity", "Consumer_Total_MomentaryFuel",
)
FEATURES = ("speed_over_ground", "wind_speed", "wind_direction", "wave_height", "wave_period", "current_speed")

REASONS = ("quoting", "column_count", "time_index", "fuel")

_NUMBER = re.compile(r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?")
_WELL_QUOTED = re.compile(r'(?:(?<=,)|^)"(?:[^"]|"")*"(?=,|$)')

csv.field_size_limit(1 << 31)  # texts may be long

_OUT = "line_id long, reason string, vessel_id string, time_index long, " + ", ".join(f"{f} double" for f in (*FEATURES, "fuel_consumption_kg_s"))


class Structure(Exception):
    """A record that is no list of nine fields; its text is the reason."""


def split_fields(line: str) -> list[str]:
    """The fields of one record, or ``Structure``.

    The strict reader refuses text after a closing quote and quotes left open,
    but lets a quote stand inside a bare field; what remains after well-quoted
    fields are taken out must hold no quote.
    """
    try:
        rows = list(csv.reader((line,), strict=True))
    except csv.Error as e:
        raise Structure("quoting") from e
    if '"' in line and '"' in _WELL_QUOTED.sub("", line):
        raise Structure("quoting")
    fields = rows[0] if len(rows) == 1 else []
    if len(fields) != len(SNAPSHOT_COLUMNS):
        raise Structure("column_count")
    return fields


def plain_number(text: str) -> float | None:
    """A finite number written plainly, or None."""
    text = text.strip()
    if not _NUMBER.fullmatch(text):
        return None
    x = float(text)
    return x if math.isfinite(x) else None


def whole_time(text: str) -> int:
    """A step number: plain, finite, not negative, whole and within 64 bits."""
    from decimal import Decimal

    x = plain_number(text)
    if x is None or x < 0:
        raise Structure("time_index")
    d = Decimal(text.strip())
    if d == 0:
        return 0
    if not 0 <= d.adjusted() <= 18 or d != d.to_integral_value() or d >= 1 << 63:
        raise Structure("time_index")
    return int(d)


def fuel(text: str) -> float:
    x = plain_number(text)
    if x is None or x < 0:
        raise Structure("fuel")
    return x


def feature(name: str, text: str) -> float | None:
    """A weather or speed value; what is unusable or out of range becomes null."""
    x = plain_number(text)
    if x is None or x < 0 or (name == "wind_direction" and x > 360) or (name == "wave_period" and x == 0):
        return None
    return x


def typed(fields: list[str]) -> tuple:
    """The values of a record; the first field that fails gives the reason."""
    t = whole_time(fields[1])
    kg_s = fuel(fields[8])
    return (fields[0].strip().lower(), t, *(feature(n, x) for n, x in zip(FEATURES, fields[2:8])), kg_s)


def one_line(text: str | None) -> str:
    """A line's record: no line end, byte order mark or inner line breaks."""
    line = (text or "").rstrip("\r\n").lstrip("﻿")
    return line.replace("\r", " ").replace("\n", " ") if "\r" in line or "\n" in line else line


def assembled(lines: DataFrame, stretch: int = 4096) -> DataFrame:
    """Records of files whose fields may hold line ends, from their physical lines (line_id, file_name, line_no, raw_text).

    A line whose quotes are left open goes on in the next one, as RFC 4180 has
    it: a line begins a record if the quotes of its file before it are even in
    number. A record has the id and number of its first line. Quotes are
    counted by stretches of lines first, so a long file is cut among tasks.
    A line without a file or number is a record by itself.
    """
    own = F.col("file_name").isNull() | F.col("line_no").isNull()
    d = lines.select("line_id", "file_name", "line_no", F.coalesce("raw_text", F.lit("")).alias("raw_text"))
    d = d.withColumn("_q", F.length("raw_text") - F.length(F.replace("raw_text", F.lit('"'), F.lit("")))).withColumn("_s", F.expr(f"line_no div {stretch}"))
    d, single = d.where(~own), d.where(own).select("line_id", "file_name", "line_no", "raw_text")
    per = d.groupBy("file_name", "_s").agg(F.sum("_q").alias("_n"))
    earlier = Window.partitionBy("file_name").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(F.col("file_name").alias("_f"), F.col("_s").alias("_t"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    d = d.join(per, (F.col("file_name") == F.col("_f")) & (F.col("_s") == F.col("_t")))
    inside = Window.partitionBy("file_name", "_s").orderBy("line_no", "line_id")
    d = d.withColumn("_odd", (F.col("_before") + F.coalesce(F.sum("_q").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))) % 2)
    # the first line of a line's record: the last even one up to it, in this stretch or the ones before
    place = F.struct("line_no", "line_id")
    d = d.withColumn("_first", F.max(F.when(F.col("_odd") == 0, place)).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    last = d.groupBy("file_name", "_s").agg(F.max(F.when(F.col("_odd") == 0, place)).alias("_l"))
    last = last.select(F.col("file_name").alias("_g"), F.col("_s").alias("_u"), F.max("_l").over(earlier).alias("_carried"))
    d = d.join(last, (F.col("file_name") == F.col("_g")) & (F.col("_s") == F.col("_u"))).withColumn("_first", F.coalesce("_first", "_carried"))
    parts = F.sort_array(F.collect_list(F.struct("line_no", "line_id", "raw_text")))
    whole = d.groupBy("file_name", F.col("_first.line_no").alias("line_no"), F.col("_first.line_id").alias("line_id")).agg(F.array_join(F.transform(parts, lambda p: p["raw_text"]), "\n").alias("raw_text"))
    return whole.select("line_id", "file_name", "line_no", "raw_text").unionByName(single)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    csv.field_size_limit(1 << 31)
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), *[pa.float64()] * 7]
    names = ["line_id", "reason", "vessel_id", "time_index", *FEATURES, "fuel_consumption_kg_s"]
    for batch in batches:
        rows = []
        for line_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            try:
                rows.append((line_id, None, *typed(split_fields(one_line(text)))))
            except Structure as why:
                rows.append((line_id, str(why), *[None] * 9))
        cols = list(zip(*rows)) if rows else [()] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)


def parse_lines(lines: DataFrame, multiline: bool = False) -> DataFrame:
    """Every data line of ``lines`` (line_id, line_no, raw_text) parsed once.

    With ``multiline`` the lines are first assembled into records, for files
    whose quoted fields may hold line ends. Snapshot files have one record a
    line, and a quote left open there is the fault of its own line only.

    ``reason`` is null for typed rows. One pass, no shuffle: the scan reads
    three columns and each task keeps one Arrow batch.
    """
    lines = assembled(lines) if multiline else lines
    return lines.where("line_no is null or line_no <> 1").select("line_id", "raw_text").mapInArrow(_parse, _OUT)


def faulty_lines(lines: DataFrame) -> DataFrame:
    """line_id and reason of each line that cannot become a canonical record."""
    return parse_lines(lines).where("reason is not null").select("line_id", "reason")


def valid_rows(lines: DataFrame) -> DataFrame:
    """All other data lines as typed rows."""
    return parse_lines(lines).where("reason is null").drop("reason")


def fault_summary(lines: DataFrame) -> DataFrame:
    """Lines by reason, typed ones under ``valid``; they add up to all data lines."""
    return parse_lines(lines).groupBy(F.coalesce("reason", F.lit("valid")).alias("reason")).agg(F.count("*").alias("n_lines"))
