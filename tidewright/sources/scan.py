"""Scans with declared schemas."""

from __future__ import annotations

import hashlib
import os
import re

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tidewright.functions.identity import content_hash, schema_fingerprint
from tidewright.operators.badrows import FEATURES, SNAPSHOT_COLUMNS
from tidewright.operators.canonical import TARGET
from tidewright.sources import publish

#: Versions and hashes. Fixed patterns.
VERSION, HASH = re.compile(r"[0-9a-f]{40}"), re.compile(r"[0-9a-f]{64}")

#: Units of the canonical columns, kept as schema metadata. Fixed values.
UNITS = {
    "time_index": "5 min", "speed_over_ground": "m/s", "wind_speed": "m/s", "wind_direction": "degrees", "wave_height": "m",
    "wave_period": "s", "current_speed": "m/s", TARGET: "kg/s",
}

CANONICAL_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType(), False) for c in ("record_id", "dataset_version", "vessel_id")]
    + [T.StructField("time_index", T.LongType(), False, {"unit": UNITS["time_index"]})]
    + [T.StructField(c, T.DoubleType(), True, {"unit": UNITS[c]}) for c in FEATURES]
    + [T.StructField(TARGET, T.DoubleType(), False, {"unit": UNITS[TARGET]})]
)


def require_schema(df: DataFrame, time: str, numeric: tuple[str, ...]) -> None:
    """Required columns are there, time is integral, the others are numbers."""
    kinds = {f.name: f.dataType for f in df.schema}
    missing = [c for c in (time, *numeric) if c not in kinds]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    if not isinstance(kinds[time], T.IntegralType):
        raise ValueError(f"{time} must be an integer")
    bad = [c for c in numeric if not isinstance(kinds[c], T.NumericType)]
    if bad:
        raise ValueError(f"not numeric: {', '.join(bad)}")


def pinned_entities(spark: SparkSession, folder: str, entities: list[str], version: str, time: str = "index") -> tuple[DataFrame, dict]:
    """One Parquet folder for each entity, in order, as raw rows, and a manifest.

    Rows pass through as they are; only the raw columns are read.
    """
    if not VERSION.fullmatch(version):
        raise ValueError("a version is forty hexadecimal digits")
    parts, prints = [], {}
    for e in entities:
        df = spark.read.parquet(os.path.join(folder, e))
        require_schema(df, time, SNAPSHOT_COLUMNS[2:])
        prints[e] = schema_fingerprint(df)
        parts.append(df.select(F.lit(e).alias("vessel_id"), F.col(time).cast("string").alias("time_index"), *[F.col(c).cast("string").alias(c) for c in SNAPSHOT_COLUMNS[2:]]))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    counts = {r[0]: r[1] for r in out.groupBy("vessel_id").agg(F.count("*")).collect()}  # one row an entity
    manifest = {
        "dataset_version": version, "entities": entities, "raw_columns": list(SNAPSHOT_COLUMNS), "row_counts": counts, "total_rows": sum(counts.values()),
        "schema_fingerprints": prints, "schema_fingerprint": combined(prints, entities), "content_hash": content_hash(out),
    }
    return out, manifest


def combined(prints: dict[str, str], entities: list[str]) -> str:
    """One fingerprint over those of all entities in order."""
    return hashlib.sha256("".join(prints[e] for e in entities).encode()).hexdigest()


def ingest(spark: SparkSession, folder: str, entities: list[str], version: str, target: str) -> str:
    """Copy pinned rows and their manifest to a new stage; what happens to the source later does not matter.

    The manifest is made from the copy, so it describes what was read.
    """

    def write(at: str) -> None:
        rows, manifest = pinned_entities(spark, folder, entities, version)
        rows.write.parquet(f"{at}/rows")
        copy = spark.read.parquet(f"{at}/rows")
        if content_hash(copy) != manifest["content_hash"]:
            raise ValueError("the source changed while it was copied")
        publish.write_json(spark, f"{at}/manifest.json", manifest | {"columns": describe(copy)})

    return publish.publish(spark, target, write)


def snapshot(spark: SparkSession, path: str, version: str) -> DataFrame:
    """The rows of an ingested stage, if its manifest holds and the rows still have the hash it names."""
    manifest = publish.read_json(spark, f"{path}/manifest.json")
    check_manifest(manifest, manifest.get("entities") or [])
    rows = spark.read.parquet(f"{path}/rows")
    if manifest["dataset_version"] != version or content_hash(rows) != manifest["content_hash"]:
        raise ValueError("the snapshot is not the one its manifest describes")
    return rows


def check_manifest(manifest: dict, entities: list[str]) -> None:
    """Raise on a manifest that contradicts itself or the expected entities."""
    if not VERSION.fullmatch(str(manifest.get("dataset_version"))):
        raise ValueError("manifest: version")
    if manifest.get("entities") != entities or manifest.get("raw_columns") != list(SNAPSHOT_COLUMNS):
        raise ValueError("manifest: entities or columns")
    counts = manifest.get("row_counts") or {}
    if set(counts) != set(entities) or any(not isinstance(n, int) or n <= 0 for n in counts.values()):
        raise ValueError("manifest: row counts")
    if manifest.get("total_rows") != sum(counts.values()):
        raise ValueError("manifest: total")
    prints = manifest.get("schema_fingerprints") or {}
    if set(prints) != set(entities) or manifest.get("schema_fingerprint") != combined(prints, entities):
        raise ValueError("manifest: fingerprints")
    if not HASH.fullmatch(str(manifest.get("content_hash"))):
        raise ValueError("manifest: content hash")


def raw_csv(spark: SparkSession, path: str) -> DataFrame:
    """A snapshot file whose header is exactly the raw columns; a malformed row is an error."""
    header = spark.read.option("header", True).csv(path).columns
    if header != list(SNAPSHOT_COLUMNS):
        raise ValueError("the snapshot's columns are not the raw columns in order")
    schema = ", ".join(f"`{c}` string" for c in SNAPSHOT_COLUMNS)
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").option("nullValue", "\0").option("enforceSchema", False).csv(path).na.fill("")


def generic(spark: SparkSession, path: str) -> DataFrame:
    """A CSV or Parquet file by its suffix; an empty one is an error."""
    kind = os.path.splitext(path.rstrip("/"))[1].lower()
    if kind == ".csv":
        df = spark.read.option("header", True).option("inferSchema", True).csv(path)
    elif kind == ".parquet":
        df = spark.read.parquet(path)
    else:
        raise ValueError("only .csv and .parquet files are read")
    if df.isEmpty():
        raise ValueError(f"{path} holds no rows")
    return df


def canonical(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CANONICAL_SCHEMA).parquet(path)


def partition(spark: SparkSession, path: str, part: str) -> DataFrame:
    """One part of a saved split; only its folder is opened. The test part needs ``frozen_test``."""
    if part not in ("train", "validation"):
        raise ValueError("only training and validation rows may be read here")
    return spark.read.parquet(path).where(F.col("split") == part)


def frozen_test(spark: SparkSession, path: str, selection: dict) -> DataFrame:
    """The test part, once a champion has been frozen."""
    if not selection.get("champion") or selection.get("test_used"):
        raise ValueError("test rows are read once, after a champion is frozen")
    return spark.read.parquet(path).where(F.col("split") == "test")


def describe(df: DataFrame) -> dict:
    return {"rows": df.count(), "columns": len(df.columns), "names": df.columns}
