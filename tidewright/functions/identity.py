"""Identities of records, rows, schemas and ordered lists."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, functions as F


def _prefixed(c: Column) -> Column:
    """A field's UTF-8 bytes after their number as eight bytes, so that fields cannot run into each other."""
    return F.concat(F.unhex(F.lpad(F.hex(F.octet_length(c)), 16, "0")), F.encode(c, "UTF-8"))


def record_id(version: Column, entity: Column, step: Column) -> Column:
    """SHA-256 over version, entity and step number as text; null if any is null."""
    return F.sha2(F.concat(*[_prefixed(c.cast("string")) for c in (version, entity, step)]), 256)


def row_id(df: DataFrame, columns: list[str] | None = None) -> Column:
    """SHA-256 over all columns in order; a null differs from every text."""
    parts = [F.coalesce(F.concat(F.encode(F.lit("v"), "UTF-8"), _prefixed(F.col(f"`{c}`").cast("string"))), F.encode(F.lit("n"), "UTF-8")) for c in columns or df.columns]
    return F.sha2(F.concat(*parts), 256)


def schema_fingerprint(df: DataFrame) -> str:
    """SHA-256 of the compact JSON of [name, type] pairs in order."""
    text = json.dumps([list(p) for p in df.dtypes], ensure_ascii=False, separators=(",", ":"))
    return hashlib.sha256(text.encode()).hexdigest()


def content_hash(df: DataFrame, columns: list[str] | None = None) -> str:
    """A hash of a table's rows that does not depend on their order or files.

    Row hashes are summed by their 16 leading words, so one small row reaches
    the driver.
    """
    words = [F.sum(F.conv(F.substring("h", 4 * i + 1, 4), 16, 10).cast("long")).alias(f"w{i}") for i in range(16)]
    r = df.select(row_id(df, columns).alias("h")).agg(F.count("*").alias("n"), *words).first()
    return hashlib.sha256(json.dumps([x or 0 for x in r]).encode()).hexdigest()


def list_digest(df: DataFrame, by: list[str], order: str, item: str, width: int = 8192) -> DataFrame:
    """Digest of each group's items in order of ``order``, a whole number, and of the item.

    SHA-256 of the digests of its stretches of ``width`` one after the other, a
    stretch's digest being that of the JSON list of its items; so a long group
    is digested by many tasks and no row holds all of it. A group's digest
    changes with any item, its place and its number.
    """
    stretch = F.expr(f"`{order}` div {width}")
    items = F.array_sort(F.collect_list(F.struct(order, item)))
    parts = df.groupBy(*by, stretch.alias("_s")).agg(F.sha2(F.to_json(F.transform(items, lambda s: s[item])), 256).alias("d"))
    all_parts = F.array_sort(F.collect_list(F.struct("_s", "d")))
    return parts.groupBy(*by).agg(F.sha2(F.array_join(F.transform(all_parts, lambda s: s["d"]), ""), 256).alias("digest"))
