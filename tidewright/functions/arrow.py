"""Helpers for Arrow-batched Python stages."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, types as T


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """``mapInArrow`` without a shuffle; the partitioning of ``df`` stays."""
    return df.mapInArrow(fn, schema)


def floats(batch: pa.RecordBatch, names: list[str]):
    """A (rows, names) float64 array of the batch's columns, null as NaN."""
    import numpy as np

    out = np.empty((batch.num_rows, len(names)))
    for j, n in enumerate(names):
        out[:, j] = batch.column(batch.schema.get_field_index(n)).to_numpy(zero_copy_only=False).astype(float, copy=False)
    return out
