"""Missing values filled from similar records, by low-rank alternating least squares.

Records (or groups of records) are rows of a matrix, their encoded features are
its columns: numbers are standardised, angles become sine and cosine, a category
becomes a fixed code vector, and the means of the record's group and time are
further columns. The matrix is approximated as U Vt from its observed cells
only; U is solved row by row, V column by column from sums over all rows, in
turn. A missing cell is decoded from its row's factor to a valid value: a number
within the observed range, a direction in [0, 360), a name of the register.
Every filled cell keeps a flag.

Distribution: factors of rows are never stored or moved; each pass solves them
inside its Arrow batch. V has (columns x rank) numbers and lives on the driver;
its normal equations are summed by key before they are collected, so the driver
gets ``columns * (rank^2 + rank)`` numbers whatever the input. The context of a
record is joined on (source, hour), which spreads a hot source over its hours.

Defined results: NaN counts as missing; a record without any observed cell gets
the column means; a group without any known category gets the register's entry
nearest to what its numbers decode to; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidewright.functions.arrow import floats
from tidewright.functions.names import register_names, squeezed
from tidewright.operators.telemetry import coded, collect_codes, null_nan, with_vessel
from tidewright.session import small, stage

RANK, SWEEPS, RIDGE = 6, 2, 0.05

#: Steps of 5 minutes in the time group of a record.
HOUR = 12


@dataclass
class LowRank:
    """A fitted model: standardisation and column factors."""

    names: list[str]
    mean: np.ndarray
    std: np.ndarray
    factors: np.ndarray  # (columns, rank)
    ridge: float

    def scaled(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        seen = ~np.isnan(x)
        return np.where(seen, (x - self.mean) / self.std, 0.0), seen

    def rows(self, z: np.ndarray, seen: np.ndarray) -> np.ndarray:
        """Row factors by ridge least squares over each row's observed cells."""
        v = self.factors
        r = v.shape[1]
        outer = (v[:, :, None] * v[:, None, :]).reshape(len(v), r * r)
        a = (seen @ outer).reshape(-1, r, r) + self.ridge * np.eye(r)
        return np.linalg.solve(a, (z @ v)[:, :, None])[:, :, 0]

    def decode(self, x: np.ndarray, columns: list[int]) -> np.ndarray:
        """The model's values of ``columns`` for rows of raw cells, missing as NaN."""
        z, seen = self.scaled(x)
        return self.rows(z, seen) @ self.factors[columns].T * self.std[columns] + self.mean[columns]


def _sums(df: DataFrame, names: list[str], per_batch, size: int) -> np.ndarray:
    """Vectors of ``size`` numbers made from each batch, summed over all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for b in batches:
            if b.num_rows:
                total += per_batch(floats(b, names))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(total)], names=["k", "v"])

    out = np.zeros(size)
    for k, v in df.select(*names).mapInArrow(run, "k int, v double").groupBy("k").agg(F.sum("v")).collect():
        out[k] = v
    return out


def fit(cells: DataFrame, names: list[str], rank: int = RANK, sweeps: int = SWEEPS, ridge: float = RIDGE) -> LowRank:
    """Fit U Vt to the observed cells of all rows of ``cells``.

    The start is the leading eigenvectors of the pairwise correlations, from
    one pass; each sweep is one pass that solves every row and sums what every
    column's least squares needs.
    """
    n = len(names)
    rank = min(rank, n)

    def moments(x: np.ndarray) -> np.ndarray:
        seen = ~np.isnan(x)
        z, s = np.where(seen, x, 0.0), seen.astype(float)
        return np.concatenate([s.sum(0), z.sum(0), (s.T @ s).ravel(), (z.T @ z).ravel(), (z.T @ s).ravel()])

    m = _sums(cells, names, moments, 2 * n + 3 * n * n)
    count, total = m[:n], m[n : 2 * n]
    both, prod, sum_i = (m[2 * n + i * n * n : 2 * n + (i + 1) * n * n].reshape(n, n) for i in range(3))
    mean = total / np.maximum(count, 1)
    pairs = np.maximum(both, 1)
    cov = prod / pairs - (sum_i / pairs) * (sum_i.T / pairs)
    std = np.sqrt(np.maximum(np.diag(cov), 0.0))
    std = np.where(std > 1e-9, std, 1.0)
    corr = np.where(both > 1, cov / np.outer(std, std), 0.0)
    w, vec = np.linalg.eigh((corr + corr.T) / 2)
    top = np.argsort(w)[::-1][:rank]
    model = LowRank(list(names), mean, std, vec[:, top] * np.sqrt(np.maximum(w[top], 1e-3)), ridge)
    for _ in range(sweeps):

        def normal(x: np.ndarray, model: LowRank = model) -> np.ndarray:
            z, seen = model.scaled(x)
            u = model.rows(z, seen)
            outer = (u[:, :, None] * u[:, None, :]).reshape(len(u), rank * rank)
            return np.concatenate([(seen.T.astype(float) @ outer).ravel(), (z.T @ u).ravel()])

        s = _sums(cells, names, normal, n * rank * rank + n * rank)
        a = s[: n * rank * rank].reshape(n, rank, rank) + ridge * np.eye(rank)
        b = s[n * rank * rank :].reshape(n, rank)
        model = LowRank(model.names, mean, std, np.linalg.solve(a, b[:, :, None])[:, :, 0], ridge)
    return model


# ---- numeric cells of records ------------------------------------------------------------------

OWN = ("wave", "wd_sin", "wd_cos", "sd_sin", "sd_cos", "period", "wind")
AROUND = tuple(f"h_{c}" for c in OWN[:6])
CELLS = (*OWN, *AROUND)


def missing_wave(df: DataFrame, codes: list[tuple[str, float]]) -> Column:
    w = F.col("wave_height")
    return w.isNull() | F.isnan(w) | coded(df, codes)


def missing_direction(c: Column) -> Column:
    return c.isNull() | F.isnan(c) | (c < 0) | (c > 360)


def encoded_records(records: DataFrame, vessels: DataFrame) -> DataFrame:
    """One row for each record: row_id, _vessel, which of the two cells are missing, and CELLS."""
    cols = ("row_id", "vessel_id", "leg_id", "time_index", "wave_height", "wind_direction", "wave_direction", "wave_period", "wind_speed")
    r = with_vessel(records.select(*cols), vessels)
    codes = collect_codes(r)
    f = lambda c: c.cast("float")
    no_wave, no_wd, no_sd = missing_wave(r, codes), missing_direction(F.col("wind_direction")), missing_direction(F.col("wave_direction"))
    # what cannot be (a spike of problem 2) must not colour its surroundings
    wave = F.when(~no_wave & (F.col("wave_height") >= 0) & (F.col("wave_height") <= 25), F.log1p("wave_height"))
    wd, sd = F.radians(F.when(~no_wd, F.col("wind_direction"))), F.radians(F.when(~no_sd, F.col("wave_direction")))
    per, wind = null_nan(F.col("wave_period")), null_nan(F.col("wind_speed"))
    r = r.select(
        "row_id", "_source", "_vessel", "leg_id", no_wave.alias("no_wave"), no_wd.alias("no_wd"),
        F.coalesce(F.expr(f"time_index div {HOUR}"), -F.xxhash64("leg_id")).alias("_hour"),
        f(wave).alias("wave"), f(F.sin(wd)).alias("wd_sin"), f(F.cos(wd)).alias("wd_cos"), f(F.sin(sd)).alias("sd_sin"), f(F.cos(sd)).alias("sd_cos"),
        f(F.when((per > 0) & (per < 40), per)).alias("period"), f(F.when((wind >= 0) & (wind <= 60), wind)).alias("wind"),
    )
    around = r.groupBy("_source", "_hour").agg(*[F.avg(c).cast("float").alias(f"h_{c}") for c in OWN[:6]])
    return r.join(around, ["_source", "_hour"]).select("row_id", "_source", "_vessel", "leg_id", "no_wave", "no_wd", *CELLS)


def filled_records(records: DataFrame, vessels: DataFrame) -> DataFrame:
    """row_id, vessel_id, wave_height and wind_direction with missing ones filled, and a flag for each.

    vessel_id is the register's name; where a row names no vessel it is filled
    by its leg.
    """
    cells = stage(encoded_records(records, vessels))
    model = fit(cells, list(CELLS))
    at = [CELLS.index("wave"), CELLS.index("wd_sin"), CELLS.index("wd_cos")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = model.decode(floats(b, list(CELLS)), at) if b.num_rows else np.zeros((0, 3))
            wave = np.round(np.clip(np.expm1(v[:, 0]), 0.0, 25.0), 2)
            wd = np.round(np.degrees(np.arctan2(v[:, 1], v[:, 2])) % 360.0) % 360.0
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(5)), pa.array(wave), pa.array(wd)], names=["row_id", "_vessel", "leg_id", "no_wave", "no_wd", "wave", "wd"])

    wanted = cells.where("no_wave or no_wd").select("row_id", "_vessel", "leg_id", "no_wave", "no_wd", *CELLS)
    decoded = wanted.mapInArrow(run, "row_id long, _vessel string, leg_id long, no_wave boolean, no_wd boolean, wave double, wd double")
    return decoded.select(
        "row_id", "_vessel", "leg_id", F.when(F.col("no_wave"), F.col("wave")).alias("wave_height"), F.when(F.col("no_wd"), F.col("wd")).alias("wind_direction"),
        F.col("no_wave").alias("wave_height_filled"), F.col("no_wd").alias("wind_direction_filled"),
    )


# ---- a category of groups ----------------------------------------------------------------------

CODE = 16


def code_of(name: str, size: int = CODE) -> np.ndarray:
    """A fixed unit vector for a name; different names are far apart."""
    from zlib import crc32

    v = np.random.default_rng(crc32(name.encode())).standard_normal(size)
    return v / np.linalg.norm(v)


def fill_category(rows: DataFrame, register: DataFrame, *, group: str = "leg_id", key: str = "vessel_id", number: str = "total_momentary_fuel") -> DataFrame:
    """(group, filled): the register's entry that each group's factor decodes to.

    A group's cells are the mean codes of the names its rows bear and the mean
    logarithm of a number of theirs. Rows are first counted by (group, name),
    so a hot group reaches its task as one row for each spelling. The register
    is small by nature; its codes go to the workers only within a checked bound.
    """
    names = [r[0] for r in register_names(register, key).select("_name").distinct().limit(BOUND + 1).collect()]
    if len(names) > BOUND:
        raise ValueError(f"the register of {key} holds more than {BOUND} names")
    names = sorted(names)
    if not names:
        return rows.select(group, F.lit(None).cast("string").alias("filled")).limit(0)
    codes = np.stack([code_of(n) for n in names])
    n = F.col(number)
    good = n.isNotNull() & ~F.isnan(n) & (n >= 0)
    per = rows.groupBy(group, squeezed(F.col(key)).alias("_k")).agg(
        F.count("*").alias("n"), F.sum(F.when(good, F.log1p(n))).alias("s"), F.count(F.when(good, 1)).alias("m")
    )
    lookup = register_names(register, key)
    known = per.join(small(lookup), per["_k"] == lookup["_key"], "left").select(group, F.col("_name").alias("name"), "n", "s", "m")
    table = known.groupBy(group).agg(F.collect_list(F.when(F.col("name").isNotNull(), F.struct("name", "n"))).alias("names"), (F.sum("s") / F.sum("m")).alias("number"))
    cols = [f"c{i}" for i in range(CODE)] + ["number"]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = {x: i for i, x in enumerate(names)}
        for b in batches:
            x = np.full((b.num_rows, CODE + 1), np.nan)
            for i, got in enumerate(b.column(1).to_pylist()):
                if got:
                    w = np.array([g["n"] for g in got], float)
                    x[i, :CODE] = (w @ codes[[at[g["name"]] for g in got]]) / w.sum()
            x[:, CODE] = b.column(2).to_numpy(zero_copy_only=False).astype(float)
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(x[:, j]) for j in range(CODE + 1)]], names=["g", *cols])

    kind = dict(rows.dtypes)[group]
    cells = stage(table.mapInArrow(encode, f"g {kind}, " + ", ".join(f"{c} double" for c in cols)))
    model = fit(cells, cols, rank=10, ridge=1e-3)
    # decode in the model's own terms: what it makes of each register entry's full code
    ideal = model.decode(np.hstack([codes, np.full((len(names), 1), np.nan)]), list(range(CODE)))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = model.decode(floats(b, cols), list(range(CODE))) if b.num_rows else np.zeros((0, CODE))
            near = nearest(got, ideal)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([names[i] for i in near], pa.string())], names=[group, "filled"])

    return cells.mapInArrow(decode, f"{group} {kind}, filled string")


def nearest(got: np.ndarray, ideal: np.ndarray, rows: int = 1024, names: int = 4096) -> np.ndarray:
    """The nearest row of ``ideal`` to each row of ``got``: |g|^2 - 2 g.c + |c|^2 as matrix products in slices of both, ties to the first."""
    out = np.zeros(len(got), np.int64)
    for a in range(0, len(got), rows):
        g = got[a : a + rows]
        best = np.full(len(g), np.inf)
        for b in range(0, len(ideal), names):
            c = ideal[b : b + names]
            far = (c * c).sum(1) - 2 * (g @ c.T)  # |g|^2 is the same for all
            i = far.argmin(1)
            d = far[np.arange(len(g)), i]
            closer = d < best
            out[a : a + rows][closer] = i[closer] + b
            best[closer] = d[closer]
    return out


#: Names a register may hold for its codes to be sent to every worker (16 numbers each).
BOUND = 100_000


def missing_category(rows: DataFrame, register: DataFrame, key: str = "vessel_id") -> DataFrame:
    """``rows`` whose ``key`` is null, blank or names nothing in the register."""
    names = register_names(register, key).select("_key")
    k = rows.withColumn("_k", squeezed(F.col(key)))
    return k.join(small(names), k["_k"] == names["_key"], "left_anti").drop("_k")


# ---- problem 1 ---------------------------------------------------------------------------------


def fill_all(records: DataFrame, partition_rows: DataFrame, vessels: DataFrame) -> DataFrame:
    """One row for each missing cell with the value it was filled with.

    (table_name, row_id, field_name, vessel_id, filled_number, filled_text);
    vessel_id is the vessel the row belongs to.
    """
    got = filled_records(records, vessels)
    nameless = missing_category(records.select("leg_id", "vessel_id", "total_momentary_fuel"), vessels).limit(1)
    if not nameless.isEmpty():
        legs = fill_category(records.select("leg_id", "vessel_id", "total_momentary_fuel"), vessels)
        got = got.join(legs, "leg_id", "left").withColumn("_vessel", F.coalesce("_vessel", "filled")).drop("filled")
    of_records = got.select(
        F.lit("vessel_records").alias("table_name"), "row_id", F.col("_vessel").alias("vessel_id"),
        F.explode(F.filter(F.array(
            F.when(F.col("wave_height_filled"), F.struct(F.lit("wave_height").alias("f"), F.col("wave_height").alias("x"))),
            F.when(F.col("wind_direction_filled"), F.struct(F.lit("wind_direction").alias("f"), F.col("wind_direction").alias("x"))),
        ), lambda s: s.isNotNull())).alias("s"),
    ).select("table_name", "row_id", F.col("s.f").alias("field_name"), "vessel_id", F.col("s.x").alias("filled_number"), F.lit(None).cast("string").alias("filled_text"))
    legs = fill_category(partition_rows, vessels)
    gone = missing_category(partition_rows.select("row_id", "leg_id", "vessel_id"), vessels).select("row_id", "leg_id")
    of_parts = gone.join(legs, "leg_id", "left").select(
        F.lit("partition_rows").alias("table_name"), "row_id", F.lit("vessel_id").alias("field_name"), F.col("filled").alias("vessel_id"),
        F.lit(None).cast("double").alias("filled_number"), F.col("filled").alias("filled_text"),
    )
    return of_records.unionByName(of_parts)
