"""Fitted transforms. Every ``fit`` sees training rows only; transforms are projections."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewright.functions import angles, parse
from tidewright.operators.badrows import FEATURES
from tidewright.session import small, stage

DIRECTION = "wind_direction"
CLASSICAL = ("speed_over_ground", "wind_speed", "wind_direction_sin", "wind_direction_cos", "wave_height", "wave_period", "current_speed")


def grouped_medians(df: DataFrame, columns: list[str], by: tuple[str, ...] = (), within: int = 1 << 16) -> DataFrame:
    """(by, column, value): the exact median of each column over its non-missing values, by group; no row where there is none.

    Each of the two middle values is narrowed down: the values still in
    question are counted in 4,096 ranges of equal width, and only the range
    that holds the middle remains, until it holds at most ``within`` values;
    those are ranked. A pass moves one row a range, and no task sees more than
    ``within`` values of a group and column.
    """
    pick = F.filter(F.array(*[F.struct(F.lit(c).alias("column"), parse.finite(F.col(f"`{c}`").cast("double")).alias("x")) for c in columns]), lambda s: s["x"].isNotNull())
    key = [*by, "column"]
    cells = stage(df.select(*by, F.explode(pick).alias("s")).select(*by, "s.column", "s.x").groupBy(*key, "x").agg(F.count("*").alias("k")))
    ends = cells.groupBy(*key).agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.sum("k").alias("n"), F.count("*").alias("m"))
    # one row for each group, column and wanted rank: the range in question, the values below it and in it
    wanted = F.explode(F.array_distinct(F.array(F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)))).alias("rank")
    state = stage(ends.select(*key, "lo", "hi", "m", F.lit(0).cast("long").alias("below"), wanted))
    one = [*key, "rank"]
    reached = lambda c: (F.col("upto") - F.col(c) <= F.col("rank")) & (F.col("upto") > F.col("rank"))
    for _ in range(64):
        wide = state.where(F.col("m") > within)
        if wide.isEmpty():
            break
        slot = F.least(F.floor((F.col("x") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / 4096)), F.lit(4095)).cast("int")
        ranges = _inside(cells, wide, key).groupBy(*one, "below", slot.alias("slot")).agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.sum("k").alias("k"), F.count("*").alias("m"))
        at = ranges.withColumn("upto", F.col("below") + F.sum("k").over(Window.partitionBy(*one).orderBy("slot")))
        narrowed = at.where(reached("k")).withColumn("below", F.col("upto") - F.col("k"))
        state = stage(state.where(F.col("m") <= within).unionByName(narrowed.select(state.columns)))
    at = _inside(cells, state, key).withColumn("upto", F.col("below") + F.sum("k").over(Window.partitionBy(*one).orderBy("x")))
    return at.where(reached("k")).groupBy(*key).agg(F.avg("x").alias("value"))


def _inside(cells: DataFrame, state: DataFrame, key: list[str]) -> DataFrame:
    """Cells of the ranges in question, with the columns of ``state``."""
    s = small(state.withColumnsRenamed({c: f"_{c}" for c in key}))
    on = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key]
    return cells.join(s, [*on, F.col("x") >= F.col("lo"), F.col("x") <= F.col("hi")]).drop("m", *[f"_{c}" for c in key])


def exact_medians(df: DataFrame, columns: list[str]) -> dict[str, float | None]:
    """The exact median of each column over its non-missing values; None if there is none."""
    if not columns:
        return {}
    got = {r["column"]: r["value"] for r in grouped_medians(df, columns).collect()}  # one row a column
    return {c: got.get(c) for c in columns}


@dataclass
class Imputer:
    """Medians for five features, the circular mean for the direction."""

    fills: dict[str, float] = field(default_factory=dict)

    @classmethod
    def fit(cls, train: DataFrame, features: tuple[str, ...] = FEATURES) -> "Imputer":
        fills = dict(exact_medians(train, [f for f in features if f != DIRECTION]))
        if DIRECTION in features:
            fills[DIRECTION] = train.agg(angles.circular_mean(parse.finite(F.col(DIRECTION)))).first()[0]
        empty = sorted(f for f, x in fills.items() if x is None)
        if empty:
            raise ValueError(f"no training value of {', '.join(empty)}")
        return cls(fills)

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({f: F.coalesce(parse.finite(F.col(f)), F.lit(x)) for f, x in self.fills.items()} | {f"{f}_was_missing": parse.finite(F.col(f)).isNull() for f in self.fills})


def encoded_direction(df: DataFrame) -> DataFrame:
    """The direction as sine and cosine: six features become seven."""
    return df.withColumns({f"{DIRECTION}_sin": angles.sine(F.col(DIRECTION)), f"{DIRECTION}_cos": angles.cosine(F.col(DIRECTION))})


@dataclass
class Standardizer:
    """Mean 0 and population deviation 1; a constant column is only centred."""

    stats: dict[str, tuple[float, float]]

    @classmethod
    def fit(cls, train: DataFrame, columns: tuple[str, ...]) -> "Standardizer":
        r = train.agg(*[f(c).alias(f"{n}_{i}") for i, c in enumerate(columns) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
        return cls({c: (r[f"m_{i}"], r[f"s_{i}"] or 1.0) for i, c in enumerate(columns)})

    def transform(self, df: DataFrame, prefix: str = "z_") -> DataFrame:
        return df.withColumns({prefix + c: (F.col(c) - m) / s for c, (m, s) in self.stats.items()})


def classical_features(p: DataFrame) -> tuple[DataFrame, Imputer, Standardizer]:
    """Imputed, encoded and standardised features of a split, fitted on its training rows: the seven of the classical models."""
    train = p.where("split = 'train'")
    imputer = Imputer.fit(train)
    scaler = Standardizer.fit(encoded_direction(imputer.transform(train)), CLASSICAL)
    return scaler.transform(encoded_direction(imputer.transform(p))), imputer, scaler


@dataclass
class MinMax:
    """Linear scaling by the training range."""

    ranges: dict[str, tuple[float, float]]

    @classmethod
    def fit(cls, train: DataFrame, columns: tuple[str, ...]) -> "MinMax":
        r = train.agg(*[f(c).alias(f"{n}_{i}") for i, c in enumerate(columns) for n, f in (("a", F.min), ("b", F.max))]).first()
        if any(r[f"a_{i}"] is None for i in range(len(columns))):
            raise ValueError("a column has no training value")
        return cls({c: (r[f"a_{i}"], r[f"b_{i}"]) for i, c in enumerate(columns)})

    def scaled(self, c: str, a: float, b: float, clip: bool) -> Column:
        low, high = self.ranges[c]
        return angles.scaled(F.col(c), F.lit(low), F.lit(high), a, b, clip)


def angle_features(df: DataFrame, ranges: MinMax) -> DataFrame:
    """Six rotation angles: five in [0, pi], the direction as radians."""
    return df.withColumns({f"a_{f}": F.radians(F.col(f)) if f == DIRECTION else ranges.scaled(f, 0.0, math.pi, True) for f in FEATURES})


def target_scaled(df: DataFrame, ranges: MinMax, target: str) -> DataFrame:
    """The target in [-1, 1] by its training range."""
    low, high = ranges.ranges[target]
    if not high > low:
        raise ValueError("a constant target cannot be scaled")
    return df.withColumn(f"{target}_scaled", ranges.scaled(target, -1.0, 1.0, False))


@dataclass
class OneHot:
    """Mode-filled categories as 0/1 columns; what training did not hold is all zeros."""

    mode: str
    values: list[str]

    #: Categories a column may have to be spread into columns.
    LIMIT = 1000

    @classmethod
    def fit(cls, train: DataFrame, column: str) -> "OneHot":
        counts = train.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
        got = counts.orderBy(F.desc("n"), column).limit(cls.LIMIT + 1).collect()
        if not got or len(got) > cls.LIMIT:
            raise ValueError(f"{column} has no category, or more than {cls.LIMIT}")
        return cls(got[0][0], sorted(r[0] for r in got))

    def transform(self, df: DataFrame, column: str) -> DataFrame:
        filled = F.coalesce(F.col(column), F.lit(self.mode))
        return df.withColumns({f"{column}_{v}": (filled == v).cast("int") for v in self.values})


def correlations(df: DataFrame, columns: list[str]) -> dict[tuple[str, str], float | None]:
    """Pearson correlation of each pair over rows where both are present, in one pass.

    None where one of them is constant.
    """
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    aggs = []
    for i, (a, b) in enumerate(pairs):
        x, y = (F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), F.col(c)) for c in (a, b))
        aggs.append(F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)).alias(f"r{i}"))
    r = df.agg(*aggs).first()
    return {p: r[f"r{i}"] for i, p in enumerate(pairs)}


def leak_warnings(df: DataFrame, features: list[str], target: str, limit: float = 0.9999, top: int = 10) -> list[str]:
    """Features that mirror the target, and the first ten pairs that mirror each other."""
    r = correlations(df, [*features, target])
    leaks = [f"{a} mirrors {target}" for (a, b), x in r.items() if b == target and x is not None and abs(x) > limit]
    pairs = [f"{a} mirrors {b}" for (a, b), x in r.items() if b != target and x is not None and abs(x) > limit]
    return leaks + pairs[:top]
