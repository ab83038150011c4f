"""Chronological and hashed splits, and evenly spaced samples.

Positions within an entity come from counts of time buckets plus a row number
inside each bucket, so an entity with a third of all rows is ranked by as many
tasks as it has buckets.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewright.session import stage

PARTS = ("train", "validation", "test")

#: Groups placed in folds singly, and hash ranges that hold the others.
LARGEST, FOLD_RANGES = 100_000, 1024


def ranked(df: DataFrame, entity: str, order: Column | list[Column], bucket: Column) -> DataFrame:
    """``df`` plus rn (from 1, by ``order``) and n (rows of the entity).

    ``bucket`` must not decrease with ``order``.
    """
    d = df.withColumn("_bk", bucket)
    counts = d.groupBy(F.col(entity).alias("_e"), "_bk").agg(F.count("*").alias("_c"))
    w = Window.partitionBy("_e").orderBy("_bk")
    counts = counts.select("_e", F.col("_bk").alias("_b"), F.coalesce(F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_c").over(Window.partitionBy("_e")).alias("n"))
    d = d.join(counts, F.col(entity).eqNullSafe(F.col("_e")) & F.col("_bk").eqNullSafe(F.col("_b")))
    rn = F.row_number().over(Window.partitionBy(entity, "_bk").orderBy(*(order if isinstance(order, list) else [order]))).cast("long") + F.col("_before")
    return d.withColumn("rn", rn).drop("_bk", "_b", "_e", "_before")


def part_of(rn: Column, n: Column) -> Column:
    """70 / 15 / 15 by position, in integer arithmetic."""
    return F.when(rn <= F.floor(7 * n / 10), "train").when(rn <= F.floor(85 * n / 100), "validation").otherwise("test")


def chronological(df: DataFrame, entity: str = "vessel_id", time: str = "time_index", width: int = 8192) -> DataFrame:
    """``df`` plus split, rn and n."""
    r = ranked(df, entity, F.col(time), F.expr(f"`{time}` div {width}"))
    return r.withColumn("split", part_of(F.col("rn"), F.col("n")))


def boundaries(split: DataFrame, entity: str = "vessel_id", time: str = "time_index") -> DataFrame:
    """Rows, first and last time of each part of each entity."""
    return split.groupBy(entity, "split").agg(F.count("*").alias("n_rows"), F.min(time).alias("first_time"), F.max(time).alias("last_time"))


def require_parts(bounds: DataFrame, entity: str = "vessel_id") -> None:
    """Every entity must fill all three parts, one after the other in time."""
    w = bounds.groupBy(entity).pivot("split", list(PARTS)).agg(F.first("first_time").alias("a"), F.first("last_time").alias("b"))
    missing = F.col("train_a").isNull() | F.col("validation_a").isNull() | F.col("test_a").isNull()
    mixed = (F.col("train_b") >= F.col("validation_a")) | (F.col("validation_b") >= F.col("test_a"))
    bad = w.where(missing | mixed).limit(1).collect()
    if bad:
        raise ValueError(f"{bad[0][0]} cannot populate all three parts in order")


def hashed(df: DataFrame, key: str, test_share: float = 0.2, seed: int = 42) -> DataFrame:
    """Exact random-like split: the ``ceil(n * share)`` rows with the least hash of (seed, key) are test.

    Ranks come from counts of 4,096 hash ranges, not from one sorted task.
    """
    h = F.sha2(F.concat(F.lit(str(seed)), F.lit(":"), F.col(key).cast("string")), 256)
    d = df.withColumn("_h", h).withColumn("_all", F.lit(0))
    r = ranked(d, "_all", F.struct("_h", key), F.substring("_h", 1, 3))
    share = Fraction(str(test_share))
    n_test = F.floor((F.col("n") * share.numerator + share.denominator - 1) / share.denominator)
    return r.withColumn("split", F.when(F.col("rn") <= n_test, "test").otherwise("train")).drop("_h", "_all", "rn", "n")


def group_folds(df: DataFrame, group: str, folds: int = 5) -> DataFrame:
    """``df`` plus fold: groups stay whole, the largest go to the emptiest fold.

    One rule at every size: the LARGEST largest groups are balanced on the
    driver by their sizes. Each other group holds at most one LARGEST-th of the
    rows; those are gathered in hash ranges, which are balanced after them.
    """
    sizes = stage(df.groupBy(group).agg(F.count("*").alias("_n")))
    top = [(r[0], r[1]) for r in sizes.orderBy(F.desc("_n"), F.col(group).cast("string")).limit(LARGEST).collect()]
    if len(top) < folds:
        raise ValueError(f"{len(top)} groups cannot make {folds} folds")
    load = [0] * folds

    def emptiest(n: int) -> int:
        f = min(range(folds), key=lambda i: (load[i], i))
        load[f] += n
        return f

    at = df.sparkSession.createDataFrame([(g, emptiest(n)) for g, n in sorted(top, key=lambda s: (-s[1], str(s[0])))], f"_g {dict(df.dtypes)[group]}, _f int")
    at = F.broadcast(at)  # at most LARGEST rows
    own = F.col(group).eqNullSafe(F.col("_g"))
    bucket = F.pmod(F.xxhash64(group), F.lit(FOLD_RANGES)).cast("int")
    rest = sizes.join(at, own, "left_anti").groupBy(bucket.alias("b")).agg(F.sum("_n")).collect()  # at most FOLD_RANGES rows
    ranges = [0] * FOLD_RANGES
    for b, n in sorted(rest, key=lambda s: (-s[1], s[0])):
        ranges[b] = emptiest(n)
    placed = df.join(at, own, "left")
    if not rest:
        return placed.withColumn("fold", F.col("_f")).drop("_g", "_f")
    return placed.withColumn("fold", F.coalesce("_f", F.element_at(F.array(*[F.lit(f) for f in ranges]), bucket + 1))).drop("_g", "_f")


def group_counts(df: DataFrame, unit: str, group: str) -> DataFrame:
    """unit and n_groups: distinct non-null groups of each unit, from distinct pairs, so that a hot unit is counted by many tasks."""
    return df.where(F.col(group).isNotNull()).select(unit, group).distinct().groupBy(unit).agg(F.count("*").alias("n_groups"))


def require_groups(df: DataFrame, group: str, least: int) -> None:
    n = df.where(F.col(group).isNotNull()).select(group).distinct().limit(least).count()
    if n < least:
        raise ValueError(f"{n} groups, {least} are needed")


def shuffled_folds(df: DataFrame, key: str, folds: int = 5, seed: int = 42) -> DataFrame:
    return df.withColumn("fold", F.pmod(F.xxhash64(F.lit(seed), key), F.lit(folds)).cast("int"))


def spaced_positions(n: Column, k: Column) -> Column:
    """Positions (from 0) of k evenly spaced rows of n: floor(i * (n - 1) / (k - 1)), the last exactly n - 1."""
    one = F.array(F.lit(0).cast("long"))
    step = (n - 1).cast("double") / (k - 1)
    many = F.transform(F.sequence(F.lit(0).cast("long"), k - 1), lambda i: F.when(i == k - 1, n - 1).otherwise(F.floor(i * step)))
    return F.when(k <= 1, one).otherwise(many)


def spaced_sample(df: DataFrame, per_entity: DataFrame, entity: str = "vessel_id", time: str = "time_index", width: int = 8192) -> DataFrame:
    """Evenly spaced rows of each entity in time order; ``per_entity`` holds entity and k."""
    r = ranked(df, entity, F.col(time), F.expr(f"`{time}` div {width}"))
    sizes = df.groupBy(entity).agg(F.count("*").alias("_n")).join(per_entity, entity)
    wanted = sizes.select(entity, F.explode(spaced_positions(F.col("_n"), F.least(F.col("k"), F.col("_n")))).alias("_p")).select(entity, (F.col("_p") + 1).alias("rn")).distinct()
    return r.join(wanted, [entity, "rn"], "left_semi")


def capped_sample(df: DataFrame, rows: int = 1000, entity: str = "vessel_id", time: str = "time_index") -> DataFrame:
    """At most ``rows`` evenly spaced rows of each entity."""
    return spaced_sample(df, df.select(entity).distinct().withColumn("k", F.lit(rows).cast("long")), entity, time)


def allocation(counts: DataFrame, requested: int, entity: str = "vessel_id") -> DataFrame:
    """entity and k, its rows of ``requested`` ones; ``counts`` holds one row of entity and n.

    Everyone gets the whole part of the proportional share, but at least one.
    What is then missing goes to the largest remainders, one each (ties by
    name): fewer are missing than have a remainder. What is too much, because
    of those raised to one, is taken back level by level from the others (the
    smallest remainders first, ties by name from the end): everyone above one
    gives up ``level`` rows, and those next in line one more.

    A request above the rows there are takes them all; one below the number of
    entities, and an entity without rows, are errors.
    """
    total, least, entities = counts.agg(F.sum("n"), F.min("n"), F.count("*")).first()
    size = min(requested, total or 0)
    if not entities or size < entities or least < 1:
        raise ValueError("the sample is too small for its entities")
    exact = F.col("n").cast("decimal(38,0)") * F.lit(size)
    part = counts.select(entity, F.expr("1L").alias("_all"), (exact % F.lit(total)).cast("long").alias("rem"), F.floor(exact / F.lit(total)).cast("long").alias("whole"))
    part = part.withColumn("start", F.greatest("whole", F.lit(1)))
    missing = size - part.agg(F.sum("start")).first()[0]
    tight = F.floor(F.col("rem") * 4096.0 / total).cast("long")  # rank by counts of 4,096 ranges of remainders
    if missing >= 0:
        r = ranked(part, "_all", [F.desc("rem"), F.col(entity)], -tight)
        return r.select(entity, (F.col("start") + (F.col("rn") <= missing).cast("long")).alias("k"))
    # rows to take back when everyone gives up as many as the poorest at this cap: one row for each distinct cap
    over = -missing
    caps = part.select((F.col("start") - 1).alias("cap")).groupBy("cap").agg(F.count("*").alias("m"))
    w = Window.orderBy("cap")
    caps = caps.select("cap", (F.sum(F.col("cap") * F.col("m")).over(w) + F.col("cap") * (entities - F.sum("m").over(w))).alias("taken"), (entities - F.sum("m").over(w)).alias("richer"))
    cap, taken, richer = caps.where(F.col("taken") <= over).agg(F.max_by(F.struct("cap", "taken", "richer"), "cap")).first()[0]
    level = cap + (over - taken) // richer if richer else cap
    left = (over - taken) % richer if richer else 0
    able = part.where(F.col("start") - 1 > level)
    next_in_line = ranked(able, "_all", [F.col("rem"), F.desc(entity)], tight).select(F.col(entity).alias("_e2"), (F.col("rn") <= left).cast("long").alias("more"))
    taken_back = F.least(F.col("start") - 1, F.lit(level)) + F.coalesce("more", F.lit(0))
    return part.join(next_in_line, F.col(entity) == F.col("_e2"), "left").select(entity, (F.col("start") - taken_back).alias("k"))


def proportional_sample(df: DataFrame, requested: int, entity: str = "vessel_id", time: str = "time_index") -> DataFrame:
    """``requested`` rows in all, shared out by ``allocation`` and evenly spaced in time."""
    return spaced_sample(df, allocation(stage(df.groupBy(entity).agg(F.count("*").alias("n"))), requested, entity), entity, time)
