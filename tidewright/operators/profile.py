"""Column-level data quality profile of each load, and the loads that depart.

Method: every distinct value of a column is abstracted at three levels, its
exact character classes (``99-Aaa``), its runs of classes (``9+-A+a+``) and its
runs of word characters (``w+-w+``). A set of regular expressions is induced by
minimum description length: bits for the expressions plus bits for all distinct
values under them, chosen bottom-up between a level and the one above it; values
for which even the cheapest expression costs more than writing them out conform
to none. The share of values under each expression is compared between loads,
beside missing, distinct, range, level, zero, category and duplicate figures.

Distribution: equal rows are merged once, cells are then counted by (load,
column, value), whose keys spread any hot load; everything after that works on
counts. Loads are compared by exact medians over the loads' figures.

Defined results: null, NaN, blank and words for null are missing; a load whose
values are all missing has null distinct, level and pattern figures; loads
departing only by ordinary sampling are none; an empty table gives no rows;
``*`` stands for a load's share of rows equal to another row of it.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tidewright.functions.names import is_null_word, squeezed
from tidewright.session import small, stage

#: Usual share above which a value or category is compared by itself; the rest are compared as one.
CATEGORY = 0.01

#: Least departure of a share, of a distribution (half the summed differences),
#: of a distinct share (a fall: relative to the usual one), of a level (ratio);
#: and in standard errors.
SHARE, SPREAD, DISTINCT, LEVEL, SIGMAS = 0.1, 0.15, 0.25, 1.2, 7.0

# bits for one character of each kind. log2 of 10, 26, 62 and 95.
_DIGIT, _LETTER, _WORD, _ANY = 3.32, 4.70, 5.95, 6.57
_RUN, _TOKEN, _NEW = 3.0, 6.0, 12.0


def merged_rows(df: DataFrame, load: str) -> DataFrame:
    """Equal rows of a load once, with ``_copies``."""
    return df.groupBy(*[F.col(f"`{c}`") for c in df.columns]).agg(F.count("*").alias("_copies"))


def _text(df: DataFrame, c: str) -> tuple:
    """(value as text or null if missing, value as number or null) of a column."""
    kind = df.schema[c].dataType
    v = F.col(f"`{c}`")
    if isinstance(kind, T.StringType):
        return F.when(~is_null_word(v), v), F.lit(None).cast("double")
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        v = F.when(~F.isnan(v), v)
    if isinstance(kind, T.NumericType):
        return v.cast("string"), v.cast("double")
    return v.cast("string"), F.lit(None).cast("double")


_DIGITS, _UPPER, _LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def exact_shape(v: Column) -> Column:
    """Every digit as 9, every capital as A, every other letter as a; regular expressions only where a letter may not be ASCII."""
    plain = F.translate(v, _DIGITS + _UPPER + _LOWER, "9" * 10 + "A" * 26 + "a" * 26)
    other = F.regexp_replace(F.regexp_replace(plain, r"\p{Lu}", "A"), r"[\p{L}&&[^Aa]]", "a")
    return F.when(F.octet_length(v) > F.char_length(v), other).otherwise(plain)


def cell_counts(rows: DataFrame, load: str, columns: list[str]) -> DataFrame:
    """(_load, col, v, x, n, s0): the number of merged rows of each value and its exact shape, staged; v null if missing."""
    cells = F.array(*[F.struct(F.lit(i).cast("short").alias("col"), _text(rows, c)[0].alias("v"), _text(rows, c)[1].alias("x")) for i, c in enumerate(columns)])
    counts = rows.select(F.col(f"`{load}`").alias("_load"), F.explode(cells).alias("c")).groupBy("_load", "c.col", "c.v", "c.x").agg(F.count("*").alias("n"))
    return stage(counts.withColumn("s0", exact_shape(F.col("v"))))


def expressions(values: DataFrame) -> DataFrame:
    """``values`` (with col, v and perhaps s0) plus ``expr``, the induced expression; null if v conforms to none.

    The description lengths are sums over all distinct values of a column. All
    of it but the count of distinct values works on shapes, and sums over the
    shapes of an expression are aggregations by it, so that no task sorts or
    holds the shapes of one.
    """
    values = values if "s0" in values.columns else values.withColumn("s0", exact_shape(F.col("v")))
    # one row for each exact shape: distinct values and their characters
    shapes = stage(values.where("v is not null").groupBy("col", "s0", "v").agg(F.lit(1).alias("one")).groupBy("col", "s0").agg(F.count("*").alias("k")))
    runs = F.regexp_replace(F.regexp_replace(F.regexp_replace("s0", "9+", "9+"), r"(?<!\+)A+", "A+"), r"a+", "a+")
    words = F.regexp_replace("s0", "[9Aa]+", "w+")
    n = lambda c, cls: F.length(c) - F.length(F.regexp_replace(c, cls, ""))
    digits, letters = n(F.col("s0"), "9"), n(F.col("s0"), "[Aa]")
    shapes = shapes.withColumn("s1", runs).withColumn("s2", words).withColumn("signs", digits + letters)
    shapes = shapes.withColumn("bits", digits * _DIGIT + letters * _LETTER).withColumn("chars", F.length("s0"))
    shapes = stage(shapes.withColumn("runs1", n(F.col("s1"), r"\+")).withColumn("runs2", n(F.col("s2"), r"\+")).withColumn("dl0", F.length("s0") * _TOKEN + F.col("k") * F.col("bits")))
    g1 = shapes.groupBy("col", "s1", "s2").agg(
        F.sum("dl0").alias("under0"),
        (F.length("s1") * _TOKEN + F.sum(F.col("k") * (F.col("bits") + F.col("runs1") * _RUN))).alias("own1"),
        F.sum(F.col("k") * (F.col("signs") * _WORD + F.col("runs2") * _RUN)).alias("in2"),
    )
    g1 = g1.withColumn("use1", F.col("own1") <= F.col("under0")).withColumn("dl1", F.least("own1", "under0"))  # an s1 has one s2
    g2 = g1.groupBy("col", "s2").agg((F.length("s2") * _TOKEN + F.sum("in2") < F.sum("dl1")).alias("use2"))
    chosen = shapes.join(g1.select("col", "s1", "use1"), ["col", "s1"]).join(g2, ["col", "s2"])
    chosen = chosen.withColumn("expr", F.when(F.col("use2"), F.col("s2")).when(F.col("use1"), F.col("s1")).otherwise(F.col("s0")))
    per = chosen.groupBy("col", "expr").agg(
        (_NEW + F.length("expr") * _TOKEN + F.sum(F.col("k") * F.when(F.col("use2"), F.col("signs") * _WORD).otherwise(F.col("bits")))).alias("cost"),
        F.sum(F.col("k") * (F.col("chars") * _ANY + 4)).alias("plain"),
    )
    kept = stage(chosen.select("col", "s0", "expr").join(per.where("cost < plain").select("col", "expr"), ["col", "expr"]))
    return values.join(small(kept), ["col", "s0"], "left").drop("s0")


def as_regex(expr: str) -> str:
    """An induced expression in the notation of ``re``."""
    import re

    names = {"9": "[0-9]", "A": r"\p{Lu}", "a": r"\p{Ll}", "w": r"\w"}
    return "^" + "".join(names.get(m[0], re.escape(m[0])) + m[1:] for m in re.findall(r"[9Aaw]\+?|.", expr, re.S)) + "$"


def profile(df: DataFrame, load: str = "load_id", columns: list[str] | None = None) -> DataFrame:
    """One row for each load and column: counts, range, level, pattern and duplicate figures."""
    columns = columns or [c for c in df.columns if c != load]
    rows = stage(merged_rows(df.select(load, *[f"`{c}`" for c in columns]), load))
    seen = expressions(cell_counts(rows, load, columns))
    per_expr = seen.groupBy("_load", "col", "expr", F.col("v").isNull().alias("miss")).agg(
        F.sum("n").alias("n"), F.count("v").alias("d"), F.min("x").alias("lo"), F.max("x").alias("hi"), F.min("v").alias("lo_text"), F.max("v").alias("hi_text"),
        F.sum(F.when(F.col("x") <= 0, F.col("n")).otherwise(0)).alias("nonpos"),
    )
    by_col = per_expr.groupBy("_load", "col").agg(
        F.sum("n").alias("n_rows"), F.sum(F.when(F.col("miss"), F.col("n")).otherwise(0)).alias("n_missing"), F.sum("d").alias("n_distinct"),
        F.min("lo").alias("min_number"), F.max("hi").alias("max_number"), F.min("lo_text").alias("min_text"), F.max("hi_text").alias("max_text"),
        F.sum("nonpos").alias("n_not_positive"),
        F.sum(F.when(~F.col("miss") & F.col("expr").isNull(), F.col("n")).otherwise(0)).alias("n_nonconforming"),
        F.max_by("expr", F.when(F.col("expr").isNotNull(), F.struct("n", "expr"))).alias("main_expr"),
    )
    copies = rows.groupBy(F.col(load).alias("_load")).agg(F.sum("_copies").alias("n_loaded"), F.sum(F.when(F.col("_copies") > 1, F.col("_copies")).otherwise(0)).alias("n_equal"), F.sum(F.col("_copies") - 1).alias("n_surplus"))
    name = F.element_at(F.array(*[F.lit(c) for c in columns]), F.col("col") + 1)
    return by_col.join(copies, "_load").select(F.col("_load").alias(load), name.alias("column_name"), "n_loaded", "n_equal", "n_surplus", *[c for c in by_col.columns if c not in ("_load", "col")])


def departures(df: DataFrame, load: str = "load_id", columns: list[str] | None = None) -> DataFrame:
    """(load, column_name) of each column of a load that clearly departs from the other loads.

    With fewer than three loads nothing can be told and nothing is returned.
    The cells are staged once; figures of loads, which are few beside them, are
    staged in turn, so that every comparison is a small plan over small tables.
    """
    columns = columns or [c for c in df.columns if c != load]
    rows = stage(merged_rows(df.select(load, *[f"`{c}`" for c in columns]), load))
    cells = stage(expressions(cell_counts(rows, load, columns)))
    figures = stage(
        cells.groupBy("_load", "col", F.coalesce("expr", F.lit("")).alias("key"), F.col("v").isNull().alias("miss")).agg(
            F.sum("n").alias("n"), F.count("v").alias("distinct"), F.sum(F.when(F.col("x") <= 0, F.col("n")).otherwise(0)).alias("nonpos"), F.count("x").alias("numeric"),
            F.max(F.when(F.col("v").isNotNull(), F.col("n"))).alias("top"),
        )
    )
    present = F.when(F.col("miss"), 0).otherwise(F.col("n"))
    totals = stage(
        figures.groupBy("_load", "col").agg(
            F.sum("n").alias("n"), F.sum(present).alias("present"), F.sum("distinct").alias("distinct"), F.sum("nonpos").alias("nonpos"), F.sum("numeric").alias("numeric"), F.max("top").alias("top")
        )
    )
    n_loads = totals.select("_load").distinct().count()
    if n_loads < 3:
        return df.select(load, F.lit("").alias("column_name")).limit(0)

    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    metric = lambda name, v, n, least: F.struct(F.lit(name).alias("metric"), v.alias("y"), F.col(n).cast("double").alias("size"), F.lit(least).alias("least"))
    shares = totals.select("_load", "col", F.explode(F.array(
        metric("missing", 1 - share("present", "n"), "n", SHARE),
        metric("distinct", share("distinct", "present"), "present", DISTINCT),
        metric("top", share("top", "present"), "present", SHARE),
        metric("nonpos", F.when(F.col("numeric") > 0, share("nonpos", "present")), "present", SHARE),
    )).alias("m")).select("_load", "col", "m.*")
    dup = rows.groupBy(F.col(load).alias("_load")).agg(F.sum("_copies").alias("n"), F.sum(F.when(F.col("_copies") > 1, F.col("_copies")).otherwise(0)).alias("eq"))
    dup = dup.select("_load", F.lit(-1).cast("short").alias("col"), F.lit("equal").alias("metric"), (F.col("eq") / F.col("n")).alias("y"), F.col("n").cast("double").alias("size"), F.lit(SHARE).alias("least"))
    hits = [stage(_outlying(stage(shares.unionByName(dup).where("y is not null")))), stage(_collapsed(stage(_drawn(cells, totals))))]

    # a category's spelling is judged by its expression, its share without regard to case and blanks
    key = F.regexp_replace(squeezed(F.col("v")), r"[\s_\-]+", "_")
    texts = cells.where("v is not null and x is null").groupBy("_load", "col", key.alias("key")).agg(F.sum("n").alias("n"))
    numbers = cells.where("v is not null and x is not null").select("_load", "col", F.col("v").alias("key"), "n")
    hits.append(stage(_categories(stage(texts.unionByName(numbers)), totals)))
    hits.append(stage(_distribution(figures.where("not miss").select("_load", "col", "key", "n"), totals)))
    hits.append(stage(_shifted(stage(_levels(cells)))))
    name = F.element_at(F.array(F.lit("*"), *[F.lit(c) for c in columns]), F.col("col") + 2)
    return reduce(DataFrame.unionByName, hits).distinct().select(F.col("_load").alias(load), name.alias("column_name"))


_OCTAVE = 32


def _levels(cells: DataFrame) -> DataFrame:
    """Quartiles of the positive values of each column of each load, in steps of 1/32 octave."""
    bins = cells.where("x > 0").groupBy("_load", "col", F.floor(F.log2("x") * _OCTAVE).alias("b")).agg(F.sum("n").alias("n"))
    w = Window.partitionBy("_load", "col")
    cum = bins.withColumn("c", F.sum("n").over(w.orderBy("b"))).withColumn("size", F.sum("n").over(w))
    at = lambda q: F.min(F.when(F.col("c") >= q * F.col("size"), (F.col("b") + 0.5) / _OCTAVE * math.log(2)))
    return cum.groupBy("_load", "col").agg(at(0.5).alias("y"), (at(0.75) - at(0.25)).alias("iqr"), F.first("size").cast("double").alias("size"))


def _median(y: Column) -> Column:
    """The lower median, from a summary of fixed size; exact up to some ten thousand loads."""
    return F.percentile_approx(y, F.lit(0.5), 10_000)


def _usual(shares: DataFrame, loads: DataFrame) -> DataFrame:
    """col, key and mid: the upper median share of each key over all loads with values of the column.

    A load without the key has a share of 0, so a key of fewer than half of the
    loads has none; of the others the median is a lower quantile of the shares
    there are, taken from a summary of fixed size in steps of 1/200.
    """
    steps = F.array(*[F.lit(i / 200) for i in range(201)])
    q = shares.groupBy("col", "key").agg(F.count("*").alias("seen"), F.percentile_approx("y", steps, 10_000).alias("q")).join(F.broadcast(loads), "col")
    rank = F.col("seen") - (F.col("loads") - F.floor((F.col("loads") - 1) / 2)) + 1  # from the bottom, from 1
    at = F.round(200 * (F.greatest(rank, F.lit(1)) - 0.5) / F.col("seen")).cast("int") + 1
    return q.where(rank >= 1).select("col", "key", F.element_at("q", at).alias("mid")).where("mid > 0")


def _centre(stats: DataFrame, by: list[str], y: str) -> DataFrame:
    """Median over loads and the median distance from it, of each figure."""
    mid = stats.groupBy(*by).agg(_median(F.col(y)).alias("mid"))
    both = stats.join(F.broadcast(mid), by)
    off = both.groupBy(*by).agg(_median(F.abs(F.col(y) - F.col("mid"))).alias("off"), _median(F.col("size")).alias("usual_size"))
    return both.join(F.broadcast(off), by)


def _outlying(shares: DataFrame) -> DataFrame:
    """Loads whose share leaves the usual one by more than sampling and a least effect."""
    c = _centre(shares, ["col", "metric"], "y")
    m = F.least(F.greatest("mid", F.lit(0.002)), F.lit(0.998))
    se = F.sqrt(m * (1 - m) / F.greatest("size", F.lit(1.0)) + F.pow(F.col("off") * 1.4826, 2))
    gap = F.abs(F.col("y") - F.col("mid"))
    far = (gap > F.col("least")) & (gap > SIGMAS * se)
    rise = F.col("y") > F.col("mid")
    # more distinct values than usual mean nothing where few values are left; fewer are judged by _collapsed
    distinct = rise & (F.col("size") > 0.5 * F.col("usual_size"))
    # the most frequent value of few rows is often a chance pair: Bernstein's term, some 16 rows more than usual at least
    top = rise & (gap > SIGMAS * se + SIGMAS**2 / 3 / F.col("size"))
    return c.where(far & F.when(F.col("metric") == "distinct", distinct).when(F.col("metric") == "top", top).otherwise(True)).select("_load", "col")


def _drawn(cells: DataFrame, totals: DataFrame) -> DataFrame:
    """Expected distinct share of 2^(step/2) rows drawn from each load's present values, up to its own size.

    A value held by n of N rows is among m drawn ones with probability
    1 - (1 - m/N)^n, so only the numbers of values of equal n are needed.
    """
    alike = cells.where("v is not null").groupBy("_load", "col", "n").agg(F.count("*").alias("values"))
    d = alike.join(totals.select("_load", "col", "present"), ["_load", "col"])
    d = d.withColumn("step", F.explode(F.sequence(F.lit(2), F.greatest(F.lit(2), F.floor(2 * F.log2("present")).cast("int"))))).withColumn("size", F.pow(F.lit(2.0), F.col("step") / 2))
    d = d.where(F.col("size") <= F.col("present") * (1 + 1e-9))
    among = 1 - F.pow(F.greatest(1 - F.col("size") / F.col("present"), F.lit(0.0)), F.col("n"))
    return d.groupBy("_load", "col", "step", "size").agg((F.sum(F.col("values") * among) / F.col("size")).alias("y"))


def _collapsed(drawn: DataFrame) -> DataFrame:
    """Loads whose distinct share falls clearly below that of as many rows of the other loads."""
    c = _centre(drawn.withColumn("y", F.log("y")), ["col", "step"], "y")
    compared = drawn.groupBy("col", "step").agg(F.count("*").alias("loads")).where("loads >= 3")
    m = F.least(F.exp("mid"), F.lit(0.998))
    se = F.sqrt((1 - m) / (m * F.col("size")) + F.pow(F.col("off") * 1.4826, 2))
    fall = F.col("mid") - F.col("y")
    return c.join(F.broadcast(compared), ["col", "step"]).where((fall > -math.log(1 - DISTINCT)) & (fall > SIGMAS * se)).select("_load", "col").distinct()


def _distribution(counts: DataFrame, totals: DataFrame) -> DataFrame:
    """Loads whose shares of keys differ from the usual shares in sum."""
    size = totals.where("present > 0").select("_load", "col", F.col("present").alias("size"))
    shares = counts.join(size, ["_load", "col"]).withColumn("y", F.col("n") / F.col("size"))
    loads = size.groupBy("col").agg(F.count("*").alias("loads"))
    # the median share over all loads with values; a load without the key has 0
    usual = _usual(shares, loads)
    # sum |y - mid| over the union of keys = sum over present keys + what absent ones leave
    base = usual.groupBy("col").agg(F.sum("mid").alias("all_mid"), F.sum(F.sqrt(F.col("mid") * (1 - F.col("mid")))).alias("noise"))
    got = shares.join(usual, ["col", "key"], "left").withColumn("m0", F.coalesce("mid", F.lit(0.0)))
    per = got.groupBy("_load", "col").agg(F.sum(F.abs(F.col("y") - F.col("m0"))).alias("present_gap"), F.sum("m0").alias("seen_mid"), F.first("size").alias("size"))
    per = per.join(F.broadcast(base), "col", "left").withColumn("tv", (F.col("present_gap") + F.coalesce(F.col("all_mid") - F.col("seen_mid"), F.lit(0.0))) / 2)
    typical = per.groupBy("col").agg(_median(F.col("tv")).alias("usual_tv"))
    limit = F.lit(SPREAD) + F.col("usual_tv") + 2.0 * F.coalesce("noise", F.lit(0.0)) / F.sqrt(F.col("size"))
    return per.join(F.broadcast(typical), "col").where(F.col("tv") > limit).select("_load", "col")


def _categories(counts: DataFrame, totals: DataFrame) -> DataFrame:
    """Loads whose shares of values differ from the usual ones: frequent values singly, the rest as one.

    A median share above CATEGORY needs that share in half of the loads, so the
    usual values follow from the at most 1 / CATEGORY frequent ones of each load.
    Of a value frequent in a load but not usually, only the part above what a
    share of CATEGORY reaches by chance counts by itself, the rest with the rest.
    """
    size = totals.where("present > 0").select("_load", "col", F.col("present").alias("size"))
    shares = counts.join(size, ["_load", "col"]).withColumn("y", F.col("n") / F.col("size"))
    loads = F.broadcast(size.groupBy("col").agg(F.count("*").alias("loads")))  # one row a column
    often = stage(shares.where(F.col("y") > CATEGORY))
    usual = stage(_usual(often, loads))
    # at most 2 / CATEGORY rows a column
    seen = shares.join(F.broadcast(usual), ["col", "key"]).select("_load", "col", "y", "mid")
    chance = CATEGORY + SIGMAS * F.sqrt(CATEGORY * (1 - CATEGORY) / F.col("size")) + SIGMAS**2 / 3 / F.col("size")
    extra = often.join(F.broadcast(usual), ["col", "key"], "left_anti").withColumn("y", F.col("y") - chance).where("y > 0").select("_load", "col", "y", F.lit(0.0).alias("mid"))
    per = seen.unionByName(extra).groupBy("_load", "col").agg(F.sum("y").alias("own"), F.sum("mid").alias("seen_mid"), F.sum(F.abs(F.col("y") - F.col("mid"))).alias("gap"))
    per = size.join(per, ["_load", "col"], "left").na.fill(0.0, ["own", "seen_mid", "gap"]).withColumn("rest", 1 - F.col("own"))
    rest = per.groupBy("col").agg(_median(F.col("rest")).alias("usual_rest"))
    base = usual.groupBy("col").agg(F.sum("mid").alias("all_mid"), F.sum(F.sqrt(F.col("mid") * (1 - F.col("mid")))).alias("noise"))
    per = per.join(F.broadcast(rest), "col").join(F.broadcast(base), "col", "left").na.fill(0.0, ["all_mid", "noise"])
    per = per.withColumn("tv", (F.col("gap") + F.col("all_mid") - F.col("seen_mid") + F.abs(F.col("rest") - F.col("usual_rest"))) / 2)
    typical = per.groupBy("col").agg(_median(F.col("tv")).alias("usual_tv"))
    of_rest = F.sqrt(F.greatest(F.col("usual_rest") * (1 - F.col("usual_rest")), F.lit(0.0)))
    limit = F.lit(SPREAD) + F.col("usual_tv") + 2.0 * (F.col("noise") + of_rest) / F.sqrt("size")
    return per.join(F.broadcast(typical), "col").where(F.col("tv") > limit).select("_load", "col")


def _shifted(levels: DataFrame) -> DataFrame:
    """Loads whose median of positive values is another level or unit."""
    c = _centre(levels, ["col"], "y")
    width = levels.groupBy("col").agg(_median(F.col("iqr")).alias("usual_iqr"))
    c = c.join(F.broadcast(width), "col")  # one row a column
    se = F.sqrt(F.pow(0.93 * F.col("usual_iqr"), 2) / F.col("size") + F.pow(F.col("off") * 1.4826, 2))
    gap = F.abs(F.col("y") - F.col("mid"))
    return c.where((gap > math.log(LEVEL)) & (gap > 5.0 * se)).select("_load", "col")
