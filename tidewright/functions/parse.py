"""Text to values, with the reason where it fails."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Texts that are numbers, and texts that are numbers but not finite. Fixed patterns.
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
NONFINITE = r"(?i)^[+-]?(nan|inf|infinity)$"

#: Formats tried in turn for timestamps of mixed origin, after the ISO forms. Fixed values.
DATE_FORMATS = ("MM/dd/yyyy HH:mm", "MM/dd/yyyy HH:mm:ss", "dd.MM.yyyy HH:mm", "yyyy/MM/dd HH:mm:ss")


def trimmed(c: Column) -> Column:
    """``c`` without white space around it."""
    return F.trim(c, F.lit(" \t\n\x0b\f\r"))


def number_value(t: Column) -> Column:
    """The double that trimmed text ``t`` writes; null if it writes none, infinite if it is too large."""
    return F.when(t.rlike(NUMBER), t.try_cast("double"))


def number_error(t: Column, v: Column) -> Column:
    """missing, nonnumeric or nonfinite, or null for a finite number; ``v`` is number_value(t)."""
    return (
        F.when(t.isNull() | (t == ""), "missing")
        .when(F.abs(v) == F.lit(float("inf")), "nonfinite")
        .when(v.isNotNull(), None)
        .when(t.rlike(NONFINITE), "nonfinite")
        .otherwise("nonnumeric")
    )


def whole_value(t: Column, v: Column) -> Column:
    """The 64-bit integer that trimmed text writes, decided on its decimal digits; null if it writes none."""
    d = F.when(v.isNotNull() & ~t.rlike(r"\.[0-9]{18}[0-9]*[1-9]"), t.try_cast("decimal(38,18)"))
    return F.when(t.rlike(r"^[+-]?[0-9]+$"), t.try_cast("bigint")).when(d == F.floor(d), d.try_cast("bigint"))


def step_error(t: Column, v: Column, error: Column, whole: Column) -> Column:
    """number_error's reasons, negative, nonintegral, or null for a whole number from 0."""
    negative = (v < 0) | (t.startswith("-") & (v != 0))
    return F.when(error.isNotNull(), error).when(negative, "negative").when(whole.isNull(), "nonintegral")


def number(c: Column) -> Column:
    """struct(value double, error string); error is missing, nonnumeric, nonfinite or null.

    Underscores in digits and type suffixes are no part of a number. For many
    columns of one table use ``parsed``, which builds each part once.
    """
    t = trimmed(c)
    v = number_value(t)
    error = number_error(t, v)
    return F.struct(F.when(error.isNull(), v).alias("value"), error.alias("error"))


def step_number(c: Column) -> Column:
    """struct(value bigint, error string): number's errors, negative, nonintegral.

    Integrality is decided on the decimal text, not on a rounded value; what
    does not fit 64 bits is refused as nonintegral.
    """
    t = trimmed(c)
    v = number_value(t)
    whole = whole_value(t, v)
    error = step_error(t, v, number_error(t, v), whole)
    return F.struct(F.when(error.isNull(), whole).alias("value"), error.alias("error"))


def parsed(df: DataFrame, numbers: dict[str, str], steps: dict[str, str]) -> DataFrame:
    """``df`` with, for each ``out: column``, ``out`` (double or bigint, null on error) and ``out_error``.

    One projection each for the trimmed texts, their numbers, and the reasons,
    so that no expression is written into the ones that use it: a table of many
    columns keeps small methods of generated code.
    """
    both = numbers | steps
    d = df.withColumns({f"_t_{o}": trimmed(F.col(f"`{c}`")) for o, c in both.items()})
    d = d.withColumns({f"_v_{o}": number_value(F.col(f"_t_{o}")) for o in both})
    d = d.withColumns({f"_e_{o}": number_error(F.col(f"_t_{o}"), F.col(f"_v_{o}")) for o in both} | {f"_w_{o}": whole_value(F.col(f"_t_{o}"), F.col(f"_v_{o}")) for o in steps})
    d = d.withColumns({f"{o}_error": step_error(F.col(f"_t_{o}"), F.col(f"_v_{o}"), F.col(f"_e_{o}"), F.col(f"_w_{o}")) if o in steps else F.col(f"_e_{o}") for o in both})
    d = d.withColumns({o: F.when(F.col(f"{o}_error").isNull(), F.col(f"_w_{o}" if o in steps else f"_v_{o}")) for o in both})
    return d.drop(*[f"_{k}_{o}" for k in "tvew" for o in both])


def out_of_range(feature: str, c: Column) -> Column:
    """Whether a feature's value cannot be: directions lie in [0, 360], periods above 0, others from 0."""
    if feature == "wind_direction":
        return (c < 0) | (c > 360)
    return c <= 0 if feature == "wave_period" else c < 0


def timestamp(c: Column) -> Column:
    """A timestamp from text of mixed formats; null where none fits."""
    t = trimmed(c)
    return F.coalesce(F.try_to_timestamp(t), *[F.try_to_timestamp(t, F.lit(f)) for f in DATE_FORMATS])


def finite(c: Column) -> Column:
    """``c`` without NaN and infinities."""
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def category(c: Column, missing: str = "UNKNOWN") -> Column:
    """Trimmed text; null and blank become ``missing``."""
    return F.coalesce(F.nullif(trimmed(c), F.lit("")), F.lit(missing))
