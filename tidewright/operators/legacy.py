"""Wide frames of older origin: their column names, targets and columns to leave out."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tidewright.functions import parse

#: Names of older frames and what they are called here. Fixed values.
RENAMES = {
    "Sailing speed": "sailing_speed",
    "Displacement": "displacement",
    "Trim": "trim",
    "Wind speed": "wind_speed",
    "Wind direction (Rel.)": "wind_direction_relative",
    "Combined wave height": "combined_wave_height",
    "Combined Wave period": "combined_wave_period",
    "Combined wave direction (Rel.)": "combined_wave_direction_relative",
    "Sea current speed": "sea_current_speed",
    "Sea current direction (Rel.)": "sea_current_direction_relative",
    "Sea water temperature": "sea_water_temperature",
    "Fuel consumption rate": "fuel_consumption_rate",
    "Current GMT Dttm": "observation_timestamp",
    "Swell height": "swell_height",
    "Swell direction (Rel.)": "swell_direction_relative",
    "Wind wave height": "wind_wave_height",
    "Wind wave direction (Rel.)": "wind_wave_direction_relative",
}


def renamed(df: DataFrame) -> DataFrame:
    """Column names without surrounding blanks, older ones by their present name; two columns of one name are an error."""
    names = [RENAMES.get(c.strip(), c.strip()) for c in df.columns]
    twice = sorted({n for n in names if names.count(n) > 1})
    if twice:
        raise ValueError(f"several columns are called {', '.join(twice)}")
    return df.toDF(*names)


def with_target(df: DataFrame, target: str) -> DataFrame:
    """Rows whose target is a number or text; null, NaN and infinities are dropped."""
    kind = dict(df.dtypes)[target]
    c = df[f"`{target}`"]
    return df.where((parse.finite(c) if kind in ("double", "float") else c).isNotNull())


def without(df: DataFrame, columns: list[str]) -> DataFrame:
    """All columns but those named; a name that is not there is no error."""
    return df.select(*[df[f"`{c}`"] for c in df.columns if c not in columns])
