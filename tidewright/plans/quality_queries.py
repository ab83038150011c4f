"""The training-data queries of the core, bound to their whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewright.operators import badrows, fill, grid, profile, spikes
from tidewright.session import table


def p1_filled(spark: SparkSession, d: str) -> DataFrame:
    return fill.fill_all(table(spark, d, "vessel_records"), table(spark, d, "partition_rows"), table(spark, d, "vessels"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_filled(spark, d).select("table_name", "row_id", "field_name", "vessel_id")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return spikes.implausible_cells(table(spark, d, "vessel_records"), table(spark, d, "vessels"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return badrows.faulty_lines(table(spark, d, "fuelcast_raw"))


def p3_valid(spark: SparkSession, d: str) -> DataFrame:
    return badrows.valid_rows(table(spark, d, "fuelcast_raw"))


def p3_summary(spark: SparkSession, d: str) -> DataFrame:
    return badrows.fault_summary(table(spark, d, "fuelcast_raw"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return grid.empty_slots(table(spark, d, "partition_rows"), table(spark, d, "vessels"))


def p4_series(spark: SparkSession, d: str) -> DataFrame:
    s = grid.leg_series(table(spark, d, "partition_rows"), table(spark, d, "vessels"))
    return s.withColumn("total_momentary_fuel", F.round("total_momentary_fuel", 9))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return profile.departures(table(spark, d, "voyage_reports"))


def p5_profile(spark: SparkSession, d: str) -> DataFrame:
    return profile.profile(table(spark, d, "voyage_reports"))


def p5_counts(spark: SparkSession, d: str) -> DataFrame:
    """The counts and ranges of the profile, without what only the induced expressions tell."""
    return p5_profile(spark, d).select("load_id", "column_name", "n_loaded", "n_equal", "n_surplus", "n_rows", "n_missing", "n_distinct", "n_not_positive", "min_number", "max_number")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p1_found, p1_filled, p2_found, p3_found, p3_valid, p3_summary, p4_found, p4_series, p5_found, p5_profile, p5_counts)}

# Where SQL can state the result on its own, from the definitions rather than from the operator.
_NAMED = "lower(regexp_replace(x.vessel_id, '^\\s+|\\s+$', '', 'g'))"

# lines without ends and marks; their fields if they are well quoted; the number a field writes
_LINES = r"""with l as (select line_id, regexp_replace(regexp_replace(coalesce(raw_text, ''), '[\r\n]+$', ''), '^\x{FEFF}+', '') as x from fuelcast_raw where line_no is null or line_no <> 1),
 q as (select line_id, x, regexp_full_match(x, '(?s)("([^"]|"")*"|[^",]*)(,("([^"]|"")*"|[^",]*))*') as quoted, [case when f[1] = '"' then replace(f[2:-2], '""', '"') else f end for f in regexp_extract_all(',' || x, '(?s),("(?:[^"]|"")*"|[^",]*)', 1)] as f from l),
 n as (select line_id, quoted, len(f) as k, f[1] as name, [case when regexp_full_match(trim(regexp_replace(v, '^\s+|\s+$', '', 'g')), '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?') then try_cast(trim(regexp_replace(v, '^\s+|\s+$', '', 'g')) as double) end for v in f] as v from q),
 r as (select *, case when not quoted then 'quoting' when k <> 9 then 'column_count' when v[2] is null or not isfinite(v[2]) or v[2] < 0 or v[2] <> floor(v[2]) or v[2] >= 9223372036854775808 then 'time_index' when v[9] is null or not isfinite(v[9]) or v[9] < 0 then 'fuel' end as reason from n)"""
_OK = {"speed_over_ground": "v[3] >= 0", "wind_speed": "v[4] >= 0", "wind_direction": "v[5] between 0 and 360", "wave_height": "v[6] >= 0", "wave_period": "v[7] > 0", "current_speed": "v[8] >= 0"}

ORACLES: dict[str, str] = {
    "p3_found": f"{_LINES} select line_id, reason from r where reason is not null",
    "p3_summary": f"{_LINES} select coalesce(reason, 'valid') as reason, count(*) as n_lines from r group by 1",
    "p3_valid": f"{_LINES} select line_id, lower(trim(name)) as vessel_id, cast(v[2] as bigint) as time_index, " + ", ".join(f"case when {ok} and isfinite(v[{i}]) then v[{i}] end as {c}" for i, (c, ok) in enumerate(_OK.items(), 3)) + ", v[9] as fuel_consumption_kg_s from r where reason is null",
    "p4_series": f"""
        with r as (select leg_id, time_index // 300 as slot, total_momentary_fuel as x from partition_rows
                   where time_index is not null and time_index >= 0 and total_momentary_fuel is not null
                     and not isnan(total_momentary_fuel) and total_momentary_fuel >= 0),
             s as (select leg_id, slot, avg(x) as v, count(*) as k from r group by 1, 2),
             g as (select *, lead(slot) over (partition by leg_id order by slot) as nxt, lead(v) over (partition by leg_id order by slot) as nv from s),
             e as (select *, unnest(range(slot, coalesce(nxt, slot + 1))) as pos from g),
             n as (select x.leg_id, v.vessel_id, count(*) as k from partition_rows x join vessels v on {_NAMED} = v.vessel_id group by 1, 2),
             l as (select leg_id, arg_min(vessel_id, (-k, vessel_id)) as vessel_id from n group by 1)
        select e.leg_id, l.vessel_id, pos as slot, round(case when pos = slot then v when nxt - slot - 1 <= 12 then v + (nv - v) * (pos - slot) / (nxt - slot) end, 9) as total_momentary_fuel,
               case when pos = slot then k else 0 end as n_readings, case when pos = slot then 'reading' when nxt - slot - 1 <= 12 then 'filled' else 'marked' end as how
        from e left join l using (leg_id)""",
    "p5_counts": "with d as (select *, count(*) as copies from voyage_reports group by all), c as (select load_id, sum(copies) as n_loaded, coalesce(sum(copies) filter (copies > 1), 0) as n_equal, sum(copies - 1) as n_surplus, count(*) as n_rows from d group by 1), u as ("
    + " union all ".join(
        f"select load_id, '{c}' as column_name, " + (f"case when lower(regexp_replace({c}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')) not in ('', 'null', 'none', 'nan', 'na', 'n/a', 'nil', 'unknown', '-', '--', '?') then {c} end as t, null::double as x from d" if c in ("report_no", "current_gmt_dttm", "vessel_type") else f"case when not isnan({c}) then cast({c} as varchar) end as t, case when not isnan({c}) then {c} end as x from d")
        for c in ("report_no", "current_gmt_dttm", "vessel_type", "sailing_speed", "displacement", "wind_speed", "swell_height", "fuel_consumption_rate")
    )
    + ") select u.load_id, column_name, cast(any_value(n_loaded) as bigint) as n_loaded, cast(any_value(n_equal) as bigint) as n_equal, cast(any_value(n_surplus) as bigint) as n_surplus, count(*) as n_rows, count(*) - count(t) as n_missing, count(distinct t) as n_distinct, count(*) filter (x <= 0) as n_not_positive, min(x) as min_number, max(x) as max_number from u join c using (load_id) group by 1, 2",
    "p4_found": f"""
        with r as (select leg_id, time_index // 300 as slot from partition_rows
                   where time_index is not null and time_index >= 0 and total_momentary_fuel is not null
                     and not isnan(total_momentary_fuel) and total_momentary_fuel >= 0),
             s as (select distinct leg_id, slot from r),
             g as (select leg_id, slot, lead(slot) over (partition by leg_id order by slot) as nxt from s),
             e as (select leg_id, unnest(range(slot + 1, nxt)) as slot from g where nxt > slot + 1),
             n as (select x.leg_id, v.vessel_id, count(*) as k from partition_rows x join vessels v on {_NAMED} = v.vessel_id group by 1, 2),
             l as (select leg_id, arg_min(vessel_id, (-k, vessel_id)) as vessel_id from n group by 1)
        select e.leg_id, l.vessel_id, e.slot from e left join l using (leg_id)""",
    "p1_found": f"""
        with r as (select x.*, v.vessel_id as name, v.logger_model from vessel_records x join vessels v on {_NAMED} = v.vessel_id),
             odd as (select distinct logger_model, wave_height, name, time_index from r where not isnan(wave_height) and (wave_height < 0 or wave_height > 25)),
             c as (select logger_model, wave_height, count(*) as n, sum(count(*)) over (partition by logger_model) as total from odd group by 1, 2),
             code as (select logger_model, wave_height from c where n >= 3 and n >= 0.1 * total),
             p as (select x.*, v.vessel_id as name from partition_rows x left join vessels v on {_NAMED} = v.vessel_id),
             l as (select leg_id, mode(name) as name from p group by 1)
        select 'vessel_records' as table_name, row_id, 'wave_height' as field_name, name as vessel_id from r
        where wave_height is null or isnan(wave_height) or (logger_model, wave_height) in (select logger_model, wave_height from code)
        union all
        select 'vessel_records', row_id, 'wind_direction', name from r
        where wind_direction is null or isnan(wind_direction) or wind_direction < 0 or wind_direction > 360
        union all
        select 'partition_rows', p.row_id, 'vessel_id', l.name from p join l using (leg_id) where p.name is null""",
}
