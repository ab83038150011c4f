"""One registered query for each telemetry operator, with SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewright.functions import angles, identity, parse
from tidewright.operators import canonical, features, keys, metrics, split, store
from tidewright.operators.badrows import FEATURES, SNAPSHOT_COLUMNS
from tidewright.session import stage, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

TARGET = canonical.TARGET
R = 6


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _clean(spark, d):
    return table(spark, d, "fuelcast_clean")


def _split(spark, d):
    """The chronological split, ranked once: what follows passes over the staged table."""
    return stage(split.chronological(_clean(spark, d)))


def _r(c, n=R):
    return F.round(c, n) + F.lit(0.0)  # no negative zero


# SQL shared by the oracles
_S = f"""s as (select *, row_number() over (partition by vessel_id order by time_index) as rn, count(*) over (partition by vessel_id) as n from fuelcast_clean),
     p as (select *, case when rn <= (7 * n) // 10 then 'train' when rn <= (85 * n) // 100 then 'validation' else 'test' end as split from s)"""
_REASON = """case when {c} is null or trim({c}) = '' then 'missing'
     when regexp_matches(lower(trim({c})), '^[+-]?(nan|inf|infinity)$') then 'nonfinite'
     when not regexp_matches(trim({c}), '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$') then 'nonnumeric'
     when isinf(try_cast(trim({c}) as double)) then 'nonfinite' else 'valid' end"""

# texts in the ways numbers come in, from the events table
_TEXT = """case event_id % 11 when 0 then '' when 1 then ' ' when 2 then 'bad' when 3 then 'inf' when 4 then '-' || cast(1 + event_id % 5 as varchar)
     when 5 then cast(event_id as varchar) || '.5' when 6 then cast(event_id as varchar) || '.0' when 7 then '1e3' when 8 then null when 9 then '1_000' else cast(event_id as varchar) end"""


def _text(e: DataFrame) -> DataFrame:
    i, s = F.col("event_id"), F.col("event_id").cast("string")
    v = [F.lit(""), F.lit(" "), F.lit("bad"), F.lit("inf"), F.concat(F.lit("-"), (1 + i % 5).cast("string")), F.concat(s, F.lit(".5")), F.concat(s, F.lit(".0")), F.lit("1e3"), F.lit(None).cast("string"), F.lit("1_000"), s]
    t = v[10]
    for k in range(9, -1, -1):
        t = F.when(i % 11 == k, v[k]).otherwise(t)
    return e.select("event_type", t.alias("txt"))


# ---- scans, projections, identity ----


@query("select record_id, dataset_version, vessel_id, time_index, fuel_consumption_kg_s, sha256(unhex(lpad(to_hex(octet_length(encode(dataset_version))), 16, '0')) || encode(dataset_version) || unhex(lpad(to_hex(octet_length(encode(vessel_id))), 16, '0')) || encode(vessel_id) || unhex(lpad(to_hex(octet_length(encode(cast(time_index as varchar)))), 16, '0')) || encode(cast(time_index as varchar))) = record_id as id_holds from fuelcast_clean")
def canonical_records(spark, d):
    """Typed canonical scan with every record id derived anew."""
    return _clean(spark, d).select(
        "record_id", "dataset_version", "vessel_id", "time_index", TARGET,
        (identity.record_id(F.col("dataset_version"), F.col("vessel_id"), F.col("time_index")) == F.col("record_id")).alias("id_holds"),
    )


@query("select event_id as record_no, event_type as vessel_id, epoch_us(ts) as time_index, cast(json_extract_string(props, '$.k') as bigint) as wind_direction, value as fuel from events")
def canonical_events(spark, d):
    """Rename and project raw columns; JSON field and time as integers."""
    e = table(spark, d, "events")
    return e.select(
        F.col("event_id").alias("record_no"), F.col("event_type").alias("vessel_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("time_index"),
        F.get_json_object("props", "$.k").cast("bigint").alias("wind_direction"), F.col("value").alias("fuel"),
    )


# ---- parsing and ranges ----


@query(f"with t as (select event_type, {_TEXT} as txt from events) select event_type, {_REASON.format(c='txt')} as reason, count(*) as n_rows from t group by 1, 2")
def parse_number_taxonomy(spark, d):
    e = parse.number(F.col("txt"))["error"]
    return _text(table(spark, d, "events")).groupBy("event_type", F.coalesce(e, F.lit("valid")).alias("reason")).agg(F.count("*").alias("n_rows"))


@query(f"""with t as (select event_type, {_TEXT} as txt from events), r as (select event_type, txt, {_REASON.format(c='txt')} as r0 from t)
select event_type, case when r0 <> 'valid' then r0 when cast(trim(txt) as double) < 0 then 'negative' when cast(trim(txt) as double) <> floor(cast(trim(txt) as double)) then 'nonintegral' else 'valid' end as reason, count(*) as n_rows from r group by 1, 2""")
def parse_time_taxonomy(spark, d):
    e = parse.step_number(F.col("txt"))["error"]
    return _text(table(spark, d, "events")).groupBy("event_type", F.coalesce(e, F.lit("valid")).alias("reason")).agg(F.count("*").alias("n_rows"))


_RANGED = {"wind_direction": "wind_direction < 0 or wind_direction > 360", "wave_period": "wave_period <= 0", "wind_speed": "wind_speed < 0", "wave_height": "wave_height < 0"}


@query("select row_id, " + ", ".join(f"case when not ({r}) then {c} end as {c}" for c, r in _RANGED.items()) + " from vessel_records")
def range_null_features(spark, d):
    """Features out of range become null, the row stays."""
    v = table(spark, d, "vessel_records")
    return v.select("row_id", *[F.when(~parse.out_of_range(c, F.col(c)), F.col(c)).alias(c) for c in _RANGED])


@query("select load_id, case when trim(coalesce(vessel_type, '')) = '' then 'UNKNOWN' else regexp_replace(vessel_type, '^\\s+|\\s+$', '', 'g') end as vessel_type, count(*) as n_rows from voyage_reports group by 1, 2")
def category_normalised(spark, d):
    return table(spark, d, "voyage_reports").groupBy("load_id", parse.category(F.col("vessel_type")).alias("vessel_type")).agg(F.count("*").alias("n_rows"))


@query("select load_id, count(*) as n_rows, count(coalesce(try_strptime(trim(current_gmt_dttm), '%Y-%m-%d %H:%M:%S'), try_strptime(trim(current_gmt_dttm), '%d.%m.%Y %H:%M'), try_strptime(trim(current_gmt_dttm), '%m/%d/%Y %H:%M'))) as n_dated, max(coalesce(try_strptime(trim(current_gmt_dttm), '%Y-%m-%d %H:%M:%S'), try_strptime(trim(current_gmt_dttm), '%d.%m.%Y %H:%M'), try_strptime(trim(current_gmt_dttm), '%m/%d/%Y %H:%M'))) as last_at from voyage_reports group by 1")
def mixed_timestamps(spark, d):
    t = parse.timestamp(F.col("current_gmt_dttm")).cast("timestamp_ntz")
    return table(spark, d, "voyage_reports").groupBy("load_id").agg(F.count("*").alias("n_rows"), F.count(t).alias("n_dated"), F.max(t).alias("last_at"))


# ---- duplicates, keys, order ----


@query("select l_orderkey, l_linenumber, l_quantity, l_extendedprice, count(*) as n_copies from (select * from lineitem union all select * from lineitem where l_returnflag = 'R') group by l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_partkey, l_suppkey, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate")
def exact_dedup(spark, d):
    x = table(spark, d, "lineitem")
    return keys.exact_duplicates(x.unionByName(x.where("l_returnflag = 'R'"))).select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "n_copies")


@query("with g as (select load_id, count(*) as k from voyage_reports group by all), u as (select load_id, report_no, current_gmt_dttm, vessel_type, sailing_speed, displacement, wind_speed, swell_height, fuel_consumption_rate, count(*) as k from voyage_reports group by all) select load_id, cast(sum(k - 1) as bigint) as n_removed from u group by 1")
def removed_duplicates(spark, d):
    return keys.removed_duplicates(table(spark, d, "voyage_reports"), "load_id")


@query("select l_orderkey, l_linenumber, count(*) as n_rows from lineitem group by 1, 2 having count(*) > 1")
def key_conflicts(spark, d):
    return keys.key_conflicts(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("select count(*) as n_rows, count(*) - count(report_no) as n_null, count(distinct report_no) as n_distinct, count(report_no) - count(distinct report_no) as n_surplus from voyage_reports")
def key_report(spark, d):
    return keys.key_report(table(spark, d, "voyage_reports"), "report_no")


@query("select leg_id, row_id, time_index, before from (select leg_id, row_id, time_index, lag(time_index) over (partition by leg_id order by row_id) as before from vessel_records) where before >= time_index")
def order_violations(spark, d):
    """Records of a leg that arrived after a later one."""
    return keys.order_violations(table(spark, d, "vessel_records"), "leg_id", "row_id", "time_index")


# ---- audit and profile ----

_RAW_SQL = f"select event_type as vessel_id, {_TEXT} as time_txt, cast(user_id as varchar) as fuel_txt, event_id % 40 as slot from events"


def _raw_events(spark, d) -> DataFrame:
    """Text rows in the snapshot's columns, with exact copies of every seventh event."""
    e = table(spark, d, "events")
    i = F.col("event_id")
    fuel = F.when(i % 13 == 0, "").when(i % 13 == 1, "bad").when(i % 13 == 2, "inf").when(i % 13 == 3, "-1").otherwise(F.col("value").cast("decimal(18,2)").cast("string"))
    when = F.when(i % 17 == 0, "").when(i % 17 == 1, "x").when(i % 17 == 2, "-1").when(i % 17 == 3, "1.5").otherwise(i.cast("string"))
    row = e.select(
        F.col("event_type").alias("vessel_id"), when.alias("time_index"),
        F.when(i % 5 == 0, "bad").otherwise("2").alias(SNAPSHOT_COLUMNS[2]), F.when(i % 5 == 1, "inf").otherwise("3").alias(SNAPSHOT_COLUMNS[3]),
        F.when(i % 5 == 2, "361").otherwise("90").alias(SNAPSHOT_COLUMNS[4]), F.when(i % 5 == 3, "").otherwise("4").alias(SNAPSHOT_COLUMNS[5]),
        F.when(i % 5 == 4, "0").otherwise("5").alias(SNAPSHOT_COLUMNS[6]), F.when(i % 7 == 0, "-1").otherwise("6").alias(SNAPSHOT_COLUMNS[7]),
        fuel.alias(SNAPSHOT_COLUMNS[8]), i.alias("_i"),
    )
    return row.unionByName(row.where("_i % 7 = 0")).drop("_i")


_AUDIT_SQL = """with e as (select event_type as vessel_id, event_id as i, value from events),
 r as (select vessel_id, i, value, case when i % 17 = 0 then '' when i % 17 = 1 then 'x' when i % 17 = 2 then '-1' when i % 17 = 3 then '1.5' else cast(i as varchar) end as t,
   case when i % 13 = 0 then '' when i % 13 = 1 then 'bad' when i % 13 = 2 then 'inf' when i % 13 = 3 then '-1' else cast(cast(value as decimal(18,2)) as varchar) end as f, i % 5 as a, i % 7 = 0 as b from e),
 c as (select * from r union all select * from r where i % 7 = 0),
 u as (select vessel_id, t, f, a, b, count(*) as k from c group by all),
 w as (select *, case when f = '' then 'target_missing' when f = 'bad' then 'target_nonnumeric' when f = 'inf' then 'target_nonfinite' when f = '-1' then 'target_negative'
   when t = '' then 'time_missing' when t = 'x' then 'time_nonnumeric' when t = '-1' then 'time_negative' when t = '1.5' then 'time_nonintegral' else 'kept' end as fate from u)"""


@query(_AUDIT_SQL + """ select vessel_id, cast(grouping(vessel_id) as integer) as is_total, cast(sum(k) as bigint) as input_rows, count(*) filter (fate = 'kept') as output_rows, cast(sum(k - 1) as bigint) as exact_duplicates,
  count(*) filter (fate = 'target_missing') as target_missing, count(*) filter (fate = 'target_nonnumeric') as target_nonnumeric, count(*) filter (fate = 'target_nonfinite') as target_nonfinite, count(*) filter (fate = 'target_negative') as target_negative,
  count(*) filter (fate = 'time_missing') as time_missing, count(*) filter (fate = 'time_nonnumeric') as time_nonnumeric, count(*) filter (fate = 'time_nonfinite') as time_nonfinite, count(*) filter (fate = 'time_negative') as time_negative, count(*) filter (fate = 'time_nonintegral') as time_nonintegral,
  count(*) filter (fate = 'kept' and a = 0) as speed_over_ground_nonnumeric, count(*) filter (fate = 'kept' and a = 1) as wind_speed_nonfinite, count(*) filter (fate = 'kept' and a = 2) as wind_direction_range,
  count(*) filter (fate = 'kept' and a = 3) as wave_height_missing, count(*) filter (fate = 'kept' and a = 4) as wave_period_range, count(*) filter (fate = 'kept' and b) as current_speed_range
  from w group by rollup (vessel_id)""")
def clean_audit(spark, d):
    """Every count of the cleaning by entity and in all."""
    a = canonical.audit(canonical.classified(_raw_events(spark, d)))
    return a.select(
        "vessel_id", "is_total", "input_rows", "output_rows", "exact_duplicates", *[f"target_{r}" for r in canonical.TARGET_REASONS], *[f"time_{r}" for r in canonical.TIME_REASONS],
        "speed_over_ground_nonnumeric", "wind_speed_nonfinite", "wind_direction_range", "wave_height_missing", "wave_period_range", "current_speed_range",
    )


@query(_AUDIT_SQL + " select vessel_id, cast(t as bigint) as time_index, case when a not in (0) then 2.0::double end as speed_over_ground, case when a <> 2 then 90.0::double end as wind_direction, cast(f as double) as fuel_consumption_kg_s from w where fate = 'kept'")
def canonical_rows(spark, d):
    c = canonical.clean_rows(canonical.classified(_raw_events(spark, d)), "0" * 40)
    return c.select("vessel_id", "time_index", "speed_over_ground", "wind_direction", TARGET)


_VR = ("report_no", "current_gmt_dttm", "vessel_type", "sailing_speed", "displacement", "wind_speed", "swell_height", "fuel_consumption_rate")


@query("select load_id, count(*) as n_rows, " + ", ".join(f"count(*) - count({c}) as {c}_nulls" for c in _VR) + " from (select load_id, " + ", ".join(c if c in _VR[:3] else f"case when not isnan({c}) then {c} end as {c}" for c in _VR) + " from voyage_reports) group by 1")
def null_profile(spark, d):
    v = table(spark, d, "voyage_reports")
    value = lambda c: F.col(c) if c in _VR[:3] else parse.finite(F.col(c))
    return v.groupBy("load_id").agg(F.count("*").alias("n_rows"), *[(F.count("*") - F.count(value(c))).alias(f"{c}_nulls") for c in _VR])


@query("with c as (select count(*) * 8 as cells, " + " + ".join(f"(count(*) - count({c}))" for c in _VR) + " as nulls from voyage_reports) select cells, nulls, round(100.0::double * nulls / cells, 6) as missing_pct, 100.0::double * nulls / cells > 5.0 as is_error from c")
def missing_pct(spark, d):
    """Missing cells against the threshold of five per cent."""
    v = table(spark, d, "voyage_reports")
    a = v.agg((F.count("*") * 8).alias("cells"), sum((F.count("*") - F.count(c) for c in _VR), F.lit(0)).alias("nulls"))
    pct = 100.0 * F.col("nulls") / F.col("cells")
    return a.select("cells", F.col("nulls").cast("long").alias("nulls"), _r(pct).alias("missing_pct"), (pct > 5.0).alias("is_error"))


# ---- splits and samples ----


@query(f"with {_S} select record_id, vessel_id, time_index, split, rn from p")
def chrono_split(spark, d):
    return _split(spark, d).select("record_id", "vessel_id", "time_index", "split", "rn")


@query(f"with {_S} select vessel_id, split, count(*) as n_rows, min(time_index) as first_time, max(time_index) as last_time from p group by 1, 2")
def split_boundaries(spark, d):
    return split.boundaries(_split(spark, d))


@query(f"with {_S} select count(*) as n_common from (select record_id from p where split = 'train' intersect select record_id from p where split <> 'train')")
def split_disjoint(spark, d):
    p = _split(spark, d)
    return keys.overlap(p.where("split = 'train'"), p.where("split <> 'train'"), "record_id").agg(F.count("*").alias("n_common"))


@query(f"with {_S}, i as (select vessel_id, split, time_index // 8192 as b, sha256(to_json(list(record_id order by time_index))) as d from p group by 1, 2, 3) select vessel_id, split, sha256(string_agg(d, '' order by b)) as digest from i group by 1, 2")
def split_digests(spark, d):
    """Digest of the ordered ids of each part."""
    return identity.list_digest(_split(spark, d), ["vessel_id", "split"], "time_index", "record_id")


@query("with h as (select o_orderkey, row_number() over (order by sha256('42:' || cast(o_orderkey as varchar)), o_orderkey) as rn, count(*) over () as n from orders) select o_orderkey, case when rn <= (n + 4) // 5 then 'test' else 'train' end as split from h")
def hash_split(spark, d):
    return split.hashed(table(spark, d, "orders").select("o_orderkey"), "o_orderkey").select("o_orderkey", "split")


_LIN = "select i, case when k <= 1 then 0 when i = k - 1 then n - 1 else cast(floor(i * ((n - 1)::double / (k - 1))) as bigint) end as pos"


@query(f"with {_S}, t as (select *, count(*) over (partition by vessel_id) as m, row_number() over (partition by vessel_id order by time_index) - 1 as pos from p where split = 'train'), e as (select vessel_id, max(m) as n, least(max(m), 40) as k from t group by 1), x as (select vessel_id, n, k, unnest(range(k)) as i from e), w as (select distinct vessel_id, case when k <= 1 then 0 when i = k - 1 then n - 1 else cast(floor(i * ((n - 1)::double / (k - 1))) as bigint) end as pos from x) select t.vessel_id, t.time_index from t join w using (vessel_id, pos)")
def sample_linspace(spark, d):
    """Forty evenly spaced training rows of each vessel."""
    return split.capped_sample(_split(spark, d).where("split = 'train'").drop("rn", "n"), 40).select("vessel_id", "time_index")


@query(f"""with {_S}, t as (select *, row_number() over (partition by vessel_id order by time_index) - 1 as pos from p where split = 'train'),
 c as (select vessel_id, count(*) as n from t group by 1), y as (select *, cast(sum(n) over () as bigint) as total from c), z as (select *, 600 * n // total as whole, 600 * n % total as rem from y),
 st as (select *, greatest(whole, 1) as k0, cast(600 - sum(greatest(whole, 1)) over () as bigint) as missing from z),
 back as (select vessel_id, row_number() over (order by rem + j * total, vessel_id desc) as o from (select *, unnest(range(greatest(k0 - 1, 0))) as j from st)),
 k as (select st.vessel_id, n, k0 + case when missing > 0 and row_number() over (order by rem desc, vessel_id) <= missing then 1 else 0 end - (select count(*) from back b where b.vessel_id = st.vessel_id and b.o <= -missing) as k from st),
 w as (select distinct vessel_id, case when k <= 1 then 0 when i = k - 1 then n - 1 else cast(floor(i * ((n - 1)::double / (k - 1))) as bigint) end as pos from (select *, unnest(range(k)) as i from k))
 select t.vessel_id, t.time_index from t join w using (vessel_id, pos)""")
def sample_proportional(spark, d):
    """Six hundred training rows in all, shared out by largest remainders."""
    return split.proportional_sample(_split(spark, d).where("split = 'train'").drop("rn", "n"), 600).select("vessel_id", "time_index")


# ---- fitted transforms ----

_MED = ", ".join(f"median({f}) filter (split = 'train') as m_{f}" for f in FEATURES if f != "wind_direction")
_CIRC = "case when sqrt(power(avg(sin(radians(wind_direction))) filter (split = 'train'), 2) + power(avg(cos(radians(wind_direction))) filter (split = 'train'), 2)) > 1e-12 then (degrees(atan2(avg(sin(radians(wind_direction))) filter (split = 'train'), avg(cos(radians(wind_direction))) filter (split = 'train'))) + 360) % 360 else 0 end as m_wind_direction"
_FITS = f"{_S}, f as (select {_MED}, {_CIRC} from p)"


@query(f"with {_FITS} select record_id, split, " + ", ".join(f"round(coalesce({f}, m_{f}), 6) as {f}, {f} is null as {f}_was_missing" for f in FEATURES) + " from p, f")
def median_impute_flagged(spark, d):
    """Gaps filled by training medians (the direction by its circular mean), flagged."""
    p = _split(spark, d)
    x = features.Imputer.fit(p.where("split = 'train'")).transform(p)
    return x.select("record_id", "split", *[_r(F.col(f)).alias(f) for f in FEATURES], *[f"{f}_was_missing" for f in FEATURES])


@query("select vessel_id, round(case when sqrt(power(avg(sin(radians(wind_direction))), 2) + power(avg(cos(radians(wind_direction))), 2)) > 1e-12 then (degrees(atan2(avg(sin(radians(wind_direction))), avg(cos(radians(wind_direction))))) + 360) % 360 else 0 end, 4) as mean_direction from fuelcast_clean group by 1")
def circular_means(spark, d):
    return _clean(spark, d).groupBy("vessel_id").agg(_r(angles.circular_mean(F.col("wind_direction")), 4).alias("mean_direction"))


@query("select record_id, round(sin(radians(wind_direction)), 9) + 0.0::double as wind_direction_sin, round(cos(radians(wind_direction)), 9) + 0.0::double as wind_direction_cos from fuelcast_clean")
def circular_encode(spark, d):
    e = features.encoded_direction(_clean(spark, d))
    return e.select("record_id", _r(F.col("wind_direction_sin"), 9).alias("wind_direction_sin"), _r(F.col("wind_direction_cos"), 9).alias("wind_direction_cos"))


@query(f"with {_FITS}, x as (select record_id, split, " + ", ".join(f"coalesce({f}, m_{f}) as {f}" for f in FEATURES) + " from p, f), y as (select *, sin(radians(wind_direction)) as wind_direction_sin, cos(radians(wind_direction)) as wind_direction_cos from x), st as (select " + ", ".join(f"avg({c}) filter (split = 'train') as a_{c}, stddev_pop({c}) filter (split = 'train') as d_{c}" for c in features.CLASSICAL) + " from y) select record_id, split, " + ", ".join(f"round(({c} - a_{c}) / case when d_{c} = 0 then 1 else d_{c} end, 6) as z_{c}" for c in features.CLASSICAL) + " from y, st")
def standardize_train_fit(spark, d):
    """Impute, encode and standardise on training rows: the seven features of the classical models."""
    x = features.classical_features(_split(spark, d))[0]
    return x.select("record_id", "split", *[_r(F.col(f"z_{c}")).alias(f"z_{c}") for c in features.CLASSICAL])


_MM = ", ".join(f"min({c}) filter (split = 'train') as lo_{c}, max({c}) filter (split = 'train') as hi_{c}" for c in (*FEATURES, TARGET))


@query(f"with {_S}, m as (select {_MM} from p) select record_id, split, " + ", ".join(f"case when {f} is not null then round(least(greatest(({f} - lo_{f}) / (hi_{f} - lo_{f}) * pi(), 0), pi()), 6) end as a_{f}" for f in FEATURES if f != "wind_direction") + f", round(radians(wind_direction), 6) as a_wind_direction, round(-1 + ({TARGET} - lo_{TARGET}) / (hi_{TARGET} - lo_{TARGET}) * 2, 6) as {TARGET}_scaled from p, m")
def minmax_angle(spark, d):
    """Rotation angles of six features and the target in [-1, 1], by the training range."""
    p = _split(spark, d)
    m = features.MinMax.fit(p.where("split = 'train'"), (*FEATURES, TARGET))
    x = features.target_scaled(features.angle_features(p, m), m, TARGET)
    return x.select("record_id", "split", *[_r(F.col(f"a_{f}")).alias(f"a_{f}") for f in FEATURES], _r(F.col(f"{TARGET}_scaled")).alias(f"{TARGET}_scaled"))


@query("with m as (select o_orderpriority as v from (select o_orderpriority, count(*) as n from orders where o_orderkey % 5 <> 0 group by 1) order by n desc, o_orderpriority limit 1), x as (select o_orderkey, coalesce(case when o_orderkey % 5 <> 0 then o_orderpriority end, m.v) as v from orders, m) select o_orderkey, " + ", ".join(f"cast(v = '{p}' as integer) as \"p_{p[0]}\"" for p in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")) + " from x")
def mode_impute_onehot(spark, d):
    """A category with gaps, filled by its mode and spread into 0/1 columns."""
    o = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderpriority")).alias("p"))
    h = features.OneHot.fit(o, "p")
    x = h.transform(o, "p")
    return x.select("o_orderkey", *[(F.col(f"`p_{v}`") if v in h.values else F.lit(0)).alias(f"p_{v[0]}") for v in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")])


# ---- metrics, ranks, correlations ----

_PRED = f"with {_S}, m as (select vessel_id, avg({TARGET}) as mu from p where split = 'train' group by 1), q as (select p.vessel_id, p.split, {TARGET} as y, mu as p from p join m using (vessel_id))"
_MET = "count(*) as n_rows, round(avg(abs(y - p)), 6) as mae, round(sqrt(avg((y - p) * (y - p))), 6) as rmse, round(case when count(y) >= 2 then 1 - sum((y - p) * (y - p)) / (var_pop(y) * count(y)) end, 6) + 0.0::double as r2"


def _predicted(spark, d) -> DataFrame:
    p = _split(spark, d)
    mu = p.where("split = 'train'").groupBy("vessel_id").agg(F.avg(TARGET).alias("p"))
    return p.join(mu, "vessel_id").select("vessel_id", "split", F.col(TARGET).alias("y"), "p")


def _rounded(m: DataFrame) -> DataFrame:
    return m.withColumns({c: _r(F.col(c)) for c in ("mae", "rmse", "r2")})


@query(_PRED + f" select {_MET} from q where split = 'validation'")
def regression_metrics(spark, d):
    return _rounded(metrics.metrics(_predicted(spark, d).where("split = 'validation'")))


@query(_PRED + f" select vessel_id, split, cast(grouping(vessel_id) as integer) as is_total, {_MET} from q group by grouping sets ((vessel_id, split), ())")
def regression_metrics_grouped(spark, d):
    return _rounded(metrics.grouped_metrics(_predicted(spark, d), ["vessel_id", "split"]))


@query(f"""with {_S}, m as (select vessel_id, avg({TARGET}) as mu, median({TARGET}) as med, max({TARGET}) as top from p where split = 'train' group by 1), g as (select avg({TARGET}) as gm from p where split = 'train'),
 sc as (select unnest(['vessel_mean', 'vessel_median', 'vessel_max', 'global_mean', 'zero']) as candidate, unnest([mu, med, top, gm, 0]) as pr, {TARGET} as y from p join m using (vessel_id), g where split = 'validation'),
 r as (select candidate, round(avg(abs(y - pr)), 6) as mae from sc group by 1) select candidate, mae, row_number() over (order by mae, candidate) as rank from r""")
def leaderboard(spark, d):
    """Five closed-form candidates ranked by validation error, ties by name."""
    p = _split(spark, d)
    train = p.where("split = 'train'")
    middle = features.grouped_medians(train, [TARGET], ("vessel_id",)).select("vessel_id", F.col("value").alias("vessel_median"))
    m = train.groupBy("vessel_id").agg(F.avg(TARGET).alias("vessel_mean"), F.max(TARGET).alias("vessel_max")).join(middle, "vessel_id")
    g = train.agg(F.avg(TARGET).alias("global_mean"))
    v = p.where("split = 'validation'").join(m, "vessel_id").crossJoin(F.broadcast(g)).withColumn("zero", F.lit(0.0))  # g is one row
    long = v.unpivot([TARGET], ["vessel_mean", "vessel_median", "vessel_max", "global_mean", "zero"], "candidate", "pr")
    return metrics.leaderboard(long.groupBy("candidate").agg(_r(F.avg(F.abs(F.col(TARGET) - F.col("pr")))).alias("mae")))


_CORR = ("speed_over_ground", "wind_speed", "wave_height", "wave_period", "current_speed")


@query("select " + ", ".join(f"round(corr({c}, {TARGET}), 6) as {c}" for c in _CORR) + " from fuelcast_clean")
def corr_leakage(spark, d):
    """Correlation of every feature with the target, in one pass."""
    c = _clean(spark, d)
    both = lambda a, b: (F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), F.col(x)) for x in (a, b))
    out = []
    for f in _CORR:
        x, y = both(f, TARGET)
        out.append(_r(F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))).alias(f))
    return c.agg(*out)


@query("select " + ", ".join(f"round(corr({a}, {b}), 6) as {a}__{b}" for i, a in enumerate(("l_quantity", "l_extendedprice", "l_discount", "l_tax")) for b in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")[i + 1 :]) + " from lineitem")
def corr_pairs(spark, d):
    r = features.correlations(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    return spark.createDataFrame([tuple(round(x, 6) if x is not None else None for x in r.values())], ", ".join(f"`{a}__{b}` double" for a, b in r))


# ---- store ----

_ORDERS = "select case when o_orderkey % 3 = 0 then -o_orderkey else o_orderkey end as o_orderkey, o_custkey, o_totalprice + 1 as o_totalprice from orders"


def _order_sides(spark, d) -> tuple[DataFrame, DataFrame]:
    """(source, target): all orders, and the same with other prices and every third under another key."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    k = F.col("o_orderkey")
    source = o.select(F.when(k % 3 == 0, -k).otherwise(k).alias("o_orderkey"), "o_custkey", (F.col("o_totalprice") + 1).alias("o_totalprice"))
    return source.withColumn("side", F.lit("source")), o.withColumn("side", F.lit("target"))


@query(f"with s as ({_ORDERS}) select o_orderkey, o_custkey, o_totalprice, 'target' as side from orders union all select o_orderkey, o_custkey, o_totalprice, 'source' from s where o_orderkey not in (select o_orderkey from orders)")
def upsert_insert_absent(spark, d):
    return store.insert_absent(*_order_sides(spark, d), "o_orderkey")


@query(f"with s as ({_ORDERS}) select o_orderkey, o_custkey, o_totalprice, 'source' as side from s union all select o_orderkey, o_custkey, o_totalprice, 'target' from orders where o_orderkey not in (select o_orderkey from s)")
def upsert_replace(spark, d):
    return store.replace(*_order_sides(spark, d), "o_orderkey")


@query("""with s as (select case when time_index % 4 = 0 then 'new' || record_id else record_id end as id, time_index, fuel_consumption_kg_s as f from fuelcast_clean),
 t as (select record_id as id, time_index, case when time_index % 10 = 0 then fuel_consumption_kg_s + 1 else fuel_consumption_kg_s end as f from fuelcast_clean),
 j as (select s.id as a, t.id as b, s.f as sf, t.f as tf from s full join t on s.id = t.id)
 select count(a) as source_rows, count(*) filter (a is not null and b is not null) as matched, count(*) filter (a is not null and b is not null and sf is distinct from tf) as conflicts, count(*) filter (a is null) as extras, count(*) filter (b is null) as to_insert, 0::bigint as null_ids, 0::bigint as duplicate_ids from j""")
def store_preflight(spark, d):
    """What a load of one table into another would meet, without writing."""
    c = _clean(spark, d)
    t = c.withColumn(TARGET, F.when(F.col("time_index") % 10 == 0, F.col(TARGET) + 1).otherwise(F.col(TARGET)))
    s = c.withColumn("record_id", F.when(F.col("time_index") % 4 == 0, F.concat(F.lit("new"), F.col("record_id"))).otherwise(F.col("record_id")))
    return store.preflight(s, t, "record_id", ["time_index", TARGET], "vessel_id", "dataset_version")


@query("select coalesce(a.event_id, b.event_id) as event_id from events a full join (select case when event_id % 97 = 0 then -1 - event_id else event_id end as event_id, case when event_id % 50 = 0 then 'other' else event_type end as event_type, user_id from events) b using (event_id) where b.event_type is null or a.event_type is distinct from b.event_type or a.user_id is distinct from b.user_id")
def identity_alignment(spark, d):
    """Positions at which two datasets do not hold the same identity."""
    e = table(spark, d, "events").select("event_id", "event_type", "user_id")
    i = F.col("event_id")
    b = e.select(F.when(i % 97 == 0, -1 - i).otherwise(i).alias("event_id"), F.when(i % 50 == 0, "other").otherwise(F.col("event_type")).alias("event_type"), "user_id")
    return keys.misaligned(e, b, "event_id", ["event_type", "user_id"])


# ---- legacy cleaning ----


@query("""with r as (select distinct sailing_speed, displacement, swell_height, case when trim(coalesce(vessel_type, '')) = '' then 'UNKNOWN' else regexp_replace(vessel_type, '^\\s+|\\s+$', '', 'g') end as vessel_type
   from (select vessel_type, case when isfinite(sailing_speed) then sailing_speed end as sailing_speed, case when isfinite(displacement) then displacement end as displacement, case when isfinite(swell_height) then swell_height end as swell_height from voyage_reports)),
 m as (select median(sailing_speed) as a, median(displacement) as b, median(swell_height) as c from r)
 select coalesce(sailing_speed, a) as sailing_speed, coalesce(displacement, b) as displacement, coalesce(swell_height, c) as swell_height, cast(sailing_speed is null as tinyint) as sailing_speed_was_missing, cast(displacement is null as tinyint) as displacement_was_missing, cast(swell_height is null as tinyint) as swell_height_was_missing, vessel_type from r, m""")
def legacy_clean(spark, d):
    """Wide frame: normalise, merge equal rows, fill by medians, flag what was filled."""
    return canonical.legacy_clean(table(spark, d, "voyage_reports"), ["sailing_speed", "displacement", "swell_height"], ["vessel_type"]).drop("record_id")


# ---- models: rows only, no SQL ----


@query()
def rotation_predictions(spark, d):
    """Expectations of a six-qubit rotation regressor with fixed weights, in kg/s."""
    import numpy as np

    from tidewright.models import rotations

    p = _split(spark, d)
    m = features.MinMax.fit(p.where("split = 'train'"), (*FEATURES, TARGET))
    low, high = m.ranges[TARGET]
    return rotations.predict(features.angle_features(p, m), [f"a_{f}" for f in FEATURES], np.linspace(0.1, 1.2, 12), "record_id", low, high)


@query(f"""with {_S}, t as (select avg(speed_over_ground) as mx, avg({TARGET}) as my, covar_pop(speed_over_ground, {TARGET}) as c, var_pop(speed_over_ground) as v, count(*) as k from p where split = 'train' and speed_over_ground is not null)
select record_id, round(my + c / (v + 1.0::double / k) * (speed_over_ground - mx), 5) as prediction from p, t where split = 'validation' and speed_over_ground is not null""")
def ridge_closed_form(spark, d):
    """Ridge (penalty 1) of fuel on speed, fitted on training rows."""
    from tidewright.models import regress

    p = _split(spark, d).where("speed_over_ground is not null").select("record_id", "split", "speed_over_ground", TARGET)
    x = regress.assembled(p, ("speed_over_ground",))
    train = x.where("split = 'train'")
    m = regress.estimator("ridge", {"alpha": 1.0}, train, TARGET).fit(train)
    return m.transform(x.where("split = 'validation'")).select("record_id", _r(F.col("prediction"), 5).alias("prediction"))


def _model(name, params):
    def run(spark, d):
        from tidewright.models import regress

        x = regress.assembled(features.classical_features(_split(spark, d))[0], tuple(f"z_{c}" for c in features.CLASSICAL))
        train = x.where("split = 'train'")
        return regress.estimator(name, params, train, TARGET).fit(train).transform(x.where("split = 'validation'")).select("record_id", "prediction")

    return run


QUERIES["rf_predict"] = _model("random_forest", {"trees": 20, "depth": 6, "leaf": 2})
QUERIES["gbt_predict"] = _model("gradient_boosting", {"rounds": 10, "rate": 0.1, "depth": 3})
