"""Contracts, store inspection and legacy reports over tables with planted breaches, with SQL that counts them on its own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewright.functions import identity
from tidewright.operators import canonical, contracts, legacy, metrics, split, store
from tidewright.operators.badrows import FEATURES
from tidewright.session import stage, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

TARGET = canonical.TARGET


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _clean(spark, d):
    return table(spark, d, "fuelcast_clean")


def _rules(source: str, rules: dict[str, str], more: str = "") -> str:
    """SQL: one row for each rule with the number of rows for which it does not hold."""
    return source + " " + " union all ".join(f"select '{r}' as rule, count(*) filter (not coalesce({ok}, false)) as n_violations from t" for r, ok in rules.items()) + more




def _t():
    return F.col("time_index")


_FIN = "{0} is not null and isfinite({0})"
_RANGE = {c: f"{c} >= 0" for c in FEATURES} | {"wind_direction": "wind_direction between 0 and 360", "wave_period": "wave_period > 0"}
_ID = "sha256(unhex(lpad(to_hex(octet_length(encode({v}))), 16, '0')) || encode({v}) || unhex(lpad(to_hex(octet_length(encode(vessel_id))), 16, '0')) || encode(vessel_id) || unhex(lpad(to_hex(octet_length(encode(cast(time_index as varchar)))), 16, '0')) || encode(cast(time_index as varchar)))"

_BAD_SQL = f"""with b as (select case when time_index % 50 = 0 then repeat('0', 64) else record_id end as record_id, dataset_version, vessel_id, time_index,
  case when time_index % 60 = 0 then -1 when time_index % 61 = 0 then null else {TARGET} end as {TARGET}, speed_over_ground, wind_speed, current_speed,
  case when time_index % 70 = 0 then 400 else wind_direction end as wind_direction, case when time_index % 71 = 0 then 0 else wave_period end as wave_period,
  case when time_index % 80 = 0 then 'inf'::double else wave_height end as wave_height from fuelcast_clean),
 t as (select * from b union all select * from b where time_index % 90 = 0)"""


def _bad(spark, d) -> DataFrame:
    """The clean rows with breaches of every kind, some rows twice."""
    c = _clean(spark, d)
    b = c.withColumns({
        "record_id": F.when(_t() % 50 == 0, "0" * 64).otherwise(F.col("record_id")), TARGET: F.when(_t() % 60 == 0, -1.0).when(_t() % 61 == 0, None).otherwise(F.col(TARGET)),
        "wind_direction": F.when(_t() % 70 == 0, 400.0).otherwise(F.col("wind_direction")), "wave_period": F.when(_t() % 71 == 0, 0.0).otherwise(F.col("wave_period")),
        "wave_height": F.when(_t() % 80 == 0, float("inf")).otherwise(F.col("wave_height")),
    })
    return b.unionByName(b.where(_t() % 90 == 0))


@query(_rules(
    _BAD_SQL + ", v as (select min(dataset_version) as m from fuelcast_clean)",
    {"record_id": "record_id = " + _ID.format(v="dataset_version"), "dataset_version": "dataset_version = (select m from v)", "vessel_id": "vessel_id is not null", "time_index": "time_index >= 0",
     TARGET: _FIN.format(TARGET) + f" and {TARGET} >= 0", **{c: f"({c} is null or (isfinite({c}) and {_RANGE[c]}))" for c in FEATURES}},
    " union all select 'record_id_unique', count(*) from (select record_id from t group by 1 having count(*) > 1) union all select 'vessel_time_unique', count(*) from (select vessel_id, time_index from t group by 1, 2 having count(*) > 1) union all select 'not_empty', 0",
))
def contract_canonical(spark, d):
    """Breaches of the contract of canonical rows, by rule."""
    version = _clean(spark, d).agg(F.min("dataset_version")).first()[0]
    return contracts.canonical(_bad(spark, d), version)


_NUM = "regexp_matches(trim({0}), '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$')"


@query(_rules(
    f"""with t as (select record_id, dataset_version, vessel_id, case when time_index % 40 = 0 then cast(time_index as varchar) || '.0' when time_index % 41 = 0 then ' ' || cast(time_index as varchar) when time_index % 47 = 0 then '9223372036854775808' else cast(time_index as varchar) end as time_index,
      case when time_index % 44 = 0 then 'inf' when time_index % 45 = 0 then '-0.5' when time_index % 46 = 0 then '' else '1.5' end as {TARGET}, case when time_index % 42 = 0 then '' when time_index % 43 = 0 then 'x' else '2' end as wave_height,
      case when time_index % 48 = 0 then '1e999' else ' 3. ' end as wave_period, null::varchar as speed_over_ground, '1' as wind_speed, '.5' as wind_direction, '7_0' as current_speed from fuelcast_clean)""",
    {"record_id": "regexp_matches(record_id, '^[0-9a-f]{64}$')", "dataset_version": "regexp_matches(dataset_version, '^[0-9a-f]{40}$')", "vessel_id": "trim(vessel_id) <> ''",
     "time_index": "regexp_matches(time_index, '^(0|[1-9][0-9]*)$') and try_cast(time_index as bigint) is not null", TARGET: _NUM.format(TARGET) + f" and isfinite(try_cast(trim({TARGET}) as double)) and try_cast(trim({TARGET}) as double) >= 0",
     **{c: f"({c} is null or trim({c}) = '' or ({_NUM.format(c)} and trim({c}) <> '1e999'))" for c in FEATURES}},
))
def contract_canonical_text(spark, d):
    """Breaches in canonical rows that are still text, by rule."""
    text = _t().cast("string")
    return contracts.canonical_text(_clean(spark, d).select(
        "record_id", "dataset_version", "vessel_id", F.when(_t() % 40 == 0, F.concat(text, F.lit(".0"))).when(_t() % 41 == 0, F.concat(F.lit(" "), text)).when(_t() % 47 == 0, "9223372036854775808").otherwise(text).alias("time_index"),
        F.when(_t() % 44 == 0, "inf").when(_t() % 45 == 0, "-0.5").when(_t() % 46 == 0, "").otherwise("1.5").alias(TARGET), F.when(_t() % 42 == 0, "").when(_t() % 43 == 0, "x").otherwise("2").alias("wave_height"),
        F.when(_t() % 48 == 0, "1e999").otherwise(" 3. ").alias("wave_period"), F.lit(None).cast("string").alias("speed_over_ground"), F.lit("1").alias("wind_speed"), F.lit(".5").alias("wind_direction"), F.lit("7_0").alias("current_speed"),
    ))


_S = """s as (select *, row_number() over (partition by vessel_id order by time_index) as rn, count(*) over (partition by vessel_id) as n from fuelcast_clean),
     p as (select *, case when rn <= (7 * n) // 10 then 'train' when rn <= (85 * n) // 100 then 'validation' else 'test' end as split from s)"""


def _split(spark, d) -> DataFrame:
    return split.chronological(_clean(spark, d))


@query(f"""with {_S}, q as (select record_id, vessel_id, time_index, case when time_index % 200 = 0 and split = 'train' then 'validation' else split end as split, case when time_index % 210 = 0 then 'inf'::double else coalesce(speed_over_ground, 0) end as x, {TARGET} as y from p),
  t as (select * from q union all select * from q where time_index % 220 = 0),
  g as (select vessel_id, split, count(*) as n, min(time_index) as a, max(time_index) as b, list(record_id order by time_index, record_id) as ids from t group by 1, 2),
  w as (select vessel_id, split, count(*) as n, min(time_index) as a, max(time_index) as b, list(record_id order by time_index, record_id) as ids from p group by 1, 2),
  j as (select g.n as gn, w.n as wn, g.a as ga, w.a as wa, g.b as gb, w.b as wb, g.ids as gi, w.ids as wi from g full join w on g.vessel_id = w.vessel_id and g.split = w.split),
  i as (select record_id, count(*) as n, count(distinct split) as k from t group by 1),
  o as (select vessel_id, max(b) filter (split = 'train') as tb, min(a) filter (split = 'validation') as va, max(b) filter (split = 'validation') as vb, min(a) filter (split = 'test') as ta from g group by 1)
  select 'finite_x' as rule, count(*) filter (not isfinite(x)) as n_violations from t union all select 'finite_y', count(*) filter (y is null or not isfinite(y)) from t union all select 'part_name', 0
  union all select 'times_rise', count(*) from (select vessel_id, time_index from t group by 1, 2 having count(*) > 1)
  union all select 'ids_unique', count(*) filter (n > 1) from i union all select 'parts_disjoint', count(*) filter (k > 1) from i
  union all select 'parts_present', count(*) filter (tb is null or va is null or ta is null) from o union all select 'parts_in_order', count(*) filter (tb >= va or vb >= ta) from o
  union all select 'manifest_n_rows', count(*) filter (gn is distinct from wn) from j union all select 'manifest_first_time', count(*) filter (ga is distinct from wa) from j
  union all select 'manifest_last_time', count(*) filter (gb is distinct from wb) from j union all select 'manifest_digest', count(*) filter (gi is distinct from wi) from j""")
def contract_split(spark, d):
    """A saved split with rows moved, repeated and made infinite, against its manifest."""
    p = _split(spark, d).select("record_id", "vessel_id", "time_index", "split", F.coalesce("speed_over_ground", F.lit(0.0)).alias("x"), F.col(TARGET).alias("y"))
    q = p.withColumns({"split": F.when((_t() % 200 == 0) & (F.col("split") == "train"), "validation").otherwise(F.col("split")), "x": F.when(_t() % 210 == 0, float("inf")).otherwise(F.col("x"))})
    return contracts.saved_split(q.unionByName(q.where(_t() % 220 == 0)), contracts.part_summary(p), ["x", "y"])


@query(_rules(
    "with t as (select speed_over_ground / 4 as a_speed_over_ground, wind_speed / 4 as a_wind_speed, radians(wind_direction) * 1.01 as a_wind_direction, wave_height - 0.5 as a_wave_height, wave_period / 3 as a_wave_period, current_speed as a_current_speed from fuelcast_clean)",
    {f"a_{c}": f"a_{c} >= 0 and a_{c} <= {2 if c == 'wind_direction' else 1} * pi() + 1e-12" for c in FEATURES},
))
def contract_angles(spark, d):
    """Angles outside their ranges, by feature."""
    c = _clean(spark, d)
    return contracts.angle_ranges(c.select(
        (F.col("speed_over_ground") / 4).alias("a_speed_over_ground"), (F.col("wind_speed") / 4).alias("a_wind_speed"), (F.radians("wind_direction") * 1.01).alias("a_wind_direction"),
        (F.col("wave_height") - 0.5).alias("a_wave_height"), (F.col("wave_period") / 3).alias("a_wave_period"), F.col("current_speed").alias("a_current_speed"),
    ))


@query(f"""with {_S}, m as (select vessel_id, avg({TARGET}) as mu from p where split = 'train' group by 1), v as (select record_id, p.vessel_id, time_index, {TARGET} as y, mu from p join m using (vessel_id) where split = 'validation'),
  o as (select min(vessel_id) as first from v)
  select 'predicted_once' as rule, count(*) filter (time_index % 30 = 0 or time_index % 31 = 0) as n_violations from v union all select 'known_rows', 1 union all select 'finite', 0
  union all select 'metric_n_rows', 0 union all select 'metric_mae', 1 union all select 'metric_rmse', 0 union all select 'metric_r2', 0
  union all select 'reloaded_model', count(*) filter (time_index % 30 <> 0 and time_index % 33 = 0) + count(*) filter (time_index % 30 <> 0 and time_index % 31 = 0 and time_index % 33 = 0) + 1 from v""")
def contract_candidate(spark, d):
    """A candidate whose saved predictions lack rows, repeat others, know one row too many, claim one wrong metric and differ from the reloaded model."""
    p = _split(spark, d)
    mu = p.where("split = 'train'").groupBy("vessel_id").agg(F.avg(TARGET).alias("mu"))
    v = stage(p.where("split = 'validation'").join(mu, "vessel_id").select("record_id", "vessel_id", "time_index", F.col(TARGET).alias("y"), "mu"))
    saved = v.where(_t() % 30 != 0).select("record_id", "time_index", F.col("mu").alias("p"))
    saved = saved.unionByName(saved.where(_t() % 31 == 0)).unionByName(spark.createDataFrame([("nobody", 0, 0.0)], "record_id string, time_index long, p double"))
    again = v.where(_t() % 30 != 0).select("record_id", (F.col("mu") + F.when(_t() % 33 == 0, 0.5).otherwise(0.0)).alias("p"))
    first = v.agg(F.min("vessel_id").alias("first"))
    honest = metrics.grouped_metrics(v.where(_t() % 30 != 0).select("vessel_id", "y", F.col("mu").alias("p")), ["vessel_id"]).crossJoin(F.broadcast(first))  # one row
    claimed = honest.withColumn("mae", F.when(F.col("vessel_id") == F.col("first"), F.col("mae") + 0.001).otherwise(F.col("mae")))
    return contracts.candidate(saved.drop("time_index"), v, claimed, again=again)


@query(f"""with {_S}, b as (select record_id as id, case when time_index % 97 = 0 then 'other' else split end as part, case when time_index % 99 = 0 then {TARGET} + 1 else {TARGET} end as y, time_index from p),
  j as (select p.split, p.{TARGET} as y0, b.part, b.y, p.record_id as a, b.id from p full join (select case when time_index % 101 = 0 then 'x' || id else id end as id, part, y from b) b on p.record_id = b.id)
  select 'ids' as rule, count(*) filter (a is null or id is null) as n_violations from j union all select 'parts', count(*) filter (a is not null and id is not null and split <> part) from j
  union all select 'targets', count(*) filter (a is not null and id is not null and y0 is distinct from y) from j""")
def contract_same_partitions(spark, d):
    """Two saved splits that differ in ids, parts and targets."""
    p = _split(spark, d).select("record_id", "split", TARGET, "time_index")
    b = p.withColumns({
        "record_id": F.when(_t() % 101 == 0, F.concat(F.lit("x"), F.col("record_id"))).otherwise(F.col("record_id")),
        "split": F.when(_t() % 97 == 0, "other").otherwise(F.col("split")), TARGET: F.when(_t() % 99 == 0, F.col(TARGET) + 1).otherwise(F.col(TARGET)),
    })
    return contracts.same_partitions(p, b)


@query(_rules(
    "with t as (select case when time_index % 30 = 0 then 'inf'::double when time_index % 31 = 0 then 'nan'::double else speed_over_ground end as speed_over_ground, wind_speed, wind_direction, case when time_index % 32 = 0 then '-inf'::double else wave_height end as wave_height, wave_period, current_speed from fuelcast_clean)",
    {c: f"({c} is null or isnan({c}) or isfinite({c}))" for c in FEATURES},
))
def contract_inference_input(spark, d):
    """Infinite values among rows a model is asked about; missing ones are allowed."""
    c = _clean(spark, d)
    s = F.when(_t() % 30 == 0, float("inf")).when(_t() % 31 == 0, float("nan")).otherwise(F.col("speed_over_ground"))
    w = F.when(_t() % 32 == 0, float("-inf")).otherwise(F.col("wave_height"))
    return contracts.inference_input(c.select(s.alias("speed_over_ground"), "wind_speed", "wind_direction", w.alias("wave_height"), "wave_period", "current_speed"))


_VR = ("load_id", "report_no", "current_gmt_dttm", "vessel_type", "sailing_speed", "displacement", "wind_speed", "swell_height", "fuel_consumption_rate")
_GONE = {c: f"({c} is null or isnan({c}))" if i > 3 else f"{c} is null" for i, c in enumerate(_VR)}


@query("with t as (select " + ", ".join(f"count(*) filter ({g}) as {c}" for c, g in _GONE.items()) + ", count(*) as k, count(*) - (select count(*) from (select distinct * from voyage_reports)) as surplus from voyage_reports), r as ("
    + " union all ".join(f"select 'warning' as level, 'column_has_missing' as finding, '{c}' as subject, {c} as n from t" for c in _VR)
    + " union all select case when 100.0::double * (" + " + ".join(_VR) + ") / (k * 9) > 5 then 'error' else 'warning' end, 'cells_missing', '*', " + " + ".join(_VR) + " from t union all select 'warning', 'rows_repeated', '*', surplus from t"
    + " union all select 'error', 'column_missing', 'trim', 1 union all select 'warning', 'column_unexpected', 'load_id', 1 union all select 'error', 'target_not_numeric', 'vessel_type', 1) select * from r where n > 0")
def validation_report(spark, d):
    """Errors and warnings of a wide frame with a column missing, one too many and a target of text."""
    return contracts.validation_report(table(spark, d, "voyage_reports"), [*_VR[1:], "trim"], "vessel_type")


# ---- store ----


@query("""with t as (select record_id, vessel_id, time_index from fuelcast_clean union all select 'x' || record_id, vessel_id, time_index from fuelcast_clean where time_index % 25 = 0),
  k as (select vessel_id, time_index, count(*) as n, count(distinct record_id) as ids from t group by 1, 2) select vessel_id, cast(sum(n) as bigint) as active_rows, cast(sum(ids) as bigint) as active_ids, cast(sum(n - 1) as bigint) as duplicate_active_keys from k group by 1""")
def store_inspection(spark, d):
    """Active rows of a store by vessel, some of whose keys are held twice under other ids."""
    c = _clean(spark, d)
    more = c.where(_t() % 25 == 0).withColumn("record_id", F.concat(F.lit("x"), F.col("record_id")))
    return store.inspect(c.unionByName(more), "record_id", "vessel_id", "time_index", "dataset_version", c.agg(F.min("dataset_version")).first()[0])


@query("""with s as (select case when o_orderkey % 3 = 0 then -o_orderkey else o_orderkey end as k from orders union all select case when o_orderkey % 5 = 0 then null when o_orderkey % 7 = 0 then -7 else o_orderkey end from orders),
  g as (select k, count(*) as n from s group by 1) select cast(sum(n) as bigint) as source_rows, cast(coalesce(sum(n) filter (k is null), 0) as bigint) as keyless, cast(sum(n - 1) filter (k is not null) as bigint) as repeated,
  count(*) filter (k is not null and k in (select o_orderkey from orders)) as matched, 0::bigint as modified, count(*) filter (k is not null and k not in (select o_orderkey from orders)) as inserted from g""")
def insert_counts(spark, d):
    """What an insertion of absent keys does, with keys repeated and missing in the source."""
    o = table(spark, d, "orders").select("o_orderkey")
    k = F.col("o_orderkey")
    s = o.select(F.when(k % 3 == 0, -k).otherwise(k).alias("o_orderkey")).unionByName(o.select(F.when(k % 5 == 0, None).when(k % 7 == 0, -7).otherwise(k).alias("o_orderkey")))
    return store.insert_counts(s, o, "o_orderkey")


@query("select vessel_id, count(*) as source_rows, count(*) filter (time_index % 40 <> 0) as loaded_rows, count(*) = count(*) filter (time_index % 40 <> 0) as complete from fuelcast_clean group by 1")
def store_loaded_by_entity(spark, d):
    """After a load that lost some rows: what is there, by vessel."""
    c = _clean(spark, d)
    lost = c.withColumn("record_id", F.when(_t() % 40 == 0, F.lit("lost")).otherwise(F.col("record_id")))
    return store.loaded_by_entity(c, lost, "record_id", "vessel_id")


# ---- legacy frames ----


@query("select load_id, sailing_speed, fuel_consumption_rate, swell_height, cast(current_gmt_dttm as varchar) as observation_timestamp from voyage_reports where fuel_consumption_rate is not null and not isnan(fuel_consumption_rate)")
def legacy_columns(spark, d):
    """Legacy column names trimmed and renamed, rows without a target dropped, columns left out."""
    v = table(spark, d, "voyage_reports").withColumnsRenamed({"sailing_speed": " Sailing speed", "fuel_consumption_rate": "Fuel consumption rate ", "swell_height": "Swell height", "current_gmt_dttm": "Current GMT Dttm"})
    return legacy.without(legacy.with_target(legacy.renamed(v), "fuel_consumption_rate"), ["report_no", "vessel_type", "displacement", "wind_speed"])


@query("select event_type as stage, count(*) as n_batches, round(sum(value), 6) as seconds, round(max(value), 6) as longest from events group by 1")
def stage_timings(spark, d):
    """Time spent by stage, from one row for each batch."""
    t = metrics.timings(table(spark, d, "events").select(F.col("event_type").alias("stage"), F.col("value").alias("seconds")), "stage", "seconds")
    return t.withColumns({c: F.round(c, 6) for c in ("seconds", "longest")})


@query("select event_type as unit, count(*) as n_groups from (select distinct event_type, user_id from events) group by 1")
def group_counts(spark, d):
    """Distinct groups by unit, as a check before folds are made of them."""
    return split.group_counts(table(spark, d, "events"), "event_type", "user_id").withColumnRenamed("event_type", "unit")
