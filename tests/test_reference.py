"""Telemetry operators: the scenarios of the survey, properties, and SQL at a small scale."""

import glob
import hashlib
import math
import os

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tidewright.functions import angles, identity, parse
from tidewright.models import regress, rotations, swarm
from tidewright.operators import canonical, contracts, features, keys, legacy, metrics, split, store
from tidewright.operators.badrows import FEATURES, SNAPSHOT_COLUMNS
from tidewright.plans import contract_queries, pipeline, quality_queries, reference_queries
from tidewright.sources import publish, scan

RAW = ", ".join(f"{c} string" for c in SNAPSHOT_COLUMNS)
TARGET = canonical.TARGET
VERSION = "a" * 40


def raw(vessel="a", t="1", speed="2", wind="3", direction="90", height="4", period="5", current="6", fuel="1.5"):
    return (vessel, t, speed, wind, direction, height, period, current, fuel)


def audit_of(spark, rows):
    return {r.vessel_id: r for r in canonical.audit(canonical.classified(spark.createDataFrame(rows, RAW))).collect()}


def test_cleaning_reasons_add_up(spark):
    rows = [raw(), raw()] + [raw(fuel=f) for f in ("", "bad", "inf", "-1")] + [raw(t=t) for t in ("", "-1", "1.5")]
    a = audit_of(spark, rows)["a"]
    assert (a.input_rows, a.output_rows, a.exact_duplicates) == (9, 1, 1)
    assert [a[f"target_{r}"] for r in canonical.TARGET_REASONS] == [1, 1, 1, 1]
    assert (a.time_missing, a.time_negative, a.time_nonintegral) == (1, 1, 1)


def test_copies_go_before_validity(spark):
    a = audit_of(spark, [raw("b", t="")] * 4 + [raw("c", t="", fuel=str(i)) for i in range(8)])
    assert a["b"].exact_duplicates == 3 and a["b"].time_missing == 1 and a["c"].time_missing == 8
    assert a[None].is_total == 1 and a[None].time_missing == 9


def test_features_become_null_and_rows_stay(spark):
    clean, audit = canonical.canonicalize(spark.createDataFrame([raw(speed="bad", wind="inf", direction="361", height="", period="0", current="-1")], RAW), VERSION, ["a"])
    r = clean.first()
    assert [r[f] for f in FEATURES] == [None] * 6 and r[TARGET] == 1.5 and r.time_index == 1
    a = audit.where("is_total = 0").first()
    assert (a.speed_over_ground_nonnumeric, a.wind_direction_range, a.wave_period_range, a.current_speed_range) == (1, 1, 1, 1)


@pytest.mark.parametrize("rows", [[raw(), raw(fuel="2")], [raw(), raw("b", fuel="")], [raw("zz")], [raw(), raw(t="1.0", fuel="2")]])
def test_conflicts_abort(spark, rows):
    with pytest.raises(ValueError):
        canonical.canonicalize(spark.createDataFrame(rows, RAW), VERSION, ["a", "b"])


def test_ids_order_and_content(spark):
    df = spark.createDataFrame([raw(t="1"), raw(t="0", fuel="2")], RAW)
    clean = canonical.canonicalize(df, VERSION)[0]
    assert [r.time_index for r in clean.collect()] == [0, 1]

    def by_hand(*xs):
        h = hashlib.sha256()
        for x in xs:
            h.update(len(x.encode()).to_bytes(8, "big") + x.encode())
        return h.hexdigest()

    assert clean.first().record_id == by_hand(VERSION, "a", "0")
    assert identity.content_hash(clean) == identity.content_hash(clean.orderBy(F.desc("time_index")))
    x = spark.createDataFrame([(None, "x"), ("x", None)], "a string, b string")
    assert x.select(identity.row_id(x)).distinct().count() == 2
    assert identity.schema_fingerprint(x) != identity.schema_fingerprint(x.select("b", "a"))


@settings(max_examples=12, deadline=None)
@given(st.lists(st.text(alphabet="0123456789.eE+-infa _", max_size=8), min_size=1, max_size=30))
def test_numbers_like_python(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for r in df.select("t", parse.number(F.col("t")).alias("n")).collect():
        s = r.t.strip()
        try:
            x = None if "_" in s else float(s)
        except ValueError:
            x = None
        want = "missing" if not s else "nonnumeric" if x is None else None if math.isfinite(x) else "nonfinite"
        assert r.n.error == want, r
        assert want or r.n.value == x


def test_step_numbers(spark):
    cases = {"1.0": 1, "1e3": 1000, "9007199254740993": 9007199254740993, "1.0000001": "nonintegral", "-1": "negative", "1e30": "nonintegral", "": "missing", "NaN": "nonfinite", "x": "nonnumeric", "0.0": 0}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    for r in df.select("t", parse.step_number(F.col("t")).alias("n")).collect():
        assert (r.n.error or r.n.value) == cases[r.t], r


def canonical_rows(spark, n=20, future=2.0, vessels=("a", "b", "c")):
    rows = [(f"{v}{i}", VERSION, v, i, None if i == 0 else (future if i >= 14 else 2.0), float(i), (0.0, 90.0, 360.0)[i % 3], 1.0, 5.0, 0.3, i + 1.0) for v in vessels for i in range(n)]
    return spark.createDataFrame(rows, scan.CANONICAL_SCHEMA)


def test_chronological_split(spark):
    p = split.chronological(canonical_rows(spark), width=3)
    got = {(r.vessel_id, r.split): r for r in split.boundaries(p).collect()}
    assert all((got[v, "train"].n_rows, got[v, "validation"].n_rows, got[v, "test"].n_rows) == (14, 3, 3) for v in "abc")
    assert got["a", "train"].last_time == 13 and got["a", "test"].first_time == 17
    split.require_parts(split.boundaries(p))
    with pytest.raises(ValueError):
        split.require_parts(split.boundaries(split.chronological(canonical_rows(spark, n=3))))


@settings(max_examples=5, deadline=None)
@given(st.integers(4, 60), st.integers(1, 17))
def test_split_is_a_partition_whatever_the_bucket(spark, n, width):
    df = spark.range(n).select(F.lit("v").alias("vessel_id"), (F.col("id") * 3).alias("time_index"))
    got = [r.split for r in split.chronological(df, width=width).orderBy("time_index").collect()]
    assert got == ["train"] * (7 * n // 10) + ["validation"] * (85 * n // 100 - 7 * n // 10) + ["test"] * (n - 85 * n // 100)


def test_no_leakage(spark):
    fits = []
    for future in (10.0, 10000.0):
        x, imputer, scaler = features.classical_features(split.chronological(canonical_rows(spark, future=future)))
        fits.append((imputer.fills, scaler.stats, sorted(map(tuple, x.where("split = 'train'").select("record_id", "z_speed_over_ground").collect()))))
    assert fits[0] == fits[1]


def test_circular_encoding_and_fill(spark):
    d = spark.createDataFrame([(0.0,), (90.0,), (360.0,)], "wind_direction double")
    got = [(r[0], r[1]) for r in features.encoded_direction(d).select("wind_direction_sin", "wind_direction_cos").collect()]
    assert np.allclose(got, [(0, 1), (1, 0), (0, 1)], atol=1e-14)
    m = spark.createDataFrame([(0.0,), (360.0,)], "w double").agg(angles.circular_mean(F.col("w"))).first()[0]
    assert min(m, 360 - m) < 1e-10
    assert spark.createDataFrame([(0.0,), (180.0,)], "w double").agg(angles.circular_mean(F.col("w"), 1e-9)).first()[0] == 0.0


@settings(max_examples=6, deadline=None)
@given(st.lists(st.one_of(st.none(), st.floats(-50, 50), st.just(float("nan")), st.integers(0, 3).map(float)), min_size=1, max_size=60))
def test_exact_medians(spark, xs):
    got = features.exact_medians(spark.createDataFrame([(x,) for x in xs], "x double"), ["x"])["x"]
    ok = [x for x in xs if x is not None and not math.isnan(x)]
    assert (got is None) if not ok else got == pytest.approx(float(np.median(ok)), abs=1e-12)


def test_medians_narrowed_down_by_group(spark):
    """Many ranges and passes: skewed groups, ties, far middles, nulls in the group."""
    rng = np.random.default_rng(5)
    groups = {"a": [*rng.normal(0, 1, 300), 1e12, -1e9], "b": [1.0] * 50 + [2.0] * 50, None: list(rng.exponential(1, 101)), "c": [*rng.normal(0, 1e-6, 60), *rng.normal(1e9, 1, 60)], "d": [4.0]}
    df = spark.createDataFrame([(g, float(x)) for g, xs in groups.items() for x in xs] + [("e", None)], "g string, x double")
    got = {r.g: r.value for r in features.grouped_medians(df, ["x"], ("g",), within=5).collect()}
    assert set(got) == set(groups) and all(got[g] == pytest.approx(float(np.median(xs)), rel=1e-12) for g, xs in groups.items())


def test_samples(spark):
    df = canonical_rows(spark, n=50)
    assert [r.time_index for r in split.capped_sample(df, 5).where("vessel_id = 'a'").orderBy("time_index").collect()] == [0, 12, 24, 36, 49]
    assert split.capped_sample(df, 1).count() == 3 and split.capped_sample(df, 500).count() == 150
    assert split.proportional_sample(df, 31).count() == 31


def test_allocation(spark):
    """Of all ways to give each entity one to all of its rows, the one nearest to the proportional shares."""
    import itertools

    def given(counts, size):
        df = spark.createDataFrame([(f"e{i}", n) for i, n in enumerate(counts)], "vessel_id string, n long")
        return [r.k for r in split.allocation(df, size).orderBy("vessel_id").collect()]

    assert given([60, 30, 10], 10) == [6, 3, 1] and given([1000, 1, 1], 10) == [8, 1, 1] and given([5, 5, 5], 4) == [2, 1, 1]
    for counts, size in (([40, 33, 1, 1, 1, 1, 1], 9), ([7, 5, 3, 2], 9), ([30, 9, 9, 1, 1, 1], 8), ([2, 2, 2], 50), ([9, 8, 7, 1, 1, 1, 1], 7)):
        got = given(counts, size)
        size = min(size, sum(counts))
        far = lambda k: sum((a - size * n / sum(counts)) ** 2 for a, n in zip(k, counts))  # noqa: E731,B023
        ways = [k for k in itertools.product(*[range(1, n + 1) for n in counts]) if sum(k) == size]
        assert sum(got) == size and far(got) < min(map(far, ways)) + 1e-9, (counts, size, got)
    with pytest.raises(ValueError):
        given([5, 5, 5], 2)


def test_hash_and_group_splits(spark):
    df = spark.range(101).withColumn("g", F.col("id") % 7)
    got = split.hashed(df, "id")
    assert got.where("split = 'test'").count() == 21
    assert sorted(map(tuple, got.select("id", "split").collect())) == sorted(map(tuple, split.hashed(df.orderBy(F.desc("id")), "id").select("id", "split").collect()))
    assert split.group_folds(df, "g", 3).select("g", "fold").distinct().count() == 7
    assert split.shuffled_folds(df, "id", 4).select("fold").distinct().count() == 4


def test_group_folds_of_very_many_groups(spark):
    """100,500 groups, one of them a third of all rows: it gets a fold that takes nothing else."""
    df = spark.range(150_750).select(F.when(F.col("id") < 50_251, -1).when(F.col("id") < 50_300, None).otherwise(F.col("id")).alias("g"))
    got = split.group_folds(df, "g", 3)
    sizes = {r[0]: r[1] for r in got.groupBy("fold").count().collect()}
    assert sum(sizes.values()) == 150_750 and max(sizes.values()) - min(sizes.values()) <= 60
    assert got.where("g = -1 or g is null").select("g", "fold").distinct().count() == 2
    with pytest.raises(ValueError):
        split.group_folds(df.where("g = -1"), "g", 3)


def test_metrics_and_ranks(spark):
    rows = list(zip("aabbcc", [0.0, 1.0, 2.0, 3.0, 4.0, 5.0], [0.0, 2.0, 1.0, 3.0, 5.0, 4.0]))
    df = spark.createDataFrame(rows, "v string, y double, p double")
    m = metrics.metrics(df).first()
    assert (m.mae, m.rmse, m.r2) == pytest.approx((4 / 6, math.sqrt(4 / 6), 1 - 4 / 17.5))
    by = {r.v: r for r in metrics.grouped_metrics(df, ["v"]).collect()}
    assert by["a"].n_rows == 2 and by[None].is_total == 1 and by[None].mae == pytest.approx(4 / 6)
    metrics.require_entities(metrics.grouped_metrics(df, ["v"]), "v", ["a", "b", "c"])
    one = spark.createDataFrame([(1.0, 1.0)], "y double, p double")
    assert metrics.metrics(one).first().r2 is None
    with pytest.raises(ValueError):
        metrics.require_finite(spark.createDataFrame([(1.0, float("nan"))], "y double, p double"))
    board = spark.createDataFrame([(c, 0.2) for c in "edcba"], "candidate string, mae double")
    assert [r.candidate for r in metrics.leaderboard(board).orderBy("rank").collect()] == list("abcde")
    assert metrics.champion(board) == "a"
    with pytest.raises(ValueError):
        metrics.leaderboard(board, list("abcd"))


def test_scalings(spark):
    df = spark.createDataFrame([(2.0,), (6.0,), (None,)], "x double")
    m = features.MinMax.fit(df, ("x",))
    assert [r[0] for r in df.select(m.scaled("x", -1, 1, False)).collect()] == [-1.0, 1.0, None]
    assert df.limit(1).select(angles.unscaled(F.lit(0.0), F.lit(2.0), F.lit(6.0))).first()[0] == 4.0
    s = features.Standardizer.fit(spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "x double, k double"), ("x", "k"))
    assert s.stats == {"x": (2.0, 1.0), "k": (5.0, 1.0)}
    with pytest.raises(Exception):
        df.limit(1).select(angles.clipped(F.lit(1.1))).collect()
    o = features.OneHot.fit(spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,)], "c string"), "c")
    assert o.mode == "a" and o.values == ["a", "b"]
    assert [tuple(r)[1:] for r in o.transform(spark.createDataFrame([("z",), (None,)], "c string"), "c").collect()] == [(0, 0), (1, 0)]
    warn = features.leak_warnings(spark.createDataFrame([(float(i), 2.0 * i, 1.0, float(i % 3)) for i in range(9)], "a double, b double, k double, y double"), ["a", "b", "k"], "y")
    assert warn == ["a mirrors b"]


def test_store(spark):
    src = spark.createDataFrame([(1, "v", 1.0), (2, "v", None)], "id long, version string, x double")
    tgt = spark.createDataFrame([(1, "v", 1.0, "kept"), (9, "old", 5.0, "kept")], "id long, version string, x double, extra string")
    once = store.insert_absent(src, tgt, "id")
    assert {tuple(r) for r in once.collect()} == {(1, "v", 1.0, "kept"), (9, "old", 5.0, "kept"), (2, "v", None, None)}
    assert store.insert_absent(src, once, "id").count() == 3
    r = store.preflight(src, tgt, "id", ["x"], "id", "version")
    assert store.blocking_reasons(r).collect() == [] and r.first().to_insert == 1
    store.verify_loaded(src, once, "id", ["x"], "id", "version")
    bad = tgt.unionByName(spark.createDataFrame([(1, "v", 2.0, "x"), (None, "v", 0.0, "x"), (7, "v", 0.0, "x")], tgt.schema))
    assert [x.reason for x in store.blocking_reasons(store.preflight(src, bad, "id", ["x"], "id", "version")).collect()] == ["conflicts", "extras", "null_ids", "duplicate_ids"]
    with pytest.raises(RuntimeError):
        store.verify_loaded(src, tgt, "id", ["x"], "id", "version")
    assert {r.id: r.x for r in store.replace(src, tgt, "id").collect()} == {1: 1.0, 2: None, 9: 5.0}
    with pytest.raises(ValueError):
        store.replace(src.unionByName(src), tgt, "id")


def test_keys_and_alignment(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (3, "z")], "i long, v string")
    b = spark.createDataFrame([(1, "x"), (2, None), (4, "z")], "i long, v string")
    assert {r[0] for r in keys.misaligned(a, b, "i", ["v"]).collect()} == {3, 4}
    assert keys.overlap(a, b, "i").count() == 2 and keys.extras(a, b, "i").count() == 1 and keys.matched(a, b, "i").count() == 2
    assert keys.column_difference(a, ["i", "w"]) == (["w"], ["v"])
    o = spark.createDataFrame([("e", 1, 5), ("e", 2, 5), ("e", 3, 6)], "e string, pos long, t long")
    assert [r.pos for r in keys.order_violations(o, "e", "pos", "t").collect()] == [2]


def test_legacy_frame(spark):
    df = spark.createDataFrame([(8.0, "Tanker ", None, "01/02/2005 03:04"), (8.0, "Tanker", None, "01/02/2005 03:04"), (None, None, None, "bad")], "speed double, kind string, swell double, at string")
    got = canonical.legacy_clean(df, ["speed", "swell"], ["kind"], ["at"]).collect()
    assert len(got) == 2 and {r.kind for r in got} == {"Tanker", "UNKNOWN"} and {r.swell for r in got} == {0.0}
    assert all(r.speed == 8.0 and r.swell_was_missing == 1 for r in got) and len({r.record_id for r in got}) == 2
    assert {r.at is None for r in got} == {True, False}


def test_publication(spark, tmp_path):
    at = str(tmp_path / "s")
    publish.publish(spark, at, lambda d: publish.write_json(spark, f"{d}/a.json", {"x": 1}))
    assert publish.read_json(spark, f"{at}/a.json") == {"x": 1}
    with pytest.raises(FileExistsError):
        publish.publish(spark, at, lambda d: None)
    os.symlink("nowhere", tmp_path / "broken")
    with pytest.raises(FileExistsError):
        publish.publish(spark, str(tmp_path / "broken"), lambda d: None)
    with pytest.raises(ZeroDivisionError):
        publish.publish(spark, str(tmp_path / "t"), lambda d: 1 / 0)
    assert sorted(p.name for p in tmp_path.iterdir()) == ["broken", "s"]
    publish.failure_report(spark, str(tmp_path / "f.json"), "load", ValueError("secret"))
    publish.write_json(spark, str(tmp_path / "f.json"), [publish.read_json(spark, str(tmp_path / "f.json"))])
    assert "secret" not in (tmp_path / "f.json").read_text()
    publish.claim(spark, str(tmp_path / "one"))
    with pytest.raises(FileExistsError):
        publish.claim(spark, str(tmp_path / "one"))
    publish.save(spark.range(3), str(tmp_path / "x.parquet"))
    assert spark.read.parquet(str(tmp_path / "x.parquet")).count() == 3
    with pytest.raises(FileExistsError):
        publish.save(spark.range(3), str(tmp_path / "x.parquet"))


def test_switching_pointers_and_recovery(spark, tmp_path):
    d = str(tmp_path)
    for name in ("a", "b", "c"):
        publish.publish(spark, f"{d}/{name}", lambda at: None)
    publish.switch(spark, d, {"model": f"{d}/a", "report": f"{d}/b"})
    assert publish.current(spark, d) == {"model": f"{d}/a", "report": f"{d}/b"} and publish.recover(spark, d) == "clean"
    with pytest.raises(FileNotFoundError):
        publish.switch(spark, d, {"model": f"{d}/nowhere", "report": f"{d}/b"})
    publish.write_json(spark, f"{d}/pending.json", {"model": f"{d}/c", "report": f"{d}/nowhere"})  # broke off before all was there
    assert publish.recover(spark, d) == "dropped" and publish.current(spark, d)["model"] == f"{d}/a"
    publish.write_json(spark, f"{d}/pending.json", {"model": f"{d}/c", "report": f"{d}/b"})  # broke off before the switch
    assert publish.recover(spark, d) == "completed" and publish.current(spark, d)["model"] == f"{d}/c"


def test_contracts(spark):
    df = spark.createDataFrame([(1, 1.0), (None, float("nan")), (3, None)], "i long, x double")
    assert {r[0]: r[1] for r in contracts.broken(df, {"i": F.col("i") > 1, "x": contracts.finite(F.col("x"))}).collect()} == {"i": 2, "x": 2}
    assert {r[0]: r[1] for r in contracts.broken(df.limit(0), {"i": F.col("i") > 1}).collect()} == {"i": 0}
    with pytest.raises(ValueError, match="x: 2"):
        contracts.require(contracts.broken(df, {"x": contracts.finite(F.col("x"))}))
    with pytest.raises(ValueError):
        contracts.inference_input(df)
    assert contracts.frame_problems(df, ["i", "y"], "x") == ["column missing: y"] and contracts.frame_problems(df.limit(0), ["i"]) == ["no rows"]
    assert not contracts.passed(contracts.validation_report(df, ["i", "x", "y"])) and contracts.passed(contracts.validation_report(df.na.fill(0), ["i", "x"]))
    out = df.select("i", F.lit(1.0).alias("prediction"))
    assert {r[0]: r[1] for r in contracts.inference_output(df.where("i is not null"), out.where("i = 1").unionByName(out.where("i = 1")), "i").collect()} == {"answered_once": 2, "asked": 0, "finite": 0}
    t = spark.createDataFrame([(2.0, -1.0), (4.0, 1.0), (3.0, 0.5)], f"{canonical.TARGET} double, s double")
    assert {r[0]: r[1] for r in contracts.scaled_target(t, 2.0, 4.0, "s").collect()} == {"s": 1, "scale_not_constant": 0}
    assert contracts.canonical_columns(spark.createDataFrame([], ", ".join(f"{c} string" for c in reversed(canonical.CANONICAL_COLUMNS)))) == ["order"]


def test_files_against_a_manifest(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x")
    (tmp_path / "b.csv").write_text("y")
    want = {"a.csv": hashlib.sha256(b"x").hexdigest(), "c.csv": "0" * 64, "b.csv": "0" * 64}
    assert {r[0]: r[1] for r in contracts.same_files(spark, str(tmp_path), want).collect()} == {"present": 1, "known": 0, "content": 1}


def test_index_plan(spark):
    kind = "name string, fields array<string>, is_unique boolean"
    want = spark.createDataFrame([("ids", ["id"], True), ("keys", ["v", "t"], True), ("new", ["t"], False), ("taken", ["w"], False)], kind)
    have = spark.createDataFrame([("other", ["id"], True, True), ("x", ["v", "t"], False, True), ("taken", ["z"], False, True)], kind + ", plain boolean")
    assert {tuple(r) for r in store.index_plan(want, have).collect()} == {("ids", "reuse", "other"), ("keys", "conflict", None), ("new", "create", None), ("taken", "conflict", None)}


def test_insertions(spark):
    src = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d")], "id long, x string")
    tgt = spark.createDataFrame([(2, "kept")], "id long, x string")
    got = store.insert_absent(src, tgt, "id")
    assert sorted(map(tuple, got.collect())) == [(1, "a"), (2, "kept")] and store.insert_absent(src, got, "id").count() == 2
    assert tuple(store.insert_counts(src, tgt, "id").first()) == (4, 1, 1, 1, 0, 1)


def test_order_across_stretches(spark):
    rows = [("hot", i, (i * 7919) % 1000) for i in range(500)] + [("b", 5, 1), ("b", 900, 0)]
    df = spark.createDataFrame(rows, "e string, pos long, t long")
    want = {r.pos for r in keys.order_violations(df, "e", "pos", "t", 10_000).collect()}
    assert want and {r.pos for r in keys.order_violations(df, "e", "pos", "t", 7).collect()} == want


def test_legacy_names(spark):
    df = spark.createDataFrame([(1.0, 2.0, float("nan"))], "` Sailing speed ` double, Trim double, `Fuel consumption rate` double")
    assert legacy.renamed(df).columns == ["sailing_speed", "trim", "fuel_consumption_rate"]
    assert legacy.with_target(legacy.renamed(df), "fuel_consumption_rate").count() == 0
    assert legacy.without(df, ["Trim", "none"]).columns == [" Sailing speed ", "Fuel consumption rate"]
    with pytest.raises(ValueError):
        legacy.renamed(spark.createDataFrame([(1, 2)], "Trim int, trim2 int").toDF("Trim", "trim"))
    with pytest.raises(ValueError):
        split.require_groups(df, "Trim", 2)


def test_scans(spark, tmp_path):
    for e in ("a", "b"):
        spark.range(3).select(F.col("id").alias("index"), *[F.lit(1.0).alias(c) for c in SNAPSHOT_COLUMNS[2:]]).write.parquet(str(tmp_path / e))
    df, manifest = scan.pinned_entities(spark, str(tmp_path), ["a", "b"], VERSION)
    assert df.count() == 6 and manifest["row_counts"] == {"a": 3, "b": 3}
    scan.check_manifest(manifest, ["a", "b"])
    scan.ingest(spark, str(tmp_path), ["a", "b"], VERSION, str(tmp_path / "stage"))
    assert scan.snapshot(spark, str(tmp_path / "stage"), VERSION).count() == 6
    spark.range(1).select(F.lit("a").alias("vessel_id"), F.lit("9").alias("time_index"), *[F.lit("1").alias(c) for c in SNAPSHOT_COLUMNS[2:]]).write.mode("append").parquet(str(tmp_path / "stage" / "rows"))
    with pytest.raises(ValueError):
        scan.snapshot(spark, str(tmp_path / "stage"), VERSION)
    for change in ({"content_hash": "x"}, {"schema_fingerprint": "0" * 64}, {"dataset_version": "x"}, {"total_rows": 7}, {"row_counts": {"a": 6}}, {"entities": ["b", "a"]}):
        with pytest.raises(ValueError):
            scan.check_manifest(manifest | change, ["a", "b"])
    with pytest.raises(ValueError):
        scan.require_schema(df, "time_index", ())
    with pytest.raises(ValueError):
        scan.generic(spark, "x.json")
    path = str(tmp_path / "raw.csv")
    with open(path, "w") as f:
        f.write(",".join(SNAPSHOT_COLUMNS) + "\n" + ",".join(raw(speed="")) + "\n")
    assert tuple(scan.raw_csv(spark, path).first()) == raw(speed="")
    with pytest.raises(ValueError):
        scan.partition(spark, path, "test")


def test_rotations_equal_a_gate_by_gate_simulation():
    rng = np.random.default_rng(0)
    x, w = rng.uniform(0, np.pi, (5, 6)), rng.uniform(-2, 2, 12)

    def gate(psi, m, q):
        psi = np.moveaxis(psi.reshape([2] * 6), 5 - q, 0)
        return np.moveaxis(np.tensordot(m, psi, 1), 0, 5 - q).reshape(-1)

    def rot(a):
        return np.array([[np.cos(a / 2), -np.sin(a / 2)], [np.sin(a / 2), np.cos(a / 2)]])

    for row, got in zip(x, rotations.expectation(x, w)):
        psi = np.zeros(64)
        psi[0] = 1
        for layer in (row, w[:6]):
            for q in range(6):
                psi = gate(psi, rot(layer[q]), q)
        for q in range(5):
            psi = np.array([psi[i ^ (((i >> q) & 1) << (q + 1))] for i in range(64)])
        for q in range(6):
            psi = gate(psi, rot(w[6 + q]), q)
        z = sum(sum((1 - 2 * ((i >> q) & 1)) * psi[i] ** 2 for i in range(64)) for q in range(6)) / 6
        assert got == pytest.approx(z, abs=1e-12)
    y = rotations.expectation(x, w)
    _, history = rotations.fit(x, y, evaluations=60)
    assert history[-1] < history[0]


def test_swarm_and_kernel():
    best, loss, history = swarm.swarm(lambda p: float(((np.log10(p) - np.array([1, -1, -2])) ** 2).sum()), swarm.SwarmConfig(12, 40))
    assert loss < 0.1 and history == sorted(history, reverse=True)
    for bad in (dict(particles=1), dict(rounds=0), dict(spread_end=2.0), dict(bounds=((1.0, 0.0),))):
        with pytest.raises(ValueError):
            swarm.SwarmConfig(**bad)
    rng = np.random.default_rng(1)
    x = rng.uniform(-1, 1, (72, 2))
    y = x[:, 0] ** 2 + 0.5 * x[:, 1]
    model, report = swarm.tuned_kernel(x, y, config=swarm.SwarmConfig(4, 2))
    assert report["evaluations"] == 12 and np.abs(model.predict(x) - y).mean() < np.abs(y - y.mean()).mean() / 2
    with pytest.raises(ValueError):
        swarm.tuned_kernel(x[:5], y[:5])


def test_ridge_equals_closed_form(spark):
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(40, 2)), rng.normal(size=40)
    df = regress.assembled(spark.createDataFrame([(*map(float, a), float(b)) for a, b in zip(x, y)], "a double, b double, y double"), ("a", "b"))
    m = regress.estimator("ridge", {"alpha": 3.0}, df, "y").fit(df)
    c = x - x.mean(0)
    assert np.allclose(m.coefficients.toArray(), np.linalg.solve(c.T @ c + 3 * np.eye(2), c.T @ (y - y.mean())), atol=1e-6)


def test_pipeline_end_to_end(spark, tmp_path, monkeypatch):
    monkeypatch.setitem(regress.SPACES, "quick", {"ridge": ({"alpha": 1.0},), "gradient_boosting": ({"rounds": 15, "rate": 0.1, "depth": 3},)})
    rng = np.random.default_rng(3)
    rows = []
    for v in "ab":
        for i in range(80):
            s = 4 + 2 * math.sin(i / 5)
            rows.append(raw(v, str(i), f"{s:.3f}", "3", str(i % 360), "1", "5", "0.2", f"{0.1 * s + 0.01 * rng.random():.5f}"))
    config = pipeline.Config(str(tmp_path))
    pipeline.clean(spark.createDataFrame(rows, RAW), VERSION, config)
    cleaned = spark.read.parquet(config.at("clean", "rows"))
    pipeline.split_stage(cleaned, config)
    pipeline.train(spark, config, ("ridge", "gradient_boosting"))
    pipeline.verify_in_fresh_process(config, "ridge")
    # a candidate that claims another error than its predictions give is refused
    claimed = spark.read.parquet(config.at("candidates", "ridge", "metrics"))
    honest = claimed.collect()
    claimed.withColumn("mae", F.col("mae") / 2).write.parquet(str(tmp_path / "lie"))
    os.rename(config.at("candidates", "ridge", "metrics"), str(tmp_path / "honest"))
    os.rename(str(tmp_path / "lie"), config.at("candidates", "ridge", "metrics"))
    with pytest.raises(ValueError, match="metric_mae"):
        pipeline.select(spark, config)
    os.rename(config.at("candidates", "ridge", "metrics"), str(tmp_path / "lie"))
    os.rename(str(tmp_path / "honest"), config.at("candidates", "ridge", "metrics"))
    assert honest
    pipeline.select(spark, config)
    with pytest.raises(FileExistsError):
        pipeline.select(spark, config)
    total = pipeline.evaluate(spark, config)
    assert total["r2"] > 0.9 and publish.current(spark, str(tmp_path))["test"] == config.at("test")
    with pytest.raises(FileExistsError):
        pipeline.evaluate(spark, config)
    six = cleaned.select("record_id", *FEATURES)
    got = pipeline.predict(spark, config, six)
    assert got.where("prediction is null").count() == 0 and got.count() == cleaned.count()
    with pytest.raises(ValueError, match="wave_height"):
        pipeline.predict(spark, config, six.withColumn("wave_height", F.lit(float("inf"))))
    with pytest.raises(ValueError):
        pipeline.predict(spark, config, six.select("record_id", *reversed(FEATURES)))
    with pytest.raises(ValueError):
        pipeline.Config("relative")


def test_streaming_equals_batch(spark, tmp_path):
    from tidewright.streaming import telemetry

    rows = [(*raw(t=str(i % 5), fuel="x" if i % 5 == 3 else "1.5"), f"2005-01-01 00:0{i % 5}:00") for i in range(10)]
    spark.createDataFrame(rows, RAW + ", at string").withColumn("arrived_at", F.to_timestamp("at")).drop("at").write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(RAW + ", arrived_at timestamp").parquet(str(tmp_path / "in"))
    q = telemetry.canonical_stream(src, VERSION).writeStream.format("memory").queryName("canon").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    batch = canonical.clean_rows(canonical.classified(spark.createDataFrame([r[:9] for r in rows], RAW)), VERSION)
    assert {r.record_id for r in spark.table("canon").collect()} == {r.record_id for r in batch.collect()}


def _norm(df):
    df = df[sorted(df.columns)].astype(object)
    df = df.map(lambda x: "NULL" if x is None or x != x else repr(float(x)) if isinstance(x, float) else str(x))
    return sorted(map(tuple, df.values.tolist()))


ORACLES = quality_queries.ORACLES | reference_queries.ORACLES | contract_queries.ORACLES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_equal_sql(spark, sf, name):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    run = (quality_queries.QUERIES | reference_queries.QUERIES | contract_queries.QUERIES)[name]
    assert _norm(run(spark, sf).toPandas()) == _norm(con.sql(ORACLES[name]).df())
