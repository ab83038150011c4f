"""The training-data operators of the core: small fixtures, brute force, edge cases."""

import csv
import math
import random
import re

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings, strategies as st

from tidewright.operators import badrows, fill, grid, profile, spikes
from tidewright.session import table

VESSELS = "vessel_id string, vessel_type string, logger_model string, design_speed double, built_year int"
RECORDS = (
    "row_id long, vessel_id string, leg_id long, time_index long, speed_over_ground double, wind_speed double, wind_direction double, "
    "wave_height double, wave_direction double, wave_period double, total_momentary_fuel double, ingested_at string"
)
PARTS = "row_id long, record_id string, vessel_id string, leg_id long, split string, time_index long, total_momentary_fuel double, ingested_at string"


@pytest.fixture(scope="module")
def vessels(spark):
    return spark.createDataFrame([("alba_1", "tug", "m1", 10.0, 2000), ("bora_2", "ferry", "m2", 12.0, 2001), (None, None, None, None, None)], VESSELS)


def series(n=300, vessel="alba_1", leg=1, seed=0, first=1):
    rng = np.random.default_rng(seed)
    return [
        [first + i, vessel, leg, i, 6 + rng.normal(0, 0.05), 8 + rng.normal(0, 0.3), float((90 + i // 10) % 360), 1.5 + 0.002 * i + rng.normal(0, 0.01), float((60 + i // 10) % 360), 6.0 + rng.normal(0, 0.1), 0.5 + rng.normal(0, 0.005), "x"]
        for i in range(n)
    ]


# ---- problem 1 ----


def test_fill_finds_every_missing_cell_and_stays_near(spark, vessels):
    rows = series() + series(vessel="BORA_2 ", leg=2, seed=1, first=1001)
    truth = {}
    for i in (10, 50, 51, 120):
        truth[rows[i][0], "wave_height"] = rows[i][7]
        rows[i][7] = None
    rows[60][7] = float("nan")
    for i in (30, 80):
        truth[rows[i][0], "wind_direction"] = rows[i][6]
    rows[30][6], rows[80][6] = -1.0, 999.0
    for i in (310, 350, 390, 420):
        rows[i][7] = -99.0  # the second logger's stand-in
    rows[200][7] = 0.0  # a true value
    got = fill.fill_all(spark.createDataFrame(rows, RECORDS), spark.createDataFrame([], PARTS), vessels).toPandas()
    cells = set(zip(got.row_id, got.field_name))
    want = {(rows[i][0], "wave_height") for i in (10, 50, 51, 120, 60, 310, 350, 390, 420)} | {(rows[i][0], "wind_direction") for i in (30, 80)}
    assert cells == want and len(got) == len(want)
    assert set(got.vessel_id) == {"alba_1", "bora_2"}
    filled = {(r.row_id, r.field_name): r.filled_number for r in got.itertuples()}
    for k, v in truth.items():
        assert abs(filled[k] - v) < (0.15 if k[1] == "wave_height" else 12), (k, v, filled[k])


def test_fill_category_by_leg(spark, vessels):
    rows = []
    for leg, name in ((1, "alba_1"), (2, "bora_2"), (3, "ALBA_1\t")):
        rows += [(leg * 100 + i, "r", name if i % 4 else ("n/a" if i % 8 else None), leg, "train", i * 60, 0.3 * leg, "x") for i in range(40)]
    got = fill.fill_all(spark.createDataFrame([], RECORDS), spark.createDataFrame(rows, PARTS), vessels).toPandas()
    assert len(got) == 30
    assert {(r.row_id // 100, r.vessel_id) for r in got.itertuples()} == {(1, "alba_1"), (2, "bora_2"), (3, "alba_1")}


def test_fill_empty_and_unknown_vessel(spark, vessels):
    assert fill.fill_all(spark.createDataFrame([], RECORDS), spark.createDataFrame([], PARTS), vessels).count() == 0
    rows = series(40)
    rows[3][1] = "nobody"
    rows[3][7] = None
    got = fill.fill_all(spark.createDataFrame(rows, RECORDS), spark.createDataFrame([], PARTS), vessels).collect()
    assert [(r.row_id, r.vessel_id) for r in got] == [(4, "alba_1")]


def test_fill_held_out_accuracy(spark, sf):
    """Known cells of the test table, hidden and filled again."""
    r = table(spark, sf.replace("sf0.001", "sf0.01"), "vessel_records").toPandas()
    ok = r.wave_height.between(0.05, 12) & r.wind_direction.between(0, 360)
    hide = r.index[ok & (r.row_id % 29 == 0)]
    truth = r.loc[hide, ["row_id", "wave_height", "wind_direction"]].set_index("row_id")
    r.loc[hide, ["wave_height", "wind_direction"]] = np.nan
    v = table(spark, sf.replace("sf0.001", "sf0.01"), "vessels")
    got = fill.filled_records(spark.createDataFrame(r), v).toPandas().set_index("row_id").loc[truth.index]
    wave = (got.wave_height - truth.wave_height).abs()
    turn = ((got.wind_direction - truth.wind_direction + 180) % 360 - 180).abs()
    assert wave.median() < 0.12 and turn.median() < 8, (wave.median(), turn.median())


# ---- problem 2 ----


def found(spark, rows, vessels):
    return set(map(tuple, spikes.implausible_cells(spark.createDataFrame(rows, RECORDS), vessels).collect()))


def test_spikes_stuck_runs_bounds_units(spark, vessels):
    rows = series(600)
    want = set()
    for i, v in ((50, 3.0), (51, 3.2), (120, 0.0), (200, 9.5)):
        rows[i][4] = v
        want.add((rows[i][0], "speed_over_ground"))
    rows[300][10] = -0.2
    want.add((rows[300][0], "total_momentary_fuel"))
    for i in range(400, 410):
        rows[i][5] = 7.77
        want.add((rows[i][0], "wind_speed"))
    for i in range(450, 462):
        rows[i][10] *= 3600
        want.add((rows[i][0], "total_momentary_fuel"))
    for i in range(500, 505):
        rows[i][7] = 2.22  # five equal values are no run
    again = list(rows[50])
    again[0], again[1] = 5001, " ALBA_1"
    want.add((5001, "speed_over_ground"))
    assert found(spark, rows + [again], vessels) == want


def test_normal_courses_are_no_spikes(spark, vessels):
    rows = series(400)
    speed = [1.0, 2.1, 3.2, 4.3, 5.2] + [6.0] * 60 + [4.9, 3.8, 2.9, 2.9, 2.8, 2.9, 3.9, 5.0] + [6.0] * 60 + [4.0, 2.0] + [0.0] * 40
    rng = np.random.default_rng(3)
    for i, v in enumerate(speed):
        rows[i][4] = v + (rng.normal(0, 0.05) if v else 0)
    assert not {x for x in found(spark, rows, vessels) if x[1] == "speed_over_ground"}


def test_spikes_at_block_edges_equal_one_block(spark, vessels, monkeypatch):
    rows = series(1500, seed=5)
    rng = random.Random(1)
    for i in rng.sample(range(5, 1495, 9), 40):
        rows[i][5] += rng.choice((-7.0, 9.0))
    whole = found(spark, rows, vessels)
    monkeypatch.setattr(spikes, "BLOCK", 256)
    monkeypatch.setattr(spikes, "BUCKET", 64)
    assert found(spark, rows, vessels) == whole and len(whole) >= 40


def test_spikes_defined_cases(spark, vessels):
    assert found(spark, [], vessels) == set()
    rows = series(50)
    rows[5][4] = None
    rows[6][4] = float("nan")
    rows[7][3], rows[7][4] = None, -3.0  # no time: judged by sign
    rows[8][1] = None
    got = found(spark, rows, vessels)
    assert (rows[7][0], "speed_over_ground") in got and not {x for x in got if x[0] in (rows[5][0], rows[6][0])}


def test_records_sent_often_count_each(spark, vessels):
    """A record sent once, twice and five times: every row of it comes out."""
    rows = series(300)
    for i in (50, 100, 150):
        rows[i][5] = 19.0
    more = [[9000 + j, "alba_1 ", *rows[i][2:]] for j, i in enumerate([100, 150, 150, 150, 150])]
    assert {x[0] for x in found(spark, rows + more, vessels) if x[1] == "wind_speed"} == {rows[i][0] for i in (50, 100, 150)} | {9000 + j for j in range(5)}


def test_every_axis_of_the_ellipsoid_decides():
    """Leaps of 9.6 to 12 scatters: without the ellipsoid, or without any one axis, the verdicts change."""
    rng = np.random.default_rng(8)
    y = 20 + rng.normal(0, 0.1, 12000)
    planted = np.arange(20, 11980, 60)
    for n, i in enumerate(planted):
        y[i : i + 1 + n % 3] += (0.96 + 0.24 * n / len(planted)) * (-1) ** n
    scale = np.array([1.4826 * np.median(s) for s in spikes.sizes(y, np.ones(len(y), bool), False)[:3]])
    axes = spikes.ellipsoid(y, scale, 20.0, False)
    got = spikes.spikes(y, spikes.outside(y, axes), axes)
    members = sum(1 + n % 3 for n in range(len(planted)))
    assert got.sum() > 0.7 * members
    everywhere = [np.full(len(y), 1e-9)] * 3
    assert (spikes.spikes(y, np.ones(len(y), bool), everywhere) != got).sum() > 500
    for a in range(3):
        without = [np.full(len(y), np.inf) if i == a else x for i, x in enumerate(axes)]
        lost = got & ~spikes.spikes(y, spikes.outside(y, without), without)
        assert lost.sum() > 20, (a, lost.sum())


def test_fuel_is_judged_in_shares_of_its_level():
    """A tenfold scatter at a low level is a spike though it is small beside the scatter at a high level."""
    rng = np.random.default_rng(4)
    y = np.concatenate([np.full(1000, 0.05), np.full(1000, 0.6)]) * (1 + rng.normal(0, 0.015, 2000))
    y[500] = 0.065
    scale = np.array([1.4826 * np.median(s) for s in spikes.sizes(y, np.ones(2000, bool), True)[:3]])
    assert np.flatnonzero(spikes.verdicts(y, scale, 0.61, 3.0, True)).tolist() == [500]


def test_stuck_ends_at_nan():
    x = np.array([1.0, 1, 1, 1, 1, np.nan, 1, 1, 1, 1, 1, 2, 2, 2, 2, 2, 2, 0, 0, 0, 0, 0, 0, 0])
    assert spikes.stuck(x).nonzero()[0].tolist() == list(range(11, 17))


# ---- problem 3 ----

LINES = "line_id long, file_name string, line_no int, raw_text string"
GOOD = "v,7.0,1,2,3,4,5,6,0.5"


def brute_reason(text):
    """The definition, character by character."""
    s = (text or "").rstrip("\r\n").lstrip("﻿")
    fields, i = [], 0
    while True:
        if i < len(s) and s[i] == '"':
            j, value = i + 1, ""
            while True:
                if j >= len(s):
                    return "quoting"
                if s[j] == '"':
                    if s[j + 1 : j + 2] == '"':
                        value, j = value + '"', j + 2
                        continue
                    break
                value, j = value + s[j], j + 1
            j += 1
            if j < len(s) and s[j] != ",":
                return "quoting"
        else:
            j = s.find(",", i)
            j = len(s) if j < 0 else j
            value = s[i:j]
            if '"' in value:
                bad = True
                return "quoting"
        fields.append(value)
        if j >= len(s):
            break
        i = j + 1
        if i == len(s):
            fields.append("")
            break
    if len(fields) != 9:
        return "column_count"
    num = re.compile(r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?")
    for k, name in ((1, "time_index"), (8, "fuel")):
        t = fields[k].strip()
        if not num.fullmatch(t) or not math.isfinite(float(t)) or float(t) < 0:
            return name
        if k == 1 and float(t) % 1:
            return name
    return None


def own_reason(text):
    try:
        badrows.typed(badrows.split_fields(badrows.one_line(text)))
    except badrows.Structure as e:
        return str(e)
    return None


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(['"', ",", "1", "7.0", "", ' "', '""', "x", "-1", "1e2", "\r", " 3 ", "0.5"]), max_size=24))
def test_reasons_equal_the_definition(parts):
    text = "".join(parts)
    if "\r" in text.rstrip("\r"):
        return
    assert own_reason(text) == brute_reason(text)


@pytest.mark.parametrize(
    "text, reason",
    [
        (GOOD, None), (GOOD + "\r", None), ('"v","7"," 1",2,3,4,5,6,"0.5"', None), ('v,7,1,2,3,4,5,6,"0.5" ', "quoting"), ('v,7,1,2"0,3,4,5,6,0.5', "quoting"),
        ('"v,7,1,2,3,4,5,6,0.5', "quoting"), ("", "column_count"), (None, "column_count"), (GOOD + ",", "column_count"), ("v,7.5,1,2,3,4,5,6,0.5", "time_index"),
        ("v,1e-1,1,2,3,4,5,6,0.5", "time_index"), ("v,1e3,bad,,inf,4,-5,6,+.5", None), ("v,7,1,2,3,4,5,6,1e400", "fuel"), ("v,7,1,2,3,4,5,6,nan", "fuel"),
        ("v,-1,1,2,3,4,5,6,bad", "time_index"), ("v,0e9999,1,2,3,4,5,6,0", None), ("v,1e30,1,2,3,4,5,6,0", "time_index"), ("x" * 300_000, "column_count"),
    ],
)
def test_reasons(text, reason):
    assert own_reason(text) == reason


def test_lines_split_into_typed_and_faulty(spark):
    rows = [(1, "f", 1, "vessel_id,..."), (2, "f", 2, GOOD), (3, "f", 3, "x"), (3, "f", 3, "x"), (4, "f", None, '"'), (5, "f", 4, "v,8,bad,2,361,4,0,-6,0.5")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], LINES + ", reason string")
    assert sorted(map(tuple, badrows.faulty_lines(df).collect())) == [(3, "column_count"), (3, "column_count"), (4, "quoting")]
    good = {r.line_id: r for r in badrows.valid_rows(df).collect()}
    assert set(good) == {2, 5} and good[2].time_index == 7
    assert [good[5][c] for c in badrows.FEATURES] == [None, 2.0, None, 4.0, None, None]
    assert badrows.faulty_lines(df.limit(0)).count() == 0


def test_records_over_several_lines(spark):
    """Lines of shuffled files, cut into small stretches, against the reader on whole files."""
    rng = random.Random(6)
    rows, want = [], set()
    for f in ("f", "g"):
        records = [",".join('"' + "x\n" * rng.choice((0, 0, 1, 5)) + 'say ""hi"""' if rng.random() < 0.3 else str(i) for _ in range(3)) for i in range(60)]
        lines = "\n".join(records).split("\n")
        rows += [(len(rows) + i, f, i + 1, t) for i, t in enumerate(lines)]
        assert len(list(csv.reader(lines))) == len(records)
        want |= {(f, r) for r in records}
    rows.append((9999, None, None, '"open'))
    df = spark.createDataFrame(rng.sample(rows, len(rows)), LINES)
    for stretch in (3, 4096):
        got = badrows.assembled(df, stretch).collect()
        assert {(r.file_name, r.raw_text) for r in got if r.file_name} == want and len(got) == 121
        assert all(r.raw_text.startswith(dict(((x[1], x[2]), x[3]) for x in rows)[r.file_name, r.line_no]) for r in got if r.file_name)
    good = GOOD.split(",")
    two = spark.createDataFrame([(1, "f", 2, '"' + good[0]), (2, "f", 3, '",' + ",".join(good[1:])), (3, "f", 4, GOOD)], LINES)
    assert {r.line_id for r in badrows.parse_lines(two, multiline=True).where("reason is null").collect()} == {1, 3}
    assert badrows.faulty_lines(two).count() == 2 and badrows.assembled(df.limit(0)).count() == 0


def test_nearest_names_equal_brute_force():
    rng = np.random.default_rng(1)
    got, ideal = rng.normal(size=(70, 5)), rng.normal(size=(50, 5))
    want = ((got[:, None] - ideal[None]) ** 2).sum(2).argmin(1)
    assert (fill.nearest(got, ideal) == want).all() and (fill.nearest(got, ideal, 16, 7) == want).all() and len(fill.nearest(got[:0], ideal)) == 0


def test_a_long_gap_comes_out_block_by_block(spark):
    df = spark.createDataFrame([("a", 0, 1.0), ("a", 300 * 1000, 2.0)], "s string, t long, x double")
    got = grid.regular_series(df, source="s", time="t", value="x", block_slots=64).collect()
    assert sorted(r.slot for r in got) == list(range(1001)) and sum(r.how == "marked" for r in got) == 999


# ---- problem 4 ----


def test_grid_against_brute_force(spark, vessels):
    rng = random.Random(2)
    rows, at = [], {}
    for leg in (1, 2, 3):
        for i in range(200):
            t = rng.choice((None, -5, rng.randrange(0, 300 * 200)))
            f = rng.choice((None, float("nan"), -1.0, 0.4, 0.5))
            rows.append((len(rows), "r", rng.choice((None, "alba_1", "Alba_1 ")), leg, "train", t, f, "x"))
            if t is not None and t >= 0 and f is not None and f >= 0:
                at.setdefault(leg, set()).add(t // 300)
    want = {(leg, "alba_1", s) for leg, got in at.items() for s in range(min(got), max(got)) if s not in got}
    df = spark.createDataFrame(rows, PARTS)
    assert set(map(tuple, grid.empty_slots(df, vessels).collect())) == want
    tiny = grid.regular_series(df, source="leg_id", time="time_index", value="total_momentary_fuel", block_slots=7)
    assert {(r.leg_id, r.slot) for r in tiny.where("how <> 'reading'").collect()} == {(a, c) for a, _, c in want}


def test_grid_fills_marks_and_extends(spark):
    df = spark.createDataFrame([(1, 0, 1.0), (1, 900, 4.0), (1, 900, 6.0), (1, 300 * 30, 2.0)], "s long, t long, v double")
    got = {r.slot: (r.v, r.how) for r in grid.regular_series(df, source="s", time="t", value="v", max_gap=5, bounds=(-1, 31)).collect()}
    assert got[0] == (1.0, "reading") and got[3] == (5.0, "reading") and got[1][1] == "filled" and abs(got[1][0] - 7 / 3) < 1e-9
    assert got[10] == (None, "marked") and got[-1] == (None, "marked") and got[31] == (None, "marked") and len(got) == 33
    assert grid.regular_series(df.limit(0), source="s", time="t", value="v").count() == 0


# ---- problem 5 ----


def loads(n=12, rows=300, seed=0):
    rng = np.random.default_rng(seed)
    out = []
    for load in range(n):
        d = pd.DataFrame({"load_id": load, "code": [f"AB-{load:03d}-{i:05d}" for i in range(rows)], "kind": rng.choice(["tug", "ferry", "ro_ro"], rows), "x": np.exp(rng.normal(2, 0.3, rows)).round(2)})
        out.append(d)
    return out


def test_departing_columns(spark):
    ds = loads()
    ds[3].loc[:150, "x"] = np.nan
    ds[4].x *= 1.944
    ds[5].loc[:200, "kind"] = "TUG!"
    ds[6].loc[:150, "code"] = [f"{i}/2005" for i in range(151)]
    ds[7].loc[:120, "x"] = 0.0
    ds[8] = pd.concat([ds[8], ds[8].head(120)])
    ds[9]["code"] = "AB-001-00001"
    ds[10].loc[:100, "kind"] = "n/a"
    df = spark.createDataFrame(pd.concat(ds, ignore_index=True))
    got = set(map(tuple, profile.departures(df).collect()))
    assert got == {(3, "x"), (4, "x"), (5, "kind"), (6, "code"), (7, "x"), (8, "*"), (9, "code"), (10, "kind")}


def test_collapsed_values_of_columns_with_few_distinct_ones(spark):
    rng = np.random.default_rng(1)
    draw = lambda rows: 1 + rng.permutation(np.arange(rows) % 40) / 100  # noqa: E731  # 40 values: a distinct share of 0.13
    ds = [pd.DataFrame({"load_id": i, "code": [f"AB-{i:03d}-{j:05d}" for j in range(rows)], "x": draw(rows), "y": draw(rows)}) for i, rows in enumerate([300] * 9 + [3000, 60])]
    ds[3].loc[:285, "x"] = 1.2  # stuck at one value
    ds[5]["y"] = np.resize([1.05, 1.2, 1.35], 300)  # none very frequent, but three only
    # larger and smaller loads of the same 40 values depart in nothing
    assert set(map(tuple, profile.departures(spark.createDataFrame(pd.concat(ds, ignore_index=True))).collect())) == {(3, "x"), (5, "y")}


def test_category_shares_of_any_number_of_values(spark):
    rng = np.random.default_rng(2)
    many = [f"{a}{b}" for a in "bcdfghjk" for b in ("alpha", "breve", "colon", "delta", "ember", "fiord", "gamma", "hotel", "india", "joker")]  # 80 names
    often = np.array([0.05] * 10 + [0.5 / 70] * 70)
    ds = []
    for i, rows in enumerate([800] * 9 + [25]):  # the last is small: unique values there are frequent
        kind = pd.Series(rng.choice(["tug", "ferry", "barge"], rows))
        ds.append(pd.DataFrame({"load_id": i, "code": [f"AB-{i:03d}-{j:05d}" for j in range(rows)], "port": rng.choice(many, rows, p=often), "kind": kind, "grade": rng.choice([2.0, 3.0, 4.0, 5.0, 6.0], rows)}))
    ds[2].port = rng.choice(many[:10], 800)  # the frequent names only
    ds[4].loc[:39, "kind"] = [f"tu{c}{d}" for c in "abcdefgh" for d in "vwxyz"]  # 40 bad spellings, one row each
    ds[4].loc[40:79, "kind"] = [f"fe{c}{d}" for c in "abcdefgh" for d in "vwxyz"]  # and 40 more
    ds[6].kind = rng.choice(["tug", "ferry", "barge"], 800, p=[0.7, 0.15, 0.15])
    ds[7].grade = rng.choice([2.0, 3.0, 4.0, 5.0, 6.0], 800, p=[0.0, 0.05, 0.9, 0.05, 0.0])
    ds[8].grade = rng.choice([2.0, 4.0, 6.0], 800)  # same median, shares of values gone
    got = set(map(tuple, profile.departures(spark.createDataFrame(pd.concat(ds, ignore_index=True))).collect()))
    assert got - {(4, "kind")} == {(2, "port"), (6, "kind"), (7, "grade"), (8, "grade")}


def test_no_departures_and_small_inputs(spark):
    df = spark.createDataFrame(pd.concat(loads(seed=4), ignore_index=True))
    assert profile.departures(df).count() == 0
    assert profile.departures(df.where("load_id < 2")).count() == 0
    assert profile.departures(df.limit(0)).count() == 0
    assert profile.profile(df.limit(0)).count() == 0


def test_profile_figures(spark):
    df = spark.createDataFrame([(1, "a-1", 2.0), (1, "a-1", 2.0), (1, None, float("nan")), (1, " N/A ", 0.0), (1, "a-22", -1.0)], "load_id long, t string, x double")
    p = {r.column_name: r for r in profile.profile(df).collect()}
    assert (p["t"].n_loaded, p["t"].n_equal, p["t"].n_surplus, p["t"].n_rows, p["t"].n_missing, p["t"].n_distinct) == (5, 2, 1, 4, 2, 2)
    assert (p["x"].n_missing, p["x"].n_distinct, p["x"].min_number, p["x"].max_number, p["x"].n_not_positive) == (1, 3, -1.0, 2.0, 2)


def test_expressions_conform(spark):
    values = [(0, f"NB-{i:07d}-{i % 100:02d}") for i in range(300)] + [(0, "?!x"), (0, "zz top 9")]
    got = {r.v: r.expr for r in profile.expressions(spark.createDataFrame(values, "col short, v string")).collect()}
    assert len({got[v] for _, v in values[:300]}) == 1
    main = got["NB-0000001-01"]
    assert re.fullmatch(profile.as_regex(main).replace(r"\p{Lu}", "[A-Z]").replace(r"\p{Ll}", "[a-z]"), "NB-1234567-12")
    assert got["?!x"] is None
