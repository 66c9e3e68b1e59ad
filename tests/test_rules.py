"""Validation, vessel records, snapshots, display values."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from wakeline import schema as S
from wakeline.functions import scalars as X
from wakeline.operators import snapshots as SN
from wakeline.operators import validate as V
from wakeline.operators import vessels as VE
from wakeline.plans import queries as Q

T0 = datetime(2024, 1, 15, 12)
COLS = "mmsi bigint, ts timestamp, lat double, lon double, sog float, cog float, heading int, nav_status int, " \
       "rot float, msg_type int, seq bigint"  # fmt: skip


def position(seq, mmsi=219000001, ts=T0, lat=55.0, lon=11.0, sog=5.0, heading=90):
    return (mmsi, ts, lat, lon, sog, 10.0, heading, 0, 0.0, 1, seq)


def reasons(spark, *rows):
    df = spark.createDataFrame(list(rows), COLS).withColumn("reason", V.reject_reason())
    return [r.reason for r in df.orderBy("seq").collect()]


def test_mmsi_bounds(spark):
    values = [99_999_999, 100_000_000, 999_999_999, 1_000_000_000]
    assert reasons(spark, *[position(i, mmsi=m) for i, m in enumerate(values)]) == ["mmsi", None, None, "mmsi"]


def test_coordinate_bounds(spark):
    nan = float("nan")
    places = [(90, 180), (-90, -180), (91, 0), (0, 181), (-90.01, 0), (nan, 1), (1, nan)]
    got = reasons(spark, *[position(i, lat=float(a), lon=float(o)) for i, (a, o) in enumerate(places)])
    assert got == [None, None, *["coords"] * 5]


def test_null_island_needs_both(spark):
    places = [(0.0, 0.0), (0.0, 1.0), (1.0, 0.0), (-0.0, 0.0)]
    got = reasons(spark, *[position(i, lat=a, lon=o) for i, (a, o) in enumerate(places)])
    assert got == ["null_island", None, None, "null_island"]


def test_speed_limit(spark):
    got = reasons(spark, *[position(i, sog=s) for i, s in enumerate([102.3, 102.2, None, float("nan")])])
    # 102.2 as a 32-bit float lies just below the limit.
    assert got == ["sog", None, None, None]


def test_first_broken_rule_counts(spark):
    assert reasons(spark, position(0, mmsi=1, lat=99.0, sog=200.0), position(1, lat=99.0, sog=200.0)) == ["mmsi", "coords"]


def test_repeats_within_a_second_keep_the_first_arrival(spark):
    rows = [
        position(3, ts=T0, sog=3.0),
        position(1, ts=T0 + timedelta(milliseconds=900), sog=1.0, heading=511),
        position(2, ts=T0 + timedelta(milliseconds=100), sog=2.0),
        position(4, ts=T0 + timedelta(seconds=1), sog=4.0),
        position(5, mmsi=219000002, ts=T0, sog=5.0),
        position(0, ts=T0, lat=99.0),
    ]
    df = spark.createDataFrame(rows, COLS).repartition(5)
    assert sorted((r.seq, r.heading) for r in V.clean(df).collect()) == [(1, 511), (4, 90), (5, 90)]
    stats = V.validation_statistics(df).head()
    assert (stats.total, stats.accepted, stats.rejected_coords, stats.duplicates) == (6, 3, 1, 2)


def test_statistics_of_nothing(spark):
    stats = V.validation_statistics(spark.createDataFrame([], COLS)).head()
    assert tuple(stats) == (0,) * 7


# --- vessels --------------------------------------------------------------------------------------


def vessel(mmsi, name=None, seen=T0, **more):
    values = {c: None for c in S.VESSEL_COLS} | {"mmsi": mmsi, "vessel_name": name, "last_seen": seen} | more
    return tuple(values[c] for c in S.VESSEL_COLS)


def test_upsert_keeps_the_latest_record(spark):
    old = spark.createDataFrame([vessel(1, "A"), vessel(2, "B"), vessel(3, "C", T0 + timedelta(days=9))], S.VESSELS)
    new = spark.createDataFrame([vessel(2, "B2", T0 + timedelta(days=1)), vessel(3, "C0"), vessel(4, "D")], S.VESSELS)
    got = {r.mmsi: r.vessel_name for r in VE.upsert(old, new).collect()}
    assert got == {1: "A", 2: "B2", 3: "C", 4: "D"}


def test_search_is_case_insensitive_with_wildcards(spark):
    df = spark.createDataFrame([vessel(i, n) for i, n in enumerate(["Anna", "HANNAH", "O'Hara", None])], S.VESSELS)
    assert sorted(r.mmsi for r in Q.find_vessels(df, name="ann").collect()) == [0, 1]
    assert [r.mmsi for r in Q.find_vessels(df, name="o'h").collect()] == [2]
    assert [r.mmsi for r in Q.find_vessels(df, name="h_nn").collect()] == [1]
    assert Q.find_vessels(df, name=" ").count() == 4
    assert Q.suggest_vessels(df, "a").count() == 0


# --- snapshots ------------------------------------------------------------------------------------


def test_snapshot_bounds_are_inclusive(spark):
    hour = timedelta(hours=1)
    rows = [position(0, 1, T0 - hour), position(1, 2, T0 - hour - timedelta(microseconds=1)), position(2, 3, T0),
            position(3, 4, T0 + timedelta(microseconds=1))]
    positions = spark.createDataFrame(rows, COLS)
    vessels = spark.createDataFrame([vessel(1, "A")], S.VESSELS)
    got = {r.mmsi: r.vessel_name for r in Q.positions_at(positions, vessels, T0.isoformat()).collect()}
    assert got == {1: "A", 3: None}


@pytest.mark.parametrize("step", [60, 300, 3600, 5400])
def test_series_equals_single_snapshots(spark, step):
    rows = [position(i, 1 + i % 3, T0 + timedelta(seconds=i * 137 % 20_000)) for i in range(150)]
    positions = spark.createDataFrame(rows, COLS).cache()
    last = T0 + timedelta(hours=5, minutes=7)
    series = SN.snapshot_series(positions, T0.isoformat(), last.isoformat(), step).collect()
    want, tick = set(), T0
    while tick <= last:
        for m in (1, 2, 3):
            seen = [r[1] for r in rows if r[0] == m and tick - timedelta(hours=1) <= r[1] <= tick]
            if seen:
                want.add((tick, m, max(seen)))
        tick += timedelta(seconds=step)
    assert {(r.at, r.mmsi, r.ts) for r in series} == want
    assert len(series) == len(want)


# --- display values -------------------------------------------------------------------------------


def values(spark, rows, ddl, *columns):
    numbered = [(*r, i) for i, r in enumerate(rows)]
    return [r[0] for r in spark.createDataFrame(numbered, f"{ddl}, i int").orderBy("i").select(*columns).collect()]


def test_categories(spark):
    cases = [
        (36, None, "sailing_pleasure"), (30, None, "fishing"), (39, "Cargo", "fishing"), (70, None, "cargo"),
        (89, None, "tanker"), (60, None, "passenger"), (52, None, "special"), (45, None, "high_speed"),
        (99, "Cargo", "other"), (None, "80", "tanker"), (None, "Cargo ship", "cargo"), (None, "SAR", "special"),
        (None, "High speed craft", "high_speed"), (None, "Pleasure", "sailing_pleasure"), (None, None, "other"),
        (None, "NaN", "other"),
    ]
    got = values(spark, [c[:2] for c in cases], "t int, d string", X.ship_category(F.col("t"), F.col("d")))
    assert got == [c[2] for c in cases]


def test_length_class(spark):
    got = values(spark, [(None,), (49.9,), (50.0,), (199.9,), (200.0,)], "x float", X.length_class(F.col("x")))
    assert got == ["unknown", "small", "medium", "medium", "large"]


def test_bearing(spark):
    rows = [(12.5, 90), (None, 90), (None, 511), (float("nan"), 45), (None, None)]
    assert values(spark, rows, "c float, h int", X.display_bearing(F.col("c"), F.col("h"))) == [12.5, 90, 0, 45, 0]


def test_labels(spark):
    assert values(spark, [(5,), (9,), (None,)], "s int", X.nav_status_label(F.col("s"))) == ["Moored", "Status 9", "—"]
    got = values(spark, [("Cargo", 8.25), (None, 8.0), ("", None)], "d string, s float", X.summary_label(F.col("d"), F.col("s")))
    assert got == ["Cargo · 8.3 kn", "8.0 kn", ""]
    assert values(spark, [(None, 7), ("ANNA", 7)], "n string, m bigint", X.display_name(F.col("n"), F.col("m"))) == ["MMSI 7", "ANNA"]
