"""Geometry, stored tables, import of files, streaming."""

import json
import struct
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from wakeline import schema as S
from wakeline.functions import spatial as G
from wakeline.functions import wkb as B
from wakeline.operators.tracks import build_tracks
from wakeline.plans import ingest as I
from wakeline.plans import queries as Q
from wakeline.plans.rendering import PLAIN_HEADER
from wakeline.sources import tables as TB
from wakeline.streaming import incremental as ST

T0 = datetime(2024, 1, 15, 12)
COLS = "mmsi bigint, ts timestamp, lat double, lon double, sog float, cog float, heading int, nav_status int, " \
       "rot float, msg_type int, seq bigint"  # fmt: skip


def positions(spark, places, mmsi=219000001, start=T0, step=60):
    rows = [
        (mmsi, start + timedelta(seconds=i * step), float(lat), float(lon), 5.0, 10.0, 90, 0, 0.0, 1, i)
        for i, (lon, lat) in enumerate(places)
    ]
    return spark.createDataFrame(rows, COLS)


def one(spark, column):
    return spark.range(1).select(column).head()[0]


def test_distance(spark):
    nm = one(spark, G.haversine_nm(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(0.0)))
    assert nm == pytest.approx(60.04, abs=0.05)


def test_point_on_the_border_is_not_within(spark):
    box = G.Envelope(10, 50, 20, 60)
    df = spark.createDataFrame([(10.0, 55.0), (15.0, 60.0), (10.000001, 50.000001)], "lon double, lat double")
    assert df.filter(box.contains_point(F.col("lon"), F.col("lat"))).count() == 1
    assert G.Envelope.of(1, 2, 3, None) is None
    assert G.Envelope(1.23456789, 0, 2, 2).min_lon == 1.234568


LINES = [
    ([(0, 0), (30, 30)], False),  # passes the corner region above left? checked below
    ([(9, 55), (21, 55)], True),  # straight through, no point inside
    ([(10, 40), (10, 50)], True),  # touches a corner
    ([(0, 55), (9.999, 55)], False),
    ([(5, 57), (12, 64)], False),  # overlaps the bounding box of the line only
    ([(5, 54), (12, 61)], True),
    ([(15, 55), (15, 55)], True),  # a vessel that stays inside
    ([(0, 0), (1, 1), (15, 55)], True),
]


@pytest.mark.parametrize("line, hit", LINES)
def test_line_touches_box(spark, line, hit):
    box = G.Envelope(10, 50, 20, 60)
    path = F.array(*[F.struct(F.lit(float(x)).alias("lon"), F.lit(float(y)).alias("lat")) for x, y in line])
    assert one(spark, box.touches_path(path)) is hit


def test_wkt_and_cells(spark):
    assert one(spark, G.point_wkt(F.lit(11.25), F.lit(-55.0))) == "POINT (11.25 -55)"
    assert one(spark, G.point_wkt(F.lit(0.0), F.lit(100.0))) == "POINT (0 100)"
    assert one(spark, G.cell_x(F.lit(-180.0))) == 0
    assert one(spark, G.cell_y(F.lit(-0.1))) == 17


def test_wkb(spark):
    point = one(spark, B.point_wkb(F.lit(11.25), F.lit(55.5)))
    assert bytes(point) == struct.pack("<BIdd", 1, 1, 11.25, 55.5)
    path = F.array(*[F.struct(F.lit(x).alias("lon"), F.lit(y).alias("lat")) for x, y in [(1.0, 2.0), (3.0, 4.0)]])
    line = one(spark, B.path_wkb(path))
    assert bytes(line) == struct.pack("<BII4d", 1, 2, 2, 1.0, 2.0, 3.0, 4.0)
    back = one(spark, B.wkb_to_path(F.lit(bytes(line))))
    assert [(p.lon, p.lat) for p in back] == [(1.0, 2.0), (3.0, 4.0)]
    big_endian = struct.pack(">BIdd", 0, 1, 11.25, 55.5)
    assert [(p.lon, p.lat) for p in one(spark, B.wkb_to_path(F.lit(big_endian)))] == [(11.25, 55.5)]
    assert one(spark, B.wkb_to_path(F.lit(b"\x01\x02"))) is None


def test_geojson_feature(spark):
    tracks = build_tracks(positions(spark, [(10, 55), (10.5, 55), (11, 55.25)]))
    feature = json.loads(Q.track_features(tracks).head().feature)
    assert feature["type"] == "Feature"
    assert feature["geometry"] == {"type": "LineString", "coordinates": [[10.0, 55.0], [10.5, 55.0], [11.0, 55.25]]}
    assert feature["properties"]["point_count"] == 3
    assert feature["properties"]["voyage_id"] == f"219000001_{int(T0.timestamp())}"
    assert set(feature["properties"]) == {
        "mmsi", "voyage_id", "start_time", "end_time", "point_count", "avg_sog", "distance_nm",
    }


def test_months_of_the_track_filter(spark):
    tracks = build_tracks(positions(spark, [(10, 55), (11, 55)]))
    assert Q.filter_tracks(tracks, start="2024-01-20").count() == 1
    assert Q.filter_tracks(tracks, start="2024-02-01").count() == 0
    assert Q.filter_tracks(tracks, end="2024-01-02").count() == 1
    assert Q.filter_tracks(tracks, end="2023-12-31").count() == 0


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_positions_table(spark, tmp_path):
    store = TB.Store(str(tmp_path))
    assert TB.write_positions(positions(spark, [(10, 55), (10.1, 55), (40, 10)]), store) == 3
    # The same cell and date again: replaced. The other cell: untouched.
    assert TB.write_positions(positions(spark, [(10.2, 55)], mmsi=219000002), store) == 1
    table = TB.read_positions(spark, store)
    assert sorted((r.mmsi, r.lon) for r in table.collect()) == [(219000001, 40.0), (219000002, 10.2)]

    hits = Q.filter_positions(table, G.Envelope(9, 54, 12, 56), start="2024-01-15T00:00:00", end="2024-01-16")
    assert [r.mmsi for r in hits.collect()] == [219000002]
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    plan = plan_of(Q.filter_positions(table, G.Envelope(9, 54, 12, 56), start="2024-01-15T00:00:00", end="2024-01-16"))
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    scan = next(line for line in plan.splitlines() if "FileScan" in line)
    assert "cell_x" in scan.split("PartitionFilters")[1]
    assert "GreaterThanOrEqual(ts" in scan.split("PushedFilters")[1]

    TB.write_catalog(spark, store)
    boxes = spark.read.parquet(store.catalog).orderBy("cell_x").collect()
    assert [(r.rows, r.min_lon, r.max_lat) for r in boxes] == [(1, 10.2, 55.0), (1, 40.0, 10.0)]


def test_date_only_end_means_midnight(spark):
    rows = positions(spark, [(10, 55)])
    assert Q.filter_positions(rows, end="2024-01-15").count() == 0
    assert Q.filter_positions(rows, start="2024-01-15", end="2024-01-16").count() == 1


def test_views(spark, tmp_path):
    store = TB.Store(str(tmp_path))
    rows = positions(spark, [(10, 55), (11, 55)])
    TB.write_positions(rows, store)
    TB.write_tracks(build_tracks(rows), store)
    TB.write_vessels(spark.createDataFrame([(1, None, "A", None, None, None, None, None, None, None, T0)], S.VESSELS), store)
    TB.register_views(spark, store)
    row = spark.sql(
        "SELECT (SELECT count(*) FROM ais_positions) AS p, (SELECT count(*) FROM ais_tracks) AS t, "
        "(SELECT max(vessel_name) FROM vessel_metadata) AS v"
    ).head()
    assert tuple(row) == (2, 1, "A")


def test_foreign_track_table(spark, tmp_path):
    tracks = build_tracks(positions(spark, [(10, 55), (11, 56)]))
    path = str(tmp_path / "tracks")
    drop = ["avg_sog_exact", "min_lon", "min_lat", "max_lon", "max_lat"]
    TB.tracks_with_wkb(tracks).drop(*drop).write.parquet(path)
    (got,) = TB.read_wkb_tracks(spark, path).collect()
    assert [(p.lon, p.lat) for p in got.path] == [(10.0, 55.0), (11.0, 56.0)]
    assert (got.min_lon, got.max_lat) == (10.0, 56.0)


# --- import ---------------------------------------------------------------------------------------

CSV = "mmsi,timestamp,lat,lon,sog,name,callsign,ship type\n"


def test_import_of_mixed_files(spark, tmp_path):
    source, store = tmp_path / "in", TB.Store(str(tmp_path / "out"))
    source.mkdir()
    rows = [f"219000001,2024-01-15 12:0{i}:00,55.{i},11.0,5,ANNA,OXYZ,70" for i in range(5)]
    bad = ["219000001,2024-01-15 12:00:00,0,0,5,,,", "219000001,2024-01-15 12:09:00,55,11,200,,,", rows[0]]
    (source / "a.csv").write_text(CSV + "\n".join(rows + bad) + "\n")
    (source / "b.nmea").write_text(
        "\\c:1599239526500*5D\\!AIVDM,1,1,,B,B>cSnNP00FVur7UaC7WQ3wS1jCJJ,0*73\n"
        "\\c:1599239531500*5D\\!AIVDM,1,1,,B,B>cSnNP00FVur7UaC7WQ3wS1jCJJ,0*73\n"
        "!AIVDM,1,1,,A,H42O55i18tMET00000000000000,2*6D\n"
    )
    done = I.import_files(spark, str(source), store, I.ImportOptions(fallback="2024-05-01 00:00:00"))
    assert (done.positions_written, done.vessel_records, done.tracks_built) == (7, 2, 1)
    assert done.duration_ms > 0
    assert {r.vessel_name for r in TB.read_vessels(spark, store).collect()} == {"ANNA", "PROGUY"}
    (track,) = TB.read_tracks(spark, store).collect()
    assert (track.mmsi, track.point_count, track.date) == (219000001, 5, "2024-01")


def test_import_upserts_vessels_on_request(spark, tmp_path):
    store = TB.Store(str(tmp_path / "out"))
    for n, name in enumerate(["ANNA", "BERTA"]):
        path = tmp_path / f"{name}.csv"
        path.write_text(CSV + f"21900000{n},2024-01-15 12:00:00,55,11,5,{name},,\n")
        I.import_files(spark, str(path), store, I.ImportOptions(vessel_mode="upsert"))
    assert {r.vessel_name for r in TB.read_vessels(spark, store).collect()} == {"ANNA", "BERTA"}


def test_import_thins_in_arrival_order_over_files(spark, tmp_path):
    """The second file's rows arrive after all of the first's, so its older reports are dropped."""
    source, store = tmp_path / "in", TB.Store(str(tmp_path / "out"))
    source.mkdir()

    def rows(minutes):
        return CSV + "".join(f"219000001,2024-01-15 12:{m:02d}:00,55.{m:02d},11,5,,,\n" for m in minutes)

    (source / "a.csv").write_text(rows([0, 1, 2, 30]))
    (source / "b.csv").write_text(rows([10, 11, 31, 32]))
    for interval, points in ((None, 8), (60, 6), (120, 4)):
        I.import_files(spark, str(source), store, I.ImportOptions(pre_interval=interval))
        assert [t.point_count for t in TB.read_tracks(spark, store).collect()] == [points]


def test_stream_of_files(spark, tmp_path):
    landing, store = tmp_path / "landing", TB.Store(str(tmp_path / "out"))
    landing.mkdir()
    header = PLAIN_HEADER + ",name"

    def drop(name, *rows):
        (landing / name).write_text(header + "\n" + "".join(f"{r}\n" for r in rows))

    def run():
        parsed = ST.stream_csv(spark, str(landing), header)
        ST.import_stream(parsed, store, str(tmp_path / "state")).awaitTermination()

    row = "219000001,2024-01-15T12:00:{:02d}.{}Z,55,11,5,6,7,0,0,1,{}"
    drop("1.csv", row.format(0, 100, "OLD"), row.format(1, 0, ""), row.format(0, 900, ""))
    run()
    drop("2.csv", row.format(1, 500, "NEW"), row.format(2, 0, ""), "1,2024-01-15T12:00:00Z,55,11,5,6,7,0,0,1,")
    run()
    stored = TB.read_positions(spark, store)
    rows = sorted(stored.collect(), key=lambda r: r.ts)
    assert [(r.ts.second, r.ts.microsecond) for r in rows] == [(0, 100_000), (1, 0), (2, 0)]  # the first to arrive stays
    assert [r.vessel_name for r in TB.read_vessels(spark, store).collect()] == ["NEW"]


def test_stream_keeps_late_reports_and_merges_fields(spark, tmp_path):
    header, stores = PLAIN_HEADER + ",name,destination", []
    for files in (1, 100):
        landing, store = tmp_path / f"landing{files}", TB.Store(str(tmp_path / f"out{files}"))
        landing.mkdir()
        rows = ["2031-01-01T00:00:00Z,55,11,5,6,7,0,0,1,ALPHA,", "2024-01-15T12:00:00Z,55,11,5,6,7,0,0,1,,KIEL", "2024-01-01T00:00:00Z,9,1,5,6,7,0,0,1,,"]
        for i, r in enumerate(rows):
            (landing / f"{i}.csv").write_text(f"{header}\n219000001,{r}\n")
        parsed = ST.stream_csv(spark, str(landing), header, files)
        ST.import_stream(parsed, store, str(tmp_path / f"state{files}")).awaitTermination()
        vessel = TB.read_vessels(spark, store).collect()
        stores.append((TB.read_positions(spark, store).count(), [(v.vessel_name, v.destination) for v in vessel]))
    assert stores == [(3, [("ALPHA", "KIEL")])] * 2


def test_cell_size_belongs_to_the_store(spark, tmp_path):
    store = TB.Store(str(tmp_path / "out"))
    TB.write_positions(positions(spark, [(10.5, 55.5), (12.5, 55.5)]), store, 1.0)
    TB.write_positions(positions(spark, [(30.5, 55.5)], mmsi=219000002), store, mode="append")
    read = TB.read_positions(spark, store)
    assert sorted(r.cell_x for r in read.collect()) == [190, 192, 210]
    assert Q.filter_positions(read, box=G.Envelope(10, 55, 11, 56)).count() == 1
    assert Q.filter_positions(read.select("*", F.lit(1)), box=G.Envelope(10, 55, 11, 56)).count() == 1
    with pytest.raises(ValueError, match="cells of 1.0"):
        TB.write_positions(positions(spark, [(10.5, 55.5)]), store, 5.0)


def test_append_moves_a_track_to_an_earlier_month(spark, tmp_path):
    store, append = TB.Store(str(tmp_path / "out")), I.ImportOptions(position_mode="append")
    none = positions(spark, []).select("mmsi", "ts", "seq").limit(0)
    reports = none.select("mmsi", *[F.lit(None).cast(S.VESSELS[c].dataType).alias(c) for c in S.VESSEL_FIELDS], F.col("ts").alias("last_seen"), "seq")
    other = positions(spark, [(9, 55), (9.1, 55), (9.2, 55)], mmsi=219000002)
    february = positions(spark, [(10, 55), (10.1, 55), (10.2, 55)], start=datetime(2024, 2, 1, 0, 10), step=600)
    january = positions(spark, [(9.8, 55), (9.9, 55)], start=datetime(2024, 1, 31, 23, 50), step=600)
    for part in (february, other.unionByName(january), january):
        I.import_rows(part, reports, store, append)
    got = sorted((t.mmsi, t.point_count, t.date) for t in TB.read_tracks(spark, store).collect())
    assert got == [(219000001, 5, "2024-01"), (219000002, 3, "2024-01")]
    assert TB.read_positions(spark, store).count() == 8
    with pytest.raises(ValueError, match="pre_interval"):
        I.import_rows(other, reports, store, I.ImportOptions(position_mode="append", pre_interval=60))


def test_import_of_archives_and_line_limit(spark, tmp_path):
    import zipfile

    row = "219000001,2024-01-15T12:{:02d}:00Z,55,{},5,6,7,0,0,1"
    text = PLAIN_HEADER + "\n" + "".join(row.format(i, 11 + i / 100) + "\n" for i in range(6))
    log = "!AIVDM,1,1,,A,15RTgt0PAso;90TKcjM8h6g208CQ,0*4A\n# comment\n"
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.csv").write_text(text)
    (folder / "b.nmea").write_text(log)
    with zipfile.ZipFile(folder / "aisdk-2024-01-15.zip", "w") as z:
        z.writestr("aisdk.csv", text.replace("219000001", "219000002"))
    with zipfile.ZipFile(folder / "log.zip", "w") as z:
        z.writestr("log.nmea", log)
    for limit, want in ((0, 13), (4, 7), (1, 1)):
        store = TB.Store(str(tmp_path / f"out{limit}"))
        done = I.import_files(spark, str(folder), store, I.ImportOptions(fallback="2024-01-15 00:00:00", line_limit=limit))
        assert done.positions_written == want == TB.read_positions(spark, store).count()


def test_many_headers_are_read_in_one_job(spark, tmp_path):
    from wakeline.sources import csv as C

    for i in range(60):
        (tmp_path / f"{i:02d}.csv").write_text(PLAIN_HEADER + f",x{i % 3}\n219000001,2024-01-15T12:00:{i:02d}Z,55,11,5,6,7,0,0,1,y\n")
    (tmp_path / "empty.csv").write_text("")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("headers", "headers")
    rows = C.read_all_rows(spark, str(tmp_path))
    jobs = len(tracker.getJobIdsForGroup("headers"))
    spark.sparkContext.setJobGroup("rest", "rest")
    assert jobs <= 3
    assert rows.count() == 60


def test_foreign_geometry(spark):
    point = struct.pack("<BIdd", 1, 1, 10.5, 55.25)
    with_srid = struct.pack("<BIIdd", 1, 1 | 0x20000000, 4326, 10.5, 55.25)
    iso_z = struct.pack(">BIddd", 0, 1001, 10.5, 55.25, 3.0)
    line_zm = struct.pack("<BIIdddddddd", 1, 2 | 0xC0000000, 2, 1.0, 2.0, 0.0, 0.0, 3.0, 4.0, 0.0, 0.0)
    df = spark.createDataFrame([(bytearray(x),) for x in (point, with_srid, iso_z)] + [(None,)], "geometry binary")
    assert [(r.lon, r.lat) for r in B.decode_points(df).collect()] == [(10.5, 55.25)] * 3 + [(None, None)]
    line = B.decode_paths(spark.createDataFrame([(bytearray(line_zm),)], "geometry binary")).head().path
    assert [(p.lon, p.lat) for p in line] == [(1.0, 2.0), (3.0, 4.0)]
    with pytest.raises(Exception, match="neither a point nor a line"):
        polygon = spark.createDataFrame([(bytearray(struct.pack("<BII", 1, 3, 0)),)], "geometry binary")
        B.decode_points(polygon, strict=True).collect()
    none = spark.createDataFrame([(None, 1.0)], "lon double, lat double").select(B.point_wkb(F.col("lon"), F.col("lat")).alias("g"))
    assert none.head().g is None


def test_point_text_keeps_all_digits(spark):
    assert one(spark, G.point_wkt(F.lit(12.345678901234567), F.lit(-0.00001))) == "POINT (12.345678901234567 -0.00001)"


def test_configure_keeps_what_the_session_sets(spark):
    from wakeline.session import configure

    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "1m")
    configure(spark)
    assert spark.conf.get(key) == "1m"
    spark.conf.set(key, before)


def test_compaction_leaves_one_file_in_a_partition(spark, tmp_path):
    store = TB.Store(str(tmp_path / "out"))
    for mmsi in (219000001, 219000002, 219000003):
        TB.write_positions(positions(spark, [(10.5, 55.5), (10.6, 55.5)], mmsi=mmsi), store, mode="append")
    files = lambda: [p for p in (tmp_path / "out" / "positions").rglob("*.parquet")]
    assert len(files()) == 3
    assert TB.compact_positions(spark, store, "2024-01-15") == 6
    assert len(files()) == 1 and TB.read_positions(spark, store).count() == 6


def test_stored_tracks_keep_path_and_measures(spark, tmp_path):
    store = TB.Store(str(tmp_path / "out"))
    tracks = build_tracks(positions(spark, [(10, 55), (10.5, 55), (11, 55.25)]))
    TB.write_tracks(tracks, store)
    assert [r.asDict(True) for r in TB.read_tracks(spark, store).select(*S.TRACK_COLS).collect()] == [r.asDict(True) for r in tracks.collect()]
