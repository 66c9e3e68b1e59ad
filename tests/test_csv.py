"""Delimited input: headers, cells, metadata rows, archives, routing."""

import zipfile

import pytest
from pyspark.sql import functions as F

from wakeline.functions.scalars import parse_time
from wakeline.operators.vessels import merge_reports
from wakeline.plans.rendering import DAILY_HEADER
from wakeline.sources import csv as C
from wakeline.sources import files as FI


@pytest.fixture
def read(spark, tmp_path):
    def reader(*texts):
        for i, text in enumerate(texts):
            (tmp_path / f"in{i}.csv").write_text(text)
        return C.read_csv(spark, str(tmp_path))

    return reader


def daily(**cells):
    names = DAILY_HEADER.split(",")
    return ",".join(str(cells.get(n.replace("# ", "").replace(" ", "_"), "")) for n in names)


def test_full_position_row(read):
    text = "mmsi,timestamp,lat,lon,sog,cog,heading,nav_status,rot,msg_type\n"
    (r,) = read(text + "219000001,2024-01-15T12:00:00Z,55.5,11.25,12.5,180.0,179,0,-1.5,1\n").collect()
    assert (r.mmsi, str(r.ts), r.lat, r.lon) == (219000001, "2024-01-15 12:00:00", 55.5, 11.25)
    assert (r.sog, r.cog, r.heading, r.nav_status, r.rot, r.msg_type) == (12.5, 180.0, 179, 0, -1.5, 1)


def test_synonyms_in_capitals(read):
    (r,) = read("MMSI,BaseDateTime,LAT,LON,SOG,COG\n219000001,2024-01-15T12:00:00,55.5,11.25,1.5,2.5\n").collect()
    assert (r.lat, r.lon, r.sog, r.cog, r.heading) == (55.5, 11.25, 1.5, 2.5, None)


def test_bad_rows_are_dropped_and_short_rows_read(read):
    text = "mmsi,timestamp,lat,lon,sog\nx,2024-01-15 12:00:00,1,2,3\n\n219000001,2024-01-15 12:00:00,55,11\n"
    (r,) = read(text + "219000002,yesterday,55,11,1\n219000003,2024-01-15 12:00:00,,11,1\n").collect()
    assert (r.mmsi, r.sog) == (219000001, None)


def test_missing_required_column_gives_nothing(read):
    assert read("mmsi,timestamp,lat\n1,2024-01-15 12:00:00,5\n").count() == 0


def test_files_with_different_headers(read):
    rows = read(
        "mmsi,timestamp,lat,lon\n219000001,2024-01-15 12:00:00,1,2\n",
        "lon,lat,time,mmsi,name\n4,3,15/01/2024 12:00:00,219000002,ANNA\n",
        "lon,lat\n4,3\n",
    ).orderBy("mmsi")
    assert [(r.mmsi, r.lat, r.lon, r.vessel_name) for r in rows.collect()] == [
        (219000001, 1.0, 2.0, None),
        (219000002, 3.0, 4.0, "ANNA"),
    ]


def test_daily_file_row(read):
    row = daily(
        Timestamp="01/02/2024 03:04:05", MMSI=219000001, Latitude=55.5, Longitude=11.25,
        Navigational_status="Under way using engine", ROT=0.0, SOG=8.1, COG=90.0, Heading="91.0", IMO="Unknown",
        Callsign="OXYZ", Name='"ANNA, THE ""BIG"""', Ship_type="Cargo", Width=10, Length=50, Draught=3.2,
        Destination="unknown",
    )
    parsed = read(DAILY_HEADER + "\n" + row + "\n")
    (r,) = parsed.collect()
    assert str(r.ts) == "2024-02-01 03:04:05"
    assert (r.nav_status, r.heading) == (None, 91)
    (v,) = C.vessel_reports_of(parsed).collect()
    assert (v.imo, v.callsign, v.vessel_name, v.destination) == (None, "OXYZ", 'ANNA, THE "BIG"', None)
    assert (v.ship_type, v.ship_type_desc, v.length_m, v.beam_m) == (None, "Cargo", 50.0, 10.0)


def test_base_station_has_no_metadata(read):
    row = daily(Timestamp="01/02/2024 03:04:05", MMSI=2190064, Latitude=55.5, Longitude=11.25, IMO="Unknown",
                Callsign="n/a", Name="undefined", Ship_type="70")
    parsed = read(DAILY_HEADER + "\n" + row + "\n")
    assert parsed.count() == 1
    # A numeric type alone does not count as metadata.
    assert C.vessel_reports_of(parsed).count() == 0


def test_size_from_antenna_offsets(read):
    row = daily(Timestamp="01/02/2024 03:04:05", MMSI=219000001, Latitude=1, Longitude=2, A=100, B=20, C=9, D=11)
    (v,) = C.vessel_reports_of(read(DAILY_HEADER + "\n" + row + "\n")).collect()
    assert (v.length_m, v.beam_m) == (120.0, 20.0)


def test_merge_follows_file_order(read):
    base = {"MMSI": 219000001, "Latitude": 1, "Longitude": 2}
    rows = [
        daily(**base, Timestamp="02/02/2024 00:00:00", Name="OLD", Callsign="OXYZ"),
        daily(**base, Timestamp="01/02/2024 00:00:00", Name="NEW", Callsign="Unknown", Draught=4),
    ]
    (v,) = merge_reports(C.vessel_reports_of(read(DAILY_HEADER + "\n" + "\n".join(rows) + "\n"))).collect()
    assert (v.vessel_name, v.callsign, v.draught_m) == ("NEW", "OXYZ", 4.0)
    assert str(v.last_seen) == "2024-02-01 00:00:00"


def test_header_resolution():
    assert C.resolve(C.header_fields("# Timestamp, MMSI ,lat,LATITUDE,lon,lon")) == {
        "mmsi": 1, "ts": 0, "lat": 2, "lon": 5,
    }


TIMES = {
    "2024-01-01T00:00:00Z": "2024-01-01 00:00:00",
    "2024-01-01T00:00:00.25Z": "2024-01-01 00:00:00.250000",
    "2024-01-01T00:00:00+01:00": "2023-12-31 23:00:00",
    "2024-01-01T00:00:00": "2024-01-01 00:00:00",
    "2024-01-01 00:00:00": "2024-01-01 00:00:00",
    "2024/01/01 00:00:00": "2024-01-01 00:00:00",
    "31/12/2024 10:11:12": "2024-12-31 10:11:12",
    "2024-01-01 00:00:00Z": None,
    "2024-01-01 00:00:00.5": None,
    "2024-13-01 00:00:00": None,
    "2024-01-01": None,
    "": None,
}


def test_time_formats(spark):
    df = spark.createDataFrame([(t,) for t in TIMES], "t string").select("t", parse_time(F.col("t")).alias("ts"))
    assert {r.t: r.ts and str(r.ts) for r in df.collect()} == TIMES


# --- archives and routing -------------------------------------------------------------------------

HEADER = "mmsi,timestamp,lat,lon,name\n"


def archive(path, entries):
    with zipfile.ZipFile(path, "w") as z:
        for name, text in entries.items():
            z.writestr(name, text)


def test_archive_entry_of_the_right_kind(spark, tmp_path):
    rows = "".join(f"{219000000 + i},2024-01-15 12:00:00,1,2,SHIP {i}\r\n" for i in range(25_000))
    archive(tmp_path / "aisdk-2024-01-15.zip", {"doc/": "", "readme.md": "hi", "data.CSV": HEADER + "\n" + rows})
    archive(tmp_path / "aisdk-2024-01-16.zip", {"lon_first.csv": "lon,lat,time,mmsi\n5,6,2024-01-16 00:00:00,7\n"})
    paths = FI.daily_files(str(tmp_path), ["2024-01-15", "2024-01-16"])
    got = C.read_csv_archives(spark, paths)
    assert got.count() == 25_001
    first = got.filter("seq.file like '%01-15%'").orderBy("seq").limit(2).collect()
    assert [r.vessel_name for r in first] == ["SHIP 0", "SHIP 1"]
    assert got.filter("mmsi = 7").head().lat == 6.0


def test_routing_by_name_and_archive_content(spark, tmp_path):
    (tmp_path / "a.CSV").write_text(HEADER)
    (tmp_path / "b.nmea").write_text("x")
    (tmp_path / "c.log").write_text("x")
    archive(tmp_path / "d.csv.zip", {"x": ""})
    archive(tmp_path / "e.zip", {"dir/": "", "x.csv": ""})
    archive(tmp_path / "f.zip", {"x.aivdm": "", "y.csv": ""})
    groups = {k: sorted(p.rsplit("/", 1)[1] for p in v) for k, v in FI.route(spark, str(tmp_path)).items()}
    assert groups == {
        ("csv", False): ["a.CSV"],
        ("nmea", False): ["b.nmea", "c.log"],
        ("csv", True): ["d.csv.zip", "e.zip"],
        ("nmea", True): ["f.zip"],
    }


def test_first_lines(spark, tmp_path):
    (tmp_path / "a.txt").write_text("h\n\n1\n2\n3\n")
    lines = FI.text_lines(spark, str(tmp_path / "a.txt"))
    assert [r.value for r in FI.first_lines(lines, 3).orderBy("seq").collect()] == ["h", "", "1"]
    assert FI.first_lines(lines, 0).count() == 5
