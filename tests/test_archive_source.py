"""The data source for archives: planning, pushed conditions, both formats, streaming offsets."""

import os
import zipfile
from datetime import date

from pyspark.sql import datasource as D
from pyspark.sql import functions as F

from wakeline.sources import archive_source as A
from wakeline.sources import csv as C


def put(folder, name, entries, at=None):
    with zipfile.ZipFile(folder / name, "w") as z:
        for entry, text in entries.items():
            z.writestr(entry, text)
    if at is not None:
        os.utime(folder / name, (at, at))


HEADER = "MMSI,BaseDateTime,LAT,LON,SOG\n"


def test_partitions_and_pushed_conditions(tmp_path):
    put(tmp_path, "aisdk-2024-03-01.zip", {"a.csv": HEADER, "b.csv": HEADER, "c.nmea": "!AI"})
    put(tmp_path, "aisdk-2024-03-02.zip", {"d.csv": HEADER})
    put(tmp_path, "other.zip", {"e.CSV": HEADER})
    (tmp_path / "aisdk-2024-03-03.zip").write_bytes(b"broken")

    def planned(*filters):
        reader = A.PushingReader({"path": str(tmp_path)})
        assert list(reader.pushFilters(list(filters))) == list(filters)  # Spark applies them again
        return sorted((p.entry, p.lines) for p in reader.partitions() if p.file)

    assert planned(D.LessThan(("date",), date(2024, 3, 3))) == [("a.csv", None), ("b.csv", None), ("d.csv", None)]
    assert planned(D.EqualTo(("date",), date(2024, 3, 2)), D.EqualTo(("line_no",), 0)) == [("d.csv", 1)]
    assert planned(D.In(("date",), (date(2024, 3, 1),)), D.LessThan(("line_no",), -5)) == [("a.csv", 0), ("b.csv", 0)]
    chosen = A.ArchiveReader({"path": str(tmp_path), "since": "2024-03-02", "until": "2024-03-02", "lines": "3"})
    assert [(p.entry, p.lines) for p in chosen.partitions()] == [("d.csv", 3)]
    assert A.date_of("/x/aisdk-2024-02-31.zip") is None and A.date_of("aisdk-2024-02-28.zip") == date(2024, 2, 28)


def test_rows_of_archives(spark, tmp_path):
    rows = "".join(f"21900000{i % 3},2024-03-01T00:{i // 60:02d}:{i % 60:02d}Z,55,11,{i}\n" for i in range(900))
    put(tmp_path, "aisdk-2024-03-01.zip", {"one.csv": HEADER + rows, "empty.csv": "", "x.txt": "!AI"})
    put(tmp_path, "aisdk-2024-03-02.zip", {"two.csv": "\n".join([HEADER.strip() + ",Name", "219000001,2024-03-02T00:00:00Z,55,11,1,ANNA", "", "x"])})
    (tmp_path / "aisdk-2024-03-09.zip").write_bytes(b"not read")
    lines = A.read_archives(spark, str(tmp_path), until="2024-03-02")
    assert lines.rdd.getNumPartitions() == 3
    assert {(r.entry, r.n) for r in lines.groupBy("entry").agg(F.count("*").alias("n")).collect()} == {("one.csv", 901), ("two.csv", 4)}
    first = A.read_archives(spark, str(tmp_path), since="2024-03-01", until="2024-03-02", lines=1)
    assert {r.value for r in first.collect()} == {HEADER.strip(), HEADER.strip() + ",Name"}
    positions = C.positions_of(A.read_csv(spark, str(tmp_path), until="2024-03-02"))
    assert positions.count() == 901
    assert C.positions_of(C.parse_lines(spark, A.with_order(lines))).count() == 901
    ordered = positions.where("ts < '2024-03-02'").orderBy("seq").select("sog").collect()
    assert [r.sog for r in ordered] == [float(i) for i in range(900)]
    assert A.read_archives(spark, str(tmp_path / "aisdk-2024-03-01.zip"), "nmea").collect()[0].value == "!AI"
    (tmp_path / "none").mkdir()
    assert A.read_archives(spark, str(tmp_path / "none")).count() == 0


def test_conditions_of_a_query_are_pushed(spark, tmp_path):
    put(tmp_path, "aisdk-2024-03-01.zip", {"one.csv": "a\nb"})
    (tmp_path / "aisdk-2024-03-09.zip").write_bytes(b"not read")
    key = "spark.sql.python.filterPushdown.enabled"
    spark.conf.set(key, "true")
    try:
        found = A.read_archives(spark, str(tmp_path), pushdown="true").where("date = DATE '2024-03-01' AND line_no <= 0")
        assert [r.value for r in found.collect()] == ["a"]
    finally:
        spark.conf.unset(key)


def test_stream_takes_each_archive_once(spark, tmp_path):
    landing, state = tmp_path / "landing", str(tmp_path / "state")
    landing.mkdir()

    def run():
        lines = spark.readStream.format(A.FORMAT).load(str(landing))
        out = lines.writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True)
        out.start(str(tmp_path / "out")).awaitTermination()
        return sorted(r.value for r in spark.read.parquet(str(tmp_path / "out")).collect())

    A.register(spark)
    put(landing, "b.zip", {"b.csv": "b1\nb2"}, at=100)
    assert run() == ["b1", "b2"]
    put(landing, "c.zip", {"c.csv": "c1"}, at=100)  # same time, later name
    put(landing, "a.zip", {"a.csv": "a1"}, at=200)
    assert run() == ["a1", "b1", "b2", "c1"]
    assert run() == ["a1", "b1", "b2", "c1"]
