"""The catalog of file extents: which files a query reads, and what a catalog that is behind costs."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from wakeline import schema as S
from wakeline.functions.spatial import Envelope
from wakeline.plans import queries as Q
from wakeline.sources import extents as E
from wakeline.sources import tables as TB

NEAR, FAR = (10.1, 55.1), (14.9, 59.9)  # one cell of five degrees
BOX = Envelope(10, 55, 11, 56)


def _rows(spark, points, mmsi=219000001, day=1):
    rows = [(mmsi, datetime(2024, 3, day, 0, 0, i), lat, lon) for i, (lon, lat) in enumerate(points)]
    df = spark.createDataFrame(rows, "mmsi long, ts timestamp, lat double, lon double")
    return df.select(*[F.col(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in S.POSITIONS])


@pytest.fixture
def store(spark, tmp_path):
    store = TB.Store(str(tmp_path / "a store"))
    for mmsi, point in ((1, NEAR), (2, FAR), (3, FAR)):
        TB.write_positions(_rows(spark, [point] * 3, 219000000 + mmsi).coalesce(1), store, mode="append")
    return store


def _read(spark, store, **bounds):
    """(files read, rows) by the catalog; rows equal those of the whole table."""
    whole = Q.filter_positions(TB.read_positions(spark, store), **bounds)
    rows = sorted(map(tuple, whole.collect()), key=repr)
    assert sorted(map(tuple, Q.stored_positions_in(spark, store, **bounds).collect()), key=repr) == rows
    return len(E.candidates(spark, store, **bounds).inputFiles()), len(rows)


def test_only_files_that_may_match_are_read(spark, store):
    assert _read(spark, store, box=BOX) == (3, 3)  # no catalog: all
    assert E.update(spark, store) == 3 and E.update(spark, store) == 0
    assert _read(spark, store, box=BOX) == (1, 3)  # cells alone leave all three
    assert _read(spark, store, mmsi=219000002) == (1, 3)
    assert _read(spark, store, box=BOX, mmsi=219000002) == (0, 0)
    assert _read(spark, store, end="2024-03-01T00:00:01") == (3, 6)
    assert _read(spark, store, start="2024-03-01T00:00:02") == (3, 3)
    assert _read(spark, store, start="2024-03-01T00:00:03") == (0, 0)
    assert _read(spark, store) == (3, 9)


def test_new_replaced_and_lost_entries(spark, store):
    E.update(spark, store)
    TB.write_positions(_rows(spark, [NEAR, FAR], 219000009).coalesce(1), store, mode="append")
    assert _read(spark, store, box=BOX) == (2, 4)  # unknown files are read
    assert _read(spark, store, mmsi=219000001) == (2, 3)
    assert E.update(spark, store) == 1 and _read(spark, store, mmsi=219000001) == (1, 3)
    known = E.read_extents(spark, store).count()
    TB.write_positions(_rows(spark, [FAR], 219000005).coalesce(1), store)  # replaces the partition: all files are new
    assert _read(spark, store, box=BOX) == (1, 0) and _read(spark, store, mmsi=219000005) == (1, 1)
    assert E.update(spark, store) == 1 and E.read_extents(spark, store).count() == known + 1
    assert _read(spark, store, box=BOX) == (0, 0)
    E.read_extents(spark, store).limit(0).write.mode("overwrite").parquet(store.extents)  # lost: filled again
    assert _read(spark, store, box=BOX) == (1, 0) and E.update(spark, store) == 1


def test_files_of_nulls_are_read(spark, store):
    TB.write_positions(_rows(spark, [(None, None)], 219000007), store, mode="append")
    E.update(spark, store)
    assert _read(spark, store, box=BOX) == (2, 3) and _read(spark, store, mmsi=219000007) == (1, 1)
