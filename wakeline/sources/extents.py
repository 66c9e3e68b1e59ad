"""Extents of the data files of the positions table: a catalog from which box, time and vessel queries choose files.

Folders by date and cell hold what lies anywhere in a cell; the files in them often hold much less (one import, a few vessels,
a harbour). ``update`` keeps one row for each file, and looks only into files it has not seen: work follows what was added. A
query reads the files whose extent meets its bounds, and every file the catalog does not know. Data files are never changed
and their names never used again, so a catalog that is behind costs reads, not rows; entries of files that are gone are ignored.

What meets on the driver is one name for each file of the table, as it does when Spark lists a table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeline.functions.scalars import at
from wakeline.functions.spatial import Envelope
from wakeline.sources.tables import POSITION_PARTITIONS, Store, read_positions, table_exists

BOUNDED = ["lon", "lat", "ts", "mmsi"]
EXTENT = "file string, rows long, " + ", ".join(
    f"min_{c} {t}, max_{c} {t}" for c, t in zip(BOUNDED, ("double", "double", "timestamp", "long"))
)
DEPTH = len(POSITION_PARTITIONS) + 1  # folders of a file below the table, and its name


def stored_files(spark: SparkSession, store: Store) -> list[str]:
    """The data files of the table, by their path below it."""
    return ["/".join(path.split("/")[-DEPTH:]) for path in read_positions(spark, store).inputFiles()]


def extents(positions: DataFrame) -> DataFrame:
    """One row for each data file that ``positions`` reads."""
    file = F.regexp_extract("_metadata.file_path", "([^/]+/){%d}[^/]+$" % (DEPTH - 1), 0)
    bounds = [f(c).alias(f"{name}_{c}") for c in BOUNDED for name, f in (("min", F.min), ("max", F.max))]
    return positions.groupBy(file.alias("file")).agg(F.count("*").alias("rows"), *bounds)


def read_extents(spark: SparkSession, store: Store) -> DataFrame:
    if not table_exists(spark, store.extents):
        return spark.createDataFrame([], EXTENT)
    return spark.read.schema(EXTENT).parquet(store.extents)


def update(spark: SparkSession, store: Store) -> int:
    """Add the files that the catalog does not know; returns their number. Run again after a failure, it adds what is missing."""
    known = {r.file for r in read_extents(spark, store).select("file").collect()}
    new = [f for f in stored_files(spark, store) if f not in known]
    if new:
        extents(read_positions(spark, store, new)).write.mode("append").parquet(store.extents)
    return len(new)


def _may_match(box: Envelope | None, mmsi: int | None, start: str | None, end: str | None) -> Column:
    tests = [F.lit(True)]
    if box is not None:
        tests += [F.col("max_lon") >= box.min_lon, F.col("min_lon") <= box.max_lon]
        tests += [F.col("max_lat") >= box.min_lat, F.col("min_lat") <= box.max_lat]
    if mmsi is not None:
        tests.append(F.lit(mmsi).between(F.col("min_mmsi"), F.col("max_mmsi")))
    if start is not None:
        tests.append(F.col("max_ts") >= at(start))
    if end is not None:
        tests.append(F.col("min_ts") <= at(end))
    every = tests[0]
    for test in tests[1:]:
        every = every & test
    return F.coalesce(every, F.lit(True))  # a file without a bound, such as one of nulls only, is read


def candidates(
    spark: SparkSession,
    store: Store,
    box: Envelope | None = None,
    mmsi: int | None = None,
    start: str | None = None,
    end: str | None = None,
) -> DataFrame:
    """The rows of all files that may hold rows within the bounds; which rows do is for the caller to test."""
    without = read_extents(spark, store).where(~_may_match(box, mmsi, start, end)).select("file").collect()
    gone = {r.file for r in without}
    return read_positions(spark, store, [f for f in stored_files(spark, store) if f not in gone])
