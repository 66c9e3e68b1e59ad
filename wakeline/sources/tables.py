"""The stored tables: layout, reading, writing, catalog of partition boxes, backfill and compaction.

    positions/date=YYYY-MM-DD/cell_x=…/cell_y=…      vessels/      tracks/date=YYYY-MM
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wakeline import schema as S
from wakeline.functions.scalars import epoch_second, month_key, to_millis
from wakeline.functions.spatial import CELL_DEG, CELL_SIZE, cell_x, cell_y
from wakeline.functions.wkb import decode_paths, decode_points, path_wkb, point_wkb
from wakeline.operators.vessels import upsert
from wakeline.session import scratch_path, stage

POSITION_PARTITIONS = ["date", "cell_x", "cell_y"]
_STORED_POSITIONS = T.StructType(
    [
        *S.POSITIONS.fields,
        T.StructField("date", T.DateType()),
        T.StructField("cell_x", T.IntegerType()),
        T.StructField("cell_y", T.IntegerType()),
    ]
)
_LAYOUT = T.StructType([T.StructField("cell_deg", T.DoubleType())])
_STORED_TRACKS = T.StructType([*S.TRACKS.fields, T.StructField("date", T.StringType())])


@dataclass(frozen=True)
class Store:
    """Paths of the three tables below one root folder."""

    root: str

    @property
    def positions(self) -> str:
        return f"{self.root.rstrip('/')}/positions"

    @property
    def vessels(self) -> str:
        return f"{self.root.rstrip('/')}/vessels"

    @property
    def tracks(self) -> str:
        return f"{self.root.rstrip('/')}/tracks"

    @property
    def layout(self) -> str:
        return f"{self.root.rstrip('/')}/layout"

    @property
    def catalog(self) -> str:
        return f"{self.root.rstrip('/')}/position_partitions"

    @property
    def extents(self) -> str:
        return f"{self.root.rstrip('/')}/position_files"


# --- reading --------------------------------------------------------------------------------------


def read_positions(spark: SparkSession, store: Store, files: list[str] | None = None) -> DataFrame:
    """The stored positions, or those of some data files, given by their path below the table.

    The cell size goes along as metadata of ``cell_x``, where box queries find it.
    """
    reader = spark.read.schema(_STORED_POSITIONS)
    if files is None:
        rows = reader.parquet(store.positions)
    elif files:
        rows = reader.option("basePath", store.positions).parquet(*[f"{store.positions}/{f}" for f in files])
    else:
        rows = spark.createDataFrame([], _STORED_POSITIONS)
    cell_deg = stored_cell_size(spark, store)
    if cell_deg is None:
        return rows
    return rows.withMetadata("cell_x", {CELL_SIZE: cell_deg})


def stored_cell_size(spark: SparkSession, store: Store) -> float | None:
    """The cell size a store was begun with; None for a store without layout table."""
    row = spark.read.schema(_LAYOUT).parquet(store.layout).head() if table_exists(spark, store.layout) else None
    return row.cell_deg if row else None


def settled_cell_size(spark: SparkSession, store: Store, cell_deg: float | None) -> float:
    """The cell size to write with: the store's own, or at the first write the given or default one, which is kept."""
    kept = stored_cell_size(spark, store)
    if kept is not None:
        if cell_deg is not None and cell_deg != kept:
            raise ValueError(f"the store has cells of {kept} degrees, not {cell_deg}")
        return kept
    if cell_deg is None and table_exists(spark, store.positions):
        raise ValueError("the store has positions but no layout table: pass the cell size they were written with")
    chosen = CELL_DEG if cell_deg is None else float(cell_deg)
    spark.range(1).select(F.lit(chosen).alias("cell_deg")).write.mode("overwrite").parquet(store.layout)
    return chosen


def read_vessels(spark: SparkSession, store: Store) -> DataFrame:
    return spark.read.schema(S.VESSELS).parquet(store.vessels)


def read_tracks(spark: SparkSession, store: Store) -> DataFrame:
    return spark.read.schema(_STORED_TRACKS).parquet(store.tracks)


def register_views(spark: SparkSession, store: Store) -> None:
    """Views over the tables for SQL users; call again to see newly written files."""
    for name, read in (
        ("ais_positions", read_positions),
        ("vessel_metadata", read_vessels),
        ("ais_tracks", read_tracks),
    ):
        read(spark, store).createOrReplaceTempView(name)


# --- writing --------------------------------------------------------------------------------------


def with_position_keys(positions: DataFrame, cell_deg: float = CELL_DEG) -> DataFrame:
    """Adds the partition columns: UTC date and grid cell."""
    return positions.withColumns(
        {
            "date": F.to_date("ts"),
            "cell_x": cell_x(F.col("lon"), cell_deg),
            "cell_y": cell_y(F.col("lat"), cell_deg),
        }
    )


def _write(df: DataFrame, path: str, partitions: list[str], sort: list[str], mode: str) -> int:
    """Write partitioned Snappy Parquet; returns the number of rows written.

    Rows meet by partition for few files, but as a rebalance: adaptive execution merges small partitions
    and splits one that holds a large share of the rows over many writers.
    """
    seen = Observation()
    rows = df.hint("rebalance", *partitions) if partitions else df.hint("rebalance")
    rows = rows.sortWithinPartitions(*partitions, *sort).observe(seen, F.count(F.lit(1)).alias("rows"))
    writer = rows.write.mode(mode).option("compression", "snappy").option("partitionOverwriteMode", "dynamic")
    (writer.partitionBy(*partitions) if partitions else writer).parquet(path)
    return seen.get["rows"]


def _storable(positions: DataFrame, store: Store, cell_deg: float | None) -> DataFrame:
    size = settled_cell_size(positions.sparkSession, store, cell_deg)
    return with_position_keys(positions.select(*S.POSITION_COLS).withColumn("ts", to_millis(F.col("ts"))), size)


def write_positions(
    positions: DataFrame, store: Store, cell_deg: float | None = None, mode: str = "overwrite"
) -> int:
    """``overwrite`` replaces every (date, cell) partition the rows fall into; others stay.

    The cell size is settled by the first write; a later one may leave it out or repeat it.
    """
    return _write(_storable(positions, store, cell_deg), store.positions, POSITION_PARTITIONS, ["mmsi", "ts"], mode)


def add_positions(positions: DataFrame, store: Store, cell_deg: float | None = None) -> DataFrame:
    """Append the positions whose vessel and second the store does not hold yet; returns those rows.

    ``positions`` holds one row per vessel and second. A stored row came first, wherever it lies, so the seconds are
    looked up in all cells of the dates that occur. Run again after a failure, it adds what is missing.
    """
    spark = positions.sparkSession
    rows = stage(_storable(positions, store, cell_deg), "arrived")
    if table_exists(spark, store.positions):
        rows = stage(not_stored(rows, store), "fresh")
    _write(rows, store.positions, POSITION_PARTITIONS, ["mmsi", "ts"], "append")
    return rows


def not_stored(rows: DataFrame, store: Store) -> DataFrame:
    """The rows (with ``date``) whose vessel and second the stored positions lack, in all cells of the dates that occur."""
    dates = [r.date for r in rows.select("date").distinct().collect()]  # as many as days, not rows
    second = epoch_second(F.col("ts")).alias("_second")
    there = read_positions(rows.sparkSession, store).filter(F.col("date").isin(dates)).select("mmsi", second)
    return rows.withColumn("_second", second).join(there, ["mmsi", "_second"], "left_anti").drop("_second")


def write_tracks(tracks: DataFrame, store: Store, mode: str = "overwrite") -> int:
    """``overwrite`` replaces every month the tracks start in."""
    times = {c: to_millis(F.col(c)) for c in ("start_time", "end_time")}
    rows = tracks.select(*S.TRACK_COLS).withColumns(times).withColumn("date", month_key(F.col("start_time")))
    return _write(rows, store.tracks, ["date"], ["mmsi", "start_time"], mode)


def replace_tracks(tracks: DataFrame, vessels: DataFrame, store: Store) -> None:
    """Let ``tracks`` stand for all tracks of ``vessels`` (column mmsi); those of other vessels stay."""
    spark = tracks.sparkSession
    tracks = stage(tracks, "tracks")
    if not table_exists(spark, store.tracks):
        write_tracks(tracks, store)
        return
    months = tracks.select(month_key(F.col("start_time")).alias("date"))
    stored = read_tracks(spark, store)
    old = stored.join(vessels, "mmsi", "left_semi").select("date")
    touched = sorted(r.date for r in months.union(old).distinct().collect())  # as many as months
    others = stored.filter(F.col("date").isin(touched)).join(vessels, "mmsi", "left_anti").select(*S.TRACK_COLS)
    rows = stage(others.unionByName(tracks.select(*S.TRACK_COLS)), "months")
    left = {r.date for r in rows.select(month_key(F.col("start_time")).alias("date")).distinct().collect()}
    write_tracks(rows, store)
    for month in (m for m in touched if m not in left):
        # All tracks of the month now start in another one: replace its folder by an empty table.
        rows.limit(0).select(*S.TRACK_COLS).write.mode("overwrite").parquet(f"{store.tracks}/date={month}")


def write_vessels(vessels: DataFrame, store: Store, mode: str = "replace") -> int:
    """``replace`` writes the table anew; ``upsert`` keeps stored vessels and the latest record of each.

    An empty ``vessels`` leaves the table as it is.
    """
    spark = vessels.sparkSession
    rows = stage(vessels.select(*S.VESSEL_COLS).withColumn("last_seen", to_millis(F.col("last_seen"))), "vessels")
    if rows.isEmpty():
        return 0
    if mode == "upsert" and table_exists(spark, store.vessels):
        # The old table is an input, so the new one is finished elsewhere before it takes its place.
        rows = stage(upsert(read_vessels(spark, store), rows), "upserted")
    return _write(rows, store.vessels, [], ["mmsi"], "overwrite")


def table_exists(spark: SparkSession, path: str) -> bool:
    """Whether the folder is there; any other trouble with it is raised."""
    from pyspark.errors import AnalysisException

    try:
        spark.read.schema("_ string").parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return False
        raise
    return True


# --- catalog of partitions ------------------------------------------------------------------------


def partition_boxes(positions: DataFrame) -> DataFrame:
    """One row per (date, cell): rows and bounding box. ``positions`` carries the partition columns."""
    return positions.groupBy(*POSITION_PARTITIONS).agg(
        F.count("*").alias("rows"),
        F.min("lon").alias("min_lon"),
        F.min("lat").alias("min_lat"),
        F.max("lon").alias("max_lon"),
        F.max("lat").alias("max_lat"),
    )


def write_catalog(spark: SparkSession, store: Store) -> int:
    """Keep the partition boxes beside the table, for readers that choose partitions by their true extent."""
    return _write(partition_boxes(read_positions(spark, store)), store.catalog, [], POSITION_PARTITIONS, "overwrite")


# --- exchange with other tools --------------------------------------------------------------------


def positions_with_wkb(positions: DataFrame) -> DataFrame:
    return positions.withColumn("geometry", point_wkb(F.col("lon"), F.col("lat"))).drop("lon", "lat")


def tracks_with_wkb(tracks: DataFrame) -> DataFrame:
    return tracks.withColumn("geometry", path_wkb(F.col("path"))).drop("path")


def read_wkb_positions(spark: SparkSession, path: str) -> DataFrame:
    """A position table of another tool: WKB points, time column ``timestamp_us``."""
    rows = decode_points(spark.read.parquet(path), strict=True).withColumnRenamed("timestamp_us", "ts")
    return rows.select(*[F.col(f.name).cast(f.dataType) for f in S.POSITIONS])


def read_wkb_tracks(spark: SparkSession, path: str) -> DataFrame:
    """A track table of another tool: WKB lines. Box columns are computed from the path."""
    rows = decode_paths(spark.read.parquet(path), strict=True)
    for axis in ("lon", "lat"):
        along = F.transform("path", lambda p: p[axis])
        rows = rows.withColumn(f"min_{axis}", F.array_min(along)).withColumn(f"max_{axis}", F.array_max(along))
    if "avg_sog_exact" not in rows.columns:
        rows = rows.withColumn("avg_sog_exact", F.lit(None).cast("double"))
    return rows.select(*[F.col(f.name).cast(f.dataType) for f in S.TRACKS])


# --- maintenance ----------------------------------------------------------------------------------


def backfill(spark: SparkSession, source: str, store: Store, cell_deg: float | None = None) -> int:
    """Bring a position table of the older layout (WKB points below ``date=…/h3_r3=…``) into this one."""
    return write_positions(read_wkb_positions(spark, source), store, cell_deg)


def compact_positions(spark: SparkSession, store: Store, date: str, target_bytes: int = 512 * 1024 * 1024) -> int:
    """Rewrite one date's partitions with files of about ``target_bytes``.

    The rows are first written to the shared folder, so the partitions are replaced from a finished copy.
    """
    rows = read_positions(spark, store).filter(F.col("date") == F.lit(date).cast("date"))
    path = scratch_path(spark, "compact")
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(size)
    spark.conf.set(size, str(target_bytes))
    try:
        rows.write.mode("errorifexists").parquet(path)
        copy = spark.read.schema(rows.schema).parquet(path)
        return _write(copy, store.positions, POSITION_PARTITIONS, ["mmsi", "ts"], "overwrite")
    finally:
        spark.conf.set(size, before)
