"""The queries users ask: positions, positions at a time, tracks, vessels, series, tracks on the fly.

Each takes DataFrames and plain parameters and returns a DataFrame, so that filters, joins and limits are
planned together. Limits come with a total order.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeline import schema as S
from wakeline.functions.scalars import at as time_at
from wakeline.functions.spatial import CELL_SIZE, Envelope, line_geojson, point_wkt
from wakeline.operators.snapshots import latest_per_vessel, snapshot_series
from wakeline.operators.tracks import build_tracks
from wakeline.operators.validate import clean
from wakeline.operators.vessels import enrich, vessel_details
from wakeline.sources.extents import candidates
from wakeline.sources.tables import Store

POSITION_ORDER = ["mmsi", "ts", "msg_type", "lon", "lat"]


def _day(text: str) -> Column:
    return F.lit(text[:10]).cast("date")


def filter_positions(
    positions: DataFrame,
    box: Envelope | None = None,
    mmsi: int | None = None,
    start: str | None = None,
    end: str | None = None,
) -> DataFrame:
    """Positions of a box, vessel and closed time range.

    On the stored table the same bounds are put on its partition columns, which prunes folders. The cell size is
    the store's own (see ``read_positions``); without it, cells are not pruned by. An end given as a date means its
    midnight.
    """
    tests: list[Column] = []
    stored = "date" in positions.columns
    cell_deg = positions.schema["cell_x"].metadata.get(CELL_SIZE) if "cell_x" in positions.columns else None
    if box is not None:
        tests.append(box.contains_point(F.col("lon"), F.col("lat")))
        if cell_deg is not None:
            tests.append(box.covers_cells(F.col("cell_x"), F.col("cell_y"), cell_deg))
    if mmsi is not None:
        tests.append(F.col("mmsi") == mmsi)
    if start is not None:
        tests.append(F.col("ts") >= time_at(start))
        if stored:
            tests.append(F.col("date") >= _day(start))
    if end is not None:
        tests.append(F.col("ts") <= time_at(end))
        if stored:
            tests.append(F.col("date") <= _day(end))
    for test in tests:
        positions = positions.filter(test)
    return positions


def stored_positions_in(spark: SparkSession, store: Store, **bounds) -> DataFrame:
    """``filter_positions`` on a store, from the files that its catalog of extents leaves."""
    return filter_positions(candidates(spark, store, **bounds), **bounds)


POSITION_RESULT = [
    "mmsi", "ts", "geom_wkt", "sog", "cog", "heading", "nav_status", "rot", "msg_type",
    "vessel_name", "ship_type", "ship_type_desc", "length_m",
]


def _position_result(positions: DataFrame, vessels: DataFrame) -> DataFrame:
    shaped = positions.withColumn("geom_wkt", point_wkt(F.col("lon"), F.col("lat")))
    return enrich(shaped, vessels).select(*POSITION_RESULT)


def positions_range(
    positions: DataFrame, vessels: DataFrame, limit: int | None = S.DEFAULT_LIMIT, **bounds
) -> DataFrame:
    """Positions of a box, vessel and time range with vessel data; ``limit=None`` gives all."""
    rows = filter_positions(positions, **bounds)
    if limit is not None:
        rows = rows.orderBy(*POSITION_ORDER).limit(limit)
    return _position_result(rows, vessels)


def positions_at(
    positions: DataFrame,
    vessels: DataFrame,
    at: str,
    box: Envelope | None = None,
    mmsi: int | None = None,
    limit: int | None = S.DEFAULT_LIMIT,
    lookback_sec: int = S.LOOKBACK_SEC,
) -> DataFrame:
    """The newest position of each vessel in the hour up to ``at``; the box is applied before choosing."""
    moment = datetime.fromisoformat(at)
    rows = filter_positions(
        positions, box, mmsi, (moment - timedelta(seconds=lookback_sec)).isoformat(), moment.isoformat()
    )
    newest = latest_per_vessel(rows)
    if limit is not None:
        newest = newest.orderBy(*POSITION_ORDER).limit(limit)
    return _position_result(newest, vessels)


def positions_series(
    positions: DataFrame, vessels: DataFrame, first: str, last: str, step_sec: int = 300, **bounds
) -> DataFrame:
    """``positions_at`` for every tick of a series, in one job, with a column ``at``."""
    early = (datetime.fromisoformat(first) - timedelta(seconds=S.LOOKBACK_SEC)).isoformat()
    rows = filter_positions(positions, start=early, end=last, **bounds)
    frames = snapshot_series(rows, first, last, step_sec)
    shaped = frames.withColumn("geom_wkt", point_wkt(F.col("lon"), F.col("lat")))
    return enrich(shaped, vessels).select("at", *POSITION_RESULT)


def filter_tracks(
    tracks: DataFrame,
    box: Envelope | None = None,
    mmsi: int | None = None,
    start: str | None = None,
    end: str | None = None,
) -> DataFrame:
    """Tracks that touch a box, of a vessel, whose start month lies between the months of two dates.

    The stored box columns settle most tracks; only the others have their path tested.
    """
    if box is not None:
        tracks = tracks.filter(
            box.overlaps(F.col("min_lon"), F.col("min_lat"), F.col("max_lon"), F.col("max_lat"))
        ).filter(box.touches_path(F.col("path")))
    if mmsi is not None:
        tracks = tracks.filter(F.col("mmsi") == mmsi)
    month = F.col("date") if "date" in tracks.columns else F.date_format("start_time", "yyyy-MM")
    if start is not None:
        tracks = tracks.filter(month >= start[:7])
    if end is not None:
        tracks = tracks.filter(month <= end[:7])
    return tracks


def track_features(tracks: DataFrame, **bounds) -> DataFrame:
    """One GeoJSON feature per track, as text in ``feature``; together they form the collection."""
    rows = filter_tracks(tracks, **bounds)
    text_time = "yyyy-MM-dd HH:mm:ss"
    feature = F.struct(
        F.lit("Feature").alias("type"),
        line_geojson(F.col("path")).alias("geometry"),
        F.struct(
            "mmsi",
            "voyage_id",
            F.date_format("start_time", text_time).alias("start_time"),
            F.date_format("end_time", text_time).alias("end_time"),
            "point_count",
            "avg_sog",
            "distance_nm",
        ).alias("properties"),
    )
    return rows.select("mmsi", "voyage_id", F.to_json(feature, {"ignoreNullFields": "false"}).alias("feature"))


def find_vessels(
    vessels: DataFrame, mmsi: int | None = None, name: str | None = None, limit: int | None = None
) -> DataFrame:
    """Vessels by MMSI and part of the name, in any case; ``%`` and ``_`` are wildcards."""
    if mmsi is not None:
        vessels = vessels.filter(F.col("mmsi") == mmsi)
    if name is not None and name.strip():
        vessels = vessels.filter(F.upper("vessel_name").like(f"%{name.upper()}%"))
    if limit is not None:
        vessels = vessels.orderBy("vessel_name", "mmsi").limit(limit)
    return vessels.select(*S.VESSEL_COLS)


SUGGESTIONS = 8
MIN_SEARCH_CHARS = 2


def suggest_vessels(vessels: DataFrame, text: str) -> DataFrame:
    """The first eight vessels whose name holds the text; none for fewer than two characters."""
    if len(text.strip()) < MIN_SEARCH_CHARS:
        return vessels.select(*S.VESSEL_COLS).limit(0)
    return find_vessels(vessels, name=text, limit=SUGGESTIONS)


def position_details(positions: DataFrame, vessels: DataFrame, mmsi: int) -> DataFrame:
    """A vessel's positions with its full record."""
    return vessel_details(positions.filter(F.col("mmsi") == mmsi), vessels.filter(F.col("mmsi") == mmsi))


def tracks_on_the_fly(positions: DataFrame, mmsis: list[int] | None = None, **bounds) -> DataFrame:
    """Tracks built straight from positions of the chosen vessels, box and time range."""
    rows = filter_positions(positions, **bounds)
    if mmsis is not None:
        rows = rows.filter(F.col("mmsi").isin(mmsis))
    if "seq" in rows.columns:
        rows = clean(rows)
    return build_tracks(rows)
