"""Voyage tracks: one row per segment of at least two points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wakeline import schema as S
from wakeline.functions.scalars import voyage_id
from wakeline.operators.downsample import pre_downsample, with_previous
from wakeline.operators.segments import segment_points

POINT_COLS = ["mmsi", "ts", "lon", "lat", "sog", "nav_status"]


def track_points(positions: DataFrame, arrival_block: Column | None = None, pre_interval: int | None = None) -> DataFrame:
    """Validated positions thinned and assigned to segments.

    ``pre_interval`` first thins in arrival order (seconds, needs ``arrival_block`` and ``seq``), which is
    what a memory-bound import does; the default is off.
    """
    if pre_interval is not None:
        positions = pre_downsample(positions.select(*POINT_COLS, "seq"), arrival_block, "seq", pre_interval)
    return segment_points(with_previous(positions.select(*POINT_COLS)))


def whole_speed_mean(sog: Column) -> Column:
    """Mean speed in whole knots: every partial sum and the division drop their fraction (speeds >= 0)."""
    return F.floor(F.sum(F.floor(sog.cast("double"))) / F.count(sog)).cast("float")


def tracks_from_points(points: DataFrame) -> DataFrame:
    """Aggregate segment points to tracks. A segment of one point gives no track.

    The path is part of the result, so a track's points meet in one row: after thinning at most 8 640 of
    24 bytes for each day the voyage lasts.
    """
    path = F.sort_array(F.collect_list(F.struct("ts", "lon", "lat")))
    sog = F.col("sog")
    return (
        points.groupBy("mmsi", "segment_start")
        .agg(
            F.max("ts").alias("end_time"),
            F.count("*").cast("int").alias("point_count"),
            whole_speed_mean(sog).alias("avg_sog"),
            F.avg(sog.cast("double")).alias("avg_sog_exact"),
            F.sum("leg_nm").cast("float").alias("distance_nm"),
            path.alias("_path"),
            F.min("lon").alias("min_lon"),
            F.min("lat").alias("min_lat"),
            F.max("lon").alias("max_lon"),
            F.max("lat").alias("max_lat"),
        )
        .filter(F.col("point_count") >= 2)
        .withColumnRenamed("segment_start", "start_time")
        .withColumn("voyage_id", voyage_id(F.col("mmsi"), F.col("start_time")))
        .withColumn("path", F.transform("_path", lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat"))))
        .select(*S.TRACK_COLS)
    )


def build_tracks(positions: DataFrame, **options) -> DataFrame:
    return tracks_from_points(track_points(positions, **options))


def track_summary(positions: DataFrame) -> DataFrame:
    """One row: points read, thinned away, tracks built, single points skipped."""
    sizes = track_points(positions).groupBy("mmsi", "segment_start").agg(F.count("*").alias("_n"))
    built = sizes.agg(
        F.sum("_n").alias("_kept"),
        F.count_if(F.col("_n") >= 2).alias("tracks"),
        F.count_if(F.col("_n") == 1).alias("skipped_single_point"),
    )
    read = positions.agg(F.count("*").alias("input_positions"))
    both = read.unionByName(built, allowMissingColumns=True).agg(
        *[F.max(c).alias(c) for c in ("input_positions", "_kept", "tracks", "skipped_single_point")]
    )
    return both.select(
        "input_positions",
        (F.col("input_positions") - F.coalesce("_kept", F.lit(0))).alias("downsampled_positions"),
        "tracks",
        "skipped_single_point",
    )
