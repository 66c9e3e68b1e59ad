"""Column lists of the stored tables, accepted CSV header names and rule thresholds."""

from __future__ import annotations

from pyspark.sql import types as T

POSITIONS = T.StructType(
    [
        T.StructField("mmsi", T.LongType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("lat", T.DoubleType()),
        T.StructField("lon", T.DoubleType()),
        T.StructField("sog", T.FloatType()),
        T.StructField("cog", T.FloatType()),
        T.StructField("heading", T.IntegerType()),
        T.StructField("nav_status", T.IntegerType()),
        T.StructField("rot", T.FloatType()),
        T.StructField("msg_type", T.IntegerType()),
    ]
)

VESSELS = T.StructType(
    [
        T.StructField("mmsi", T.LongType()),
        T.StructField("imo", T.LongType()),
        T.StructField("vessel_name", T.StringType()),
        T.StructField("callsign", T.StringType()),
        T.StructField("ship_type", T.IntegerType()),
        T.StructField("ship_type_desc", T.StringType()),
        T.StructField("length_m", T.FloatType()),
        T.StructField("beam_m", T.FloatType()),
        T.StructField("draught_m", T.FloatType()),
        T.StructField("destination", T.StringType()),
        T.StructField("last_seen", T.TimestampType()),
    ]
)

TRACKS = T.StructType(
    [
        T.StructField("mmsi", T.LongType()),
        T.StructField("voyage_id", T.StringType()),
        T.StructField("start_time", T.TimestampType()),
        T.StructField("end_time", T.TimestampType()),
        T.StructField("point_count", T.IntegerType()),
        T.StructField("avg_sog", T.FloatType()),
        T.StructField("avg_sog_exact", T.DoubleType()),
        T.StructField("distance_nm", T.FloatType()),
        T.StructField(
            "path",
            T.ArrayType(
                T.StructType([T.StructField("lon", T.DoubleType()), T.StructField("lat", T.DoubleType())])
            ),
        ),
        T.StructField("min_lon", T.DoubleType()),
        T.StructField("min_lat", T.DoubleType()),
        T.StructField("max_lon", T.DoubleType()),
        T.StructField("max_lat", T.DoubleType()),
    ]
)

POSITION_COLS = [f.name for f in POSITIONS]
VESSEL_COLS = [f.name for f in VESSELS]
TRACK_COLS = [f.name for f in TRACKS]
# Vessel columns filled from static reports; the merge treats each on its own.
VESSEL_FIELDS = [c for c in VESSEL_COLS if c not in ("mmsi", "last_seen")]

# The header names each field answers to; the first one present is used.
CSV_NAMES = {
    "mmsi": ["mmsi"],
    "ts": ["timestamp", "basedatetime", "time", "datetime"],
    "lat": ["lat", "latitude"],
    "lon": ["lon", "lng", "longitude"],
    "sog": ["sog"],
    "cog": ["cog"],
    "heading": ["heading"],
    "nav_status": ["nav_status", "navstatus", "status", "navigational status"],
    "rot": ["rot"],
    "msg_type": ["msg_type", "msgtype", "type"],
    "imo": ["imo"],
    "callsign": ["callsign"],
    "vessel_name": ["name"],
    "ship_type_raw": ["ship type", "shiptype"],
    "beam_m": ["width"],
    "length_m": ["length"],
    "draught_m": ["draught"],
    "destination": ["destination"],
    "dim_a": ["a"],
    "dim_b": ["b"],
    "dim_c": ["c"],
    "dim_d": ["d"],
}
CSV_REQUIRED = ["mmsi", "ts", "lat", "lon"]
# A file carries vessel metadata when it has at least one of these.
CSV_METADATA = ["imo", "callsign", "vessel_name", "ship_type_raw", "beam_m", "length_m", "draught_m", "destination"]

# Validation limits.
MMSI_MIN = 100_000_000
MMSI_MAX = 999_999_999
MAX_SOG = 102.2

# Track rules (seconds, knots, points, navigation status codes).
DOWNSAMPLE_SEC = 10
PRE_DOWNSAMPLE_SEC = 60
GAP_SEC = 6 * 3600
PORT_CALL_SOG = 0.5
PORT_CALL_SEC = 30 * 60
PORT_CALL_POINTS = 6
STATIONARY_STATUS = [1, 5]

# Look-back of the point-in-time query and default result size.
LOOKBACK_SEC = 3600
DEFAULT_LIMIT = 1000
HEADING_UNAVAILABLE = 511
