"""The registered queries as plain SQL over the same tables, written independently of the Spark jobs.

Sequential rules (thinning, segmentation) are stated as recursion along each vessel's rows.
"""

from __future__ import annotations

_EPOCH = "TIMESTAMP '1970-01-01 00:00:00'"


def _f(expr: str) -> str:
    """A 32-bit float shown with four decimals."""
    return f"round(CAST(CAST({expr} AS REAL) AS DOUBLE), 4)"


# --- derived tables -------------------------------------------------------------------------------

RAW = """
e AS (
  SELECT event_id AS eid, user_id, event_type, value,
         date_diff('microsecond', TIMESTAMP '2024-01-01 00:00:00', ts) // 12 AS us
  FROM events),
e2 AS (SELECT *, us // 21600000000 AS phase FROM e),
base AS (
  SELECT CASE WHEN eid % 97 = 0 THEN 99999999 ELSE 219000000 + user_id END AS mmsi,
         TIMESTAMP '2024-01-01 00:00:00' + to_microseconds(us) AS ts,
         CASE WHEN eid % 101 = 0 THEN 0.0::DOUBLE WHEN eid % 103 = 0 THEN 91.0::DOUBLE
              ELSE 54 + CAST(eid * 53 % 400 AS DOUBLE) / 100 END AS lat,
         CASE WHEN eid % 101 = 0 THEN 0.0::DOUBLE ELSE 8 + CAST(eid * 37 % 800 AS DOUBLE) / 100 END AS lon,
         CAST(CASE WHEN phase % 3 = 0 THEN CAST(eid % 5 AS DOUBLE) / 10
                   WHEN event_type <> 'error' THEN value END AS REAL) AS sog,
         CAST(CAST(eid * 7 % 3600 AS DOUBLE) / 10 AS REAL) AS cog,
         CAST(CASE WHEN event_type = 'view' THEN 511 ELSE eid % 360 END AS INTEGER) AS heading,
         CAST(CASE WHEN phase % 3 = 0 AND user_id % 7 = 0 THEN 5 ELSE 0 END AS INTEGER) AS nav_status,
         CAST(CASE WHEN event_type <> 'click' THEN eid % 9 - 4 END AS REAL) AS rot,
         CAST(CASE eid % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 ELSE 18 END AS INTEGER) AS msg_type,
         phase * 10000000 + eid * 7919 % 1000003 AS seq, eid
  FROM e2),
raw AS (
  SELECT mmsi, ts, lat, lon, sog, cog, heading, nav_status, rot, msg_type, seq FROM base
  UNION ALL
  SELECT mmsi, ts, lat, lon, sog, cog, heading, nav_status, rot, msg_type, seq + 1000000000000 FROM base
  WHERE eid % 50 = 0)"""

REASON = """
CASE WHEN mmsi NOT BETWEEN 100000000 AND 999999999 THEN 'mmsi'
     WHEN lat NOT BETWEEN -90 AND 90 OR lon NOT BETWEEN -180 AND 180 THEN 'coords'
     WHEN lat = 0 AND lon = 0 THEN 'null_island'
     WHEN CAST(sog AS DOUBLE) > 102.2 THEN 'sog' END"""

CHECKED = f"""{RAW},
checked AS (SELECT *, {REASON} AS reason FROM raw),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY mmsi, epoch_us(ts) // 1000000 ORDER BY seq) AS nth
  FROM checked WHERE reason IS NULL)"""

CLEAN = f"""{CHECKED},
clean AS (
  SELECT mmsi, ts, lat, lon, sog, cog, heading, nav_status, rot, msg_type, seq FROM numbered WHERE nth = 1)"""

STATIC = """
static AS (
  SELECT 219000000 + o_custkey AS mmsi,
         CASE WHEN o_orderkey % 3 = 0 THEN 9000000 + o_orderkey % 1000000 END AS imo,
         CASE WHEN o_orderkey % 3 <> 1 THEN 'SHIP ' || (o_orderkey % 1000) END AS vessel_name,
         CASE WHEN o_orderkey % 3 = 1 THEN 'CS' || (o_orderkey % 9999) END AS callsign,
         CAST(CASE WHEN o_orderkey % 3 = 2 THEN o_orderkey % 100 END AS INTEGER) AS ship_type,
         CASE WHEN o_orderkey % 3 = 0 THEN lower(o_orderpriority) END AS ship_type_desc,
         CAST(CASE WHEN o_orderkey % 3 <> 2 THEN o_orderkey % 400 END AS DOUBLE) AS length_m,
         CAST(CASE WHEN o_orderkey % 3 = 2 THEN o_orderkey % 60 END AS DOUBLE) AS beam_m,
         CASE WHEN o_orderkey % 3 = 1 THEN round(CAST(o_orderkey % 200 AS DOUBLE) / 10, 4) END AS draught_m,
         CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus END AS destination,
         o_orderdate AS last_seen, o_orderkey AS seq
  FROM orders)"""

MERGED = f"""{STATIC},
merged AS (
  SELECT mmsi,
         arg_max(imo, seq) FILTER (imo IS NOT NULL) AS imo,
         arg_max(vessel_name, seq) FILTER (vessel_name IS NOT NULL) AS vessel_name,
         arg_max(callsign, seq) FILTER (callsign IS NOT NULL) AS callsign,
         arg_max(ship_type, seq) FILTER (ship_type IS NOT NULL) AS ship_type,
         arg_max(ship_type_desc, seq) FILTER (ship_type_desc IS NOT NULL) AS ship_type_desc,
         arg_max(length_m, seq) FILTER (length_m IS NOT NULL) AS length_m,
         arg_max(beam_m, seq) FILTER (beam_m IS NOT NULL) AS beam_m,
         arg_max(draught_m, seq) FILTER (draught_m IS NOT NULL) AS draught_m,
         arg_max(destination, seq) FILTER (destination IS NOT NULL) AS destination,
         arg_max(last_seen, seq) AS last_seen
  FROM static GROUP BY mmsi)"""

NAMED = """
named AS (
  SELECT 219000000 + c_custkey AS mmsi, CAST(NULL AS BIGINT) AS imo, c_name AS vessel_name,
         CAST(NULL AS VARCHAR) AS callsign,
         CAST(CASE WHEN c_custkey % 2 = 0 THEN c_custkey % 100 END AS INTEGER) AS ship_type,
         lower(c_mktsegment) AS ship_type_desc,
         CAST(CASE WHEN c_custkey % 5 <> 0 THEN c_custkey % 300 END AS DOUBLE) AS length_m,
         CAST(NULL AS DOUBLE) AS beam_m, CAST(NULL AS DOUBLE) AS draught_m,
         CAST(NULL AS VARCHAR) AS destination, TIMESTAMP '2024-01-01 00:00:00' AS last_seen
  FROM customer)"""

VESSEL_COLS = """mmsi, imo, vessel_name, callsign, ship_type, ship_type_desc, length_m, beam_m, draught_m,
destination, last_seen"""

# Newest whole record; nulls sort first among equal times, so the larger record wins.
_RECORD_ORDER = ", ".join(
    f"{c} DESC NULLS LAST"
    for c in (
        "last_seen", "imo", "vessel_name", "callsign", "ship_type", "ship_type_desc", "length_m", "beam_m",
        "draught_m", "destination",
    )
)


def _latest(source: str) -> str:
    return (
        f"SELECT {VESSEL_COLS} FROM (SELECT *, row_number() OVER (PARTITION BY mmsi ORDER BY {_RECORD_ORDER}) AS nth "
        f"FROM {source}) WHERE nth = 1"
    )


POSITION_VALUES = f"""mmsi, ts, lat, lon, {_f('sog')} AS sog, {_f('cog')} AS cog, heading, nav_status,
{_f('rot')} AS rot, msg_type"""


def _plain_number(c: str) -> str:
    """All digits of a double, a whole number without its fraction."""
    return f"regexp_replace(CAST({c} AS VARCHAR), '\\.0$', '')"


# What the daily files carry of a position, as it is stored.
_STORED_VALUES = f"""mmsi, date_trunc('millisecond', ts) AS ts, lat, lon, {_f('sog')} AS sog, {_f('cog')} AS cog, heading,
nav_status, {_f('rot')} AS rot, CAST(NULL AS INTEGER) AS msg_type"""
_FUTURE = "TIMESTAMP '2031-05-06 07:08:09'"
_STREAMED_POSITIONS = f"""WITH {CLEAN} SELECT {_STORED_VALUES} FROM clean
UNION ALL SELECT 219999999, {_FUTURE}, 55.5, 10.25, NULL, NULL, NULL, NULL, NULL, NULL"""
_STREAMED_VESSELS = f"""WITH {RAW},
report AS (
  SELECT mmsi, ts, seq, seq // 10000000 AS phase FROM raw UNION ALL SELECT 219999999, {_FUTURE}, 0, 0),
told AS (
  SELECT *, CASE WHEN phase % 2 = 0 THEN 'V ' || mmsi || ' ' || phase END AS name,
         CASE WHEN phase % 2 = 1 THEN 'PORT ' || phase END AS port
  FROM report)
SELECT mmsi, CAST(NULL AS BIGINT) AS imo, max_by(name, seq) FILTER (name IS NOT NULL) AS vessel_name,
       CAST(NULL AS VARCHAR) AS callsign, CAST(NULL AS INTEGER) AS ship_type, CAST(NULL AS VARCHAR) AS ship_type_desc,
       CAST(mmsi % 300 + 1 AS DOUBLE) AS length_m, CAST(NULL AS DOUBLE) AS beam_m, CAST(NULL AS DOUBLE) AS draught_m,
       max_by(port, seq) FILTER (port IS NOT NULL) AS destination,
       date_trunc('millisecond', max_by(ts, seq)) AS last_seen
FROM told GROUP BY mmsi"""
_ACCUMULATED_VESSELS = f"""WITH {RAW}, {NAMED},
part AS (
  SELECT *, 1 AS delivery FROM raw WHERE seq // 10000000 <= 5 UNION ALL SELECT *, 2 FROM raw WHERE seq // 10000000 >= 4),
seen AS (SELECT mmsi, delivery, max_by(ts, seq) AS seen_at FROM part GROUP BY mmsi, delivery)
SELECT v.mmsi, imo, vessel_name, callsign, CAST(NULL AS INTEGER) AS ship_type, CAST(NULL AS VARCHAR) AS ship_type_desc,
       length_m, beam_m, draught_m, destination, date_trunc('millisecond', max(seen_at)) AS last_seen
FROM seen JOIN named v ON seen.mmsi = v.mmsi GROUP BY ALL"""


_WKT = f"'POINT (' || {_plain_number('p.lon')} || ' ' || {_plain_number('p.lat')} || ')'"
RESULT = f"""p.mmsi, p.ts, {_WKT} AS geom_wkt, {_f('p.sog')} AS sog, {_f('p.cog')} AS cog, p.heading, p.nav_status,
{_f('p.rot')} AS rot, p.msg_type, v.vessel_name, v.ship_type, v.ship_type_desc, v.length_m"""
_IN_BOX = "lon > 9.5 AND lon < 13.25 AND lat > 54.75 AND lat < 56.5"
_IN_RANGE = "ts >= TIMESTAMP '2024-01-01 18:00:00' AND ts <= TIMESTAMP '2024-01-02 12:00:00'"
_IN_HOUR = "ts >= TIMESTAMP '2024-01-02 08:30:00' AND ts <= TIMESTAMP '2024-01-02 09:30:00'"


def _at(extra: str) -> str:
    return f"""WITH {CLEAN}, {NAMED},
ranked AS (SELECT *, row_number() OVER (PARTITION BY mmsi ORDER BY ts DESC) AS nth FROM clean WHERE {_IN_HOUR} {extra}),
p AS (SELECT * FROM ranked WHERE nth = 1)
SELECT {RESULT} FROM p LEFT JOIN named v ON p.mmsi = v.mmsi"""


# --- tracks ---------------------------------------------------------------------------------------


def _thinned(source: str = "clean") -> str:
    """Greedy ten-second rule along each vessel (needs WITH RECURSIVE)."""
    return f"""
t_in AS (SELECT *, epoch_us(ts) AS us, row_number() OVER (PARTITION BY mmsi ORDER BY ts) AS n FROM {source}),
t_walk AS (
  SELECT mmsi, n, us AS last, true AS kept FROM t_in WHERE n = 1
  UNION ALL
  SELECT r.mmsi, r.n, CASE WHEN (r.us - w.last) // 1000000 >= 10 THEN r.us ELSE w.last END,
         (r.us - w.last) // 1000000 >= 10
  FROM t_walk w JOIN t_in r ON r.mmsi = w.mmsi AND r.n = w.n + 1),
thinned AS (SELECT t_in.* EXCLUDE (n) FROM t_in JOIN t_walk USING (mmsi, n) WHERE kept)"""


PRE_THINNED = """
a_in AS (SELECT *, epoch_us(ts) AS us, row_number() OVER (PARTITION BY mmsi ORDER BY seq) AS n FROM clean),
a_walk AS (
  SELECT mmsi, n, us AS last, true AS kept FROM a_in WHERE n = 1
  UNION ALL
  SELECT r.mmsi, r.n, CASE WHEN r.us - w.last >= 60000000 THEN r.us ELSE w.last END, r.us - w.last >= 60000000
  FROM a_walk w JOIN a_in r ON r.mmsi = w.mmsi AND r.n = w.n + 1),
pre AS (SELECT a_in.* EXCLUDE (n, us) FROM a_in JOIN a_walk USING (mmsi, n) WHERE kept)"""


SEGMENTED = """
s_lag AS (
  SELECT *, COALESCE(nav_status IN (1, 5), false) AS still, row_number() OVER v AS n, lag(us) OVER v AS p_us,
         lag(lat) OVER v AS p_lat, lag(lon) OVER v AS p_lon
  FROM thinned WINDOW v AS (PARTITION BY mmsi ORDER BY us)),
s_in AS (
  SELECT *, COALESCE((us - p_us) // 1000000 > 21600, false) AS gap_cut,
         COALESCE((us - p_us) // 1000000 <= 21600 AND still <> lag(still) OVER (PARTITION BY mmsi ORDER BY us), false)
           AS status_cut,
         COALESCE(sog < 0.5::REAL, false) AS slow
  FROM s_lag),
s_walk AS (
  SELECT mmsi, n, CASE WHEN slow THEN us END AS since, CASE WHEN slow THEN 1 ELSE 0 END AS points,
         CAST(NULL AS BIGINT) AS cut_at
  FROM s_in WHERE n = 1
  UNION ALL
  SELECT mmsi, n, CASE WHEN done THEN NULL ELSE since END, CASE WHEN done THEN 0 ELSE points END,
         CASE WHEN done THEN since END
  FROM (
    SELECT mmsi, n, since, points, points >= 6 AND (us - since) // 1000000 >= 1800 AS done
    FROM (
      SELECT r.mmsi, r.n, r.us,
             CASE WHEN NOT r.slow THEN NULL
                  WHEN r.gap_cut OR r.status_cut OR w.points = 0 THEN r.us ELSE w.since END AS since,
             CASE WHEN NOT r.slow THEN 0
                  WHEN r.gap_cut OR r.status_cut OR w.points = 0 THEN 1 ELSE w.points + 1 END AS points
      FROM s_walk w JOIN s_in r ON r.mmsi = w.mmsi AND r.n = w.n + 1))),
s_cuts AS (SELECT DISTINCT mmsi, cut_at AS us FROM s_walk WHERE cut_at IS NOT NULL),
s_flag AS (
  SELECT s_in.*, c.us IS NOT NULL AS port_call_cut,
         p_us IS NULL OR gap_cut OR status_cut OR c.us IS NOT NULL AS begins
  FROM s_in LEFT JOIN s_cuts c ON s_in.mmsi = c.mmsi AND s_in.us = c.us),
points AS (
  SELECT *, max(CASE WHEN begins THEN us END) OVER (PARTITION BY mmsi ORDER BY us) AS seg_us,
         CASE WHEN begins THEN 0.0::DOUBLE ELSE
           6371000.0::DOUBLE * 2 * atan2(
             sqrt(pow(sin(radians(lat - p_lat) / 2), 2)
                  + cos(radians(p_lat)) * cos(radians(lat)) * pow(sin(radians(lon - p_lon) / 2), 2)),
             sqrt(1 - (pow(sin(radians(lat - p_lat) / 2), 2)
                  + cos(radians(p_lat)) * cos(radians(lat)) * pow(sin(radians(lon - p_lon) / 2), 2)))) / 1852.0::DOUBLE
         END AS leg
  FROM s_flag)"""

TRACKS = """
tracks AS (
  SELECT mmsi, mmsi || '_' || (seg_us // 1000000) AS voyage_id, min(ts) AS start_time, max(ts) AS end_time,
         CAST(count(*) AS INTEGER) AS point_count,
         CAST(floor(sum(floor(CAST(sog AS DOUBLE))) / count(sog)) AS DOUBLE) AS avg_sog,
         round(avg(CAST(sog AS DOUBLE)), 4) AS avg_sog_exact,
         round(CAST(CAST(sum(leg) AS REAL) AS DOUBLE), 1) AS distance_nm,
         min(lon) AS min_lon, min(lat) AS min_lat, max(lon) AS max_lon, max(lat) AS max_lat,
         list({'lon': lon, 'lat': lat} ORDER BY us) AS path
  FROM points GROUP BY mmsi, seg_us HAVING count(*) >= 2)"""

ALL_TRACKS = f"WITH RECURSIVE {CLEAN}, {_thinned()}, {SEGMENTED}, {TRACKS}"
_TRACK_COLS = "* EXCLUDE (path)"
# Of the positions as they are stored, in milliseconds.
_STREAMED_TRACKS = f"""WITH RECURSIVE {CLEAN},
stored AS (SELECT * REPLACE (date_trunc('millisecond', ts) AS ts) FROM clean),
{_thinned('stored')}, {SEGMENTED}, {TRACKS} SELECT {_TRACK_COLS} FROM tracks"""

# A leg touches the closed box: clip the leg's parameter range [0, 1] against each side in turn.
_BOX = (9.0, 55.0, 9.2, 55.1)


def _clip(axis: str, low: float, high: float) -> tuple[str, str, str]:
    """(enter, leave, parallel leg inside) of a leg a→b along one axis."""
    d = f"(b_{axis} - a_{axis})"
    enter = f"CASE WHEN {d} = 0 THEN 0 ELSE least(({low} - a_{axis}) / {d}, ({high} - a_{axis}) / {d}) END"
    leave = f"CASE WHEN {d} = 0 THEN 1 ELSE greatest(({low} - a_{axis}) / {d}, ({high} - a_{axis}) / {d}) END"
    return enter, leave, f"({d} <> 0 OR a_{axis} BETWEEN {low} AND {high})"


_X, _Y = _clip("lon", _BOX[0], _BOX[2]), _clip("lat", _BOX[1], _BOX[3])
TOUCHING = f"""
legs AS (
  SELECT mmsi, seg_us, CAST(p_lon AS DOUBLE) AS a_lon, CAST(p_lat AS DOUBLE) AS a_lat, lon AS b_lon, lat AS b_lat
  FROM points WHERE NOT begins),
hits AS (
  SELECT DISTINCT mmsi, mmsi || '_' || (seg_us // 1000000) AS voyage_id FROM legs
  WHERE {_X[2]} AND {_Y[2]} AND greatest(0, {_X[0]}, {_Y[0]}) <= least(1, {_X[1]}, {_Y[1]}))"""

# --- input files ----------------------------------------------------------------------------------

SHOWN_TS = "CASE WHEN seq % 3 = 0 THEN ts ELSE date_trunc('second', ts) END"
TAG_TS = """CASE WHEN seq % 7 = 0 THEN TIMESTAMP '2024-01-01 00:00:00'
     WHEN seq % 2 = 0 THEN date_trunc('second', ts) ELSE date_trunc('millisecond', ts) END"""
SENT_POSITIONS = f"""
sent AS (
  SELECT mmsi, {TAG_TS} AS ts, round(lat * 600000) / 600000 AS lat, round(lon * 600000) / 600000 AS lon,
         {_f("CASE WHEN sog IS NULL THEN 102.3 ELSE floor(CAST(least(sog, 102.2::REAL) AS DOUBLE) * 10 + 0.5) / 10 END")}
           AS sog,
         {_f("floor(CAST(cog AS DOUBLE) * 10 + 0.5) / 10")} AS cog, heading,
         CASE WHEN msg_type <> 18 THEN nav_status END AS nav_status,
         CASE WHEN msg_type <> 18 THEN CAST(COALESCE(rot, -128) AS DOUBLE) END AS rot, msg_type, seq
  FROM raw)"""
SENT_COLS = "mmsi, ts, lat, lon, sog, cog, heading, nav_status, rot, msg_type"

FRAGMENTS = f"""
frag AS (
  SELECT CASE WHEN event_id % 11 = 0 THEN 1
              ELSE 2 + user_id % 2 + CASE WHEN event_id % 29 = 0 THEN 1 ELSE 0 END END AS total,
         1 + (event_id * 7 + event_id // 13) % 3 AS num, 'A|' || (user_id % 10) AS key, 'p' || event_id AS payload,
         {_EPOCH} + to_seconds(event_id) AS ts, event_id AS seq, event_id % 3 AS file
  FROM events),
parts AS (
  SELECT *, max(CASE WHEN num = 1 THEN seq END) OVER (PARTITION BY file, key ORDER BY seq) AS start
  FROM frag WHERE total <> 1),
grouped AS (
  SELECT p.*, s.total AS size, s.ts AS start_ts FROM parts p
  JOIN parts s ON s.file = p.file AND s.key = p.key AND s.seq = p.start
  WHERE p.num <= s.total),
running AS (
  SELECT *, len(list_distinct(list(num) OVER (PARTITION BY file, key, start ORDER BY seq))) AS seen FROM grouped),
done AS (
  SELECT file, key, start, min(seq) AS done FROM running WHERE num = total AND seen = size GROUP BY ALL),
newest AS (
  SELECT r.file, r.key, r.start, r.num, d.done, any_value(r.start_ts) AS ts, arg_max(r.payload, r.seq) AS payload
  FROM running r JOIN done d ON r.file = d.file AND r.key = d.key AND r.start = d.start
  WHERE r.seq <= d.done GROUP BY ALL)"""

_CATEGORY_OF = """CASE WHEN {c} IN (36, 37) THEN 'sailing_pleasure' WHEN {c} BETWEEN 70 AND 79 THEN 'cargo'
WHEN {c} BETWEEN 80 AND 89 THEN 'tanker' WHEN {c} BETWEEN 60 AND 69 THEN 'passenger'
WHEN {c} BETWEEN 30 AND 39 THEN 'fishing' WHEN {c} BETWEEN 50 AND 59 THEN 'special'
WHEN {c} BETWEEN 40 AND 49 THEN 'high_speed' ELSE 'other' END"""

# One decimal, half up (printf alone would round 43.25 to the even 43.2).
_COG_TEXT = "printf('%.1f', floor(CAST(p.cog AS DOUBLE) * 10 + 0.5) / 10) || '°'"
_SOG_TEXT = "printf('%.1f', floor(CAST(p.sog AS DOUBLE) * 10 + 0.5) / 10) || ' kn'"


_STATIC_MESSAGES = f"""WITH {STATIC}
    SELECT mmsi, CASE WHEN seq % 3 = 0 THEN imo END AS imo,
           CASE WHEN seq % 3 <> 1 THEN vessel_name END AS vessel_name, callsign,
           CASE seq % 3 WHEN 0 THEN 70 WHEN 1 THEN 36 END AS ship_type,
           CASE seq % 3 WHEN 0 THEN 'cargo' WHEN 1 THEN 'sailing_pleasure' END AS ship_type_desc,
           CASE WHEN seq % 3 <> 2 AND length_m > 0 THEN length_m END AS length_m,
           CASE WHEN seq % 3 = 0 THEN 9.0::DOUBLE END AS beam_m,
           CASE WHEN seq % 3 = 0 THEN 5.7::DOUBLE END AS draught_m, destination, last_seen
    FROM static"""


def oracle_sql() -> dict[str, str]:
    named_join = "FROM clean p LEFT JOIN named v ON p.mmsi = v.mmsi"
    return {
        "csv_positions": f"""WITH {RAW}
            SELECT mmsi, {SHOWN_TS} AS ts, lat, lon, {_f('sog')} AS sog, {_f('cog')} AS cog, heading,
                   CASE WHEN seq % 5 <> 0 THEN nav_status END AS nav_status, {_f('rot')} AS rot,
                   CASE WHEN seq % 2 = 1 THEN msg_type END AS msg_type
            FROM raw WHERE seq % 41 <> 0""",
        "csv_vessels": f"""WITH {STATIC}
            SELECT mmsi, imo, vessel_name, callsign, ship_type, ship_type_desc,
                   CASE WHEN seq % 3 = 2 THEN seq % 50 + 10.0 ELSE length_m END::DOUBLE AS length_m,
                   beam_m, draught_m, destination, last_seen
            FROM static""",
        "csv_counts": f"""WITH {RAW}, {STATIC},
            both_kinds AS (
              SELECT seq % 41 <> 0 AS good, false AS telling FROM raw UNION ALL SELECT true, true FROM static)
            SELECT count(*) AS rows, count(*) FILTER (good) AS positions, count(*) FILTER (telling) AS vessels,
                   count(*) FILTER (NOT good) AS skipped
            FROM both_kinds""",
        "nmea_counts": f"""WITH {RAW}, {STATIC}
            SELECT (SELECT count(*) FROM raw) + count(*) + count(*) FILTER (seq % 3 = 0) AS sentences, 0 AS skipped,
                   (SELECT count(*) FROM raw) + count(*) AS messages, (SELECT count(*) FROM raw) AS positions,
                   count(*) AS vessels
            FROM static""",
        "nmea_tag_time": f"""WITH {RAW}
            SELECT 1 AS total, 1 AS num, CASE WHEN seq % 2 = 0 THEN 'A|' ELSE 'B|' END AS key, {TAG_TS} AS ts,
                   count(*) AS n
            FROM raw GROUP BY ALL""",
        "nmea_assemble": f"""WITH {FRAGMENTS}
            SELECT payload, ts, seq FROM frag WHERE total = 1
            UNION ALL
            SELECT string_agg(payload, '' ORDER BY num), any_value(ts), done
            FROM newest GROUP BY file, key, start, done""",
        "nmea_decode_positions": f"WITH {RAW}, {SENT_POSITIONS} SELECT {SENT_COLS} FROM sent",
        "nmea_decode_static": _STATIC_MESSAGES,
        "first_lines": f"""WITH {RAW}, {SENT_POSITIONS}
            SELECT {SENT_COLS} FROM (SELECT * FROM sent ORDER BY seq LIMIT 500)""",
        "validate_reasons": f"""WITH {CHECKED}
            SELECT reason, count(*) AS rows FROM checked WHERE reason IS NOT NULL GROUP BY reason
            UNION ALL
            SELECT CASE WHEN nth = 1 THEN 'accepted' ELSE 'duplicate' END, count(*) FROM numbered GROUP BY 1""",
        "validation_statistics": f"""WITH {CHECKED}
            SELECT (SELECT count(*) FROM raw) AS total, (SELECT count(*) FROM numbered WHERE nth = 1) AS accepted,
                   count(*) FILTER (reason = 'mmsi') AS rejected_mmsi,
                   count(*) FILTER (reason = 'coords') AS rejected_coords,
                   count(*) FILTER (reason = 'null_island') AS rejected_null_island,
                   count(*) FILTER (reason = 'sog') AS rejected_sog,
                   (SELECT count(*) FROM numbered WHERE nth > 1) AS duplicates
            FROM checked""",
        "dedup_keep_first": f"WITH {CLEAN} SELECT {POSITION_VALUES}, seq FROM clean",
        "vessel_merge": f"WITH {MERGED} SELECT {VESSEL_COLS} FROM merged",
        "vessel_latest": f"WITH {STATIC} {_latest('static')}",
        "vessel_upsert": f"""WITH {MERGED}, {NAMED},
            both_sides AS (SELECT {VESSEL_COLS} FROM named UNION ALL SELECT {VESSEL_COLS} FROM merged)
            {_latest('both_sides')}""",
        "enrich_positions": f"""WITH {CLEAN}, {NAMED}
            SELECT p.mmsi, p.ts, v.vessel_name, v.ship_type, v.ship_type_desc, v.length_m {named_join}""",
        "vessel_details": f"""WITH {CLEAN}, {NAMED}, {MERGED}
            SELECT p.mmsi, p.ts, {_f('p.sog')} AS sog, m.imo, COALESCE(v.vessel_name, m.vessel_name) AS vessel_name,
                   m.callsign, COALESCE(v.ship_type, m.ship_type) AS ship_type,
                   COALESCE(v.ship_type_desc, m.ship_type_desc) AS ship_type_desc,
                   COALESCE(v.length_m, m.length_m) AS length_m, m.beam_m, m.draught_m, m.destination, m.last_seen
            {named_join} LEFT JOIN merged m ON p.mmsi = m.mmsi""",
        "positions_range": f"""WITH {CLEAN}, {NAMED},
            p AS (SELECT * FROM clean WHERE {_IN_BOX} AND {_IN_RANGE})
            SELECT {RESULT} FROM p LEFT JOIN named v ON p.mmsi = v.mmsi""",
        "positions_first_1000": f"""WITH {CLEAN}, {NAMED},
            p AS (SELECT * FROM clean ORDER BY mmsi, ts, msg_type, lon, lat LIMIT 1000)
            SELECT {RESULT} FROM p LEFT JOIN named v ON p.mmsi = v.mmsi""",
        "positions_at": _at(""),
        "positions_at_box": _at(f"AND {_IN_BOX}"),
        "positions_series": f"""WITH {CLEAN}, {NAMED},
            ticks AS (
              SELECT unnest(generate_series(TIMESTAMP '2024-01-01 20:00:00', TIMESTAMP '2024-01-02 08:00:00',
                                            INTERVAL 5 MINUTE)) AS at),
            ranked AS (
              SELECT t.at, c.*, row_number() OVER (PARTITION BY t.at, c.mmsi ORDER BY c.ts DESC) AS nth
              FROM ticks t JOIN clean c ON c.ts <= t.at AND c.ts >= t.at - INTERVAL 1 HOUR),
            p AS (SELECT * FROM ranked WHERE nth = 1)
            SELECT p.at, {RESULT} FROM p LEFT JOIN named v ON p.mmsi = v.mmsi""",
        "vessel_search": f"""WITH {NAMED}
            SELECT {VESSEL_COLS} FROM named WHERE upper(vessel_name) LIKE upper('%omer#00000_1%')""",
        "vessel_suggest": f"""WITH {NAMED}
            SELECT {VESSEL_COLS} FROM named WHERE upper(vessel_name) LIKE upper('%er#0000000%')
            ORDER BY vessel_name, mmsi LIMIT 8""",
        "downsample_10s": f"WITH RECURSIVE {CLEAN}, {_thinned()} SELECT mmsi, ts, lon, lat FROM thinned",
        "pre_downsample_60s": f"WITH RECURSIVE {CLEAN}, {PRE_THINNED} SELECT mmsi, ts, lon, lat, seq FROM pre",
        "segment_flags": f"""WITH RECURSIVE {CLEAN}, {_thinned()}, {SEGMENTED}
            SELECT mmsi, ts, gap_cut, status_cut, port_call_cut, {_EPOCH} + to_microseconds(seg_us) AS segment_start,
                   round(leg, 4) AS leg_nm
            FROM points""",
        "track_build": f"{ALL_TRACKS} SELECT {_TRACK_COLS} FROM tracks",
        "track_build_pre60": f"""WITH RECURSIVE {CLEAN}, {PRE_THINNED}, {_thinned('pre')}, {SEGMENTED}, {TRACKS}
            SELECT {_TRACK_COLS} FROM tracks""",
        "track_summary": f"""WITH RECURSIVE {CLEAN}, {_thinned()}, {SEGMENTED},
            sizes AS (SELECT count(*) AS n FROM points GROUP BY mmsi, seg_us)
            SELECT (SELECT count(*) FROM clean) AS input_positions,
                   (SELECT count(*) FROM clean) - (SELECT count(*) FROM thinned) AS downsampled_positions,
                   count(*) FILTER (n >= 2) AS tracks, count(*) FILTER (n = 1) AS skipped_single_point
            FROM sizes""",
        "tracks_bbox": f"{ALL_TRACKS}, {TOUCHING} SELECT mmsi, voyage_id, point_count FROM tracks JOIN hits USING (mmsi, voyage_id)",
        "tracks_geojson": f"""{ALL_TRACKS}
            SELECT mmsi, voyage_id, 'Feature' AS type, 'LineString' AS geometry_type,
                   '[' || list_aggregate(list_transform(path, lambda p: '[' || p.lon || ',' || p.lat || ']'),
                                         'string_agg', ',') || ']' AS coordinates,
                   strftime(start_time, '%Y-%m-%d %H:%M:%S') AS start_time, CAST(point_count AS VARCHAR) AS point_count,
                   CAST(avg_sog AS VARCHAR) AS avg_sog
            FROM tracks WHERE strftime(start_time, '%Y-%m') = '2024-01'""",
        "tracks_on_the_fly": f"""WITH RECURSIVE {CLEAN}, chosen AS (SELECT * FROM clean WHERE {_IN_RANGE}),
            {_thinned('chosen')}, {SEGMENTED}, {TRACKS} SELECT {_TRACK_COLS} FROM tracks""",
        "vessel_positions": f"""WITH {CLEAN}, {NAMED}, p AS (SELECT * FROM clean WHERE mmsi = 219000005)
            SELECT {RESULT} FROM p LEFT JOIN named v ON p.mmsi = v.mmsi""",
        "vessel_tracks": f"{ALL_TRACKS} SELECT {_TRACK_COLS} FROM tracks WHERE mmsi = 219000005",
        "chosen_tracks_on_the_fly": f"""WITH RECURSIVE {CLEAN},
            chosen AS (SELECT * FROM clean WHERE {_IN_RANGE} AND mmsi IN (219000003, 219000005, 219000011)),
            {_thinned('chosen')}, {SEGMENTED}, {TRACKS} SELECT {_TRACK_COLS} FROM tracks""",
        "vessel_record": f"WITH {NAMED} SELECT {VESSEL_COLS} FROM named WHERE mmsi = 219000005",
        "partition_bbox": f"""WITH {CLEAN}
            SELECT strftime(ts, '%Y-%m-%d') AS date, CAST(floor(lon + 180) AS INTEGER) AS cell_x,
                   CAST(floor(lat + 90) AS INTEGER) AS cell_y, count(*) AS rows, min(lon) AS min_lon,
                   min(lat) AS min_lat, max(lon) AS max_lon, max(lat) AS max_lat
            FROM clean GROUP BY 1, 2, 3""",
        "cell_prune": f"""WITH {CLEAN}
            SELECT mmsi, date_trunc('millisecond', ts) AS ts, lon, lat, CAST(floor(lon + 180) AS INTEGER) AS cell_x,
                   CAST(floor(lat + 90) AS INTEGER) AS cell_y
            FROM clean WHERE {_IN_BOX} AND {_IN_RANGE.replace('ts ', "date_trunc('millisecond', ts) ")}""",
        "positions_by_extents": f"""WITH {CLEAN}
            SELECT mmsi, date_trunc('millisecond', ts) AS ts, lon, lat
            FROM clean WHERE {_IN_BOX} AND {_IN_RANGE.replace('ts ', "date_trunc('millisecond', ts) ")}""",
        "stored_positions": f"""WITH {CLEAN},
            second AS (SELECT * FROM clean WHERE ts >= TIMESTAMP '2024-01-02' AND (sog IS NULL OR sog < 50)),
            placed AS (SELECT *, CAST(ts AS DATE) AS d, floor((lon + 180) / 5) AS x, floor((lat + 90) / 5) AS y FROM clean),
            touched AS (
              SELECT DISTINCT CAST(ts AS DATE) AS d, floor((lon + 180) / 5) AS x, floor((lat + 90) / 5) AS y FROM second),
            left_over AS (SELECT placed.* EXCLUDE (d, x, y) FROM placed ANTI JOIN touched USING (d, x, y)),
            stored AS (SELECT * FROM second UNION ALL SELECT * FROM left_over)
            SELECT {POSITION_VALUES.replace('mmsi, ts,', "mmsi, date_trunc('millisecond', ts) AS ts,", 1)},
                   strftime(ts, '%Y-%m-%d') AS date
            FROM stored""",
        "stored_tracks": f"""{ALL_TRACKS}
            SELECT mmsi, voyage_id, point_count, date_trunc('millisecond', start_time) AS start_time,
                   date_trunc('millisecond', end_time) AS end_time, strftime(start_time, '%Y-%m') AS date
            FROM tracks""",
        "stored_vessels": f"""WITH {MERGED}, {NAMED},
            both_sides AS (SELECT {VESSEL_COLS} FROM named UNION ALL SELECT {VESSEL_COLS} FROM merged)
            {_latest('both_sides')}""",
        "compacted_positions": f"WITH {CLEAN} SELECT mmsi, date_trunc('millisecond', ts) AS ts, lon, lat FROM clean",
        "backfilled_positions": f"""WITH {CLEAN}
            SELECT mmsi, date_trunc('millisecond', ts) AS ts, lon, lat,
                   CAST(floor((lon + 180) / 5) AS INTEGER) AS cell_x, CAST(floor((lat + 90) / 5) AS INTEGER) AS cell_y
            FROM clean""",
        "sql_views": f"""{ALL_TRACKS}, {NAMED},
            built AS (SELECT mmsi, count(*) AS tracks FROM tracks GROUP BY mmsi)
            SELECT p.mmsi, any_value(v.vessel_name) AS vessel_name, count(*) AS positions, any_value(b.tracks) AS tracks
            {named_join} LEFT JOIN built b ON p.mmsi = b.mmsi GROUP BY p.mmsi""",
        "wkb_round_trip": f"WITH {CLEAN} SELECT mmsi, ts, lon, lat FROM clean",
        "import_summary": f"""{ALL_TRACKS}, {NAMED}
            SELECT (SELECT count(*) FROM clean) AS positions_written,
                   (SELECT count(DISTINCT r.mmsi) FROM raw r JOIN named v ON r.mmsi = v.mmsi) AS vessel_records,
                   count(*) AS tracks_built
            FROM tracks""",
        "accumulated_positions": f"WITH {CLEAN} SELECT {_STORED_VALUES} FROM clean",
        "accumulated_vessels": _ACCUMULATED_VESSELS,
        "accumulated_tracks": f"""{ALL_TRACKS}
            SELECT mmsi, voyage_id, point_count, date_trunc('millisecond', start_time) AS start_time,
                   date_trunc('millisecond', end_time) AS end_time, strftime(start_time, '%Y-%m') AS date
            FROM tracks""",
        "streamed_positions": _STREAMED_POSITIONS,
        "streamed_positions_batched": _STREAMED_POSITIONS,
        "streamed_vessels": _STREAMED_VESSELS,
        "streamed_vessels_batched": _STREAMED_VESSELS,
        "archived_csv_positions": f"WITH {CLEAN} SELECT {_STORED_VALUES} FROM clean",
        "archived_sentences": f"WITH {RAW}, {SENT_POSITIONS} SELECT {SENT_COLS} FROM sent",
        "mixed_folder_positions": f"WITH {CLEAN} SELECT {_STORED_VALUES} FROM clean",
        "streamed_tracks": _STREAMED_TRACKS,
        "streamed_tracks_batched": _STREAMED_TRACKS,
        "streamed_sentences": _STATIC_MESSAGES,
        "streamed_sentences_batched": _STATIC_MESSAGES,
        "ship_class": f"""WITH {CLEAN}, {NAMED}
            SELECT p.mmsi, p.ts,
                   CASE WHEN v.ship_type IS NOT NULL THEN {_CATEGORY_OF.format(c='v.ship_type')} ELSE 'other' END AS category,
                   CASE WHEN v.length_m IS NULL THEN 'unknown' WHEN v.length_m < 50 THEN 'small'
                        WHEN v.length_m < 200 THEN 'medium' ELSE 'large' END AS length_class,
                   round(CAST(p.cog AS DOUBLE), 4) AS bearing,
                   CASE p.nav_status WHEN 0 THEN 'Under way (engine)' WHEN 5 THEN 'Moored' END AS status,
                   COALESCE(v.vessel_name, 'MMSI ' || p.mmsi) AS name,
                   concat_ws(' · ', v.ship_type_desc, {_SOG_TEXT}) AS summary, {_COG_TEXT} AS course, {_WKT} AS wkt
            {named_join}""",
    }
