"""Registered queries: every operator over the plain test tables. The same results as SQL: ``oracles.py``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wakeline import schema as S
from wakeline.functions import scalars as X
from wakeline.functions import spatial as G
from wakeline.functions import wkb as B
from wakeline.operators import downsample as DS
from wakeline.operators import tracks as TR
from wakeline.operators import validate as V
from wakeline.operators import vessels as VE
from wakeline.plans import derived as D
from wakeline.plans import ingest as I
from wakeline.plans import queries as Q
from wakeline.plans import rendering as R
from wakeline.session import configure, scratch_path, stage
from wakeline.sources import archive_source as A
from wakeline.sources import csv as C
from wakeline.sources import extents as E
from wakeline.sources import files as FI
from wakeline.sources import sentences as N
from wakeline.sources import tables as TB
from wakeline.streaming import incremental as ST
from wakeline.streaming import logs as LO
from wakeline.streaming import voyages as VO

Query = Callable[[SparkSession, str], DataFrame]

BOX = G.Envelope(9.5, 54.75, 13.25, 56.5)
AT = "2024-01-02T09:30:00"
RANGE = {"start": "2024-01-01T18:00:00", "end": "2024-01-02T12:00:00"}
SERIES = ("2024-01-01T20:00:00", "2024-01-02T08:00:00")
FALLBACK = "2024-01-01 00:00:00"


def plain(df: DataFrame) -> DataFrame:
    """Times without zone and floats as doubles with four decimals, for comparison with other engines."""
    out = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, T.TimestampType):
            c = c.cast("timestamp_ntz")
        elif isinstance(f.dataType, T.FloatType):
            c = F.round(c.cast("double"), 4)
        out.append(c.alias(f.name))
    return df.select(*out)


def _clean(spark: SparkSession, sf: str) -> DataFrame:
    return V.clean(D.raw_positions(spark, sf))


def _tracks(spark: SparkSession, sf: str) -> DataFrame:
    return TR.build_tracks(_clean(spark, sf))


def _arrival_block():
    return X.floor_div(F.col("seq"), D.SEQ_BLOCK)


# --- sources --------------------------------------------------------------------------------------


def csv_positions(spark, sf):
    return C.positions_of(C.read_csv(spark, R.position_csv_files(spark, sf))).drop("seq")


def csv_vessels(spark, sf):
    return C.vessel_reports_of(C.read_csv(spark, R.static_csv_files(spark, sf))).drop("seq")


def csv_counts(spark, sf):
    return C.parse_counts(C.read_all_rows(spark, [*R.position_csv_files(spark, sf), R.static_csv_files(spark, sf)]))


def nmea_counts(spark, sf):
    logs = [R.position_sentences(spark, sf), R.static_sentences(spark, sf)]
    return N.parse_counts(FI.text_lines(spark, logs), FALLBACK)


def nmea_tag_time(spark, sf):
    lines = FI.text_lines(spark, R.position_sentences(spark, sf))
    return N.sentence_fields(lines, FALLBACK).groupBy("total", "num", "key", "ts").agg(F.count("*").alias("n"))


def _fragments(spark, sf):
    """Sentences with parts missing, repeated, out of order and of differing totals."""
    e = D.table(spark, sf, "events").select("event_id", "user_id")
    eid = F.col("event_id")
    return e.select(
        F.when(eid % 11 == 0, 1).otherwise(2 + F.col("user_id") % 2 + F.when(eid % 29 == 0, 1).otherwise(0))
        .cast("int")
        .alias("total"),
        (1 + (eid * 7 + F.floor(eid / 13)) % 3).cast("int").alias("num"),
        F.concat(F.lit("A|"), (F.col("user_id") % 10).cast("string")).alias("key"),
        F.concat(F.lit("p"), eid.cast("string")).alias("payload"),
        X.from_micros(eid * 1_000_000).alias("ts"),
        eid.alias("seq"),
        (eid % 3).alias("file"),
    )


def nmea_assemble(spark, sf):
    return N.assemble(_fragments(spark, sf), F.col("file"), X.floor_div(F.col("seq"), 256))


def nmea_decode_positions(spark, sf):
    messages = N.read_sentences(spark, R.position_sentences(spark, sf), FALLBACK)
    return N.decode_positions(messages).drop("seq")


def archived_csv_positions(spark, sf):
    """Daily archives read by the data source, a partition for each entry."""
    rows = V.clean(C.positions_of(A.read_csv(spark, R.daily_archives(spark, sf))))
    return rows.withColumn("ts", X.to_millis(F.col("ts"))).drop("seq")


def archived_sentences(spark, sf):
    lines = A.with_order(A.read_archives(spark, R.sentence_archives(spark, sf), "nmea"))
    return N.decode_positions(N.assemble(N.sentence_fields(lines, FALLBACK))).drop("seq")


def mixed_folder_positions(spark, sf):
    """A folder of daily archives, routed by name and entry, imported into a store."""
    store, folder = _store(spark), R.daily_archives(spark, sf)
    names = [f"{folder}/{FI.DAILY_NAME.format(date=d)}" for d in ("2024-01-01", "2024-01-02")]
    for path, files in ((folder, None), (None, names)):  # the daily drop again: nothing is added twice
        I.import_files(spark, path or files, store, I.ImportOptions(position_mode="append", vessel_mode="upsert"))
    return TB.read_positions(spark, store).select(*S.POSITION_COLS)


def nmea_decode_static(spark, sf):
    messages = N.read_sentences(spark, R.static_sentences(spark, sf), FALLBACK)
    return N.decode_static(messages).drop("seq")


def first_lines(spark, sf):
    """Sampling operator: the first 500 lines of a log in arrival order."""
    lines = FI.text_lines(spark, R.position_sentences(spark, sf))
    sample = FI.first_lines(lines, 500)
    return N.decode_positions(N.assemble(N.sentence_fields(sample, FALLBACK))).drop("seq")


# --- validation and vessels -----------------------------------------------------------------------


def validate_reasons(spark, sf):
    return V.reason_counts(D.raw_positions(spark, sf))


def validation_statistics(spark, sf):
    return V.validation_statistics(D.raw_positions(spark, sf))


def dedup_keep_first(spark, sf):
    return _clean(spark, sf)


def vessel_merge(spark, sf):
    return VE.merge_reports(D.static_reports(spark, sf))


def vessel_latest(spark, sf):
    return VE.latest_record(D.static_reports(spark, sf).drop("seq"))


def vessel_upsert(spark, sf):
    return VE.upsert(D.named_vessels(spark, sf), VE.merge_reports(D.static_reports(spark, sf)))


def enrich_positions(spark, sf):
    vessels = D.named_vessels(spark, sf)
    return VE.enrich(_clean(spark, sf), vessels).select("mmsi", "ts", *VE.ENRICH_COLS)


def vessel_details(spark, sf):
    """Positions that already carry a name and type, joined with merged vessel records."""
    carrying = VE.enrich(_clean(spark, sf).select("mmsi", "ts", "sog"), D.named_vessels(spark, sf))
    merged = VE.merge_reports(D.static_reports(spark, sf))
    return VE.vessel_details(carrying, merged)


# --- queries --------------------------------------------------------------------------------------


def positions_range(spark, sf):
    return Q.positions_range(_clean(spark, sf), D.named_vessels(spark, sf), limit=None, box=BOX, **RANGE)


def positions_first_1000(spark, sf):
    """The default result size of the positions query, over the whole table."""
    return Q.positions_range(_clean(spark, sf), D.named_vessels(spark, sf))


def positions_at(spark, sf):
    return Q.positions_at(_clean(spark, sf), D.named_vessels(spark, sf), AT, limit=None)


def positions_at_box(spark, sf):
    return Q.positions_at(_clean(spark, sf), D.named_vessels(spark, sf), AT, box=BOX, limit=None)


def positions_series(spark, sf):
    return Q.positions_series(_clean(spark, sf), D.named_vessels(spark, sf), *SERIES)


def vessel_search(spark, sf):
    return Q.find_vessels(D.named_vessels(spark, sf), name="omer#00000_1")


def vessel_suggest(spark, sf):
    return Q.suggest_vessels(D.named_vessels(spark, sf), "er#0000000")


# --- tracks ---------------------------------------------------------------------------------------


def downsample_10s(spark, sf):
    return DS.downsample(_clean(spark, sf).select("mmsi", "ts", "lon", "lat"))


def pre_downsample_60s(spark, sf):
    rows = _clean(spark, sf).select("mmsi", "ts", "lon", "lat", "seq")
    return DS.pre_downsample(rows, _arrival_block())


def segment_flags(spark, sf):
    points = TR.track_points(_clean(spark, sf))
    return points.select(
        "mmsi", "ts", "gap_cut", "status_cut", "port_call_cut", "segment_start", F.round("leg_nm", 4).alias("leg_nm")
    )


def _track_columns(tracks):
    return tracks.select(
        "mmsi", "voyage_id", "start_time", "end_time", "point_count", "avg_sog",
        F.round("avg_sog_exact", 4).alias("avg_sog_exact"),
        F.round(F.col("distance_nm").cast("double"), 1).alias("distance_nm"),
        "min_lon", "min_lat", "max_lon", "max_lat",
    )


def track_build(spark, sf):
    return _track_columns(_tracks(spark, sf))


def track_build_pre60(spark, sf):
    """Tracks after thinning to 60 seconds in arrival order, as the memory-bound import builds them."""
    tracks = TR.build_tracks(
        _clean(spark, sf), arrival_block=_arrival_block(), pre_interval=S.PRE_DOWNSAMPLE_SEC
    )
    return _track_columns(tracks)


def track_summary(spark, sf):
    return TR.track_summary(_clean(spark, sf))


def tracks_bbox(spark, sf):
    hits = Q.filter_tracks(_tracks(spark, sf), box=G.Envelope(9.0, 55.0, 9.2, 55.1))
    return hits.select("mmsi", "voyage_id", "point_count")


def tracks_geojson(spark, sf):
    features = Q.track_features(_tracks(spark, sf), start="2024-01-01", end="2024-01-31")
    read = {
        "type": "$.type", "geometry_type": "$.geometry.type", "coordinates": "$.geometry.coordinates",
        "start_time": "$.properties.start_time", "point_count": "$.properties.point_count",
        "avg_sog": "$.properties.avg_sog",
    }
    return features.select(
        "mmsi", "voyage_id", *[F.get_json_object("feature", p).alias(c) for c, p in read.items()]
    )


def tracks_on_the_fly(spark, sf):
    """Tracks of the time range built from raw positions without stored tracks."""
    return _track_columns(Q.tracks_on_the_fly(D.raw_positions(spark, sf), **RANGE))


# Vessels that a user picks on the map.
CHOSEN = [219000003, 219000005, 219000011]


def vessel_positions(spark, sf):
    """All positions of one chosen vessel."""
    return Q.positions_range(_clean(spark, sf), D.named_vessels(spark, sf), limit=None, mmsi=CHOSEN[1])


def vessel_tracks(spark, sf):
    """The tracks of one chosen vessel."""
    return _track_columns(Q.filter_tracks(_tracks(spark, sf), mmsi=CHOSEN[1], start="2024-01-01"))


def chosen_tracks_on_the_fly(spark, sf):
    return _track_columns(Q.tracks_on_the_fly(D.raw_positions(spark, sf), mmsis=CHOSEN, **RANGE))


def vessel_record(spark, sf):
    return Q.find_vessels(D.named_vessels(spark, sf), mmsi=CHOSEN[1])


# --- tables ---------------------------------------------------------------------------------------


def _store(spark) -> TB.Store:
    return TB.Store(scratch_path(spark, "store"))


def partition_bbox(spark, sf):
    return TB.partition_boxes(TB.with_position_keys(_clean(spark, sf), 1.0)).withColumn(
        "date", F.col("date").cast("string")
    )


def cell_prune(spark, sf):
    """Written table, read back for a box: folders outside the box and the time range are not listed."""
    store = _store(spark)
    TB.write_positions(_clean(spark, sf), store, 1.0)
    hits = Q.filter_positions(TB.read_positions(spark, store), BOX, **RANGE)
    return hits.select("mmsi", "ts", "lon", "lat", "cell_x", "cell_y")


def positions_by_extents(spark, sf):
    """A box from a store whose catalog of file extents knows the first of two deliveries; files of the other are all read."""
    store, rows = _store(spark), stage(_clean(spark, sf), "rows")
    TB.write_positions(rows.filter("mmsi % 2 = 0"), store)
    E.update(spark, store)
    TB.write_positions(rows.filter("mmsi % 2 = 1"), store, mode="append")
    return Q.stored_positions_in(spark, store, box=BOX, **RANGE).select("mmsi", "ts", "lon", "lat")


def stored_positions(spark, sf):
    """Written twice: the second write replaces the partitions it touches and no others."""
    store = _store(spark)
    rows = stage(_clean(spark, sf), "rows")
    TB.write_positions(rows, store)
    TB.write_positions(rows.filter(F.col("ts") >= X.at("2024-01-02")).filter("sog is null or sog < 50"), store)
    return TB.read_positions(spark, store).select(*S.POSITION_COLS, F.col("date").cast("string").alias("date"))


def stored_tracks(spark, sf):
    store = _store(spark)
    TB.write_tracks(_tracks(spark, sf), store)
    return TB.read_tracks(spark, store).select("mmsi", "voyage_id", "point_count", "start_time", "end_time", "date")


def stored_vessels(spark, sf):
    """Replaced, then upserted with merged static reports."""
    store = _store(spark)
    TB.write_vessels(D.named_vessels(spark, sf), store)
    TB.write_vessels(VE.merge_reports(D.static_reports(spark, sf)), store, "upsert")
    return TB.read_vessels(spark, store)


def sql_views(spark, sf):
    """SQL over the registered views of the stored tables."""
    store = _store(spark)
    rows = stage(_clean(spark, sf), "rows")
    TB.write_positions(rows, store)
    TB.write_vessels(D.named_vessels(spark, sf), store)
    TB.write_tracks(TR.build_tracks(rows), store)
    TB.register_views(spark, store)
    return spark.sql(
        """SELECT p.mmsi, max(v.vessel_name) AS vessel_name, count(*) AS positions, max(t.tracks) AS tracks
           FROM ais_positions p
           LEFT JOIN vessel_metadata v ON p.mmsi = v.mmsi
           LEFT JOIN (SELECT mmsi, count(*) AS tracks FROM ais_tracks GROUP BY mmsi) t ON p.mmsi = t.mmsi
           GROUP BY p.mmsi"""
    )


def wkb_round_trip(spark, sf):
    rows = TB.positions_with_wkb(_clean(spark, sf).select("mmsi", "ts", "lon", "lat"))
    return B.decode_points(rows)


def compacted_positions(spark, sf):
    """Appended in two halves (two sets of files), then one date compacted: the rows stay the same."""
    store = _store(spark)
    rows = stage(_clean(spark, sf), "rows")
    TB.write_positions(rows.filter("mmsi % 2 = 0"), store)
    TB.write_positions(rows.filter("mmsi % 2 = 1"), store, mode="append")
    TB.compact_positions(spark, store, "2024-01-02")
    return TB.read_positions(spark, store).select("mmsi", "ts", "lon", "lat")


def backfilled_positions(spark, sf):
    """A table of the older layout (WKB points below date and cell name) brought into the new layout."""
    old, store = scratch_path(spark, "old"), _store(spark)
    rows = TB.positions_with_wkb(_clean(spark, sf).drop("seq")).withColumnRenamed("ts", "timestamp_us")
    keyed = rows.withColumn("date", F.to_date("timestamp_us")).withColumn("h3_r3", F.lit("831f05fffffffff"))
    keyed.write.partitionBy("date", "h3_r3").parquet(old)
    TB.backfill(spark, old, store)
    return TB.read_positions(spark, store).select("mmsi", "ts", "lon", "lat", "cell_x", "cell_y")


def import_summary(spark, sf):
    """A whole CSV import; the counts it reports."""
    done = I.import_files(spark, R.import_csv_files(spark, sf), _store(spark))
    return spark.createDataFrame(
        [(done.positions_written, done.vessel_records, done.tracks_built)],
        "positions_written bigint, vessel_records bigint, tracks_built bigint",
    )


def _accumulated(spark, sf) -> TB.Store:
    """Two overlapping deliveries of one month, imported one after the other."""
    store = _store(spark)
    options = I.ImportOptions(position_mode="append", vessel_mode="upsert")
    for delivery in R.overlapping_csv_files(spark, sf):
        I.import_files(spark, delivery, store, options)
    return store


def accumulated_positions(spark, sf):
    return TB.read_positions(spark, _accumulated(spark, sf)).select(*S.POSITION_COLS)


def accumulated_vessels(spark, sf):
    return TB.read_vessels(spark, _accumulated(spark, sf))


def accumulated_tracks(spark, sf):
    tracks = TB.read_tracks(spark, _accumulated(spark, sf))
    return tracks.select("mmsi", "voyage_id", "point_count", "start_time", "end_time", "date")


def _streamed(spark, sf, files_per_batch: int) -> TB.Store:
    store = _store(spark)
    parsed = ST.stream_csv(spark, R.landing_csv_files(spark, sf), R.DAILY_HEADER, files_per_batch)
    ST.import_stream(parsed, store, scratch_path(spark, "stream")).awaitTermination()
    return store


def streamed_positions(spark, sf):
    """Files read as a stream, one in a batch, with late days and a clock that runs ahead."""
    return TB.read_positions(spark, _streamed(spark, sf, 1)).select(*S.POSITION_COLS)


def streamed_positions_batched(spark, sf):
    """The same in batches of up to 100 files: the result does not depend on the batches."""
    return TB.read_positions(spark, _streamed(spark, sf, 100)).select(*S.POSITION_COLS)


def streamed_vessels(spark, sf):
    return TB.read_vessels(spark, _streamed(spark, sf, 1))


def streamed_vessels_batched(spark, sf):
    return TB.read_vessels(spark, _streamed(spark, sf, 100))


def _streamed_tracks(spark, sf, files_per_batch: int) -> DataFrame:
    state = scratch_path(spark, "voyages")
    landing = R.landing_csv_files(spark, sf)
    for _ in range(2):  # the second start finds nothing new, whatever the state says
        parsed = ST.stream_csv(spark, landing, R.DAILY_HEADER, files_per_batch)
        VO.import_voyages(parsed, TB.Store(f"{state}/store"), state).awaitTermination()
    return _track_columns(VO.tracks(spark, state))


def streamed_tracks(spark, sf):
    """Tracks kept up to date by state per vessel, one file in a batch, with repeats of all days at the end."""
    return _streamed_tracks(spark, sf, 1)


def streamed_tracks_batched(spark, sf):
    """The same in batches of up to 100 files."""
    return _streamed_tracks(spark, sf, 100)


def _streamed_messages(spark, sf, files_per_batch: int) -> DataFrame:
    state, landing = scratch_path(spark, "logs"), R.landing_logs(spark, sf)
    for _ in range(2):  # the second start finds nothing new
        lines = LO.stream_lines(spark, landing, files_per_batch)
        LO.write_messages(lines, f"{state}/messages", state, r"^(.*)/[^/]*$", FALLBACK).awaitTermination()
    return N.decode_static(LO.read_messages(spark, f"{state}/messages")).drop("seq")


def streamed_sentences(spark, sf):
    """Pieces of a sentence log as a stream, one file in a batch; parts of some messages lie in different batches."""
    return _streamed_messages(spark, sf, 1)


def streamed_sentences_batched(spark, sf):
    """The same in batches of up to 100 files."""
    return _streamed_messages(spark, sf, 100)


# --- display values -------------------------------------------------------------------------------


def ship_class(spark, sf):
    rows = VE.enrich(_clean(spark, sf), D.named_vessels(spark, sf))
    return rows.select(
        "mmsi",
        "ts",
        X.ship_category(F.col("ship_type"), F.col("ship_type_desc")).alias("category"),
        X.length_class(F.col("length_m")).alias("length_class"),
        F.round(X.display_bearing(F.col("cog"), F.col("heading")), 4).alias("bearing"),
        X.nav_status_label(F.col("nav_status")).alias("status"),
        X.display_name(F.col("vessel_name"), F.col("mmsi")).alias("name"),
        X.summary_label(F.col("ship_type_desc"), F.col("sog")).alias("summary"),
        X.cog_label(F.col("cog")).alias("course"),
        G.point_wkt(F.col("lon"), F.col("lat")).alias("wkt"),
    )


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        csv_positions, csv_vessels, csv_counts, nmea_tag_time, nmea_counts, nmea_assemble, nmea_decode_positions, nmea_decode_static,
        archived_csv_positions, archived_sentences, mixed_folder_positions,
        first_lines, validate_reasons, validation_statistics, dedup_keep_first, vessel_merge, vessel_latest,
        vessel_upsert, enrich_positions, vessel_details, positions_range, positions_first_1000, positions_at,
        positions_at_box, positions_series, vessel_search, vessel_suggest, downsample_10s, pre_downsample_60s,
        segment_flags, track_build, track_build_pre60, track_summary, tracks_bbox, tracks_geojson,
        tracks_on_the_fly, vessel_positions, vessel_tracks, chosen_tracks_on_the_fly, vessel_record, partition_bbox, cell_prune, positions_by_extents, stored_positions, stored_tracks, stored_vessels, sql_views,
        wkb_round_trip, compacted_positions, backfilled_positions, import_summary, accumulated_positions,
        accumulated_vessels, accumulated_tracks, streamed_positions, streamed_positions_batched, streamed_vessels,
        streamed_vessels_batched, streamed_tracks, streamed_tracks_batched,
        streamed_sentences, streamed_sentences_batched, ship_class,
    )
}


def registered() -> dict[str, Query]:
    def prepared(query: Query) -> Query:
        return lambda spark, sf_dir: plain(query(configure(spark), sf_dir))

    return {name: prepared(query) for name, query in QUERIES.items()}
