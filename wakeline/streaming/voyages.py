"""Voyage tracks of a stream of positions, kept up to date with state per vessel.

A stateful operator holds for each vessel the newest second it has taken (repeats and older reports stand out by it), the
last kept point, the start of the open segment, and the points of the open slow run, whose count decides on a port
call. With these the thinning and cutting rules go on where the batch before ended: work and state follow the batch, not the
history. A port call moves the points of its run (at most half an hour of them) to a new segment; they are given out again.

What the operator gives out is written by batch below the checkpoint folder, each batch to a folder of its own, so one that is run
again replaces what it had written. ``track_points`` takes the newest version of each point.

A report that is older than what its vessel's state has taken cannot be taken in order. It is looked up in the store: most are
repeats. If the store lacks it, the vessel is marked, and its points are from then on worked out anew from its stored positions,
in every batch that brings it rows. So no report is too late, and tracks are those of the stored positions, however the files
are cut into batches. A clock that runs ahead concerns its own vessel only, as nothing rests on a common watermark.

When a vessel has been silent for ``silence_ms`` by the clock, a timer marks its open voyage as ended.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from wakeline import schema as S
from wakeline.functions.scalars import MICROS, from_micros, micros, to_millis
from wakeline.functions.spatial import haversine_nm
from wakeline.operators.tracks import track_points as points_of
from wakeline.operators.tracks import tracks_from_points
from wakeline.operators.validate import accepted
from wakeline.session import configure, stage
from wakeline.sources import csv as C
from wakeline.sources.tables import Store, add_positions, not_stored, read_positions, table_exists

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PAYLOAD = [f for f in S.POSITIONS if f.name not in ("mmsi", "ts")]
PAYLOAD_SCHEMA = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in PAYLOAD)
ORDER = ["at", "file", "block", "row"]
INPUT = "mmsi long, us long, lat double, lon double, sog float, nav_status int, payload string, at long, file string, block long, row long"
OUTPUT = "kind string, mmsi long, us long, segment_us long, lat double, lon double, from_lat double, from_lon double, payload string"
OUT = Row(*[column.split()[0] for column in OUTPUT.split(", ")])
POINTS = "mmsi long, ts timestamp, lon double, lat double, sog float, segment_start timestamp, leg_nm double, batch long"
SILENCE_MS = S.GAP_SEC * 1000


class Voyage:
    """The state of one vessel, and the rules on its next report."""

    def __init__(self, saved: str | None):
        # A state of before the timer was kept with it ends here; then the timers are listed once.
        self.last, self.segment, self.run, self.timer = ([*json.loads(saved), None] if saved else [None, None, [], None])[:4]
        self.points: dict[int, tuple] = {}  # given out in this batch: the newest version of each

    def saved(self) -> str:
        return json.dumps([self.last, self.segment, self.run, self.timer])

    def take(self, us: int, lat: float, lon: float, slow: bool, still: bool, payload: str) -> None:
        before = self.last
        if before and us - before[0] < S.DOWNSAMPLE_SEC * MICROS:
            return
        origin = (None, None)
        if not before or (us - before[0]) // MICROS > S.GAP_SEC or still != before[3]:
            self.segment, self.run = us, []
        else:
            origin = before[1:3]
        self.last = [us, lat, lon, still]
        self._give(us, lat, lon, *origin, payload)
        if not slow:
            self.run = []
            return
        self.run.append([us, lat, lon, *origin, payload])
        since = self.run[0][0]
        if len(self.run) >= S.PORT_CALL_POINTS and us - since >= S.PORT_CALL_SEC * MICROS:
            if since != self.segment:
                self.segment = since
                self.run[0][3:5] = None, None
                for point in self.run:
                    self._give(*point)
            self.run = []

    def _give(self, us, lat, lon, from_lat, from_lon, payload) -> None:
        self.points[us] = ("point", us, self.segment, lat, lon, from_lat, from_lon, payload)


def _first_reports(rows: Iterable[Row]) -> list[tuple[int, Row]]:
    """The earliest report of every second, by time; repeats go as the rows come."""
    held = {}
    for row in rows:
        second, order = row.us // MICROS, (row.at, row.file, row.block, row.row)
        if second not in held or order < held[second][0]:
            held[second] = order, row
    return [(second, held[second][1]) for second in sorted(held)]


class VoyageProcessor(StatefulProcessor):
    """Positions of a vessel to new positions, late ones, and points with their segment.

    Most vessels have few reports in a batch, so the rows are handled as they come: a table of a library for each vessel, and
    calls to the state beyond one read, one write and its timer's, would cost more than the rules.
    """

    def __init__(self, silence_ms: int = SILENCE_MS):
        self.silence_ms = silence_ms

    def init(self, handle) -> None:
        self._handle = handle
        self._vessel = handle.getValueState("vessel", "newest long, voyage string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        (mmsi,) = key
        newest, saved = self._vessel.get() or (None, None)
        voyage = Voyage(saved)
        fresh = False
        for second, row in _first_reports(rows):
            late = newest is not None and second <= newest
            yield OUT("late" if late else "position", mmsi, row.us, None, None, None, None, None, row.payload)
            if not late:
                fresh = True
                slow = row.sog is not None and row.sog < S.PORT_CALL_SOG
                voyage.take(row.us, row.lat, row.lon, slow, row.nav_status in S.STATIONARY_STATUS, row.payload)
        if fresh:
            timers = list(self._handle.listTimers()) if saved and voyage.timer is None else [voyage.timer] * bool(saved)
            for timer in timers:
                self._handle.deleteTimer(timer)
            voyage.timer = timerValues.getCurrentProcessingTimeInMs() + self.silence_ms
            self._handle.registerTimer(voyage.timer)
            self._vessel.update((second, voyage.saved()))
        for kind, us, segment, *rest in voyage.points.values():
            yield OUT(kind, mmsi, us, segment, *rest)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        (mmsi,) = key
        known = self._vessel.get()
        if known:
            voyage = Voyage(known[1])
            yield OUT("silent", mmsi, voyage.last[0], voyage.segment, None, None, None, None, None)

    def close(self) -> None:
        pass


def _numbered(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the place of each row in its task, in the order of the file."""
    at = 0
    for batch in batches:
        rows = pa.array(np.arange(at, at + batch.num_rows))
        at += batch.num_rows
        yield pa.RecordBatch.from_arrays([*batch.columns, rows], [*batch.schema.names, "row"])


def _reports(parsed: DataFrame) -> DataFrame:
    rows = accepted(C.positions_of(parsed)).withColumn("ts", to_millis(F.col("ts")))
    rows = rows.select(
        "mmsi", micros(F.col("ts")).alias("us"), "lat", "lon", "sog", "nav_status",
        F.to_json(F.struct(*[f.name for f in PAYLOAD])).alias("payload"),
        F.unix_micros("seq.at").alias("at"), "seq.file", "seq.block",
    )
    return rows.mapInArrow(_numbered, INPUT)


def voyage_stream(parsed: DataFrame, silence_ms: int = SILENCE_MS) -> DataFrame:
    """Parsed rows of a stream to new and late positions and points with their segment (``OUTPUT``)."""
    spark = parsed.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    by_vessel = _reports(parsed).groupBy("mmsi")
    return by_vessel.transformWithState(VoyageProcessor(silence_ms), OUTPUT, "Append", "ProcessingTime")


def _positions(out: DataFrame, kinds: list[str]) -> DataFrame:
    rows = out.where(F.col("kind").isin(kinds)).select("mmsi", from_micros(F.col("us")).alias("ts"), F.from_json("payload", PAYLOAD_SCHEMA).alias("p"))
    return rows.select("mmsi", "ts", "p.*").select(*S.POSITION_COLS)


def _write(rows: DataFrame, path: str, number: int) -> None:
    rows.write.mode("overwrite").parquet(f"{path}/batch={number}")


def _late_vessels(out: DataFrame, store: Store, path: str, number: int) -> DataFrame:
    """Vessels with reports, in this batch or before, that came too late to be taken in order and that the store lacked.

    Written before the positions are, and not again when the batch is repeated: then the store has them.
    """
    spark = out.sparkSession
    if not table_exists(spark, f"{path}/batch={number}"):
        late = _positions(out, ["late"]).withColumn("date", F.to_date("ts"))
        if table_exists(spark, store.positions):
            late = not_stored(late, store)
        _write(late.select("mmsi").distinct(), path, number)
    return spark.read.schema("mmsi long, batch long").parquet(path).where(F.col("batch") <= number).select("mmsi").distinct()


def import_voyages(
    parsed: DataFrame,
    store: Store,
    checkpoint: str,
    available_now: bool = True,
    cell_deg: float | None = None,
    silence_ms: int = SILENCE_MS,
) -> StreamingQuery:
    """Start the import of positions and tracks of a stream (``incremental.stream_csv``).

    Positions go to the store as in ``incremental.import_stream``; points with their segments go below ``checkpoint``, where
    ``track_points``, ``tracks`` and ``ended_voyages`` read them. A batch that is repeated gives the same result.
    """
    trigger = {"availableNow": True} if available_now else {"processingTime": "1 minute"}
    spark = configure(parsed.sparkSession)

    def add_batch(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        out = stage(batch, "voyages")
        marked = stage(_late_vessels(out, store, f"{checkpoint}/late-vessels", number), "marked")
        add_positions(_positions(out, ["position", "late"]), store, cell_deg)
        leg = F.when(F.col("from_lat").isNull(), 0.0).otherwise(haversine_nm(F.col("from_lat"), F.col("from_lon"), F.col("lat"), F.col("lon")))
        points = out.where("kind = 'point'").select(
            "mmsi", from_micros(F.col("us")).alias("ts"), "lon", "lat",
            F.from_json("payload", PAYLOAD_SCHEMA)["sog"].alias("sog"),
            from_micros(F.col("segment_us")).alias("segment_start"), leg.alias("leg_nm"),
        )
        _write(points, f"{checkpoint}/points", number)
        _write(out.where("kind = 'silent'").select("mmsi", "us", "segment_us"), f"{checkpoint}/silent", number)
        concerned = stage(marked.join(out.where("kind <> 'silent'").select("mmsi").distinct(), "mmsi", "left_semi"), "concerned")
        if not concerned.isEmpty():
            history = read_positions(spark, store).join(concerned, "mmsi", "left_semi").select(*S.POSITION_COLS)
            anew = points_of(history).select(*[c for c in points.columns])
            _write(anew, f"{checkpoint}/points-anew", number)

    # Timers by the clock call for batches without data, of which a run over the available files would see no end.
    key = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, str(not available_now).lower())
    writer = (
        voyage_stream(parsed, silence_ms)
        .writeStream.foreachBatch(add_batch)
        .outputMode("append")
        .option("checkpointLocation", f"{checkpoint}/voyages")
        .trigger(**trigger)
    )
    try:
        return writer.start()  # a query keeps the settings it starts with
    finally:
        spark.conf.set(key, before)


def track_points(spark: SparkSession, checkpoint: str) -> DataFrame:
    """Every kept point with its segment, as it stands: mmsi, ts, lon, lat, sog, segment_start, leg_nm."""
    value = ["lon", "lat", "sog", "segment_start", "leg_nm"]
    given = spark.read.schema(POINTS).parquet(f"{checkpoint}/points")
    newest = given.groupBy("mmsi", "ts").agg(F.max_by(F.struct(*value), "batch").alias("p")).select("mmsi", "ts", "p.*")
    if not table_exists(spark, f"{checkpoint}/points-anew"):
        return newest
    anew = spark.read.schema(POINTS).parquet(f"{checkpoint}/points-anew")
    last = anew.groupBy("mmsi").agg(F.max("batch").alias("batch"))
    anew = anew.join(last, ["mmsi", "batch"]).drop("batch")
    return newest.join(last.select("mmsi"), "mmsi", "left_anti").unionByName(anew.select(*newest.columns))


def tracks(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The tracks of all positions so far, open voyages included."""
    return tracks_from_points(track_points(spark, checkpoint))


def ended_voyages(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(mmsi, start_time): voyages that a timer ended, and that no later report went on with."""
    silent = spark.read.schema("mmsi long, us long, segment_us long, batch long").parquet(f"{checkpoint}/silent")
    silent = silent.select("mmsi", from_micros(F.col("us")).alias("until"), from_micros(F.col("segment_us")).alias("start_time")).distinct()
    newest = track_points(spark, checkpoint).groupBy("mmsi", F.col("segment_start").alias("start_time")).agg(F.max("ts").alias("until"))
    return silent.join(newest, ["mmsi", "start_time", "until"]).select("mmsi", "start_time")
