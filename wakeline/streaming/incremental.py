"""Continuous import of a landing folder with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wakeline import schema as S
from wakeline.operators.validate import clean
from wakeline.session import configure, stage
from wakeline.sources import csv as C
from wakeline.sources.tables import Store, add_positions, read_vessels, table_exists, write_vessels


def stream_csv(spark: SparkSession, landing: str, header: str, files_per_batch: int = 100) -> DataFrame:
    """Parsed rows of CSV files with one known header, as they arrive in ``landing``.

    ``seq`` orders rows by their file's modification time, name and place. ``files_per_batch`` only sets how much is
    read at once; the stored result is the same for any value.
    """
    configure(spark)
    fields = C.header_fields(header)
    place = C.resolve(fields)
    if place is None:
        raise ValueError("the header lacks a required column")
    layout = ", ".join(f"c{i} string" for i in range(len(fields)))
    raw = (
        spark.readStream.options(**C.OPTIONS, header="true")
        .option("maxFilesPerTrigger", files_per_batch)
        .schema(layout)
        .csv(landing)
    )
    return C.good_rows(C.parse(raw.select("*", file_place().alias("_file")), place, F.col("_file")))


def file_place() -> Column:
    """What orders the rows of a stream of files: modification time, path and place in the file."""
    return F.struct(
        F.col("_metadata.file_modification_time").alias("at"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
    )


def in_arrival_order(batch: DataFrame) -> DataFrame:
    """A batch with the row number added to ``seq``. A file's rows lie in one partition in their order."""
    row = F.struct("seq.at", "seq.file", "seq.block", F.monotonically_increasing_id().alias("row"))
    return batch.withColumn("seq", row)


def _field_state(rows: DataFrame) -> DataFrame:
    """Per vessel and field the newest value with its order key, as (mmsi, struct columns)."""
    values = [*S.VESSEL_FIELDS, "last_seen"]
    return rows.select(
        "mmsi", *[F.when(F.col(c).isNotNull(), F.struct(F.col("seq").alias("order"), F.col(c).alias("value"))).alias(c) for c in values]
    )


def merge_states(states: DataFrame) -> DataFrame:
    """Field states of any number of batches, merged: the same for any grouping of the reports."""
    fields = [c for c in states.columns if c != "mmsi"]
    return states.groupBy("mmsi").agg(*[F.max_by(c, F.col(f"{c}.order")).alias(c) for c in fields])


def records_of(state: DataFrame) -> DataFrame:
    return state.select("mmsi", *[F.col(f"{c}.value").alias(c) for c in S.VESSEL_COLS if c != "mmsi"])


def import_stream(
    parsed: DataFrame,
    store: Store,
    checkpoint: str,
    available_now: bool = True,
    cell_deg: float | None = None,
) -> StreamingQuery:
    """Start the import: per batch, positions the store lacks are added and vessel records are brought up to date.

    The earliest report of a vessel's second stays, whenever and in whatever batch repeats arrive; no report is too late.
    A vessel's fields each keep their newest value over all batches: values and order keys lie below ``checkpoint``
    in two tables used in turn, so a batch that is run again starts from the state before it. Both parts give the
    same result when a batch is repeated, and files may also be imported into the same store by ``import_files``. The
    stream's record of a vessel replaces a stored one; other vessels stay. Tracks are built from the stored
    positions when asked for (``plans.queries.tracks_on_the_fly``).
    """

    def read(batch: DataFrame, number: int) -> tuple[DataFrame, DataFrame]:
        rows = stage(in_arrival_order(batch), "batch")
        return C.positions_of(rows), C.vessel_reports_of(rows)

    return start_import(parsed, read, store, checkpoint, available_now, cell_deg)


def start_import(
    arriving: DataFrame,
    read: Callable[[DataFrame, int], tuple[DataFrame, DataFrame]],
    store: Store,
    checkpoint: str,
    available_now: bool,
    cell_deg: float | None,
) -> StreamingQuery:
    """Start a stream that stores what ``read`` makes of a batch and its number: positions and static reports, with ``seq``."""
    trigger = {"availableNow": True} if available_now else {"processingTime": "1 minute"}

    def add_batch(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        positions, reports = read(batch, number)
        add_positions(clean(positions), store, cell_deg)
        state = merge_states(_field_state(reports))
        before, after = (f"{checkpoint}/vessel-fields/{n % 2}" for n in (number - 1, number))
        if number > 0 and table_exists(spark, before):
            known = spark.read.schema(state.schema).parquet(before)
            state = merge_states(known.unionByName(state))
        state.write.mode("overwrite").parquet(after)
        records = records_of(spark.read.schema(state.schema).parquet(after))
        if table_exists(spark, store.vessels):
            others = read_vessels(spark, store).join(records.select("mmsi"), "mmsi", "left_anti")
            records = records.unionByName(others)
        write_vessels(records, store)

    return (
        arriving.writeStream.foreachBatch(add_batch)
        .option("checkpointLocation", f"{checkpoint}/import")
        .trigger(**trigger)
        .start()
    )
