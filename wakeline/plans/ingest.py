"""Import of files into the stored tables."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeline import schema as S
from wakeline.operators.tracks import build_tracks
from wakeline.operators.validate import clean, validation_statistics
from wakeline.operators.vessels import merge_reports
from wakeline.session import configure, stage
from wakeline.sources import csv as C
from wakeline.sources import sentences as N
from wakeline.sources import tables as T
from wakeline.sources.files import route


@dataclass(frozen=True)
class ImportSummary:
    positions_written: int
    vessel_records: int
    tracks_built: int
    duration_ms: int


@dataclass(frozen=True)
class ImportOptions:
    """How to import.

    ``position_mode``: ``overwrite`` replaces the partitions and months that the files touch; ``append`` adds the
    positions the store does not hold yet and builds the tracks of the vessels concerned anew from all their
    stored positions. ``vessel_mode``: replace or upsert. ``pre_interval``: seconds of thinning in arrival order,
    or None; stored positions have no arrival order, so it cannot go with ``append``. ``cell_deg``: the cell size
    of a new store. ``line_limit``: read that many first lines of every file, headers included; 0 means all.
    """

    vessel_mode: str = "replace"
    pre_interval: int | None = None
    cell_deg: float | None = None
    position_mode: str = "overwrite"
    fallback: str | None = None
    line_limit: int = 0


def import_files(
    spark: SparkSession, paths: str | list[str], store: T.Store, options: ImportOptions = ImportOptions()
) -> ImportSummary:
    """Import CSV files, sentence logs and archives of either; the format follows the file names."""
    configure(spark)
    started = time.monotonic()
    positions, reports = read_any(spark, paths, options.fallback, options.line_limit)
    return _import(positions, reports, store, options, started, F.struct("seq.file", "seq.block"))


def read_any(
    spark: SparkSession, paths: str | list[str], fallback: str | None = None, line_limit: int = 0
) -> tuple[DataFrame, DataFrame]:
    """(positions, static reports) of all files, both with ``seq``; nothing is validated yet."""
    fallback = fallback or time.strftime("%Y-%m-%d 00:00:00", time.gmtime())
    positions, reports = [], []
    for (fmt, archived), files in route(spark, paths).items():
        if fmt == "csv":
            # One pass over the text; positions and metadata are read from the typed copy.
            read = C.read_csv_archives if archived else C.read_csv
            parsed = stage(read(spark, files, line_limit), "parsed")
            positions.append(C.positions_of(parsed))
            reports.append(C.vessel_reports_of(parsed))
        else:
            read = N.read_sentence_archives if archived else N.read_sentences
            messages = stage(read(spark, files, fallback, line_limit), "messages")
            positions.append(N.decode_positions(messages))
            reports.append(N.decode_static(messages))
    if not positions:
        raise FileNotFoundError(f"no input files below {paths}")
    return _union(positions), _union(reports)


def _union(parts: list[DataFrame]) -> DataFrame:
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def import_rows(
    positions: DataFrame,
    reports: DataFrame,
    store: T.Store,
    options: ImportOptions = ImportOptions(),
    arrival_block: Column | None = None,
) -> ImportSummary:
    """Import rows that are already typed and carry ``seq``."""
    return _import(positions, reports, store, options, time.monotonic(), arrival_block)


def _import(positions, reports, store, options, started, arrival_block) -> ImportSummary:
    if options.position_mode == "append":
        if options.pre_interval is not None:
            raise ValueError("pre_interval cannot be used with position_mode='append'")
        written, built = add_to_store(clean(positions), store, options.cell_deg)
        vessels = T.write_vessels(merge_reports(reports), store, options.vessel_mode)
        return ImportSummary(written, vessels, built, round((time.monotonic() - started) * 1000))
    valid = stage(clean(positions), "valid")
    written = T.write_positions(valid, store, options.cell_deg, options.position_mode)
    vessels = T.write_vessels(merge_reports(reports), store, options.vessel_mode)
    tracks = build_tracks(valid, arrival_block=arrival_block, pre_interval=options.pre_interval)
    built = T.write_tracks(tracks, store)
    return ImportSummary(written, vessels, built, round((time.monotonic() - started) * 1000))


def add_to_store(valid: DataFrame, store: T.Store, cell_deg: float | None = None) -> tuple[int, int]:
    """Add positions that the store lacks; rebuild the tracks of their vessels. Returns (positions, tracks)."""
    spark = valid.sparkSession
    fresh = T.add_positions(valid, store, cell_deg)
    vessels = stage(fresh.select("mmsi").distinct(), "touched")
    history = T.read_positions(spark, store).join(vessels, "mmsi", "left_semi")
    tracks = stage(build_tracks(history.select(*S.POSITION_COLS)), "rebuilt")
    T.replace_tracks(tracks, vessels, store)
    return fresh.count(), tracks.count()


def import_statistics(spark: SparkSession, paths: str | list[str], fallback: str | None = None) -> DataFrame:
    """Validation statistics of the files without writing anything."""
    return validation_statistics(read_any(spark, paths, fallback)[0])
