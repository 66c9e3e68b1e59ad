"""Delimited vessel reports: header resolution, row parsing, metadata rows."""

from __future__ import annotations

import csv as textcsv
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeline import schema as S
from wakeline.functions import scalars as X
from wakeline.sources.files import archive_lines, file_order, first_lines_by_file, header_lines, list_files

# Quotes may enclose a field and are doubled inside it; a record is always one line.
OPTIONS = {
    "quote": '"',
    "escape": '"',
    "mode": "PERMISSIVE",
    "multiLine": "false",
    "ignoreLeadingWhiteSpace": "true",
    "ignoreTrailingWhiteSpace": "true",
}

PARSED_COLS = S.POSITION_COLS + [c for c in S.VESSEL_COLS if c not in ("mmsi", "last_seen")] + ["seq"]


def header_fields(header: str) -> list[str]:
    cells = next(textcsv.reader([header.strip()]), [])
    return [re.sub(r"^#\s*", "", c.strip()).lower() for c in cells]


def resolve(fields: list[str]) -> dict[str, int] | None:
    """Place of each known field in the header; None if a required field is missing.

    Of several names of one field the first listed wins; of equal header names the last column.
    """
    place = {name: i for i, name in enumerate(fields)}
    found = {}
    for field, names in S.CSV_NAMES.items():
        hit = next((n for n in names if n in place), None)
        if hit is not None:
            found[field] = place[hit]
    return found if all(f in found for f in S.CSV_REQUIRED) else None


def read_csv(spark: SparkSession, paths: str | list[str], line_limit: int = 0) -> DataFrame:
    """All good rows of the CSV files, with position and metadata columns and ``seq``.

    A file without the required columns gives no rows; a row whose required values do not parse is dropped.
    ``line_limit`` reads that many first lines of each file, its header included.
    """
    return good_rows(read_all_rows(spark, paths, line_limit))


def read_all_rows(spark: SparkSession, paths: str | list[str], line_limit: int = 0) -> DataFrame:
    """The same with the bad rows still in.

    Files may have different headers: one scan per distinct header.
    """
    by_header: dict[str, list[str]] = {}
    for path, header in header_lines(spark, list_files(spark, paths)):
        by_header.setdefault(header, []).append(path)
    scans = []
    for header, files in by_header.items():
        fields = header_fields(header)
        place = resolve(fields)
        if place is not None and line_limit != 1:
            layout = ", ".join(f"c{i} string" for i in range(len(fields)))
            raw = spark.read.options(**OPTIONS, header="true").schema(layout).csv(files)
            rows = first_lines_by_file(raw.select("*", file_order().alias("seq")), max(line_limit - 1, 0))
            scans.append(parse(rows, place, F.col("seq")))
    return _union(spark, scans)


def read_csv_archives(spark: SparkSession, paths: str | list[str], line_limit: int = 0) -> DataFrame:
    """The same for ZIP archives that hold a CSV entry each."""
    return good_rows(_archive_rows(spark, first_lines_by_file(archive_lines(spark, paths, "csv"), line_limit)))


def parse_lines(spark: SparkSession, lines: DataFrame, heads: DataFrame | None = None) -> DataFrame:
    """Parsed rows of CSV lines (value, seq) of any files, the line of row 0 being a file's header.

    ``heads`` holds at least these first lines, where they can be had without reading all.
    """
    return good_rows(_archive_rows(spark, lines, heads))


def _archive_rows(spark: SparkSession, lines: DataFrame, heads: DataFrame | None = None) -> DataFrame:
    headers = (lines if heads is None else heads).filter("seq.block = 0 and seq.row = 0").select(F.col("seq.file").alias("_file"), F.col("value").alias("_header"))
    rows = lines.filter((F.col("seq.row") > 0) & (X.strip(F.col("value")) != ""))
    rows = rows.join(headers, F.col("seq.file") == F.col("_file"))
    scans = []
    for (header,) in headers.select("_header").distinct().collect():
        fields = header_fields(header)
        place = resolve(fields)
        if place is not None:
            layout = ", ".join(f"c{i} string" for i in range(len(fields)))
            own = rows.filter(F.col("_header") == header)
            raw = own.select(F.from_csv("value", layout, OPTIONS).alias("_r"), "seq").select("_r.*", "seq")
            scans.append(parse(raw, place, F.col("seq")))
    return _union(spark, scans)


def _union(spark: SparkSession, scans: list[DataFrame]) -> DataFrame:
    if scans:
        return reduce(DataFrame.unionByName, scans)
    order = "struct<file:string,block:bigint,row:bigint>"
    types = {f.name: f.dataType.simpleString() for f in [*S.POSITIONS, *S.VESSELS]}
    return spark.createDataFrame([], ", ".join(f"{c} {types.get(c, order)}" for c in PARSED_COLS))


def parse(raw: DataFrame, place: dict[str, int], order: Column) -> DataFrame:
    """Text columns ``c0, c1, …`` to typed position and metadata columns."""

    def cell(field: str) -> Column:
        if field not in place:
            return F.lit("")
        # A short row reads as if its missing cells were empty.
        return F.coalesce(X.strip(F.col(f"c{place[field]}")), F.lit(""))

    def number(field: str) -> Column:
        return X.lenient_float(cell(field))

    ship_type_text = X.null_if_unknown(cell("ship_type_raw"))
    ship_type = ship_type_text.try_cast("double")
    values = {
        "mmsi": X.strict_long(cell("mmsi")),
        "ts": X.parse_time(cell("ts")),
        "lat": X.strict_double(cell("lat")),
        "lon": X.strict_double(cell("lon")),
        "sog": number("sog"),
        "cog": number("cog"),
        "heading": X.lenient_int(cell("heading")),
        "nav_status": X.lenient_int(cell("nav_status")),
        "rot": number("rot"),
        "msg_type": X.lenient_int(cell("msg_type")),
        "imo": X.strict_long(X.null_if_unknown(cell("imo"))),
        "vessel_name": X.null_if_unknown(cell("vessel_name")),
        "callsign": X.null_if_unknown(cell("callsign")),
        "ship_type": ship_type.try_cast("int"),
        "ship_type_desc": F.when(ship_type.isNull(), ship_type_text),
        "length_m": F.coalesce(number("length_m"), number("dim_a") + number("dim_b")),
        "beam_m": F.coalesce(number("beam_m"), number("dim_c") + number("dim_d")),
        "draught_m": number("draught_m"),
        "destination": X.null_if_unknown(cell("destination")),
        "seq": order,
    }
    if not any(f in place for f in S.CSV_METADATA):
        for c in S.VESSEL_FIELDS:
            values[c] = F.lit(None).cast(S.VESSELS[c].dataType)
    return raw.select(*[values[c].alias(c) for c in PARSED_COLS])


def good_rows(parsed: DataFrame) -> DataFrame:
    return parsed.dropna(subset=S.CSV_REQUIRED)


def parse_counts(parsed: DataFrame) -> DataFrame:
    """One row over ``read_all_rows``: rows, positions, vessel reports, skipped rows."""
    good = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in S.CSV_REQUIRED])
    return parsed.agg(
        F.count("*").alias("rows"),
        F.count_if(good).alias("positions"),
        F.count_if(good & _tells_something()).alias("vessels"),
        F.count_if(~good).alias("skipped"),
    )


def positions_of(parsed: DataFrame) -> DataFrame:
    return parsed.select(*S.POSITION_COLS, "seq")


def _tells_something() -> Column:
    """A numeric ship type alone does not count."""
    return F.coalesce(*[F.col(c).cast("string") for c in S.VESSEL_FIELDS if c != "ship_type"]).isNotNull()


def vessel_reports_of(parsed: DataFrame) -> DataFrame:
    """Rows that say something about the vessel."""
    return parsed.filter(_tells_something()).select("mmsi", *S.VESSEL_FIELDS, F.col("ts").alias("last_seen"), "seq")
