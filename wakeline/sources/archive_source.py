"""A Spark data source for daily ZIP archives: ``spark.read.format("ship_archives")`` and ``spark.readStream``.

Every entry of the wanted format is a partition of its own, planned from the archives' directories, which alone are read for it. Rows
are lines: file, entry, date (of the archive's name, else null), line_no, value. Nothing is unpacked to disk.

Options: ``path`` (a folder, or archives parted by commas), ``entries`` (``csv`` or ``nmea``), ``since`` and ``until`` (days; archives of
other days, or whose name has none, are not opened), ``lines`` (of each entry, from its start). With ``pushdown``
and the session's ``spark.sql.python.filterPushdown.enabled``, conditions on ``date`` and ``line_no`` do the same; Spark 4.1 then gives
all scans of one loaded frame the conditions of the last, so a frame must not be used twice in a query with different ones. The driver and the tasks
open the archives as files, so they have to lie on a mount all of them share; ``files.archive_lines`` reads from other stores.

As a stream, archives are taken in the order of their modification time and name; the offset is the last one taken, so each is read
once. One that is put in place later with an older time than the last offset is not seen: move archives into place, don't back-date them.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from datetime import date

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as D
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from wakeline.sources import csv as C
from wakeline.sources.files import BLOCK_LINES, CSV_ENDINGS, DAILY_NAME, SENTENCE_ENDINGS

FORMAT = "ship_archives"
SCHEMA = "file string, entry string, date date, line_no long, value string"
_DAILY = re.compile(re.escape(DAILY_NAME).replace(re.escape("{date}"), r"(\d{4}-\d{2}-\d{2})"))
_ARROW = pa.schema([("file", pa.string()), ("entry", pa.string()), ("date", pa.date32()), ("line_no", pa.int64()), ("value", pa.string())])
BATCH = 10_000


def date_of(path: str) -> date | None:
    """The day in an archive's name."""
    found = _DAILY.fullmatch(path.rsplit("/", 1)[-1])
    try:
        return date.fromisoformat(found[1]) if found else None
    except ValueError:
        return None


@dataclass
class EntryPartition(D.InputPartition):
    file: str
    entry: str
    lines: int | None  # how many are wanted; None for all

    def __post_init__(self) -> None:
        super().__init__(self.file)


def _archives(options: dict) -> list[tuple[int, str]]:
    """(modification time, path) of the archives, in this order."""
    from pyarrow import fs

    found = []
    for path in filter(None, (p.strip() for p in options.get("path", "").split(","))):
        system, place = fs.LocalFileSystem(), re.sub(r"^file:(//)?(?=/)", "", path)
        info = system.get_file_info(place)
        inside = system.get_file_info(fs.FileSelector(place, recursive=True)) if info.type == fs.FileType.Directory else [info]
        found += [(i.mtime_ns or 0, i.path) for i in inside if i.type == fs.FileType.File and i.path.lower().endswith(".zip")]
    return sorted(found)


def _entries(paths: Iterable[str], options: dict, lines: int | None = None) -> list[EntryPartition]:
    endings = CSV_ENDINGS if options.get("entries", "csv") == "csv" else SENTENCE_ENDINGS
    planned = []
    for path in paths:
        with open(path, "rb") as raw, zipfile.ZipFile(raw) as archive:  # the directory at its end
            names = [e.filename for e in archive.infolist() if not e.is_dir() and e.filename.lower().endswith(endings)]
        planned += [EntryPartition(path, name, lines) for name in names]
    return planned


def _lines(partition: EntryPartition) -> Iterator[pa.RecordBatch]:
    day = date_of(partition.file)
    with open(partition.file, "rb") as raw, zipfile.ZipFile(raw) as archive, archive.open(partition.entry) as entry:
        first, values = 0, []

        def batch() -> pa.RecordBatch:
            n = len(values)
            columns = [[partition.file] * n, [partition.entry] * n, [day] * n, range(first, first + n), values]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW)], schema=_ARROW)

        for line in io.TextIOWrapper(entry, encoding="utf-8", errors="replace"):
            if partition.lines is not None and first + len(values) >= partition.lines:
                break
            values.append(line.rstrip("\n"))
            if len(values) == BATCH:
                yield batch()
                first, values = first + BATCH, []
        if values:
            yield batch()


class ArchiveReader(D.DataSourceReader):
    def __init__(self, options: dict):
        self.options, self.tests = options, []
        self.lines = int(options["lines"]) if "lines" in options else None
        for option, test in (("since", lambda a, b: a >= b), ("until", lambda a, b: a <= b)):
            if option in options:
                self.tests.append((test, date.fromisoformat(options[option])))

    def _wanted(self, path: str) -> bool:
        day = date_of(path)
        return all(day is not None and test(day, value) for test, value in self.tests)

    def partitions(self) -> list[EntryPartition]:
        planned = _entries((p for _, p in _archives(self.options) if self._wanted(p)), self.options, self.lines)
        return planned or [EntryPartition("", "", 0)]

    def read(self, partition: EntryPartition) -> Iterator[pa.RecordBatch]:
        return _lines(partition) if partition.file else iter(())


class PushingReader(ArchiveReader):
    """Takes the query's own conditions, too."""

    def pushFilters(self, filters: list[D.Filter]) -> Iterable[D.Filter]:  # noqa: N802
        """Filters only narrow what is planned; Spark still applies all of them."""
        compare = {
            D.EqualTo: lambda a, b: a == b,
            D.GreaterThan: lambda a, b: a > b,
            D.GreaterThanOrEqual: lambda a, b: a >= b,
            D.LessThan: lambda a, b: a < b,
            D.LessThanOrEqual: lambda a, b: a <= b,
            D.In: lambda a, b: a in b,
        }
        for f in filters:
            column, value = getattr(f, "attribute", ()), getattr(f, "value", None)
            if column == ("date",) and type(f) in compare:
                self.tests.append((compare[type(f)], value))
            elif column == ("line_no",) and isinstance(value, int):
                end = {D.EqualTo: value + 1, D.LessThan: value, D.LessThanOrEqual: value + 1}.get(type(f))
                if end is not None:
                    self.lines = max(end, 0) if self.lines is None else min(self.lines, max(end, 0))
            yield f


class ArchiveStreamReader(D.DataSourceStreamReader):
    def __init__(self, options: dict):
        self.options = options

    def initialOffset(self) -> dict:  # noqa: N802
        return {"time": -1, "file": ""}

    def latestOffset(self) -> dict:  # noqa: N802
        there = _archives(self.options)
        return {"time": there[-1][0], "file": there[-1][1]} if there else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[EntryPartition]:
        after, until = ((o["time"], o["file"]) for o in (start, end))
        return _entries((p for t, p in _archives(self.options) if after < (t, p) <= until), self.options) or [EntryPartition("", "", 0)]

    def read(self, partition: EntryPartition) -> Iterator[pa.RecordBatch]:
        return _lines(partition) if partition.file else iter(())


class ArchiveSource(D.DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> ArchiveReader:
        pushing = self.options.get("pushdown", "false").lower() == "true"
        return (PushingReader if pushing else ArchiveReader)(dict(self.options))

    def streamReader(self, schema: StructType) -> ArchiveStreamReader:  # noqa: N802
        return ArchiveStreamReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ArchiveSource)


def read_archives(spark: SparkSession, path: str, entries: str = "csv", **options: str | int) -> DataFrame:
    """Lines of the archives below ``path`` (``SCHEMA``); ``options`` are ``since``, ``until`` and ``lines``."""
    register(spark)
    return spark.read.format(FORMAT).option("entries", entries).options(**options).load(path)


def read_csv(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """Parsed rows of the CSV entries of archives. Headers are read from the entries' first lines only."""
    heads, lines = (read_archives(spark, path, **options, **first) for first in ({"lines": 1}, {}))
    return C.parse_lines(spark, with_order(lines), with_order(heads))


def with_order(lines: DataFrame) -> DataFrame:
    """(value, seq) as the other line readers give them; the order is that of the archives' names and entries."""
    place = F.struct(
        F.concat_ws("!", "file", "entry").alias("file"), F.expr(f"line_no div {BLOCK_LINES}").alias("block"), F.col("line_no").alias("row")
    )
    return lines.select("value", place.alias("seq"))
