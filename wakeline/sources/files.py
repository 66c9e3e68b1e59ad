"""Finding input files, telling their format, and reading archives line by line."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wakeline.session import stage

# File name endings of the two input formats, and the name of a daily archive.
CSV_ENDINGS = (".csv",)
SENTENCE_ENDINGS = (".nmea", ".aivdm", ".txt")
DAILY_NAME = "aisdk-{date}.zip"

# Lines of an archive are numbered in blocks of this many, which are the unit of spreading them.
BLOCK_LINES = 100_000
LINES = "file string, block bigint, line_no bigint, value string"


def list_files(spark: SparkSession, paths: str | list[str]) -> list[str]:
    """Files below the given paths. Only names are read: the content column is pruned."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths).select("path")
    return sorted(r.path for r in found.collect())


def daily_files(landing: str, dates: Iterable[str]) -> list[str]:
    return [f"{landing.rstrip('/')}/{DAILY_NAME.format(date=d)}" for d in dates]


def format_of(name: str) -> str:
    """``csv`` or ``nmea`` by file name; every ending but ``.csv`` counts as a sentence log."""
    return "csv" if name.lower().endswith(CSV_ENDINGS) else "nmea"


def route(spark: SparkSession, paths: str | list[str]) -> dict[tuple[str, bool], list[str]]:
    """Group files by (format, is archive). An archive whose own name does not tell is opened."""
    groups: dict[tuple[str, bool], list[str]] = {}
    unnamed = []
    for path in list_files(spark, paths):
        if not path.lower().endswith(".zip"):
            groups.setdefault((format_of(path), False), []).append(path)
        elif format_of(path[: -len(".zip")]) == "csv":
            groups.setdefault(("csv", True), []).append(path)
        else:
            unnamed.append(path)
    if unnamed:
        for row in _first_entry_names(spark, unnamed).collect():
            groups.setdefault((format_of(row.entry), True), []).append(row.file)
    return groups


def file_order() -> Column:
    """Arrival order of a row of a text or CSV scan. Attach it right on the scan, before any shuffle."""
    return F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )


def text_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Lines of plain text files with their arrival order ``seq`` (file, block, row)."""
    return spark.read.text(paths).select("value", file_order().alias("seq"))


def first_lines(lines: DataFrame, n: int) -> DataFrame:
    """The first ``n`` lines in arrival order, header and blank lines included; 0 means all."""
    return lines.orderBy("seq").limit(n) if n > 0 else lines


def first_lines_by_file(rows: DataFrame, n: int) -> DataFrame:
    """The first ``n`` rows of every file in arrival order; 0 means all.

    Each task passes on its first ``n`` rows of a file only, so what meets in one task is ``n`` rows for each split.
    """
    if n <= 0:
        return rows
    place = F.row_number().over(Window.partitionBy("seq.file").orderBy("seq"))
    return rows.withColumn("_place", place).filter(F.col("_place") <= n).drop("_place")


def header_lines(spark: SparkSession, files: list[str]) -> list[tuple[str, str]]:
    """(file, first line) of all files that are not empty, in one job whose tasks open the files' beginnings.

    A store that only Spark's readers know is read through them, each file's first line as a job of its own.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            found = []
            for path in batch.column(0).to_pylist():
                try:
                    system, place = fs.FileSystem.from_uri(path)
                except (pa.ArrowInvalid, ImportError):
                    found.append((path, None, False))
                    continue
                with system.open_input_stream(place) as raw:
                    line = io.TextIOWrapper(io.BufferedReader(raw), encoding="utf-8", errors="replace").readline()
                found.append((path, line.rstrip("\r\n") if line else None, True))
            names = ["file", "value", "reached"]
            kinds = [pa.string(), pa.string(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], names)

    paths = spark.createDataFrame([(f,) for f in files], "path string")
    tasks = max(1, min(len(files), 256))
    rows = paths.repartition(tasks).mapInArrow(read, "file string, value string, reached boolean").collect()
    lines = {r.file: r.value for r in rows if r.reached}
    for path in (r.file for r in rows if not r.reached):
        first = spark.read.text(path).head()
        lines[path] = first.value if first is not None else None
    return [(f, lines[f]) for f in files if lines[f] is not None]


def archive_lines(spark: SparkSession, paths: str | list[str], fmt: str) -> DataFrame:
    """Lines of the chosen entry of each ZIP archive, as ``text_lines`` gives them.

    An archive can only be read from its start, so each is one task; its lines leave in batches and are
    then spread by blocks, so that the parsing of a large archive uses the whole cluster. The unpacked
    lines are staged because headers and rows are read from them separately.
    """
    endings = CSV_ENDINGS if fmt == "csv" else SENTENCE_ENDINGS

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path, archive in _opened(batches):
            yield from _entry_batches(path, archive, endings)

    lines = _archives(spark, paths).mapInArrow(unpack, LINES).repartition("file", "block")
    return stage(lines, "unpacked").select(
        "value", F.struct("file", "block", F.col("line_no").alias("row")).alias("seq")
    )


def _choose_entry(archive: zipfile.ZipFile, endings: tuple[str, ...]) -> zipfile.ZipInfo | None:
    entries = [e for e in archive.infolist() if not e.is_dir()]
    fitting = [e for e in entries if e.filename.lower().endswith(endings)]
    return next(iter(fitting or entries), None)


def _archives(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Archives as (path, content). Where tasks can open the files themselves, content is null and nothing is loaded."""
    from pyarrow import fs

    files = list_files(spark, paths)
    try:
        for path in files:
            fs.FileSystem.from_uri(path)
    except (pa.ArrowInvalid, ImportError):  # a store that only Spark's readers know; its archives are loaded whole
        return spark.read.format("binaryFile").load(paths).select("path", "content")
    rows = spark.createDataFrame([(f, None) for f in files], "path string, content binary")
    return rows.repartition(max(1, min(len(files), 1024)), "path")


def _opened(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[str, zipfile.ZipFile]]:
    """The archives of (path, content) rows. A file is read where the archive's directory points, not as a whole."""
    from pyarrow import fs

    for batch in batches:
        for path, content in zip(batch["path"].to_pylist(), batch["content"]):
            if content.is_valid:
                with zipfile.ZipFile(io.BytesIO(content.as_py())) as archive:
                    yield path, archive
            else:
                system, place = fs.FileSystem.from_uri(path)
                with system.open_input_file(place) as raw, zipfile.ZipFile(raw) as archive:
                    yield path, archive


def _entry_batches(
    path: str, archive: zipfile.ZipFile, endings: tuple[str, ...], rows: int = 10_000
) -> Iterator[pa.RecordBatch]:
    entry = _choose_entry(archive, endings)
    if entry is None:
        raise ValueError(f"no usable entry in archive {path}")
    with archive.open(entry) as raw:
        text = io.TextIOWrapper(raw, encoding="utf-8", errors="replace")
        first, values = 0, []
        for line in text:
            values.append(line.rstrip("\n"))
            if len(values) == rows:
                yield _line_batch(path, first, values)
                first, values = first + rows, []
        yield _line_batch(path, first, values)


def _line_batch(path: str, first: int, values: list[str]) -> pa.RecordBatch:
    numbers = range(first, first + len(values))
    return pa.RecordBatch.from_arrays(
        [
            pa.array([path] * len(values), pa.string()),
            pa.array([n // BLOCK_LINES for n in numbers], pa.int64()),
            pa.array(numbers, pa.int64()),
            pa.array(values, pa.string()),
        ],
        names=["file", "block", "line_no", "value"],
    )


def _first_entry_names(spark: SparkSession, paths: list[str]) -> DataFrame:
    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path, archive in _opened(batches):
            entry = _choose_entry(archive, ("",))
            yield pa.RecordBatch.from_pydict({"file": [path], "entry": [entry.filename if entry else ""]})

    return _archives(spark, paths).mapInArrow(names, "file string, entry string")
