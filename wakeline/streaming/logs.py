"""Continuous import of radio sentence logs; messages whose parts lie in several files are put together.

A receiver's log comes in pieces: it is cut into files by size or time, wherever a message stands. ``log`` is a pattern whose
first group, found in a file's path, names the log the file belongs to. Without it every file is a log of its own.

Parts of the messages still open at the end of a batch are the state: of each log, channel and sequence id the newest
version of each part of the last group, unless that is complete. They are read before the sentences of the next batch, which
are then put together as those of a batch import. So the state is as large as the open messages, work follows the batch, and the
result is that of an import of all files at once, for any number of files in a batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wakeline.session import configure, stage
from wakeline.sources import sentences as N
from wakeline.sources.tables import Store, table_exists
from wakeline.streaming.incremental import file_place, in_arrival_order, start_import


def stream_lines(spark: SparkSession, landing: str, files_per_batch: int = 100) -> DataFrame:
    """Lines of text files as they arrive in ``landing``; ``seq`` orders them by their file's modification time, name and place."""
    raw = configure(spark).readStream.option("maxFilesPerTrigger", files_per_batch).text(landing)
    return raw.select("value", file_place().alias("seq"))


def log_name(log: str | None) -> Column:
    """The log a sentence belongs to, by the path of its file; files that the pattern does not fit are logs of their own."""
    file = F.col("seq.file")
    if log is None:
        return file
    return F.coalesce(F.nullif(F.regexp_extract(file, log, 1), F.lit("")), file)


def place_in_log() -> Column:
    return F.struct("seq.at", "seq.file", "seq.block")


def messages_of_batch(sentences: DataFrame, before: DataFrame | None, log: str | None) -> tuple[DataFrame, DataFrame]:
    """(whole messages, parts of messages still open) of sentences that follow the open parts ``before``."""
    single = sentences.filter("total = 1").select("payload", "ts", "seq")
    parts = sentences.filter(N.IS_PART)
    parts = stage(parts if before is None else before.unionByName(parts), "parts")
    return single.unionByName(N.assemble_parts(parts, log_name(log), place_in_log())), N.open_parts(parts, log_name(log))


def _reader(checkpoint: str, log: str | None, fallback: str | None) -> Callable[[DataFrame, int], DataFrame]:
    """What makes whole messages of a batch and its number.

    Open parts lie below ``checkpoint`` in two tables used in turn, so a batch that is run again starts from those before it.
    """

    def read(batch: DataFrame, number: int) -> DataFrame:
        spark = batch.sparkSession
        sentences = stage(N.sentence_fields(in_arrival_order(batch), fallback), "sentences")
        before, after = (f"{checkpoint}/open-parts/{n % 2}" for n in (number - 1, number))
        carried = None
        if log is not None and number > 0 and table_exists(spark, before):
            carried = spark.read.schema(sentences.schema).parquet(before)
        messages, still_open = messages_of_batch(sentences, carried, log)
        if log is not None:  # else a file, and with it its log, ends within the batch
            still_open.select(*sentences.columns).write.mode("overwrite").parquet(after)
        return messages

    return read


def import_sentences(
    lines: DataFrame,
    store: Store,
    checkpoint: str,
    log: str | None = None,
    fallback: str | None = None,
    available_now: bool = True,
    cell_deg: float | None = None,
) -> StreamingQuery:
    """Start the import of ``stream_lines``: positions and vessel records go to the store as by ``incremental.import_stream``.

    ``fallback`` is the UTC time of sentences without a time of their own; without it they are left out.
    """
    whole = _reader(checkpoint, log, fallback)

    def read(batch: DataFrame, number: int) -> tuple[DataFrame, DataFrame]:
        messages = stage(whole(batch, number), "messages")
        return N.decode_positions(messages), N.decode_static(messages)

    return start_import(lines, read, store, checkpoint, available_now, cell_deg)


def write_messages(
    lines: DataFrame, path: str, checkpoint: str, log: str | None = None, fallback: str | None = None, available_now: bool = True
) -> StreamingQuery:
    """Start writing the whole messages of ``stream_lines`` below ``path``, a folder for each batch; ``read_messages`` reads them."""
    whole = _reader(checkpoint, log, fallback)
    trigger = {"availableNow": True} if available_now else {"processingTime": "1 minute"}

    def write(batch: DataFrame, number: int) -> None:
        whole(batch, number).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return lines.writeStream.foreachBatch(write).option("checkpointLocation", f"{checkpoint}/log").trigger(**trigger).start()


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    seq = "struct<at: timestamp, file: string, block: bigint, row: bigint>"
    return spark.read.schema(f"payload string, ts timestamp, seq {seq}").parquet(path)
