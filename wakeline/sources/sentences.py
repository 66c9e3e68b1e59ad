"""Radio sentence logs: line fields, assembly of multi-part messages, decoding to typed rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wakeline import schema as S
from wakeline.functions import payload as P
from wakeline.functions import scalars as X
from wakeline.session import stage
from wakeline.sources.files import archive_lines, first_lines_by_file, text_lines

# Sentence starts, and the epoch inside a tag block.
SENTENCE = "!AI"
TAGGED_SENTENCES = ("!AIVDM", "!AIVDO")
TAG_EPOCH = r"c:(\d+)"
# Fixed value: larger epochs are milliseconds.
MILLIS_ABOVE = 1_000_000_000_000

# Sentences that belong to a message of several.
IS_PART = "total <> 1 and total >= 0 and num >= 1"

POSITION_TYPES_A = [1, 2, 3]
POSITION_TYPE_B = 18
STATIC_TYPE_A = 5
STATIC_TYPE_B = 24


def read_sentences(
    spark: SparkSession, paths: str | list[str], fallback: str | None = None, line_limit: int = 0
) -> DataFrame:
    return assemble(sentence_fields(first_lines_by_file(text_lines(spark, paths), line_limit), fallback))


def read_sentence_archives(
    spark: SparkSession, paths: str | list[str], fallback: str | None = None, line_limit: int = 0
) -> DataFrame:
    return assemble(sentence_fields(first_lines_by_file(archive_lines(spark, paths, "nmea"), line_limit), fallback))


def sentence_fields(lines: DataFrame, fallback: str | None = None) -> DataFrame:
    """Lines (``value``, ``seq``) to sentences: total, num, channel key, payload, ts, seq.

    ``fallback`` is the UTC time of sentences without a tag block time. Comments, blank lines, other
    sentences and lines with too few or non-numeric fields are left out.
    """
    return _fields(lines, fallback).filter("commas >= 5 and total is not null and num is not null").drop("commas")


def parse_counts(lines: DataFrame, fallback: str | None = None) -> DataFrame:
    """One row: sentences read, skipped for their fields, assembled messages, positions, vessel reports."""
    usable = F.coalesce(F.expr("commas >= 5 and total is not null and num is not null"), F.lit(False))
    fields = stage(_fields(lines, fallback).withColumn("usable", usable), "fields")
    read = fields.agg(F.count("*").alias("sentences"), F.count_if(~F.col("usable")).alias("skipped"))
    messages = stage(assemble(fields.filter("usable").drop("usable", "commas")), "messages")
    counts = [
        read,
        messages.agg(F.count("*").alias("messages")),
        decode_positions(messages).agg(F.count("*").alias("positions")),
        decode_static(messages).agg(F.count("*").alias("vessels")),
    ]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), counts)
    return rows.agg(*[F.max(c).alias(c) for c in rows.columns])


def _fields(lines: DataFrame, fallback: str | None) -> DataFrame:
    line, sentence = F.col("_line"), F.col("_s")
    # A tag block stands between two backslashes before the sentence.
    behind_tags = F.substr(line, F.locate("\\", line, 2) + 1)
    after_tag = [behind_tags.startswith(start) & (F.length(behind_tags) > len(start)) for start in TAGGED_SENTENCES]
    tagged = line.startswith("\\") & (after_tag[0] | after_tag[1])
    parts = {
        "_s": F.when(tagged, behind_tags).otherwise(line),
        "_tags": F.when(tagged, F.split_part(line, F.lit("\\"), F.lit(2))),
    }
    epoch = F.regexp_extract("_tags", TAG_EPOCH, 1).try_cast("bigint")
    at = F.when(epoch > MILLIS_ABOVE, F.timestamp_millis(epoch)).otherwise(F.timestamp_seconds(epoch))
    default = X.at(fallback) if fallback else F.lit(None).cast("timestamp")

    def field(i: int) -> Column:
        return F.coalesce(F.get("_fields", F.lit(i)), F.lit(""))

    fields = {
        "commas": F.size("_fields") - 1,
        "total": field(1).try_cast("int"),
        "num": field(2).try_cast("int"),
        "key": F.concat_ws("|", F.trim(field(4)), F.trim(field(3))),
        "payload": F.trim(field(5)),
        "ts": F.coalesce(at, default),
    }
    split = {"_fields": F.split(sentence, ","), "_tags": F.col("_tags")}
    read = lines.filter(F.col("value").contains(SENTENCE)).select("seq", X.strip(F.col("value")).alias("_line"))
    return _once(_once(_once(read, parts).filter(sentence.startswith(SENTENCE)), split), fields)


def _once(df: DataFrame, values: dict[str, Column]) -> DataFrame:
    """``seq`` and new columns, each computed once per row.

    A filter on a selected expression is moved below the selection, together with a copy of the
    expression; for text parsed in several steps the copies multiply. Filters do not move below ``inline``.
    """
    row = F.struct(*[value.alias(name) for name, value in values.items()])
    return df.select("seq", F.inline_outer(F.array(row)))


def assemble(sentences: DataFrame, file: Column | None = None, block: Column | None = None) -> DataFrame:
    """Whole messages (payload, ts, seq) from sentences.

    Parts of a message share a channel and sequence id within one file. Part 1 starts a group and ends
    the one before; parts without a group or beyond its size are dropped; the message is complete at the
    first sentence that is the last of its own count while every part has been seen, with the newest
    version of each part. ``file`` and ``block`` default to the fields of the scan's ``seq``; ``block``
    must grow with ``seq`` and bounds how many rows are ordered together.
    """
    # The typed sentences are staged, so that the log is read once; whole messages and parts come from this copy.
    sentences = stage(sentences.filter("total >= 0"), "sentences")
    single = sentences.filter("total = 1").select("payload", "ts", "seq")
    parts = stage(sentences.filter(IS_PART), "parts")
    return single.unionByName(assemble_parts(parts, file, block))


def assemble_parts(parts: DataFrame, file: Column | None = None, block: Column | None = None) -> DataFrame:
    """The messages of several sentences, from staged ``IS_PART`` sentences."""
    if parts.isEmpty():
        return parts.select("payload", "ts", "seq")
    keys = {"_file": F.col("seq.file") if file is None else file, "_block": F.col("seq.block") if block is None else block}
    grouped = _join_to_group(parts.withColumns(keys)).filter("num <= _group.total")
    group = ["_file", "key", "_group"]

    # Each step is a combining aggregation, so repeats of a part without end do no harm.
    seen = grouped.groupBy(*group, "num").agg(F.min("seq").alias("_first"))
    full = (
        seen.groupBy(*group)
        .agg(F.count("*").alias("_seen"), F.max("_first").alias("_full_at"))
        .filter("_seen = _group.total")
        .drop("_seen")
    )
    closing = F.when((F.col("num") == F.col("total")) & (F.col("seq") >= F.col("_full_at")), F.struct("seq", "ts"))
    done = grouped.join(full, group).groupBy(*group).agg(F.min(closing).alias("_done")).filter("_done is not null")
    newest = (
        grouped.join(done, group)
        .filter(F.col("seq") <= F.col("_done.seq"))
        .groupBy(*group, "num")
        .agg(F.max_by("payload", "seq").alias("payload"), F.first("_done").alias("_done"))
    )
    in_order = F.transform(F.sort_array(F.collect_list(F.struct("num", "payload"))), lambda p: p["payload"])
    multi = newest.groupBy(*group).agg(F.array_join(in_order, "").alias("payload"), F.first("_done").alias("_done"))
    return multi.select("payload", F.coalesce("_group.ts", "_done.ts").alias("ts"), F.col("_done.seq").alias("seq"))


def open_parts(sentences: DataFrame, file: Column) -> DataFrame:
    """The parts of messages that later sentences may complete: of each file and key those of the last group, unless it is complete.

    Of a part only the newest version stays. ``assemble`` gives the same for these and the sentences that follow as for all.
    """
    parts = sentences.filter(IS_PART).withColumn("_file", file)
    start = F.when(F.col("num") == 1, F.struct("seq", "total"))
    last = parts.groupBy("_file", "key").agg(F.max(start).alias("_group")).filter("_group is not null")
    closing = F.when(F.col("num") == F.col("total"), F.col("seq"))
    versions = (
        parts.join(last, ["_file", "key"])
        .filter("seq >= _group.seq and num <= _group.total")
        .groupBy("_file", "key", "_group.total", "num")
        .agg(
            F.min("seq").alias("_first"),
            F.max(closing).alias("_closing"),
            F.max_by(F.struct("seq", "total", "payload", "ts"), "seq").alias("_part"),
        )
    )
    complete = (F.count("*") == F.col("total")) & F.coalesce(F.max("_closing") >= F.max("_first"), F.lit(False))
    still_open = versions.groupBy("_file", "key", "total").agg(complete.alias("_complete")).filter("not _complete")
    return versions.join(still_open, ["_file", "key"], "left_semi").select("key", "num", "_part.*")


def _join_to_group(parts: DataFrame) -> DataFrame:
    """Adds ``_group`` (seq, total, ts of the part 1 a sentence belongs to); others are dropped.

    The newest part 1 is found inside each block; what was open at the end of earlier blocks comes from
    one small row per block.
    """
    start = F.when(F.col("num") == 1, F.struct("seq", "total", "ts"))
    inside = Window.partitionBy("_file", "key", "_block").orderBy("seq")
    earlier = Window.partitionBy("_file", "key").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    by_block = parts.groupBy("_file", "key", "_block").agg(F.max(start).alias("_start"))
    carried = by_block.select("_file", "key", "_block", F.last("_start", ignorenulls=True).over(earlier).alias("_open"))
    so_far = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        parts.withColumn("_own", F.last(start, ignorenulls=True).over(so_far))
        .join(carried, ["_file", "key", "_block"])
        .withColumn("_group", F.coalesce("_own", "_open"))
        .filter("_group is not null")
        .drop("_own", "_open", "_block")
    )


# --- decoding -------------------------------------------------------------------------------------
#
# Bit positions are those of ITU-R M.1371. Values are given as transmitted: speed 102.3 and position
# 181/91 (not available) are left to validation, heading 511 stays, the rate of turn is the raw signed
# value. Checksums are not verified.


def _messages_of(messages: DataFrame, types: list[int], bits: int) -> DataFrame:
    """Messages of some types with at least ``bits`` bits, ready for reading fields.

    The type is the value of the first payload character, so this needs no decoding.
    """
    first = F.substring("payload", 1, 1)
    timed = messages.filter("ts is not null").filter(F.length("payload") * 6 >= bits)
    return P.with_bits(timed.filter(first.isin([P.ARMOUR[t] for t in types]))).withColumn(
        "_type", P.unsigned(0, 6).cast("int")
    )


def decode_positions(messages: DataFrame) -> DataFrame:
    """Position reports (types 1, 2, 3 and 18) with ``seq``; other messages give no row."""
    class_a = ~F.startswith(F.col("payload"), F.lit(P.ARMOUR[POSITION_TYPE_B]))

    def pick(a: Column, b: Column) -> Column:
        return F.when(class_a, a).otherwise(b)

    none = F.lit(None)
    # Up to the end of the latitude; class A has it four bits later.
    reports = _messages_of(messages, [*POSITION_TYPES_A, POSITION_TYPE_B], 112)
    rows = reports.filter(~class_a | (F.col("_bits") >= 116))
    values = {
        "mmsi": P.unsigned(8, 30),
        "ts": F.col("ts"),
        "lat": pick(P.signed(89, 27), P.signed(85, 27)) / 600_000.0,
        "lon": pick(P.signed(61, 28), P.signed(57, 28)) / 600_000.0,
        "sog": (pick(P.unsigned(50, 10), P.unsigned(46, 10)) / 10.0).cast("float"),
        "cog": (pick(P.unsigned(116, 12), P.unsigned(112, 12)) / 10.0).cast("float"),
        "heading": pick(P.unsigned(128, 9), P.unsigned(124, 9)).cast("int"),
        "nav_status": pick(P.unsigned(38, 4), none).cast("int"),
        "rot": pick(P.signed(42, 8), none).cast("float"),
        "msg_type": F.col("_type"),
        "seq": F.col("seq"),
    }
    return rows.select(*[values[c].alias(c) for c in [*S.POSITION_COLS, "seq"]])


def decode_static(messages: DataFrame) -> DataFrame:
    """Static reports (type 5 and both parts of type 24), one row per message, with ``seq``.

    The type text is the ship category of the type code.
    """
    is_a = F.col("_type") == STATIC_TYPE_A
    part = P.unsigned(38, 2)
    is_name = ~is_a & (part == 0)
    is_rest = ~is_a & (part != 0)

    def pick(a=None, name=None, rest=None) -> Column:
        chain = F
        for test, value in ((is_a, a), (is_name, name), (is_rest, rest)):
            if value is not None:
                chain = chain.when(test, value)
        return chain

    rows = _messages_of(messages, [STATIC_TYPE_A, STATIC_TYPE_B], 40)
    # Fields that are used more than once are read in a selection of their own.
    read = rows.withColumns(
        {
            "ship_type": pick(a=P.unsigned(232, 8), rest=P.unsigned(40, 8)).cast("int"),
            "_imo": pick(a=P.unsigned(40, 30)),
            "_name": pick(a=P.text(112, 20), name=P.text(40, 20)),
            "_call": pick(a=P.text(70, 7), rest=P.text(90, 7)),
            "_port": pick(a=P.text(302, 20)),
            "_bow": pick(a=P.unsigned(240, 9), rest=P.unsigned(132, 9)),
            "_stern": pick(a=P.unsigned(249, 9), rest=P.unsigned(141, 9)),
            "_left": pick(a=P.unsigned(258, 6), rest=P.unsigned(150, 6)),
            "_right": pick(a=P.unsigned(264, 6), rest=P.unsigned(156, 6)),
        }
    )
    values = {
        "mmsi": P.unsigned(8, 30),
        "imo": F.when(F.col("_imo") > 0, F.col("_imo")),
        "vessel_name": X.trim_padding(F.col("_name")),
        "callsign": X.trim_padding(F.col("_call")),
        "ship_type": F.col("ship_type"),
        "ship_type_desc": F.when(
            F.col("ship_type").isNotNull(), X.ship_category(F.col("ship_type"), F.lit(None).cast("string"))
        ),
        "length_m": X.dimension_sum(F.col("_bow"), F.col("_stern")),
        "beam_m": X.dimension_sum(F.col("_left"), F.col("_right")),
        "draught_m": pick(a=(P.unsigned(294, 8) / 10.0).cast("float")),
        "destination": X.trim_padding(F.col("_port")),
        "last_seen": F.col("ts"),
        "seq": F.col("seq"),
    }
    return read.select(*[values[c].alias(c) for c in [*S.VESSEL_COLS, "seq"]])
