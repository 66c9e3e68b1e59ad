"""Writes the derived test data as input files, so that the registered queries can read them back.

The sentence encoder is the inverse of the payload decoder, by the same public bit layout.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeline.functions import payload as P
from wakeline.plans import derived as D
from wakeline.session import scratch_path, stage

# Fixed value: the header of the national daily files.
DAILY_HEADER = (
    "# Timestamp,Type of mobile,MMSI,Latitude,Longitude,Navigational status,ROT,SOG,COG,Heading,IMO,Callsign,"
    "Name,Ship type,Cargo type,Width,Length,Type of position fixing device,Draught,Destination,ETA,"
    "Data source type,A,B,C,D"
)
PLAIN_HEADER = "MMSI,BaseDateTime,LAT,LON,SOG,COG,heading,nav_status,rot,msg_type"

ISO_MICROS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"


def write_csv(rows: DataFrame, cells: dict[str, Column], header: str, label: str, order: str = "seq") -> str:
    """Write CSV files in the order of a column; header columns without a cell are empty."""
    names = header.split(",")
    text = [cells.get(n, F.lit(None)).cast("string").alias(n) for n in names]
    path = scratch_path(rows.sparkSession, label)
    rows.orderBy(order).select(*text).write.option("header", "true").csv(path)
    return path


def position_csv_files(spark: SparkSession, sf_dir: str) -> list[str]:
    """Raw positions under two headers, with three time formats, some broken rows and status texts."""
    rows = D.raw_positions(spark, sf_dir)
    seq, ts = F.col("seq"), F.col("ts")
    time = (
        F.when(seq % 3 == 0, F.date_format(ts, ISO_MICROS))
        .when(seq % 3 == 1, F.date_format(ts, "yyyy-MM-dd HH:mm:ss"))
        .otherwise(F.date_format(ts, "dd/MM/yyyy HH:mm:ss"))
    )
    lat = F.when(seq % 41 == 0, "no fix").otherwise(F.col("lat").cast("string"))
    status = F.when(seq % 5 == 0, "Moored, alongside").otherwise(F.col("nav_status").cast("string"))
    daily = {
        "# Timestamp": time, "MMSI": F.col("mmsi"), "Latitude": lat, "Longitude": F.col("lon"),
        "Navigational status": status, "ROT": F.col("rot"), "SOG": F.col("sog"), "COG": F.col("cog"),
        "Heading": F.concat(F.col("heading").cast("string"), F.lit(".0")),
    }
    plain = {
        "MMSI": F.col("mmsi"), "BaseDateTime": time, "LAT": lat, "LON": F.col("lon"), "SOG": F.col("sog"),
        "COG": F.col("cog"), "heading": F.col("heading"), "nav_status": status, "rot": F.col("rot"),
        "msg_type": F.col("msg_type"),
    }
    return [
        write_csv(rows.filter(seq % 2 == 0), daily, DAILY_HEADER, "daily-csv"),
        write_csv(rows.filter(seq % 2 == 1), plain, PLAIN_HEADER, "plain-csv"),
    ]


def static_csv_files(spark: SparkSession, sf_dir: str) -> str:
    """Static reports as daily-file rows; absent values are blank or an unknown marker."""
    rows = D.static_reports(spark, sf_dir)
    seq = F.col("seq")
    kind = seq % 3
    marker = F.element_at(F.array(*[F.lit(m) for m in ("Unknown", "undefined", "N/A", "")]), (seq % 4 + 1).cast("int"))

    def shown(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), marker)

    cells = {
        "# Timestamp": F.date_format("last_seen", "dd/MM/yyyy HH:mm:ss"), "MMSI": F.col("mmsi"),
        "Latitude": F.lit("55.5"), "Longitude": F.lit("11.25"), "IMO": shown("imo"), "Callsign": shown("callsign"),
        "Name": shown("vessel_name"), "Ship type": F.coalesce(F.col("ship_type").cast("string"), shown("ship_type_desc")),
        "Width": F.col("beam_m"), "Length": F.col("length_m"), "Draught": F.col("draught_m"),
        "Destination": shown("destination"), "A": F.when(kind == 2, seq % 50), "B": F.when(kind == 2, 10),
    }
    return write_csv(rows, cells, DAILY_HEADER, "static-csv")


def _import_cells() -> dict[str, Column]:
    return {
        "# Timestamp": F.date_format("ts", ISO_MICROS), "MMSI": F.col("mmsi"), "Latitude": F.col("lat"),
        "Longitude": F.col("lon"), "Navigational status": F.col("nav_status"), "ROT": F.col("rot"),
        "SOG": F.col("sog"), "COG": F.col("cog"), "Heading": F.col("heading"), "Name": F.col("vessel_name"),
        "Length": F.col("length_m"),
    }


def _import_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = D.named_vessels(spark, sf_dir).select("mmsi", "vessel_name", "length_m")
    return D.raw_positions(spark, sf_dir).join(names, "mmsi", "left")


def import_csv_files(spark: SparkSession, sf_dir: str) -> str:
    """Raw positions with names and numeric types of named vessels, in arrival order, for a whole import."""
    return write_csv(_import_rows(spark, sf_dir), _import_cells(), DAILY_HEADER, "import-csv")


def overlapping_csv_files(spark: SparkSession, sf_dir: str) -> list[str]:
    """The same in two deliveries: the second repeats the last part of the first and goes on in the same month."""
    rows, phase = _import_rows(spark, sf_dir), F.expr(f"seq div {D.SEQ_BLOCK}")
    return [
        write_csv(rows.filter(phase <= 5), _import_cells(), DAILY_HEADER, "first-csv"),
        write_csv(rows.filter(phase >= 4), _import_cells(), DAILY_HEADER, "second-csv"),
    ]


# A report of a clock that runs years ahead, in the first file that arrives.
FUTURE = {"mmsi": 219999999, "ts": "2031-05-06 07:08:09", "lat": 55.5, "lon": 10.25}


def landing_csv_files(spark: SparkSession, sf_dir: str) -> str:
    """Raw positions as five files that arrive one after another, the last with repeats of all days.

    A vessel's name and destination come in turn, by phase, so that no single file holds all of its fields. One
    file each, so that the order of modification times is that of ``seq``: input of a test, not of an import.
    """
    rows = D.raw_positions(spark, sf_dir)
    future = spark.range(1).select(
        *[F.lit(FUTURE[c]).cast(rows.schema[c].dataType).alias(c) for c in FUTURE], F.lit(0).cast("bigint").alias("seq")
    )
    rows = rows.unionByName(future, allowMissingColumns=True)
    phase = F.expr(f"seq div {D.SEQ_BLOCK}")
    cells = _import_cells() | {
        "Name": F.when(phase % 2 == 0, F.concat_ws(" ", F.lit("V"), "mmsi", phase.cast("string"))),
        "Destination": F.when(phase % 2 == 1, F.concat_ws(" ", F.lit("PORT"), phase.cast("string"))),
        "Length": F.col("mmsi") % 300 + 1,
    }
    path = scratch_path(spark, "landing")
    names = DAILY_HEADER.split(",")
    text = [cells.get(n, F.lit(None)).cast("string").alias(n) for n in names]
    parts = [phase <= 2, (phase > 2) & (phase <= 4), (phase > 4) & (phase <= 7), (phase > 7) & (phase < 1000), phase >= 1000]
    for part in parts:
        # The text is made by all tasks; the one that writes the file only puts it in order.
        own = rows.filter(part).select(*text, "seq").repartition(1).sortWithinPartitions("seq")
        own.drop("seq").write.mode("append").option("header", "true").csv(path)
    return path


def _write_archives(lines: DataFrame, folder: str, entry: str) -> None:
    """Lines (name, part, seq, value) to one ZIP archive for each part, written by a task of its own, in order."""

    def write(batches):
        import os
        import zipfile

        import pyarrow as pa

        archive = out = name = None

        def close():
            if archive:
                out.close()
                archive.close()
                os.replace(f"{folder}/.{name}", f"{folder}/{name}")

        for batch in batches:
            for own, value in zip(batch.column("name").to_pylist(), batch.column("value").to_pylist()):
                if own != name:
                    close()
                    name = own
                    os.makedirs(folder, exist_ok=True)
                    archive = zipfile.ZipFile(f"{folder}/.{name}", "w", zipfile.ZIP_DEFLATED)
                    out = archive.open(entry, "w")
                out.write(f"{value}\n".encode())
        close()
        yield pa.RecordBatch.from_pydict({"n": pa.array([1], pa.int64())})

    rows = lines.repartition("name").sortWithinPartitions("name", "seq", "part").select("name", "value")
    rows.mapInArrow(write, "n long").count()


def daily_archives(spark: SparkSession, sf_dir: str) -> str:
    """Import rows as daily CSV archives, named in the order of arrival: a day for each phase, repeats last."""
    folder = scratch_path(spark, "daily-zip").removeprefix("file:")
    names = DAILY_HEADER.split(",")
    cells = _import_cells()
    shown = [F.coalesce(F.translate(cells[n].cast("string"), ",", " ") if n in cells else F.lit(""), F.lit("")) for n in names]
    rows = _import_rows(spark, sf_dir).select(_archive_name().alias("name"), F.lit(1).alias("part"), "seq", F.concat_ws(",", *shown).alias("value"))
    header = rows.select("name").distinct().select("name", F.lit(0).alias("part"), F.lit(-1).cast("bigint").alias("seq"), F.lit(DAILY_HEADER).alias("value"))
    _write_archives(header.unionByName(rows), folder, "data.csv")
    return folder


def _archive_name() -> Column:
    phase = F.least(F.expr(f"seq div {D.SEQ_BLOCK}"), F.lit(60)).cast("int")
    return F.concat(F.lit("aisdk-"), F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), phase), "yyyy-MM-dd"), F.lit(".zip"))


def sentence_archives(spark: SparkSession, sf_dir: str) -> str:
    """Raw positions as sentences in daily archives."""
    folder = scratch_path(spark, "daily-nmea").removeprefix("file:")
    rows = _position_lines(spark, sf_dir).select(_archive_name().alias("name"), "part", "seq", "value")
    _write_archives(rows, folder, "log.nmea")
    return folder


# --- sentences ------------------------------------------------------------------------------------


def _bits(value: Column, width: int) -> Column:
    whole = value.cast("bigint")
    return F.lpad(F.bin(F.when(whole < 0, whole + (1 << width)).otherwise(whole)), width, "0")


# Characters that one translation turns into payload values, and those it does not know.
LETTERS = "".join(map(chr, range(1, 592)))
OTHER_LETTERS = "[^\\x01-\\u024f]"


def _with_text_bits(rows: DataFrame, texts: dict[str, tuple[Column, int]]) -> DataFrame:
    """Adds bit texts: six bits for each character of a text, its code modulo 64.

    Each step is a selection of its own, so that it is computed once.
    """
    rows = rows.withColumns({f"{n}_text": F.rpad(F.substring(F.coalesce(t, F.lit("")), 1, chars), chars, "@") for n, (t, chars) in texts.items()})
    base64 = "".join(P.BASE64[ord(c) % 64] for c in LETTERS)
    whole = {n: -(-chars // 8) * 8 for n, (_, chars) in texts.items()}
    known = {n: F.when(~F.col(f"{n}_text").rlike(OTHER_LETTERS), F.translate(f"{n}_text", LETTERS, base64)) for n in texts}
    rows = rows.withColumns({f"{n}_hex": F.hex(F.unbase64(F.rpad(known[n], w, F.lit("A")))) for n, w in whole.items()})

    def bits(name: str, chars: int) -> Column:
        steps = [F.lpad(F.conv(F.substring(f"{name}_hex", i + 1, 12), 16, 2), 48, "0") for i in range(0, whole[name] * 3 // 2, 12)]
        each = F.transform(F.split(f"{name}_text", ""), lambda c: _bits(F.ascii(c) % 64, 6))
        return F.when(F.col(f"{name}_hex").isNull(), F.array_join(each, "")).otherwise(F.substring(F.concat(*steps), 1, chars * 6))

    return rows.withColumns({n: bits(n, chars) for n, (_, chars) in texts.items()})


def armour(bits: str, width: int) -> Column:
    """A column of up to ``width`` bits to payload characters; the last character is filled up with zero bits."""
    whole = -(-width // 48) * 48
    padded = F.rpad(bits, whole, F.lit("0"))
    digits = [F.lpad(F.conv(F.substring(padded, i + 1, 48), 2, 16), 12, "0") for i in range(0, whole, 48)]
    letters = F.translate(F.base64(F.unhex(F.concat(*digits))), P.BASE64, P.ARMOUR)
    return F.substring(letters, F.lit(1), F.ceil(F.length(bits) / 6).cast("int"))


def _position_bits() -> Column:
    scaled = {
        "lon": F.round(F.col("lon") * 600_000),
        "lat": F.round(F.col("lat") * 600_000),
        "sog": F.coalesce(F.floor(F.col("sog").cast("double") * 10 + 0.5), F.lit(1023)),
        "cog": F.floor(F.col("cog").cast("double") * 10 + 0.5),
    }
    heading = _bits(F.col("heading"), 9)
    class_a = [
        _bits(F.col("msg_type"), 6), _bits(F.lit(0), 2), _bits(F.col("mmsi"), 30), _bits(F.col("nav_status"), 4),
        _bits(F.coalesce(F.col("rot"), F.lit(-128)), 8), _bits(scaled["sog"], 10), _bits(F.lit(0), 1),
        _bits(scaled["lon"], 28), _bits(scaled["lat"], 27), _bits(scaled["cog"], 12), heading, _bits(F.lit(0), 31),
    ]
    class_b = [
        _bits(F.lit(18), 6), _bits(F.lit(0), 2), _bits(F.col("mmsi"), 30), _bits(F.lit(0), 8),
        _bits(scaled["sog"], 10), _bits(F.lit(0), 1), _bits(scaled["lon"], 28), _bits(scaled["lat"], 27),
        _bits(scaled["cog"], 12), heading, _bits(F.lit(0), 35),
    ]
    return F.when(F.col("msg_type") == 18, F.concat(*class_b)).otherwise(F.concat(*class_a))


def _tag(ts: Column, seq: Column) -> Column:
    """Tag block with seconds for even and milliseconds for odd sequence numbers."""
    epoch = F.when(seq % 2 == 0, F.unix_seconds(ts)).otherwise(F.unix_millis(ts))
    return F.concat(F.lit("\\s:derived,c:"), epoch.cast("string"), F.lit("*00\\"))


def _write_lines(lines: DataFrame, label: str) -> str:
    """Write lines made of rows that lie in ranges of ``seq``, so all parts of a message go to one file."""
    path = scratch_path(lines.sparkSession, label)
    lines.sortWithinPartitions("seq", "part").select("value").write.text(path)
    return path


def _position_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw positions as sentences. The speed fits its ten bits, so those above 102.2 become 102.2.

    The rows are dealt out by ranges of ``seq`` before they are encoded: their scan may be a few tasks only.
    """
    top = F.lit(102.2).cast("float")
    rows = D.raw_positions(spark, sf_dir).repartitionByRange("seq").withColumn("sog", F.when(F.col("sog") > top, top).otherwise(F.col("sog")))
    rows = rows.withColumn("bits", _position_bits())
    seq = F.col("seq")
    sentence = F.concat(
        F.when(seq % 7 == 0, "").otherwise(_tag(F.col("ts"), seq)),
        F.lit("!AIVDM,1,1,,"),
        F.when(seq % 2 == 0, "A").otherwise("B"),
        F.lit(","),
        armour("bits", 168),
        F.lit(",0*00"),
    )
    return rows.select(sentence.alias("value"), "seq", F.lit(1).alias("part"))


def position_sentences(spark: SparkSession, sf_dir: str) -> str:
    return _write_lines(_position_lines(spark, sf_dir), "positions-nmea")


def static_sentences(spark: SparkSession, sf_dir: str) -> str:
    """Static reports as sentences, one log."""
    return _write_lines(_static_lines(spark, sf_dir, F.col("seq") % 10).select("seq", "part", "value"), "static-nmea")


# Files of a group of a landing log. Their number is the receiver's, not that of the tasks that write them.
GROUP_FILES = 4


def landing_logs(spark: SparkSession, sf_dir: str) -> str:
    """The same as pieces of one log that arrive in three groups of files; some messages are cut by the groups' ends.

    The parts of a cut message lie in the first group and in one of the others. Until then its sequence id is its own.
    """
    turn = F.expr("seq div 3")
    cut = (F.col("seq") % 3 == 0) & (turn % 50 == 0)
    group_id = F.when(cut, F.concat(F.lit("s"), F.col("seq").cast("string"))).otherwise((F.col("seq") % 10).cast("string"))
    arrival = F.when(~cut, turn % 3).when(F.col("part") == 0, 0).otherwise(1 + turn % 2)
    # Encoded once, by all tasks; each group is then only put in order and written.
    lines = stage(_static_lines(spark, sf_dir, group_id).withColumn("arrival", arrival), "lines")
    path = scratch_path(spark, "landing-nmea")
    for group in range(3):
        own = lines.where(F.col("arrival") == group).repartitionByRange(GROUP_FILES, "seq").sortWithinPartitions("seq", "part")
        own.select("value").write.mode("append").text(path)
    return path


def _static_lines(spark: SparkSession, sf_dir: str, group_id: Column) -> DataFrame:
    """Static reports as sentences: kind 0 as type 5 in two parts, kind 1 as type 24 B, kind 2 as 24 A.

    The rows are dealt out by ranges of ``seq`` before they are encoded: their scan may be a few tasks only.
    """
    rows = D.static_reports(spark, sf_dir).repartitionByRange("seq")
    rows = _with_text_bits(
        rows, {"call_bits": (F.col("callsign"), 7), "name_bits": (F.upper("vessel_name"), 20), "port_bits": (F.col("destination"), 20)}
    )
    seq = F.col("seq")
    kind = seq % 3
    zero = F.lit(0)
    mmsi = _bits(F.col("mmsi"), 30)
    length = F.coalesce(F.col("length_m"), zero)
    type5 = F.concat(
        _bits(F.lit(5), 6), _bits(zero, 2), mmsi, _bits(zero, 2), _bits(F.col("imo"), 30),
        F.col("call_bits"), F.col("name_bits"), _bits(F.lit(70), 8),
        _bits(length, 9), _bits(zero, 9), _bits(F.lit(4), 6), _bits(F.lit(5), 6), _bits(zero, 4), _bits(zero, 20),
        _bits(F.lit(57), 8), F.col("port_bits"), _bits(zero, 2),
    )
    type24b = F.concat(
        _bits(F.lit(24), 6), _bits(zero, 2), mmsi, _bits(F.lit(1), 2), _bits(F.lit(36), 8), _bits(zero, 42),
        F.col("call_bits"), _bits(length, 9), _bits(zero, 9), _bits(zero, 6), _bits(zero, 6),
        _bits(zero, 6),
    )
    type24a = F.concat(
        _bits(F.lit(24), 6), _bits(zero, 2), mmsi, _bits(zero, 2), F.col("name_bits")
    )
    rows = rows.withColumn("bits", F.when(kind == 0, type5).when(kind == 1, type24b).otherwise(type24a))
    group = group_id.cast("string")
    # Seconds throughout: as milliseconds these years would lie below the limit that tells them apart.
    tag = _tag(F.col("last_seen"), F.lit(0))

    def part(n: int, begin: int, chars: int) -> Column:
        return F.concat(
            tag, F.lit(f"!AIVDM,2,{n},"), group, F.lit(",A,"), F.substring("body", begin, chars), F.lit(",2*00")
        )

    whole = F.concat(tag, F.lit("!AIVDM,1,1,,B,"), F.col("body"), F.lit(",0*00"))
    lines = F.when(kind == 0, F.array(part(1, 1, 56), part(2, 57, 100))).otherwise(F.array(whole))
    return rows.withColumn("body", armour("bits", 424)).select("seq", F.posexplode(lines).alias("part", "value"))
