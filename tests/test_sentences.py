"""Sentence logs: tag blocks, assembly, decoding."""

import random

import pytest
from pyspark.sql import functions as F
from sequential import assembled

from wakeline.functions.scalars import floor_div, trim_padding
from wakeline.sources import sentences as N
from wakeline.sources.files import text_lines

FALLBACK = "2024-05-01 00:00:00"

LOG = r"""# comment

\c:1599239526500,s:station,T:2020-09-04 18.12.06*5D\!AIVDM,1,1,,B,B>cSnNP00FVur7UaC7WQ3wS1jCJJ,0*73
!AIVDM,1,1,,A,15RTgt0PAso;90TKcjM8h6g208CQ,0*4A
not a sentence at all
!AIVDM,1,1,,A
!AIVDM,one,1,,A,15RTgt0PAso;90TKcjM8h6g208CQ,0*4A
!AIVDM,2,1,1,A,55?MbV02;H;s<HtKR20EHE:0@T4@Dn2222222216L961O5Gf0NSQEp6ClRp8,0*1C
!AIVDM,2,2,1,A,88888888880,2*25
!AIVDM,1,1,,A,B52K>;h00Fc>jpUlNV@ikwpUoP06,0*4C
!AIVDM,1,1,,A,H42O55i18tMET00000000000000,2*6D
!AIVDM,1,1,,A,H42O55lt0000000D3nink000?0500,0*40
\s:x,c:1699401684*4D\!AIVDM,1,1,,A,13u?etPv2;0n:dDPwUM1U1Cb069D,0*24
!AIVDM,1,1,,A,402M??AvAPP000h0MJR07Ug02H0I,0*10
!BSVDM,1,1,,A,15RTgt0PAso;90TKcjM8h6g208CQ,0*4A
"""


@pytest.fixture(scope="module")
def messages(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("log") / "sample.nmea"
    path.write_text(LOG)
    return N.read_sentences(spark, str(path), FALLBACK)


def rows_by(df, key):
    return {getattr(r, key): r for r in df.collect()}


def test_position_report_of_a_class_a_vessel(messages):
    r = rows_by(N.decode_positions(messages), "mmsi")[371798000]
    assert (r.msg_type, r.nav_status, r.rot, r.heading) == (1, 0, -127.0, 215)
    assert r.sog == pytest.approx(12.3, abs=1e-5)
    assert r.cog == 224.0
    assert (r.lon, r.lat) == (pytest.approx(-123.395383333), pytest.approx(48.381633333))
    assert str(r.ts) == FALLBACK


def test_position_report_of_a_class_b_vessel(messages):
    r = rows_by(N.decode_positions(messages), "mmsi")[338087471]
    assert (r.msg_type, r.nav_status, r.rot, r.heading) == (18, None, None, 511)
    assert (round(r.sog, 4), round(r.cog, 4)) == (0.1, 79.6)
    assert (r.lon, r.lat) == (pytest.approx(-74.0721316667), pytest.approx(40.68454))


def test_tag_block_time_in_milliseconds_and_seconds(messages):
    at = {r.mmsi: r.ts for r in N.decode_positions(messages).collect()}
    assert str(at[985200250]) == "2020-09-04 17:12:06.500000"
    assert "2023-11-08 00:01:24" in {str(t) for t in at.values()}


def test_static_report_in_two_parts(messages):
    r = rows_by(N.decode_static(messages), "mmsi")[351759000]
    assert (r.imo, r.callsign, r.vessel_name, r.destination) == (9134270, "3FOF8", "EVER DIADEM", "NEW YORK")
    assert (r.ship_type, r.ship_type_desc) == (70, "cargo")
    assert (r.length_m, r.beam_m) == (295.0, 32.0)
    assert r.draught_m == pytest.approx(12.2, abs=1e-5)


def test_static_report_parts_a_and_b(messages):
    a, b = sorted((r for r in N.decode_static(messages).collect() if r.mmsi == 271041815), key=lambda r: r.seq.row)
    assert (a.vessel_name, a.callsign, a.ship_type) == ("PROGUY", None, None)
    assert (b.vessel_name, b.callsign, b.ship_type, b.length_m, b.beam_m) == (None, "TC6163", 60, 15.0, 5.0)


def test_other_types_and_bad_lines_give_nothing(messages):
    assert N.decode_positions(messages).count() == 4
    assert N.decode_static(messages).count() == 3


def test_counts(spark, tmp_path):
    path = tmp_path / "sample.nmea"
    path.write_text(LOG)
    counts = N.parse_counts(text_lines(spark, str(path)), FALLBACK).head()
    assert (counts.sentences, counts.skipped, counts.messages) == (11, 2, 8)
    assert (counts.positions, counts.vessels) == (4, 3)


def test_without_any_time_nothing_is_decoded(spark, tmp_path):
    path = tmp_path / "one.nmea"
    path.write_text("!AIVDM,1,1,,A,15RTgt0PAso;90TKcjM8h6g208CQ,0*4A\n")
    assert N.decode_positions(N.read_sentences(spark, str(path))).count() == 0


def test_short_payload_gives_no_position(spark, tmp_path):
    path = tmp_path / "short.nmea"
    path.write_text("!AIVDM,1,1,,A,15RTgt0P,0*4A\n!AIVDM,1,1,,A,15RTgt0PAso;90TKcjM8h6g208CQ€,0*4A\n")
    assert N.decode_positions(N.read_sentences(spark, str(path), FALLBACK)).count() == 0


def test_padding_is_trimmed(spark):
    texts = ["WEST@@@@@@@", "@@@@", "", None, "HELLO WORLD       "]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r[0] for r in df.orderBy("i").select(trim_padding(F.col("t"))).collect()]
    assert got == ["WEST", None, None, None, "HELLO WORLD"]


def test_assembly_matches_the_sequential_rule(spark):
    rng = random.Random(7)
    logs = []
    for n in range(40):
        log, p_right = [], rng.choice([0.3, 0.7, 0.95])
        open_parts = []
        for seq in range(600):
            if open_parts and rng.random() < p_right:
                total, num, key = open_parts.pop(0)
            else:
                total, key = rng.choice([1, 2, 2, 3, 5]), rng.choice("AB") + "|" + str(rng.randrange(3))
                num = 1 if rng.random() < 0.6 else rng.randrange(1, 6)
                open_parts = [(total, i, key) for i in range(num + 1, total + 1)]
                if rng.random() < 0.2:
                    rng.shuffle(open_parts)
            log.append((seq, total, num, key, f"{n}.{seq} "))
        logs.append(log)
    rows = [(*s, n) for n, log in enumerate(logs) for s in log]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "seq bigint, total int, num int, key string, payload string, file int")
    df = df.withColumn("ts", F.timestamp_seconds("seq"))
    got = N.assemble(df, F.col("file"), floor_div(F.col("seq"), 37)).select("payload", "seq").collect()
    want = {pair for log in logs for pair in assembled(log)}
    assert {tuple(r) for r in got} == want
    assert len(got) == len(want)


def test_a_group_that_never_ends_is_not_collected(spark):
    """One part 1 followed by very many repeats of part 3 of 3: aggregated away, and nothing completes."""
    lines = spark.range(200_000).select(
        F.col("id").alias("seq"), F.lit(3).alias("total"), F.when(F.col("id") == 0, 1).otherwise(3).alias("num"),
        F.lit("A|1").alias("key"), F.lit("x").alias("payload"), F.timestamp_seconds("id").alias("ts"),
    )
    assert N.assemble(lines, F.lit("f"), floor_div(F.col("seq"), 10_000)).count() == 0


def test_line_order_is_kept_over_splits(spark, tmp_path):
    path = tmp_path / "long.txt"
    path.write_text("".join(f"line {i} {'x' * (i % 90)}\n" for i in range(30_000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
    try:
        lines = text_lines(spark, str(path)).repartition(7)
        got = [int(r.value.split()[1]) for r in lines.orderBy("seq").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == list(range(30_000))


def test_the_encoder_names_a_text_once_and_takes_any_letters(spark):
    """Bits and texts are computed in a selection of their own: used in several places, they would be worked out in each."""
    from wakeline.functions import payload as P
    from wakeline.plans import rendering as R

    texts = ["SHIP 12", "", None, "A@b~z", "x" * 30, "\u00e9\u0250\u4e2d\U0001f600", "\x01\x7f 9"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    coded = R._with_text_bits(rows, {"b": (F.col("t"), 20)})
    plan = coded._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("unbase64") == 1
    for r in coded.collect():
        padded = (r.t or "")[:20].ljust(20, "@")
        assert r.b == "".join(f"{ord(c) % 64:06b}" for c in padded)
    for width in (1, 6, 49, 168, 424):
        bits = "".join(str(i * i % 7 % 2) for i in range(width))
        want = "".join(P.ARMOUR[int(bits[i : i + 6].ljust(6, "0"), 2)] for i in range(0, width, 6))
        got = spark.createDataFrame([(bits,), (None,)], "bits string").select(R.armour("bits", 424).alias("p")).collect()
        assert [r.p for r in got] == [want, None]


def test_text_fields_are_read_without_a_step_for_each_letter(spark):
    from wakeline.functions import payload as P

    payloads = ["".join(P.ARMOUR[(i * k + 3) % 64] for i in range(n)) for k, n in ((5, 71), (7, 28), (11, 20), (3, 9), (1, 2))]
    rows = P.with_bits(spark.createDataFrame([(p,) for p in payloads], "payload string"))
    for start, chars in ((112, 20), (40, 20), (70, 7), (90, 7), (302, 20)):
        read = rows.select("payload", P.text(start, chars).alias("t"))
        assert "transform(" not in read._jdf.queryExecution().optimizedPlan().toString()
        for r in read.collect():
            bits = "".join(f"{P.ARMOUR.index(c):06b}" for c in r.payload)
            ends = range(start + 6, min(start + chars * 6, len(bits)) + 1, 6)
            assert r.t == "".join(P.TEXT[int(bits[e - 6 : e], 2)] for e in ends)
