"""Sentence logs as a stream: parts of a message in different files and batches."""

import datetime
import os
import random

from pyspark.sql import functions as F
from sequential import assembled

from wakeline.session import stage
from wakeline.sources import sentences as N
from wakeline.sources import tables as TB
from wakeline.streaming import logs as LO

FALLBACK = "2024-05-01 00:00:00"
SCHEMA = "at timestamp, file string, block long, row long, total int, num int, key string, payload string, ts timestamp"
PARTS = [
    "!AIVDM,2,1,1,A,55?MbV02;H;s<HtKR20EHE:0@T4@Dn2222222216L961O5Gf0NSQEp6ClRp8,0*1C",
    "!AIVDM,2,2,1,A,88888888880,2*25",
]
POSITION = "!AIVDM,1,1,,A,15RTgt0PAso;90TKcjM8h6g208CQ,0*4A"


def _sentences(spark, rows):
    place = F.struct("at", "file", "block", "row")
    df = spark.createDataFrame(rows, SCHEMA)
    return df.select(place.alias("seq"), "total", "num", "key", "payload", "ts")


def test_open_parts_go_on_in_any_number_of_batches(spark):
    rng, rows, want = random.Random(4), [], set()
    for log in range(4):
        own, following = [], []
        for i in range(240):
            if following and rng.random() < (0.4, 0.7, 0.95)[log % 3]:
                total, num, key = following.pop(0)
            else:
                total, key = rng.choice([0, 1, 2, 2, 3, 5]), rng.choice("AB") + "|" + str(rng.randrange(2))
                num = 1 if rng.random() < 0.6 else rng.randrange(1, 6)
                following = [(total, n, key) for n in range(num + 1, total + 1)]
                if rng.random() < 0.3:
                    rng.shuffle(following)
            own.append((i, total, num, key, f"{log}.{i} "))
            at = datetime.datetime(2024, 1, 1, 0, i // 20)  # a file each 20 sentences
            rows.append((at, f"/in/log{log}.{i // 20}", 0, i % 20, total, num, key, f"{log}.{i} ", at))
        want |= {p for p, _ in assembled(own)}
    everything = LO.messages_of_batch(_sentences(spark, rows), None, r"(log\d+)\.\d+$")[0].collect()
    assert {r.payload for r in everything} == want and len(everything) == len(want)
    assert [r for r in everything if r.payload.count(" ") > 1]
    for cuts in ([0, 3, 4, 12], [0, 1, 7, 8, 12]):
        got, before = [], None
        for begin, end in zip(cuts, cuts[1:]):
            part = _sentences(spark, [r for r in rows if begin <= r[0].minute < end])
            messages, still_open = LO.messages_of_batch(part, before, r"(log\d+)\.\d+$")
            got += [tuple(r) for r in messages.collect()]
            before = stage(still_open.select(*part.columns), "open")
            assert before.count() <= 4 * 4 * 5  # logs, keys, parts
        assert sorted(got) == sorted(tuple(r) for r in everything)
    alone = {r.payload for r in LO.messages_of_batch(_sentences(spark, rows), None, None)[0].collect()}
    assert alone != want  # without a pattern every file is a log of its own


def _drop(folder, name, lines, at):
    (folder / name).write_text("".join(f"{x}\n" for x in lines))
    os.utime(folder / name, (at, at))


def test_import_of_pieces_of_logs_with_restarts(spark, tmp_path):
    landing, state = tmp_path / "landing", str(tmp_path / "state")
    landing.mkdir()
    store = TB.Store(str(tmp_path / "store"))

    def run(log, store=store, state=state, files=1):
        LO.import_sentences(LO.stream_lines(spark, str(landing), files), store, state, log, FALLBACK).awaitTermination()

    pattern = r"/([a-z]+)\.\d+$"
    _drop(landing, "north.1", [POSITION, PARTS[0], ""], 1_700_000_000)
    run(pattern)
    assert not TB.table_exists(spark, store.vessels) and TB.read_positions(spark, store).count() == 1
    _drop(landing, "south.1", [PARTS[1], "# other log"], 1_700_000_100)
    run(pattern)
    assert not TB.table_exists(spark, store.vessels)  # the part belongs to another log
    _drop(landing, "north.2", ["no sentence"], 1_700_000_200)
    _drop(landing, "north.3", [PARTS[1], POSITION.replace("!AIVDM", "\\c:1714521601*00\\!AIVDM")], 1_700_000_300)
    run(pattern)
    vessel = TB.read_vessels(spark, store).collect()
    assert len(vessel) == 1 and vessel[0].vessel_name and str(vessel[0].last_seen) == FALLBACK
    assert TB.read_positions(spark, store).count() == 2
    run(pattern)
    assert TB.read_vessels(spark, store).collect() == vessel and TB.read_positions(spark, store).count() == 2

    for n, (log, found) in enumerate(((pattern, 1), (None, 0))):  # all files at once; files as logs of their own
        again = TB.Store(str(tmp_path / f"again{n}"))
        run(log, again, str(tmp_path / f"state{n}"), 100)
        assert TB.read_positions(spark, again).count() == 2
        assert (TB.read_vessels(spark, again).count() if TB.table_exists(spark, again.vessels) else 0) == found


def test_a_repeated_batch_starts_from_the_same_parts(spark, tmp_path):
    read = LO._reader(str(tmp_path), r"^(in)/", FALLBACK)

    def lines(file, values):
        place = F.struct(F.lit("2024-01-01").cast("timestamp").alias("at"), F.lit(file).alias("file"), F.lit(0).cast("long").alias("block"))
        return spark.createDataFrame([(v,) for v in values], "value string").select("value", place.alias("seq"))

    assert read(lines("in/1", PARTS[:1]), 0).count() == 0
    for _ in range(2):
        assert read(lines("in/2", PARTS[1:]), 1).count() == 1
    assert read(lines("in/3", PARTS[1:]), 2).count() == 0
    empty = N.open_parts(N.sentence_fields(LO.in_arrival_order(lines("in/4", [])), FALLBACK), F.col("seq.file"))
    assert empty.count() == 0
