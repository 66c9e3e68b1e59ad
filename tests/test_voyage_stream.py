"""Streamed tracks: state per vessel against the batch rules, for any batches, late reports and restarts."""

import random

import pytest
import sequential
from pyspark.sql import Row
from pyspark.sql import functions as F

from wakeline import schema as S
from wakeline.functions.scalars import micros
from wakeline.operators.tracks import build_tracks
from wakeline.plans.rendering import PLAIN_HEADER
from wakeline.sources import tables as TB
from wakeline.streaming import incremental as ST
from wakeline.streaming import voyages as VO


def test_state_follows_the_sequential_rules():
    draw = random.Random(4)
    for _ in range(200):
        us, points = 1_700_000_000_000_000, []
        for _ in range(draw.randint(1, 120)):
            us += draw.choice([3, 8, 10, 11, 60, 290, 700, 22_000]) * 1_000_000 + draw.randint(0, 999) * 1000
            points.append((us, draw.choice([0.1, 0.1, 0.2, 4.0, None]), draw.choice([0, 0, 0, 0, 5])))
        kept = [points[i] for i in sequential.keep_spaced([p[0] for p in points], 10)]
        want = dict(sequential.segment_starts(kept))
        saved, given = None, {}
        while points:  # batches of any size, the state being saved between them
            voyage = VO.Voyage(saved)
            size = draw.randint(1, 40)
            for us, sog, status in points[:size]:
                voyage.take(us, 55.0, 11.0, sog is not None and sog < 0.5, status in (1, 5), "")
            points, saved = points[size:], voyage.saved()
            given |= voyage.points
            assert len(voyage.run) <= 187
        assert {us: p[2] for us, p in given.items()} == want
        assert {us for us, p in given.items() if p[5] is None} == {us for us, start in want.items() if us == start}


class _State:
    """Counts the calls to the state of one vessel."""

    def __init__(self):
        self.value, self.timers, self.calls = None, set(), []

    def getValueState(self, *_):  # noqa: N802
        return self

    def exists(self):
        self.calls.append("exists")
        return self.value is not None

    def get(self):
        self.calls.append("get")
        return self.value

    def update(self, value):
        self.calls.append("update")
        self.value = value

    def listTimers(self):  # noqa: N802
        self.calls.append("list")
        return list(self.timers)

    def deleteTimer(self, at):  # noqa: N802
        self.calls.append("delete")
        self.timers.remove(at)

    def registerTimer(self, at):  # noqa: N802
        self.calls.append("register")
        self.timers.add(at)

    def getCurrentProcessingTimeInMs(self):  # noqa: N802
        return 1_000 * len(self.calls)


def test_a_vessel_costs_a_few_calls_to_its_state_in_a_batch():
    """Most vessels have few reports in a batch, so the time of a batch is that of these calls."""
    state = _State()
    processor = VO.VoyageProcessor()
    processor.init(state)
    report = Row("us", "lat", "lon", "sog", "nav_status", "payload", "at", "file", "block", "row")

    def batch(*rows):
        state.calls.clear()
        return [r.asDict() for r in processor.handleInputRows((5,), iter(rows), state)]

    start = 1_700_000_000_000_000
    at = [report(start + s * 1_000_000, 55.0, 11.0, 4.0, None, str(s), 1, "a", 0, -s) for s in (0, 60, 60, 30)]
    first = report(*at[2][:5], "first", *at[2][6:9], -99)
    out = batch(at[0], at[1], first, at[3])
    assert [(r["kind"], r["payload"]) for r in out if r["kind"] == "position"] == [("position", "0"), ("position", "30"), ("position", "first")]
    assert len([r for r in out if r["kind"] == "point"]) == 3 and all(r["segment_us"] == start for r in out if r["kind"] == "point")
    assert len(state.calls) <= 3 and len(state.timers) == 1
    late = report(start + 1, 55.0, 11.0, None, None, "late", 2, "b", 0, 0)
    out = batch(late, report(start + 90_000_000, 55.0, 11.0, None, 5, "90", 2, "b", 0, 1))
    assert [r["kind"] for r in out] == ["late", "position", "point"] and len(state.timers) == 1
    assert sorted(state.calls) == ["delete", "get", "register", "update"]
    assert batch(late)[0]["kind"] == "late" and state.calls == ["get"]
    # A state saved before the timer was kept with it: the timers are listed once.
    newest, saved = state.value
    state.value = newest, saved.rsplit(",", 1)[0] + "]"
    batch(report(start + 120_000_000, 55.0, 11.0, 4.0, 0, "120", 3, "c", 0, 0))
    assert "list" in state.calls and len(state.timers) == 1


def _line(mmsi, second, sog=5.0, status=0, lat=55.0):
    day, rest = divmod(second, 86_400)
    return f"{mmsi},2024-03-{day + 1:02d}T{rest // 3600:02d}:{rest % 3600 // 60:02d}:{rest % 60:02d}Z,{lat},11,{sog},6,7,{status},0,1"


def _drop(landing, name, lines):
    (landing / name).write_text(PLAIN_HEADER + "\n" + "".join(f"{x}\n" for x in lines))


def _run(spark, tmp_path, files=1, **options):
    store, state = TB.Store(str(tmp_path / "store")), str(tmp_path / "state")
    parsed = ST.stream_csv(spark, str(tmp_path / "landing"), PLAIN_HEADER, files)
    VO.import_voyages(parsed, store, state, **options).awaitTermination()
    return store, state


def _same_as_batch(spark, store, state):
    want = build_tracks(TB.read_positions(spark, store).select(*S.POSITION_COLS))
    got = VO.tracks(spark, state)
    rows = [sorted(tuple(r) for r in t.drop("avg_sog_exact", "distance_nm").collect()) for t in (got, want)]
    assert rows[0] == rows[1]
    legs = [dict((r.voyage_id, r.distance_nm) for r in t.collect()) for t in (got, want)]
    assert legs[0] == pytest.approx(legs[1])
    return len(rows[0])


def test_late_reports_and_restarts(spark, tmp_path):
    (tmp_path / "landing").mkdir()
    draw = random.Random(6)

    def voyage(mmsi, begin, n):
        at = begin
        for i in range(n):
            at += draw.choice([4, 30, 400, 500])
            yield _line(mmsi, at, sog=0.1 if i % 40 > 15 else 6.5, status=5 if i % 70 > 60 else 0, lat=55 + i / 100)

    first, second = list(voyage(219000001, 0, 150)), list(voyage(219000002, 0, 150))
    _drop(tmp_path / "landing", "1.csv", [*first[:60], *second[:60][::-1], _line(219000003, 20 * 86_400), _line(99, 5)])
    _run(spark, tmp_path)
    # On in time; repeats of old reports with other values; a clock that ran ahead concerns its vessel only.
    again = [x.replace(",55.", ",54.") for x in second[10:20]]
    _drop(tmp_path / "landing", "2.csv", [*first[60:100], *second[60:100], *again, _line(219000003, 100)])
    store, state = _run(spark, tmp_path)
    late = spark.read.parquet(f"{state}/late-vessels")
    assert {r.mmsi for r in late.collect()} == {219000003}
    assert _same_as_batch(spark, store, state) > 2
    # New reports of the past: within what was thinned, and in a gap.
    _drop(tmp_path / "landing", "3.csv", [_line(219000001, 7, lat=55.5), *first[100:120], *second[100:]])
    _drop(tmp_path / "landing", "4.csv", [*first[120:], _line(219000003, 200), _line(219000003, 20 * 86_400 + 60)])
    store, state = _run(spark, tmp_path)
    late = spark.read.parquet(f"{state}/late-vessels")
    assert {r.mmsi for r in late.collect()} == {219000001, 219000003}
    built = _same_as_batch(spark, store, state)
    assert VO.ended_voyages(spark, state).count() == 0

    # All files at once give the same.
    (tmp_path / "again").mkdir()
    (tmp_path / "again" / "landing").symlink_to(tmp_path / "landing")
    store, state = _run(spark, tmp_path / "again", files=100)
    assert not spark.read.parquet(f"{state}/late-vessels").count() and _same_as_batch(spark, store, state) == built


def test_earliest_of_a_file_stays_and_silence_ends_a_voyage(spark, tmp_path):
    (tmp_path / "landing").mkdir()
    lines = [_line(219000001, s, sog=s) for s in (0, 20, 40)] + [_line(219000001, 20, sog=9)]
    _drop(tmp_path / "landing", "1.csv", lines)
    _run(spark, tmp_path, silence_ms=0)
    _drop(tmp_path / "landing", "2.csv", [_line(219000002, 0), _line(219000002, 30)])  # by then the first is silent
    store, state = _run(spark, tmp_path, silence_ms=0)
    assert [r.sog for r in TB.read_positions(spark, store).where("mmsi = 219000001").orderBy("ts").collect()] == [0.0, 20.0, 40.0]
    ended = VO.ended_voyages(spark, state)
    assert 219000001 in {r.mmsi for r in ended.collect()}
    _drop(tmp_path / "landing", "3.csv", [_line(219000001, 60)])  # goes on after all
    store, state = _run(spark, tmp_path)
    assert _same_as_batch(spark, store, state) == 2
    counts = {r.mmsi: r.point_count for r in VO.tracks(spark, state).collect()}
    assert counts == {219000001: 4, 219000002: 2}
    assert 219000001 not in {r.mmsi for r in VO.ended_voyages(spark, state).collect()}
    assert TB.read_positions(spark, store).select(F.max(micros(F.col("ts")))).first()[0] is not None


def test_a_repeated_batch_changes_nothing(spark, tmp_path, monkeypatch):
    """The write of the points fails once, after the positions are stored; the batch is run again."""
    (tmp_path / "landing").mkdir()
    _drop(tmp_path / "landing", "1.csv", [_line(219000001, s) for s in range(100, 400, 20)])
    _run(spark, tmp_path)
    _drop(tmp_path / "landing", "2.csv", [_line(219000001, s) for s in range(0, 500, 25)])
    write, failed = VO._write, []

    def breaks(rows, path, number):
        if path.endswith("/points") and not failed:
            failed.append(path)
            raise OSError("disk")
        write(rows, path, number)

    monkeypatch.setattr(VO, "_write", breaks)
    with pytest.raises(Exception, match="disk"):
        _run(spark, tmp_path)
    store, state = _run(spark, tmp_path)
    assert failed and _same_as_batch(spark, store, state) == 1
    assert {r.mmsi for r in spark.read.parquet(f"{state}/late-vessels").collect()} == {219000001}
