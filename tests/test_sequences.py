"""Thinning and segmentation against the sequential rules, on data made to cross every chunk border."""

import random
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F
from sequential import SECOND, keep_spaced, segment_starts

from wakeline.functions.scalars import floor_div
from wakeline.operators.downsample import downsample, pre_downsample, with_previous
from wakeline.operators.segments import segment_points
from wakeline.operators.tracks import build_tracks, track_summary, tracks_from_points

T0 = int(datetime(2024, 3, 1, tzinfo=timezone.utc).timestamp()) * SECOND
MMSI = 219_000_001


def times_of(rng, count, steps):
    """Increasing times with one row per second at most."""
    us, out = T0 + rng.randrange(86_400) * SECOND, []
    for _ in range(count):
        us += int(rng.choice(steps) * SECOND) + rng.choice([0, 0, rng.randrange(-400_000, 400_000)])
        out.append(us)
    seen, kept = set(), []
    for us in sorted(out):
        if us // SECOND not in seen:
            seen.add(us // SECOND)
            kept.append(us)
    return kept


def frame(spark, rows):
    """rows: (mmsi, us, lon, lat, sog, nav_status, seq), spread over partitions in random order."""
    rows = list(rows)
    random.Random(3).shuffle(rows)
    df = spark.createDataFrame(
        rows, "mmsi bigint, us bigint, lon double, lat double, sog float, nav_status int, seq bigint"
    )
    return df.withColumn("ts", F.timestamp_micros("us")).drop("us")


@pytest.fixture(scope="module")
def vessels():
    """Vessels that report densely over several stretches and days, and others that report seldom."""
    rng = random.Random(11)
    step_sets = [
        [2], [1, 2, 3], [7], [10], [9, 10, 11], [3, 9.5, 31], [60], [170, 190], [300], [600, 1200],
        [1799, 1800, 1801], [5, 20, 1800, 21_600, 21_601], [3_600, 21_600, 21_599, 21_601, 50_000],
    ]
    out = {}
    for i, steps in enumerate(step_sets * 3):
        mean = sum(steps) / len(steps)
        out[MMSI + i] = times_of(rng, int(min(9_000, max(40, 150_000 / mean))), steps)
    return out


def test_thinning_matches_the_sequential_rule(spark, vessels):
    rows = [(m, us, 1.0, 2.0, None, None, i) for m, ts in vessels.items() for i, us in enumerate(ts)]
    kept = downsample(frame(spark, rows)).select("mmsi", F.unix_micros("ts").alias("us")).collect()
    want = {(m, ts[i]) for m, ts in vessels.items() for i in keep_spaced(ts, 10)}
    assert {(r.mmsi, r.us) for r in kept} == want
    assert len(kept) == len(want)


def test_thinning_of_long_histories(spark):
    """Vessels of 20 000 stretches: blocks of stretches, gaps longer than a block, stretches wholly blocked at a border."""
    rng = random.Random(31)
    block = 64 * 86_400
    dense = [T0 + int(i * 21_600 * SECOND) + d * SECOND for i in range(20_000) for d in (-4, 3)]
    uneven, at = [], T0
    for _ in range(4_000):
        at += rng.choice([4, 9, 10, 21_593, 21_600, 86_400, block, 3 * block - 5]) * SECOND
        uneven.append(at)
    border = (T0 // SECOND // block + 1) * block
    edges = [(border + n * block + d) * SECOND for n in range(60) for d in rng.sample(range(-25, 25), 6)]
    long = {MMSI: dense, MMSI + 1: uneven, MMSI + 2: sorted(set(edges)), MMSI + 3: [-9 * SECOND, -1 * SECOND, 8 * SECOND]}
    rows = [(m, us, 1.0, 2.0, None, None, i) for m, ts in long.items() for i, us in enumerate(ts)]
    for interval in (10, 60):
        kept = downsample(frame(spark, rows), interval).select("mmsi", F.unix_micros("ts").alias("us")).collect()
        want = {(m, ts[i]) for m, ts in long.items() for i in keep_spaced(ts, interval)}
        assert {(r.mmsi, r.us) for r in kept} == want
        assert len(kept) == len(want)


def test_a_mooring_of_many_days(spark):
    """A slow run over 300 days, with a count open over every midnight."""
    times = [T0 + i * 1_500 * SECOND + (i % 7) * SECOND for i in range(17_000)]
    rows = [(MMSI, us, 1.0, 2.0, 0.1, 5, i) for i, us in enumerate(times)]
    got = segment_points(with_previous(frame(spark, rows)))
    got = got.select(F.unix_micros("ts").alias("us"), F.unix_micros("segment_start").alias("start")).collect()
    assert {(r.us, r.start) for r in got} == set(segment_starts([(us, 0.1, 5) for us in times]))


def test_thinning_in_arrival_order(spark, vessels):
    rng = random.Random(5)
    rows, want = [], set()
    for m, ts in vessels.items():
        arrival = sorted(ts, key=lambda us: us + rng.randrange(0, 4_000) * SECOND)
        rows += [(m, us, 1.0, 2.0, None, None, i) for i, us in enumerate(arrival)]
        want |= {(m, arrival[i]) for i in keep_spaced(arrival, 60)}
    kept = pre_downsample(frame(spark, rows), floor_div(F.col("seq"), 97)).select("mmsi", F.unix_micros("ts").alias("us"))
    got = kept.collect()
    assert {(r.mmsi, r.us) for r in got} == want
    assert len(got) == len(want)


def test_segments_match_the_sequential_rule(spark, vessels):
    rng = random.Random(23)
    rows, want = [], set()
    for n, (m, ts) in enumerate(vessels.items()):
        # From almost always moored (runs over many days) to changing all the time.
        p_fast, p_status = [(0.0, 0.0), (0.0005, 0.0), (0.01, 0.002), (0.2, 0.02)][n % 4]
        status, points = 0, []
        for us in [ts[i] for i in keep_spaced(ts, 10)]:
            status = rng.choice([0, 1, 5, None]) if rng.random() < p_status else status
            sog = rng.choice([None, 0.5, 7.5]) if rng.random() < p_fast else rng.choice([0.0, 0.1, 0.4])
            points.append((us, sog, status))
        rows += [(m, us, 1.0, 2.0, sog, st, i) for i, (us, sog, st) in enumerate(points)]
        want |= {(m, us, start) for us, start in segment_starts(points)}
    points = segment_points(with_previous(frame(spark, rows)))
    got = points.select("mmsi", F.unix_micros("ts").alias("us"), F.unix_micros("segment_start").alias("start")).collect()
    assert {(r.mmsi, r.us, r.start) for r in got} == want
    assert len(got) == len(want)


# --- hand-made cases ------------------------------------------------------------------------------


def points(spark, *rows, mmsi=MMSI):
    """rows: (seconds, sog, nav_status)."""
    return frame(
        spark, [(mmsi, T0 + int(s * SECOND), 10.0 + i / 100, 55.0, sog, st, i) for i, (s, sog, st) in enumerate(rows)]
    )


def tracks(spark, *rows):
    return build_tracks(points(spark, *rows)).orderBy("start_time").collect()


def sizes(spark, *rows):
    return [t.point_count for t in tracks(spark, *rows)]


def test_one_track(spark):
    assert sizes(spark, (0, 5.0, 0), (60, 5.0, 0), (120, 5.0, 0)) == [3]


def test_single_point_gives_no_track(spark):
    summary = track_summary(points(spark, (0, 5.0, 0))).head()
    assert (summary.input_positions, summary.tracks, summary.skipped_single_point) == (1, 0, 1)


def test_gap_over_six_hours_cuts_and_exactly_six_does_not(spark):
    six = 6 * 3600
    assert sizes(spark, (0, 5.0, 0), (60, 5.0, 0), (60 + six + 1, 5.0, 0), (120 + six + 1, 5.0, 0)) == [2, 2]
    assert sizes(spark, (0, 5.0, 0), (60, 5.0, 0), (60 + six, 5.0, 0), (120 + six, 5.0, 0)) == [4]


@pytest.mark.parametrize("before, after, want", [(0, 5, 2), (1, 0, 2), (5, 5, 1), (None, None, 1), (1, 5, 1)])
def test_status_change(spark, before, after, want):
    rows = [(0, 5.0, before), (60, 5.0, before), (120, 5.0, after), (180, 5.0, after)]
    assert len(sizes(spark, *rows)) == want


def test_port_call(spark):
    fast = [(i * 60, 8.0, 0) for i in range(3)]

    def slow(count, span):
        return [(1000 + i * span / (count - 1), 0.1, 0) for i in range(count)]

    assert sizes(spark, *fast, *slow(6, 1801)) == [3, 6]
    assert sizes(spark, *fast, *slow(6, 1799)) == [9]
    assert sizes(spark, *fast, *slow(5, 1920)) == [8]


def test_long_mooring_is_cut_again_and_again(spark):
    # Seven points reach half an hour; counting starts anew behind each cut's last point.
    rows = [(i * 300, 0.0, 0) for i in range(28)]
    assert sizes(spark, *rows) == [7, 7, 7, 7]


def test_points_closer_than_ten_seconds(spark):
    summary = track_summary(points(spark, (0, 5.0, 0), (5, 5.0, 0), (20, 5.0, 0))).head()
    assert (summary.input_positions, summary.downsampled_positions, summary.tracks) == (3, 1, 1)


def test_track_values(spark):
    (track,) = tracks(spark, (120, 30.0, 0), (0, 10.0, 0), (60, 20.0, 0))
    assert track.avg_sog == 20.0
    assert track.voyage_id == f"{MMSI}_{T0 // SECOND}"
    assert [round(p.lon, 2) for p in track.path] == [10.01, 10.02, 10.0]
    assert (track.min_lon, track.max_lon, track.min_lat, track.max_lat) == (10.0, 10.02, 55.0, 55.0)


def test_mean_speed_drops_fractions_and_may_be_absent(spark):
    (track,) = tracks(spark, (0, 8.9, 0), (60, 8.9, 0))
    assert track.avg_sog == 8.0
    assert track.avg_sog_exact == pytest.approx(8.9, abs=1e-6)
    (track,) = tracks(spark, (0, None, 0), (60, None, 0))
    assert track.avg_sog is None


def test_vessels_do_not_mix(spark):
    both = points(spark, (0, 5.0, 0), (60, 5.0, 0)).unionByName(points(spark, (30, 5.0, 0), (90, 5.0, 0), mmsi=MMSI + 1))
    assert sorted(t.mmsi for t in build_tracks(both).collect()) == [MMSI, MMSI + 1]


def test_no_points(spark):
    assert tracks_from_points(segment_points(with_previous(points(spark, (0, 5.0, 0)).limit(0)))).collect() == []
