"""Cutting each vessel's thinned points into voyage segments.

Three rules start a new segment: a gap of more than six hours, a change between stationary and moving
status, and a port call (a run of slow points that has lasted long enough is cut off at its start, again
and again while it goes on). The rules look back along a vessel's whole history, so as in
``downsample`` the rows are handled per vessel and day, and only one small record per vessel and day is
passed along the vessel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wakeline import schema as S
from wakeline.functions.scalars import MICROS, floor_div, from_micros, micros
from wakeline.functions.spatial import haversine_nm
from wakeline.session import stage

DAY_US = 86_400 * MICROS
HOLD_US = S.PORT_CALL_SEC * MICROS
# A slow run is cut at most every half hour, so a walk over the cuts of one day ends within this many steps.
STEPS_PER_DAY = 86_400 // S.PORT_CALL_SEC + 1
# Days of a run chained at a time.
BLOCK = 64



def _in_day():
    return Window.partitionBy("mmsi", "_day").orderBy("_us")


def _in_day_so_far():
    return _in_day().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _over_days():
    """Along a vessel's days, on data with one small row per vessel and day."""
    return Window.partitionBy("mmsi").orderBy("_day")


def segment_points(points: DataFrame) -> DataFrame:
    """Thinned points (``downsample.with_previous``) with their cut flags and segment start time.

    Adds ``gap_cut``, ``status_cut``, ``port_call_cut``, ``segment_start`` and ``leg_nm``, the distance
    from the previous point of the same segment (0 for its first).
    """
    flagged = stage(_flag_gaps_and_status(points), "flagged")
    cuts = stage(_port_call_cuts(flagged), "cuts")
    cut = F.coalesce(F.array_contains("_cuts", F.col("_us")), F.lit(False))
    rows = (
        flagged.join(cuts, ["mmsi", "_day"], "left")
        .withColumn("port_call_cut", cut)
        .withColumn("_begins", F.col("_split") | F.col("port_call_cut"))
        .drop("_cuts")
    )
    kept = [c for c in points.columns if c != "previous"]
    added = ["gap_cut", "status_cut", "port_call_cut", "segment_start", "leg_nm"]
    return _carry_segment_start(rows).select(*kept, *added)


def _still(nav_status: Column) -> Column:
    return F.coalesce(nav_status.isin(S.STATIONARY_STATUS), F.lit(False))


def _slow(sog: Column) -> Column:
    return F.coalesce(sog < F.lit(S.PORT_CALL_SOG).cast("float"), F.lit(False))


def _flag_gaps_and_status(points: DataFrame) -> DataFrame:
    here, before = F.col, lambda c: F.col(f"previous.{c}")
    us = micros(here("ts"))
    gap = F.coalesce(floor_div(us - before("_us"), MICROS) > S.GAP_SEC, F.lit(False))
    first = here("previous").isNull()
    status = ~first & (_still(before("nav_status")) != _still(here("nav_status")))
    # A slow run begins at a slow point that does not continue one.
    run_begins = here("_slow") & (here("_split") | ~_slow(before("sog")))
    return (
        points.withColumns({"_us": us, "_day": floor_div(us, DAY_US), "gap_cut": gap, "_slow": _slow(here("sog"))})
        .withColumn("status_cut", status & ~here("gap_cut"))
        .withColumn("_split", first | here("gap_cut") | here("status_cut"))
        .withColumn("_run_begins", run_begins)
        .withColumn("_leg", haversine_nm(before("lat"), before("lon"), here("lat"), here("lon")))
        .drop("previous")
    )


# --- port calls -----------------------------------------------------------------------------------
#
# A run is a maximal stretch of slow points without a split. Within a run, counting starts at its first
# point; once there are six points over half an hour, the run is cut at the point where counting
# started, and counting starts anew at the next point. "Piece" is the part of a run inside one day. A
# piece holds its points as an array of (_us, next): ``next`` is the 1-based place where counting
# restarts if it started at this point; a value of n + 2 or more means no cut inside the piece.


def _port_call_cuts(flagged: DataFrame) -> DataFrame:
    """(mmsi, _day, _cuts): times at which a port call cuts, one array per vessel and day."""
    pieces = _slow_pieces(flagged)
    brought_in = _open_counts(pieces).select("mmsi", "_day", F.lit(0).cast("bigint").alias("_run"), "_open")
    open_count = F.coalesce("_open", _no_count())
    cut_times = F.explode(_cuts_of_piece(F.col("_pts"), open_count)).alias("_cut")
    return (
        pieces.join(brought_in, ["mmsi", "_day", "_run"], "left")
        .select("mmsi", cut_times)
        .groupBy("mmsi", floor_div(F.col("_cut"), DAY_US).alias("_day"))
        .agg(F.collect_set("_cut").alias("_cuts"))
    )


def _slow_pieces(flagged: DataFrame) -> DataFrame:
    """(mmsi, _day, _run, _pts); ``_run`` is 0 for a piece that continues a run of an earlier day."""
    piece = Window.partitionBy("mmsi", "_day", "_run").orderBy("_us")
    place = F.row_number().over(piece)
    within_hold = F.count("*").over(piece.rangeBetween(Window.unboundedPreceding, HOLD_US - 1))
    slow = (
        flagged.select("mmsi", "_day", "_us", "_slow", "_run_begins")
        .withColumn("_run", F.sum(F.col("_run_begins").cast("int")).over(_in_day_so_far()))
        .filter("_slow")
    )
    numbered = slow.withColumn("next", F.greatest(within_hold + 1, place + (S.PORT_CALL_POINTS - 1)).cast("int") + 1)
    return numbered.groupBy("mmsi", "_day", "_run").agg(
        F.sort_array(F.collect_list(F.struct("_us", "next"))).alias("_pts")
    )


_OPEN = "struct<since:bigint,points:int>"


def _no_count() -> Column:
    return F.struct(F.lit(None).cast("bigint").alias("since"), F.lit(0).alias("points"))


def _next_start(pts: Column, place: Column) -> Column:
    return F.get(pts, place - 1)["next"]


def _walk(pts: Column, begin: Column) -> Column:
    """Places where counting starts, from ``begin`` on; empty if that lies behind the piece."""
    steps = F.sequence(F.lit(1), F.lit(STEPS_PER_DAY))

    def step(starts: Column, _: Column) -> Column:
        following = _next_start(pts, F.element_at(starts, -1))
        return F.when(following <= F.size(pts), F.concat(starts, F.array(following))).otherwise(starts)

    return F.when(begin <= F.size(pts), F.aggregate(steps, F.array(begin), step)).otherwise(
        F.array().cast("array<int>")
    )


def _count_left_open(pts: Column, begin: Column) -> Column:
    """Start time and number of points of the count still open at the end, if counting starts at ``begin``."""
    steps = F.sequence(F.lit(1), F.lit(STEPS_PER_DAY))

    def step(place: Column, _: Column) -> Column:
        following = _next_start(pts, place)
        return F.when(following <= F.size(pts), following).otherwise(place)

    def outcome(last: Column) -> Column:
        since = F.get(pts, last - 1)["_us"]
        still_open = F.struct(since.alias("since"), (F.size(pts) - last + 1).alias("points"))
        return F.when(_next_start(pts, last) == F.size(pts) + 1, _no_count()).otherwise(still_open)

    return F.aggregate(steps, begin, step, outcome)


def _closing_place(times: Column, open_count: Column) -> Column:
    """Place of the point that completes a count brought in from before; 0 if there is none."""
    after_hold = F.size(F.filter(times, lambda t: t < open_count["since"] + HOLD_US)) + 1
    closing = F.greatest(after_hold, S.PORT_CALL_POINTS - open_count["points"])
    return F.when(open_count["since"].isNull(), 0).otherwise(closing).cast("int")


def _open_counts(pieces: DataFrame) -> DataFrame:
    """(mmsi, _day, _open): the count brought into each continued piece.

    Whatever was open before, counting first starts among the points of a piece's first half hour (or
    its first seven). For these places the outcome is worked out inside the piece; chaining the outcomes
    along the run needs no other points.
    """
    pts = F.col("_pts")
    times = F.transform(pts, lambda p: p["_us"])
    begin = F.get(pts, F.lit(0))["_us"]
    in_hold = F.size(F.filter(pts, lambda p: p["_us"] < begin + HOLD_US))
    head = F.when(F.col("_run") == 0, F.greatest(in_hold + 2, F.lit(S.PORT_CALL_POINTS + 1))).otherwise(1)
    head = F.least(head, F.size(pts))
    day_end = F.max("_run").over(Window.partitionBy("mmsi", "_day"))
    tables = pieces.withColumn("_day_end", day_end).filter("_run = 0 or _run = _day_end").select(
        "mmsi",
        "_day",
        "_run",
        F.struct(
            "_day",
            "_run",
            F.size(pts).alias("n"),
            F.slice(times, 1, head).alias("times"),
            F.transform(F.sequence(F.lit(1), head), lambda begin: _count_left_open(pts, begin)).alias("left"),
        ).alias("_t"),
        F.when(F.col("_run") > 0, begin).alias("_begin"),
    )
    along = Window.partitionBy("mmsi").orderBy("_day", "_run").rowsBetween(Window.unboundedPreceding, 0)
    runs = (
        tables.withColumn("_run_id", F.last("_begin", ignorenulls=True).over(along))
        .groupBy("mmsi", "_run_id")
        .agg(F.sort_array(F.collect_list(F.struct("_t"))).alias("_ts"))
        .filter(F.size("_ts") > 1)
    )

    def step(acc: Column, item: Column) -> Column:
        t, now = item["_t"], acc["open"]
        closing = _closing_place(t["times"], now)
        longer = F.struct(now["since"].alias("since"), (now["points"] + t["n"]).alias("points"))
        # Place closing + 1 starts the next count; behind the piece there is nothing open.
        then = F.coalesce(F.get(t["left"], closing), _no_count())
        after = F.when(now["since"].isNotNull() & (closing > t["n"]), longer).otherwise(then)
        entry = F.struct(t["_day"].alias("_day"), t["_run"].alias("_run"), now.alias("_open"))
        return F.struct(after.alias("open"), F.concat(acc["entries"], F.array(entry)).alias("entries"))

    entry_type = f"struct<_day:bigint,_run:bigint,_open:{_OPEN}>"
    none = F.array().cast(f"array<{entry_type}>")

    # Appending copies an array, so entries are gathered in short blocks, joined at the end.
    def add_block(acc: Column, block: Column) -> Column:
        return F.aggregate(
            block,
            F.struct(acc["open"].alias("open"), none.alias("entries")),
            step,
            lambda own: F.struct(
                own["open"].alias("open"), F.concat(acc["blocks"], F.array(own["entries"])).alias("blocks")
            ),
        )

    blocks = F.transform(
        F.sequence(F.lit(0), F.floor((F.size("_ts") - 1) / BLOCK).cast("int")),
        lambda b: F.slice("_ts", b * BLOCK + 1, F.lit(BLOCK)),
    )
    start = F.struct(_no_count().alias("open"), F.array().cast(f"array<array<{entry_type}>>").alias("blocks"))
    chained = F.aggregate(blocks, start, add_block, lambda acc: F.flatten(acc["blocks"]))
    entries = runs.select("mmsi", F.inline(chained))
    return entries.filter("_run = 0").select("mmsi", "_day", "_open")


def _cuts_of_piece(pts: Column, open_count: Column) -> Column:
    """Cut times decided in this piece; the first may lie on an earlier day, where the count began."""
    closing = _closing_place(F.transform(pts, lambda p: p["_us"]), open_count)
    brought_in = F.when((closing > 0) & (closing <= F.size(pts)), F.array(open_count["since"]))
    done = F.filter(_walk(pts, closing + 1), lambda i: F.get(pts, i - 1)["next"] <= F.size(pts) + 1)
    own = F.transform(done, lambda i: F.get(pts, i - 1)["_us"])
    return F.concat(F.coalesce(brought_in, F.array().cast("array<bigint>")), own)


# --- segments -------------------------------------------------------------------------------------


def _carry_segment_start(rows: DataFrame) -> DataFrame:
    begin = F.when(F.col("_begins"), F.col("_us"))
    earlier = _over_days().rowsBetween(Window.unboundedPreceding, -1)
    by_day = rows.groupBy("mmsi", "_day").agg(F.max(begin).alias("_day_begin"))
    carried = by_day.select(
        "mmsi", "_day", F.last("_day_begin", ignorenulls=True).over(earlier).alias("_carried_begin")
    )
    newest_begin = F.last(begin, ignorenulls=True).over(_in_day_so_far())
    return (
        rows.withColumn("_in_day", newest_begin)
        .join(carried, ["mmsi", "_day"])
        .withColumn("segment_start", from_micros(F.coalesce("_in_day", "_carried_begin")))
        .withColumn("leg_nm", F.when(F.col("_begins"), 0.0).otherwise(F.col("_leg")))
    )
