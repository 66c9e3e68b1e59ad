"""Greedy thinning: keep a report when at least so many seconds passed since the last kept one.

Each decision depends on the one before, back to a vessel's first report, and one vessel may hold a
large share of all rows. So the rule is run on fixed stretches of time per vessel:

1. inside a stretch the first kept report can only be one of the few reports of its first seconds. For
   each of these candidates a fold over the stretch gives the time of the last kept report;
2. these small candidate tables (one per stretch) are composed in blocks of stretches, the blocks chained
   per vessel and their entry passed back along their stretches, which fixes the last kept row on entry to
   every stretch;
3. each stretch then picks its reports from its known entry time.

Input is validated data with one row per vessel and second, so a stretch has a fixed maximum size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wakeline import schema as S
from wakeline.functions.scalars import MICROS, floor_div, micros

# Length of a stretch: at most 21,600 rows at one row per second.
STRETCH_US = 6 * 3600 * MICROS
# Stretches chained in one row: 64 days. A century of reports has 571 such blocks.
CHAINED = 256
# Rows folded at a time when a stretch picks its rows.
BLOCK = 48


def downsample(points: DataFrame, interval_sec: int = S.DOWNSAMPLE_SEC) -> DataFrame:
    """Rows of ``points`` kept by the greedy rule, per vessel in time order."""
    return with_previous(points, interval_sec).drop("previous")


def with_previous(points: DataFrame, interval_sec: int = S.DOWNSAMPLE_SEC) -> DataFrame:
    """The kept rows, each with the kept row before it as a struct (null for a vessel's first).

    The struct has ``_us`` (time in microseconds) and all columns but ``mmsi``. It comes free with the
    rule, so that comparing neighbours needs no window over the vessel.
    """
    interval = interval_sec * MICROS
    cols = [c for c in points.columns if c != "mmsi"]
    stretches = (
        points.withColumn("_us", micros(F.col("ts")))
        .withColumn("_stretch", floor_div(F.col("_us"), STRETCH_US))
        .groupBy("mmsi", "_stretch")
        .agg(F.sort_array(F.collect_list(F.struct("_us", *cols))).alias("_rows"))
        # Stated here so that both uses below have the same plan and share one shuffle.
        .filter(F.col("mmsi").isNotNull() & F.col("_stretch").isNotNull())
    )
    row_type = stretches.schema["_rows"].dataType.elementType.simpleString()
    entries = _entries(stretches, interval, row_type)
    chosen = stretches.join(entries, ["mmsi", "_stretch"]).select(
        "mmsi", _pick(F.col("_rows"), F.col("_entry"), interval, row_type).alias("_kept")
    )
    # The outer form keeps the optimizer from evaluating the fold a second time to test for empty arrays.
    rows = chosen.select("mmsi", F.inline_outer("_kept")).filter("row is not null")
    return rows.select("mmsi", "row.*", "previous").select(*points.columns, "previous")


def _far_enough(t: Column, last: Column, interval: int) -> Column:
    return F.coalesce(t >= last["_us"] + interval, F.lit(True))


def _entries(stretches: DataFrame, interval: int, row_type: str) -> DataFrame:
    """(mmsi, _stretch, _entry): the last row kept before each stretch; null before the first."""
    rows = F.col("_rows")
    begin = F.col("_stretch") * STRETCH_US
    # A report kept earlier lies before the stretch, so it blocks less than one interval of it. After
    # validation that is at most one report per second, and the first one behind them.
    blocked = F.size(F.filter(rows, lambda r: r["_us"] < begin + interval))
    candidates = F.slice(rows, 1, blocked + 1)

    # A row that follows its neighbour by the interval is kept whatever came before: from there on all
    # candidates agree, and one is enough.
    def advance(acc: Column, r: Column) -> Column:
        moved = F.transform(acc["kept"], lambda k: F.when(r["_us"] >= k["_us"] + interval, r).otherwise(k))
        agreed = F.when(r["_us"] >= acc["before"] + interval, F.array(r)).otherwise(moved)
        return F.struct(r["_us"].alias("before"), agreed.alias("kept"))

    none_before = F.struct(F.lit(None).cast("bigint").alias("before"), candidates.alias("kept"))
    last_kept = F.aggregate(rows, none_before, advance, lambda acc: acc["kept"])
    place = F.transform(candidates, lambda r: r["_us"])
    nothing = F.lit(None).cast(row_type)
    table = F.struct("_stretch", place.alias("first"), last_kept.alias("last"), nothing.alias("through"))
    return _along(stretches.select("mmsi", table.alias("_t")), interval, row_type)


# A table says what a stretch, or a block of them, makes of the row kept before it: ``last`` is the row kept last
# if ``first`` (the times of the candidates) begins to be free at that place, ``through`` the one kept last if all
# candidates are blocked; null leaves the row that came in. A place behind the end of ``last`` means its end.


def _outcome(t: Column, entry: Column, interval: int) -> Column:
    """The row kept last after ``t``, if ``entry`` was kept last before it."""
    place = F.size(F.filter(t["first"], lambda c: ~_far_enough(c, entry, interval)))
    found = F.get(t["last"], F.least(place, F.size(t["last"]) - 1))
    return F.when(place < F.size(t["first"]), found).otherwise(F.coalesce(t["through"], entry))


def _composed(ts: Column, interval: int) -> Column:
    """One table for a block of tables in time order.

    What came in lies before the block's first stretch, and so at least a stretch before any later one, of which it
    blocks nothing: behind the first stretch it counts as no row.
    """

    def step(acc: Column, t: Column) -> Column:
        moved = F.transform(acc["last"], lambda r: _outcome(t, r, interval))
        times = F.transform(moved, lambda r: r["_us"])
        agreed = F.when(F.array_min(times) == F.array_max(times), F.slice(moved, 1, 1)).otherwise(moved)
        return F.struct(
            acc["_stretch"].alias("_stretch"),
            acc["first"].alias("first"),
            agreed.alias("last"),
            _outcome(t, acc["through"], interval).alias("through"),
        )

    return F.aggregate(F.slice(ts, 2, F.size(ts)), F.get(ts, F.lit(0)), step)


def _passed_on(ts: Column, entry: Column, interval: int, row_type: str) -> Column:
    """Array of (_stretch, _entry) for tables in time order, given the row kept before the first."""

    def step(acc: Column, t: Column) -> Column:
        here = F.struct(t["_stretch"].alias("_stretch"), acc["last"].alias("_entry"))
        return F.struct(
            _outcome(t, acc["last"], interval).alias("last"), F.concat(acc["entries"], F.array(here)).alias("entries")
        )

    none = F.array().cast(f"array<struct<_stretch:bigint,_entry:{row_type}>>")
    return F.aggregate(ts, F.struct(entry.alias("last"), none.alias("entries")), step, lambda acc: acc["entries"])


def _along(tables: DataFrame, interval: int, row_type: str) -> DataFrame:
    """(mmsi, _stretch, _entry) from (mmsi, _t): blocks of stretches are composed, the blocks of a vessel chained, and
    each block's entry then passed along its stretches. No row holds more than one block's tables, or one table
    for each block of a vessel.
    """
    blocks = (
        tables.groupBy("mmsi", floor_div(F.col("_t._stretch"), CHAINED).alias("_block"))
        .agg(F.sort_array(F.collect_list("_t")).alias("_ts"))
        .filter(F.col("mmsi").isNotNull() & F.col("_block").isNotNull())
    )
    before = F.lit(None).cast(row_type)
    whole = blocks.select("mmsi", _composed(F.col("_ts"), interval).alias("_t"))
    chained = whole.groupBy("mmsi").agg(F.sort_array(F.collect_list("_t")).alias("_bs"))
    found = chained.select("mmsi", F.inline(_passed_on(F.col("_bs"), before, interval, row_type)))
    entered = found.select("mmsi", floor_div(F.col("_stretch"), CHAINED).alias("_block"), F.col("_entry").alias("_in"))
    passed = _passed_on(F.col("_ts"), F.col("_in"), interval, row_type)
    return blocks.join(entered, ["mmsi", "_block"]).select("mmsi", F.inline(passed))


def _pick(rows: Column, entry: Column, interval: int, row_type: str) -> Column:
    """Array of the kept rows with their predecessors, given the row kept before them.

    Appending to an array copies it, so the fold works on short blocks and joins their results at the end.
    """
    blocks = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(rows) - 1) / BLOCK).cast("int")),
        lambda b: F.slice(rows, b * BLOCK + 1, F.lit(BLOCK)),
    )
    nothing = F.array().cast(f"array<struct<row:{row_type},previous:{row_type}>>")

    def keep(acc: Column, r: Column) -> Column:
        pair = F.struct(r.alias("row"), acc["last"].alias("previous"))
        taken = F.struct(r.alias("last"), F.concat(acc["kept"], F.array(pair)).alias("kept"))
        return F.when(_far_enough(r["_us"], acc["last"], interval), taken).otherwise(acc)

    def add_block(acc: Column, block: Column) -> Column:
        return F.aggregate(
            block,
            F.struct(acc["last"].alias("last"), nothing.alias("kept")),
            keep,
            lambda own: F.struct(
                own["last"].alias("last"), F.concat(acc["kept"], F.array(own["kept"])).alias("kept")
            ),
        )

    no_blocks = F.array().cast(f"array<array<struct<row:{row_type},previous:{row_type}>>>")
    start = F.struct(entry.alias("last"), no_blocks.alias("kept"))
    return F.aggregate(blocks, start, add_block, lambda acc: F.flatten(acc["kept"]))


def pre_downsample(
    points: DataFrame, arrival_block: Column, order: str = "seq", interval_sec: int = S.PRE_DOWNSAMPLE_SEC
) -> DataFrame:
    """The same rule in arrival order; reports that arrive late (older than the last kept) are dropped.

    A kept report is always newer than every report that arrived before it: what lies between two kept
    ones is less than the interval past the first. So only reports that set a new maximum time matter,
    and among those arrival order is time order. The maximum so far is taken inside blocks of the
    arrival order and carried across them; ``arrival_block`` must grow with ``order`` (a file split, or
    a range of the key).
    """
    rows = points.withColumn("_block", arrival_block).withColumn("_us", micros(F.col("ts")))
    inside = Window.partitionBy("mmsi", "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy("mmsi").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        rows.groupBy("mmsi", "_block")
        .agg(F.max("_us").alias("_block_max"))
        .select("mmsi", "_block", F.max("_block_max").over(across).alias("_before_block"))
    )
    so_far = F.greatest(F.max("_us").over(inside), F.col("_before_block"))
    records = (
        rows.join(carried, ["mmsi", "_block"])
        .withColumn("_so_far", so_far)
        .filter(F.col("_so_far").isNull() | (F.col("_us") > F.col("_so_far")))
    )
    return downsample(records.select(*points.columns), interval_sec)
