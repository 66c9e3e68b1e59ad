"""Latest position per vessel, at one instant or along a series of instants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wakeline import schema as S
from wakeline.functions.scalars import MICROS, at, floor_div, from_micros, micros


def _newest(cols: list[str]) -> Column:
    """The newest row; equal times are told apart by type and place so that the result is stable."""
    return F.max_by(F.struct(*cols), F.struct("ts", "msg_type", "lon", "lat"))


def latest_per_vessel(positions: DataFrame) -> DataFrame:
    """One row per vessel. The maximum is combined before the shuffle, whatever one vessel's share."""
    cols = [c for c in positions.columns if c != "mmsi"]
    return positions.groupBy("mmsi").agg(_newest(cols).alias("_p")).select("mmsi", "_p.*").select(*positions.columns)


def snapshot_series(
    positions: DataFrame, first_tick: str, last_tick: str, step_sec: int = 300, lookback_sec: int = S.LOOKBACK_SEC
) -> DataFrame:
    """For each tick and vessel the newest position of the look-back time before the tick.

    One job instead of one query per tick. A position counts from the first tick at or after it; of all
    positions of a vessel that share this tick only the newest can ever be shown, so a combining
    aggregation leaves one row per vessel and tick. That row is shown until its look-back ends or the
    vessel's next row takes over, so each row is copied to just the ticks that show it. The window holds
    at most one row per tick of the series.
    """
    t0, t1 = micros(at(first_tick)), micros(at(last_tick))
    step, lookback = step_sec * MICROS, lookback_sec * MICROS
    cols = [c for c in positions.columns if c != "mmsi"]
    us = micros(F.col("ts"))

    # Ticks are numbered from 0; the first tick at or after a time, and the last one on or before it.
    tick_after = floor_div(us - t0 + (step - 1), step)
    last_no = floor_div(t1 - t0, step)
    entering = (
        positions.filter((F.col("ts") >= from_micros(t0 - lookback)) & (F.col("ts") <= at(last_tick)))
        .withColumn("_tick", F.greatest(tick_after, F.lit(0).cast("bigint")))
        .filter(F.col("_tick") <= last_no)
        .groupBy("mmsi", "_tick")
        .agg(_newest(cols).alias("_p"))
    )
    takes_over = F.lead("_tick").over(Window.partitionBy("mmsi").orderBy("_tick"))
    in_reach = F.least(floor_div(micros(F.col("_p.ts")) - t0 + lookback, step), last_no)
    shown = (
        entering.withColumn("_until", F.least(in_reach, takes_over - 1))
        .filter(F.col("_until") >= F.col("_tick"))
        .select("mmsi", F.explode(F.sequence(F.col("_tick"), F.col("_until"))).alias("_no"), "_p.*")
    )
    return shown.select(from_micros(t0 + F.col("_no") * step).alias("at"), "mmsi", *cols)
