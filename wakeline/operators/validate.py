"""Validation rules and keep-first removal of repeated reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wakeline import schema as S
from wakeline.functions.scalars import epoch_second


def reject_reason() -> Column:
    """The first rule a position breaks, or null.

    Spark orders NaN above every number, so a NaN coordinate fails the upper bound; a NaN speed has to
    be let through by hand.
    """
    mmsi, lat, lon, sog = (F.col(c) for c in ("mmsi", "lat", "lon", "sog"))
    return (
        F.when(~F.coalesce(mmsi.between(S.MMSI_MIN, S.MMSI_MAX), F.lit(False)), "mmsi")
        .when(~F.coalesce(lat.between(-90, 90) & lon.between(-180, 180), F.lit(False)), "coords")
        .when((lat == 0) & (lon == 0), "null_island")
        .when(~F.isnan(sog) & (sog.cast("double") > S.MAX_SOG), "sog")
    )


def accepted(positions: DataFrame) -> DataFrame:
    """Positions that pass all rules; repeats are still in."""
    return positions.filter(reject_reason().isNull())


def keep_first(positions: DataFrame, order: str = "seq") -> DataFrame:
    """One row per vessel and second: the earliest in arrival order.

    Written as an aggregation, not a window: rows are combined before the shuffle, and the key holds
    the second, so neither a busy vessel nor one endlessly repeated report lands in one task.
    """
    cols = [c for c in positions.columns]
    return (
        positions.withColumn("_second", epoch_second(F.col("ts")))
        .groupBy("mmsi", "_second")
        .agg(F.min_by(F.struct(*[c for c in cols if c != "mmsi"]), F.col(order)).alias("_row"))
        .select("mmsi", "_row.*")
        .select(*cols)
    )


def clean(positions: DataFrame, order: str = "seq") -> DataFrame:
    return keep_first(accepted(positions), order)


# Statistic names in report order.
REASONS = ["mmsi", "coords", "null_island", "sog"]


def validation_statistics(positions: DataFrame) -> DataFrame:
    """One row: total, accepted, and the count of each reject reason.

    A first aggregation by reason, vessel and second shrinks the data; repeats are what the accepted
    keys count beyond one.
    """
    per_key = (
        positions.withColumn("_reason", reject_reason())
        .groupBy(
            "_reason",
            F.when(F.col("_reason").isNull(), F.col("mmsi")).alias("_key_mmsi"),
            F.when(F.col("_reason").isNull(), epoch_second(F.col("ts"))).alias("_key_second"),
        )
        .agg(F.count("*").alias("_n"))
    )
    rejected = [F.sum(F.when(F.col("_reason") == r, F.col("_n")).otherwise(0)).alias(f"rejected_{r}") for r in REASONS]
    keys = F.count_if(F.col("_reason").isNull())
    rows = F.sum(F.when(F.col("_reason").isNull(), F.col("_n")).otherwise(0))
    return per_key.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("total"),
        keys.alias("accepted"),
        *[F.coalesce(c, F.lit(0)).alias(f"rejected_{r}") for c, r in zip(rejected, REASONS)],
        (F.coalesce(rows, F.lit(0)) - keys).alias("duplicates"),
    )


def reason_counts(positions: DataFrame) -> DataFrame:
    """The same statistics as (reason, rows) lines; reasons that do not occur are left out."""
    stats = validation_statistics(positions)
    lines = [F.struct(F.lit(r).alias("reason"), F.col(f"rejected_{r}").alias("rows")) for r in REASONS]
    lines.append(F.struct(F.lit("duplicate").alias("reason"), F.col("duplicates").alias("rows")))
    lines.append(F.struct(F.lit("accepted").alias("reason"), F.col("accepted").alias("rows")))
    return stats.select(F.inline(F.array(*lines))).filter(F.col("rows") > 0)
