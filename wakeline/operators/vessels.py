"""Vessel metadata: merge of static reports, latest record, upsert and enrichment joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline import schema as S


def merge_reports(reports: DataFrame, order: str = "seq") -> DataFrame:
    """One row per vessel: each field's last non-null value in arrival order, time of the last report.

    Pure partial/final aggregation, so a vessel with very many reports is combined before the shuffle.
    """
    fields = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in S.VESSEL_FIELDS]
    return (
        reports.groupBy("mmsi").agg(*fields, F.max_by("last_seen", order).alias("last_seen")).select(*S.VESSEL_COLS)
    )


def latest_record(vessels: DataFrame) -> DataFrame:
    """One whole record per vessel, the most recently seen one; ties go to the larger record."""
    rest = [c for c in S.VESSEL_COLS if c not in ("mmsi", "last_seen")]
    newest = F.max(F.struct("last_seen", *rest)).alias("_v")
    return vessels.groupBy("mmsi").agg(newest).select("mmsi", "_v.*").select(*S.VESSEL_COLS)


def upsert(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Stored vessels overlaid by incoming ones: per vessel the latest record of both sides."""
    return latest_record(stored.select(*S.VESSEL_COLS).unionByName(incoming.select(*S.VESSEL_COLS)))


ENRICH_COLS = ["vessel_name", "ship_type", "ship_type_desc", "length_m"]


def enrich(positions: DataFrame, vessels: DataFrame) -> DataFrame:
    """Positions with name, type and length of their vessel; vessels without metadata give nulls.

    ``vessels`` holds one row per vessel. No broadcast hint: adaptive execution broadcasts the vessel
    side when its measured size allows, and otherwise splits the skewed keys of the sort-merge join.
    """
    return positions.join(vessels.select("mmsi", *ENRICH_COLS), "mmsi", "left")


def vessel_details(positions: DataFrame, vessels: DataFrame) -> DataFrame:
    """Positions with the full vessel record; values the position already carries win."""
    carried = [c for c in ENRICH_COLS if c in positions.columns]
    side = vessels.select("mmsi", *[F.col(c).alias(f"_{c}") for c in S.VESSEL_COLS if c != "mmsi"])
    joined = positions.join(side, "mmsi", "left")
    out = [F.col(c) for c in positions.columns if c not in carried]
    for c in S.VESSEL_COLS[1:]:
        value = F.coalesce(F.col(c), F.col(f"_{c}")) if c in carried else F.col(f"_{c}")
        out.append(value.alias(c))
    return joined.select(*out)
