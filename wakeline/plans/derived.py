"""Vessel data derived from the plain test tables (``events``, ``orders``, ``customer``).

Every event becomes a position report, every order a static report, every customer a vessel name. The
same rules are written as SQL in ``oracles.py``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeline import schema as S
from wakeline.functions.scalars import at, from_micros, micros

START = "2024-01-01 00:00:00"
SLOW_PHASE_US = 6 * 3600 * 1_000_000
SEQ_BLOCK = 10_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions with bad rows and repeats, in an arrival order (``seq``) that is not time order."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    eid = F.col("event_id")
    e = e.withColumn("us", F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '{START}', ts) div 12"))
    slow = F.col("phase") % 3 == 0
    zero = eid % 101 == 0
    sog = F.when(slow, (eid % 5) / F.lit(10.0)).when(F.col("event_type") != "error", F.col("value"))
    base = e.withColumn("phase", F.expr(f"us div {SLOW_PHASE_US}")).select(
        F.when(eid % 97 == 0, 99_999_999).otherwise(219_000_000 + F.col("user_id")).cast("bigint").alias("mmsi"),
        from_micros(F.col("us") + micros(at(START))).alias("ts"),
        F.when(zero, 0.0).when(eid % 103 == 0, 91.0).otherwise(54 + (eid * 53 % 400) / 100.0).alias("lat"),
        F.when(zero, 0.0).otherwise(8 + (eid * 37 % 800) / 100.0).alias("lon"),
        sog.cast("float").alias("sog"),
        ((eid * 7 % 3600) / 10.0).cast("float").alias("cog"),
        F.when(F.col("event_type") == "view", 511).otherwise(eid % 360).cast("int").alias("heading"),
        F.when(slow & (F.col("user_id") % 7 == 0), 5).otherwise(0).cast("int").alias("nav_status"),
        F.when(F.col("event_type") != "click", eid % 9 - 4).cast("float").alias("rot"),
        F.element_at(F.array(*[F.lit(t) for t in (1, 2, 3, 18)]), (eid % 4 + 1).cast("int")).alias("msg_type"),
        (F.col("phase") * SEQ_BLOCK + eid * 7919 % 1_000_003).alias("seq"),
        eid,
    )
    again = base.filter(eid % 50 == 0).withColumn("seq", F.col("seq") + 1_000_000_000_000)
    return base.unionByName(again).select(*S.POSITION_COLS, "seq")


def static_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Static reports with gaps: which fields an order fills depends on its key."""
    o = table(spark, sf_dir, "orders")
    key, kind = F.col("o_orderkey"), F.col("o_orderkey") % 3
    return o.select(
        (219_000_000 + F.col("o_custkey")).alias("mmsi"),
        F.when(kind == 0, 9_000_000 + key % 1_000_000).alias("imo"),
        F.when(kind != 1, F.concat(F.lit("SHIP "), (key % 1000).cast("string"))).alias("vessel_name"),
        F.when(kind == 1, F.concat(F.lit("CS"), (key % 9999).cast("string"))).alias("callsign"),
        F.when(kind == 2, key % 100).cast("int").alias("ship_type"),
        F.when(kind == 0, F.lower(F.col("o_orderpriority"))).alias("ship_type_desc"),
        F.when(kind != 2, key % 400).cast("float").alias("length_m"),
        F.when(kind == 2, key % 60).cast("float").alias("beam_m"),
        F.when(kind == 1, (key % 200) / 10.0).cast("float").alias("draught_m"),
        F.when(kind == 0, F.col("o_orderstatus")).alias("destination"),
        F.col("o_orderdate").cast("timestamp").alias("last_seen"),
        key.alias("seq"),
    )


def named_vessels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One vessel per customer: name, type text from the market segment, code for every second one."""
    c = table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    return c.select(
        (219_000_000 + key).alias("mmsi"),
        F.lit(None).cast("bigint").alias("imo"),
        F.col("c_name").alias("vessel_name"),
        F.lit(None).cast("string").alias("callsign"),
        F.when(key % 2 == 0, key % 100).cast("int").alias("ship_type"),
        F.lower(F.col("c_mktsegment")).alias("ship_type_desc"),
        F.when(key % 5 != 0, key % 300).cast("float").alias("length_m"),
        F.lit(None).cast("float").alias("beam_m"),
        F.lit(None).cast("float").alias("draught_m"),
        F.lit(None).cast("string").alias("destination"),
        at(START).alias("last_seen"),
    )
