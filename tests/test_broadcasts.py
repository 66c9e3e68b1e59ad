"""What is gathered in the driver to be broadcast is bounded by its rows, not by the size of the files that hold them."""

import pytest
from pyspark.sql import functions as F

from wakeline.plans import rendering as R
from wakeline.session import configure, stage
from wakeline.sources import sentences as N
from wakeline.sources import tables as TB


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


def events_and_customers(spark, folder, customers):
    no = F.col("id")
    events = spark.range(200).select(
        no.alias("event_id"), F.expr("timestamp_ntz '2024-01-01' + make_interval(0, 0, 0, 0, 0, 0, id)").alias("ts"), (no % 7).alias("user_id"),
        F.lit("view").alias("event_type"), F.lit(1.5).alias("value"), F.lit("{}").alias("props"),
    )
    events.write.parquet(f"{folder}/events.parquet")
    names = spark.range(customers).select(
        no.alias("c_custkey"), F.format_string("Customer#%09d", no).alias("c_name"), F.lit(1).alias("c_nationkey"),
        F.lit(0.5).alias("c_acctbal"), F.lit("FURNITURE").alias("c_mktsegment"),
    )
    names.write.parquet(f"{folder}/customer.parquet")
    return str(folder)


@pytest.mark.parametrize("customers, gathered", [(400, True), (300_000, False)])
def test_names_of_many_vessels_are_not_gathered_in_the_driver(spark, tmp_path, customers, gathered):
    rows = R._import_rows(spark, events_and_customers(spark, tmp_path, customers))
    assert ("BroadcastHashJoin" in final_plan(rows)) is gathered
    named = rows.filter("mmsi < 219000400 and mmsi >= 219000000")
    assert named.count() > 0 and named.filter("vessel_name is null").isEmpty()


def test_seconds_of_the_store_are_not_gathered_in_the_driver(spark, tmp_path):
    store, no = TB.Store(str(tmp_path / "store")), F.col("id")
    cells = {"lat": "55.5D", "lon": "10.5D", "sog": "1F", "cog": "2F", "heading": "3", "nav_status": "0", "rot": "0F", "msg_type": "1"}
    rows = spark.range(600_000).select(
        (219_000_000 + no % 50).alias("mmsi"), F.timestamp_seconds(1_704_070_800 + F.floor(no / 50)).alias("ts"),
        *[F.expr(value).alias(name) for name, value in cells.items()],
    )
    TB.write_positions(rows, store)
    # Fifty seconds that are there, and the same of other vessels.
    known = rows.filter(F.col("ts") == F.timestamp_seconds(F.lit(1_704_070_800)))
    arrived = known.unionByName(known.withColumn("mmsi", F.col("mmsi") + 1000))
    fresh = TB.not_stored(arrived.withColumn("date", F.to_date("ts")), store)
    assert "BroadcastHashJoin" not in final_plan(fresh)
    assert sorted(r.mmsi for r in fresh.select("mmsi").collect()) == [219_001_000 + i for i in range(50)]


def test_open_parts_are_not_gathered_in_the_driver(spark):
    at = F.timestamp_seconds(F.lit(1_704_070_800))
    file = F.lit("file:/landing/" + "a" * 200)
    parts = spark.range(60_000).select(
        F.lit(2).alias("total"), F.lit(1).alias("num"), F.concat(F.lit("A|s"), F.col("id").cast("string")).alias("key"),
        F.lit("payload").alias("payload"), at.alias("ts"),
        F.struct(at.alias("at"), file.alias("file"), F.lit(0).cast("bigint").alias("block"), F.col("id").alias("row")).alias("seq"),
    )
    still_open = N.open_parts(stage(parts, "parts"), F.col("seq.file"))
    assert "BroadcastHashJoin" not in final_plan(still_open)
    assert still_open.count() == 60_000


def test_a_limit_of_the_session_stays_with_its_estimates(spark):
    other = spark.newSession()
    other.conf.set("spark.sql.autoBroadcastJoinThreshold", "1m")
    configure(other)
    assert other.conf.get("spark.sql.autoBroadcastJoinThreshold") == "1m"
    assert "spark.sql.sources.fileCompressionFactor" not in other.conf.getAll
