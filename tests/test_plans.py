"""Shapes of physical plans that matter when one vessel holds a large share of the rows."""

import re
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from wakeline.operators.downsample import downsample
from wakeline.operators.snapshots import latest_per_vessel
from wakeline.operators.validate import clean
from wakeline.plans import catalog
from wakeline.plans import derived as D
from wakeline.session import shared_folder, stage


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(plan):
    """Columns of each hash exchange, without their ids."""
    found = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)
    return [[c.split("#")[0].strip() for c in f.split(",")[:-1]] for f in found]


def test_keep_first_combines_before_its_only_shuffle(spark, sf_dir):
    plan = plan_of(clean(D.raw_positions(spark, sf_dir)))
    assert exchanges(plan) == [["mmsi", "_second"]]
    assert "partial_min_by" in plan
    assert "Window" not in plan


def test_latest_combines_before_its_shuffle(spark, sf_dir):
    plan = plan_of(latest_per_vessel(D.raw_positions(spark, sf_dir)))
    assert exchanges(plan) == [["mmsi"]]
    assert "partial_max_by" in plan


def test_thinning_shuffles_rows_by_stretch_once(spark, sf_dir):
    rows = downsample(stage(clean(D.raw_positions(spark, sf_dir)), "rows"))
    rows.collect()
    plan = plan_of(rows).split("Initial Plan")[0]
    assert "ReusedExchange" in plan
    assert exchanges(plan).count(["mmsi", "_stretch"]) >= 1
    assert "Window" not in plan


@pytest.mark.parametrize(
    "name", ["positions_range", "positions_at", "positions_series", "track_build", "track_summary", "vessel_upsert", "nmea_assemble"]
)
def test_no_join_without_keys(spark, sf_dir, name):
    plan = plan_of(catalog.registered()[name](spark, sf_dir))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


def test_raw_events_are_read_by_column(spark, sf_dir):
    plan = plan_of(catalog.registered()["partition_bbox"](spark, sf_dir))
    assert "props" not in plan


def session_with(**conf):
    settings = {k.replace("_", "."): v for k, v in conf.items()}
    return SimpleNamespace(conf=SimpleNamespace(get=lambda k, default=None: settings.get(k, default)))


def test_staging_uses_the_named_folder():
    named = session_with(spark_checkpoint_dir="hdfs:/shared/", spark_master="yarn")
    assert shared_folder(named) == "hdfs:/shared"


def test_no_local_folder_on_a_cluster():
    with pytest.raises(ValueError):
        shared_folder(session_with(spark_master="yarn"))
    assert shared_folder(session_with(spark_master="local[2]"))


def test_staged_table_cuts_the_lineage(spark):
    staged = stage(spark.range(10).groupBy((F.col("id") % 3).alias("k")).agg(F.sum("id").alias("s")), "t")
    plan = plan_of(staged)
    assert "FileScan parquet" in plan
    assert "Exchange" not in plan
    assert sorted(tuple(r) for r in staged.collect()) == [(0, 18), (1, 12), (2, 15)]


def test_pieces_of_a_landing_log_do_not_grow_with_the_tasks(spark, sf_dir):
    """One file is one batch of the stream, so their number is the receiver's, not that of the writing tasks."""
    from wakeline.plans import rendering as R

    key, before = "spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set(key, "23")
    try:
        pieces = spark.read.format("binaryFile").load(R.landing_logs(spark, sf_dir)).select("path").count()
    finally:
        spark.conf.set(key, before)
    assert pieces <= 3 * R.GROUP_FILES
