"""Published tables after failed, torn and rival writes; look-ahead found by value."""

import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from dockflow.operators import ledger
from dockflow.session import scratch_dir
from dockflow.sinks import tables
from dockflow.testbed.queries import QUERIES


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_readers_see_whole_versions_only(spark):
    root = scratch_dir(spark)
    first = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "id long, name string, part int")
    second = spark.createDataFrame([(3, "c", 1)], "id long, name string, part int")
    with pytest.raises(ValueError):
        tables.published(spark, root)
    assert tables.publish(first, root, ["part"]) == 1
    tables.register_published(spark, "seen_by_readers", root)
    begun = tables.published(spark, root)

    # A write that fails half way leaves its folder, and readers as they were.
    broken = second.select("id", F.assert_true(F.lit(False)).cast("string").alias("name"), "part")
    with pytest.raises(Exception, match="false|assert"):
        tables.publish(broken, root, ["part"])
    tables.write_version(second, root, ["part"])
    assert rows(tables.published(spark, root)) == rows(first)

    # A torn manifest is passed over, and its number is not given again.
    tables.write_manifest(spark, root, 2, '{"version": "versi')
    assert rows(tables.published(spark, root)) == rows(first)
    assert tables.publish(second, root, ["part"]) == 3
    assert rows(tables.published(spark, root)) == rows(second)
    assert rows(begun) == rows(first) == rows(spark.table("seen_by_readers"))
    tables.register_published(spark, "seen_by_readers", root)
    assert rows(spark.table("seen_by_readers")) == rows(second)

    assert tables.remove_versions(spark, root, keep=1) >= 2
    assert rows(tables.published(spark, root)) == rows(second)


def test_of_two_publishers_one_fails(spark):
    root = scratch_dir(spark)
    tables.write_manifest(spark, root, 1, "{}")
    with pytest.raises(Exception, match="exists"):
        tables.write_manifest(spark, root, 1, "{}")


def test_partitions_of_a_published_table_are_pruned(spark):
    root = scratch_dir(spark)
    tables.publish(spark.range(10).withColumn("part", (F.col("id") % 5).cast("int")), root, ["part"])
    tables.register_published(spark, "pruned_readers", root)
    plan = spark.table("pruned_readers").filter("part = 3")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(part" in plan


def test_an_empty_table_is_published(spark):
    root = scratch_dir(spark)
    tables.publish(spark.createDataFrame([], "id long, part int"), root, ["part"])
    assert tables.published(spark, root).columns == ["id", "part"] and tables.published(spark, root).isEmpty()


def test_the_value_audit_flags_occupancy_and_what_follows_from_it(spark):
    found = {r.column_name: r.n_moved for r in QUERIES["value_leakage"](spark, SMALL).collect()}
    assert {c for c, n in found.items() if n} >= {"occupancy", "occupancy_lag_1h", "pct_full"}
    quiet = {"arr", "dep", "net_flow", "net_flow_lag_1h", "net_flow_same_hour_last_week", "net_flow_rolling_7d_mean"}
    assert not any(found[c] for c in quiet)
    assert not any(r.n_moved for r in QUERIES["value_leakage_fixed_level"](spark, SMALL).collect())


def test_a_station_that_opens_after_the_known_hours_starts_at_zero(spark):
    table = spark.createDataFrame(
        [(1, 1, 3), (1, 2, -2), (1, 3, -5), (2, 3, -1)], "station_id int, hour_ts int, cum_delta long"
    )
    got = {(r.station_id, r.hour_ts): r.occupancy for r in ledger.occupancy(table, F.col("hour_ts") <= 2).collect()}
    assert got == {(1, 1): 5, (1, 2): 0, (1, 3): -3, (2, 3): -1}
