"""What the physical plans look like before they run."""

import re

import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from dockflow.operators import conform, features, ledger
from dockflow.operators import trajectories as tj
from dockflow.plans import labels as plan
from dockflow.sinks.tables import register_partitioned, write_json, write_partitioned
from dockflow.testbed import fixtures as fx
from dockflow.testbed import queries as q

CONTRACT = fx.test_contract()


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def lake(spark, tmp_path_factory):
    """Trips, stations and labels as tables, as the phases read them."""
    root = str(tmp_path_factory.mktemp("lake"))
    trips = conform.with_month(fx.trips(spark, SMALL), "start_time")
    write_partitioned(trips, f"{root}/trips", ["year", "month"])
    fx.stations(spark, SMALL).write.parquet(f"{root}/stations")
    t, s = spark.read.parquet(f"{root}/trips"), spark.read.parquet(f"{root}/stations")
    write_partitioned(plan.build_labels(t, s, CONTRACT).labels, f"{root}/labels", ["part_year", "part_month"])
    return {"trips": t, "stations": s, "labels": spark.read.parquet(f"{root}/labels"), "root": root}


def test_trajectories_shuffle_once(lake):
    text = physical(tj.bike_trajectories(lake["trips"]))
    assert text.count("Exchange hashpartitioning") == 1


def test_labels_shuffle_trips_once_and_the_panel_twice(lake):
    """By bike, then pre-aggregated by station and hour, then the panel by station. The station table adds its own."""
    labels = plan.build_labels(lake["trips"], lake["stations"], CONTRACT).labels
    keys = re.findall(r"Exchange hashpartitioning\(([^)]*?), \d+\)", physical(labels))
    names = [re.sub(r"#\d+L?", "", k) for k in keys]
    assert sorted(names) == ["bike_id", "station_id", "station_id", "station_id, hour"]


def test_labels_read_only_the_columns_they_use(lake):
    text = physical(plan.build_labels(lake["trips"], lake["stations"], CONTRACT).labels)
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", text)
    assert all("bike_type" not in s and "duration_s" not in s and "station_name" not in s for s in schemas)


def test_no_join_without_a_key(lake):
    """The ends of the window are scalar subqueries, read from one column of the trips."""
    text = physical(plan.build_labels(lake["trips"], lake["stations"], CONTRACT).labels)
    assert "CartesianProduct" not in text and "NestedLoopJoin" not in text
    assert "Subquery" in text and "ReadSchema: struct<end_time:timestamp_ntz>" in text


def test_no_window_without_partition(lake):
    labels = lake["labels"]
    weather = q.weather_table(labels.sparkSession, SMALL)
    for df in (
        plan.build_labels(lake["trips"], lake["stations"], CONTRACT).labels,
        features.build_features(labels, weather, CONTRACT),
        q.classification_metrics(labels.sparkSession, SMALL),
    ):
        assert "Exchange SinglePartition" not in re.sub(
            r"\+- Exchange SinglePartition, ENSURE_REQUIREMENTS[^\n]*\n[^\n]*(HashAggregate|ObjectHashAggregate)", "",
            physical(df),
        )


def test_features_shuffle_the_panel_once(lake):
    weather = q.weather_table(lake["labels"].sparkSession, SMALL)
    text = physical(features.with_lags(lake["labels"]))
    assert text.count("Exchange hashpartitioning") == 1
    joined = features.build_features(lake["labels"], weather, CONTRACT)
    assert physical(joined).count("Exchange hashpartitioning(station_id") == 1
    assert "BroadcastHashJoin" in physical(joined)


def test_filters_reach_the_scan(lake):
    df = conform.filter_trips(lake["trips"], CONTRACT).filter("month = 1")
    explain = df.sparkSession._jvm.PythonSQLUtils.explainString
    text = explain(df._jdf.queryExecution(), "formatted")
    assert "GreaterThan(duration_s,60)" in text and "PartitionFilters: [isnotnull(month" in text


def test_dedup_counts_keys_by_hash_and_sorts_repeated_rows_only(lake):
    counted = physical(conform.repeated_keys(lake["trips"], ["trip_id"]))
    assert "Sort" not in counted and counted.count("HashAggregate") == 2
    assert re.findall(r"ReadSchema: struct<([^>]*)>", counted) == ["trip_id:bigint"]
    text = physical(conform.deduplicate(lake["trips"], ["trip_id"]))
    anti, semi = text.index("LeftAnti"), text.index("LeftSemi")
    first, second = sorted((anti, semi))
    alone = text[anti : second if anti == first else len(text)]
    # Rows with a key of their own: no sort, and no exchange but the broadcast of the repeated keys.
    assert "Sort" not in alone.split("SortAggregate")[0] and "Exchange hashpartitioning" not in alone.split("SortAggregate")[0]
    assert "partial_min" in text[text.index("Exchange hashpartitioning") :] and "Window" not in text


def test_dedup_without_broadcast_sorts_above_the_exchange_only(lake):
    spark = lake["trips"].sparkSession
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        copies = lake["trips"].unionByName(lake["trips"].filter("trip_id % 3 = 0"))
        found = conform.deduplicate(copies, ["trip_id"])
        lines = [line.strip(" :+-|*()0123456789") for line in physical(found).splitlines()]
        below = [a for a, b in zip(lines[1:], lines) if b.startswith("Exchange hashpartitioning")]
        assert below and not any(line.startswith("Sort ") for line in below)
        assert found.count() == lake["trips"].count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_partitioned_write_makes_few_files(lake, spark, tmp_path):
    rows = lake["labels"].repartition(40)
    write_partitioned(rows, str(tmp_path / "t"), ["part_year", "part_month"])
    files = list((tmp_path / "t").rglob("*.parquet"))
    assert len(files) == lake["labels"].select("part_year", "part_month").distinct().count()
    assert spark.read.parquet(str(tmp_path / "t")).exceptAll(rows).count() == 0


def test_full_rebuild_drops_stale_partitions_and_increment_keeps_them(spark, tmp_path):
    path = str(tmp_path / "t")
    two = spark.createDataFrame([(1, 1), (2, 2)], "v int, m int")
    write_partitioned(two, path, ["m"])
    write_partitioned(two.filter("m = 1").withColumn("v", F.lit(9)), path, ["m"], incremental=True)
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [(2, 2), (9, 1)]
    write_partitioned(two.filter("m = 2"), path, ["m"])
    assert [tuple(r) for r in spark.read.parquet(path).collect()] == [(2, 2)]


def test_catalog_table_sees_its_partitions(spark, tmp_path):
    df = spark.createDataFrame([(1, 1), (2, 2)], "v int, m int")
    register_partitioned(df, "registered_rows", str(tmp_path / "r"), ["m"])
    assert spark.table("registered_rows").count() == 2
    assert spark.sql("SHOW PARTITIONS registered_rows").count() == 2
    spark.sql("DROP TABLE registered_rows")


def test_json_artefacts(spark, tmp_path):
    write_json(spark.createDataFrame([("train", 3)], "split string, n_rows int"), str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).first().asDict() == {"split": "train", "n_rows": 3}


def test_every_label_step_is_lazy(lake):
    """Building the plan runs nothing but the measurement of key sizes."""
    tracker = lake["trips"].sparkSession.sparkContext.statusTracker()
    before = len(tracker.getJobIdsForGroup(None))
    ledger.labels_from_flows(
        plan.dense_flows(
            plan.moves_per_station_hour(
                tj.bike_trajectories(lake["trips"], measured_on=lake["trips"].limit(0)),
                tj.window_end(lake["trips"]), CONTRACT.labels,
            ),
            lake["stations"], tj.window_end(lake["trips"]), CONTRACT.labels,
        ),
        CONTRACT.labels,
    )
    assert len(tracker.getJobIdsForGroup(None)) - before <= 1


def test_tasks_of_the_panel_follow_its_rows(spark, monkeypatch):
    """Twenty-four hours of each of many stations come from few moves: Spark alone would merge them into one task."""
    monkeypatch.setattr(plan, "PANEL_ROWS", 1500)
    monkeypatch.setattr(plan, "LEAST_ROWS", 1500)
    for panel in (q.labels(spark, SMALL), plan.by_station(q.flows(spark, SMALL), q.panel_tasks(spark, SMALL))):
        rows = [r["count"] for r in panel.groupBy(F.spark_partition_id().alias("task")).count().collect()]
        assert len(rows) > 1
        stations = panel.groupBy("station_id").count().agg(F.max("count"), F.count("*")).first()
        assert max(rows) <= max(1500, 5 * stations[0])
