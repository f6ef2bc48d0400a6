from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from dockflow.contract import LabelRules
from dockflow.operators import checks, grid, ledger, rolling
from dockflow.operators import trajectories as tj
from dockflow.plans import labels as plan
from dockflow.testbed import fixtures as fx

RULES = fx.test_contract().labels


def same(a, b):
    b = b.select(*a.columns)
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


@pytest.fixture(scope="module")
def tables(spark):
    trips, stations = fx.trips(spark, SMALL).persist(), fx.stations(spark, SMALL).persist()
    end = tj.window_end(trips)
    traj = tj.bike_trajectories(trips)
    moves = plan.moves_per_station_hour(traj, end, RULES)
    flows = plan.dense_flows(moves, stations, end, RULES).persist()
    yield {"trips": trips, "stations": stations, "end": end, "traj": traj, "moves": moves, "flows": flows}
    for t in (trips, stations, flows):
        t.unpersist()


def test_fused_moves_equal_the_separate_counts(tables):
    events = tj.movement_events(tables["traj"], RULES, tables["end"])
    stepwise = ledger.station_hour_moves(tables["trips"], events)
    assert same(stepwise, tables["moves"])


def test_filled_flows_equal_the_grid_join(tables):
    trips = tables["trips"]
    g = grid.station_hour_grid(tables["stations"], grid.station_activity(trips), grid.window_bounds(trips), RULES)
    stepwise = ledger.station_hour_flows(g, tables["moves"].select("station_id", "hour_ts", *ledger.COUNTS))
    assert g.count() == g.distinct().count()
    assert same(stepwise, tables["flows"])


def test_events_off_the_grid_are_counted_by_reason(spark, tables):
    t = datetime(2024, 1, 1)
    h = timedelta(hours=1)
    stations = [(1, t + 2 * h, t + 5 * h), (2, t, t + h), (3, t + h, t), (4, t, t + h), (4, t + 6 * h, t + 8 * h)]
    ranged = spark.createDataFrame(stations, "station_id int, lo timestamp_ntz, hi timestamp_ntz")
    events = [(1, 1.9, "before"), (1, 2, "on"), (1, 5.9, "on"), (1, 6, "after"), (3, 0, "unknown"), (9, 0, "unknown"),
              (4, 0.5, "on"), (4, 7, "on"), (4, 3, "before"), (4, 9, "after")]
    rows = [(s, t + at * h, "reb_in", kind) for s, at, kind in events]
    df = spark.createDataFrame(rows, "station_id int, event_time timestamp_ntz, event_type string, event_kind string")
    got = {r["event_kind"]: r for r in grid.off_grid_events(df, ranged).collect()}
    want = {"on": (4, "n_on_grid"), "before": (2, "n_before_grid"), "after": (2, "n_after_grid"), "unknown": (2, "n_unknown_station")}
    for kind, (n, column) in want.items():
        assert got[kind]["n_events"] == got[kind][column] == n

    trips = tables["trips"]
    ranged = grid.station_bounds(tables["stations"], grid.station_activity(trips), grid.window_bounds(trips), RULES)
    found = tj.movement_events(tables["traj"], RULES, tables["end"])
    parts = grid.off_grid_events(found, ranged).collect()
    assert all(r["n_events"] == sum(r[f"n_{p}"] for p in grid.PLACES) for r in parts)
    assert sum(r["n_events"] for r in parts) == found.count()
    # What is on the grid is what the flows hold.
    held = tables["flows"].agg(F.sum(F.col("reb_in") + F.col("reb_out"))).first()[0]
    assert sum(r["n_on_grid"] for r in parts) == held
    off = {r["check"]: r["observed"] for r in checks.off_grid_share(tables["moves"], ranged).collect()}
    assert sum(off.values()) == found.count() - held


def test_go_live_inside_a_quiet_gap_starts_the_grid(spark):
    """The first active hour before go-live is dropped, the quiet hours after go-live are kept."""
    t = datetime(2024, 1, 1)
    trips = spark.createDataFrame(
        [(1, "A", t, t + timedelta(minutes=30), 1, 1), (2, "A", t + timedelta(hours=9), t + timedelta(hours=9.5), 1, 1)],
        "trip_id long, bike_id string, start_time timestamp_ntz, end_time timestamp_ntz, start_station_id int, "
        "end_station_id int",
    )
    stations = spark.createDataFrame([(1, "x", t + timedelta(hours=4))],
                                     "station_id int, station_name string, go_live_date timestamp_ntz")
    end = tj.window_end(trips)
    flows = plan.flows_from(tj.bike_trajectories(trips), end, stations, LabelRules())
    rows = sorted(flows.collect(), key=lambda r: r["hour_ts"])
    assert [r["hour_ts"].hour for r in rows] == [4, 5, 6, 7, 8, 9]
    assert [r["arr"] for r in rows] == [0, 0, 0, 0, 0, 1]


def test_station_live_after_its_last_trip_has_no_rows(spark):
    t = datetime(2024, 1, 1)
    schema = ("trip_id long, bike_id string, start_time timestamp_ntz, end_time timestamp_ntz, start_station_id int, "
              "end_station_id int")
    trips = spark.createDataFrame(
        [(1, "A", t, t + timedelta(minutes=30), 1, 2), (2, "B", t + timedelta(days=90), t + timedelta(days=90.1), 2, 2)],
        schema,
    )
    stations = spark.createDataFrame([(1, "x", t + timedelta(days=9)), (2, "y", None)],
                                     "station_id int, station_name string, go_live_date timestamp_ntz")
    end = tj.window_end(trips)
    flows = plan.flows_from(tj.bike_trajectories(trips), end, stations, LabelRules())
    assert {r["station_id"] for r in flows.select("station_id").distinct().collect()} == {2}
    g = grid.station_hour_grid(stations, grid.station_activity(trips), grid.window_bounds(trips), LabelRules())
    assert same(g, flows.select("station_id", "hour_ts"))


def test_occupancy_touches_zero_and_never_goes_below(tables):
    occupied = ledger.occupancy(ledger.running_ledger(tables["flows"]))
    low = occupied.groupBy("station_id").agg(F.min("occupancy").alias("low")).collect()
    assert low and {r["low"] for r in low} == {0}


def test_panel_is_dense(tables):
    steps = tables["flows"].groupBy("station_id").agg(
        F.count(F.lit(1)).alias("n"),
        ((F.unix_timestamp(F.max("hour_ts")) - F.unix_timestamp(F.min("hour_ts"))) / 3600 + 1).alias("span"),
    )
    assert steps.filter("n <> span").count() == 0


@pytest.mark.parametrize("hours", [1, 5, 24, 168, 5000])
def test_block_maximum_equals_the_range_frame(tables, hours):
    occupied = ledger.occupancy(ledger.running_ledger(tables["flows"])).select("station_id", "hour_ts", "occupancy")
    fast = rolling.trailing_max(occupied, "station_id", "hour_ts", "occupancy", hours, "m")
    slow = rolling.trailing_max_by_range(occupied, "station_id", "hour_ts", "occupancy", hours, "m")
    assert same(fast, slow)


@pytest.mark.parametrize("hours", [1, 24, 168])
def test_prefix_mean_equals_the_range_frame(tables, hours):
    both = tables["flows"].select(
        rolling.trailing_mean("station_id", "hour_ts", "net_flow", hours).alias("fast"),
        rolling.trailing_mean_by_range("station_id", "hour_ts", "net_flow", hours).alias("slow"),
    )
    assert both.filter("NOT fast <=> slow").count() == 0
    assert both.filter("fast IS NULL").count() == tables["flows"].select("station_id").distinct().count()


def test_label_types_and_bounds(tables):
    from dockflow.schemas import label_schema

    labels = ledger.labels_from_flows(tables["flows"], RULES)
    assert [(f.name, f.dataType) for f in labels.schema] == [(f.name, f.dataType) for f in label_schema(True)]
    assert labels.filter("capacity < 1 OR pct_full > 1 OR pct_full < 0 OR is_empty <> (occupancy < 1)").count() == 0


def test_checks_from_moves_equal_checks_from_events(tables):
    events = tj.movement_events(tables["traj"], RULES, tables["end"])
    assert checks.mass_balance(events).collect() == checks.mass_balance_of_moves(tables["moves"]).collect()
    by_events = {r["month"]: r["n_removals"] for r in checks.maintenance_by_month(events).collect()}
    by_moves = {r["month"]: r["n_removals"] for r in checks.maintenance_by_month_of_moves(tables["moves"]).collect()}
    assert by_events == by_moves and by_events


def test_labels_do_not_depend_on_cut_keys(spark, tables):
    contract = fx.test_contract()
    plain = plan.build_labels(tables["trips"], tables["stations"], contract)
    cut = plan.build_labels(tables["trips"], tables["stations"], contract, hot_rows=10, slice_rows=5)
    assert same(plain.labels, cut.labels) and same(plain.events, cut.events)


ZONED = ("trip_id long, bike_id string, start_time timestamp, end_time timestamp, start_station_id int, "
         "end_station_id int")


@pytest.mark.parametrize("day,hours", [("2024-03-10", 23), ("2024-11-03", 25)])
def test_zoned_days_have_as_many_hours_as_passed(new_york, day, hours):
    """On the days clocks change the grid follows instants, and durations follow them too."""
    text = new_york.createDataFrame(
        [(1, "A", f"{day} 00:10:00", f"{day} 00:40:00", 1, 1), (2, "A", f"{day} 23:10:00", f"{day} 23:40:00", 1, 1)],
        "trip_id long, bike_id string, s string, e string, start_station_id int, end_station_id int",
    )
    trips = text.select("trip_id", "bike_id", F.to_timestamp("s").alias("start_time"),
                        F.to_timestamp("e").alias("end_time"), "start_station_id", "end_station_id")
    stations = new_york.createDataFrame([(1, "x")], "station_id int, station_name string").withColumn(
        "go_live_date", F.lit(None).cast("timestamp"))
    flows = plan.flows_from(tj.bike_trajectories(trips), tj.window_end(trips), stations, LabelRules())
    assert flows.count() == hours
    spine = grid.hour_spine(grid.window_bounds(trips))
    assert spine.count() == hours
    labels = ledger.labels_from_flows(flows, LabelRules())
    assert labels.count() == hours and dict(labels.dtypes)["hour_ts"] == "timestamp"


def test_every_month_of_removals_is_reported(spark):
    events = spark.sql("""
        SELECT add_months(DATE'2022-01-15', CAST(id AS INT))::timestamp_ntz AS event_time, 'maintenance_removal' AS event_kind
        FROM range(14)""")
    assert checks.maintenance_by_month(events).count() == 14
    moves = spark.sql("""
        SELECT add_months(DATE'2022-01-15', CAST(id AS INT))::timestamp_ntz AS hour_ts, 2 AS maintenance_removal
        FROM range(14)""")
    assert checks.maintenance_by_month_of_moves(moves).agg(F.sum("n_removals")).first()[0] == 28
