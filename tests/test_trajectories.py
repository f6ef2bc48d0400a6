from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from dockflow.contract import LabelRules
from dockflow.operators import checks, ordering
from dockflow.operators import trajectories as tj
from dockflow.testbed import fixtures as fx

RULES = LabelRules()
START = datetime(2026, 3, 2, 8, 0)
HOUR = timedelta(hours=1)
SCHEMA = (
    "trip_id long, bike_id string, start_time timestamp_ntz, end_time timestamp_ntz, start_station_id int, "
    "end_station_id int"
)


def histories(spark, *trips):
    """(bike, start, minutes, from, to) in any order, as trajectories."""
    rows = [(i, b, t, t + timedelta(minutes=m), a, z) for i, (b, t, m, a, z) in enumerate(trips)]
    return tj.bike_trajectories(spark.createDataFrame(rows, SCHEMA))


def found(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def gap(spark, hours):
    end = START + timedelta(minutes=10)
    traj = histories(spark, ("B", START, 10, 100, 200), ("B", end + hours * HOUR, 10, 900, 300))
    return end, found(tj.rebalancing_events(traj, RULES), "event_type", "station_id", "event_time", "event_kind")


def test_a_bike_that_stays_makes_no_event(spark):
    traj = histories(spark, ("B", START, 10, 100, 200), ("B", START + 3 * HOUR, 10, 200, 300))
    assert tj.rebalancing_events(traj, RULES).count() == 0
    assert tj.relocations(traj).count() == 0


def test_short_gap_meets_in_the_middle(spark):
    end, events = gap(spark, 2)
    assert events == [("reb_in", 900, end + HOUR, "rebalance"), ("reb_out", 200, end + HOUR, "rebalance")]


def test_middle_gap_uses_both_edges(spark):
    end, events = gap(spark, 24)
    assert events == [("reb_in", 900, end + 23 * HOUR, "rebalance"), ("reb_out", 200, end + HOUR, "rebalance")]


@pytest.mark.parametrize("hours,kind", [(71, "rebalance"), (72, "maintenance_removal"), (100, "maintenance_removal")])
def test_long_gap_is_maintenance(spark, hours, kind):
    assert {e[3] for e in gap(spark, hours)[1]} == {kind}


def test_negative_gap_counts_as_short(spark):
    traj = histories(spark, ("B", START, 60, 100, 200), ("B", START + timedelta(minutes=31), 5, 900, 300))
    at = START + timedelta(minutes=45, seconds=30)
    assert {r["event_time"] for r in tj.rebalancing_events(traj, RULES).collect()} == {at}


def test_ten_moves_are_recovered_exactly(spark):
    trips, expected = [], set()
    for i in range(10):
        start = START + timedelta(days=i)
        end, again = start + timedelta(minutes=15), start + timedelta(minutes=15) + 24 * HOUR
        trips += [(f"B{i}", start, 15, 100 + i, 200 + i), (f"B{i}", again, 15, 300 + i, 100 + i)]
        expected |= {(200 + i, "reb_out", end + HOUR), (300 + i, "reb_in", again - HOUR)}
    events = tj.rebalancing_events(histories(spark, *trips), RULES)
    assert set(found(events, "station_id", "event_type", "event_time")) == expected
    assert events.count() == 20


def test_no_false_move_at_a_quarter_boundary(spark):
    traj = histories(
        spark, ("B", datetime(2026, 3, 31, 22), 20, 100, 200), ("B", datetime(2026, 4, 1, 9), 20, 200, 300)
    )
    assert tj.rebalancing_events(traj, RULES).count() == 0


def window_end(spark, at):
    return spark.createDataFrame([(at,)], "window_end timestamp_ntz")


def test_fleet_entry_and_exit(spark):
    traj = histories(spark, ("B", START, 10, 100, 200), ("B", START + 2 * HOUR, 10, 200, 300))
    end = window_end(spark, START + timedelta(days=365))
    events = found(tj.fleet_events(traj, RULES, end), "event_kind", "station_id", "event_type", "event_time")
    assert events == [
        ("fleet_entry", 100, "reb_in", START - HOUR),
        ("fleet_exit", 300, "reb_out", START + 3 * HOUR + timedelta(minutes=10)),
    ]


def test_recent_last_trip_is_idle_not_retired(spark):
    traj = histories(spark, ("B", START, 10, 100, 200))
    end = window_end(spark, START + timedelta(days=5))
    assert found(tj.fleet_events(traj, RULES, end), "event_kind") == [("fleet_entry",)]


def test_ties_are_broken_by_trip_id(spark):
    traj = histories(spark, ("B", START, 5, 1, 2), ("B", START, 5, 2, 3), ("B", START, 5, 3, 4))
    assert found(traj, "trip_seq", "trip_id", "next_start_station") == [(1, 0, 2), (2, 1, 3), (3, 2, None)]


def test_all_events_in_one_pass_equal_the_parts(spark):
    trips, end = fx.trips(spark, SMALL), tj.window_end(fx.trips(spark, SMALL))
    rules = fx.test_contract().labels
    traj = tj.bike_trajectories(trips)
    parts = tj.rebalancing_events(traj, rules).unionByName(tj.fleet_events(traj, rules, end))
    whole = tj.movement_events(traj, rules, end)
    assert parts.exceptAll(whole).count() == 0 and whole.exceptAll(parts).count() == 0


@pytest.mark.parametrize("hot_rows,slice_rows", [(10, 7), (100, 1), (200, 1000)])
def test_cut_keys_give_the_plain_window(spark, hot_rows, slice_rows):
    """A third of all rows on one key, which is NULL, and times that crowd into one second."""
    trips = fx.trips(spark, SMALL)
    trips = trips.withColumns({
        "bike_id": F.when(F.col("trip_id") % 3 > 0, F.col("bike_id")),
        "start_time": F.when(F.col("trip_id") % 6 == 0, F.lit("2024-01-09 12:00:00").cast("timestamp_ntz"))
        .otherwise(F.col("start_time")),
    })
    plain = tj.bike_trajectories(trips)
    cut = tj.bike_trajectories(trips, hot_rows=hot_rows, slice_rows=slice_rows)
    assert "_slice" in cut._jdf.queryExecution().optimizedPlan().toString()
    assert plain.count() == cut.count() == trips.count()
    assert plain.exceptAll(cut).count() == 0


def one_second(spark, rows):
    """A bike whose trips all start in one second, another one spread over a day, and a small one."""
    at = F.lit("2024-01-09 12:00:00").cast("timestamp_ntz")
    spread = F.expr("TIMESTAMP_NTZ '2024-01-09 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, id % 86400)")
    bike = F.when(F.col("id") % 2 == 0, "A").when(F.col("id") % 100 == 1, "C").otherwise("B")
    start = F.when(F.col("id") % 2 == 0, at).otherwise(spread)
    return spark.range(rows).select(
        F.col("id").alias("trip_id"), bike.alias("bike_id"), start.alias("start_time"), start.alias("end_time"),
        F.lit(1).alias("start_station_id"), (F.col("id") % 7).cast("int").alias("end_station_id"),
    )


@pytest.mark.parametrize("fan", [3, 64])
def test_a_key_of_one_second_is_cut_into_bounded_slices(spark, monkeypatch, fan):
    monkeypatch.setattr(ordering, "FAN", fan)
    trips, order = one_second(spark, 24_000), ["start_time", "trip_id"]
    hot = ordering.hot_keys(trips, "bike_id", 5_000)
    assert sorted(r[0] for r in hot.collect()) == ["A", "B"]
    cuts = ordering.splitters(trips, hot, "bike_id", order, 1_000)
    sliced = ordering._with_slice(trips, hot, cuts, "bike_id", order)
    per = {(r["bike_id"], r["_slice"]): r for r in sliced.groupBy("bike_id", "_slice").agg(
        F.count("*").alias("n"), F.min(F.struct(*order)).alias("lo"), F.max(F.struct(*order)).alias("hi")).collect()}
    assert len([k for k in per if k[0] == "A"]) >= 9
    assert all(r["n"] <= 2_000 for k, r in per.items() if k[0] != "C") and per["C", 0]["n"] == 240
    for bike in "AB":  # slices follow each other in the total order
        ends = [(r["lo"], r["hi"]) for (b, _), r in sorted(per.items()) if b == bike]
        assert all(a[1] < b[0] for a, b in zip(ends, ends[1:]))
    plain, cut = tj.bike_trajectories(trips), tj.bike_trajectories(trips, hot_rows=5_000, slice_rows=1_000)
    assert plain.exceptAll(cut).count() == 0 and cut.count() == 24_000


def test_order_and_partitioning_do_not_matter(spark):
    trips = fx.trips(spark, SMALL)
    a = tj.bike_trajectories(trips)
    b = tj.bike_trajectories(trips.repartition(7).orderBy(F.desc("trip_id")))
    assert a.exceptAll(b).count() == 0


def test_recovery_gate_passes_and_can_fail(spark):
    rules = fx.test_contract().labels
    trips = fx.trips(spark, SMALL)
    rows = {r["check"]: r for r in checks.recovery_gate(trips, rules).collect()}
    assert rows["recovered"]["observed"] == 2 * trips.count()
    assert {r["status"] for r in rows.values()} == {"OK"}


def test_mass_balance_holds(spark):
    trips = fx.trips(spark, SMALL)
    rules = fx.test_contract().labels
    events = tj.movement_events(tj.bike_trajectories(trips), rules, tj.window_end(trips))
    assert checks.mass_balance(events).first()["status"] == "OK"
    unpaired = events.filter("NOT (event_type = 'reb_in' AND event_kind = 'rebalance')")
    assert checks.mass_balance(unpaired).first()["status"] == "FAIL"
