from dataclasses import replace
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from dockflow.contract import Contract, ContractError, default_contract, load_contract
from dockflow.functions.time import hour_floor, local_to_utc
from dockflow.operators import checks, conform
from dockflow.operators.models import feature_vectors
from dockflow.testbed import fixtures as fx

CANONICAL = tuple(conform.COLUMN_ALIASES)


def resolved(spark, *rows):
    """(trip_id, duration, start, end, from, to, bike)."""
    return spark.createDataFrame([(*r, None, None) for r in rows], ", ".join(f"{c} string" for c in CANONICAL))


def test_formats_and_durations(spark):
    df = resolved(
        spark,
        ("1", "5", "1/2/2022 0:04", "1/2/2022 0:09", "3", "4", "b"),
        ("2", "", "1/2/2022 0:04:30", "2022-01-02 00:10:00", "3", "4", "b"),
        ("3", None, "2022-01-02T00:04:00", "n/a", "3", "x", "b"),
        ("4", "1.5", "2022-01-02 00:00:00", "2022-01-02 00:01:00", "3", "4", "b"),
        ("5", "99999999999", "2022-01-02 00:00:00", "2022-01-02 00:01:00", "3", "4", "b"),
    )
    rows = {r["trip_id"]: r for r in conform.parse_trips(df, unzoned=True).collect()}
    assert [rows[i]["duration_s"] for i in range(1, 6)] == [300, 330, None, 60, None]
    assert rows[1]["start_time"] == datetime(2022, 1, 2, 0, 4) and rows[3]["end_time"] is None
    assert rows[3]["end_station_id"] is None


def test_unzoned_parsing_ignores_the_session_zone(new_york):
    """02:30 does not exist on this day in the session's zone."""
    df = new_york.createDataFrame([("3/10/2024 2:30",)], "t string")
    got = df.select(conform.parse_time("t", conform.TRIP_TIME_FORMATS, True).alias("t"))
    assert got.first()[0] == datetime(2024, 3, 10, 2, 30)
    floored = got.withColumn("t", F.expr("t + INTERVAL 7 MINUTES")).select(hour_floor(got, "t").cast("string"))
    assert floored.first()[0] == "2024-03-10 02:00:00"


def test_local_hours_become_instants(spark):
    df = spark.sql("SELECT TIMESTAMP_NTZ'2024-07-01 12:00:00' AS summer, TIMESTAMP_NTZ'2024-01-01 12:00:00' AS winter")
    row = df.select(local_to_utc("summer", "America/New_York"), local_to_utc("winter", "America/New_York")).first()
    assert (row[0].hour, row[1].hour) == (16, 17)


@pytest.mark.parametrize("bad,status", [(0, "OK"), (1, "OK"), (2, "FAIL")])
def test_parse_gate_fails_above_one_percent(spark, bad, status):
    df = spark.range(100).select(
        F.when(F.col("id") >= bad, F.lit("2024-01-01").cast("timestamp")).alias("start_time"),
        F.lit("2024-01-01").cast("timestamp").alias("end_time"),
    )
    assert conform.parse_rate(df).first()["status"] == status


def test_duration_bounds(spark):
    contract = replace(default_contract(), train_window_start="2022-01-01")
    rows = spark.createDataFrame(
        [(s, 1, 1, datetime(2022, 1, 1)) for s in (59, 60, 61, 86400, 86401, None)]
        + [(100, 1, 1, datetime(2021, 12, 31, 23, 59)), (100, None, 1, datetime(2023, 1, 1))],
        "duration_s int, start_station_id int, end_station_id int, start_time timestamp_ntz",
    )
    assert sorted(r["duration_s"] for r in conform.filter_trips(rows, contract).collect()) == [61, 86400]


def test_pseudo_station_is_dropped_by_name_and_by_id(spark):
    stations = spark.createDataFrame([(1, "VIRTUAL Station"), (2, "B"), (3, None)],
                                     "station_id int, station_name string")
    assert {r[0] for r in conform.exclude_pseudo_stations(stations).collect()} == {2, 3}
    trips = spark.createDataFrame([(1, 2), (2, 1), (2, 3), (None, 2)], "start_station_id int, end_station_id int")
    assert conform.drop_pseudo_trips(trips, stations).count() == 2


def test_unknown_header_is_an_error(spark):
    with pytest.raises(ContractError, match="start_station"):
        conform.resolve_columns(resolved(spark).drop("start_station"))
    assert "bike_type" in conform.resolve_columns(resolved(spark).drop("bike_type")).columns


def test_dedup_is_the_same_for_any_partitioning_and_hot_key(spark):
    """A third of the rows carry one key."""
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"), (F.hash("id") % 1000).alias("v"),
        F.col("id").cast("string").alias("s"),
    )
    a = conform.deduplicate(df, ["k"]).collect()
    b = conform.deduplicate(df.repartition(11).orderBy(F.desc("s")), ["k"]).collect()
    assert sorted(a) == sorted(b) and len(a) == 2001 - 1 + (7 % 3 == 0)


def test_dedup_by_several_keys_with_nulls(spark):
    rows = [(None, 1, "b"), (None, 1, "a"), (None, None, "z"), (None, None, "z"), (1, None, "x"), (1, 2, None), (1, 2, "q")]
    df = spark.createDataFrame(rows, "k int, j int, s string")
    got = sorted(conform.deduplicate(df, ["k", "j"]).collect(), key=str)
    assert got == sorted([(None, 1, "a"), (None, None, "z"), (1, None, "x"), (1, 2, None)], key=str)
    assert conform.deduplicate(df.limit(0), ["k"]).count() == 0


def test_clean_trips_from_raw_are_the_typed_trips_under_the_rules(spark):
    """Archive 0 publishes minutes, the others whole seconds and NULL or minute durations: ids must agree."""
    contract = fx.test_contract()
    stations = conform.parse_stations(fx.stations_raw(spark, SMALL), unzoned=True)
    cells = fx.trip_cells(fx.trips_raw(spark, SMALL))
    clean = conform.clean_trips(conform.resolve_cells(cells), stations, contract, unzoned=True)
    assert clean.count() == clean.select("trip_id").distinct().count()
    typed = conform.drop_pseudo_trips(conform.filter_trips(fx.trips(spark, SMALL), contract), stations)
    assert clean.join(typed, "trip_id", "left_anti").count() == 0
    assert dict(clean.dtypes)["year"] == "int"


def test_contract_round_trip_and_variants(spark, tmp_path):
    contract = default_contract()
    assert len(contract.features) == 22 and contract.weather_point == "center"
    (tmp_path / "c.json").write_text(contract.to_json())
    assert load_contract(spark, str(tmp_path / "c.json")) == contract
    assert Contract.from_json(contract.to_json()) == contract
    variant = contract.without_groups(["lag"])
    assert len(variant.features) == 18 and "lag" not in variant.feature_groups
    with pytest.raises(ContractError, match="lags"):
        contract.without_groups(["lags"])


def test_vector_order_is_the_contract_order(spark):
    contract = default_contract()
    row = {f: float(i) for i, f in enumerate(contract.features)}
    df = spark.createDataFrame([{**row, "rain": None}], ", ".join(f"{f} double" for f in reversed(contract.features)))
    got = feature_vectors(df, contract).first()
    expected = [0.0 if f == "rain" else row[f] for f in contract.features]
    assert list(got["features"].toArray()) == expected and got["n_filled"] == 1
    with pytest.raises(ContractError, match="snowfall"):
        feature_vectors(df.drop("snowfall"), contract)


def test_undeclared_feature_stops_the_audit(spark):
    contract = default_contract()
    columns = [*contract.features, "station_id", "hour_ts", "net_flow", "is_empty"]
    df = spark.createDataFrame([], ", ".join(f"{c} double" for c in columns))
    checks.require_declared(df, contract)
    leaked = df.withColumn("net_flow_next_hour", F.lit(1.0))
    with pytest.raises(ContractError, match="net_flow_next_hour"):
        checks.require_declared(leaked, contract)
    with pytest.raises(ContractError, match="is_holiday"):
        checks.require_declared(df.drop("is_holiday"), contract)
    statuses = {r["column_name"]: r["status"] for r in checks.leakage_audit(leaked.drop("rain"), contract).collect()}
    assert statuses["net_flow_next_hour"] == "FAIL" and statuses["rain"] == "WARN" and statuses["month"] == "OK"


def test_enforce_raises_on_errors_only(spark):
    schema = "check string, status string, observed double, expected double, severity string"
    checks.enforce(spark.createDataFrame([("a", "FAIL", 1.0, 0.0, "warn"), ("b", "OK", 1.0, 1.0, "error")], schema))
    with pytest.raises(ContractError, match="c: observed 3"):
        checks.enforce(spark.createDataFrame([("c", "FAIL", 3.0, 0.0, "error")], schema))
    with pytest.raises(ContractError, match="weather"):
        checks.require_rows(spark.range(0), "weather")
