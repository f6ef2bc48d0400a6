"""Every registered query of the engine: an operator over whole test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dockflow.functions.single import attach
from dockflow.functions.time import hour_floor, literal_like, local_to_utc
from dockflow.operators import (
    assembly,
    attribution,
    boosting,
    calendar,
    checks,
    conform,
    features,
    grid,
    ledger,
    metrics,
    models,
    trajectories,
)
from dockflow.plans import increments
from dockflow.plans import labels as label_plan
from dockflow.session import scratch_dir, staged
from dockflow.sinks import tables
from dockflow.sources import archives, planning
from dockflow.sources import weather as weather_source
from dockflow.testbed import fixtures as fx

CONTRACT = fx.test_contract()
RULES = CONTRACT.labels
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def without_null_ints(df: DataFrame, *names: str) -> DataFrame:
    """NULL integers as -1, as in the SQL: engines hand nullable integers to clients in different types."""
    return df.fillna(-1, subset=list(names))


# ---- conform -------------------------------------------------------------------------------------------------------


def parsed_stations(spark, sf):
    return conform.parse_stations(fx.stations_raw(spark, sf), unzoned=True)


def parsed_trips(spark, sf):
    return conform.parse_trips(fx.trips_raw(spark, sf), unzoned=True)


@query
def stations_parsed(spark, sf):
    return parsed_stations(spark, sf)


@query
def stations_clean(spark, sf):
    return conform.exclude_pseudo_stations(parsed_stations(spark, sf))


@query
def stations_undated(spark, sf):
    return conform.undated_stations(parsed_stations(spark, sf))


@query
def trips_resolved(spark, sf):
    return conform.resolve_cells(fx.trip_cells(fx.trips_raw(spark, sf)))


@query
def missing_columns(spark, sf):
    """With no column allowed to be absent, the archive without bike types shows up."""
    return conform.missing_columns(fx.trip_cells(fx.trips_raw(spark, sf)), nullable=())


@query
def trips_parsed(spark, sf):
    return without_null_ints(parsed_trips(spark, sf), "duration_s", "start_station_id")


@query
def parse_rate(spark, sf):
    return conform.parse_rate(parsed_trips(spark, sf))


@query
def trip_duration(spark, sf):
    raw = fx.trips_raw(spark, sf)
    timed = raw.select(
        "duration",
        conform.parse_time("start_time", conform.TRIP_TIME_FORMATS, True).alias("start_time"),
        conform.parse_time("end_time", conform.TRIP_TIME_FORMATS, True).alias("end_time"),
    )
    source = F.when(F.col("duration").rlike(r"^\d+$"), "minutes").otherwise("difference")
    counted = timed.groupBy(source.alias("source"), conform.trip_duration().alias("duration_s")).agg(
        F.count(F.lit(1)).alias("n_trips")
    )
    return without_null_ints(counted, "duration_s")


@query
def trips_no_pseudo(spark, sf):
    kept = conform.drop_pseudo_trips(parsed_trips(spark, sf), parsed_stations(spark, sf))
    return without_null_ints(kept, "duration_s", "start_station_id")


@query
def trips_filtered(spark, sf):
    return conform.filter_trips(parsed_trips(spark, sf), CONTRACT)


@query
def drop_report(spark, sf):
    return conform.drop_report(parsed_trips(spark, sf), parsed_stations(spark, sf), CONTRACT)


@query
def merge_report(spark, sf):
    return conform.merge_report(parsed_trips(spark, sf), "trip_id")


@query
def station_report(spark, sf):
    return conform.station_report(fx.stations_raw(spark, sf), parsed_stations(spark, sf))


@query
def trips_dedup(spark, sf):
    return without_null_ints(conform.deduplicate(parsed_trips(spark, sf), ["trip_id"]), "duration_s", "start_station_id")


@query
def trips_clean(spark, sf):
    resolved = conform.resolve_cells(fx.trip_cells(fx.trips_raw(spark, sf)))
    return conform.clean_trips(resolved, parsed_stations(spark, sf), CONTRACT, unzoned=True)


@query
def local_hour(spark, sf):
    trips = parsed_trips(spark, sf).filter("start_time IS NOT NULL")
    utc = local_to_utc(hour_floor(trips, "start_time"), CONTRACT.timezone)
    return trips.groupBy(utc.alias("hour_utc")).agg(F.count(F.lit(1)).alias("n_trips"))


# ---- trajectories --------------------------------------------------------------------------------------------------


def kept_trips(spark, sf):
    """Typed rides under the conform rules: the input of everything below."""
    trips = conform.filter_trips(fx.trips(spark, sf), CONTRACT)
    return conform.drop_pseudo_trips(trips, parsed_stations(spark, sf))


def chain(spark, sf):
    """Trajectories and the end of the window, over one derivation of the rides."""
    trips = kept_trips(spark, sf)
    return trajectories.bike_trajectories(trips, measured_on=fx.bikes(spark, sf)), trajectories.window_end(trips)


def traj(spark, sf):
    return chain(spark, sf)[0]


def events(spark, sf):
    chained, end = chain(spark, sf)
    return trajectories.movement_events(chained, RULES, end)


def trajectory_columns(chained):
    rows = chained.select(
        "trip_id", "bike_id", "start_time", "end_time", "start_station_id", "end_station_id", "next_start_time",
        "next_start_station", "trip_seq", "is_first_trip", "is_last_trip",
    )
    return without_null_ints(rows, "next_start_station")


@query
def bike_trajectories(spark, sf):
    return trajectory_columns(traj(spark, sf))


@query
def bike_trajectories_sliced(spark, sf):
    """The same with every bike of more than five trips cut into slices of about three."""
    return trajectory_columns(trajectories.bike_trajectories(kept_trips(spark, sf), hot_rows=5, slice_rows=3))


def same_second_trips(spark, sf):
    """Every second bike has all its rides of a month at one and the same second."""
    even = F.try_mod(F.substring("bike_id", 2, 9).cast("int"), F.lit(2)) == 0
    first = F.date_trunc("month", "start_time").cast("timestamp_ntz")
    return kept_trips(spark, sf).withColumn("start_time", F.when(even, first).otherwise(F.col("start_time")))


@query
def bike_trajectories_same_second(spark, sf):
    """Keys that only the trip id orders, in slices of about twenty rows."""
    trips = same_second_trips(spark, sf)
    return trajectory_columns(trajectories.bike_trajectories(trips, hot_rows=60, slice_rows=20))


@query
def relocations(spark, sf):
    return trajectories.relocations(traj(spark, sf)).select(
        "trip_id", "bike_id", "end_station_id", "next_start_station", "gap_h"
    )


@query
def rebalancing_events(spark, sf):
    return trajectories.rebalancing_events(traj(spark, sf), RULES)


@query
def fleet_events(spark, sf):
    chained, end = chain(spark, sf)
    return trajectories.fleet_events(chained, RULES, end)


@query
def movement_events(spark, sf):
    return events(spark, sf)


# ---- grid and ledger -----------------------------------------------------------------------------------------------


@query
def window_bounds(spark, sf):
    return grid.window_bounds(kept_trips(spark, sf))


@query
def hour_spine(spark, sf):
    return grid.hour_spine(grid.window_bounds(kept_trips(spark, sf)))


@query
def station_activity(spark, sf):
    return grid.station_activity(kept_trips(spark, sf))


@query
def stations_unseen(spark, sf):
    return grid.unseen_stations(fx.stations(spark, sf), grid.station_activity(kept_trips(spark, sf)))


@query
def station_hour_grid(spark, sf):
    trips = kept_trips(spark, sf)
    return grid.station_hour_grid(
        fx.stations(spark, sf), grid.station_activity(trips), grid.window_bounds(trips), RULES
    )


def grid_bounds(spark, sf):
    trips = kept_trips(spark, sf)
    return grid.station_bounds(
        fx.stations(spark, sf), grid.station_activity(trips), grid.window_bounds(trips), RULES
    )


@query
def off_grid_events(spark, sf):
    return grid.off_grid_events(events(spark, sf), grid_bounds(spark, sf))


@query
def off_grid_share(spark, sf):
    """The same from the station-hour counts, as check rows of the label phase."""
    chained, end = chain(spark, sf)
    return checks.off_grid_share(label_plan.moves_per_station_hour(chained, end, RULES), grid_bounds(spark, sf))


@query
def arrivals(spark, sf):
    return ledger.arrivals(kept_trips(spark, sf))


@query
def departures(spark, sf):
    return ledger.departures(kept_trips(spark, sf))


@query
def rebalance_counts(spark, sf):
    return ledger.rebalance_counts(events(spark, sf))


def panel_tasks(spark, sf):
    return label_plan.panel_tasks(fx.stations(spark, sf), fx.ride_times(spark, sf))


def flows(spark, sf):
    chained, end = chain(spark, sf)
    return label_plan.flows_from(chained, end, fx.stations(spark, sf), RULES, panel_tasks(spark, sf))


@query
def station_hour_flows(spark, sf):
    return flows(spark, sf)


@query
def running_ledger(spark, sf):
    return ledger.running_ledger(flows(spark, sf)).select("station_id", "hour_ts", "delta", "cum_delta")


@query
def occupancy(spark, sf):
    return ledger.occupancy(ledger.running_ledger(flows(spark, sf))).select(
        "station_id", "hour_ts", "o_initial", "occupancy"
    )


def in_train(df: DataFrame):
    return F.col("hour_ts") <= literal_like(df, "hour_ts", CONTRACT.split["train_end"])


@query
def occupancy_fixed_level(spark, sf):
    """Occupancy whose level the train period alone decides."""
    running = ledger.running_ledger(flows(spark, sf))
    return ledger.occupancy(running, in_train(running)).select("station_id", "hour_ts", "o_initial", "occupancy")


@query
def ledger_solve_stats(spark, sf):
    stats = ledger.solve_stats(ledger.running_ledger(flows(spark, sf)))
    return stats.withColumn("mean_initial", F.round("mean_initial", 6))


@query
def rolling_capacity(spark, sf):
    occupied = ledger.occupancy(ledger.running_ledger(flows(spark, sf)))
    return ledger.with_capacity(occupied, RULES).select("station_id", "hour_ts", "capacity")


def labels(spark, sf):
    return ledger.labels_from_flows(flows(spark, sf), RULES)


@query
def station_hour_labels(spark, sf):
    return labels(spark, sf)


@query
def labels_in_runs(spark, sf):
    """Labels of three runs: to the end of train, to the end of validation, and the rest. The second run is repeated."""
    root, panel = scratch_dir(spark), staged(assembly.with_split(flows(spark, sf), CONTRACT))
    for splits in (["train"], ["val"], ["val"], ["test", assembly.AFTER]):
        increments.add_hours(panel.filter(F.col("split").isin(splits)).drop("split"), root, RULES)
    return increments.read_labels(spark, root)


# ---- weather and features ------------------------------------------------------------------------------------------


def weather_table(spark, sf):
    return weather_source.weather_hours(fx.weather_payload(spark, sf), CONTRACT, unzoned=True)


@query
def weather_hours(spark, sf):
    return weather_table(spark, sf).drop("is_daylight")


@query
def daylight(spark, sf):
    return weather_table(spark, sf).select("point_name", "hour_ts", "is_daylight")


@query
def cyclic_time(spark, sf):
    trips = fx.trips(spark, sf)
    hours = trips.select("trip_id", hour_floor(trips, "start_time").alias("hour_ts"))
    names = ("hour_sin", "hour_cos", "dow_sin", "dow_cos")
    return calendar.with_calendar(hours).select("trip_id", *[F.round(c, 6).alias(c) for c in names])


@query
def calendar_features(spark, sf):
    orders = fx.table(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").alias("hour_ts"))
    return calendar.with_calendar(orders).select("o_orderkey", "hour_ts", "is_weekend", "is_holiday", "month")


@query
def federal_holidays(spark, sf):
    """The holidays of the years the orders span, with the orders placed on each."""
    orders = fx.table(spark, sf, "orders")
    bounds = orders.agg(F.min("o_orderdate").alias("lo"), F.max("o_orderdate").alias("hi"))
    placed = orders.groupBy(F.to_date("o_orderdate").alias("holiday")).agg(F.count(F.lit(1)).alias("n_orders"))
    return calendar.federal_holidays(bounds).join(placed, "holiday", "left").select(
        F.col("holiday").cast("timestamp_ntz").alias("holiday"), F.coalesce("n_orders", F.lit(0)).alias("n_orders")
    )


@query
def lag_features(spark, sf):
    lags = ("occupancy_lag_1h", "net_flow_lag_1h", "net_flow_same_hour_last_week")
    return features.with_lags(labels(spark, sf)).select(
        "station_id", "hour_ts", *[F.col(c).cast("double").alias(c) for c in lags]
    )


@query
def rolling_mean_7d(spark, sf):
    return features.with_lags(labels(spark, sf)).select(
        "station_id", "hour_ts", F.round("net_flow_rolling_7d_mean", 6).alias("net_flow_rolling_7d_mean")
    )


@query
def weather_features(spark, sf):
    joined = features.with_weather(labels(spark, sf), weather_table(spark, sf), CONTRACT)
    return joined.select("station_id", "hour_ts", *CONTRACT.hourly, "is_daylight")


def feature_table(spark, sf):
    return features.build_features(labels(spark, sf), weather_table(spark, sf), CONTRACT)


def plain_features(df: DataFrame) -> DataFrame:
    """Features as doubles, rounded, for comparison."""
    rounded = {c: F.round(F.col(c).cast("double"), 6) for c in CONTRACT.features}
    return df.withColumns(rounded)


@query
def station_hour_features(spark, sf):
    return plain_features(feature_table(spark, sf))


# ---- assembly ------------------------------------------------------------------------------------------------------


def split_table(spark, sf):
    return assembly.chronological_split(feature_table(spark, sf), CONTRACT)


def label_splits(spark, sf):
    """Splits of the labels alone, for steps that use no feature."""
    return assembly.chronological_split(labels(spark, sf), CONTRACT)


@query
def chronological_split(spark, sf):
    return label_splits(spark, sf).select("station_id", "hour_ts", "net_flow", "split")


@query
def split_manifest(spark, sf):
    return assembly.split_manifest(labels(spark, sf), CONTRACT)


@query
def class_weight(spark, sf):
    weights = assembly.class_weight(label_splits(spark, sf).filter("split = 'train'"))
    return weights.withColumn("class_weight", F.round("class_weight", 6))


def baseline(spark, sf):
    return assembly.baseline_table(label_splits(spark, sf).filter("split = 'train'"))


@query
def baseline_table(spark, sf):
    return baseline(spark, sf).withColumn("mean_net_flow", F.round("mean_net_flow", 6))


# ---- checks and reports --------------------------------------------------------------------------------------------


def check_values(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in ("observed", "expected")})


@query
def mass_balance(spark, sf):
    return check_values(checks.mass_balance(events(spark, sf)))


@query
def zero_rate(spark, sf):
    return check_values(checks.zero_rate(labels(spark, sf)))


@query
def zero_concentration(spark, sf):
    return checks.zero_concentration(labels(spark, sf)).withColumn("worst_share_pct", F.round("worst_share_pct", 6))


@query
def worst_stations(spark, sf):
    return checks.worst_stations(labels(spark, sf)).withColumn("pct_zero", F.round("pct_zero", 6))


@query
def maintenance_by_month(spark, sf):
    return checks.maintenance_by_month(events(spark, sf))


@query
def leakage_audit(spark, sf):
    return checks.leakage_audit(feature_table(spark, sf), CONTRACT)


@query
def ridership_by_quarter(spark, sf):
    return checks.ridership_by_quarter(kept_trips(spark, sf))


@query
def dataset_card(spark, sf):
    card = checks.dataset_card(kept_trips(spark, sf), labels(spark, sf))
    return card.withColumns({c: F.round(c, 6) for c in ("mean_occupancy", "zero_hour_share", "zero_flow_share")})


@query
def feature_profile(spark, sf):
    profile = checks.feature_profile(feature_table(spark, sf), CONTRACT.features)
    return profile.withColumns({c: F.round(c, 6) for c in profile.columns if c != "feature"})


@query
def recovery_gate(spark, sf):
    return checks.recovery_gate(kept_trips(spark, sf), RULES)


@query
def recovery_gate_faults(spark, sf):
    """The gate over a detector that loses the events of some stations and reports others twice."""

    def faulty(trips, rules):
        found = checks.detected_moves(trips, rules)
        lost = F.col("station_id") % 7 == 0
        return found.filter(~lost).unionByName(found.filter(F.col("station_id") % 11 == 1).filter(~lost))

    return checks.recovery_gate(kept_trips(spark, sf), RULES, faulty)


@query
def leakage_audit_faults(spark, sf):
    """The audit of a table with an undeclared column and without a declared one."""
    table = feature_table(spark, sf).withColumn("bikes_now", F.col("net_flow")).drop(CONTRACT.features[0])
    return checks.leakage_audit(table, CONTRACT)


def looks_ahead(spark, sf, fixed: bool):
    panel, tasks = staged(flows(spark, sf)), panel_tasks(spark, sf)
    known, spread = in_train(panel), label_plan.by_station(panel, tasks)
    return checks.value_leakage(
        spread, lambda f: features.with_lags(ledger.labels_from_flows(f, RULES, known if fixed else None)), ~known
    )


@query
def value_leakage(spark, sf):
    """Columns of train rows that move when later flows are disturbed."""
    return looks_ahead(spark, sf, fixed=False)


@query
def value_leakage_fixed_level(spark, sf):
    """The same with the level fixed by the train period."""
    return looks_ahead(spark, sf, fixed=True)


# ---- metrics -------------------------------------------------------------------------------------------------------


def scored_flow(spark, sf):
    """Test rows with the baseline's prediction."""
    rows = staged(label_splits(spark, sf).select("station_id", "hour_ts", "net_flow", "split"))
    table = assembly.baseline_table(rows.filter("split = 'train'"))
    return assembly.baseline_predictions(rows.filter("split = 'test'"), table)


@query
def baseline_mae(spark, sf):
    mae = metrics.regression_metrics(scored_flow(spark, sf), "net_flow", "pred_flow")
    return mae.select("n_rows", F.round("mae", 6).alias("mae"))


@query
def regression_metrics(spark, sf):
    found = metrics.regression_metrics(scored_flow(spark, sf), "net_flow", "pred_flow")
    return found.withColumns({c: F.round(c, 6) for c in ("mae", "rmse")})


@query
def classification_metrics(spark, sf):
    """A score from last hour's stock, over every labelled hour that has one."""
    lagged = features.with_lags(labels(spark, sf)).filter("occupancy_lag_1h IS NOT NULL")
    scored = staged(lagged.select("is_empty", (1 / (1 + F.col("occupancy_lag_1h"))).alias("p_empty")))
    found = metrics.classification_metrics(scored, "is_empty", "p_empty")
    return found.withColumns({c: F.round(c, 6) for c in ("pr_auc", "roc_auc", "brier", "log_loss")})


@query
def group_share(spark, sf):
    """Linear contributions: weight times distance from the mean, weights one to the number of features."""
    filled = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in CONTRACT.features]
    table = staged(split_table(spark, sf).select(*filled))
    means = table.agg(*[F.avg(c).alias(f"{c}_mean") for c in CONTRACT.features])
    effects = attach(table, means).select(
        *[((i + 1) * (F.col(c) - F.col(f"{c}_mean"))).alias(c) for i, c in enumerate(CONTRACT.features)]
    )
    found = metrics.group_share(effects, CONTRACT.feature_groups)
    return found.withColumns({c: F.round(c, 6) for c in ("mean_abs_effect", "share")})


BIN_EDGES = {
    "precipitation": [0.25, 0.5, 1.0, 2.0],
    "is_daylight": [0.0],
    "occupancy_lag_1h": [0.0, 1.0, 2.0, 3.0, 5.0, 8.0, 13.0],
    "net_flow_lag_1h": [-2.0, -1.0, 0.0, 1.0],
    "net_flow_same_hour_last_week": [-1.0, 0.0, 1.0],
}


@query
def missing_value_splits(spark, sf):
    """Inner nodes of the first boosted tree of depth two: features keep their NULLs, every split learns their side."""
    rows = split_table(spark, sf).filter("split = 'train'").withColumn("is_val", F.lit(False))
    params = boosting.BoostParams(learning_rate=0.2, max_depth=2, min_rows=20, max_rounds=1)
    model = boosting.fit(rows, list(BIN_EDGES), "net_flow", params, edges=list(BIN_EDGES.values()))
    schema = (
        "tree int, node int, feature string, threshold double, missing_left boolean, gain double, n_rows long, "
        "value_left double, value_right double"
    )
    splits = spark.createDataFrame(model.splits(), schema)
    return splits.drop("tree").withColumns({c: F.round(c, 9) for c in ("gain", "value_left", "value_right")})


@query
def net_flow_missing_model(spark, sf):
    """The flow regressor over features with NULLs: fit until three rounds bring no gain, applied to all test rows."""
    # Written once: edges, bins and scores read the features, which are dear to derive.
    rows = staged(split_table(spark, sf))
    known = rows.filter(F.col("split").isin("train", "val")).withColumn("is_val", F.col("split") == "val")
    params = boosting.BoostParams(learning_rate=0.3, max_depth=3, min_rows=20, max_rounds=24, patience=3)
    model = boosting.fit(known, list(CONTRACT.features), CONTRACT.regression_target, params)
    kept = rows.filter("split = 'test'").select("station_id", "hour_ts", "net_flow", *CONTRACT.features)
    return boosting.score(model, kept, "pred_flow").select("station_id", "hour_ts", "net_flow", "pred_flow")


# A fixed ensemble over four label columns: (feature, threshold, share of rows at or below it, tree below, tree above).
FIXED_FEATURES = ["arr", "dep", "occupancy", "capacity"]
FIXED_TREES = [
    (0, 0.0, 0.6, (2, 3.0, 0.5, 0.2, -0.4), (1, 1.0, 0.7, 1.0, (3, 8.0, 0.9, -0.5, 2.0))),
    (2, 1.0, 0.3, -1.0, (2, 5.0, 0.5, (3, 4.0, 0.2, 0.5, 0.1), 0.9)),
    0.25,
]


@query
def shapley_fixed_trees(spark, sf):
    """Shapley values of fixed trees for every test row; one tree tests a feature twice, one is a single leaf."""
    leaves = [leaf for tree in FIXED_TREES for leaf in attribution.tree_leaves(tree)]
    values = F.array(*[F.col(c).cast("double") for c in FIXED_FEATURES]).alias("x")
    rows = test_rows(label_splits(spark, sf)).select("station_id", "hour_ts", values)
    found = attribution.explained(rows, leaves, ["station_id", "hour_ts"], FIXED_FEATURES)
    return found.withColumns({c: F.round(c, 9) for c in (*FIXED_FEATURES, "base_value")})


# ---- sources and sinks ---------------------------------------------------------------------------------------------


@query
def zip_csv_rows(spark, sf):
    """Raw rides written as zips of drifting CSVs, read back and resolved."""
    path = fx.write_trip_zips(fx.trips_raw(spark, sf))
    return conform.resolve_cells(archives.read_zip_csv(spark, path)).drop("archive", "member")


@query
def csv_text_scan(spark, sf):
    path = fx.write_trip_csvs(fx.trips_raw(spark, sf))
    return conform.resolve_columns(archives.read_csv_text(spark, path))


@query
def archive_links(spark, sf):
    """The last page that links each target, over every anchor of every page."""
    links = planning.extract_links(fx.table(spark, sf, "pages"), fx.ANY_LINK, [1])
    return planning.last_link_per_key(links).select("url", "n_links")


def planned(spark, sf):
    orders = fx.table(spark, sf, "orders")
    bounds = orders.agg(F.to_date(F.min("o_orderdate")).alias("first_day"),
                        F.to_date(F.max("o_orderdate")).alias("last_day"))
    points = fx.table(spark, sf, "events").select(F.col("event_type").alias("point_name")).distinct()
    return planning.fetch_plan(points, bounds)


def chunk_times(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("chunk_start", "chunk_end")})


@query
def fetch_plan(spark, sf):
    return chunk_times(planned(spark, sf))


@query
def fetch_missing(spark, sf):
    """Chunks in which their point has events are taken as landed."""
    events = fx.table(spark, sf, "events")
    plan = planned(spark, sf)
    seen = events.select(F.col("event_type").alias("point_name"), F.to_date("ts").alias("day")).distinct()
    landed = plan.join(seen, (plan.point_name == seen.point_name) & (seen.day >= plan.chunk_start)
                       & (seen.day <= plan.chunk_end), "left_semi").select("object_name")
    return chunk_times(planning.still_to_fetch(plan, landed))


@query
def sink_roundtrip(spark, sf):
    """Labels written by month and read back."""
    path = scratch_dir(spark)
    tables.write_partitioned(labels(spark, sf), path, ["part_year", "part_month"])
    return spark.read.parquet(path)


@query
def sink_plain(spark, sf):
    """Clean stations written as a plain table and read back."""
    path = scratch_dir(spark)
    tables.write_table(stations_clean(spark, sf), path)
    return spark.read.parquet(path)


@query
def sink_catalog(spark, sf):
    """Labels registered by month and read through the catalog."""
    path = scratch_dir(spark)
    name = f"labels_{path[-32:]}"
    tables.register_partitioned(labels(spark, sf), name, path, ["part_year", "part_month"])
    return spark.table(name)


@query
def sink_published(spark, sf):
    """Labels published twice, then a write that stops half way and one whose manifest is torn: readers see the second."""
    root = scratch_dir(spark)
    name = f"published_{root[-32:]}"
    by = ["part_year", "part_month"]
    panel = staged(labels(spark, sf))
    tables.publish(panel.filter(F.col("net_flow") == 0), root, by)
    tables.register_published(spark, name, root)
    tables.publish(panel, root, by)
    tables.write_version(panel.filter(F.col("net_flow") > 0), root, by)
    tables.write_manifest(spark, root, tables.latest(spark, root)[0] + 1, "")
    tables.register_published(spark, name, root)
    return spark.table(name)


# ---- models --------------------------------------------------------------------------------------------------------

# Parameters of these queries, not limits of the operators: small trees, as the test panel covers thirty days. The
# patience is short of the rounds, so that fits are stopped and cut to their best prefix here as well.
TREES = models.TreeParams(learning_rate=0.3, max_depth=4, min_rows_per_leaf=20, max_iterations=16, patience=3)


def vectors(spark, sf, contract=CONTRACT):
    """Feature vectors, written once because a fit reads them many times."""
    return staged(models.feature_vectors(split_table(spark, sf), contract))


@query
def feature_vector_sum(spark, sf):
    rows = models.feature_vectors(split_table(spark, sf), CONTRACT)
    total = F.aggregate(vector_to_array("features"), F.lit(0.0), lambda acc, v: acc + v)
    return rows.select("station_id", "hour_ts", F.round(total, 6).alias("vector_sum"), "n_filled")


def test_rows(df: DataFrame) -> DataFrame:
    return df.filter("split = 'test'")


@query
def net_flow_model(spark, sf):
    rows = vectors(spark, sf)
    model = models.train_net_flow(rows, CONTRACT, TREES, "l2")
    return models.score_net_flow(model, test_rows(rows)).select("station_id", "hour_ts", "net_flow", "pred_flow")


@query
def is_empty_model(spark, sf):
    rows = vectors(spark, sf)
    model = models.train_is_empty(rows, CONTRACT, TREES)
    return models.score_is_empty(model, test_rows(rows)).select("station_id", "hour_ts", "is_empty", "p_empty")


@query
def model_gates(spark, sf):
    rows = vectors(spark, sf)
    model = models.train_net_flow(rows, CONTRACT, TREES, "l2")
    scored = models.score_net_flow(model, test_rows(rows))
    table = assembly.baseline_table(rows.filter("split = 'train'"))
    base = assembly.baseline_predictions(test_rows(rows), table)
    return models.model_gates(
        metrics.regression_metrics(scored, "net_flow", "pred_flow"),
        metrics.regression_metrics(base, "net_flow", "pred_flow"),
        model.getNumTrees,
    )


@query
def attribution_sample(spark, sf):
    """The rows that attribution explains: all test rows."""
    rows = test_rows(label_splits(spark, sf)).select("station_id", "hour_ts", "net_flow", "split")
    return models.row_share(rows, ["station_id", "hour_ts"])


@query
def group_attribution(spark, sf):
    rows = vectors(spark, sf)
    model = models.train_net_flow(rows, CONTRACT, TREES, "l2")
    keys = ["station_id", "hour_ts"]
    sample = models.row_share(test_rows(rows), keys)
    return metrics.group_share(
        attribution.contributions(model, sample, keys, CONTRACT.features), CONTRACT.feature_groups
    )


@query
def variant_no_lag(spark, sf):
    """The same attribution by a model that was never shown the lag group."""
    variant = CONTRACT.without_groups(["lag"])
    rows = vectors(spark, sf, variant)
    model = models.train_net_flow(rows, variant, TREES, "l2")
    keys = ["station_id", "hour_ts"]
    sample = models.row_share(test_rows(rows), keys)
    return metrics.group_share(
        attribution.contributions(model, sample, keys, variant.features), variant.feature_groups
    )
