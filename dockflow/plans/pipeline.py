"""The phases from landed files to models, each reading and writing tables below one root.

    python -m dockflow.plans.pipeline labels --root s3://bucket/lake [--contract features.json]

Zones: ``raw`` holds files as downloaded, ``parsed`` the same as Parquet text, ``clean`` conformed trips, stations and
labels, ``training`` features and splits, ``models`` exports.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dockflow.contract import Contract, ContractError, default_contract, load_contract
from dockflow.functions.time import literal_like
from dockflow.operators import assembly, checks, conform, features, grid, ledger, models, trajectories
from dockflow.plans import training
from dockflow.plans.labels import dense_flows, moves_per_station_hour, panel_tasks
from dockflow.session import build_session, scratch_scope, staged
from dockflow.sinks.tables import register_partitioned, write_json, write_partitioned, write_table
from dockflow.sources import archives, weather

LABEL_PARTS = ["part_year", "part_month"]


class Zones:
    def __init__(self, root: str):
        root = root.rstrip("/")
        self.raw, self.parsed, self.clean = f"{root}/raw", f"{root}/parsed", f"{root}/clean"
        self.training, self.models, self.checks = f"{root}/training", f"{root}/models", f"{root}/checks"


def save_partitioned(df: DataFrame, path: str, by: list[str], catalog: str | None, name: str) -> None:
    if catalog:
        register_partitioned(df, f"{catalog}.{name}", path, by)
    else:
        write_partitioned(df, path, by)


def land(spark: SparkSession, zones: Zones, contract: Contract, catalog: str | None = None) -> None:
    """Raw files as Parquet, without judgement. The header audit runs on headers alone, before any row is read."""
    gaps = conform.missing_columns(archives.read_zip_headers(spark, f"{zones.raw}/trips"))
    uncovered = gaps.select("archive", "column_name").limit(checks.NAMED).collect()
    if uncovered:
        raise ContractError(f"{gaps.count()} columns without an alias, among them {[(r[0], r[1]) for r in uncovered]}")
    write_table(archives.read_zip_csv(spark, f"{zones.raw}/trips"), f"{zones.parsed}/trips")
    checks.require_rows(spark.read.parquet(f"{zones.parsed}/trips"), "trip archives")

    stations = conform.parse_stations(archives.read_csv_text(spark, f"{zones.raw}/stations"))
    write_table(stations, f"{zones.parsed}/stations")
    landed = spark.read.parquet(f"{zones.parsed}/stations")
    checks.require_rows(landed, "station table")
    write_json(conform.undated_stations(landed), f"{zones.checks}/stations_undated")

    hours = weather.weather_hours(weather.read_payloads(spark, f"{zones.raw}/weather"), contract)
    write_table(hours, f"{zones.parsed}/weather")
    checks.require_rows(spark.read.parquet(f"{zones.parsed}/weather"), "weather documents")


def conform_phase(spark: SparkSession, zones: Zones, contract: Contract, catalog: str | None = None) -> None:
    """Clean stations and trips. Text is parsed once; the gates read the typed columns they need."""
    stations = spark.read.parquet(f"{zones.parsed}/stations")
    write_table(conform.exclude_pseudo_stations(stations), f"{zones.clean}/stations")

    resolved = conform.resolve_cells(spark.read.parquet(f"{zones.parsed}/trips"))
    parsed = staged(conform.parse_trips(resolved))
    rate = staged(conform.parse_rate(parsed))
    write_json(rate, f"{zones.checks}/parse_rate")
    if not rate.filter("status = 'FAIL'").isEmpty():
        raise ContractError("more than 1% of the trips have an unreadable time: the published format changed")
    write_json(conform.drop_report(parsed, stations, contract), f"{zones.checks}/drop_report")
    kept = conform.drop_pseudo_trips(conform.filter_trips(parsed, contract), stations)
    write_json(conform.merge_report(kept, "trip_id"), f"{zones.checks}/merge_report")
    save_partitioned(
        conform.clean_parsed_trips(parsed, stations, contract), f"{zones.clean}/trips", ["year", "month"], catalog,
        "clean_trips",
    )


def labels_phase(spark: SparkSession, zones: Zones, contract: Contract, catalog: str | None = None) -> None:
    """Labels and the ledger's diagnostics, from one pass over the trajectories."""
    trips = spark.read.parquet(f"{zones.clean}/trips")
    stations = spark.read.parquet(f"{zones.clean}/stations")
    rules = contract.labels
    end = trajectories.window_end(trips)
    write_table(
        moves_per_station_hour(trajectories.bike_trajectories(trips), end, rules), f"{zones.clean}/station_hour_moves"
    )
    moves = spark.read.parquet(f"{zones.clean}/station_hour_moves")
    path = f"{zones.clean}/station_hour_labels"
    save_partitioned(
        ledger.labels_from_flows(dense_flows(moves, stations, end, rules, panel_tasks(stations, trips)), rules), path,
        LABEL_PARTS, catalog, "station_hour_labels",
    )
    labels = spark.read.parquet(path)
    gates = checks.mass_balance_of_moves(moves).unionByName(checks.zero_rate(labels))
    bounds = grid.station_bounds(stations, grid.station_activity(trips), grid.window_bounds(trips), rules)
    gates = gates.unionByName(checks.off_grid_share(moves, bounds))
    write_json(gates, f"{zones.checks}/ledger")
    write_json(checks.zero_concentration(labels), f"{zones.checks}/zero_concentration")
    write_json(checks.worst_stations(labels), f"{zones.checks}/worst_stations")
    write_json(checks.maintenance_by_month_of_moves(moves), f"{zones.checks}/maintenance_by_month")


def gate_phase(spark: SparkSession, zones: Zones, contract: Contract, catalog: str | None = None) -> None:
    """The recovery gate over the clean trips: its rows are written, and a failed one of severity `error` ends the run."""
    trips = spark.read.parquet(f"{zones.clean}/trips")
    gates = staged(checks.recovery_gate(trips, contract.labels))
    write_json(gates, f"{zones.checks}/recovery_gate")
    checks.enforce(gates)


def features_phase(spark: SparkSession, zones: Zones, contract: Contract, catalog: str | None = None) -> None:
    hours = spark.read.parquet(f"{zones.parsed}/weather")
    point = hours.filter(F.col("point_name") == contract.weather_point)
    checks.require_rows(point, f"weather at grid point {contract.weather_point!r}")
    labels = spark.read.parquet(f"{zones.clean}/station_hour_labels")
    table = features.build_features(labels, hours, contract)
    checks.require_declared(table, contract)
    later = F.col("hour_ts") > literal_like(labels, "hour_ts", contract.split["train_end"])
    write_json(
        checks.value_leakage(
            labels.select("station_id", "hour_ts", *ledger.COUNTS, "net_flow"),
            lambda flows: features.build_features(ledger.labels_from_flows(flows, contract.labels), hours, contract),
            later,
        ),
        f"{zones.checks}/value_leakage",
    )
    save_partitioned(
        table, f"{zones.clean}/station_hour_features", LABEL_PARTS, catalog, "station_hour_features"
    )


def assembly_phase(spark: SparkSession, zones: Zones, contract: Contract, catalog: str | None = None) -> None:
    """One wide table partitioned by split first, so that reading a split prunes the others."""
    table = spark.read.parquet(f"{zones.clean}/station_hour_features")
    path = f"{zones.training}/station_hour_features"
    save_partitioned(
        assembly.with_split(table, contract), path, ["split", *LABEL_PARTS], catalog, "training_station_hour_features"
    )
    wide = spark.read.parquet(path)
    train = wide.filter("split = 'train'")
    write_json(assembly.published_baseline(assembly.baseline_table(train)), f"{zones.training}/baseline")
    write_json(assembly.split_manifest(wide.drop("split"), contract), f"{zones.training}/split_manifest")
    write_json(assembly.class_weight(train), f"{zones.training}/class_weight")


def train_phase(
    spark: SparkSession,
    zones: Zones,
    contract: Contract,
    params: models.TreeParams = models.TreeParams(),
    objective: str = "l1",
    drop_groups: tuple[str, ...] = (),
    share: float = 1.0,
) -> None:
    splits = spark.read.parquet(f"{zones.training}/station_hour_features").filter(F.col("split") != assembly.AFTER)
    result = training.train(splits, contract, params, objective, drop_groups, share)
    name = "-".join(["current" if not drop_groups else "without", *sorted(drop_groups)])
    training.export(result, contract, f"{zones.models}/{name}", drop_groups)
    write_json(result.gates, f"{zones.models}/{name}/gates")


PHASES = {
    "land": land,
    "conform": conform_phase,
    "gate": gate_phase,
    "labels": labels_phase,
    "features": features_phase,
    "assembly": assembly_phase,
}


def main() -> None:
    ap = argparse.ArgumentParser(description="Run one phase.")
    ap.add_argument("phase", choices=[*PHASES, "train"])
    ap.add_argument("--root", required=True, help="folder that holds the zones")
    ap.add_argument("--contract", help="contract JSON; the packaged one when absent")
    ap.add_argument("--catalog", help="database to register partitioned tables in")
    ap.add_argument("--learning-rate", type=float, default=0.05)
    ap.add_argument("--max-depth", type=int, default=6)
    ap.add_argument("--min-data-in-leaf", type=int, default=200)
    ap.add_argument("--max-iterations", type=int, default=2000)
    ap.add_argument("--shap-share", type=float, default=1.0, help="share of the test rows to explain")
    ap.add_argument("--objective", choices=sorted(models.LOSSES), default="l1")
    ap.add_argument("--drop-feature-groups", default="", help="comma-separated groups to leave out")
    args = ap.parse_args()

    packaged = default_contract()
    spark = build_session(f"dockflow-{args.phase}", packaged.timezone)
    contract = load_contract(spark, args.contract) if args.contract else packaged
    spark.conf.set("spark.sql.session.timeZone", contract.timezone)
    zones = Zones(args.root)
    if args.phase != "train":
        with scratch_scope(spark):
            PHASES[args.phase](spark, zones, contract, args.catalog)
        return
    params = models.TreeParams(
        learning_rate=args.learning_rate,
        max_depth=args.max_depth,
        min_rows_per_leaf=args.min_data_in_leaf,
        max_iterations=args.max_iterations,
    )
    dropped = tuple(sorted({g.strip() for g in args.drop_feature_groups.split(",") if g.strip()}))
    with scratch_scope(spark):
        train_phase(spark, zones, contract, params, args.objective, dropped, args.shap_share)


if __name__ == "__main__":
    main()
