"""Quality gates. Every gate is a table of check rows; ``enforce`` turns a failed one into an error."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dockflow.contract import CALENDAR_FEATURES, KEY_COLUMNS, LABEL_COLUMNS, Contract, ContractError, LabelRules
from dockflow.functions.single import attach
from dockflow.functions.time import month_floor
from dockflow.operators import grid, trajectories

ZERO_RATE_LIMIT = 15.0
WORST_STATIONS = 20


def check_row(name: str, passed: Column, observed: Column, expected: Column, severity: str, failed: str = "FAIL"):
    return F.struct(
        F.lit(name).alias("check"),
        F.when(passed, "OK").otherwise(failed).alias("status"),
        observed.cast("double").alias("observed"),
        expected.cast("double").alias("expected"),
        F.lit(severity).alias("severity"),
    )


#: An error text names so many failures, and says how many there were in all.
NAMED = 20


def enforce(checks: DataFrame) -> None:
    """Raise on any failed check of severity ``error``. Check tables hold a few rows."""
    failed = checks.filter("severity = 'error' AND status = 'FAIL'")
    bad = failed.limit(NAMED).collect()
    if bad:
        named = "; ".join(f"{r['check']}: observed {r['observed']}, expected {r['expected']}" for r in bad)
        raise ContractError(named if len(bad) < NAMED else f"{failed.count()} checks failed, among them {named}")


def require_rows(df: DataFrame, what: str) -> None:
    if df.isEmpty():
        raise ContractError(f"no rows: {what}")


def mass_balance(events: DataFrame) -> DataFrame:
    """Relocations pair up, so what is left over must be the bikes that entered and did not leave."""
    return _balance(events.agg(
        F.count_if(F.col("event_type") == "reb_in").alias("n_in"),
        F.count_if(F.col("event_type") == "reb_out").alias("n_out"),
        F.count_if(F.col("event_kind") == "fleet_entry").alias("n_entry"),
        F.count_if(F.col("event_kind") == "fleet_exit").alias("n_exit"),
    ))


def mass_balance_of_moves(moves: DataFrame) -> DataFrame:
    """The same from the station-hour counts, without deriving the events again."""
    names = {"n_in": "reb_in", "n_out": "reb_out", "n_entry": "fleet_entry", "n_exit": "fleet_exit"}
    return _balance(moves.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(n) for n, c in names.items()]))


def _balance(counts: DataFrame) -> DataFrame:
    left, expected = F.col("n_in") - F.col("n_out"), F.col("n_entry") - F.col("n_exit")
    return counts.select(F.inline(F.array(check_row("mass_balance", left == expected, left, expected, "warn"))))


def off_grid_share(moves: DataFrame, ranged: DataFrame) -> DataFrame:
    """Inferred moves that no grid row counts, from the station-hour counts: one check row for each direction."""
    placed = grid.event_places(moves.select("station_id", "hour_ts", "reb_in", "reb_out"), ranged)
    off = F.col("place") != grid.PLACES[0]
    names = ("reb_in", "reb_out")
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names]
    sums += [F.coalesce(F.sum(F.when(off, F.col(c))), F.lit(0)).alias(f"{c}_off") for c in names]
    rows = [
        check_row(f"off_grid_{c}", F.col(f"{c}_off") == 0, F.col(f"{c}_off"), F.lit(0), "warn", failed="REVIEW")
        for c in names
    ]
    return placed.agg(*sums).select(F.inline(F.array(*rows)))


def station_zero_hours(labels: DataFrame) -> DataFrame:
    return labels.groupBy("station_id").agg(
        F.count(F.lit(1)).alias("n_hours"), F.count_if(F.col("occupancy") < 1.0).alias("n_zero")
    )


def zero_rate(labels: DataFrame, limit: float = ZERO_RATE_LIMIT) -> DataFrame:
    totals = station_zero_hours(labels).agg(F.sum("n_hours").alias("n_hours"), F.sum("n_zero").alias("n_zero"))
    rate = F.try_divide(100.0 * F.col("n_zero"), "n_hours")
    return totals.select(
        F.inline(F.array(check_row("zero_rate", rate < limit, rate, F.lit(limit), "warn", failed="REVIEW")))
    )


def zero_concentration(labels: DataFrame, worst: int = WORST_STATIONS) -> DataFrame:
    """Dead stations or drift: how much of all empty hours the worst stations hold."""
    per_station = station_zero_hours(labels)
    total = per_station.agg(
        F.count(F.lit(1)).alias("n_stations"),
        F.count_if(F.col("n_zero") == F.col("n_hours")).alias("n_dead"),
        F.sum("n_zero").alias("n_zero"),
    )
    top = per_station.orderBy(F.desc("n_zero"), "station_id").limit(worst).agg(F.sum("n_zero").alias("n_zero_worst"))
    share = F.when(F.col("n_zero") > 0, 100.0 * F.col("n_zero_worst") / F.col("n_zero")).otherwise(0.0)
    return attach(total, top).withColumn("worst_share_pct", share)


def worst_stations(labels: DataFrame, n: int = 5) -> DataFrame:
    top = station_zero_hours(labels).orderBy(F.desc("n_zero"), "station_id").limit(n)
    return top.withColumn("pct_zero", 100.0 * F.col("n_zero") / F.col("n_hours"))


def maintenance_by_month(events: DataFrame) -> DataFrame:
    removed = events.filter(F.col("event_kind") == "maintenance_removal")
    counted = removed.groupBy(month_floor(removed, "event_time").alias("month"))
    return counted.agg(F.count(F.lit(1)).alias("n_removals"))


def maintenance_by_month_of_moves(moves: DataFrame) -> DataFrame:
    """The same from the station-hour counts, which carry both events of each removal."""
    counted = moves.groupBy(month_floor(moves, "hour_ts").alias("month"))
    return counted.agg(F.sum("maintenance_removal").alias("n_removals")).filter("n_removals > 0")


def disturbed(flows: DataFrame, later: Column, count: str) -> DataFrame:
    """Flows with one of their counts raised in all later rows, by one to twenty-four with the hour of the day."""
    raised = F.when(later, F.col(count) + F.hour("hour_ts") + 1).otherwise(F.col(count))
    return flows.withColumn(count, raised).withColumn("net_flow", F.col("arr") - F.col("dep"))


def value_leakage(
    flows: DataFrame, build: Callable[[DataFrame], DataFrame], later: Column, keys: tuple[str, ...] = ("station_id", "hour_ts")
) -> DataFrame:
    """Which columns of earlier rows depend on later ones, found by value: (column_name, n_rows, n_moved, status).

    ``build`` is run on the flows and on two disturbed copies, one with more arrivals and one with more departures after
    the split, so that a dependence on later highs and one on later lows both show. A row counts once for a column that
    any copy moves; NULL and a value differ. A name audit cannot see this: a feature may be declared and still look ahead.
    """
    earlier = build(flows).filter(~later)
    names = [c for c in earlier.columns if c not in keys]
    rows = earlier
    for number, count in enumerate(("arr", "dep")):
        copy = build(disturbed(flows, later, count)).filter(~later)
        rows = rows.join(copy.select(*keys, F.struct(*names).alias(f"copy_{number}")), list(keys), "left")
    moved = lambda c: ~F.col(c).eqNullSafe(F.col(f"copy_0.{c}")) | ~F.col(c).eqNullSafe(F.col(f"copy_1.{c}"))
    counts = rows.agg(F.count(F.lit(1)).alias("n_rows"), *[F.count_if(moved(c)).alias(c) for c in names])
    entry = lambda c: F.struct(F.lit(c).alias("column_name"), "n_rows", F.col(c).alias("n_moved"))
    return counts.select(F.inline(F.array(*[entry(c) for c in names]))).withColumn(
        "status", F.when(F.col("n_moved") > 0, "LOOKS AHEAD").otherwise("OK")
    )


def leakage_audit(features: DataFrame, contract: Contract) -> DataFrame:
    """Every column that is no key or label must be a declared feature, and every declared feature must be there.

    Names are compared from the schema; the table is read once to say how many values each column holds.
    """
    declared = set(contract.features)
    present = [c for c in features.columns if c not in KEY_COLUMNS and c not in LABEL_COLUMNS]
    names = sorted(declared | set(present))
    counts = features.agg(*[(F.count(c) if c in present else F.lit(None).cast("long")).alias(c) for c in names])
    rows = F.array(*[
        F.struct(
            F.lit(c).alias("column_name"),
            F.lit(c in declared).alias("declared"),
            F.lit(c in present).alias("present"),
            F.lit("OK" if c in declared and c in present else "FAIL" if c not in declared else "WARN").alias("status"),
            F.coalesce(F.col(c), F.lit(0)).cast("long").alias("n_values"),
        )
        for c in names
    ])
    return counts.select(F.inline(rows))


def require_declared(features: DataFrame, contract: Contract) -> None:
    """The gate of the audit: needs the schema only."""
    known = {*contract.features, *KEY_COLUMNS, *LABEL_COLUMNS}
    undeclared = sorted(set(features.columns) - known)
    if undeclared:
        raise ContractError(f"undeclared columns reached the feature table: {undeclared}")
    unbuilt = [c for c in CALENDAR_FEATURES if c not in features.columns]
    if unbuilt:
        raise ContractError(f"calendar features were not built: {unbuilt}")


def ridership_by_quarter(trips: DataFrame) -> DataFrame:
    quarter = F.quarter("start_time")
    return trips.groupBy(F.year("start_time").alias("year")).agg(
        *[F.count_if(quarter == q).alias(f"q{q}") for q in (1, 2, 3, 4)]
    )


def dataset_card(trips: DataFrame, labels: DataFrame) -> DataFrame:
    t = trips.agg(F.count(F.lit(1)).alias("n_trips"), F.countDistinct("bike_id").alias("n_bikes"))
    panel = labels.groupBy("station_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("hour_ts").alias("lo"),
        F.max("hour_ts").alias("hi"),
        F.sum("occupancy").alias("occupancy"),
        F.count_if("is_empty").alias("n_empty"),
        F.count_if(F.col("net_flow") == 0).alias("n_still"),
    )
    span = F.unix_timestamp(F.max("hi")) - F.unix_timestamp(F.min("lo"))
    p = panel.agg(
        F.count(F.lit(1)).alias("n_stations"),
        F.sum("n").alias("n_station_hours"),
        (F.floor(span / 3600) + 1).alias("n_hours"),
        (F.sum("occupancy") / F.sum("n")).alias("mean_occupancy"),
        (F.sum("n_empty") / F.sum("n")).alias("zero_hour_share"),
        (F.sum("n_still") / F.sum("n")).alias("zero_flow_share"),
    )
    return attach(t, p)


def feature_profile(features: DataFrame, names: list[str]) -> DataFrame:
    """Range, spread, and share of nulls and zeros per feature, from one aggregation."""
    def stats(c: str) -> Column:
        v = F.col(c).cast("double")
        return F.struct(
            F.lit(c).alias("feature"),
            F.min(v).alias("min_value"),
            F.max(v).alias("max_value"),
            F.stddev_samp(v).alias("stddev"),
            F.avg(F.when(v.isNull(), 1.0).otherwise(0.0)).alias("null_share"),
            F.avg(F.when(v == 0, 1.0).otherwise(0.0)).alias("zero_share"),
        )

    return features.agg(*[stats(c).alias(c) for c in names]).select(F.inline(F.array(*names)))


def detected_moves(trips: DataFrame, rules: LabelRules) -> DataFrame:
    """The rebalancing events that the engine infers. Histories of two trips each: no key needs to be measured or cut."""
    return trajectories.rebalancing_events(trajectories.bike_trajectories(trips, measured_on=trips.limit(0)), rules)


def recovery_gate(
    trips: DataFrame, rules: LabelRules, detect: Callable[[DataFrame, LabelRules], DataFrame] = detected_moves
) -> DataFrame:
    """Plant a known move behind every trip and demand exactly its two events back from ``detect``.

    Each trip becomes the first of a two-trip history; the second starts elsewhere after a short, a middle or a long
    gap. Planted and recovered events are netted against each other by key, so any multiplicity shows.
    """
    short, long_ = rules.rebalance_short_gap_hours, rules.rebalance_long_gap_hours
    gaps = F.array(*[F.lit(h) for h in (max(short // 3, 1), (short + long_) // 2, long_ + 28)])
    base = trips.select(
        F.col("trip_id").alias("n"),
        "start_time",
        "end_time",
        F.col("start_station_id").alias("a"),
        F.col("end_station_id").alias("b"),
        (F.col("end_station_id") + 100_000).alias("c"),
        F.element_at(gaps, F.pmod("trip_id", F.lit(3)).cast("int") + 1).alias("gap_h"),
    ).withColumn("again", F.expr("timestampadd(HOUR, gap_h, end_time)"))
    bike = F.concat(F.lit("planted-"), F.col("n").cast("string"))

    def trip(offset: int, start: Column, end: Column, origin: str, target: str) -> Column:
        return F.struct(
            (F.col("n") * 2 + offset).alias("trip_id"),
            bike.alias("bike_id"),
            start.alias("start_time"),
            end.alias("end_time"),
            F.col(origin).alias("start_station_id"),
            F.col(target).alias("end_station_id"),
        )

    planted = base.select(F.inline(F.array(
        trip(0, F.col("start_time"), F.col("end_time"), "a", "b"),
        trip(1, F.col("again"), F.expr("again + INTERVAL 15 MINUTES"), "c", "a"),
    )))
    edge = rules.edge_offset_hours
    is_short = F.col("gap_h") < short
    kind = F.when(F.col("gap_h") >= long_, "maintenance_removal").otherwise("rebalance")

    def event(station: str, shift: Column, event_type: str) -> Column:
        return F.struct(
            F.col(station).alias("station_id"),
            F.timestamp_add("MINUTE", shift.cast("int"), F.col("end_time")).alias("event_time"),
            F.lit(event_type).alias("event_type"),
            kind.alias("event_kind"),
        )

    half, whole = F.col("gap_h") * 30, F.col("gap_h") * 60
    expected = base.select(F.inline(F.array(
        event("b", F.when(is_short, half).otherwise(F.lit(edge * 60)), "reb_out"),
        event("c", F.when(is_short, half).otherwise(whole - edge * 60), "reb_in"),
    )))
    found = detect(planted, rules)
    keys = ["station_id", "event_time", "event_type", "event_kind"]
    netted = (
        expected.withColumn("w", F.lit(1)).unionByName(found.withColumn("w", F.lit(-1)))
        .groupBy(*keys).agg(F.sum("w").alias("net"), F.count_if(F.col("w") == 1).alias("planted"))
    )
    n = netted.agg(
        F.coalesce(F.sum("planted"), F.lit(0)).alias("planted"),
        F.coalesce(F.sum(F.greatest("net", F.lit(0))), F.lit(0)).alias("missing"),
        F.coalesce(F.sum(F.greatest(-F.col("net"), F.lit(0))), F.lit(0)).alias("spurious"),
    )
    recovered = F.col("planted") - F.col("missing")
    zero = F.lit(0)
    return n.select(F.inline(F.array(
        check_row("recovered", recovered == F.col("planted"), recovered, F.col("planted"), "error"),
        check_row("missing", F.col("missing") == 0, F.col("missing"), zero, "error"),
        check_row("spurious", F.col("spurious") == 0, F.col("spurious"), zero, "error"),
    )))
