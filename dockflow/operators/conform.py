"""From published text to clean trips and stations."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dockflow.contract import (
    COLUMN_ALIASES,
    GO_LIVE_FORMATS,
    NULLABLE_COLUMNS,
    PSEUDO_STATION_NAME,
    STATION_ALIASES,
    TRIP_TIME_FORMATS,
    Contract,
    ContractError,
    normalise_name,
)
from dockflow.functions.single import attach
from dockflow.functions.time import HOUR, literal_like, parse_time, seconds, text_to_int
from dockflow.schemas import clean_trip_schema
from dockflow.session import staged


def _normalised(aliases: list[str]) -> list[str]:
    return list(dict.fromkeys(normalise_name(a) for a in aliases))


def resolve_columns(df: DataFrame, aliases=None, nullable=NULLABLE_COLUMNS) -> DataFrame:
    """Pick the canonical columns from a table whose header drifted.

    A table joined from files with different headers has several columns for one canonical name; a row uses whichever
    its own file had.
    """
    aliases = aliases or COLUMN_ALIASES
    by_name: dict[str, list[str]] = {}
    for column in df.columns:
        by_name.setdefault(normalise_name(column), []).append(column)
    picked, missing = [], []
    for canonical, names in aliases.items():
        found = [c for n in _normalised(names) for c in by_name.get(n, [])]
        if found:
            picked.append(F.coalesce(*[F.col(f"`{c}`") for c in found]).alias(canonical))
        elif canonical in nullable:
            picked.append(F.lit(None).cast("string").alias(canonical))
        else:
            missing.append(canonical)
    if missing:
        raise ContractError(f"no alias covers {missing}; columns present: {df.columns}")
    return df.select(*picked)


def _cells_by_name(cells: str) -> Column:
    return F.transform_keys(cells, lambda k, _: F.replace(F.lower(k), F.lit(" "), F.lit("_")))


def resolve_cells(df: DataFrame, aliases=None, cells: str = "cells") -> DataFrame:
    """The same for header-keyed cells, so every archive is read by its own header. Other columns are kept."""
    aliases = aliases or COLUMN_ALIASES
    named = df.withColumn("_named", _cells_by_name(cells))
    picked = [
        F.coalesce(*[F.col("_named")[n] for n in _normalised(names)]).alias(canonical)
        for canonical, names in aliases.items()
    ]
    return named.select(*[c for c in df.columns if c != cells], *picked)


def missing_columns(df: DataFrame, aliases=None, nullable=NULLABLE_COLUMNS, cells: str = "cells") -> DataFrame:
    """Canonical columns that some archive's header lacks, with the number of its rows: empty when all are covered."""
    aliases = aliases or COLUMN_ALIASES
    named = df.withColumn("_named", _cells_by_name(cells))
    required = {c: _normalised(a) for c, a in aliases.items() if c not in nullable}

    def absent(names: list[str]) -> Column:
        has = F.lit(False)
        for n in names:
            has = has | F.map_contains_key("_named", n)
        return F.count_if(~has)

    counts = named.groupBy("archive").agg(*[absent(names).alias(c) for c, names in required.items()])
    listed = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("n_rows")) for c in required])
    return counts.select("archive", F.inline(listed)).filter("n_rows > 0")


def parse_trips(resolved: DataFrame, unzoned: bool = False) -> DataFrame:
    """Typed trips: times by the first fitting format, whole-minute durations as seconds, keys as integers.

    Times and stations are generated columns because filters are not pushed below a generator: pushed below a
    projection, each condition on them would read the text again.
    """
    typed = F.struct(
        parse_time("start_time", TRIP_TIME_FORMATS, unzoned).alias("start_time"),
        parse_time("end_time", TRIP_TIME_FORMATS, unzoned).alias("end_time"),
        text_to_int("start_station").alias("start_station_id"),
        text_to_int("end_station").alias("end_station_id"),
    )
    text = [c for c in resolved.columns if c not in ("start_time", "end_time")]
    return resolved.select(*text, F.inline(F.array(typed))).select(
        F.col("trip_id").try_cast("long").alias("trip_id"),
        trip_duration().alias("duration_s"),
        "start_time",
        "end_time",
        "start_station_id",
        "end_station_id",
        "bike_id",
        "bike_type",
        "passholder_type",
    )


def trip_duration() -> Column:
    """Digits are minutes; anything else falls back to the time between start and end."""
    minutes = F.col("duration").try_cast("int").cast("long") * 60
    return F.when(F.col("duration").rlike(r"^\d+$"), minutes).otherwise(seconds("end_time") - seconds("start_time"))


def parse_rate(parsed: DataFrame, max_percent: float = 1.0) -> DataFrame:
    """How many rows have an unreadable time; more than ``max_percent`` means the published format changed."""
    bad = F.count_if(F.col("start_time").isNull() | F.col("end_time").isNull())
    counts = parsed.agg(F.count(F.lit(1)).alias("n_rows"), bad.alias("n_unparsed"))
    pct = F.when(F.col("n_rows") > 0, 100.0 * F.col("n_unparsed") / F.col("n_rows")).otherwise(0.0)
    return counts.withColumn("pct_unparsed", pct).withColumn(
        "status", F.when(F.col("pct_unparsed") > max_percent, "FAIL").otherwise("OK")
    )


def is_pseudo_station() -> Column:
    return F.lower(F.coalesce(F.col("station_name"), F.lit(""))) == PSEUDO_STATION_NAME


def pseudo_stations(stations: DataFrame) -> DataFrame:
    return stations.filter(is_pseudo_station()).select("station_id").distinct()


def exclude_pseudo_stations(stations: DataFrame) -> DataFrame:
    """Drop every directory row of a pseudo-station, matched by name."""
    return stations.filter(~is_pseudo_station())


def flag_pseudo_trips(trips: DataFrame, stations: DataFrame) -> DataFrame:
    """Mark trips that touch a pseudo-station at either end.

    No hint: Spark compares the directory's size with its broadcast threshold, and a directory above it is merged with
    AQE splitting the busy stations.
    """
    pseudo = pseudo_stations(stations)
    at_start = pseudo.select(F.col("station_id").alias("start_station_id"), F.lit(True).alias("_pseudo_start"))
    at_end = pseudo.select(F.col("station_id").alias("end_station_id"), F.lit(True).alias("_pseudo_end"))
    marked = trips.join(at_start, "start_station_id", "left").join(at_end, "end_station_id", "left")
    flag = F.coalesce("_pseudo_start", "_pseudo_end", F.lit(False))
    return marked.select(*trips.columns, flag.alias("is_pseudo"))


def drop_pseudo_trips(trips: DataFrame, stations: DataFrame) -> DataFrame:
    pseudo = pseudo_stations(stations)
    at_start = pseudo.select(F.col("station_id").alias("start_station_id"))
    at_end = pseudo.select(F.col("station_id").alias("end_station_id"))
    return trips.join(at_start, "start_station_id", "left_anti").join(at_end, "end_station_id", "left_anti").select(
        *trips.columns
    )


def trip_rules(trips: DataFrame, contract: Contract) -> dict[str, Column]:
    """What a trip must satisfy, rule by rule. The lower duration bound is strict."""
    rules = contract.labels
    return {
        "has_stations": F.col("start_station_id").isNotNull() & F.col("end_station_id").isNotNull(),
        "long_enough": F.col("duration_s") > rules.min_trip_seconds,
        "short_enough": F.col("duration_s") <= rules.max_trip_hours * HOUR,
        "in_window": F.col("start_time") >= literal_like(trips, "start_time", contract.train_window_start),
    }


def filter_trips(trips: DataFrame, contract: Contract) -> DataFrame:
    keep = F.lit(True)
    for rule in trip_rules(trips, contract).values():
        keep = keep & rule
    return trips.filter(keep)


def drop_report(trips: DataFrame, stations: DataFrame, contract: Contract) -> DataFrame:
    """Rows each rule would drop by itself and all together, from one aggregation over one scan."""
    flagged = flag_pseudo_trips(trips, stations)
    rules = {"not_pseudo": ~F.col("is_pseudo"), **trip_rules(trips, contract)}
    rules = {name: F.coalesce(rule, F.lit(False)) for name, rule in rules.items()}
    every = F.lit(True)
    for rule in rules.values():
        every = every & rule
    rules["all"] = every
    counts = flagged.agg(
        F.count(F.lit(1)).alias("_before"), *[F.count_if(~rule).alias(name) for name, rule in rules.items()]
    )
    rows = F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("n_dropped")) for n in rules])
    return counts.select("_before", F.inline(rows)).select(
        "rule",
        F.col("_before").alias("n_before"),
        (F.col("_before") - F.col("n_dropped")).alias("n_after"),
        "n_dropped",
        F.when(F.col("_before") > 0, 100.0 * F.col("n_dropped") / F.col("_before")).otherwise(0.0).alias("pct_dropped"),
    )


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of more than one row: counts by a hash aggregate, merged before the shuffle."""
    counts = df.groupBy(*[F.col(c).alias(f"_{c}") for c in keys]).agg(F.count(F.lit(1)).alias("_n"))
    return counts.filter("_n > 1").drop("_n")


def deduplicate(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key: the least by all other columns, so a rerun keeps the same row.

    Only the keys are shuffled for all rows. Rows of a key of their own pass as they are; the others, NULL keys included,
    go through an ordered aggregate that merges copies before the shuffle, so a key with very many copies is no heavier
    than any other. The repeated keys are written first, so that Spark knows their size: while they are below its
    broadcast threshold, no whole row that is kept is shuffled or sorted. ``df`` is read three times.
    """
    repeated = staged(repeated_keys(df, keys))
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys])
    rest = [c for c in df.columns if c not in keys]
    several = df.join(repeated, same, "left_semi").groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_row"))
    least = several.select(*[F.col(c) if c in keys else F.col("_row")[c].alias(c) for c in df.columns])
    return df.join(repeated, same, "left_anti").unionByName(least)


def merge_report(df: DataFrame, key: str) -> DataFrame:
    """What `deduplicate` by this key merges: rows before and after, and how many have no readable key and so become one."""
    per = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    zero = F.lit(0)
    return per.agg(
        F.coalesce(F.sum("_n"), zero).alias("n_before"),
        F.count(F.lit(1)).alias("n_after"),
        (F.coalesce(F.sum("_n"), zero) - F.count(F.lit(1))).alias("n_merged"),
        F.coalesce(F.sum(F.when(F.col(key).isNull(), F.col("_n"))), zero).alias("n_without_key"),
    )


def station_report(raw: DataFrame, parsed: DataFrame) -> DataFrame:
    """Directory rows: published, with a usable id, and left once pseudo-stations are out."""
    counts = raw.agg(F.count(F.lit(1)).alias("n_published"))
    usable = parsed.agg(F.count(F.lit(1)).alias("n_usable"))
    return attach(attach(counts, usable), exclude_pseudo_stations(parsed).agg(F.count(F.lit(1)).alias("n_stations")))


def to_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def with_month(df: DataFrame, time: str, year: str = "year", month: str = "month") -> DataFrame:
    return df.withColumn(year, F.year(time)).withColumn(month, F.month(time))


def clean_parsed_trips(
    parsed: DataFrame, stations: DataFrame, contract: Contract, unzoned: bool = False
) -> DataFrame:
    """Typed trips to clean trips: filter, drop pseudo-stations, deduplicate, conform."""
    kept = drop_pseudo_trips(filter_trips(parsed, contract), stations)
    return with_month(to_schema(deduplicate(kept, ["trip_id"]), clean_trip_schema(unzoned)), "start_time")


def clean_trips(resolved: DataFrame, stations: DataFrame, contract: Contract, unzoned: bool = False) -> DataFrame:
    """Resolved text to clean trips."""
    return clean_parsed_trips(parse_trips(resolved, unzoned), stations, contract, unzoned)


def parse_stations(raw: DataFrame, unzoned: bool = False) -> DataFrame:
    """The station directory under whatever header it was published; rows without a usable id are dropped."""
    named = resolve_columns(raw, STATION_ALIASES, nullable=())
    return named.select(
        text_to_int("station_id").alias("station_id"),
        "station_name",
        parse_time("go_live_raw", GO_LIVE_FORMATS, unzoned).alias("go_live_date"),
    ).filter("station_id IS NOT NULL")


def undated_stations(stations: DataFrame) -> DataFrame:
    return stations.agg(
        F.count(F.lit(1)).alias("n_stations"), F.count_if(F.col("go_live_date").isNull()).alias("n_undated")
    )
