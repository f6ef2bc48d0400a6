"""The test tables seen as the engine's inputs: events are rides, suppliers are stations, event types weather points.

Every table is a whole-table projection, so its size follows the input's.
"""

from __future__ import annotations

import uuid
import zipfile
from dataclasses import replace
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dockflow.contract import GO_LIVE_FORMATS, Contract, LabelRules, default_contract
from dockflow.functions.single import attach
from dockflow.functions.time import at_second, hour_floor, parse_time
from dockflow.operators.conform import exclude_pseudo_stations
from dockflow.operators.ordering import neighbours
from dockflow.session import scratch_dir


def test_contract() -> Contract:
    """Thresholds fitted to thirty days of test data."""
    groups = dict(default_contract().feature_groups)
    groups["weather"] = ("temperature_2m", "wind_gusts_10m", "precipitation")
    return replace(
        default_contract(),
        train_window_start="2024-01-02",
        hourly=groups["weather"],
        grid_points=({"name": "click"},),
        labels=LabelRules(
            rebalance_short_gap_hours=6,
            rebalance_long_gap_hours=36,
            maintenance_gap_hours=36,
            fleet_exit_days=1,
            edge_offset_hours=1,
            capacity_rolling_days=7,
            min_trip_seconds=60,
            max_trip_hours=4,
        ),
        feature_groups=groups,
        split={"train_end": "2024-01-18", "val_end": "2024-01-24", "test_end": "2024-01-29"},
    )


_SCHEMAS: dict[str, T.StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table; its schema is read from the file once per process."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    # All stations but two have rides; three more fall silent on the twentieth.
    stations = table(spark, sf_dir, "supplier").agg(F.count("*").cast("int").alias("n"))
    busy = F.col("n") - F.when(F.col("ts") < F.expr("TIMESTAMP_NTZ '2024-01-20 00:00:00'"), 2).otherwise(5)
    rides = attach(events, stations).select(
        "event_id",
        "user_id",
        "event_type",
        k.alias("k"),
        at_second("unix_timestamp(ts)", unzoned=True).alias("start_time"),
        F.floor(F.col("value") * 60).cast("int").alias("duration_s"),
        busy.alias("m"),
    ).withColumn("end_station_id", (3000 + (F.col("event_id") * 31 + F.col("k")) % F.col("m")).cast("int"))
    chained = neighbours(
        rides,
        "user_id",
        ["start_time", "event_id"],
        lag={"previous_end": "end_station_id"},
        measured_on=events.select("user_id", F.col("ts").alias("start_time")),
    )
    start = F.when(F.col("event_id") % 4 == 0, 3000 + (F.col("event_id") * 7 + F.col("k")) % F.col("m")).otherwise(
        F.coalesce("previous_end", 3000 + (F.col("event_id") + F.col("k")) % F.col("m"))
    )
    return chained.select(
        F.col("event_id").alias("trip_id"),
        F.concat(F.lit("B"), F.col("user_id").cast("string")).alias("bike_id"),
        "start_time",
        F.expr("timestampadd(SECOND, duration_s, start_time)").alias("end_time"),
        "duration_s",
        start.cast("int").alias("start_station_id"),
        "end_station_id",
        F.when(F.col("event_id") % 2 == 0, "electric").otherwise("classic").alias("bike_type"),
        F.col("event_type").alias("passholder_type"),
    )


def bikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bike and time of every ride: what key sizes are measured on, without deriving the rides."""
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("B"), F.col("user_id").cast("string")).alias("bike_id"), F.col("ts").alias("start_time")
    )


def ride_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Start and end of every ride, without deriving the rides: what the panel's size is measured on."""
    seconds = F.floor(F.col("value") * 60).cast("int")
    return table(spark, sf_dir, "events").select(
        F.col("ts").alias("start_time"), F.timestamp_add("SECOND", seconds, F.col("ts")).alias("end_time")
    )


def trips_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rides as published text: three archives with their own time formats, and repeated rows."""
    t = trips(spark, sf_dir)
    archive = F.col("trip_id") % 3

    def text(name: str) -> Column:
        return (
            F.when(F.col("trip_id") % 500 == 7, "n/a")
            .when(archive == 0, F.date_format(name, "M/d/yyyy H:mm"))
            .when(archive == 1, F.date_format(name, "yyyy-MM-dd HH:mm:ss"))
            .otherwise(F.date_format(name, "yyyy-MM-dd'T'HH:mm:ss"))
        )

    minutes = F.floor(F.col("duration_s") / 60).cast("int").cast("string")
    copies = F.when(F.col("trip_id") % 50 == 0, 2).otherwise(1)
    return t.select(
        F.col("trip_id").cast("string").alias("trip_id"),
        archive.alias("archive"),
        text("start_time").alias("start_time"),
        text("end_time").alias("end_time"),
        F.when(archive == 1, "").otherwise(minutes).alias("duration"),
        F.when(F.col("trip_id") % 400 != 9, F.col("start_station_id").cast("string")).alias("start_station"),
        F.col("end_station_id").cast("string").alias("end_station"),
        "bike_id",
        F.when(archive != 2, F.col("bike_type")).alias("bike_type"),
        "passholder_type",
        F.explode(F.array_repeat(F.lit(1), copies)).alias("_copy"),
    ).drop("_copy")


# The header each archive uses for a canonical column; the third has no bike type.
ARCHIVE_HEADERS = {
    0: {c: c for c in (
        "trip_id", "duration", "start_time", "end_time", "start_station", "end_station", "bike_id", "bike_type",
        "passholder_type",
    )},
    1: {
        "trip_id": "Trip ID", "duration": "Duration", "start_time": "Start Time", "end_time": "End Time",
        "start_station": "Start Station", "end_station": "End Station", "bike_id": "Bike ID",
        "bike_type": "Bike Type", "passholder_type": "Passholder Type",
    },
    2: {
        "trip_id": "tripid", "duration": "duration", "start_time": "starttime", "end_time": "endtime",
        "start_station": "startstation", "end_station": "endstation", "bike_id": "bikeid",
        "passholder_type": "passholdertype",
    },
}


def trip_cells(raw: DataFrame) -> DataFrame:
    """Raw rides as header-keyed cells, the shape a zip of drifting CSVs is read into."""
    cells = F.lit(None)
    for archive, headers in ARCHIVE_HEADERS.items():
        pairs = [x for canonical, header in headers.items() for x in (F.lit(header), F.col(canonical))]
        cells = F.when(F.col("archive") == archive, F.create_map(*pairs)).otherwise(cells)
    return raw.select(F.col("archive").cast("string").alias("archive"), cells.alias("cells"))


def stations_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The station directory as published: text columns under a drifted header."""
    s = table(spark, sf_dir, "supplier")
    day = F.date_add(F.lit("2023-12-20").cast("date"), (F.col("s_suppkey") * 13 % 25).cast("int"))
    go_live = (
        F.when(F.col("s_suppkey") % 11 == 5, None)
        .when(F.col("s_suppkey") % 2 == 0, F.date_format(day, "M/d/yyyy"))
        .otherwise(F.date_format(day, "yyyy-MM-dd"))
    )
    return s.select(
        (3000 + F.col("s_suppkey")).cast("string").alias("Station_ID"),
        F.when(F.col("s_suppkey") == 0, "Virtual Station").otherwise(F.col("s_name")).alias("Station_Name"),
        go_live.alias("Day of Go_live_date"),
    )


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned directory: typed, pseudo-stations gone."""
    raw = stations_raw(spark, sf_dir)
    parsed = raw.select(
        F.col("Station_ID").cast("int").alias("station_id"),
        F.col("Station_Name").alias("station_name"),
        parse_time("Day of Go_live_date", GO_LIVE_FORMATS, unzoned=True).alias("go_live_date"),
    )
    return exclude_pseudo_stations(parsed)


def weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    per_hour = events.groupBy(F.col("event_type").alias("point_name"), hour_floor(events, "ts").alias("hour_ts")).agg(
        F.max("value").alias("temperature_2m"),
        F.min("value").alias("wind_gusts_10m"),
        F.count(F.lit(1)).alias("n"),
    )
    quarter = F.when(F.col("n") % 3 != 0, F.col("n").cast("double") / 4)
    return per_hour.select("point_name", "hour_ts", "temperature_2m", "wind_gusts_10m", quarter.alias("precipitation"))


def weather_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON document of parallel arrays per point and day, as a downloader would leave it."""
    w = weather(spark, sf_dir)
    names = ("temperature_2m", "wind_gusts_10m", "precipitation")
    rows = F.array_sort(F.collect_list(F.struct(F.date_format("hour_ts", "yyyy-MM-dd'T'HH:mm").alias("time"), *names)))
    # A day holds at most 24 hours, so a document is bounded whatever the history's length.
    docs = w.groupBy("point_name", F.to_date("hour_ts").alias("day")).agg(rows.alias("rows"))
    dom = F.date_format("day", "dd")
    keep = F.dayofmonth("day") % 9 != 0
    days = F.when(keep, F.array(F.date_format("day", "yyyy-MM-dd"))).otherwise(F.array().cast("array<string>"))
    rise = F.when(keep, F.array(F.concat(F.date_format("day", "yyyy-MM-dd"), F.lit("T07:"), dom)))
    fall = F.when(keep, F.array(F.concat(F.date_format("day", "yyyy-MM-dd"), F.lit("T17:"), dom)))
    payload = F.to_json(
        F.struct(
            F.struct(F.col("point_name").alias("name")).alias("_point"),
            F.struct(
                F.col("rows.time").alias("time"),
                *[F.col(f"rows.{n}").alias(n) for n in names],
            ).alias("hourly"),
            F.struct(days.alias("time"), rise.alias("sunrise"), fall.alias("sunset")).alias("daily"),
        ),
        {"ignoreNullFields": "false"},
    )
    return docs.select(payload.alias("payload"))


# Any anchor target of a crawled page.
ANY_LINK = r'(?i)href="([^"]*)"'

# The order in which a written CSV lists its columns.
CSV_ORDER = tuple(ARCHIVE_HEADERS[0])


def write_trip_csvs(raw: DataFrame) -> str:
    """One directory of CSV files per archive, each under that archive's own header."""
    root = scratch_dir(raw.sparkSession)
    for archive, headers in ARCHIVE_HEADERS.items():
        part = raw.filter(F.col("archive") == archive)
        named = part.select(*[F.nullif(F.col(c), F.lit("")).alias(headers[c]) for c in CSV_ORDER if c in headers])
        named.write.option("header", "true").csv(f"{root}/archive={archive}")
    return root


def write_trip_zips(raw: DataFrame) -> str:
    """The same CSVs zipped: every task writes the rows it holds as archives of its own."""
    root = scratch_dir(raw.sparkSession)
    local = root.removeprefix("file://").removeprefix("file:")
    names = raw.columns

    def write(batches):
        members: dict[int, list[str]] = {}
        for batch in batches:
            for archive, rows in batch.groupby("archive"):
                headers = ARCHIVE_HEADERS[int(archive)]
                kept = rows[[c for c in CSV_ORDER if c in headers]].rename(columns=headers)
                members.setdefault(int(archive), []).append(kept.to_csv(index=False, header=False, lineterminator="\n"))
        if members:
            with zipfile.ZipFile(f"{local}/trips-{uuid.uuid4().hex}.zip", "w", zipfile.ZIP_DEFLATED) as out:
                for archive, parts in members.items():
                    head = ",".join(ARCHIVE_HEADERS[archive][c] for c in CSV_ORDER if c in ARCHIVE_HEADERS[archive])
                    out.writestr(f"data/trips-{archive}.csv", head + "\n" + "".join(parts))
        yield pd.DataFrame({"written": [len(members)]})

    Path(local).mkdir(parents=True, exist_ok=True)
    raw.select(*names).mapInPandas(write, "written int").write.format("noop").mode("overwrite").save()
    return root
