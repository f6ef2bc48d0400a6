"""Labels that grow by runs: each run reads the new hours and what the runs before carried over, never all history.

Below one root lie ``hours``, the ledger of every run in a folder of its own, and ``state``, one published row a station
with its running sum, its least sum, and the sums of the hours that a capacity window can still reach.
The ledger is kept without a level: running sum and its trailing high. The level, minus the least running sum so far, is
in the state alone, and is put on when labels are read. A new minimum thus corrects the labels of all earlier hours of
its station without one of them being written again.

A run counts once its state is published. One that fails leaves labels as they were, and may simply be repeated: hours
of runs beyond the state are not read, and their folder is replaced. Flows handed in must be dense by hour and final:
hours at or before a station's last one are closed and left out, so a run repeated after its success adds nothing. One run at a time may write below a root.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dockflow.contract import LabelRules
from dockflow.operators import ledger
from dockflow.operators.rolling import trailing_max
from dockflow.sinks import tables

HOUR_COLUMNS = ("station_id", "hour_ts", *ledger.COUNTS, "net_flow", "cum_delta", "high")


def _window(rules: LabelRules) -> int:
    return rules.capacity_rolling_days * 24


def extended(flows: DataFrame, state: DataFrame | None, rules: LabelRules) -> DataFrame:
    """Ledger rows of the new hours: ``HOUR_COLUMNS``, with the running sum and its high over the capacity window.

    All is per station: one exchange of the new hours and of what was carried over.
    """
    if state is None:
        rows = ledger.running_ledger(flows).select(*HOUR_COLUMNS[:-1])
        return trailing_max(rows, "station_id", "hour_ts", "cum_delta", _window(rules), "high")
    carried = state.select("station_id", "last_hour", F.col("cum_delta").alias("before"))
    new = flows.join(carried, "station_id", "left").filter("last_hour IS NULL OR hour_ts > last_hour")
    running = ledger.running_ledger(new).withColumn("cum_delta", F.col("cum_delta") + F.coalesce("before", F.lit(0)))
    rows = running.select(*HOUR_COLUMNS[:-1], F.lit(True).alias("is_new")).unionByName(
        state.select("station_id", F.inline("tail")).withColumn("is_new", F.lit(False)), allowMissingColumns=True
    )
    rolled = trailing_max(rows, "station_id", "hour_ts", "cum_delta", _window(rules), "high")
    return rolled.filter("is_new").select(*HOUR_COLUMNS)


def carried_over(hours: DataFrame, state: DataFrame | None, rules: LabelRules) -> DataFrame:
    """The state after new ledger rows: (station_id, last_hour, cum_delta, low, tail, moved).

    ``tail`` holds one window of (hour_ts, cum_delta), so no run reads older hours. ``moved`` is how far this run raised
    the level of the station's earlier hours, 0 for a new station.
    """
    rows = hours.select("station_id", "hour_ts", "cum_delta")
    if state is not None:
        rows = rows.unionByName(state.select("station_id", F.inline("tail")))
    rows = rows.withColumn("last_hour", F.max("hour_ts").over(Window.partitionBy("station_id")))
    open_ = F.col("hour_ts") > F.col("last_hour") - F.make_interval(hours=F.lit(_window(rules)))
    after = rows.groupBy("station_id").agg(
        F.max("last_hour").alias("last_hour"),
        F.max(F.struct("hour_ts", "cum_delta"))["cum_delta"].alias("cum_delta"),
        F.min("cum_delta").alias("low"),
        F.collect_list(F.when(open_, F.struct("hour_ts", "cum_delta"))).alias("tail"),
    )
    if state is None:
        return after.withColumn("moved", F.lit(0).cast("long"))
    joined = after.join(state.select("station_id", F.col("low").alias("low_before")), "station_id", "left")
    low = F.least("low", "low_before")
    return joined.withColumn("moved", F.coalesce(F.col("low_before") - low, F.lit(0))).withColumn("low", low).drop("low_before")


def levelled(hours: DataFrame, state: DataFrame) -> DataFrame:
    """Labels of ledger rows under the newest level of their station; joined as sizes say, one row a station."""
    rows = hours.join(state.select("station_id", "low"), "station_id")
    return ledger.label_columns(
        rows.withColumns({
            "occupancy": F.col("cum_delta") - F.col("low"),
            "capacity": F.greatest(F.col("high") - F.col("low"), F.lit(1)),
        })
    )


def add_hours(flows: DataFrame, root: str, rules: LabelRules) -> int:
    """One run: ledger rows of the new hours, then the state that makes them count. The number of the run."""
    spark = flows.sparkSession
    before, manifest = tables.latest(spark, f"{root}/state")
    state = tables.published(spark, f"{root}/state") if manifest else None
    path = f"{root}/hours/run={before + 1}"
    tables.write_table(extended(flows, state, rules), path)
    return tables.publish(carried_over(spark.read.parquet(path), state, rules), f"{root}/state", [])


def read_labels(spark: SparkSession, root: str) -> DataFrame:
    """Labels of all hours so far. Folders beyond the state, or of torn runs, are not among those it names."""
    state = tables.published(spark, f"{root}/state")
    runs = tables.whole_numbers(spark, f"{root}/state")
    hours = spark.read.parquet(f"{root}/hours").filter(F.col("run").isin(runs)).drop("run")
    return levelled(hours, state)
