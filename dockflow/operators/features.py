"""The feature table: weather, calendar and lags on the labelled panel."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dockflow.contract import Contract
from dockflow.operators.calendar import with_calendar
from dockflow.operators.conform import deduplicate
from dockflow.operators.rolling import trailing_mean

HOURS_PER_WEEK = 168


def point_weather(weather: DataFrame, contract: Contract) -> DataFrame:
    """The first grid point's hours, one row each whatever the input repeats."""
    point = weather.filter(F.col("point_name") == contract.weather_point)
    return deduplicate(point.select("hour_ts", *contract.hourly, "is_daylight"), ["hour_ts"])


def with_weather(panel: DataFrame, weather: DataFrame, contract: Contract) -> DataFrame:
    """Every station takes the same point. One row per hour of history is broadcast: a century is under a million."""
    return panel.join(F.broadcast(point_weather(weather, contract)), "hour_ts", "left")


def with_lags(panel: DataFrame) -> DataFrame:
    """Row lags on the dense panel and the mean flow of the seven days before; one exchange by station serves all."""
    w = Window.partitionBy("station_id").orderBy("hour_ts")
    return panel.withColumns({
        "occupancy_lag_1h": F.lag("occupancy", 1).over(w),
        "net_flow_lag_1h": F.lag("net_flow", 1).over(w),
        "net_flow_same_hour_last_week": F.lag("net_flow", HOURS_PER_WEEK).over(w),
        "net_flow_rolling_7d_mean": trailing_mean("station_id", "hour_ts", "net_flow", HOURS_PER_WEEK),
    })


def build_features(labels: DataFrame, weather: DataFrame, contract: Contract) -> DataFrame:
    """Lags first, while the panel is still clustered by station; the other arms are row-wise or broadcast."""
    return with_calendar(with_weather(with_lags(labels), weather, contract))
