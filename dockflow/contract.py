"""The contract document: thresholds, feature groups, split bounds.

One JSON file drives every operator. Feature order is the order of ``feature_groups`` in the document and nothing else.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace
from pathlib import Path

from pyspark.sql import SparkSession

# The names each published column has had. Compared lower-cased, with spaces as underscores.
COLUMN_ALIASES = {
    "trip_id": ["trip_id", "tripid", "Trip ID"],
    "duration": ["duration", "Duration"],
    "start_time": ["start_time", "starttime", "Start Time"],
    "end_time": ["end_time", "endtime", "End Time"],
    "start_station": ["start_station", "startstation", "Start Station"],
    "end_station": ["end_station", "endstation", "End Station"],
    "bike_id": ["bike_id", "bikeid", "Bike ID"],
    "bike_type": ["bike_type", "biketype", "Bike Type"],
    "passholder_type": ["passholder_type", "passholdertype", "Passholder Type"],
}
NULLABLE_COLUMNS = ("bike_type", "passholder_type")
STATION_ALIASES = {
    "station_id": ["station_id", "station", "id"],
    "go_live_raw": ["go_live_date", "golivedate", "go_live", "day_of_go_live_date"],
    "station_name": ["station_name", "name"],
}
TRIP_TIME_FORMATS = ("M/d/yyyy H:mm", "M/d/yyyy H:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss")
GO_LIVE_FORMATS = ("M/d/yyyy", "yyyy-MM-dd")
WEATHER_TIME_FORMATS = ("yyyy-MM-dd'T'HH:mm", "yyyy-MM-dd'T'HH:mm:ss")
PSEUDO_STATION_NAME = "virtual station"

# Table columns that are keys, labels or ledger intermediates, hence never features.
KEY_COLUMNS = ("station_id", "hour_ts", "part_year", "part_month")
LABEL_COLUMNS = (
    "net_flow", "is_empty", "is_full", "occupancy", "pct_full", "arr", "dep", "reb_in", "reb_out",
    "o_initial", "delta", "cum_delta", "point_name",
)
CALENDAR_FEATURES = ("hour_sin", "hour_cos", "dow_sin", "dow_cos", "is_weekend", "is_holiday", "month")


class ContractError(ValueError):
    """The data or a request does not fit the contract."""


def normalise_name(name: str) -> str:
    return name.lower().replace(" ", "_")


@dataclass(frozen=True)
class LabelRules:
    rebalance_short_gap_hours: int = 6
    rebalance_long_gap_hours: int = 72
    maintenance_gap_hours: int = 72
    fleet_exit_days: int = 30
    edge_offset_hours: int = 1
    capacity_rolling_days: int = 90
    min_trip_seconds: int = 60
    max_trip_hours: int = 24


@dataclass(frozen=True)
class Contract:
    timezone: str
    train_window_start: str
    hourly: tuple[str, ...]
    grid_points: tuple[dict, ...]
    labels: LabelRules
    feature_groups: dict[str, tuple[str, ...]]
    split: dict[str, str]
    regression_target: str = "net_flow"
    classification_target: str = "is_empty"
    daily: tuple[str, ...] = ("sunrise", "sunset")
    document: dict = field(default_factory=dict, compare=False, repr=False)

    @property
    def features(self) -> list[str]:
        return [name for names in self.feature_groups.values() for name in names]

    @property
    def weather_point(self) -> str:
        """The first listed grid point serves every station."""
        return self.grid_points[0]["name"]

    def without_groups(self, names) -> Contract:
        """The contract of a variant trained without the named feature groups."""
        unknown = sorted(set(names) - set(self.feature_groups))
        if unknown:
            raise ContractError(f"unknown feature groups {unknown}; the contract has {sorted(self.feature_groups)}")
        kept = {g: f for g, f in self.feature_groups.items() if g not in set(names)}
        return replace(self, feature_groups=kept)

    def to_json(self) -> str:
        doc = dict(self.document)
        doc["project"] = {
            **doc.get("project", {}), "timezone": self.timezone, "train_window_start": self.train_window_start,
        }
        doc["weather"] = {
            "hourly": list(self.hourly), "daily": list(self.daily), "grid_points": [dict(p) for p in self.grid_points],
        }
        doc["labels"] = dict(self.labels.__dict__)
        doc["feature_groups"] = {g: list(f) for g, f in self.feature_groups.items()}
        doc["targets"] = {"regression": self.regression_target, "classification": self.classification_target}
        doc["split"] = dict(self.split)
        return json.dumps(doc, indent=2)

    @classmethod
    def from_json(cls, text: str) -> Contract:
        doc = json.loads(text)
        weather = doc.get("weather", {})
        targets = doc.get("targets", {})
        rules = {k: v for k, v in doc["labels"].items() if k in LabelRules.__dataclass_fields__}
        return cls(
            timezone=doc["project"]["timezone"],
            train_window_start=doc["project"]["train_window_start"],
            hourly=tuple(weather.get("hourly", ())),
            daily=tuple(weather.get("daily", ("sunrise", "sunset"))),
            grid_points=tuple(weather.get("grid_points", ())),
            labels=LabelRules(**rules),
            feature_groups={g: tuple(f) for g, f in doc["feature_groups"].items()},
            split=dict(doc["split"]),
            regression_target=targets.get("regression", "net_flow"),
            classification_target=targets.get("classification", "is_empty"),
            document=doc,
        )


def default_contract() -> Contract:
    return Contract.from_json((Path(__file__).parent / "contract_default.json").read_text())


def load_contract(spark: SparkSession, path: str) -> Contract:
    """Read the document through Spark's own file systems, so any path Spark can read works."""
    row = spark.read.text(path, wholetext=True).first()
    if row is None:
        raise ContractError(f"no contract document at {path}")
    return Contract.from_json(row[0])
