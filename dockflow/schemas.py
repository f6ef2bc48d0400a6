"""Declared table schemas; writers conform to these, not to whatever a plan inferred."""

from __future__ import annotations

from pyspark.sql import types as T


def time_type(unzoned: bool) -> T.DataType:
    return T.TimestampNTZType() if unzoned else T.TimestampType()


def clean_trip_schema(unzoned: bool = False) -> T.StructType:
    return T.StructType([
        T.StructField("trip_id", T.LongType()),
        T.StructField("duration_s", T.IntegerType()),
        T.StructField("start_time", time_type(unzoned)),
        T.StructField("end_time", time_type(unzoned)),
        T.StructField("start_station_id", T.IntegerType()),
        T.StructField("end_station_id", T.IntegerType()),
        T.StructField("bike_id", T.StringType()),
        T.StructField("bike_type", T.StringType()),
        T.StructField("passholder_type", T.StringType()),
    ])


def label_schema(unzoned: bool = False) -> T.StructType:
    ints = ("arr", "dep", "reb_in", "reb_out", "net_flow")
    return T.StructType([
        T.StructField("station_id", T.IntegerType()),
        T.StructField("hour_ts", time_type(unzoned)),
        *[T.StructField(c, T.IntegerType()) for c in ints],
        T.StructField("occupancy", T.DoubleType()),
        T.StructField("capacity", T.IntegerType()),
        T.StructField("pct_full", T.DoubleType()),
        T.StructField("is_empty", T.BooleanType()),
        T.StructField("is_full", T.BooleanType()),
        T.StructField("part_year", T.IntegerType()),
        T.StructField("part_month", T.IntegerType()),
    ])
