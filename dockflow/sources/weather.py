"""Hourly weather from documents of parallel arrays."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dockflow.contract import WEATHER_TIME_FORMATS, Contract
from dockflow.functions.time import parse_time
from dockflow.operators.conform import deduplicate


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """One row per document; gzip is decoded by extension. Documents are bounded by the download plan's chunk length."""
    return (
        spark.read.option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.json.gz")
        .text(path, wholetext=True)
        .withColumnRenamed("value", "payload")
    )


def payload_schema(contract: Contract) -> T.StructType:
    text, numbers = T.ArrayType(T.StringType()), T.ArrayType(T.DoubleType())
    return T.StructType([
        T.StructField("_point", T.StructType([T.StructField("name", T.StringType())])),
        T.StructField("hourly", T.StructType(
            [T.StructField("time", text), *[T.StructField(v, numbers) for v in contract.hourly]]
        )),
        T.StructField("daily", T.StructType(
            [T.StructField("time", text), T.StructField("sunrise", text), T.StructField("sunset", text)]
        )),
    ])


def weather_hours(docs: DataFrame, contract: Contract, unzoned: bool = False) -> DataFrame:
    """Point-hours with every contract variable as a double, and whether the hour lies between sunrise and sunset.

    A variable a document lacks, or an array that ends early, gives NULL. Daylight is NULL when the day is absent.
    """
    doc = docs.select(F.from_json("payload", payload_schema(contract)).alias("d"))
    no_numbers = F.array().cast("array<double>")
    hours = F.arrays_zip(
        F.col("d.hourly.time").alias("time"),
        *[F.coalesce(F.col(f"d.hourly.{v}"), no_numbers).alias(v) for v in contract.hourly],
    )
    suns = F.filter(
        F.arrays_zip("d.daily.time", "d.daily.sunrise", "d.daily.sunset"),
        lambda s: (F.coalesce(s["sunrise"], F.lit("")) != "") & (F.coalesce(s["sunset"], F.lit("")) != ""),
    )
    rows = doc.select(
        F.coalesce("d._point.name", F.lit("unknown")).alias("point_name"), suns.alias("suns"), F.inline(hours)
    ).filter("time IS NOT NULL")
    day = F.try_element_at(F.filter("suns", lambda s: s["time"] == F.substring("time", 1, 10)), F.lit(-1))
    lit_up = F.when(
        F.col("day").isNotNull(),
        F.when(F.col("time").between(F.col("day.sunrise"), F.col("day.sunset")), 1.0).otherwise(0.0),
    )
    typed = rows.withColumn("day", day).select(
        "point_name",
        parse_time("time", WEATHER_TIME_FORMATS, unzoned).alias("hour_ts"),
        *contract.hourly,
        lit_up.alias("is_daylight"),
    )
    return deduplicate(typed, ["point_name", "hour_ts"])
