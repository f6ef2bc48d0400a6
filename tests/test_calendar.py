import math
from datetime import date, datetime, timedelta

from pyspark.sql import functions as F

from dockflow.operators import calendar as cal


def holidays(spark, lo, hi):
    bounds = spark.createDataFrame([(lo, hi)], "lo date, hi date")
    return {r[0] for r in cal.federal_holidays(bounds).collect()}


def test_known_dates(spark):
    days = holidays(spark, date(2020, 1, 1), date(2026, 12, 31))
    for known in (
        (2026, 7, 4), (2026, 7, 3), (2026, 12, 25), (2026, 6, 19), (2026, 1, 19), (2026, 5, 25), (2026, 9, 7),
        (2026, 11, 26), (2021, 5, 31), (2026, 2, 16), (2026, 10, 12),
    ):
        assert date(*known) in days
    assert date(2026, 3, 17) not in days


def test_new_year_observed_in_the_year_before(spark):
    """1 January 2022 was a Saturday."""
    assert date(2021, 12, 31) in holidays(spark, date(2021, 2, 1), date(2021, 12, 31))


def test_predicate_equals_the_dimension_for_sixty_years(spark):
    days = spark.sql("SELECT explode(sequence(DATE'1990-01-01', DATE'2049-12-31')) AS d")
    flagged = {r[0] for r in days.filter(cal.is_federal_holiday("d")).collect()}
    assert flagged == {
        d for d in holidays(spark, date(1990, 1, 1), date(2049, 12, 31)) if 1990 <= d.year <= 2049
    }


def test_calendar_columns(spark):
    hours = [datetime(2026, 3, 14) + timedelta(hours=h) for h in range(24 * 9)]
    rows = cal.with_calendar(spark.createDataFrame([(h,) for h in hours], "hour_ts timestamp_ntz")).collect()
    for r in rows:
        h = r["hour_ts"]
        assert math.isclose(r["hour_sin"], math.sin(2 * math.pi * h.hour / 24), abs_tol=1e-12)
        assert math.isclose(r["dow_cos"], math.cos(2 * math.pi * h.weekday() / 7), abs_tol=1e-12)
        assert r["is_weekend"] == float(h.weekday() >= 5)
        assert r["month"] == 3.0 and r["is_holiday"] == 0.0


def test_midnight_is_near_eleven_at_night(spark):
    df = spark.createDataFrame([(datetime(2026, 3, 17, 23),), (datetime(2026, 3, 18, 0),)], "hour_ts timestamp_ntz")
    a, b = cal.with_calendar(df).orderBy("hour_ts").collect()
    assert math.hypot(a["hour_sin"] - b["hour_sin"], a["hour_cos"] - b["hour_cos"]) < 0.3


def test_weekday_of_zoned_time_uses_the_session_zone(new_york):
    df = new_york.createDataFrame([(1,)], "x int").select(F.timestamp_seconds(F.lit(1767247200)).alias("hour_ts"))
    row = cal.with_calendar(df).first()
    assert row["is_holiday"] == 1.0 and row["month"] == 1.0
