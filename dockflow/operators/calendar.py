"""Calendar features and US federal holidays."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values: (month, day) holidays, observed on the nearest weekday too when they fall on a weekend.
FIXED_HOLIDAYS = ((1, 1), (6, 19), (7, 4), (11, 11), (12, 25))
# Fixed values: (month, weekday with Monday = 0, n-th of the month or -1 for the last).
FLOATING_HOLIDAYS = ((1, 0, 3), (2, 0, 3), (5, 0, -1), (9, 0, 1), (10, 0, 2), (11, 3, 4))


def federal_holidays(bounds: DataFrame) -> DataFrame:
    """Every holiday date, observed days included, for the years of ``lo`` to ``hi`` and the year after.

    The extra year supplies a New Year observed on 31 December. About 16 rows per year.
    """
    years = bounds.select(F.explode(F.sequence(F.year("lo"), F.year("hi") + 1)).alias("y"))
    fixed = F.array(*[F.make_date("y", F.lit(m), F.lit(d)) for m, d in FIXED_HOLIDAYS])
    observed = F.transform(
        fixed, lambda d: F.when(F.weekday(d) == 5, F.date_sub(d, 1)).when(F.weekday(d) == 6, F.date_add(d, 1))
    )

    def floating(month: int, weekday: int, nth: int) -> Column:
        first = F.make_date("y", F.lit(month), F.lit(1))
        if nth < 0:
            last = F.last_day(first)
            return F.date_sub(last, F.pmod(F.weekday(last) - weekday, F.lit(7)))
        return F.date_add(first, F.pmod(F.lit(weekday) - F.weekday(first), F.lit(7)) + 7 * (nth - 1))

    days = F.concat(fixed, observed, F.array(*[floating(*rule) for rule in FLOATING_HOLIDAYS]))
    return years.select(F.explode(days).alias("holiday")).filter("holiday IS NOT NULL").distinct()


def is_federal_holiday(col: Column | str) -> Column:
    """The same rules as a predicate on one date: no join and no need to know the table's years beforehand."""
    day = F.to_date(col)

    def fixed(d: Column) -> Column:
        return (F.month(d) * 100 + F.dayofmonth(d)).isin(*[m * 100 + n for m, n in FIXED_HOLIDAYS])

    weekday = F.weekday(day)
    hit = fixed(day) | ((weekday == 4) & fixed(F.date_add(day, 1))) | ((weekday == 0) & fixed(F.date_sub(day, 1)))
    for month, wd, nth in FLOATING_HOLIDAYS:
        dom = F.dayofmonth(day)
        in_week = dom > F.dayofmonth(F.last_day(day)) - 7 if nth < 0 else dom.between(7 * nth - 6, 7 * nth)
        hit = hit | ((F.month(day) == month) & (weekday == wd) & in_week)
    return hit


def cyclic(value: Column, period: float) -> tuple[Column, Column]:
    angle = F.lit(2.0 * math.pi) * value / F.lit(period)
    return F.sin(angle), F.cos(angle)


def with_calendar(df: DataFrame, time: str = "hour_ts") -> DataFrame:
    """Hour and weekday on the circle, weekend, holiday, month; from the wall clock of ``time``."""
    hour_sin, hour_cos = cyclic(F.hour(time), 24.0)
    dow_sin, dow_cos = cyclic(F.weekday(time), 7.0)
    return df.withColumns({
        "hour_sin": hour_sin,
        "hour_cos": hour_cos,
        "dow_sin": dow_sin,
        "dow_cos": dow_cos,
        "is_weekend": F.when(F.weekday(time) >= 5, 1.0).otherwise(0.0),
        "is_holiday": F.when(is_federal_holiday(time), 1.0).otherwise(0.0),
        "month": F.month(time).cast("double"),
    })
