"""Time helpers that keep the caller's timestamp type.

Zoned (``timestamp``) input behaves like wall time of the session zone with correct instants; unzoned
(``timestamp_ntz``) input is plain wall time whatever the session zone is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

HOUR = 3600
DAY = 86400


def is_unzoned(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.TimestampNTZType)


def seconds(col: Column | str) -> Column:
    """Whole seconds since the epoch; of the wall clock for unzoned input."""
    return F.unix_timestamp(col)


def hour_floor(df: DataFrame, name: str) -> Column:
    if not is_unzoned(df, name):
        return F.date_trunc("hour", F.col(name))
    # date_trunc would pass through the session zone and move hours that zone skips.
    return at_second(f"unix_timestamp(`{name}`) - pmod(unix_timestamp(`{name}`), {HOUR})", unzoned=True)


def hour_key(secs: str, unzoned: bool) -> Column:
    """What to group seconds by hour with: plain arithmetic where no zone can have hours off the full one."""
    return F.expr(f"{secs} - pmod({secs}, {HOUR})" if unzoned else f"date_trunc('hour', timestamp_seconds({secs}))")


def hour_of_key(key: str, unzoned: bool) -> Column:
    return at_second(key, unzoned=True) if unzoned else F.col(key)


def month_floor(df: DataFrame, name: str) -> Column:
    first = F.trunc(F.col(name), "month")
    return first.cast("timestamp_ntz" if is_unzoned(df, name) else "timestamp")


def at_second(secs: str, unzoned: bool) -> Column:
    """The timestamp that is ``secs`` (an SQL expression) after the epoch."""
    if unzoned:
        return F.expr(f"timestampadd(SECOND, {secs}, TIMESTAMP_NTZ '1970-01-01 00:00:00')")
    return F.expr(f"timestamp_seconds({secs})")


def literal_like(df: DataFrame, like: str, text: str) -> Column:
    """A date or timestamp literal in the type of column ``like``."""
    return F.lit(text).cast(df.schema[like].dataType)


def _separators(fmt: str) -> str:
    """What is left of a text in this format once its digits are gone."""
    return "".join(c for c in fmt.replace("'T'", "|") if not c.isalpha()).replace("|", "T")


def parse_time(col: Column | str, formats, unzoned: bool) -> Column:
    """The first format that parses wins; text that fits none is NULL, never an error.

    A format is tried only where its separators match the text's, so nearly every value is parsed once. Text whose
    separators fit no format gets every format's verdict.
    """
    text = F.col(col) if isinstance(col, str) else col

    def one(fmt: str) -> Column:
        # Unzoned text is read as UTC, so that the session zone skips or shifts no wall time.
        return (
            F.try_to_timestamp(F.concat(text, F.lit("Z")), F.lit(f"{fmt}X"))
            if unzoned else F.try_to_timestamp(text, F.lit(fmt))
        )

    by_shape: dict[str, list[str]] = {}
    for fmt in formats:
        by_shape.setdefault(_separators(fmt), []).append(fmt)
    shape = F.translate(text, "0123456789", "")
    parsed = F.when(text.isNull(), F.lit(None))
    for separators, same in by_shape.items():
        parsed = parsed.when(shape == separators, F.coalesce(*[one(f) for f in same]))
    parsed = parsed.otherwise(F.coalesce(*[one(f) for f in formats]))
    if not unzoned:
        return parsed
    return F.timestamp_add("SECOND", F.unix_timestamp(parsed), F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'"))


def local_to_utc(col: Column | str, zone: str) -> Column:
    """Unzoned wall time of ``zone`` as unzoned UTC, so that equal values are equal instants."""
    c = F.col(col) if isinstance(col, str) else col
    return F.convert_timezone(F.lit(zone), F.lit("UTC"), c)


def text_to_int(col: Column | str, to: str = "int") -> Column:
    """Integer text, tolerant of blanks and of a decimal tail; anything else is NULL."""
    return F.regexp_replace(F.trim(col), r"\.\d*$", "").try_cast(to)
