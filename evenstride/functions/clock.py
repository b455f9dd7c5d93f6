"""Time as microseconds, by arithmetic on the wall clock that the session's time zone doesn't touch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ntz_micros(ts: str) -> str:
    """Microseconds since 1970 of a timestamp without time zone (SQL)."""
    return f"(datediff(cast({ts} as date), date'1970-01-01') * 86400000000L + hour({ts}) * 3600000000L + minute({ts}) * 60000000L + cast(extract(second from {ts}) * 1000000 as bigint))"


def micros(df: DataFrame, col: str = "ts") -> Column:
    """Microseconds since 1970 of a column: of its wall clock if it has no time zone, else of its instant."""
    return F.expr(f"unix_micros({col})" if dict(df.dtypes).get(col) == "timestamp" else ntz_micros(f"cast({col} as timestamp_ntz)"))


def at_second(seconds: Column, start: str = "1970-01-01 00:00:00") -> Column:
    """Timestamp without time zone that many seconds (whole or not) after ``start``."""
    return F.to_timestamp_ntz(F.lit(start)) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)"))
