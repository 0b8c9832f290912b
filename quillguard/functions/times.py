"""Time expressions that do not depend on the session's time zone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _utc_clock(epoch_s: Column) -> Column:
    """A timestamp whose clock in the session zone shows the UTC time of ``epoch_s``."""
    return F.to_utc_timestamp(F.timestamp_seconds(epoch_s), F.current_timezone())


def utc_iso(epoch_s: Column) -> Column:
    return F.date_format(_utc_clock(epoch_s), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def utc_date(epoch_s: Column) -> Column:
    return F.to_date(_utc_clock(epoch_s))


def micros(df: DataFrame, column: str) -> Column:
    """Microseconds since the epoch; times without a zone are read as UTC."""
    if isinstance(df.schema[column].dataType, T.TimestampNTZType):
        local = F.col(column).cast("timestamp")
        return F.unix_micros(F.from_utc_timestamp(local, F.current_timezone()))
    return F.unix_micros(F.col(column))
