"""Event time as whole numbers, free of the session's time zone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def microseconds(df: DataFrame, time: str) -> Column:
    """Microseconds since 1970. A time without zone is taken as UTC."""
    at = F.col(time)
    if df.schema[time].dataType.typeName() != "timestamp_ntz":
        return F.unix_micros(at)
    day = F.unix_date(F.to_date(at)).cast("bigint") * 86_400_000_000
    clock = F.hour(at).cast("bigint") * 3_600_000_000 + F.minute(at).cast("bigint") * 60_000_000
    return day + clock + (F.date_part(F.lit("SECOND"), at) * 1_000_000).cast("bigint")


def instant(df: DataFrame, time: str) -> Column:
    """Timestamp with zone, as watermarks need it."""
    return F.timestamp_micros(microseconds(df, time))
