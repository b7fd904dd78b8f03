"""Time parsing and formatting.

Epochs are doubles in seconds. TIMESTAMP_NTZ values are converted with
``timestamp_diff`` against the NTZ epoch, which involves no session time zone;
TIMESTAMP (with local time zone) values are instants and use ``unix_micros``.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

def _ntz_epoch():
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")


def epoch_seconds(col: Column, dtype: T.DataType) -> Column:
    """Seconds since 1970-01-01 (with microsecond fraction) as double."""
    if isinstance(dtype, T.TimestampNTZType):
        micros = F.timestamp_diff("MICROSECOND", _ntz_epoch(), col)
    elif isinstance(dtype, T.TimestampType):
        micros = F.unix_micros(col)
    elif isinstance(dtype, T.DateType):
        micros = F.unix_date(col).cast("long") * F.lit(86_400_000_000)
    else:
        raise TypeError(f"not a timestamp type: {dtype}")
    return micros.cast("double") / F.lit(1_000_000.0)


def parse_iso_epoch(text: Column) -> Column:
    """ISO-8601 text -> epoch seconds with fraction; unparsable text -> NULL."""
    return F.unix_micros(F.try_to_timestamp(text)).cast("double") / F.lit(1_000_000.0)


def parse_iso_whole_seconds(text: Column) -> Column:
    """ISO-8601 text -> epoch in whole seconds (fraction dropped) as double."""
    return F.unix_timestamp(F.try_to_timestamp(text)).cast("double")


def iso_millis(ts_ntz: Column) -> Column:
    """UTC wall clock -> ``yyyy-MM-ddTHH:mm:ss.SSSZ``; milliseconds truncated."""
    return F.date_format(ts_ntz, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def iso_micros(ts_ntz: Column) -> Column:
    """UTC wall clock -> ``yyyy-MM-ddTHH:mm:ss.SSSSSSZ``."""
    return F.date_format(ts_ntz, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
