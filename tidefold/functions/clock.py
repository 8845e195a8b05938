"""Zone-free time arithmetic on TIMESTAMP_NTZ columns."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

EPOCH = datetime(1970, 1, 1)


def seconds_of(moment: datetime) -> int:
    return int((moment - EPOCH).total_seconds())


def epoch_seconds(ts: Column) -> Column:
    """Whole seconds since 1970, read off the wall clock so no session zone is involved."""
    return (
        F.datediff(ts.cast("date"), F.lit("1970-01-01").cast("date")).cast("long") * 86400
        + F.hour(ts) * 3600
        + F.minute(ts) * 60
        + F.second(ts)
    )


def slot_of(ts: Column, start: datetime, step: int) -> Column:
    """Index of the tumbling bucket of ``step`` seconds that holds ``ts``."""
    return F.floor((epoch_seconds(ts) - F.lit(seconds_of(start))) / F.lit(step)).cast("long")


def slot_start(slot: Column, start: datetime, step: int) -> Column:
    origin = F.lit(start.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp_ntz")
    return origin + F.make_dt_interval(secs=(slot * F.lit(step)).cast("decimal(18,6)"))


def slots_between(start: datetime, end: datetime, step: int) -> int:
    """Number of buckets in [start, end): the proven length bound of a gridded series."""
    span = seconds_of(end) - seconds_of(start)
    if span <= 0 or step <= 0:
        raise ValueError("The period must be positive.")
    return -(-span // step)


def text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")
