"""Days of a time zone over instants in UTC: a day begins at local midnight and has 23, 24 or 25 hours."""

from __future__ import annotations

import datetime as dt
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the zone whose days are counted.
ZONE = "Europe/Berlin"


def local_day(instant: Column | str, zone: str = ZONE) -> Column:
    """The local date of an instant (a timestamp without zone, in UTC), whatever the session's zone."""
    column = F.col(instant) if isinstance(instant, str) else instant
    return F.to_date(F.convert_timezone(F.lit("UTC"), F.lit(zone), column.cast("timestamp_ntz")))


def local_month(instant: Column | str, zone: str = ZONE) -> Column:
    return F.trunc(local_day(instant, zone), "month")


def bounds(first: dt.date, last: dt.date, zone: str = ZONE) -> tuple[dt.datetime, dt.datetime]:
    """The half-open range of instants, in UTC without a zone, of the local days from first to last."""
    start, end = (dt.datetime.combine(d, dt.time(), ZoneInfo(zone)).astimezone(dt.UTC).replace(tzinfo=None) for d in (first, last + dt.timedelta(days=1)))
    return start, end


def within(column: str, first: dt.date, last: dt.date, zone: str = ZONE) -> str:
    """A condition on instants that files can be skipped by."""
    start, end = bounds(first, last, zone)
    return f"{column} >= TIMESTAMP_NTZ '{start:%Y-%m-%d %H:%M:%S}' AND {column} < TIMESTAMP_NTZ '{end:%Y-%m-%d %H:%M:%S}'"


def today(now: dt.datetime, zone: str = ZONE) -> dt.date:
    """The local date of an instant in UTC."""
    return now.replace(tzinfo=dt.UTC).astimezone(ZoneInfo(zone)).date()
