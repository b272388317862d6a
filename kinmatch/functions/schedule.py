"""Wall-clock slots of the periodic refresh."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def next_slot(ts: Column, hours: int = 4) -> Column:
    """The first slot after a time; slots are that many hours apart, from midnight on."""
    day = F.date_trunc("DAY", ts)
    step = hours * 3600
    passed = F.unix_timestamp(ts) - F.unix_timestamp(day)
    return F.timestamp_seconds(F.unix_timestamp(day) + (F.floor(passed / step) + 1) * step)
