"""Window strings and time truncation."""

from __future__ import annotations

import re
from datetime import timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

# Window units.
WINDOW_UNITS = {"s": "seconds", "m": "minutes", "h": "hours", "d": "days"}
BUCKETS = ("hour", "day")


def parse_window(window: str) -> timedelta:
    """``"5m"`` -> five minutes; raises ValueError on any other shape."""
    found = re.fullmatch(r"(\d+)([smhd])", window.strip().lower())
    if found is None:
        raise ValueError(f"window must be a number and one of s, m, h, d, not {window!r}")
    return timedelta(**{WINDOW_UNITS[found.group(2)]: int(found.group(1))})


def truncate_bucket(ts: Column, bucket: str) -> Column:
    """Start of the hour or day."""
    if bucket not in BUCKETS:
        raise ValueError(f"bucket must be one of {BUCKETS}, not {bucket!r}")
    return F.date_trunc(bucket, ts)
