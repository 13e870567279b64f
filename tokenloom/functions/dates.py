"""Date and time literals that do not depend on any time zone."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def ntz(value: dt.datetime) -> Column:
    """A TIMESTAMP_NTZ literal parsed from text.

    ``F.lit(datetime)`` goes through the Python process's zone and back
    through the session's; parsing wall-clock text keeps the value exact
    whatever either zone is.
    """
    return F.to_timestamp_ntz(F.lit(value.strftime("%Y-%m-%d %H:%M:%S.%f")))
