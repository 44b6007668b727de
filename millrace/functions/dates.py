"""Date and epoch helpers that do not depend on the session time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def epoch_micros(ts: Column) -> Column:
    """Microseconds since 1970 of a ``timestamp_ntz`` read as UTC."""
    days = F.datediff(ts.cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint")
    seconds = days * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60
    micros = F.extract(F.lit("SECOND"), ts).cast("decimal(8,6)") * 1000000
    return seconds * 1000000 + micros.cast("bigint")


def epoch_seconds(ts: Column) -> Column:
    return F.floor(epoch_micros(ts) / 1000000)
