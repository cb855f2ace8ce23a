"""Times as columns. Nothing here looks at the clock: the reference time is a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_date(text: Column) -> Column:
    """A timestamp from ISO (date, or date and time) or RFC 822 text (with or without seconds), else null."""
    bare = F.regexp_replace(F.trim(text), r"^[A-Za-z]{3}, ", "")
    zoned = F.regexp_replace(bare, " GMT$| UTC$", " +0000")
    return F.coalesce(
        F.when(F.rlike(text, F.lit(r"^\d{4}-\d{2}-\d{2}")), F.try_to_timestamp(text)),
        F.try_to_timestamp(zoned, F.lit("d MMM yyyy HH:mm:ss Z")),
        F.try_to_timestamp(zoned, F.lit("d MMM yyyy HH:mm Z")),
        F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm:ss")),
    )


def ago(as_of: str, hours: int) -> Column:
    return F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL {hours} HOURS")


def relative_label(ts: Column, as_of: str) -> Column:
    """now, minutes, hours or days before ``as_of``; empty for null."""
    minutes = F.floor((F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp(ts.cast("timestamp"))) / 60)
    hours = F.floor(minutes / 60)
    label = F.when(minutes < 1, "now").when(minutes < 60, F.concat(minutes.cast("string"), F.lit("min"))).when(hours < 24, F.concat(hours.cast("string"), F.lit("h"))).otherwise(F.concat(F.floor(hours / 24).cast("string"), F.lit("d")))
    return F.when(ts.isNull(), "").otherwise(label)
