"""Display formatting as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def duration(seconds: Column) -> Column:
    """``HH:MM:SS`` with unbounded hours; null, unparsable and negative input give ``00:00:00``."""
    value = seconds.try_cast("double")
    total = F.when(value.isNull() | F.isnan(value) | (value < 0), F.lit(0)).otherwise(value).cast("bigint")
    return F.format_string(
        "%02d:%02d:%02d",
        F.floor(total / 3600),
        F.floor(total % 3600 / 60),
        total % 60,
    )


def ms(millis: Column) -> Column:
    """``HH:MM:SS.mmm``; hours wrap at 24, as report tables have always shown them."""
    value = millis.cast("bigint")
    return F.format_string(
        "%02d:%02d:%02d.%03d",
        F.floor(value / 3_600_000) % 24,
        F.floor(value / 60_000) % 60,
        F.floor(value / 1000) % 60,
        value % 1000,
    )


def size(num_bytes: Column) -> Column:
    """Human-readable size with one decimal (ties to even), steps of 1024, from B to PB."""
    value = num_bytes.cast("double")
    out = F.format_string("%.1f PB", F.bround(value / 1024.0**5, 1))
    for power, unit in reversed(list(enumerate(["B", "KB", "MB", "GB", "TB"]))):
        scaled = value / 1024.0**power
        out = F.when(scaled < 1024, F.format_string(f"%.1f {unit}", F.bround(scaled, 1))).otherwise(out)
    return out


def title(kill_type: Column) -> Column:
    """``double_kill`` -> ``Double Kill``."""
    return F.initcap(F.replace(kill_type, F.lit("_"), F.lit(" ")))
