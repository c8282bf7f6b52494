"""Content hashes that stay the same across runs and key orders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical(entries: Column) -> Column:
    """Array of struct<path,value> -> one text that does not depend on entry order.

    Lengths are part of the text so that no two different documents share it.
    """
    lines = F.transform(
        F.array_sort(entries),
        lambda e: F.concat_ws(
            ":",
            F.length(e["path"]),
            e["path"],
            F.length(F.coalesce(e["value"], F.lit("null"))),
            F.coalesce(e["value"], F.lit("null")),
        ),
    )
    return F.array_join(lines, "\n")


def stable_hash(text: Column) -> Column:
    """First 16 hex digits of SHA-256."""
    return F.substring(F.sha2(text, 256), 1, 16)


def path_hash(path: Column, length: int = 8) -> Column:
    return F.substring(F.sha2(path, 256), 1, length)
