"""Lenient parsers: bad input becomes a default or NULL, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What reads as true and as false.
FLAG_WORDS = {"true": True, "1": True, "yes": True, "on": True, "false": False, "0": False, "no": False, "off": False}


def fps(value: Column) -> Column:
    """Whole ``num/den`` or a plain number; zero denominator or garbage -> 0.0."""
    num = F.split_part(value, F.lit("/"), F.lit(1)).try_cast("bigint")
    den = F.split_part(value, F.lit("/"), F.lit(2)).try_cast("bigint")
    has_slash = F.contains(value, F.lit("/"))
    is_pair = F.size(F.split(value, "/")) == 2
    rate = F.when(has_slash, F.when(is_pair, F.try_divide(num, den))).otherwise(value.try_cast("double"))
    return F.coalesce(rate, F.lit(0.0))


def resolution(value: Column) -> Column:
    """``WxH`` -> struct<width,height>; both NULL when either half is not an integer."""
    parts = F.split(value, "x", 2)
    width = F.trim(F.get(parts, F.lit(0))).try_cast("int")
    height = F.trim(F.get(parts, F.lit(1))).try_cast("int")
    ok = width.isNotNull() & height.isNotNull()
    return F.struct(F.when(ok, width).alias("width"), F.when(ok, height).alias("height"))


def as_float(value: Column, default: float | Column) -> Column:
    return F.coalesce(value.try_cast("double"), default if isinstance(default, Column) else F.lit(default))


def as_bool(value: Column, default: bool | Column) -> Column:
    """true/1/yes/on and false/0/no/off in any case and padding; anything else -> default."""
    word = F.lower(F.trim(value.cast("string")))
    fallback = default if isinstance(default, Column) else F.lit(default)
    return (
        F.when(word.isin([w for w, flag in FLAG_WORDS.items() if flag]), F.lit(True))
        .when(word.isin([w for w, flag in FLAG_WORDS.items() if not flag]), F.lit(False))
        .otherwise(fallback)
    )


def frame_ts_from_name(path: Column) -> Column:
    """Milliseconds in ``frame_<ms>[_k]``; unparsable names -> 0."""
    return F.coalesce(
        F.nullif(F.regexp_extract(path, r"frame_(\d+)", 1), F.lit("")).try_cast("bigint"), F.lit(0).cast("bigint")
    )
