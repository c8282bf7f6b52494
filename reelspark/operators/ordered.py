"""Running aggregates along time that survive one recording holding a third of all rows.

A plain ``Window.partitionBy(video).orderBy(t)`` puts a whole recording into one task. Here the time axis of
every key is cut into buckets:

1. inside (key, bucket) an ordinary window runs;
2. every (key, bucket) is reduced to one summary row (map-side combine again);
3. a window over the summaries, which are fewer by the bucket density, yields what each bucket inherits from the
   buckets before it, and an equi-join on (key, bucket) - the partitioning step 1 already has - hands it over.

Buckets are either of fixed width on the axis, for callers that hand in distinct instants (a bucket then has no more
rows than its width), or of a fixed number of rows (``rows``), whatever the axis looks like: rows are sorted by range
over all partitions, equal instants are dealt out by their content, and every ``rows`` rows in turn are a bucket.

NULL keys are one key. They are told apart by a flag beside a filled key, so that joins stay plain equalities and
keep the partitioning of the windows. Fixed-width buckets are a function of the data alone, buckets by rows are
checkpointed, so a lost executor's tasks recompute to the same answer.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelspark.session import durable

#: One hour of media: at most 3.6 million distinct millisecond instants per bucket.
HOUR_MS = 3_600_000
#: Bucket width for axes that count rows (clip ids, frame numbers, ranks).
COUNT_WIDTH = 100_000
#: Rows of a bucket where the axis promises nothing; a power of two.
BUCKET_ROWS = 1 << 16
#: Spark limits the rows of a group before the shuffle for ranks up to this one.
GROUP_LIMIT = 1000
#: Parts of a key in which higher ranks are looked for first.
RANK_PARTS = 64

_BUCKET, _AT = "__bucket", "__at"


@dataclass(frozen=True)
class Run:
    """One running aggregate: ``kind`` is sum, max, min or last (non-null) of ``column``.

    ``upto`` is "before" (strictly earlier rows), "through" (earlier rows and this one), "onward" (this row and
    all later ones) or "after" (strictly later ones); looking forward, "last" means the nearest following value.
    ``bit_xor`` is a kind too.
    """

    kind: str
    column: Column
    upto: str = "before"


def bucket_of(order: Column, width: int) -> Column:
    return F.floor(order / F.lit(width)).cast("bigint")


def _combine(kind: str, carried: Column, local: Column) -> Column:
    if kind == "sum":
        return F.when(carried.isNull() & local.isNull(), None).otherwise(
            F.coalesce(carried, F.lit(0)) + F.coalesce(local, F.lit(0))
        )
    if kind == "bit_xor":
        return F.coalesce(carried, F.lit(0)).bitwiseXOR(F.coalesce(local, F.lit(0)))
    if kind == "max":
        return F.greatest(carried, local)
    if kind == "min":
        return F.least(carried, local)
    return F.coalesce(local, carried)


def _over(kind: str, column: Column, window) -> Column:
    if kind == "last":
        return F.last(column, ignorenulls=True).over(window)
    return getattr(F, kind)(column).over(window)


def filled(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """``df`` with each key as a column without NULLs and a flag column, and the names of these columns."""
    fill = {T.StringType: "", T.BooleanType: "false", T.DateType: "1970-01-01", T.TimestampType: "1970-01-01", T.TimestampNTZType: "1970-01-01", T.BinaryType: ""}
    new: dict[str, Column] = {}
    for key in keys:
        field = df.schema[key]
        if not field.nullable:
            new[f"__key_{key}"] = F.col(key)
            continue
        value = next((v for t, v in fill.items() if isinstance(field.dataType, t)), "0")
        new[f"__key_{key}"] = F.coalesce(F.col(key), F.lit(value).cast(field.dataType))
        new[f"__null_{key}"] = F.col(key).isNull()
    return df.withColumns(new), list(new)


def laid_out(df: DataFrame, keys: Sequence[str], order: str, tie: Sequence[str] = (), rows: int = BUCKET_ROWS) -> DataFrame:
    """``df`` in the order of (keys, order, tie) over all partitions, with ``__at``, the place in that order, and
    ``__bucket``, of at most ``rows`` rows (rounded down to a power of two). Equal places are dealt out by the rows' content."""
    content = F.xxhash64(*df.columns)
    position = [*keys, order, *tie, content]
    ranged = df.repartitionByRange(*position).sortWithinPartitions(*position)
    # The high bits of the place are the partition's, so no bucket reaches over two partitions.
    placed = durable(ranged.withColumn(_AT, F.monotonically_increasing_id()))
    return placed.withColumn(_BUCKET, F.shiftright(_AT, rows.bit_length() - 1))


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    runs: Mapping[str, Run],
    *,
    width: int = HOUR_MS,
    tie: Sequence[str] = (),
    rows: int | None = None,
) -> DataFrame:
    """Add each of ``runs`` to ``df``: aggregates over the rows before, through or from each row of its key.

    ``order`` is an integer axis; ``tie`` breaks equal positions. NULL keys are one key. ``rows`` bounds a bucket by its
    number of rows, not by its width: for axes on which many rows may share an instant (costs one sort by range, written
    to the shared folder). Otherwise ``df`` is read twice (rows and summaries): Spark reuses its last shuffle when both
    need the same columns, otherwise cut the lineage of expensive inputs first (``session.durable``).
    """
    columns = df.columns
    df, names = filled(df, keys)
    group = [*names, _BUCKET]
    inputs = {f"__in_{name}": run.column for name, run in runs.items()}
    if rows is None:
        tagged = df.withColumns({_BUCKET: bucket_of(F.col(order), width), **inputs})
    else:
        tagged = laid_out(df.withColumns(inputs), names, order, tie, rows)
        order, tie = _AT, ()
    position = F.struct(order, *tie)

    def total(name: str, run: Run) -> Column:
        value = F.col(f"__in_{name}")
        if run.kind == "last":
            pick = F.min_by if run.upto in ("onward", "after") else F.max_by
            return pick(value, F.when(value.isNotNull(), position)).alias(name)
        return getattr(F, run.kind)(value).alias(name)

    summaries = tagged.groupBy(*group).agg(*[total(n, r) for n, r in runs.items()])
    by_key = W.partitionBy(*names)
    outside = {
        False: by_key.orderBy(_BUCKET).rowsBetween(W.unboundedPreceding, -1),
        True: by_key.orderBy(F.col(_BUCKET).desc()).rowsBetween(W.unboundedPreceding, -1),
    }
    inherited = summaries.select(
        *group, *[_over(r.kind, F.col(n), outside[r.upto in ("onward", "after")]).alias(f"__carry_{n}") for n, r in runs.items()]
    )

    up = W.partitionBy(*group).orderBy(order, *tie)
    down = W.partitionBy(*group).orderBy(F.col(order).desc(), *[F.col(t).desc() for t in tie])
    frames = {
        "before": up.rowsBetween(W.unboundedPreceding, -1),
        "through": up.rowsBetween(W.unboundedPreceding, 0),
        "onward": down.rowsBetween(W.unboundedPreceding, 0),
        "after": down.rowsBetween(W.unboundedPreceding, -1),
    }
    local = {f"__local_{n}": _over(r.kind, F.col(f"__in_{n}"), frames[r.upto]) for n, r in runs.items()}
    out = {n: _combine(r.kind, F.col(f"__carry_{n}"), F.col(f"__local_{n}")) for n, r in runs.items()}
    joined = tagged.withColumns(local).join(inherited, group, "left")
    return joined.withColumns(out).select(*columns, *runs)


def numbered(
    df: DataFrame, keys: Sequence[str], order: str, name: str, *, width: int = HOUR_MS, tie: Sequence[str] = (), rows: int | None = None
) -> DataFrame:
    """1-based position of every row within its key."""
    return running(df, keys, order, {name: Run("sum", F.lit(1).cast("bigint"), "through")}, width=width, tie=tie, rows=rows)


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first ``n`` rows of every key.

    Spark limits each map partition to n per key before the shuffle, up to ``GROUP_LIMIT``. For more, a key's rows are
    ranked in ``RANK_PARTS`` parts first, and only the first n of each part meet.
    """
    if n > GROUP_LIMIT:
        part = W.partitionBy(*keys, "__part").orderBy(*order)
        parted = df.withColumn("__part", F.pmod(F.xxhash64(*df.columns), F.lit(RANK_PARTS)))
        df = parted.withColumn("__rank", F.row_number().over(part)).filter(F.col("__rank") <= n).drop("__part", "__rank")
    window = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= n)
