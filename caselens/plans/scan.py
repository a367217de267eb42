"""Running values over an ordered key without holding a whole key in one task.

A plain window sorts every row of a key in one task, which fails when one session or
stream owns a large share of the table. Here a key is cut into chunks of consecutive
order values. Windows run inside a chunk, one summary row per chunk carries the value
across chunks, and an equi-join on (key, chunk) hands the carry back. A chunk holds at
most ``rows`` rows because the order value is unique within its key.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import pinned

CHUNK_ROWS = 1 << 20


@dataclass(frozen=True)
class Sum:
    """Running sum up to and including the row (or before it)."""

    value: Column
    inclusive: bool = True


@dataclass(frozen=True)
class Max:
    """Largest value before the row (or up to it)."""

    value: Column
    inclusive: bool = False


@dataclass(frozen=True)
class Last:
    """Nearest non-null value before the row (or up to it)."""

    value: Column
    inclusive: bool = False


@dataclass(frozen=True)
class Next:
    """Nearest non-null value after the row (or from it on)."""

    value: Column
    inclusive: bool = False


Scan = Sum | Max | Last | Next


def _total(spec: Scan, value: Column, order: Column) -> Column:
    if isinstance(spec, Sum):
        return F.sum(value)
    if isinstance(spec, Max):
        return F.max(value)
    position = F.when(value.isNotNull(), order)
    return F.max_by(value, position) if isinstance(spec, Last) else F.min_by(value, position)


def ordered_scan(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    outputs: Mapping[str, Scan],
    rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Add the ``outputs`` columns; ``order`` is an integer, unique within ``keys``."""
    names = list(outputs)
    staged = df.withColumn("_chunk", F.expr(f"`{order}` div {int(rows)}"))
    for index, name in enumerate(names):
        staged = staged.withColumn(f"_v{index}", outputs[name].value)
    staged_keys = [*keys, "_chunk"]

    summary = staged.groupBy(*staged_keys).agg(
        *[
            _total(outputs[name], F.col(f"_v{index}"), F.col(order)).alias(f"_t{index}")
            for index, name in enumerate(names)
        ]
    )
    # looking ahead is looking back in the opposite order: a frame that grows with the rows
    # is updated in place, one that shrinks would be recomputed for every row
    across = Window.partitionBy(*(keys or [F.lit(0)]))
    earlier = across.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    later = across.orderBy(F.desc("_chunk")).rowsBetween(Window.unboundedPreceding, -1)
    carries = []
    for index, name in enumerate(names):
        spec, total = outputs[name], F.col(f"_t{index}")
        if isinstance(spec, Sum):
            carry = F.sum(total).over(earlier)
        elif isinstance(spec, Max):
            carry = F.max(total).over(earlier)
        elif isinstance(spec, Last):
            carry = F.last(total, ignorenulls=True).over(earlier)
        else:
            carry = F.last(total, ignorenulls=True).over(later)
        carries.append(carry.alias(f"_c{index}"))
    carry_rows = summary.select(*staged_keys, *carries)

    within = Window.partitionBy(*staged_keys)
    local = staged
    for index, name in enumerate(names):
        spec, value = outputs[name], F.col(f"_v{index}")
        stop = 0 if spec.inclusive else -1
        before = within.orderBy(order).rowsBetween(Window.unboundedPreceding, stop)
        after = within.orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, stop)
        if isinstance(spec, Sum):
            expr = F.sum(value).over(before)
        elif isinstance(spec, Max):
            expr = F.max(value).over(before)
        elif isinstance(spec, Last):
            expr = F.last(value, ignorenulls=True).over(before)
        else:
            expr = F.last(value, ignorenulls=True).over(after)
        local = local.withColumn(f"_l{index}", expr)

    joined = local.join(carry_rows, staged_keys, "left")
    merged = []
    for index, name in enumerate(names):
        spec = outputs[name]
        here, carried = F.col(f"_l{index}"), F.col(f"_c{index}")
        if isinstance(spec, Sum):
            # at least one addend is an exact zero where a side has no rows yet
            merged.append(
                F.when(here.isNull(), carried).when(carried.isNull(), here)
                .otherwise(here + carried).alias(name)
            )
        elif isinstance(spec, Max):
            merged.append(F.greatest(here, carried).alias(name))
        else:
            merged.append(F.coalesce(here, carried).alias(name))
    kept = [c for c in df.columns if c not in names]
    return joined.select(*kept, *merged)


def numbered(
    df: DataFrame, keys: Sequence[str], order: str, name: str, rows: int = CHUNK_ROWS
) -> DataFrame:
    """1-based position of each row within its key."""
    return ordered_scan(df, keys, order, {name: Sum(F.lit(1).cast("bigint"))}, rows)


def ranked(df: DataFrame, keys: Sequence[str], sort: Sequence[Column], name: str) -> DataFrame:
    """1-based position within ``keys`` for any total order.

    Rows are range-partitioned on (keys, sort), so a large group spreads over many
    partitions. The partition number is pinned before it is used as a chunk number.
    """
    spread = df.repartitionByRange(*[F.col(k) for k in keys], *sort)
    spread = pinned(spread.withColumn("_part", F.spark_partition_id()))
    counts = spread.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"))
    across = (
        Window.partitionBy(*(keys or [F.lit(0)]))
        .orderBy("_part")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = counts.select(
        *keys, "_part", F.coalesce(F.sum("_n").over(across), F.lit(0)).alias("_before")
    )
    within = Window.partitionBy(*keys, "_part").orderBy(*sort)
    return (
        spread.withColumn("_rn", F.row_number().over(within))
        .join(offsets, [*keys, "_part"])
        .withColumn(name, F.col("_before") + F.col("_rn"))
        .drop("_part", "_rn", "_before")
    )


def top_rows(
    df: DataFrame, keys: Sequence[str], sort: Sequence[Column], k: int | Column, name: str = "rank"
) -> DataFrame:
    """First ``k`` rows per key. A constant ``k`` lets Spark prune each task to ``k``
    rows per key before the shuffle (WindowGroupLimit)."""
    window = Window.partitionBy(*[F.col(key) for key in keys]).orderBy(*sort)
    return df.withColumn(name, F.row_number().over(window)).where(F.col(name) <= k)
