"""Ordered scans per key that stay parallel when one key holds most of the rows.

A running value over ``partitionBy(keys).orderBy(..)`` puts a whole key into one task.
Here the rows of keys with more than ``max_rows`` rows are dealt by range of the whole order,
ties included, so every slice holds about equally many rows however uneven the times are.  Each
slice is its own window partition; a *seed* row at its front carries the combined value of all
earlier slices.  Without hot keys the plan is the usual one shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..errors import SpecError
from ..session import cut

# Rows of one key a single task may order; slices aim at an eighth of it.
MAX_ROWS = 4_000_000
OVERSPLIT = 8

SLICE = "__slice"
_FLAG = "__flag"


def with_slice(
    df: DataFrame, keys: list[str], order: list[str], max_rows: int | None
) -> tuple[DataFrame, DataFrame | None]:
    """(all rows with ``__slice``, the rows of hot keys only).

    ``__slice`` is -1 for ordinary keys and rises along ``order`` for hot keys.  A count of the
    key columns alone comes first; only if it finds hot keys are their rows dealt by range and
    written once, which fixes the slices for everything that reads them.
    """
    plain = df.withColumn(SLICE, F.lit(-1).cast("long"))
    if max_rows is None:
        return plain, None
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > max_rows)
    found = counted.agg(
        F.count(F.lit(1)).alias("keys"), F.sum(F.ceil(F.col("__n") * OVERSPLIT / max_rows)).alias("slices")
    ).first()
    if not found["keys"]:
        return plain, None
    # A struct of the keys compares nulls as equal, so null keys are a key like any other.
    hot = cut(counted.select(F.struct(*keys).alias("__hot")), "hot-keys")
    keyed = df.withColumn("__key", F.struct(*keys))
    same = F.col("__key") == F.col("__hot")
    dealt = keyed.join(hot, same, "left_semi").drop("__key").repartitionByRange(found["slices"], *keys, *order)
    sliced = cut(dealt.withColumn(SLICE, F.spark_partition_id().cast("long")), "hot-rows")
    ordinary = keyed.join(hot, same, "left_anti").drop("__key").withColumn(SLICE, F.lit(-1).cast("long"))
    return ordinary.unionByName(sliced), sliced


def _entry(op: str, column: Column) -> Column:
    """What one row contributes; a seed contributes its carried value instead."""
    return F.when(column.isNotNull(), F.lit(1).cast("long")) if op == "count" else column


_OVER = {
    "count": F.sum,
    "sum": F.sum,
    "min": F.min,
    "max": F.max,
    "first": lambda c: F.first(c, ignorenulls=True),
    "last": lambda c: F.last(c, ignorenulls=True),
}


def _slice_total(op: str, value: str, order: list[str]) -> Column:
    rank = F.when(F.col(value).isNotNull(), F.struct(*order))
    if op == "first":
        return F.min_by(value, rank)
    if op == "last":
        return F.max_by(value, rank)
    return _OVER[op](F.col(value))


def running(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    aggs: dict[str, tuple[str, Column]],
    max_rows: int | None = MAX_ROWS,
    inclusive: bool = True,
) -> DataFrame:
    """Add running aggregates per key: ``{output: (op, column)}``.

    ``op`` is count, sum, min, max, first or last (nulls ignored).  ``order`` must be a
    total order, which hot keys are sliced along.  With ``inclusive=False`` a row sees only
    the rows before it.
    """
    unknown = {op for op, _ in aggs.values()} - set(_OVER)
    if unknown:
        raise SpecError(f"unsupported running operations {sorted(unknown)}")
    columns = df.columns
    values = {f"__v{i}": (op, col) for i, (op, col) in enumerate(aggs.values())}
    group = list(keys)
    rows = df.withColumns({v: _entry(op, col) for v, (op, col) in values.items()})
    if not group:
        group = ["__all"]
        # Always 0, but not a literal: the plan keeps an ordinary one-key join.
        rows = rows.withColumn("__all", F.pmod(F.xxhash64(order[0]), F.lit(1)))
    rows, hot = with_slice(rows.withColumn(_FLAG, F.lit(1)), group, order, max_rows)
    if hot is not None:
        before = W.partitionBy(*group).orderBy(SLICE).rowsBetween(W.unboundedPreceding, -1)
        totals = hot.groupBy(*group, SLICE).agg(
            *[_slice_total(op, v, order).alias(v) for v, (op, _) in values.items()]
        )
        carried = [_OVER[op](F.col(v)).over(before).alias(v) for v, (op, _) in values.items()]
        seeds = totals.select(*group, SLICE, *carried, F.lit(0).alias(_FLAG))
        rows = rows.unionByName(seeds, allowMissingColumns=True)
    frame = (
        W.partitionBy(*group, SLICE)
        .orderBy(_FLAG, *order)
        .rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
    )
    results = []
    for out, (v, (op, _)) in zip(aggs, values.items()):
        result = _OVER[op](F.col(v)).over(frame)
        results.append((F.coalesce(result, F.lit(0)) if op == "count" else result).alias(out))
    kept = [F.col(c) for c in columns if c not in aggs]
    return rows.select(*kept, *results, _FLAG).where(F.col(_FLAG) == 1).drop(_FLAG)


def row_positions(
    df: DataFrame, keys: list[str], order: list[str], out: str, max_rows: int | None = MAX_ROWS
) -> DataFrame:
    """1-based position of every row within its key."""
    return running(df, keys, order, {out: ("count", F.lit(1))}, max_rows)


def sample_every(
    df: DataFrame, keys: list[str], order: list[str], n: int, max_rows: int | None = MAX_ROWS
) -> DataFrame:
    """Keep the first of every ``n`` rows per key."""
    placed = row_positions(df, keys, order, "__pos", max_rows)
    return placed.where((F.col("__pos") - 1) % n == 0).drop("__pos")


def batch_of(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    n: int,
    out: str = "batch",
    max_rows: int | None = MAX_ROWS,
) -> DataFrame:
    """Number consecutive batches of ``n`` rows per key, from 0."""
    placed = row_positions(df, keys, order, "__pos", max_rows)
    return placed.withColumn(out, F.floor((F.col("__pos") - 1) / n).cast("long")).drop("__pos")


def flag_out_of_order(
    df: DataFrame,
    keys: list[str],
    arrival: list[str],
    ts: str,
    out: str = "out_of_order",
    max_rows: int | None = MAX_ROWS,
) -> DataFrame:
    """Flag rows older than the newest time already seen for their key."""
    seen = running(df, keys, arrival, {"__seen": ("max", F.col(ts))}, max_rows, inclusive=False)
    late = F.coalesce(F.col(ts) < F.col("__seen"), F.lit(False))
    return seen.withColumn(out, late).drop("__seen")
