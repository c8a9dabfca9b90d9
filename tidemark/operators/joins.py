"""Equi joins, point-in-time joins, lookups and gathering of branch events."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import SpecError
from ..functions.time import duration_micros
from ..types import orderable
from .ordered import MAX_ROWS, batch_of, running


def _on(left_keys: list[str], right_keys: list[str]) -> Column:
    pairs = [F.col(f"l.{a}") == F.col(f"r.{b}") for a, b in zip(left_keys, right_keys)]
    return reduce(lambda a, b: a & b, pairs)


def equi_join(
    left: DataFrame,
    right: DataFrame,
    left_keys: list[str],
    right_keys: list[str] | None = None,
    how: str = "inner",
) -> DataFrame:
    """Join on keys whose names may differ; key columns keep the left names.

    Size-based broadcast and skew splitting are left to adaptive execution.  A full outer
    join is a left join plus the unmatched right rows, because a skewed full outer join
    cannot be split.
    """
    right_keys = list(right_keys or left_keys)
    if len(left_keys) != len(right_keys) or not left_keys:
        raise SpecError("joins need equally many left and right keys")
    if how not in ("inner", "left", "right", "outer"):
        raise SpecError(f"join type {how!r} is not supported")
    extra = [c for c in right.columns if c not in right_keys]
    clash = sorted(set(extra) & set(left.columns))
    if clash:
        raise SpecError(f"columns {clash} are on both sides; rename them first")
    if how == "outer":
        matched = equi_join(left, right, left_keys, right_keys, "left")
        lonely = right.alias("r").join(
            left.select(*left_keys).alias("l"), _on(left_keys, right_keys), "left_anti"
        )
        lonely = lonely.withColumnsRenamed(dict(zip(right_keys, left_keys)))
        return matched.unionByName(lonely, allowMissingColumns=True)
    keys = dict(zip(left_keys, right_keys))
    joined = left.alias("l").join(right.alias("r"), _on(left_keys, right_keys), how)
    side = "r" if how == "right" else "l"
    picked = [
        F.col(f"{side}.{keys[c] if side == 'r' else c}").alias(c) if c in keys else F.col(f"l.{c}")
        for c in left.columns
    ]
    return joined.select(*picked, *[F.col(f"r.{c}") for c in extra])


@dataclass(frozen=True)
class AsOf:
    """Right side of a point-in-time join; ``keep_ts`` names a column for the matched time."""

    df: DataFrame
    keys: tuple[str, ...]
    ts: str
    keep_ts: str | None = None

    @property
    def values(self) -> list[str]:
        return [c for c in self.df.columns if c not in self.keys and c != self.ts]

    @property
    def ranked(self) -> list[str]:
        """Value columns that can break ties; maps cannot be compared."""
        return [c for c in self.values if orderable(self.df.schema[c].dataType)]

    @property
    def outputs(self) -> list[str]:
        return [*self.values, *([self.keep_ts] if self.keep_ts else [])]


def asof_join(
    left: DataFrame,
    right: DataFrame,
    left_keys: list[str],
    left_ts: str,
    right_ts: str | None = None,
    right_keys: list[str] | None = None,
    keep_right_ts: str | None = None,
    max_rows: int | None = MAX_ROWS,
) -> DataFrame:
    """For each left row the newest right row with equal keys and ``right_ts <= left_ts``."""
    side = AsOf(right, tuple(right_keys or left_keys), right_ts or left_ts, keep_right_ts)
    return asof_join_many(left, [side], left_keys, left_ts, max_rows)


def asof_join_many(
    left: DataFrame,
    rights: list[AsOf],
    left_keys: list[str],
    left_ts: str,
    max_rows: int | None = MAX_ROWS,
) -> DataFrame:
    """Point-in-time join of several sets on the same left keys, in one shuffle.

    All sides are stacked and the last row of each right side is carried along time, so
    nothing is joined by inequality and no pair is built that is not in the result.  Left
    rows are always kept.  Equal right times are resolved towards the largest remaining
    columns.
    """
    names = [f"__k{i}" for i in range(len(left_keys))]
    outputs = [c for r in rights for c in r.outputs]
    clash = sorted({c for c in outputs if outputs.count(c) > 1 or c in left.columns})
    if clash:
        raise SpecError(f"columns {clash} are on both sides; rename them first")
    # Rows with a null key match nothing; a salt keeps them out of one common group.
    unkeyed = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in left_keys])
    stacked = left.select(
        *[F.col(k).alias(n) for k, n in zip(left_keys, names)],
        F.when(unkeyed, F.pmod(F.xxhash64(left_ts), F.lit(4096))).otherwise(F.lit(0)).alias("__salt"),
        F.col(left_ts).cast("timestamp").alias("__ts"),
        F.lit(len(rights)).alias("__side"),
        F.struct(*left.columns).alias("__l"),
    )
    order = ["__ts", "__side"]
    for i, right in enumerate(rights):
        if len(right.keys) != len(left_keys):
            raise SpecError("joins need equally many left and right keys")
        row = F.struct(F.col(right.ts).cast("timestamp").alias("__ts"), *right.values)
        rows = right.df.na.drop(subset=[*right.keys, right.ts]).select(
            *[F.col(k).alias(n) for k, n in zip(right.keys, names)],
            F.lit(0).cast("long").alias("__salt"),
            F.col(right.ts).cast("timestamp").alias("__ts"),
            F.lit(i).alias("__side"),
            row.alias(f"__r{i}"),
        )
        if right.ranked == right.values:
            order.append(f"__r{i}")
        elif right.ranked:
            rows = rows.withColumn(f"__t{i}", F.struct(*[f"__r{i}.{c}" for c in right.ranked]))
            order.append(f"__t{i}")
        stacked = stacked.unionByName(rows, allowMissingColumns=True)
    found = {f"__m{i}": ("last", F.col(f"__r{i}")) for i in range(len(rights))}
    carried = running(stacked, [*names, "__salt"], order, found, max_rows).where(
        F.col("__side") == len(rights)
    )
    extra = []
    for i, right in enumerate(rights):
        extra += [F.col(f"__m{i}.{c}").alias(c) for c in right.values]
        if right.keep_ts:
            extra.append(F.col(f"__m{i}.__ts").alias(right.keep_ts))
    return carried.select(*[F.col(f"__l.{c}").alias(c) for c in left.columns], *extra)


def asof_join_ranked(left, right, keys, left_ts, right_ts) -> DataFrame:
    """Small-data cross-check of ``asof_join``: inequality join, newest match by aggregate."""
    values = [c for c in right.columns if c not in keys and c != right_ts]
    tagged = left.withColumn("__row", F.monotonically_increasing_id())
    pairs = tagged.alias("l").join(
        right.alias("r"),
        _on(keys, keys) & (F.col(f"r.{right_ts}") <= F.col(f"l.{left_ts}")),
        "left",
    )
    best = F.max(F.struct(F.col(f"r.{right_ts}"), *[F.col(f"r.{v}") for v in values]))
    return (
        pairs.groupBy("__row", *[F.col(f"l.{c}").alias(c) for c in left.columns])
        .agg(best.alias("__m"))
        .select(*left.columns, *[F.col(f"__m.{v}").alias(v) for v in values])
    )


def latest_per_key(df: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """Newest row per key, combined map-side; ties go to the largest remaining columns."""
    rest = [c for c in df.columns if c not in keys and c != ts]
    row = F.struct(F.col(ts), *rest)
    rank = F.struct(F.col(ts), *[c for c in rest if orderable(df.schema[c].dataType)])
    best = F.max(row) if all(orderable(df.schema[c].dataType) for c in rest) else F.max_by(row, rank)
    return (
        df.where(F.col(ts).isNotNull())
        .groupBy(*keys)
        .agg(best.alias("__m"))
        .select(*[c if c in keys else F.col(f"__m.{c}").alias(c) for c in df.columns])
    )


def lookup_latest(
    requests: DataFrame, tables: list[tuple[DataFrame, list[str]]], keep_found: str | None = None
) -> DataFrame:
    """Features of each requested key from keyed tables; missing keys give nulls."""
    found = []
    for i, (table, keys) in enumerate(tables):
        flagged = table.withColumn(f"__f{i}", F.lit(True))
        requests = equi_join(requests, flagged, keys, keys, "left")
        found.append(F.col(f"__f{i}"))
    if keep_found:
        requests = requests.withColumn(keep_found, F.coalesce(*found, F.lit(False)))
    return requests.drop(*[f"__f{i}" for i in range(len(tables))])


def lookup_fixed_window(
    requests: DataFrame,
    windows: DataFrame,
    keys: list[str],
    ts: str,
    window_end: str,
    size: str,
    kind: str = "last_closed",
) -> DataFrame:
    """Value of the last closed or the current open tumbling window at request time.

    The window of a request is known from its time, so this is an equi join for the open
    window and a point-in-time join for the closed one.
    """
    if kind == "last_closed":
        return asof_join(requests, windows, keys, ts, window_end, keep_right_ts="window_end")
    if kind != "current_open":
        raise SpecError(f"unknown window kind {kind!r}")
    micros = duration_micros(size)
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    end = F.timestamp_micros(at - F.pmod(at, F.lit(micros)) + micros)
    right = windows.withColumnRenamed(window_end, "window_end")
    return equi_join(
        requests.withColumn("__end", end), right, [*keys, "__end"], [*keys, "window_end"], "left"
    ).withColumnRenamed("__end", "window_end")


def merge_by_key(
    df: DataFrame,
    key: str,
    order: list[str],
    value: Column,
    expected: int,
    out: str = "parts",
    max_rows: int | None = MAX_ROWS,
) -> DataFrame:
    """Gather the branch events of a key; emit one row per ``expected`` arrivals.

    ``df`` holds the events of all branches, ``order`` their arrival.  Incomplete keys
    emit nothing.  A gathered array never exceeds ``expected`` entries.
    """
    placed = batch_of(df.withColumn("__part", value), [key], order, expected, "__round", max_rows)
    arrival = F.struct(*[F.col(c) for c in order], F.col("__part").alias("__part"))
    return (
        placed.groupBy(key, "__round")
        .agg(F.sort_array(F.collect_list(arrival)).alias(out))
        .where(F.size(out) == expected)
        .select(key, F.transform(out, lambda p: p["__part"]).alias(out))
    )
