"""Epoch-aligned tumbling and sliding aggregates, per window or per event.

Rows are reduced once to partials per (key, bucket); windows are then merged from
partials.  A sliding window never multiplies raw rows and a hot key is combined map-side.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..errors import SpecError
from ..functions.time import duration_seconds, epoch_bucket
from ..specs import Aggregation
from ..types import orderable
from .ordered import MAX_ROWS, SLICE, with_slice
from .partials import (
    combine,
    fields_for,
    finish,
    frame_partial,
    group_partial,
    merge_aggs,
    prefix_partial,
)

_B = "__bucket"

# Length of a block of buckets, in windows; the copied share is its inverse.
BLOCK_WINDOWS = 16


def _rank(df: DataFrame, ts: str) -> Column:
    """Total order in time: ties are broken by a hash of the row."""
    plain = [f.name for f in df.schema if orderable(f.dataType)]
    return F.when(F.col(ts).isNotNull(), F.struct(F.col(ts), F.xxhash64(*plain)))


def _check(df: DataFrame, keys, ts, aggregations) -> None:
    wanted = {*keys, ts, *[a.column for a in aggregations]}
    missing = sorted(wanted - set(df.columns))
    if missing:
        raise SpecError(f"columns {missing} are not in the data")
    outputs = [a.output(op, w) for a in aggregations for w in a.windows for op in a.operations]
    if len(set(outputs)) != len(outputs):
        raise SpecError("two aggregations give the same column name")


def _ops_by_column(specs: list[tuple[Aggregation, str]]) -> dict[str, list[str]]:
    ops: dict[str, set] = {}
    for agg, _ in specs:
        ops.setdefault(agg.column, set()).update(agg.operations)
    return {c: fields_for(o) for c, o in ops.items()}


def aggregate_windows(
    df: DataFrame,
    keys: list[str],
    ts: str,
    aggregations: list[Aggregation],
    carry_last: bool = True,
) -> DataFrame:
    """One row per key and window: window end as time, ``{ts}_window`` names the window.

    With ``carry_last`` every other column carries its last value in the window.  Windows
    of different sizes are stacked; a row has only its own window's aggregates.  All
    windows come from one scan: buckets of the common step are merged once to the buckets of
    each step, and a window from those, so a long window next to a short one merges few.
    """
    _check(df, keys, ts, aggregations)
    specs = [(a, w) for a in aggregations for w in a.windows]
    windows = list(dict.fromkeys((w, a.step(w)) for a, w in specs))
    bucket = reduce(math.gcd, [step for _, step in windows]) * 1_000_000
    fields = _ops_by_column(specs)
    others = [c for c in df.columns if c not in keys and c != ts] if carry_last else []
    rank = _rank(df, ts)
    aggs = [group_partial(F.col(c), rank, f).alias(f"__p_{c}") for c, f in fields.items()]
    if others:
        carried = F.struct(rank.alias("o"), F.struct(*others).alias("v"))
        aggs.append(F.max_by(carried, rank).alias("__rest"))
    partials = (
        df.where(F.col(ts).isNotNull())
        .withColumn(_B, epoch_bucket(ts, bucket))
        .groupBy(*keys, _B)
        .agg(*aggs)
    )
    if len(windows) == 1 and duration_seconds(windows[0][0]) * 1_000_000 == bucket:
        merged = partials.withColumns({"__end": F.col(_B) + bucket, "__w": F.lit(0)})
    else:
        merged = _merge_windows(partials, keys, windows, bucket, fields, others)
    outputs = []
    for agg, window in specs:
        own = F.col("__w") == windows.index((window, agg.step(window)))
        for op in agg.operations:
            value = finish(op, F.col(f"__p_{agg.column}"))
            outputs.append(F.when(own, value).alias(agg.output(op, window)))
    labels = F.array(*[F.lit(w) for w, _ in windows])
    return merged.select(
        *keys,
        F.timestamp_micros("__end").alias(ts),
        *[F.col(f"__rest.v.{c}").alias(c) for c in others],
        *outputs,
        F.get(labels, F.col("__w")).alias(f"{ts}_window"),
    )


def _merged(rows: DataFrame, group: list, fields: dict, others: list[str]) -> DataFrame:
    """Partials of a group from the partials of its parts."""
    aggs, built = [], {}
    for c, f in fields.items():
        columns, struct = merge_aggs(F.col(f"__p_{c}"), f, f"__m_{c}")
        aggs += columns
        built[f"__p_{c}"] = struct
    if others:
        aggs.append(F.max_by("__rest", F.col("__rest.o")).alias("__rest"))
    return rows.groupBy(*group).agg(*aggs).withColumns(built)


def _merge_windows(partials, keys, windows, bucket, fields, others):
    """Partials of every window from the partials of its buckets, step by step."""
    kept = [*keys, "__w", "__end", *[f"__p_{c}" for c in fields], *(["__rest"] if others else [])]
    steps: dict[int, list[tuple[int, int]]] = {}
    for i, (window, step) in enumerate(windows):
        steps.setdefault(step * 1_000_000, []).append((i, duration_seconds(window) * 1_000_000))
    out = None
    for step, sizes in steps.items():
        coarse = partials
        if step != bucket:
            own = (F.col(_B) - F.pmod(F.col(_B), F.lit(step))).alias(_B)
            coarse = _merged(partials, [*keys, own], fields, others)
        for i, size in sizes:
            first = F.col(_B) + step
            if size == step:
                part = coarse.withColumns({"__w": F.lit(i), "__end": first})
            else:
                ends = F.sequence(first, first + (size - step), F.lit(step))
                spread = coarse.withColumn("__w", F.lit(i)).withColumn("__end", F.explode(ends))
                part = _merged(spread, [*keys, "__w", "__end"], fields, others)
            part = part.select(*kept)
            out = part if out is None else out.unionByName(part)
    return out


def aggregate_every_event(
    df: DataFrame,
    keys: list[str],
    ts: str,
    aggregations: list[Aggregation],
    max_rows: int | None = MAX_ROWS,
) -> DataFrame:
    """One output row per input row with its trailing window aggregates.

    The window of an event at ``t`` starts at ``floor(t, period) + period - window`` and
    ends with the event itself: complete earlier buckets merged with the running part of
    the event's own bucket.
    """
    _check(df, keys, ts, aggregations)
    passes: dict[int, list[tuple[Aggregation, str]]] = {}
    for agg in aggregations:
        for window in agg.windows:
            passes.setdefault(agg.step(window), []).append((agg, window))
    for step, specs in passes.items():
        df = _every_event_pass(df, keys, ts, step * 1_000_000, specs, max_rows)
    return df


def _every_event_pass(df, keys, ts, step, specs, max_rows):
    columns = df.columns
    fields = _ops_by_column(specs)
    group = [*keys, _B]
    rank = _rank(df, ts)
    rows = df.withColumns({_B: epoch_bucket(ts, step), "__rank": rank, "__flag": F.lit(1)})
    rows, hot = with_slice(rows, group, ["__rank"], max_rows)
    windows = sorted({duration_seconds(w) * 1_000_000 for _, w in specs})
    seeds = _bucket_seeds(rows, group, step, windows, specs, fields)
    if hot is not None:
        seeds = _slice_seeds(hot, group, seeds, specs, fields)
    names = [f"__s_{c}_{size}" for c, size in _pairs(specs)]
    if seeds is not None:
        rows = rows.unionByName(
            seeds.select(*group, SLICE, *names, F.lit(0).alias("__flag")), allowMissingColumns=True
        )
    frame = (
        W.partitionBy(*group, SLICE)
        .orderBy("__flag", "__rank")
        .rowsBetween(W.unboundedPreceding, 0)
    )
    running = {
        f"__r_{c}": frame_partial(F.col(c), F.col("__rank"), f, frame) for c, f in fields.items()
    }
    if seeds is not None:
        running |= {n: F.first(n, ignorenulls=True).over(frame) for n in names}
    rows = rows.select(
        *columns, "__flag", *[c.alias(n) for n, c in running.items()]
    ).where(F.col("__flag") == 1)
    outputs = []
    for agg, window in specs:
        size = duration_seconds(window) * 1_000_000
        part = F.col(f"__r_{agg.column}")
        if seeds is not None:
            part = combine(F.col(f"__s_{agg.column}_{size}"), part, fields[agg.column])
        outputs += [finish(op, part).alias(agg.output(op, window)) for op in agg.operations]
    return rows.select(*columns, *outputs)


def _pairs(specs) -> list[tuple[str, int]]:
    """(column, window size) pairs, each once."""
    return list(
        dict.fromkeys((a.column, duration_seconds(w) * 1_000_000) for a, w in specs)
    )


def _bucket_seeds(rows, group, step, windows, specs, fields):
    """For every bucket with rows: merged partials of the earlier buckets of its windows.

    Buckets are laid out in blocks of time, each with a copy of the buckets its first
    windows still reach back to.  A block holds a bounded number of buckets, so a key with
    a long history is many small ordered groups, and buckets are not copied per window.
    """
    if windows[-1] <= step:
        return None
    partials = rows.groupBy(*group).agg(
        *[
            group_partial(F.col(c), F.col("__rank"), f).alias(f"__p_{c}")
            for c, f in fields.items()
        ]
    )
    reach, length = windows[-1] - step, BLOCK_WINDOWS * windows[-1]
    own = F.floor(F.col(_B) / length)
    last = F.floor((F.col(_B) + reach) / length)
    spread = partials.withColumn("__block", F.explode(F.sequence(own, last)))
    whole = W.partitionBy(*group[:-1], "__block")
    merged = {}
    for c, size in _pairs(specs):
        if size > step:
            earlier = whole.orderBy(_B).rangeBetween(step - size, -step)
            merged[f"__s_{c}_{size}"] = prefix_partial(F.col(f"__p_{c}"), fields[c], earlier, whole)
        else:
            merged[f"__s_{c}_{size}"] = F.when(F.lit(False), F.col(f"__p_{c}"))
    return (
        spread.select(*group, "__block", *[column.alias(n) for n, column in merged.items()])
        .where(F.col("__block") == own)
        .select(*group, F.lit(-1).cast("long").alias(SLICE), *merged)
    )


def _slice_seeds(hot, group, seeds, specs, fields):
    """Seeds of the slices of hot buckets: earlier buckets plus earlier slices."""
    whole = W.partitionBy(*group)
    before = whole.orderBy(SLICE).rowsBetween(W.unboundedPreceding, -1)
    totals = hot.groupBy(*group, SLICE).agg(
        *[
            group_partial(F.col(c), F.col("__rank"), f).alias(f"__p_{c}")
            for c, f in fields.items()
        ]
    )
    earlier = totals.select(
        *group,
        SLICE,
        *[
            prefix_partial(F.col(f"__p_{c}"), f, before, whole).alias(f"__q_{c}")
            for c, f in fields.items()
        ],
    )
    pairs = _pairs(specs)
    if seeds is None:
        return earlier.select(
            *group, SLICE, *[F.col(f"__q_{c}").alias(f"__s_{c}_{size}") for c, size in pairs]
        )
    cuts = earlier.select(
        *[F.col(g).alias(f"__g{i}") for i, g in enumerate(group)],
        F.col(SLICE).alias("__cut"),
        *[f"__q_{c}" for c in fields],
    )
    match = reduce(
        lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"__g{i}")) for i, g in enumerate(group)]
    )
    return seeds.join(cuts, match, "left").select(
        *group,
        F.coalesce("__cut", F.lit(-1)).cast("long").alias(SLICE),
        *[
            F.when(F.col("__cut").isNull(), F.col(f"__s_{c}_{size}"))
            .otherwise(combine(F.col(f"__s_{c}_{size}"), F.col(f"__q_{c}"), fields[c]))
            .alias(f"__s_{c}_{size}")
            for c, size in pairs
        ],
    )


def reduce_all(df: DataFrame, aggregates: list[Column]) -> DataFrame:
    """Reduce the whole flow to one row."""
    return df.agg(*aggregates)
