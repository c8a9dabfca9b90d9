"""Mergeable partial aggregates behind every time-window operator.

A partial is a struct with only the fields the requested operations need.  Variance is
kept as (count, mean, sum of squared deviations) and merged without subtracting large
sums from each other.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_FIELDS = {
    "count": ("n",),
    "sum": ("s",),
    "sqr": ("q",),
    "min": ("lo",),
    "max": ("hi",),
    "first": ("f",),
    "last": ("l",),
    "avg": ("n", "s"),
    "stdvar": ("n", "mean", "m2"),
    "stddev": ("n", "mean", "m2"),
}


def fields_for(ops) -> list[str]:
    wanted = {f for op in ops for f in _FIELDS[op]}
    return [f for f in ("n", "s", "q", "lo", "hi", "f", "l", "mean", "m2") if f in wanted]


def _struct(parts: dict[str, Column]) -> Column:
    return F.struct(*[c.alias(f) for f, c in parts.items()])


def _raw(value: Column, rank: Column, fields, agg) -> dict[str, Column]:
    """Field expressions over raw rows; ``agg`` wraps them for a group or a frame."""
    stamped = F.struct(rank.alias("o"), value.alias("v"))
    real = F.when(rank.isNotNull(), stamped)
    table = {
        "n": lambda: agg(F.count(value)),
        "s": lambda: agg(F.sum(value)),
        "q": lambda: agg(F.sum(value * value)),
        "lo": lambda: agg(F.min(value)),
        "hi": lambda: agg(F.max(value)),
        "f": lambda: agg(F.min_by(real, rank)),
        "l": lambda: agg(F.max_by(real, rank)),
        "mean": lambda: agg(F.avg(value)),
        "m2": lambda: agg(F.var_pop(value)) * agg(F.count(value)),
    }
    return {f: table[f]() for f in fields}


def group_partial(value: Column, rank: Column, fields) -> Column:
    """Partial of a group of rows; ``rank`` orders them in time."""
    return _struct(_raw(value, rank, fields, lambda c: c))


def frame_partial(value: Column, rank: Column, fields, window) -> Column:
    """Partial of the rows of a growing, ordered frame; rows with null ``rank`` are ignored."""
    stamped = F.when(rank.isNotNull(), F.struct(rank.alias("o"), value.alias("v")))
    parts = _raw(value, rank, [f for f in fields if f not in "fl"], lambda c: c.over(window))
    for f, pick in (("f", F.first), ("l", F.last)):
        if f in fields:
            parts[f] = pick(stamped, ignorenulls=True).over(window)
    return _struct({f: parts[f] for f in fields})


def _merge_moments(moments: Column) -> Column:
    """Fold an array of (n, mean, m2) structs pairwise."""

    def step(acc: Column, x: Column) -> Column:
        n = acc["n"] + x["n"]
        delta = x["mean"] - acc["mean"]
        return F.when(x["n"] == 0, acc).when(acc["n"] == 0, x).otherwise(
            F.struct(
                n.alias("n"),
                (acc["mean"] + delta * x["n"] / n).alias("mean"),
                (acc["m2"] + x["m2"] + delta * delta * acc["n"] * x["n"] / n).alias("m2"),
            )
        )

    zero = F.struct(
        F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2")
    )
    return F.aggregate(moments, zero, step)


def merge_aggs(p: Column, fields, name: str) -> tuple[list[Column], Column]:
    """(aggregate columns, struct built from them) merging the partials ``p`` of a group.

    The list of moments holds one entry per partial: at most window / period.
    """
    table = {
        "n": lambda: F.sum(p["n"]),
        "s": lambda: F.sum(p["s"]),
        "q": lambda: F.sum(p["q"]),
        "lo": lambda: F.min(p["lo"]),
        "hi": lambda: F.max(p["hi"]),
        "f": lambda: F.min_by(p["f"], p["f"]["o"]),
        "l": lambda: F.max_by(p["l"], p["l"]["o"]),
    }
    plain = [f for f in fields if f in table]
    aggs = [table[f]().alias(f"{name}__{f}") for f in plain]
    built = {f: F.col(f"{name}__{f}") for f in plain}
    if "m2" in fields:
        kept = F.when(p["n"] > 0, F.struct(p["n"].alias("n"), p["mean"].alias("mean"), p["m2"].alias("m2")))
        aggs.append(F.collect_list(kept).alias(f"{name}__w"))
        folded = _merge_moments(F.col(f"{name}__w"))
        built["mean"], built["m2"] = folded["mean"], folded["m2"]
    if "n" in built:
        built["n"] = F.coalesce(built["n"], F.lit(0))
    return aggs, _struct({f: built[f] for f in fields})


def combine(a: Column, b: Column, fields) -> Column:
    """Partial of two disjoint row sets, ``a`` earlier than ``b``; either may be null."""

    def either(f, both):
        return F.coalesce(both, a[f], b[f])

    parts = {}
    for f in fields:
        if f in ("n", "s", "q"):
            parts[f] = either(f, a[f] + b[f])
        elif f == "lo":
            parts[f] = F.least(a[f], b[f])
        elif f == "hi":
            parts[f] = F.greatest(a[f], b[f])
        elif f == "f":
            parts[f] = F.coalesce(a[f], b[f])
        elif f == "l":
            parts[f] = F.coalesce(b[f], a[f])
    if "m2" in fields:
        total = a["n"] + b["n"]
        delta = b["mean"] - a["mean"]
        only_b = a["n"].isNull() | (a["n"] == 0)
        only_a = b["n"].isNull() | (b["n"] == 0)
        parts["mean"] = (
            F.when(only_b, b["mean"])
            .when(only_a, a["mean"])
            .otherwise(a["mean"] + delta * b["n"] / total)
        )
        parts["m2"] = (
            F.when(only_b, b["m2"])
            .when(only_a, a["m2"])
            .otherwise(a["m2"] + b["m2"] + delta * delta * a["n"] * b["n"] / total)
        )
    return _struct({f: parts[f] for f in fields})


def prefix_partial(p: Column, fields, before, whole) -> Column:
    """Merge of the partials in frame ``before``; ``whole`` spans the group.

    Squared deviations are taken around the mean of the whole group.
    """
    parts = {}
    for f in fields:
        if f in ("n", "s", "q"):
            parts[f] = F.sum(p[f]).over(before)
        elif f == "lo":
            parts[f] = F.min(p[f]).over(before)
        elif f == "hi":
            parts[f] = F.max(p[f]).over(before)
        elif f == "f":
            parts[f] = F.first(p[f], ignorenulls=True).over(before)
        elif f == "l":
            parts[f] = F.last(p[f], ignorenulls=True).over(before)
    if "m2" in fields:
        n = F.sum(p["n"]).over(before)
        center = F.sum(p["mean"] * p["n"]).over(whole) / F.nullif(
            F.sum(p["n"]).over(whole), F.lit(0)
        )
        shift = p["mean"] - center
        first = F.sum(p["n"] * shift).over(before)
        second = F.sum(p["m2"] + p["n"] * shift * shift).over(before)
        safe = F.nullif(n, F.lit(0))
        parts["mean"] = center + first / safe
        parts["m2"] = F.greatest(second - first * first / safe, F.lit(0.0))
    return _struct({f: parts[f] for f in fields})


def finish(op: str, p: Column) -> Column:
    """Final value of an operation from a partial; empty input gives null (count: 0)."""
    if op == "count":
        return F.coalesce(p["n"], F.lit(0))
    if op in ("sum", "sqr", "min", "max"):
        return p[{"sum": "s", "sqr": "q", "min": "lo", "max": "hi"}[op]]
    if op in ("first", "last"):
        return p["f" if op == "first" else "l"]["v"]
    if op == "avg":
        return F.when(p["n"] > 0, p["s"] / p["n"])
    variance = F.when(p["n"] > 1, p["m2"] / (p["n"] - 1))
    return variance if op == "stdvar" else F.sqrt(variance)
