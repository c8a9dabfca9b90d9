"""Row filters: time ranges, (column, op, value) lists and predicates."""

from __future__ import annotations

import datetime as dt
import operator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import SpecError
from ..functions.time import parse_time_expr

_COMPARE = {
    "=": operator.eq,
    "==": operator.eq,
    "!=": operator.ne,
    ">": operator.gt,
    "<": operator.lt,
    ">=": operator.ge,
    "<=": operator.le,
}


def _bound(df: DataFrame, column: str, value, now) -> Column:
    """Literal of the column's own type, so the comparison reaches the file scan."""
    moment = parse_time_expr(value, now).astimezone(dt.timezone.utc).replace(tzinfo=None)
    if isinstance(df.schema[column].dataType, T.TimestampNTZType):
        return F.lit(moment.isoformat(sep=" ")).cast("timestamp_ntz")
    return F.lit(moment.isoformat(sep=" ") + "+00:00").cast("timestamp")


def time_range(
    df: DataFrame,
    column: str,
    start=None,
    end=None,
    now: dt.datetime | None = None,
    closed_start: bool = False,
) -> DataFrame:
    """Keep rows in ``(start, end]``, or ``[start, end]`` with ``closed_start``."""
    if column not in df.columns:
        raise SpecError(f"no column {column!r} to filter on")
    if start is not None:
        bound = _bound(df, column, start, now)
        df = df.where(F.col(column) >= bound if closed_start else F.col(column) > bound)
    if end is not None:
        df = df.where(F.col(column) <= _bound(df, column, end, now))
    return df


def partition_bounds(columns: list[str], start=None, end=None, now=None) -> Column | None:
    """Predicate on year/month/.. partition columns implied by a time range.

    Spark prunes partitions only on their own columns, so a reader of a time-partitioned
    table adds this next to the time filter.  Each level compares the tuple prefix.
    """
    units = [u for u in ("year", "month", "day", "hour", "minute", "second") if u in columns]
    if not units or units[0] != "year":
        return None

    def compare(moment, beyond) -> Column:
        parts = [getattr(moment, u) for u in units]
        whole = F.lit(True)
        for unit, part in reversed(list(zip(units, parts))):
            whole = beyond(F.col(unit), part) | ((F.col(unit) == part) & whole)
        return whole

    bounds = []
    if start is not None:
        moment = parse_time_expr(start, now).astimezone(dt.timezone.utc)
        bounds.append(compare(moment, operator.gt))
    if end is not None:
        moment = parse_time_expr(end, now).astimezone(dt.timezone.utc)
        bounds.append(compare(moment, operator.lt))
    return reduce(operator.and_, bounds) if bounds else None


def _missing(df: DataFrame, name: str) -> Column:
    if isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType)):
        return F.col(name).isNull() | F.isnan(name)
    return F.col(name).isNull()


def _condition(df: DataFrame, name: str, op: str, value) -> Column:
    if name not in df.columns:
        raise SpecError(f"no column {name!r} to filter on")
    if op in _COMPARE:
        return _COMPARE[op](F.col(name), F.lit(value))
    if op.lower() not in ("in", "not in") or not isinstance(value, (list, tuple, set)):
        raise SpecError(f"unsupported filter {(name, op, value)!r}")
    listed = [v for v in value if v is not None]
    has_none = len(listed) < len(value)
    found = F.col(name).isin(listed) if listed else F.lit(False)
    if op.lower() == "in":
        return found | _missing(df, name) if has_none else found
    return ~found & ~_missing(df, name) if has_none else ~found


def additional_filters(df: DataFrame, filters) -> DataFrame:
    """AND of ``(column, op, value)``; ``None`` inside a list stands for null or NaN."""
    for item in filters or []:
        if not item:
            continue
        if not isinstance(item, (tuple, list)) or len(item) != 3:
            raise SpecError(f"filter {item!r} must be (column, op, value)")
        df = df.where(_condition(df, *item))
    return df


def label_not_null(df: DataFrame, label: str) -> DataFrame:
    return df.na.drop(subset=[label])


def by_query(df: DataFrame, text: str) -> DataFrame:
    """Row predicate given as SQL text."""
    return df.where(text)
