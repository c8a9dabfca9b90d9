"""Alerts: fire when enough matching events fall into a trailing period.

Every event gets its position within its alert (a distributed count).  An event completes
a window when the event ``count - 1`` positions earlier is younger than the period.
Positions are cut into chunks of bounded size, so a hot alert spreads over tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import SpecError
from ..functions.time import duration_micros
from ..session import cut
from .ordered import MAX_ROWS, row_positions

# Positions of one alert a task walks through when alerts reset themselves.
CHUNK = 1_000_000

_POS = "__pos"


def match_alerts(events: DataFrame, alerts: DataFrame) -> DataFrame:
    """Events per alert: same event kind, entity listed or ``*``.

    ``alerts``: alert, event_kind, entities (array).  Listed entities are looked up by an
    equi join on (kind, entity); only alerts for every entity join on the kind alone.
    """
    every = F.array_contains("entities", "*")
    general = alerts.where(every).select("alert", F.col("event_kind").alias("__kind")).distinct()
    listed = (
        alerts.where(~every)
        .select("alert", F.col("event_kind").alias("__kind"), F.explode("entities").alias("__entity"))
        .distinct()
    )
    by_kind = F.col("event_kind") == F.col("__kind")
    named = events.join(listed, by_kind & (F.col("entity") == F.col("__entity"))).drop("__entity")
    return named.unionByName(events.join(general, by_kind)).drop("__kind")


def completed_windows(
    events: DataFrame, keys: list[str], ts: str, tie: str, count: int, period: str | None,
    max_rows: int | None = MAX_ROWS, chunk: int = CHUNK,
) -> DataFrame:
    """Events that complete ``count`` events within ``(t - period, t]``, with their position."""
    if count < 1:
        raise SpecError("an alert needs a count of at least 1")
    placed = row_positions(events, keys, [ts, tie], _POS, max_rows)
    if count == 1:
        return placed
    if period is None:
        return placed.where(F.col(_POS) >= count)
    chunk = max(chunk, count)
    # The last count - 1 rows of a chunk are repeated in the next one, so that looking back
    # never leaves it.
    own = F.floor((F.col(_POS) - 1) / chunk)
    reach = F.floor((F.col(_POS) + (count - 2)) / chunk)
    spread = placed.withColumn("__chunk", F.explode(F.sequence(own, reach)))
    inside = W.partitionBy(*keys, "__chunk").orderBy(_POS)
    then = F.lag(ts, count - 1).over(inside)
    young = F.unix_micros(ts) - F.unix_micros("__then") < duration_micros(period)
    return spread.withColumn("__then", then).where((F.col("__chunk") == own) & young).drop("__then", "__chunk")


def fire(
    events: DataFrame, keys: list[str], ts: str, tie: str, count: int = 1, period: str | None = None,
    reset: str | None = None, max_rows: int | None = MAX_ROWS, chunk: int = CHUNK,
) -> DataFrame:
    """Events at which an alert fires.

    ``reset=None`` reports every completed window, ``"manual"`` only the first one (the
    alert stays active), ``"auto"`` clears the window at each firing.
    """
    done = completed_windows(events, keys, ts, tie, count, period, max_rows, chunk)
    if reset is None:
        return done.drop(_POS)
    if reset == "manual":
        first = F.min(F.struct(_POS, *[c for c in done.columns if c != _POS and c not in keys]))
        rest = [c for c in events.columns if c not in keys]
        return (
            done.groupBy(*keys).agg(first.alias("__f"))
            .select(*[F.col(c) if c in keys else F.col(f"__f.{c}").alias(c) for c in [*keys, *rest]])
            .select(*events.columns)
        )
    if reset != "auto":
        raise SpecError("reset is None, 'manual' or 'auto'")
    if count == 1:
        return done.drop(_POS)
    chunk = max(chunk, count)
    # The walk reads the candidates several times, so they are written once.
    return _auto_reset(cut(done, "alert-candidates"), keys, count, chunk).select(*events.columns)


def _walk(positions: np.ndarray, allowed: int, count: int) -> Iterator[int]:
    """Indexes that fire when positions from ``allowed`` on may fire."""
    at = int(np.searchsorted(positions, allowed))
    while at < len(positions):
        yield at
        at = int(np.searchsorted(positions, positions[at] + count))


def _auto_reset(done: DataFrame, keys: list[str], count: int, chunk: int) -> DataFrame:
    """After firing at position p the alert may fire again from p + count on.

    Positions are cut into chunks.  An alert within one chunk starts free.  For longer
    ones each chunk is summarized as "allowed offset in -> allowed offset
    out" (``count`` entries) and the summaries are chained per alert, so every chunk knows
    its start.  The final walk streams over sorted partitions, one batch at a time.
    """
    # One text per alert: null keys are a key like any other, in joins and in pandas.
    code = F.to_json(F.struct(*keys))
    placed = done.withColumn("__chunk", F.floor((F.col(_POS) - 1) / chunk).cast("long")).withColumn("__alert", code)
    long_ones = placed.where(F.col("__chunk") > 0).select("__alert").distinct()
    group = ["__alert", "__chunk"]

    def summarize(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        positions = np.sort(pdf[_POS].to_numpy())
        start, end = key[-1] * chunk + 1, (key[-1] + 1) * chunk + 1
        out = []
        for offset in range(count):
            allowed = start + offset
            for at in _walk(positions, start + offset, count):
                allowed = int(positions[at]) + count
            out.append(max(allowed - end, 0))
        return pd.DataFrame([[*key, out]], columns=[*group, "out"])

    summary_schema = T.StructType(
        [T.StructField("__alert", T.StringType()), T.StructField("__chunk", T.LongType()), T.StructField("out", T.ArrayType(T.LongType()))]
    )
    summaries = (
        placed.join(long_ones, "__alert", "left_semi")
        .select(*group, _POS)
        .groupBy(*group)
        .applyInPandas(summarize, summary_schema)
    )

    def chain(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        entries, allowed, previous = [], 0, None
        for number, out in pdf.sort_values("__chunk")[["__chunk", "out"]].itertuples(index=False):
            if previous is None or number != previous + 1:
                allowed = 0
            entries.append(allowed)
            allowed = int(out[allowed])
            previous = number
        result = pdf[group].sort_values("__chunk").copy()
        result["__from"] = entries
        return result

    entry_schema = T.StructType(
        [T.StructField("__alert", T.StringType()), T.StructField("__chunk", T.LongType()), T.StructField("__from", T.LongType())]
    )
    entries = summaries.groupBy("__alert").applyInPandas(chain, entry_schema)

    def select(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, allowed = None, 0
        for pdf in batches:
            if not len(pdf):
                continue
            marks = pdf[group]
            fresh = (marks != marks.shift()).any(axis=1).to_numpy()
            fresh[0] = True
            bounds = [*np.flatnonzero(fresh), len(pdf)]
            positions = pdf[_POS].to_numpy()
            starts = pdf["__from"].to_numpy()
            taken = []
            for begin, end in zip(bounds, bounds[1:]):
                name = tuple(marks.iloc[begin])
                if name != current:
                    current, allowed = name, name[-1] * chunk + 1 + starts[begin]
                part = positions[begin:end]
                for at in _walk(part, allowed, count):
                    taken.append(begin + at)
                    allowed = part[at] + count
            yield pdf.iloc[taken].drop(columns=["__from", *group])

    out_schema = done.schema
    return (
        placed.join(entries, group, "left")
        .withColumn("__from", F.coalesce("__from", F.lit(0)))
        .repartition(*group)
        .sortWithinPartitions(*group, _POS)
        .mapInPandas(select, out_schema)
    )
