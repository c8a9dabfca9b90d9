"""Per-key state across micro-batches: user maps, sampling, gathering, alerts.

A key's rows reach its function as an iterator of Arrow batches in arrival order, and the
state is a small tuple, so memory per key does not grow with its rows.
``late_per_batch`` handles keys by slots, as ``processors`` does.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..errors import SpecError
from ..functions.time import duration_seconds
from .processors import _CODE, _SLOT, SLOTS, _slotted

# Before any time, in microseconds.
NEVER = -(2**63)

MapFn = Callable[[tuple, pd.DataFrame, tuple], tuple[pd.DataFrame, tuple]]


def map_with_state(
    stream: DataFrame,
    keys: list[str],
    fn: MapFn,
    out_schema: T.StructType | str,
    state_schema: str,
    initial: tuple,
) -> DataFrame:
    """``fn(key, rows, state) -> (output rows, new state)`` with state kept per key.

    ``fn`` is called once per Arrow batch of a key's rows.
    """

    def call(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState):
        current = tuple(state.get) if state.exists else initial
        for pdf in batches:
            out, current = fn(key, pdf, current)
            yield out
        state.update(current)

    return stream.groupBy(*keys).applyInPandasWithState(
        call, out_schema, state_schema, "append", GroupStateTimeout.NoTimeout
    )


def sample_every(stream: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Keep the first of every ``n`` rows per key, in arrival order."""
    if n < 1:
        raise SpecError("n must be at least 1")

    def take(_key, pdf, state):
        seen = state[0]
        kept = pdf.iloc[(-seen) % n :: n]
        return kept, (seen + len(pdf),)

    return map_with_state(stream, keys, take, stream.schema, "seen long", (0,))


def merge_parts(
    stream: DataFrame, key: str, value: str, expected: int, ts: str, lateness: str
) -> DataFrame:
    """Emit a key's parts when ``expected`` of them arrived; incomplete keys expire.

    A key whose parts are still missing when the watermark passes its first part by
    ``lateness`` is dropped, like parts arriving after that.
    """
    value_type = stream.schema[value].dataType.simpleString()
    out = T.StructType(
        [stream.schema[key], T.StructField("parts", T.ArrayType(stream.schema[value].dataType))]
    )
    wait_ms = duration_seconds(lateness) * 1000

    def gather(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        parts, first = (list(state.get[0]), state.get[1]) if state.exists else ([], None)
        for pdf in batches:
            done = []
            for part, at in zip(pdf[value].tolist(), pdf[ts]):
                millis = int(at.timestamp() * 1000)
                first = millis if first is None else min(first, millis)
                parts.append(part)
                if len(parts) == expected:
                    done.append(parts)
                    parts, first = [], None
            if done:
                yield pd.DataFrame({key: [name[0]] * len(done), "parts": done})
        if parts:
            state.update((parts, first))
            state.setTimeoutTimestamp(max(first + wait_ms, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()

    return (
        stream.withWatermark(ts, f"{duration_seconds(lateness)} seconds")
        .groupBy(key)
        .applyInPandasWithState(
            gather,
            out,
            f"parts array<{value_type}>, first long",
            "append",
            GroupStateTimeout.EventTimeTimeout,
        )
    )


def fire_alerts(
    stream: DataFrame, keys: list[str], ts: str, count: int, period: str | None, reset: str = "auto"
) -> DataFrame:
    """Rows at which an alert fires, in arrival order.

    State per alert: the times of at most ``count`` recent events and whether it is active.
    """
    if reset not in ("auto", "manual"):
        raise SpecError("reset is 'auto' or 'manual'")
    span = duration_seconds(period) * 1_000_000_000 if period else None

    def watch(_key, pdf, state):
        times, active = list(state[0]), state[1]
        fired = []
        for at, now in enumerate(pdf[ts].astype("datetime64[ns]").astype("int64").tolist()):
            if active:
                break
            times = [t for t in times if span is None or t > now - span]
            times.append(now)
            if len(times) >= count:
                fired.append(at)
                times, active = [], reset == "manual"
        return pdf.iloc[fired], (times, active)

    return map_with_state(
        stream, keys, watch, stream.schema, "times array<long>, active boolean", ([], False)
    )


def count_late(stream: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """Per micro-batch and key: rows older than the newest time seen so far."""
    out = T.StructType([stream.schema[k] for k in keys] + [T.StructField("late", T.LongType())])

    def watch(key, pdf, state):
        times = pdf[ts].astype("datetime64[ns]").astype("int64")
        before = times.cummax().shift(1, fill_value=state[0]).clip(lower=state[0])
        late = int((times < before).sum())
        return pd.DataFrame([[*key, late]], columns=[*keys, "late"]), (max(state[0], int(times.max())),)

    return map_with_state(stream, keys, watch, out, "newest long", (-(2**62),))


def late_per_batch(stream: DataFrame, keys: list[str], ts: str, slots: int = SLOTS) -> DataFrame:
    """Per micro-batch and key: its rows, and those older than all earlier micro-batches brought.

    The order of rows inside a micro-batch does not count, so a rerun agrees.  Python is called
    per slot of keys, whose newest times are its state; the number of ``slots`` is fixed with the
    checkpoint.
    """

    def watch(_slot: tuple, batches: Iterator[pd.DataFrame], state: GroupState):
        known = dict(zip(*state.get)) if state.exists else {}
        place: dict[str, int] = {}
        before, n, late, newest = (np.empty(0, "int64") for _ in range(4))
        for pdf in batches:
            numbers, codes = pd.factorize(pdf[_CODE])
            new = [c for c in codes if c not in place]
            place.update(zip(new, range(len(place), len(place) + len(new))))
            start = np.array([known.get(c, NEVER) for c in new], "int64")
            none = np.zeros(len(new), "int64")
            before, newest = np.append(before, start), np.append(newest, start)
            n, late = np.append(n, none), np.append(late, none)
            at = np.array([place[c] for c in codes], "int64")[numbers]
            n += np.bincount(at, minlength=len(n))
            has = pdf["at"].notna().to_numpy()
            times, at = pdf["at"][has].astype("datetime64[us]").astype("int64").to_numpy(), at[has]
            late += np.bincount(at[times < before[at]], minlength=len(late))
            np.maximum.at(newest, at, times)
        known.update((c, t) for c, t in zip(place, newest.tolist()) if t != NEVER)
        state.update((list(known), list(known.values())))
        yield pd.DataFrame({_CODE: list(place), "n": n, "late": late})

    places = [f"k{i}" for i in range(len(keys))]
    by_place = stream.select(*(F.col(k).alias(p) for k, p in zip(keys, places)), F.col(ts).alias("at"))
    counted = (
        _slotted(by_place, places, slots).select(_SLOT, _CODE, "at").groupBy(_SLOT).applyInPandasWithState(
            watch, f"{_CODE} string, n long, late long", "codes array<string>, newest array<long>", "append",
            GroupStateTimeout.NoTimeout,
        )
    )
    texts = F.from_json(_CODE, T.StructType([T.StructField(p, T.StringType()) for p in places]))
    named = [texts[p].cast(stream.schema[k].dataType).alias(k) for k, p in zip(keys, places)]
    return counted.select(*named, "n", "late")


def enrich(stream: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """Stream-static join: table columns for every event, null when unknown."""
    return stream.join(table, keys, "left")


def late_windows(stream: DataFrame, keys: list[str], ts: str, window: str, slide: str | None, lateness: str, value: str) -> DataFrame:
    """Tumbling or sliding counts and sums with late rows up to ``lateness``."""
    span = F.window(ts, f"{duration_seconds(window)} seconds", f"{duration_seconds(slide or window)} seconds")
    return (
        stream.withWatermark(ts, f"{duration_seconds(lateness)} seconds")
        .groupBy(*keys, span.alias("w"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
        .select(*keys, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n", "total")
    )
