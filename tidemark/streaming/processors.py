"""Stateful processors: value, list and map state per key, timers, state that starts from a table.

They run on ``transformWithStateInPandas``, whose state lives in RocksDB: start their queries
inside ``state_store(spark)``.  A key is one task's work, as Spark's state API defines it; keys
are dealt into slots, and Python is called per slot with one state entry per key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..errors import SpecError
from ..functions.time import duration_seconds

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

MapFn = Callable[[tuple, pd.DataFrame, tuple], tuple[pd.DataFrame, tuple]]


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB; the session's own choice comes back after."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


# Rows reach a processor as named tuples, which rename columns that begin with a line.
_CODE, _SLOT = "tidemark_key", "tidemark_slot"

# Slots of keys: each is one call of a micro-batch, which holds the slot's new rows in memory.
SLOTS = 1024


def _coded(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` with one text per key: a null is a value like any other, and never splits a key's rows."""
    return df.withColumn(_CODE, F.to_json(F.struct(*[F.col(k).cast("string").alias(k) for k in keys])))


def _typed(value, kind: T.DataType):
    """A value of a pandas row as state of this type.

    A long column with nulls arrives as floats, which the state API would store as null.
    """
    if value is None or (not isinstance(value, (list, np.ndarray, dict)) and pd.isna(value)):
        return None
    if isinstance(kind, T.IntegralType):
        return int(value)
    if isinstance(value, pd.Timestamp):
        return value.to_pydatetime()
    return value.item() if isinstance(value, np.generic) else value


def _schema(fields: str | T.StructType) -> T.StructType:
    return T.StructType.fromDDL(fields) if isinstance(fields, str) else fields


class _Slotted(StatefulProcessor):
    """Keys that share a slot are handled together: one call per slot, one state entry per key.

    Spark calls a processor once per grouping key.  Were that the user's key, frames, Arrow
    batches and calls of a few rows each would cost more than the work.
    """

    def __init__(self, schema: T.StructType, order: list[str] | None):
        self._columns, self._order = schema.fieldNames(), order

    def _frames(self, rows: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, pd.DataFrame, np.ndarray]]:
        """(codes, rows sorted by key, where each code's rows begin and the last ones end).

        With an order, the slot's rows of the micro-batch are one frame in that order within a
        key; else frames come as they arrive.
        """
        for pdf in rows if self._order is None else [pd.concat(list(rows), ignore_index=True)]:
            if not len(pdf):
                continue
            if self._order is not None:
                pdf = pdf.sort_values(self._order, kind="stable")
            numbers, codes = pd.factorize(pdf[_CODE])
            place = np.argsort(numbers, kind="stable")
            ends = np.cumsum(np.bincount(numbers, minlength=len(codes)))
            yield np.asarray(codes), pdf[self._columns].iloc[place].reset_index(drop=True), np.append(0, ends)

    def close(self) -> None:
        pass


def _slotted(df: DataFrame, keys: list[str], slots: int) -> DataFrame:
    """``df`` with the coded key and the slot that the key falls into."""
    return _coded(df, keys).withColumn(_SLOT, F.pmod(F.xxhash64(_CODE), F.lit(slots)).cast("int"))


def _together(frames: list[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The frames put together, those of other types apart, so that no value changes its type."""
    for _, alike in groupby(frames, key=lambda f: (tuple(f.columns), tuple(f.dtypes))):
        yield pd.concat(list(alike), ignore_index=True)


class _Mapped(_Slotted):
    """A user function over a key's rows, with its state as one value."""

    def __init__(self, keys: list[str], columns: T.StructType, fn: MapFn, state: T.StructType, initial: tuple, order):
        super().__init__(columns, order)
        self._keys, self._fn = [columns[k] for k in keys], fn
        self._schema, self._initial = state, initial

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._state = handle.getMapState("state", T.StructType([T.StructField(_CODE, T.StringType())]), self._schema)

    def _update(self, code: str, values) -> None:
        self._state.updateValue((code,), tuple(_typed(v, f.dataType) for v, f in zip(values, self._schema.fields)))

    def handleInitialState(self, key, initialState, timerValues) -> None:
        codes = initialState[_CODE].tolist()
        for code, *values in zip(codes, *(initialState[n].array for n in self._schema.fieldNames())):
            self._update(code, values)

    def handleInputRows(self, key, rows, timerValues):
        current: dict[str, tuple] = {}
        some = self._state.exists()
        for codes, pdf, begins in self._frames(rows):
            names = list(zip(*([_typed(v, k.dataType) for v in pdf[k.name].iloc[begins[:-1]].array] for k in self._keys)))
            found = []
            for code, name, begin, end in zip(codes, names, begins[:-1], begins[1:]):
                if code not in current:
                    held = self._state.getValue((code,)) if some else None
                    current[code] = self._initial if held is None else held
                mine = pdf.iloc[begin:end].reset_index(drop=True)
                out, current[code] = self._fn(name, mine, current[code])
                found.append(out)
            yield from _together(found)
        for code, values in current.items():
            self._update(code, values)


def map_with_table(
    stream: DataFrame,
    keys: list[str],
    fn: MapFn,
    out_schema: T.StructType | str,
    state_schema: str,
    initial: tuple,
    seed: DataFrame | None = None,
    order: list[str] | None = None,
    slots: int = SLOTS,
) -> DataFrame:
    """``fn(key, rows, state) -> (output rows, new state)``; the state of a key starts from ``seed``.

    ``seed`` has the keys and the fields of ``state_schema``; it is read once, when the query
    first starts.  Of several rows of a key the greatest counts; a key without one starts from
    ``initial``; null keys match null keys.  With ``order`` the rows of a key in one
    micro-batch are sorted first and reach ``fn`` as one frame, otherwise they come batch by
    batch as they arrive.  The number of ``slots`` is fixed with the checkpoint.
    """
    state = _schema(state_schema)
    names, grouped = state.fieldNames(), None
    if seed is not None:
        missing = [n for n in [*keys, *names] if n not in seed.columns]
        if missing:
            raise SpecError(f"the seed table lacks {missing}")
        one = _slotted(seed, keys, slots).groupBy(_SLOT, _CODE).agg(F.max(F.struct(*names)).alias("__state"))
        grouped = one.select(_SLOT, _CODE, "__state.*").groupBy(_SLOT)
    processor = _Mapped(keys, stream.schema, fn, state, initial, order)
    return _slotted(stream, keys, slots).groupBy(_SLOT).transformWithStateInPandas(
        processor, out_schema, "Append", "None", initialState=grouped
    )


def _value_name(value):
    """A value as it is kept in state: what is not a text, number or truth value as its text."""
    return value if value is None or isinstance(value, (str, int, float)) else repr(value)


class _Counted(_Slotted):
    """How often a key has shown each value, as map state: one entry per key."""

    def __init__(self, schema: T.StructType, value: str, out: str, order: list[str] | None):
        super().__init__(schema, order)
        self._value, self._kind, self._out = value, schema[value].dataType, out

    def init(self, handle: StatefulProcessorHandle) -> None:
        plain = isinstance(self._kind, (T.StringType, T.IntegralType, T.BooleanType, T.FloatType, T.DoubleType))
        values = T.ArrayType(self._kind if plain else T.StringType())
        entry = T.StructType([T.StructField("values", values), T.StructField("counts", T.ArrayType(T.LongType()))])
        self._counts = handle.getMapState("counts", T.StructType([T.StructField(_CODE, T.StringType())]), entry)

    def handleInputRows(self, key, rows, timerValues):
        held: dict[str, dict] = {}
        some = self._counts.exists()
        for codes, pdf, begins in self._frames(rows):
            for code in codes:
                if code not in held:
                    entry = self._counts.getValue((code,)) if some else None
                    held[code] = {} if entry is None else dict(zip(*entry))
            owner = np.repeat(np.arange(len(codes)), np.diff(begins))
            numbers, values = pd.factorize(pdf[self._value], use_na_sentinel=False)
            pairs, place = np.unique(owner * len(values) + numbers, return_inverse=True)
            names = [_value_name(_typed(v, self._kind)) for v in values]
            counts = [(held[codes[p // len(values)]], names[p % len(values)]) for p in pairs.tolist()]
            base = np.array([seen.get(name, 0) for seen, name in counts], "int64")
            at = pd.Series(place).groupby(place).cumcount().to_numpy() + 1
            yield pdf.assign(**{self._out: base[place] + at})
            for (seen, name), n in zip(counts, (base + np.bincount(place, minlength=len(counts))).tolist()):
                seen[name] = n
        for code, seen in held.items():
            self._counts.updateValue((code,), (list(seen), list(seen.values())))


def count_values(
    stream: DataFrame, keys: list[str], value: str, out: str = "seen", order: list[str] | None = None, slots: int = SLOTS
) -> DataFrame:
    """Every row with how often its key has shown its ``value`` so far, itself included.

    The number of ``slots`` is fixed with the checkpoint.
    """
    schema = T.StructType([*stream.schema.fields, T.StructField(out, T.LongType())])
    processor = _Counted(stream.schema, value, out, order)
    return _slotted(stream, keys, slots).groupBy(_SLOT).transformWithStateInPandas(processor, schema, "Append", "None")


def cut_at(times: np.ndarray, n: int, span: int) -> tuple[list[int], int]:
    """(ends of the closed batches, start of the open one) of rows taken in order.

    A batch closes with its ``n``-th row, or before the first row that comes ``span`` or more
    after its first one.
    """
    ends, start = [], 0
    while start < len(times):
        over = np.flatnonzero(times[start : start + n] >= times[start] + span)
        end = start + (int(over[0]) if len(over) else n)
        if end > len(times) or (end == len(times) and not len(over) and end - start < n):
            break
        ends.append(end)
        start = end
    return ends, start


class _Batched(_Slotted):
    """Rows of a key's open batch as a list in its entry, a timer at the slot's earliest deadline."""

    def __init__(self, schema: T.StructType, ts: str, n: int, span: int, order: list[str]):
        super().__init__(schema, order)
        self._ts, self._n, self._span = ts, n, span
        self._times = [f.name for f in schema.fields if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType))]
        self._held = [T.StructField(f.name, T.LongType() if f.name in self._times else f.dataType) for f in schema.fields]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        rows = T.StructField("rows", T.ArrayType(T.StructType(self._held)))
        entry = T.StructType([T.StructField("batch", T.LongType()), rows])
        self._open = handle.getMapState("open", T.StructType([T.StructField(_CODE, T.StringType())]), entry)

    def _deadline(self, first: int) -> int:
        return (first + self._span + 999) // 1000

    def _out(self, pdf: pd.DataFrame, batches: list[int], closed: list[str]) -> pd.DataFrame:
        times = {c: pd.to_datetime(pdf[c], unit="us") for c in self._times}
        return pdf.assign(**times, batch=np.array(batches, "int64"), closed_by=closed)

    def _joined(self, codes: np.ndarray, pdf: pd.DataFrame, begins: np.ndarray) -> tuple[pd.DataFrame, np.ndarray, list[int]]:
        """(rows of the open batches and new ones by key, where each key's begin, batch numbers)."""
        for c in self._times:
            pdf[c] = pdf[c].astype("datetime64[us]").astype("int64")
        some = self._open.exists()
        entries = [(self._open.getValue((code,)) if some else None) or (0, []) for code in codes]
        sizes = [len(rows) for _, rows in entries]
        held = [tuple(r) for _, rows in entries for r in rows]
        if held:
            owner = np.concatenate([np.repeat(np.arange(len(codes)), sizes), np.repeat(np.arange(len(codes)), np.diff(begins))])
            both = pd.concat([pd.DataFrame(held, columns=self._columns), pdf], ignore_index=True)
            pdf = both.iloc[np.argsort(owner, kind="stable")].reset_index(drop=True)
        return pdf, begins + np.append(0, np.cumsum(sizes)), [number for number, _ in entries]

    def handleInputRows(self, key, rows, timerValues):
        mark = timerValues.getCurrentWatermarkInMs()
        for codes, new, begins in self._frames(rows):
            pdf, begins, numbers = self._joined(codes, new, begins)
            times, batches, closed = pdf[self._ts].to_numpy("int64"), [], []
            is_open, due = np.zeros(len(pdf), bool), []
            for i, (begin, end) in enumerate(zip(begins[:-1].tolist(), begins[1:].tolist())):
                ends, start = cut_at(times[begin:end], self._n, self._span)
                sizes = np.diff([0, *ends]).tolist()
                if begin + start < end:
                    deadline = self._deadline(int(times[begin + start]))
                    if deadline <= mark:
                        sizes.append(end - begin - start)
                    else:
                        is_open[begin + start : end] = True
                        due.append(deadline)
                batches += [numbers[i] + k for k, size in enumerate(sizes) for _ in range(size)]
                closed += ["count" if size == self._n else "time" for size in sizes for _ in range(size)]
                numbers[i] += len(sizes)
            if batches:
                yield self._out(pdf[~is_open], batches, closed)
            left = pdf[is_open]
            held = list(zip(*([_typed(v, f.dataType) for v in left[f.name].array] for f in self._held)))
            at = np.append(0, np.cumsum(is_open))[begins]
            for code, number, begin, end in zip(codes, numbers, at[:-1].tolist(), at[1:].tolist()):
                self._open.updateValue((code,), (number, held[begin:end]))
            self._wake(due)

    def _wake(self, due: list[int]) -> None:
        """The slot's timer stands at its earliest deadline, or before it."""
        if not due:
            return
        timers = list(self._handle.listTimers())
        if timers and min(timers) <= min(due):
            return
        for at in timers:
            self._handle.deleteTimer(at)
        self._handle.registerTimer(min(due))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        """Closes the slot's batches whose deadline the watermark has passed."""
        mark, due, ended = timerValues.getCurrentWatermarkInMs(), [], []
        at = self._columns.index(self._ts)
        for (code,), (number, rows) in list(self._open.iterator()):
            if not rows:
                continue
            deadline = self._deadline(rows[0][at])
            if deadline <= mark:
                ended.append((code, number, rows))
            else:
                due.append(deadline)
        if due:
            self._handle.registerTimer(min(due))
        if ended:
            held = pd.DataFrame([tuple(r) for _, _, rows in ended for r in rows], columns=self._columns)
            batches = [number for _, number, rows in ended for _ in rows]
            yield self._out(held, batches, ["time"] * len(held))
        for code, number, _ in ended:
            self._open.updateValue((code,), (number + 1, []))


def batch_rows(
    stream: DataFrame, keys: list[str], n: int, timeout: str, ts: str, lateness: str, tie: list[str] | None = None,
    slots: int = SLOTS,
) -> DataFrame:
    """Rows with the number of their batch, when it closes: at ``n`` rows of a key or after ``timeout``.

    Time is event time: a batch ends before the first row ``timeout`` or more after its first
    row, and a timer closes it once the watermark (``lateness`` behind the newest time) has
    passed that point, so a key that falls silent keeps nothing open.  ``closed_by`` is count
    or time.  Rows of one micro-batch are taken by time, then ``tie``.  The number of ``slots`` is
    fixed with the checkpoint.  The batch form is ``operators.cuts.batch_by_time``.
    """
    if n < 1:
        raise SpecError("n must be at least 1")
    span = int(duration_seconds(timeout) * 1_000_000)
    if span <= 0:
        raise SpecError("the timeout must be positive")
    schema = T.StructType([
        *stream.schema.fields, T.StructField("batch", T.LongType()), T.StructField("closed_by", T.StringType()),
    ])
    processor = _Batched(stream.schema, ts, n, span, [ts, *(tie or [])])
    marked = _slotted(stream, keys, slots).withWatermark(ts, f"{duration_seconds(lateness)} seconds")
    return marked.groupBy(_SLOT).transformWithStateInPandas(processor, schema, "Append", "EventTime")
