"""Batches cut greedily by count or elapsed time, also within one hot key.

Where a batch starts depends on where all earlier ones did.  A key's rows are cut into chunks;
each chunk is summarized as a map from "first start in the chunk" to "last start in it", the
summaries are walked in order per key, and then every chunk is cut on its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import SpecError
from ..functions.time import duration_seconds
from .ordered import MAX_ROWS, row_positions

CHUNK = 100_000
_POS, _CHUNK, _KEY, _AT = "__pos", "__chunk", "__code", "__micros"


def next_starts(times: np.ndarray, n: int, span: int) -> np.ndarray:
    """For a batch that starts at a row: the row that starts the next one (``len`` or more: beyond)."""
    places = np.arange(len(times))
    by_time = np.searchsorted(times, times + span)
    # A time cut that falls on the end is only known by the rows that follow.
    by_time = np.where(by_time == len(times), len(times) + n, by_time)
    return np.minimum(places + n, by_time)


def summarize(times: np.ndarray, n: int, span: int) -> tuple[np.ndarray, np.ndarray]:
    """(last start, starts) when the first start of a chunk is row 0, 1, ... below ``n``."""
    size = len(times)
    after = next_starts(times, n, span)
    last, count = np.arange(size), np.ones(size, "int64")
    # From the back: a row that leads beyond is a last start, others inherit from the next.
    for i in range(size - 1, -1, -1):
        if after[i] < size:
            last[i], count[i] = last[after[i]], count[after[i]] + 1
    return last[:n], count[:n]


def _first_start(times: np.ndarray, n: int, span: int, held: int, since: int) -> int:
    """Where the open batch (``held`` rows, begun at ``since``) ends in a chunk."""
    if not held:
        return 0
    return min(n - held, int(np.searchsorted(times, since + span)))


def batch_by_time(
    df: DataFrame,
    keys: list[str],
    ts: str,
    n: int,
    timeout: str,
    tie: list[str] | None = None,
    out: str = "batch",
    chunk: int = CHUNK,
    max_rows: int | None = MAX_ROWS,
) -> DataFrame:
    """Adds the number of each row's batch within its key, from 0.

    Rows are taken by time, then ``tie``.  A batch ends with its ``n``-th row (count), before
    the first row that comes ``timeout`` or more after its first one (time), or with the data
    (open).  Rows without a time belong to no batch and go; null keys are a key like any other.
    """
    if n < 1:
        raise SpecError("n must be at least 1")
    span = int(duration_seconds(timeout) * 1_000_000)
    if span <= 0:
        raise SpecError("the timeout must be positive")
    order = [ts, *(tie or [])]
    timed = df.where(F.col(ts).isNotNull())
    placed = row_positions(timed, keys, order, _POS, max_rows)
    code = F.to_json(F.struct(*keys)) if keys else F.lit("")
    placed = placed.withColumns({
        _KEY: code, _AT: F.unix_micros(F.col(ts).cast("timestamp")), _CHUNK: F.floor((F.col(_POS) - 1) / chunk).cast("long"),
    })
    # Keys of one chunk start free; only longer ones are summarized.
    longer = placed.where(F.col(_CHUNK) > 0).select(_KEY).distinct()
    narrow = placed.select(_KEY, _CHUNK, _POS, _AT).join(longer, _KEY, "left_semi")

    def summary(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        times = pdf.sort_values(_POS)[_AT].to_numpy("int64")
        last, count = summarize(times, n, span)
        return pd.DataFrame({
            _KEY: [key[0]], _CHUNK: [key[1]], "rows": [len(times)], "head": [times[:n]], "at": [times[last]],
            "last": [last], "starts": [count],
        })

    fields = f"{_KEY} string, {_CHUNK} long, rows long, head array<long>, at array<long>, last array<long>, starts array<long>"
    summaries = narrow.groupBy(_KEY, _CHUNK).applyInPandas(summary, fields)

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Only the open batch of the current key is held."""
        current, held, since, number = None, 0, 0, 0
        for pdf in batches:
            entries = []
            for row in pdf.itertuples(index=False, name=None):
                key, no, rows, head, at, last, starts = row
                if key != current:
                    current, held, since, number = key, 0, 0, -1
                entries.append((key, no, held, since, number))
                first = _first_start(np.asarray(head, "int64"), n, span, held, since)
                if first >= rows:
                    held += rows
                else:
                    held, since, number = int(rows - last[first]), int(at[first]), number + int(starts[first])
            yield pd.DataFrame(entries, columns=[_KEY, _CHUNK, "__held", "__since", "__number"])

    entry = f"{_KEY} string, {_CHUNK} long, __held long, __since long, __number long"
    chained = summaries.repartition(_KEY).sortWithinPartitions(_KEY, _CHUNK).mapInPandas(walk, entry)

    def cut(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Goes on over Arrow batches; the first row of a chunk brings its entry state."""
        current, held, since, number = None, 0, 0, -1
        for pdf in pdfs:
            if not len(pdf):
                continue
            marks = pdf[[_KEY, _CHUNK]]
            fresh = (marks != marks.shift()).any(axis=1).to_numpy()
            fresh[0] = True
            bounds = [*np.flatnonzero(fresh), len(pdf)]
            times, found = pdf[_AT].to_numpy("int64"), np.empty(len(pdf), "int64")
            for begin, end in zip(bounds, bounds[1:]):
                name = tuple(marks.iloc[begin])
                if name != current:
                    current = name
                    held, since, number = (int(pdf[c].iloc[begin]) for c in ("__held", "__since", "__number"))
                part = times[begin:end]
                after = next_starts(part, n, span)
                at = _first_start(part, n, span, held, since)
                found[begin : begin + min(at, len(part))] = number
                if at >= len(part):
                    held += len(part)
                    continue
                while at < len(part):
                    number += 1
                    stop = min(int(after[at]), len(part))
                    found[begin + at : begin + stop] = number
                    held, since, at = stop - at, int(part[at]), int(after[at])
            yield pdf.assign(**{out: found}).drop(columns=[_KEY, _CHUNK, _POS, _AT, "__held", "__since", "__number"])

    entered = placed.join(chained, [_KEY, _CHUNK], "left").fillna({"__held": 0, "__since": 0, "__number": -1})
    numbered = (
        entered.select(*df.columns, _KEY, _CHUNK, _POS, _AT, "__held", "__since", "__number")
        .repartition(_KEY, _CHUNK)
        .sortWithinPartitions(_KEY, _CHUNK, _POS)
        .mapInPandas(cut, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + f", `{out}` long")
    )
    return numbered


def closed_batches(
    batched: DataFrame, keys: list[str], ts: str, n: int, aggs: list, batch: str = "batch"
) -> DataFrame:
    """One row per batch: ``aggs``, its rows ``n``, first and last time, and what closed it.

    The newest batch of a key is open unless it is full.
    """
    per_batch = batched.groupBy(*keys, batch).agg(
        F.count(F.lit(1)).alias("n"), F.min(ts).alias("first_time"), F.max(ts).alias("last_time"), *aggs
    )
    newest = per_batch.groupBy(*keys).agg(F.max(batch).alias("__newest"))
    same = [per_batch[k].eqNullSafe(newest[k]) for k in keys]
    joined = per_batch.join(newest, same).select(per_batch["*"], "__newest") if keys else per_batch.crossJoin(newest)
    reason = F.when(F.col("n") == n, "count").when(F.col(batch) < F.col("__newest"), "time").otherwise("open")
    return joined.withColumn("closed_by", reason).drop("__newest")
