"""Ingest a source into a feature set's targets."""

from __future__ import annotations

import datetime as dt
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import SpecError
from ..functions.names import normalize_columns
from ..operators.filters import time_range
from ..operators.stats import describe_numeric, infer_schema, sample_by_hash
from ..session import cut
from ..sinks import files, tables
from ..sources.files import read_parquet
from ..specs import FeatureSet

_APPENDABLE = {"parquet", "latest", "series"}


@dataclass(frozen=True)
class Target:
    """Where and how to write: kind is parquet, csv, latest or series."""

    name: str
    kind: str
    path: str
    unit: str | None = None
    columns: tuple[str, ...] = ()
    key_buckets: int | None = None
    single_file: bool = False


@dataclass
class IngestStatus:
    run_id: str
    paths: dict[str, str] = field(default_factory=dict)
    last_written: dict[str, dt.datetime] = field(default_factory=dict)
    schema: list[dict] = field(default_factory=list)
    stats: DataFrame | None = None
    skipped: bool = False


def check_targets(targets: list[Target]) -> None:
    """Names and paths must differ; kinds must be known; single files cannot be partitioned."""
    if not targets:
        raise SpecError("no target given")
    for attr in ("name", "path"):
        values = [getattr(t, attr) for t in targets]
        twice = sorted({v for v in values if values.count(v) > 1})
        if twice:
            raise SpecError(f"target {attr} used twice: {twice}")
    for t in targets:
        if t.kind not in ("parquet", "csv", "latest", "series"):
            raise SpecError(f"unknown target kind {t.kind!r}")
        if t.single_file and (t.unit or t.columns or t.key_buckets is not None):
            raise SpecError(f"target {t.name!r} is a single file and cannot be partitioned")
        if t.path.endswith((".parquet", ".csv")) and not t.single_file:
            raise SpecError(f"target {t.name!r} must be a folder")


def check_append(targets: list[Target]) -> None:
    refused = [t.name for t in targets if t.single_file or t.kind not in _APPENDABLE]
    if refused:
        raise SpecError(f"targets {refused} do not support append")


def _write(df: DataFrame, feature_set: FeatureSet, target: Target, path: str, mode: str) -> None:
    keys, ts = list(feature_set.entities), feature_set.timestamp_key
    if target.kind == "parquet":
        files.write_parquet(
            df, path, mode, ts=ts, unit=target.unit, columns=list(target.columns), keys=keys,
            key_buckets=target.key_buckets,
        )
    elif target.kind == "csv":
        files.write_csv(df, path, mode)
    elif target.kind == "latest":
        _write_latest(df, keys, ts, path, mode)
    else:
        labels = keys
        values = [c for c in df.columns if c not in labels and c != ts]
        rows = tables.series_rows(df, ts, labels, values)
        files.write_parquet(rows, path, mode, columns=["date"])


def _write_latest(df: DataFrame, keys: list[str], ts: str, path: str, mode: str) -> None:
    """Each append writes a new complete version; the one before it is kept for its readers."""
    if mode == "append" and (version := latest_version(df.sparkSession, path)) is not None:
        old = read_parquet(df.sparkSession, f"{path}/v={version}")
        merged = tables.merge_latest(old, df, keys, ts)
        merged.write.parquet(f"{path}/v={version + 1}")
        drop_versions(df.sparkSession, path, version)
    else:
        tables.merge_latest(None, df, keys, ts).write.mode("overwrite").parquet(f"{path}/v=0")


def _folder(spark, path: str):
    """(file system, Hadoop path class, path) of a folder."""
    kind = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    folder = kind(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), kind, folder


def _versions(spark, path: str) -> list[int]:
    fs, kind, folder = _folder(spark, path)
    if not fs.exists(folder):
        return []
    return [
        int(s.getPath().getName()[2:])
        for s in fs.listStatus(folder)
        if s.getPath().getName().startswith("v=") and fs.exists(kind(s.getPath(), "_SUCCESS"))
    ]


def latest_version(spark, path: str) -> int | None:
    """Newest finished version folder of a latest table."""
    return max(_versions(spark, path), default=None)


def drop_versions(spark, path: str, below: int) -> None:
    """Remove the finished versions of a table that are older than ``below``."""
    fs, kind, folder = _folder(spark, path)
    for version in _versions(spark, path):
        if version < below:
            fs.delete(kind(folder, f"v={version}"), True)


def purge_run(spark, target: Target, run_id: str) -> None:
    """Remove what an earlier run wrote to a target."""
    fs, _, folder = _folder(spark, f"{target.path}/{run_id}")
    if fs.exists(folder):
        fs.delete(folder, True)


def read_latest(spark, path: str) -> DataFrame:
    version = latest_version(spark, path)
    if version is None:
        raise SpecError(f"no latest table at {path}")
    return read_parquet(spark, f"{path}/v={version}")


def ingest(
    feature_set: FeatureSet,
    source: DataFrame,
    targets: list[Target],
    previous: IngestStatus | None = None,
    overwrite: bool = True,
    start=None,
    end=None,
    with_stats: bool = False,
    now=None,
) -> IngestStatus:
    """Transform a source and write every target.

    Overwriting starts a new run folder and, once it is written, removes that of the
    ``previous`` run; appending keeps the run and skips an empty frame.
    The first Parquet target is written once and the other targets read it back, so the
    source and the steps run a single time.
    """
    check_targets(targets)
    if not overwrite:
        check_append(targets)
    spark, ts = source.sparkSession, feature_set.timestamp_key
    if start is not None or end is not None:
        source = time_range(source, ts, start, end, now)
    df = normalize_columns(feature_set.transform(source))
    feature_set.check_special_columns(df.columns)
    run_id = uuid.uuid4().hex if overwrite or previous is None else previous.run_id
    status = IngestStatus(run_id, schema=infer_schema(df, list(feature_set.entities), ts))
    if not overwrite:
        # The increment feeds several writes: run the source and the steps once.
        df = cut(df, "increment")
    if not overwrite and df.isEmpty():
        status.skipped = True
        status.paths = dict(previous.paths) if previous else {}
        status.last_written = dict(previous.last_written) if previous else {}
        return status
    mode = "overwrite" if overwrite else "append"
    ordered = sorted(targets, key=lambda t: t.kind != "parquet")
    stage = df
    for target in ordered:
        path = f"{target.path}/{run_id}"
        _write(stage, feature_set, target, path, mode)
        status.paths[target.name] = path
        if target.kind == "parquet" and overwrite and stage is df:
            stage = read_parquet(spark, path, columns=df.columns)
    if ts:
        newest = stage.agg(F.max(ts)).first()[0]
        before = (previous.last_written if previous and not overwrite else {}) or {}
        for target in targets:
            marks = [m for m in (newest, before.get(target.name)) if m is not None]
            if marks:
                status.last_written[target.name] = max(marks)
    if with_stats:
        status.stats = describe_numeric(stage)
    if overwrite and previous is not None:
        for target in targets:
            purge_run(spark, target, previous.run_id)
    return status


def preview_ingest(
    feature_set: FeatureSet, source: DataFrame, rows: int = 1000, start=None, end=None, with_stats: bool = False,
    sample: float | None = None, now=None,
) -> tuple[DataFrame, IngestStatus]:
    """What an ingest would write, without writing: (transformed rows, schema and statistics).

    Only the first ``rows`` of the source are transformed, unless statistics are wanted, which
    need all of them; ``sample`` transforms a share of the rows instead, chosen by entity hash.
    """
    ts = feature_set.timestamp_key
    if start is not None or end is not None:
        source = time_range(source, ts, start, end, now)
    if sample is not None:
        source = sample_by_hash(source, list(feature_set.entities), sample)
    elif not with_stats:
        source = source.limit(rows)
    df = normalize_columns(feature_set.transform(source))
    feature_set.check_special_columns(df.columns)
    status = IngestStatus("preview", schema=infer_schema(df, list(feature_set.entities), ts))
    if with_stats:
        status.stats = describe_numeric(df)
    return df, status


def ingest_increment(
    feature_set: FeatureSet,
    source: DataFrame,
    targets: list[Target],
    previous: IngestStatus,
    now: dt.datetime,
) -> IngestStatus:
    """Scheduled run: read ``(oldest mark of the targets, now]`` and append it."""
    marks = [previous.last_written.get(t.name) for t in targets]
    start = None if None in marks else min(marks)
    if start is not None and start.tzinfo is None:
        start = start.replace(tzinfo=dt.timezone.utc)
    return ingest(feature_set, source, targets, previous, overwrite=False, start=start, end=now)
