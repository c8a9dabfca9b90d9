"""A partitioned log that many small writes append to and that is compacted while it is read.

Rows lie in ``data/log_commit=<id>/<partition folders>``.  A manifest, one JSON file per version, says which
commits hold rows of a partition, so an append or a compaction is seen whole or not at all, and
readers of an older manifest keep their files until these are vacuumed.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..errors import SpecError
from .buckets import _fs, _numbers, _publish, manifest

TARGET_BYTES = 128 << 20
_ADVISORY = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
_TRIES = 10
_COMMIT = "log_commit"


def _held(spark: SparkSession, path: str, commit: str, depth: int) -> dict[str, dict]:
    """Per partition folder of a commit its files and bytes; as many entries as the commit has partitions."""
    fs, kind = _fs(spark, path)
    found: dict[str, dict] = {}
    root = kind(f"{path}/data/{_COMMIT}={commit}")
    if not fs.exists(root):
        return found
    inside = fs.makeQualified(root).toUri().getPath()
    files = fs.listFiles(root, True)
    while files.hasNext():
        status = files.next()
        name = status.getPath().getName()
        if name.startswith(("_", ".")):
            continue
        folder = status.getPath().getParent().toUri().getPath()[len(inside) :].strip("/")
        if len(folder.split("/")) != depth:
            raise SpecError(f"{folder} is not a partition of {depth} columns")
        entry = found.setdefault(folder, {"commit": commit, "files": 0, "bytes": 0})
        entry["files"] += 1
        entry["bytes"] += status.getLen()
    return found


def _change(spark: SparkSession, path: str, change: Callable[[dict | None], dict | None]) -> dict | None:
    """Publish ``change(newest manifest)``; another writer's version in between leads to a new try."""
    for left in range(_TRIES - 1, -1, -1):
        found = manifest(spark, path)
        new = change(found)
        if new is None:
            return found
        new["version"] = found["version"] + 1 if found else 0
        try:
            _publish(spark, path, new)
            return new
        except SpecError:
            if not left:
                raise
    return None


def append(batch: DataFrame, path: str, partition_by: list[str], batch_id: int | None = None, writer: str = "") -> dict | None:
    """Add the rows of ``batch`` as one commit; returns the manifest that holds them.

    A ``batch_id`` that is not above the last one of this ``writer`` changes nothing, so a
    micro-batch that runs again is added once.  Schema and partition columns are fixed by the first append.
    """
    spark = batch.sparkSession
    if not partition_by or not set(partition_by) < set(batch.columns) or _COMMIT in batch.columns:
        raise SpecError(f"a log needs partition columns, columns beside them, and none named {_COMMIT}")
    schema = json.loads(batch.schema.json())

    def seen(found: dict | None) -> bool:
        return bool(found) and batch_id is not None and batch_id <= found["batches"].get(writer, -1)

    found = manifest(spark, path)
    if seen(found):
        return found
    if found and (found["partition_by"] != list(partition_by) or _types(found["schema"]) != _types(schema)):
        raise SpecError(f"{path} has other columns or partitions")
    commit = uuid.uuid4().hex
    batch.hint("rebalance", *partition_by).write.partitionBy(*partition_by).parquet(f"{path}/data/{_COMMIT}={commit}")
    added = _held(spark, path, commit, len(partition_by))

    def change(now: dict | None) -> dict | None:
        if seen(now):
            return None
        parts = {k: list(v) for k, v in now["parts"].items()} if now else {}
        for folder, entry in added.items():
            parts.setdefault(folder, []).append(entry)
        batches = dict(now["batches"]) if now else {}
        if batch_id is not None:
            batches[writer] = batch_id
        return {"schema": schema, "partition_by": list(partition_by), "parts": parts, "batches": batches}

    return _change(spark, path, change)


def _types(schema: dict) -> list[tuple]:
    return [(f["name"], json.dumps(f["type"])) for f in schema["fields"]]


def _values(folder: str) -> dict[str, str]:
    return dict(level.split("=", 1) for level in folder.split("/"))


def read_log(
    spark: SparkSession, path: str, version: int | None = None, where: Callable[[dict[str, str]], bool] | None = None
) -> DataFrame:
    """The log as one manifest has it.

    ``where`` sees the partition values of a folder as text (as the folder spells them) and leaves
    folders out before Spark lists them; filters on partition columns prune the rest as usual.
    """
    found = manifest(spark, path, version)
    if found is None:
        raise SpecError(f"no log at {path}")
    wanted = [
        f"{path}/data/{_COMMIT}={e['commit']}/{folder}"
        for folder, entries in sorted(found["parts"].items()) if where is None or where(_values(folder)) for e in entries
    ]
    return _read(spark, path, found, wanted)


def _read(spark: SparkSession, path: str, found: dict, folders: list[str]) -> DataFrame:
    schema = T.StructType.fromJson(found["schema"])
    if not folders:
        return spark.createDataFrame([], schema)
    # The commit is one more partition column, so that all commits are one scan.
    whole = T.StructType([*schema, T.StructField(_COMMIT, T.StringType())])
    return spark.read.schema(whole).option("basePath", f"{path}/data").parquet(*folders).select(*schema.names)


def small_parts(found: dict, target_bytes: int, max_files: int) -> dict[str, list[dict]]:
    """Per partition the commits worth merging: files below half the target, more than ``max_files`` of them."""
    out = {}
    for folder, entries in found["parts"].items():
        small = [e for e in entries if e["bytes"] < e["files"] * target_bytes // 2]
        if sum(e["files"] for e in small) > max_files:
            out[folder] = small
    return out


def compact(spark: SparkSession, path: str, target_bytes: int = TARGET_BYTES, max_files: int = 1) -> int:
    """Merge the small files of partitions that have more than ``max_files``; returns how many partitions.

    Rows are dealt by partition into files of about ``target_bytes``; a large partition is split
    over several tasks.  Large files stay where they are.  Readers see the old files or the new
    ones.  Rows appended meanwhile stay; a second compaction that got ahead wins, and this one's
    files are left to ``vacuum``.
    """
    found = manifest(spark, path)
    if found is None or target_bytes < 1 or max_files < 1:
        raise SpecError("compaction needs a log, a target of at least one byte and at least one file")
    merge = small_parts(found, target_bytes, max_files)
    if not merge:
        return 0
    by = found["partition_by"]
    folders = [f"{path}/data/{_COMMIT}={e['commit']}/{folder}" for folder, entries in merge.items() for e in entries]
    commit = uuid.uuid4().hex
    with _setting(spark, _ADVISORY, f"{target_bytes}b"):
        rows = _read(spark, path, found, folders).hint("rebalance", *by)
        rows.write.partitionBy(*by).parquet(f"{path}/data/{_COMMIT}={commit}")
    written = _held(spark, path, commit, len(by))
    if set(written) != set(merge):
        raise SpecError("the merged files are not those of the partitions that were read")
    done = [0]

    def change(now: dict | None) -> dict | None:
        parts = {k: list(v) for k, v in now["parts"].items()}
        for folder, old in merge.items():
            gone = {e["commit"] for e in old}
            if not gone <= {e["commit"] for e in parts.get(folder, [])}:
                done[0] = 0
                return None
            parts[folder] = [e for e in parts[folder] if e["commit"] not in gone] + [written[folder]]
        done[0] = len(merge)
        return {**now, "parts": parts}

    _change(spark, path, change)
    return done[0]


@contextmanager
def _setting(spark: SparkSession, name: str, value: str):
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Remove partition folders that none of the newest ``keep`` manifests names; returns how many."""
    if keep < 1:
        raise SpecError("keep must be at least 1")
    numbers = _numbers(spark, path)
    fs, kind = _fs(spark, path)

    def named(some: list[int]) -> set[str]:
        return {
            f"{e['commit']}/{folder}" for n in some for folder, entries in manifest(spark, path, n)["parts"].items() for e in entries
        }

    old = named(numbers[:-keep]) - named(numbers[-keep:])
    for folder in old:
        fs.delete(kind(f"{path}/data/{_COMMIT}={folder}"), True)
    for n in numbers[:-keep]:
        fs.delete(kind(f"{path}/manifest/{n:010d}.json"), False)
    return len(old)


def file_counts(spark: SparkSession, path: str) -> dict[str, int]:
    """Files per partition folder of the newest version."""
    found = manifest(spark, path)
    return {folder: sum(e["files"] for e in entries) for folder, entries in (found or {"parts": {}})["parts"].items()}

