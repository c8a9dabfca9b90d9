"""Keyed tables in hash buckets: an upsert rewrites the buckets it touches and no other.

Rows lie in ``data/<commit>/b=<bucket>``.  A manifest, one small JSON file per version, names the
folder that holds each bucket, so a version is visible as a whole or not at all, and readers of
an older manifest keep their files until these are vacuumed.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import SpecError
from ..operators.joins import latest_per_key

BUCKETS = 64
_BUCKET = "b"

Merge = Callable[[DataFrame | None, DataFrame], DataFrame]


def _fs(spark: SparkSession, path: str):
    kind = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return kind(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), kind


def _numbers(spark: SparkSession, path: str) -> list[int]:
    fs, kind = _fs(spark, path)
    folder = kind(f"{path}/manifest")
    if not fs.exists(folder):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def manifest(spark: SparkSession, path: str, version: int | None = None) -> dict | None:
    """The newest (or a given) manifest: version, schema, buckets, folders, batch."""
    numbers = _numbers(spark, path)
    if version is None and not numbers:
        return None
    version = numbers[-1] if version is None else version
    if version not in numbers:
        raise SpecError(f"no version {version} of {path}")
    fs, kind = _fs(spark, path)
    stream = fs.open(kind(f"{path}/manifest/{version:010d}.json"))
    try:
        text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return json.loads(text)


def _publish(spark: SparkSession, path: str, found: dict) -> None:
    """The manifest appears under its number by one rename; a number is given once."""
    fs, kind = _fs(spark, path)
    whole = kind(f"{path}/manifest/{found['version']:010d}.json")
    draft = kind(f"{path}/manifest/.{uuid.uuid4().hex}")
    out = fs.create(draft, True)
    try:
        out.write(bytearray(json.dumps(found).encode()))
    finally:
        out.close()
    if fs.exists(whole) or not fs.rename(draft, whole):
        fs.delete(draft, False)
        raise SpecError(f"version {found['version']} of {path} was written by another run")


def _rows(spark: SparkSession, path: str, found: dict, buckets: list[int] | None = None) -> DataFrame | None:
    folders = [f for b, f in found["folders"].items() if buckets is None or int(b) in set(buckets)]
    schema = T.StructType.fromJson(found["schema"])
    if not folders:
        return None
    return spark.read.schema(schema).parquet(*[f"{path}/{f}" for f in sorted(folders)])


def bucket_of(keys: list[str], buckets: int):
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def read_buckets(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The table as one manifest has it."""
    found = manifest(spark, path, version)
    if found is None:
        raise SpecError(f"no table at {path}")
    rows = _rows(spark, path, found)
    return spark.createDataFrame([], T.StructType.fromJson(found["schema"])) if rows is None else rows


def keep_newest(keys: list[str], ts: str) -> Merge:
    """Merge rule: newest row per key; ties go to the largest remaining columns."""

    def merge(current: DataFrame | None, batch: DataFrame) -> DataFrame:
        return latest_per_key(batch if current is None else current.unionByName(batch), keys, ts)

    return merge


def upsert(
    batch: DataFrame, path: str, keys: list[str], merge: Merge, buckets: int = BUCKETS, batch_id: int | None = None
) -> dict:
    """Merge ``batch`` into the table and return the manifest that holds it.

    ``merge(current, batch)`` sees the rows of the touched buckets only, and must keep rows in
    their bucket, that is keep the keys of rows.  A ``batch_id`` that is not above the last one
    applied changes nothing, so a batch that is run again after a failure is applied once.  An
    empty batch changes nothing.  The number of buckets is fixed by the first write.
    """
    spark = batch.sparkSession
    found = manifest(spark, path)
    if found and batch_id is not None and found["batch"] is not None and batch_id <= found["batch"]:
        return found
    if found and found["buckets"] != buckets:
        raise SpecError(f"{path} has {found['buckets']} buckets, not {buckets}")
    if buckets < 1:
        raise SpecError("buckets must be at least 1")
    place = bucket_of(keys, buckets)
    # At most ``buckets`` numbers.
    touched = sorted(r[0] for r in batch.select(place.alias(_BUCKET)).distinct().collect())
    if not touched and found:
        return found
    current = _rows(spark, path, found, touched) if found else None
    merged = merge(current, batch)
    commit = f"data/{uuid.uuid4().hex}"
    placed = merged.withColumn(_BUCKET, bucket_of(keys, buckets))
    placed.repartition(F.col(_BUCKET)).write.partitionBy(_BUCKET).parquet(f"{path}/{commit}")
    fs, kind = _fs(spark, path)
    written = {
        s.getPath().getName()[len(_BUCKET) + 1 :] for s in fs.listStatus(kind(f"{path}/{commit}")) if s.isDirectory()
    }
    if not written <= set(map(str, touched)):
        raise SpecError("the merge moved rows to buckets the batch does not touch")
    folders = {b: f for b, f in (found["folders"] if found else {}).items() if int(b) not in touched}
    folders |= {b: f"{commit}/{_BUCKET}={b}" for b in written}
    last = batch_id if batch_id is not None else found["batch"] if found else None
    new = {
        "version": found["version"] + 1 if found else 0, "schema": json.loads(merged.schema.json()), "buckets": buckets,
        "folders": folders, "batch": last,
    }
    _publish(spark, path, new)
    return new


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Remove folders that none of the newest ``keep`` manifests names; returns how many."""
    if keep < 1:
        raise SpecError("keep must be at least 1")
    numbers = _numbers(spark, path)
    fs, kind = _fs(spark, path)
    used = {f for n in numbers[-keep:] for f in manifest(spark, path, n)["folders"].values()}
    old = {f for n in numbers[:-keep] for f in manifest(spark, path, n)["folders"].values()} - used
    for folder in old:
        fs.delete(kind(f"{path}/{folder}"), True)
    for n in numbers[:-keep]:
        fs.delete(kind(f"{path}/manifest/{n:010d}.json"), False)
    return len(old)
