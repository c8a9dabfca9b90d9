"""User-written targets: a data source whose tasks report to one commit.

Every task writes a Parquet file of its own and returns its name and row count as commit message.
The driver then names the files of all tasks in the next manifest; readers take the newest manifest,
so a write is seen whole or not at all.  Any folder that pyarrow can open will do (a plain
path, ``file:``, ``hdfs:``, ``s3:``).
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..errors import SpecError

_MANIFEST = "manifest-"


@dataclass
class FileWritten(WriterCommitMessage):
    name: str
    rows: int


def _folder(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def _newest(path: str) -> tuple[int, list[dict]]:
    """Number of the newest manifest and the files it names; 0 and none before the first write."""
    store, root = _folder(path)
    names = [f.base_name for f in store.get_file_info(fs.FileSelector(root, allow_not_found=True))]
    numbers = [int(n[len(_MANIFEST) : -5]) for n in names if n.startswith(_MANIFEST) and n.endswith(".json")]
    if not numbers:
        return 0, []
    with store.open_input_stream(f"{root}/{_MANIFEST}{max(numbers):012d}.json") as file:
        return max(numbers), json.loads(file.read())


class CommittedWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite

    def write(self, iterator) -> FileWritten:
        store, root = _folder(self.path)
        store.create_dir(root, recursive=True)
        # Attempts of one task write different files; only the one that reports is named.
        name = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.parquet"
        rows, writer = 0, None
        try:
            for batch in iterator:
                if writer is None:
                    writer = pq.ParquetWriter(f"{root}/{name}", batch.schema, filesystem=store)
                writer.write_batch(batch)
                rows += batch.num_rows
        except BaseException:
            if writer is not None:
                writer.close()
                store.delete_file(f"{root}/{name}")
                writer = None
            raise
        finally:
            if writer is not None:
                writer.close()
        return FileWritten(name if writer is not None else "", rows)

    def commit(self, messages: list) -> None:
        store, root = _folder(self.path)
        store.create_dir(root, recursive=True)
        number, files = _newest(self.path)
        named = [] if self.overwrite else files
        named = named + [{"name": m.name, "rows": m.rows} for m in messages if m is not None and m.name]
        # Renamed when it is complete: readers never see half a manifest.
        draft = f"{root}/draft-{uuid.uuid4().hex}"
        with store.open_output_stream(draft) as file:
            file.write(json.dumps(named).encode())
        store.move(draft, f"{root}/{_MANIFEST}{number + 1:012d}.json")

    def abort(self, messages: list) -> None:
        store, root = _folder(self.path)
        for m in messages:
            if m is not None and m.name:
                store.delete_file(f"{root}/{m.name}")


class Committed(DataSource):
    """Target of ``df.write.format("committed")``; option ``path``, modes append and overwrite."""

    @classmethod
    def name(cls) -> str:
        return "committed"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        if not self.options.get("path"):
            raise SpecError("a committed target needs a path")
        return CommittedWriter(self.options["path"], overwrite)


def write_committed(df: DataFrame, path: str, mode: str = "append") -> None:
    """One commit of all rows; a failed write leaves what was there before.

    Earlier versions of an overwritten target keep their files for readers of the old manifest.
    Two writers at the same time are not supported: the later commit would not name the other's files.
    """
    if mode not in ("append", "overwrite"):
        raise SpecError(f"a committed target is appended to or overwritten, not {mode!r}")
    df.sparkSession.dataSource.register(Committed)
    df.write.format(Committed.name()).mode(mode).option("path", path).save()


def read_committed(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows of the files that the newest manifest names; without any, an empty frame of ``schema``."""
    files = [f"{path}/{f['name']}" for f in _newest(path)[1]]
    return spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)


def committed_rows(path: str) -> int:
    """Rows of the newest version, from its manifest alone."""
    return sum(f["rows"] for f in _newest(path)[1])
