"""Token ids in compressed files (operator 8).

Documents are dealt in ascending doc_id order, encoded, and written as range-coded blocks of
whole documents.  A block is a self-contained binary (see ``range_coder``); the files that hold
the blocks are Parquet, so that Spark's writer commits them and any store it knows can keep
them.  Each block lists its documents and their id counts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .batches import returning, small_batches
from .prefix import before
from .range_coder import read_block, write_block
from .words import lasting_units, one_thread, pack_numbers, read_tokenizer, unpack_numbers

# A block closes with the document that brings it to so many ids.
BLOCK_IDS = 1 << 22
# Texts whose distinct words are encoded together.
CHUNK_BYTES = 24 << 20
BLOCKS = "part int, at long, n_docs long, n_ids long, block binary"
_BLOCK_FIELDS = pa.schema([
    ("part", pa.int32()), ("at", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("block", pa.binary()),
])


def _listing(doc_ids: list, counts: list[int]) -> bytes:
    """The documents of a block: ids as steps, nulls marked, and their id counts."""
    known = np.array([d is not None for d in doc_ids], bool)
    values = np.array([d or 0 for d in doc_ids], "int64")
    steps = np.diff(values, prepend=np.int64(0)).tobytes()
    parts = [zlib.compress(steps, 6), np.packbits(known).tobytes(), pack_numbers(np.array(counts, "int64"))]
    return np.array([len(doc_ids), *map(len, parts)], "<u8").tobytes() + b"".join(parts)


def _documents(listing: bytes) -> tuple[list, np.ndarray]:
    n, a, b, c = (int(x) for x in np.frombuffer(listing, "<u8", 4))
    at = 32
    values = np.cumsum(np.frombuffer(zlib.decompress(listing[at : at + a]), "int64"))
    known = np.unpackbits(np.frombuffer(listing, "uint8", b, at + a))[:n].astype(bool)
    counts = unpack_numbers(listing[at + a + b : at + a + b + c])
    return [int(v) if k else None for v, k in zip(values, known)], counts


def _write(spec: str, end_id: int, block_ids: int):
    """Task function: blocks of whole documents, in the order they come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        units, part, at = lasting_units(spec), TaskContext.get().partitionId(), 0
        names, counts, held, size = [], [], [], 0

        def out() -> pa.RecordBatch:
            block = write_block(np.concatenate(held).astype("int64"), _listing(names, counts))
            row = {"part": part, "at": at, "n_docs": len(names), "n_ids": size, "block": block}
            return pa.RecordBatch.from_pylist([row], _BLOCK_FIELDS)

        for table in _chunks(batches):
            ids, sizes = units.encode_texts(table["text"].combine_chunks(), end_id)
            begin = 0
            for doc_id, n in zip(table["doc_id"].to_pylist(), sizes.tolist()):
                names.append(doc_id)
                counts.append(n)
                held.append(ids[begin : begin + n])
                begin, size = begin + n, size + n
                if size >= block_ids:
                    yield out()
                    names, counts, held, at, size = [], [], [], at + size, 0
        if names:
            yield out()

    return run


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches put together until they hold CHUNK_BYTES."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= CHUNK_BYTES:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def write_tokens(
    docs: DataFrame, tokenizer: str, path: str, end_id: int = 2, block_ids: int = BLOCK_IDS
) -> None:
    """Write the ids of all documents to ``path``, in ascending doc_id order.

    The ids are those the tokenizers library gives with the file ``tokenizer`` and no special
    tokens added, and ``end_id`` after every document.  Only doc_id and text are read.  Null ids
    come first, rows that repeat an id in an order by text hash; null and empty texts hold the
    end id only; an empty table writes no block.
    """
    small_batches(docs.sparkSession)
    spec = read_tokenizer(tokenizer)
    texts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
        F.xxhash64(F.col("text").cast("string")).alias("__hash"),
    )
    order = [F.col("doc_id").asc_nulls_first(), F.col("__hash")]
    dealt = texts.repartitionByRange(*order).sortWithinPartitions(*order)
    blocks = dealt.select("doc_id", "text").mapInArrow(returning(_write(spec, end_id, block_ids)), BLOCKS)
    blocks.write.option("compression", "none").parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document in the files under ``path``.

    ``start`` counts the ids of all documents before it; ``ids`` are little-endian unsigned
    32-bit numbers.  A damaged block is an error.
    """
    blocks = spark.read.schema(BLOCKS).parquet(path)
    sizes = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    starts = before(sizes, "n", ["part"], "part_start").select(F.col("part").alias("__part"), "part_start")

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples():
                ids, listing = read_block(row.block)
                doc_ids, counts = _documents(listing)
                ends = np.cumsum(counts)
                for first in range(0, len(doc_ids), 1000):
                    few = slice(first, first + 1000)
                    begins = ends[few] - counts[few]
                    yield pd.DataFrame({
                        "part": row.part, "doc_id": pd.array(doc_ids[few], "Int64"),
                        "at": row.at + begins, "n_tokens": counts[few],
                        "ids": [ids[a:b].tobytes() for a, b in zip(begins, ends[few])],
                    })

    found = blocks.select("part", "at", "block").mapInPandas(
        returning(decode), "part int, doc_id long, at long, n_tokens long, ids binary"
    )
    # One row per file part, as many as the write had tasks.
    return found.join(F.broadcast(starts), F.col("part") == F.col("__part")).select(
        "doc_id", (F.col("at") + F.col("part_start")).cast("long").alias("start"), "n_tokens", "ids"
    )
