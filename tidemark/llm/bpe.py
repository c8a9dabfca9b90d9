"""BPE encoding and decoding by a distinct-word table (operator 9).

Texts are split where Spark reads them.  A task numbers the distinct words of its chunk of
documents and keeps each document as a list of numbers.  Only the chunk's distinct words travel,
dealt by word, so that every distinct word is encoded once.  Their ids return to the chunk, where
documents are put together by position, and are decoded through a join with the id-to-piece table.

The documents' numbers are written bucketed by chunk, so the join back moves the word table only.
"""

from __future__ import annotations

import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import fresh_path
from .batches import release, returning, small_batches
from .words import Units, gather, one_thread, pack_numbers, pieces, read_tokenizer, unpack_numbers

# A chunk ends after so many characters of text, a row of it after so many numbers.
CHUNK_CHARS = 8 << 20
ROW_WORDS = 1 << 18
# Distinct words of a bucket that a task remembers before it starts over.
MEMORY_WORDS = 1_000_000

_FOLDERS_IN_CATALOG = "spark.sql.hive.manageFilesourcePartitions"
_CHUNKS = "kind int, chunk long, no int, ids array<long>, sizes array<int>, payload binary"


def _pack_words(words: list[str], ranks: np.ndarray) -> bytes:
    """Words with their rising numbers, compressed."""
    raw = [w.encode("utf-8") for w in words]
    numbers = pack_numbers(np.diff(ranks, prepend=0))
    sizes = pack_numbers(np.fromiter(map(len, raw), "int64", len(raw)))
    head = np.array([len(numbers), len(sizes)], "<u8").tobytes()
    return zstandard.ZstdCompressor(level=6).compress(head + numbers + sizes + b"".join(raw))


def _unpack_words(payload: bytes) -> tuple[list[str], bytes]:
    """The words, and their numbers still packed."""
    data = zstandard.ZstdDecompressor().decompress(payload)
    a, b = (int(x) for x in np.frombuffer(data, "<u8", 2))
    ends = np.cumsum(unpack_numbers(data[16 + a : 16 + a + b])) + 16 + a + b
    begins = np.concatenate([[16 + a + b], ends[:-1]])
    return [data[i:j].decode("utf-8") for i, j in zip(begins.tolist(), ends.tolist())], data[16 : 16 + a]


def _chunk_rows(spec: str, buckets: int):
    """Task function: per chunk its distinct words by word bucket, and its documents."""

    def flush(chunk: int, units: Units, seen: dict, docs: list) -> Iterator[pd.DataFrame]:
        words: dict[str, int] = {}
        numbers, counts = array("q"), array("q")
        for unit in seen:
            parts = units.words(unit)
            counts.append(len(parts))
            numbers.extend([words.setdefault(w, len(words)) for w in parts])
        sizes, flat = np.array(counts, "int64"), np.array(numbers, "int64")
        begins = np.cumsum(sizes) - sizes
        uses = np.zeros(len(seen), "int64")
        for _, codes in docs:
            np.add.at(uses, codes, 1)
        frequency = np.bincount(flat, np.repeat(uses, sizes), len(words))
        # Numbers by frequency are small and compress well.
        order = np.argsort(-frequency, kind="stable")
        rank = np.empty(len(order), "int64")
        rank[order] = np.arange(len(order))
        flat = rank[flat]
        names = np.array(list(words), dtype=object)[order]
        bucket = np.fromiter((zlib.crc32(w.encode()) % buckets for w in names), "int64", len(names))
        for no in np.unique(bucket):
            mine = np.flatnonzero(bucket == no)
            yield pd.DataFrame({
                "kind": 0, "chunk": chunk, "no": no, "ids": None, "sizes": None,
                "payload": [_pack_words(list(names[mine]), mine)],
            })
        pack = zstandard.ZstdCompressor(level=6)
        held, size, no = [], 0, 0
        for i, (doc_id, codes) in enumerate(docs):
            held.append((doc_id, gather(flat, begins, sizes, codes)))
            size += len(held[-1][1])
            if size >= ROW_WORDS or i == len(docs) - 1:
                yield pd.DataFrame({
                    "kind": 1, "chunk": chunk, "no": no, "ids": [[d for d, _ in held]], "sizes": [[len(c) for _, c in held]],
                    "payload": [pack.compress(pack_numbers(np.concatenate([c for _, c in held])))],
                })
                held, size, no = [], 0, no + 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        units = Units(spec)
        chunk, seen, docs, chars = TaskContext.get().partitionId() << 32, {}, [], 0
        for pdf in batches:
            for doc_id, text in zip(pdf["doc_id"].array, pdf["text"]):
                text = text or ""
                number = [seen.setdefault(u, len(seen)) for u in units.split(text)]
                docs.append((None if pd.isna(doc_id) else int(doc_id), np.array(number, "int32")))
                chars += len(text)
                if chars >= CHUNK_CHARS:
                    yield from flush(chunk, units, seen, docs)
                    chunk, seen, docs, chars = chunk + 1, {}, [], 0
        if docs:
            yield from flush(chunk, units, seen, docs)

    return run


def _encode_words(spec: str, width: str):
    """Task function over rows in order of word bucket: each distinct word is encoded once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one_thread()
        units, bucket, known = Units(spec), None, {}
        for pdf in batches:
            for row in pdf.itertuples():
                if row.no != bucket:
                    bucket, known = row.no, {}
                words, numbers = _unpack_words(row.payload)
                new = [w for w in words if w not in known]
                if len(known) + len(new) > MEMORY_WORDS:
                    # Words that come again after this are encoded again, to the same ids.
                    known, new = {}, words
                known.update(zip(new, units.packed(new, width)))
                packed = [known[w] for w in words]
                sizes = pack_numbers(np.fromiter(map(len, packed), "int64", len(packed)))
                head = np.array([len(numbers), len(sizes)], "<u8").tobytes()
                body = zstandard.ZstdCompressor(level=3).compress(head + numbers + sizes + b"".join(packed))
                yield pd.DataFrame({"chunk": [row.chunk], "encoded": [body]})

    return run


def _table(encoded: pd.Series, width: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, begin, size) of the chunk's words by their numbers."""
    numbers, sizes, ids = [np.empty(0, "int64")], [np.empty(0, "int64")], []
    for body in encoded:
        data = zstandard.ZstdDecompressor().decompress(body)
        a, b = (int(x) for x in np.frombuffer(data, "<u8", 2))
        numbers.append(np.cumsum(unpack_numbers(data[16 : 16 + a])))
        sizes.append(unpack_numbers(data[16 + a : 16 + a + b]) // np.dtype(width).itemsize)
        ids.append(data[16 + a + b :])
    number, size = np.concatenate(numbers), np.concatenate(sizes)
    begin_of, size_of = np.zeros(len(number), "int64"), np.zeros(len(number), "int64")
    begin_of[number], size_of[number] = np.cumsum(size) - size, size
    return np.frombuffer(b"".join(ids), width), begin_of, size_of


def _by_id(piece_table: list[tuple[int, bytes]]) -> tuple[np.ndarray, bytes]:
    """The id-to-piece table by id: bytes per id, and the bytes of all ids."""
    sizes = np.zeros(piece_table[-1][0] + 1, "int64")
    for i, piece in piece_table:
        sizes[i] = len(piece)
    return sizes, b"".join(p for _, p in piece_table)


def _assemble(width: str, piece_size: np.ndarray, piece_bytes: bytes):
    """Task function of one chunk: its documents with their ids and decoded texts."""

    def run(docs: pd.DataFrame, encoded: pd.DataFrame) -> pd.DataFrame:
        release()
        # Ids meet the id-to-piece table by position.
        piece_begin = np.cumsum(piece_size) - piece_size
        letters = np.frombuffer(piece_bytes, "uint8")
        ids, begins, sizes = _table(encoded["encoded"], width)
        unpack = zstandard.ZstdDecompressor()
        out = []
        for row in docs.itertuples():
            codes = unpack_numbers(unpack.decompress(row.payload))
            ends = np.cumsum(np.asarray(row.sizes, "int64"))
            for doc_id, begin, end in zip(row.ids, ends - np.asarray(row.sizes), ends):
                mine = gather(ids, begins, sizes, codes[begin:end])
                text = gather(letters, piece_begin, piece_size, mine).tobytes().decode("utf-8", "replace")
                out.append((None if pd.isna(doc_id) else int(doc_id), mine.astype("<u4").tobytes(), len(mine), text))
        return pd.DataFrame(out, columns=["doc_id", "ids", "n_tokens", "decoded"]).astype({"doc_id": "Int64"})

    return run


def _bucketed(rows: DataFrame, buckets: int) -> DataFrame:
    """The rows as a written table that is bucketed by chunk and has no catalog entry.

    Spark knows buckets from its catalog only.  A table with a path keeps its files when its entry
    is dropped, and the frame read before knows its files and buckets, because the folders of this
    table are listed and not looked up in the catalog.
    """
    spark, name = rows.sparkSession, f"bpe_chunks_{uuid.uuid4().hex}"
    before = spark.conf.get(_FOLDERS_IN_CATALOG, None)
    spark.conf.set(_FOLDERS_IN_CATALOG, "false")
    try:
        (
            rows.write.partitionBy("kind").bucketBy(buckets, "chunk").option("path", fresh_path(spark, "bpe-chunks"))
            .option("compression", "none").saveAsTable(name)
        )
        return spark.table(name)
    finally:
        if before is None:
            spark.conf.unset(_FOLDERS_IN_CATALOG)
        else:
            spark.conf.set(_FOLDERS_IN_CATALOG, before)
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def encode_decode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, ids, n_tokens, decoded) of every document.

    ``ids`` are little-endian unsigned 32-bit numbers, as the tokenizers library encodes the
    whole text with the file ``tokenizer`` and no special tokens added; ``decoded`` is the text
    that the ids stand for, special tokens included.  Only doc_id and text are read.  Null and
    empty texts have no ids and decode to an empty text; repeated rows and ids are kept; an
    empty table gives an empty one.
    """
    spark = docs.sparkSession
    small_batches(spark)
    spec = read_tokenizer(tokenizer)
    piece_table = pieces(spec)
    width = "<u2" if piece_table[-1][0] < 1 << 16 else "<u4"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    chunks = _bucketed(texts.mapInPandas(returning(_chunk_rows(spec, buckets)), _CHUNKS), buckets)
    words = chunks.where("kind = 0").select("chunk", "no", "payload").repartition("no").sortWithinPartitions("no")
    encoded = words.mapInPandas(returning(_encode_words(spec, width)), "chunk long, encoded binary")
    coded = chunks.where("kind = 1").select("chunk", "ids", "sizes", "payload")
    return coded.groupBy("chunk").cogroup(encoded.groupBy("chunk")).applyInPandas(
        _assemble(width, *_by_id(piece_table)), "doc_id long, ids binary, n_tokens long, decoded string"
    )
