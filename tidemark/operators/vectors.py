"""Similarity search: the k nearest vectors of each query."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import SpecError

# Vectors in a tile and queries in a block: what a task multiplies at a time.
TILE_ROWS = 4096
BLOCK_ROWS = 512


def _packed(df: DataFrame, name: str, vector: str, rows: int, prefix: str) -> DataFrame:
    """Rows packed where they are: one row holds up to ``rows`` ids and their unit vectors."""
    kind = df.schema[name].dataType

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sizes = pdf[vector].map(len)
            for size, same in pdf.groupby(sizes.to_numpy()):
                for at in range(0, len(same), rows):
                    part = same.iloc[at : at + rows]
                    block = np.stack([np.asarray(v, dtype="float64") for v in part[vector]])
                    block /= np.maximum(np.linalg.norm(block, axis=1, keepdims=True), 1e-300)
                    yield pd.DataFrame({
                        f"{prefix}_ids": [part[name].tolist()], f"{prefix}_dims": int(size), f"{prefix}_rows": [block.tobytes()],
                    })

    schema = T.StructType([
        T.StructField(f"{prefix}_ids", T.ArrayType(kind)), T.StructField(f"{prefix}_dims", T.LongType()),
        T.StructField(f"{prefix}_rows", T.BinaryType()),
    ])
    return df.where(F.col(vector).isNotNull()).select(name, vector).mapInPandas(pack, schema)


def _best(scores: np.ndarray, order: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the ``k`` best scores of each row, ties by ``order``."""
    if scores.shape[1] > k:
        least = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
        row, col = np.nonzero(scores >= least[:, None])
    else:
        row, col = np.nonzero(np.ones_like(scores, bool))
    sort = np.lexsort((order[col], -scores[row, col], row))
    row, col = row[sort], col[sort]
    begin = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
    nth = np.arange(len(row)) - np.repeat(begin, np.diff(np.append(begin, len(row))))
    return row[nth < k], col[nth < k]


def top_k(
    vectors: DataFrame, queries: DataFrame, vector_id: str, vector: str, query_id: str, query: str, k: int = 3
) -> DataFrame:
    """Exact cosine top-k of any number of queries.

    Vectors are packed into tiles and queries into blocks; every tile meets every block, and
    only ``k`` ids per query and tile are shuffled.  Tiles and blocks are dealt into groups, and a
    pair of groups is one join key, so that the pairs spread over all tasks with as few copies as
    the number of queries allows.  Vectors and queries of different lengths never meet.  Equal
    scores go to the smaller id; null vectors take no part.
    """
    if k < 1:
        raise SpecError("k must be at least 1")
    tiles = _packed(vectors, vector_id, vector, TILE_ROWS, "v")
    blocks = _packed(queries, query_id, query, BLOCK_ROWS, "q")
    schema = T.StructType([
        T.StructField(query_id, queries.schema[query_id].dataType),
        T.StructField(vector_id, vectors.schema[vector_id].dataType),
        T.StructField("score", T.DoubleType()),
    ])

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for pair in pdf.itertuples():
                left = np.frombuffer(pair.q_rows).reshape(-1, pair.v_dims)
                right = np.frombuffer(pair.v_rows).reshape(-1, pair.v_dims)
                ids, asked = list(pair.v_ids), list(pair.q_ids)
                order = np.empty(len(ids), "int64")
                order[sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i]))] = np.arange(len(ids))
                scores = left @ right.T
                row, col = _best(scores, order, k)
                yield pd.DataFrame({
                    query_id: [asked[i] for i in row], vector_id: [ids[j] for j in col], "score": scores[row, col],
                })

    tasks = max(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    block_groups = max(1, min(math.isqrt(tasks), -(-queries.count() // BLOCK_ROWS)))
    tile_groups = -(-tasks // block_groups)

    def dealt(df: DataFrame, rows: str, own: str, groups: int, other: str, copies: int) -> DataFrame:
        group = F.pmod(F.xxhash64(rows), F.lit(groups)).cast("int")
        return df.withColumn(own, group).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))

    left = dealt(tiles, "v_ids", "tile_group", tile_groups, "block_group", block_groups)
    right = dealt(blocks, "q_ids", "block_group", block_groups, "tile_group", tile_groups)
    pairs = left.join(right.withColumnRenamed("q_dims", "v_dims"), ["tile_group", "block_group", "v_dims"])
    found = pairs.mapInPandas(nearest, schema)
    best = W.partitionBy(query_id).orderBy(F.col("score").desc(), F.col(vector_id))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
