"""Exact similarity search that skips tiles which cannot hold a nearest vector.

Vectors are dealt to the nearest of some pivots and packed into tiles of one cell.  A tile is known
by its centre and radius; by the triangle inequality no vector of it is nearer to a query than the
centre's distance less the radius.  A query first reads the tiles around it, whose k-th best
distance then rules out most others.
"""

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
from ..session import cut
from .vectors import _best

# Vectors in a tile, queries that meet a tile at a time, tile summaries in a packed row.
TILE_ROWS = 1024
BLOCK_ROWS = 512
SUMMARY_ROWS = 4096
# Pivots are a sample chosen by hash of the vector; they shape the tiles and decide no result.
PIVOTS = 512
# Distances of unit vectors are off by less than this.
SLACK = 1e-6


def _unit(rows: pd.Series) -> np.ndarray:
    block = np.stack([np.asarray(v, dtype="float64") for v in rows])
    return block / np.maximum(np.linalg.norm(block, axis=1, keepdims=True), 1e-300)


def _away(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Distances between rows; null vectors and such without a direction are no rows here."""
    square = (left**2).sum(axis=1)[:, None] + (right**2).sum(axis=1)[None, :] - 2 * left @ right.T
    return np.sqrt(np.maximum(square, 0))


def _pivots(vectors: DataFrame, vector: str, count: int) -> dict[int, np.ndarray]:
    """At most ``count`` unit vectors, by length of vector."""
    chosen = vectors.where(F.col(vector).isNotNull()).select(vector).orderBy(F.xxhash64(vector)).limit(count).collect()
    by_size: dict[int, list] = {}
    for row in chosen:
        v = np.asarray(row[0], dtype="float64")
        if np.isfinite(v).all() and np.linalg.norm(v) > 0:
            by_size.setdefault(len(v), []).append(v / np.linalg.norm(v))
    return {size: np.stack(rows) for size, rows in by_size.items()}


def tiles(vectors: DataFrame, vector_id: str, vector: str, pivots: int = PIVOTS, rows: int = TILE_ROWS) -> DataFrame:
    """(tile, dims, n, ids, rows, centre, radius): vectors of one cell, at most ``rows`` of them.

    A tile whose vectors have no direction (zero or not finite) has an infinite radius and is never skipped.
    """
    kind = vectors.schema[vector_id].dataType
    known = _pivots(vectors, vector, pivots)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for size, same in pdf.groupby(pdf["v"].map(len).to_numpy()):
                unit = _unit(same["v"])
                cell, far = np.full(len(same), -1), np.zeros(len(same))
                plain = np.isfinite(unit).all(axis=1) & (np.abs(unit).sum(axis=1) > 0)
                if size in known and plain.any():
                    away = _away(unit[plain], known[size])
                    cell[plain], far[plain] = away.argmin(axis=1), away.min(axis=1)
                elif plain.any():
                    cell[plain] = 0
                yield same.assign(dims=size, cell=cell, far=far)

    fields = [T.StructField("id", kind), T.StructField("v", vectors.schema[vector].dataType)]
    schema = T.StructType([*fields, T.StructField("dims", T.LongType()), T.StructField("cell", T.LongType()), T.StructField("far", T.DoubleType())])
    plain = vectors.where(F.col(vector).isNotNull()).select(F.col(vector_id).alias("id"), F.col(vector).alias("v"))
    order = ["dims", "cell", "far", "id"]
    # Dealt by range: a cell that holds a third of all rows is spread over many tasks.
    dealt = plain.mapInPandas(assign, schema).repartitionByRange(*order).sortWithinPartitions(*order)

    def one(size: int, cell: int, ids: list, block: np.ndarray) -> pd.DataFrame:
        centre = block.mean(axis=0)
        radius = float(_away(block, centre[None])[:, 0].max()) if cell >= 0 else math.inf
        return pd.DataFrame({
            "dims": [size], "n": len(ids), "ids": [ids], "rows": [block.tobytes()],
            "centre": [np.nan_to_num(centre).tobytes()], "radius": radius,
        })

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, now = None, None
        for pdf in batches:
            for key, same in pdf.groupby(["dims", "cell"], sort=False):
                ids, block = same["id"].tolist(), _unit(same["v"])
                if key == now:
                    ids, block = held[0] + ids, np.concatenate([held[1], block])
                elif held is not None:
                    yield one(*now, *held)
                while len(ids) > rows:
                    yield one(*key, ids[:rows], block[:rows])
                    ids, block = ids[rows:], block[rows:]
                held, now = (ids, block), key
        if held is not None:
            yield one(*now, *held)

    packed = T.StructType([
        T.StructField("dims", T.LongType()), T.StructField("n", T.LongType()), T.StructField("ids", T.ArrayType(kind)),
        T.StructField("rows", T.BinaryType()), T.StructField("centre", T.BinaryType()), T.StructField("radius", T.DoubleType()),
    ])
    return cut(dealt.mapInPandas(pack, packed).withColumn("tile", F.monotonically_increasing_id()), "tiles")


def _queries(queries: DataFrame, query_id: str, query: str) -> DataFrame:
    """(at, qid, dims, q): unit vectors of the queries under numbers of their own, so that ids may repeat."""

    def unit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            units = [np.asarray(v, dtype="float64") for v in pdf["q"]]
            units = [v / max(float(np.linalg.norm(v)), 1e-300) for v in units]
            yield pd.DataFrame({"qid": pdf["qid"], "dims": [len(v) for v in units], "q": [v.tobytes() for v in units]})

    schema = T.StructType([
        T.StructField("qid", queries.schema[query_id].dataType), T.StructField("dims", T.LongType()), T.StructField("q", T.BinaryType()),
    ])
    plain = queries.where(F.col(query).isNotNull()).select(F.col(query_id).alias("qid"), F.col(query).alias("q"))
    return cut(plain.mapInPandas(unit, schema).withColumn("at", F.monotonically_increasing_id()), "queries")


def _met(found: DataFrame, summaries: DataFrame, schema: str, task) -> DataFrame:
    """``task(queries, summaries)`` for every block of queries with every block of summaries.

    Work is queries x tiles; pairs of groups are join keys, so that they spread over all tasks.
    """
    spark = found.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    groups = max(1, math.isqrt(tasks))

    def packed(df: DataFrame, rows: int, columns: list[str], own: str, other: str, name: str) -> DataFrame:
        parts = max(groups, -(-df.count() // rows))
        block = F.pmod(F.xxhash64(columns[0]), F.lit(parts))
        packed = df.groupBy("dims", block.alias("block")).agg(F.collect_list(F.struct(*columns)).alias(name))
        dealt = packed.withColumn(own, F.pmod(F.xxhash64("dims", "block"), F.lit(groups)).cast("int")).drop("block")
        return dealt.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))

    wide = [c for c in found.columns if c not in ("qid", "dims")]
    wide.sort(key=lambda c: c != "at")
    left = packed(found.drop("qid"), BLOCK_ROWS, wide, "g", "h", "asked")
    right = packed(summaries, SUMMARY_ROWS, ["tile", "n", "centre", "radius"], "h", "g", "held")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples():
                asked, held = pd.DataFrame(list(map(_plain, row.asked))), pd.DataFrame(list(map(_plain, row.held)))
                q = np.frombuffer(b"".join(asked["q"])).reshape(len(asked), -1)
                away = _away(q, np.frombuffer(b"".join(held["centre"])).reshape(len(held), -1))
                # A query without a direction is as near to everything.
                away[~(np.isfinite(q).all(axis=1) & (np.abs(q).sum(axis=1) > 0))] = 0
                yield task(asked, held, away)

    return left.join(right, ["g", "h", "dims"]).select("asked", "held").mapInPandas(run, schema)


def _plain(row) -> dict:
    return row if isinstance(row, dict) else row.asDict()


def _scored(pairs: DataFrame, found: DataFrame, held: DataFrame, k: int, vector_id: T.DataType) -> DataFrame:
    """(at, id, score): per pair of query and tile the ``k`` best."""
    slices = max(1, -(-found.count() // BLOCK_ROWS))
    asked = pairs.join(found.select("at", "q"), "at")
    # A tile that all queries read meets them a block at a time.
    blocks = asked.groupBy("tile", F.pmod(F.xxhash64("at"), F.lit(slices)).alias("slice")).agg(
        F.collect_list(F.struct("at", "q")).alias("asked")
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples():
                asked = list(map(_plain, row.asked))
                q = np.frombuffer(b"".join(a["q"] for a in asked)).reshape(len(asked), -1)
                ids = list(row.ids)
                order = np.empty(len(ids), "int64")
                order[sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i]))] = np.arange(len(ids))
                scores = q @ np.frombuffer(row.rows).reshape(len(ids), -1).T
                at, col = _best(scores, order, k)
                yield pd.DataFrame({"at": [asked[i]["at"] for i in at], "id": [ids[j] for j in col], "score": scores[at, col]})

    schema = T.StructType([T.StructField("at", T.LongType()), T.StructField("id", vector_id), T.StructField("score", T.DoubleType())])
    joined = blocks.join(held.select("tile", "ids", "rows"), "tile")
    return joined.select("asked", "ids", "rows").mapInPandas(run, schema)


def _first(found: DataFrame, summaries: DataFrame, k: int) -> DataFrame:
    """(at, tile): the tiles nearest to each query that hold ``k`` vectors together."""

    def near(asked: pd.DataFrame, held: pd.DataFrame, away: np.ndarray) -> pd.DataFrame:
        order = np.argsort(away, axis=1, kind="stable")
        n = held["n"].to_numpy()[order]
        row, col = np.nonzero(np.cumsum(n, axis=1) - n < k)
        tile = order[row, col]
        return pd.DataFrame({
            "at": asked["at"].to_numpy()[row], "tile": held["tile"].to_numpy()[tile], "n": n[row, col], "away": away[row, tile],
        })

    each = _met(found, summaries, "at long, tile long, n long, away double", near)
    before = F.sum("n").over(W.partitionBy("at").orderBy("away", "tile").rowsBetween(W.unboundedPreceding, -1))
    return each.withColumn("before", before).where(F.coalesce("before", F.lit(0)) < k).select("at", "tile")


def visits(found: DataFrame, held: DataFrame, k: int, vector_id: T.DataType) -> DataFrame:
    """(at, tile): the tiles that may hold one of the ``k`` best of a query, none of them missing."""
    summaries = held.select("tile", "dims", "n", "centre", "radius")
    first = _first(found, summaries, k)
    best = _scored(first, found, held, k, vector_id)
    rank = F.row_number().over(W.partitionBy("at").orderBy(F.desc("score"), "id"))
    reached = best.withColumn("rank", rank).where(F.col("rank") == k).select("at", F.col("score").alias("kth"))
    # Fewer than k vectors so far rule out nothing.
    asked = cut(found.join(reached, "at", "left").select("at", "dims", "q", F.coalesce("kth", F.lit(-2.0)).alias("kth")), "reached")

    def may(asked: pd.DataFrame, held: pd.DataFrame, away: np.ndarray) -> pd.DataFrame:
        least = away - held["radius"].to_numpy()[None, :] - SLACK
        kth = asked["kth"].to_numpy()
        bound = np.where(np.isfinite(kth), np.sqrt(np.maximum(2 - 2 * kth, 0)), np.inf) + SLACK
        # Of vectors without a direction the score is 0, whatever the distance says.
        row, col = np.nonzero((least <= bound[:, None]) | np.isinf(held["radius"].to_numpy())[None, :])
        return pd.DataFrame({"at": asked["at"].to_numpy()[row], "tile": held["tile"].to_numpy()[col]})

    return _met(asked, summaries, "at long, tile long", may)


def pruned_top_k(
    vectors: DataFrame, queries: DataFrame, vector_id: str, vector: str, query_id: str, query: str, k: int = 3,
    pivots: int = PIVOTS, tile_rows: int = TILE_ROWS,
) -> DataFrame:
    """Exact cosine top-k, as ``top_k`` gives it, without reading tiles that cannot matter.

    Equal scores go to the smaller id, null vectors and queries take no part, vectors and queries
    of different lengths never meet.  Tiles are written once; a query is sent to the tiles it may
    need, and whole tiles move only to queries.  Vectors without clusters prune little; the result is the same.
    """
    if k < 1 or pivots < 1 or tile_rows < 1:
        raise SpecError("k, pivots and tile_rows must be at least 1")
    kind = vectors.schema[vector_id].dataType
    held = tiles(vectors, vector_id, vector, pivots, tile_rows)
    found = _queries(queries, query_id, query)
    best = _scored(visits(found, held, k, kind), found, held, k, kind)
    rank = F.row_number().over(W.partitionBy("at").orderBy(F.desc("score"), "id"))
    ranked = best.withColumn("rank", rank).where(F.col("rank") <= k)
    return ranked.join(found.select("at", "qid"), "at").select(
        F.col("qid").alias(query_id), F.col("id").alias(vector_id), "score", "rank"
    )
