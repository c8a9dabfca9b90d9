"""Embedding near-duplicates (operator 4): subspace pigeonhole join.

Unit vectors with cosine >= t are within a squared distance of 2 - 2t.  After a random rotation
the dimensions are split into blocks; in at least one block a close pair is within the share of
that budget that is proportional to the block's dimensions.  Each block is range-joined on its
own, and what a block finds is verified on the whole vectors.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .components import components, forest
from .vectors import matrix, rotation, unit, usable

BLOCK_DIMS = 16
# Vectors of one side of a joined pair of tiles.
TILE_ROWS = 16384
# Bounds of what tasks are sent: cells per block, and the sample that places the cells.
MAX_CELLS = 1024
SAMPLE = 8192
_CHUNK = 256
_PAIRS = 200_000
_SLACK = 1e-9


def _blocks(dims: int) -> list[slice]:
    n = max(1, round(dims / BLOCK_DIMS))
    return [slice(dims * i // n, dims * (i + 1) // n) for i in range(n)]


def _cells(points: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Boxes (low, high corner) that tile the space: sample medians, widest axis first."""
    boxes = [(points, np.full(points.shape[1], -np.inf), np.full(points.shape[1], np.inf))]
    for _ in range(depth):
        halves = []
        for inside, low, high in boxes:
            spread = inside.std(axis=0) if len(inside) else np.zeros(len(low))
            axis = int(spread.argmax())
            at = float(np.median(inside[:, axis])) if len(inside) else 0.0
            at = min(max(at, low[axis]), high[axis])
            left_high, right_low = high.copy(), low.copy()
            left_high[axis] = right_low[axis] = at
            left = inside[:, axis] < at
            halves += [(inside[left], low, left_high), (inside[~left], right_low, high)]
        boxes = halves
    return np.stack([b[1] for b in boxes]), np.stack([b[2] for b in boxes])


def _home(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The one cell that holds each point: low corner inclusive, high corner exclusive."""
    home = np.zeros(len(x), "int64")
    for c in range(len(low)):
        home[((x >= low[c]) & (x < high[c])).all(axis=1)] = c
    return home


def _near(x: np.ndarray, low: np.ndarray, high: np.ndarray, radius2: float) -> np.ndarray:
    """(points, cells): whether the cell is within the radius of the point."""
    out = np.empty((len(x), len(low)), bool)
    for c in range(len(low)):
        gap = np.maximum(np.maximum(low[c] - x, x - high[c]), 0.0)
        out[:, c] = (gap * gap).sum(axis=1) <= radius2
    return out


def _budget(threshold: float, dims: int, block: slice) -> float:
    return (2.0 - 2.0 * threshold) * (block.stop - block.start) / dims * (1 + _SLACK) + _SLACK


def _tile_links(threshold: float, dims: int, seed: int):
    """Task function of one pair of tiles: verified link counts and a forest of the links.

    A pair is counted by the first block that finds it, so the union over blocks holds every
    pair once without bringing the pairs together.
    """
    blocks = _blocks(dims)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        block, first, second = (int(pdf[c].iloc[0]) for c in ("block", "low_tile", "high_tile"))
        units = unit(np.frombuffer(b"".join(pdf["vector"]), "<f8").reshape(len(pdf), dims))
        turned = units @ rotation(dims, seed)
        cid, copies, tile = (pdf[c].to_numpy("int64") for c in ("cid", "copies", "tile"))
        rows = np.flatnonzero(tile == first)
        cols = rows if first == second else np.flatnonzero(tile == second)
        here = blocks[block]
        part = turned[:, here].astype("float32")
        norm = (part * part).sum(axis=1)
        right, right_norm = part[cols], norm[cols]
        counts = np.zeros(len(pdf), "int64")
        high, low = [], []
        for begin in range(0, len(rows), _CHUNK):
            chunk = rows[begin : begin + _CHUNK]
            dist = norm[chunk][:, None] + right_norm[None, :] - 2 * (part[chunk] @ right.T)
            near = dist <= _budget(threshold, dims, here) + 1e-5
            if first == second:
                near &= chunk[:, None] < cols[None, :]
            flat = np.flatnonzero(near)
            for at in range(0, len(flat), _PAIRS):
                i, j = np.divmod(flat[at : at + _PAIRS], len(cols))
                i, j = chunk[i], cols[j]
                close = (units[i] * units[j]).sum(axis=1) >= threshold
                i, j = i[close], j[close]
                for b, dims_of in enumerate(blocks[: block + 1]):
                    gap = turned[i, dims_of] - turned[j, dims_of]
                    inside = (gap * gap).sum(axis=1) <= _budget(threshold, dims, dims_of)
                    keep = inside if b == block else ~inside
                    i, j = i[keep], j[keep]
                if not len(i):
                    continue
                np.add.at(counts, i, copies[j])
                np.add.at(counts, j, copies[i])
                a, z = forest(cid[i], cid[j])
                high.append(a)
                low.append(z)
        linked = np.flatnonzero(counts)
        out = [pd.DataFrame({"a": cid[linked], "b": -1, "n": counts[linked]})]
        if high:
            a, z = forest(np.concatenate(high), np.concatenate(low))
            out.append(pd.DataFrame({"a": a, "b": z, "n": 0}))
        return pd.concat(out, ignore_index=True)

    return run


def _class_links(classes: DataFrame, dims: int, n: int, threshold: float, seed: int) -> DataFrame:
    """(a, b, n): link counts (b = -1) and forest links of distinct vectors of one length."""
    blocks, turn = _blocks(dims), (dims, seed)
    depth = min(int(math.log2(MAX_CELLS)), max(0, math.ceil(math.log2(max(n, 1) / TILE_ROWS))))
    if depth:
        rows = classes.orderBy(F.xxhash64("cid"), "cid").limit(SAMPLE).select("embedding").toPandas()
        sample = unit(matrix(rows["embedding"])) @ rotation(*turn)
    else:
        sample = np.zeros((1, dims))
    corners = [_cells(sample[:, b], depth) for b in blocks]

    def place(batches):
        q = rotation(*turn)
        for pdf in batches:
            if not len(pdf):
                continue
            turned = unit(matrix(pdf["embedding"])) @ q
            for no, block in enumerate(blocks):
                home = _home(turned[:, block], *corners[no])
                cell, size = np.unique(home, return_counts=True)
                yield pd.DataFrame({"block": no, "cell": cell, "size": size})

    # A cell with more vectors than a tile holds is sliced by hash; the table of slices is
    # bounded by blocks x MAX_CELLS.
    slices = np.ones((len(blocks), 1 << depth), "int64")
    if n > TILE_ROWS:
        sizes = classes.select("embedding").mapInPandas(place, "block int, cell long, size long")
        for row in sizes.groupBy("block", "cell").agg(F.sum("size").alias("size")).collect():
            slices[row["block"], row["cell"]] = -(-row["size"] // TILE_ROWS)
    first_tile = np.concatenate([np.zeros((len(blocks), 1), "int64"), slices.cumsum(axis=1)], axis=1)

    def deal(batches):
        q = rotation(*turn)
        for pdf in batches:
            if not len(pdf):
                continue
            plain = matrix(pdf["embedding"])
            turned = unit(plain) @ q
            cid = pdf["cid"].to_numpy("int64")
            packed = pd.Series([v.tobytes() for v in plain.astype("<f8")])
            for no, block in enumerate(blocks):
                low, high = corners[no]
                x = turned[:, block]
                home = _home(x, low, high)
                mixed_id = (cid.astype("uint64") * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
                own = first_tile[no, home] + (mixed_id % slices[no, home].astype("uint64")).astype("int64")
                row, cell = np.nonzero(_near(x, low, high, _budget(threshold, dims, block)))
                # Every slice of every near cell, each pair of tiles once.
                times = slices[no, cell]
                row, cell = np.repeat(row, times), np.repeat(cell, times)
                nth = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
                other = first_tile[no, cell] + nth
                yield pd.DataFrame({
                    "block": no, "low_tile": np.minimum(own[row], other), "high_tile": np.maximum(own[row], other),
                    "tile": own[row], "cid": cid[row], "copies": pdf["copies"].to_numpy("int64")[row],
                    "vector": packed.to_numpy()[row],
                })

    dealt = classes.select("cid", "copies", "embedding").mapInPandas(
        deal, "block int, low_tile long, high_tile long, tile long, cid long, copies long, vector binary"
    )
    return dealt.groupBy("block", "low_tile", "high_tile").applyInPandas(
        _tile_links(threshold, dims, seed), "a long, b long, n long"
    )


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, seed: int = 7) -> DataFrame:
    """Per row: vec_id, n_links, component_id, kept, by cosine >= ``threshold``.

    Only vec_id and embedding are read.  Equal vectors are merged first and counted with
    their number.  Vectors of different lengths never link.  Null, zero and non-finite vectors
    and rows without an id link with nothing: n_links 0, the component is the own id, kept is
    true (false without an id).  Repeated rows count as vectors of their own; an empty table
    gives an empty one.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold is a cosine in (0, 1]")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    good = rows.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull())
    classes = cut(
        good.groupBy("embedding").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
        .withColumn("cid", F.monotonically_increasing_id()),
        "vector-classes",
    )
    lengths = classes.groupBy(F.size("embedding").alias("dims")).count().collect()
    found = None
    for dims, n in sorted(map(tuple, lengths)):
        part = _class_links(classes.where(F.size("embedding") == dims), dims, n, threshold, seed)
        found = part if found is None else found.union(part)
    if found is None:
        found = rows.sparkSession.createDataFrame([], "a long, b long, n long")
    found = cut(found, "vector-links")
    counts = found.where("b < 0").groupBy(F.col("a").alias("cid")).agg(F.sum("n").alias("n"))
    joined = components(found.where("b >= 0"))
    tagged = classes.join(joined, classes["cid"] == joined["node"]).select("cid", "component", "least")
    least = tagged.groupBy("component").agg(F.min("least").alias("component_id"))
    moved = tagged.select("cid", "component").join(least, "component").select("cid", "component_id")
    final = classes.join(counts, "cid", "left").join(moved, "cid", "left").select(
        F.col("embedding").alias("__vector"),
        (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("component_id", "least").alias("component_id"),
    )
    same = (F.col("embedding") == F.col("__vector")) & F.col("vec_id").isNotNull()
    out = rows.join(final, same, "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
    )
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e, row_number() OVER () AS r FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.r <> b.r AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
reach(a, b) AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
least AS (SELECT a, min(b) AS b FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, least(e.vec_id, coalesce(l.b, e.vec_id)) AS component_id,
  e.vec_id = least(e.vec_id, coalesce(l.b, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN n ON n.a = e.vec_id LEFT JOIN least l ON l.a = e.vec_id
"""
