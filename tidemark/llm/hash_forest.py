"""Approximate nearest neighbours (operator 10): a forest of sorted hash strings.

Every tree gives a vector a string of symbols: the first names the random direction, with its
sign, that the vector is closest to; each later one is the side of a random plane.  Sorted by
string, the vectors that share a prefix with a query are one range.  A query descends to the
longest prefix it finds, then all trees ascend together, symbol by symbol, until their ranges
hold enough candidates; those are scored.  How many are enough is measured on every table: on a
sample of its queries, against brute force.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut
from .prefix import numbered
from .vectors import matrix, unit, usable

TREES = 40
DIRECTIONS = 64
# Candidates, counted over all trees, below which the trees ascend further on any table.
MIN_CANDIDATES = 5120
# Share of the true neighbours of the sampled queries that the ranges must hold.
RECALL = 0.96
SAMPLE_QUERIES = 96
# Symbols beyond those at which evenly spread rows reach MIN_CANDIDATES, for dense places.
MORE_SYMBOLS = 5
# Rows of a sorted array that are scored together, and queries sent to one copy of them.
BLOCK_ROWS = 2048
BLOCK_QUERIES = 1024
# Queries whose scores with a block are in memory at a time.
SCORED_QUERIES = 256
# Trees in which the block around a query is scored before all others; of each, so much more than
# an even share of the best is looked at.
FIRST_TREES = 8
FIRST_SHARES = 2
# Scored pairs a task holds to merge them over its blocks.
HELD_ROWS = 1_000_000
SEED = 11


def symbols_for(rows: int, trees: int) -> int:
    """Length of the strings: each symbol after the first halves the ranges."""
    halvings = math.ceil(math.log2(max(1, rows * trees / (2 * DIRECTIONS * MIN_CANDIDATES))))
    return 1 + MORE_SYMBOLS + halvings


def _codes(vectors: np.ndarray, trees: int, symbols: int, seed: int) -> Iterator[np.ndarray]:
    """Per tree one row of symbols a vector."""
    units = unit(vectors)
    dims = units.shape[1]
    for tree in range(trees):
        rng = np.random.default_rng([seed, tree, dims])
        codes = np.empty((len(units), symbols), "uint8")
        shadow = units @ rng.standard_normal((dims, DIRECTIONS))
        at = np.abs(shadow).argmax(axis=1)
        codes[:, 0] = 2 * at + (shadow[np.arange(len(at)), at] < 0)
        codes[:, 1:] = units @ rng.standard_normal((dims, symbols - 1)) < 0
        yield codes


def _text(codes: np.ndarray) -> list[str]:
    """Symbols as strings: two hex digits for the first one, a digit for each other."""
    digits = np.frombuffer(b"0123456789abcdef", "uint8")
    out = np.empty((len(codes), codes.shape[1] + 1), "uint8")
    out[:, 0], out[:, 1], out[:, 2:] = digits[codes[:, 0] >> 4], digits[codes[:, 0] & 15], digits[codes[:, 1:]]
    return [row.tobytes().decode() for row in out]


def _strings(trees: int, symbols: int, seed: int, kind: str):
    """Task function: one row per vector and tree, with the vector as numbers of type ``kind``.

    The numbers are multiples of ``scale``; ``off`` is the length of what they leave out.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            lengths = pdf["embedding"].map(len)
            for _, same in pdf.groupby(lengths.to_numpy()):
                plain = matrix(same["embedding"])
                ids = same["vec_id"].to_numpy("int64")
                scale = np.abs(plain).max(axis=1) / 127
                small = plain / scale[:, None]
                small = (np.rint(small) if kind == "int8" else small).astype(kind)
                off = np.linalg.norm(plain - small * scale[:, None], axis=1)
                packed = [v.tobytes() for v in small]
                for tree, codes in enumerate(_codes(plain, trees, symbols, seed)):
                    # Vectors of another length are another forest.
                    yield pd.DataFrame({
                        "vec_id": ids, "tree": plain.shape[1] * 4096 + tree, "code": _text(codes), "scale": scale, "off": off, "packed": packed,
                    })

    return run


def _depths(queries: np.ndarray, others: np.ndarray, trees: int, symbols: int, seed: int) -> np.ndarray:
    """Level at which the search from a query meets the vector in the same row."""
    deepest = np.zeros(len(queries), "int64")
    for a, b in zip(_codes(queries, trees, symbols, seed), _codes(others, trees, symbols, seed)):
        deepest = np.maximum(deepest, np.cumprod(a == b, axis=1).sum(axis=1))
    return deepest


def levels_for(sums: np.ndarray, goal: float) -> np.ndarray:
    """Level at which each query stops: the deepest whose ranges hold ``goal`` rows in all.

    ``sums`` has a row a query and a column a level; level 0 is the whole table once.  Ranges
    that hold as many rows as the table are no better than the table.
    """
    enough = sums >= goal
    enough[:, 0] = True
    level = sums.shape[1] - 1 - enough[:, ::-1].argmax(axis=1)
    return np.where(sums[np.arange(len(sums)), level] >= sums[:, 0], 0, level)


def goal_for(sums: np.ndarray, owner: np.ndarray, depth: np.ndarray, recall: float, least: float) -> float:
    """The smallest goal with which the queries meet the share ``recall`` of their neighbours.

    ``owner`` and ``depth`` have an entry a true neighbour: its query and its level.
    """
    if not len(owner):
        return least
    goals = np.unique(np.append(sums[:, 1:][sums[:, 1:] > least], [least, sums.max() + 1]))
    low, high = 0, len(goals) - 1
    # The greatest goal scans everything; a greater goal never meets fewer.
    while low < high:
        middle = (low + high) // 2
        if (depth >= levels_for(sums, goals[middle])[owner]).mean() >= recall:
            high = middle
        else:
            low = middle + 1
    return float(goals[low])


def _nearest(ids: list[int], vectors: list, k: int):
    """Task function: the best ``k`` of every batch for each of a few queries, by brute force."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for length, same in pdf.groupby(pdf["embedding"].map(len).to_numpy()):
                kin = [i for i, v in enumerate(vectors) if len(v) == length]
                if not kin:
                    continue
                mine = np.asarray(ids)[kin]
                scores = np.asarray([vectors[i] for i in kin], "float64") @ matrix(same["embedding"]).T
                scores[mine[:, None] == same["vec_id"].to_numpy("int64")[None, :]] = -np.inf
                n = min(k, scores.shape[1])
                best = np.argpartition(-scores, n - 1, axis=1)[:, :n]
                value = np.take_along_axis(scores, best, 1)
                q, c = np.nonzero(np.isfinite(value))
                yield pd.DataFrame({
                    "query_id": mine[q], "vec_id": same["vec_id"].to_numpy("int64")[best[q, c]], "score": value[q, c],
                    "embedding": list(same["embedding"].to_numpy()[best[q, c]]),
                })

    return run


def _met(asked: dict[int, list], trees: int, symbols: int, seed: int):
    """Task function: per true neighbour its query and the level at which the search meets it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for _, same in pdf.groupby(pdf["embedding"].map(len).to_numpy()):
                queries = np.asarray([asked[q] for q in same["query_id"]], "float64")
                yield pd.DataFrame({"query_id": same["query_id"], "depth": _depths(queries, matrix(same["embedding"]), trees, symbols, seed)})

    return run


def _measured_goal(classes: DataFrame, found: DataFrame, k: int, trees: int, symbols: int, least: int, seed: int) -> float:
    """Candidates a query needs on this table, from a sample of its queries and brute force.

    The driver receives the sample and counts per query and level, no neighbours.
    """
    # Ids first: every task sends so many of its rows to the driver.
    sample = classes.where("asks").select("vec_id").orderBy(F.xxhash64("vec_id", F.lit(seed)), "vec_id").limit(SAMPLE_QUERIES)
    sampled = F.col("vec_id").isin([r["vec_id"] for r in sample.collect()])
    asked = {r["vec_id"]: r["embedding"] for r in classes.where(sampled).select("vec_id", "embedding").collect()}
    if not asked:
        return least
    kind = classes.schema["embedding"].dataType.simpleString()
    each = classes.select("vec_id", "embedding").mapInPandas(
        _nearest(list(asked), list(asked.values()), k), f"query_id long, vec_id long, score double, embedding {kind}"
    )
    first = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    true = each.withColumn("__at", first).where(F.col("__at") <= k).select("query_id", "embedding")
    met = true.mapInPandas(_met(asked, trees, symbols, seed), "query_id long, depth long").groupBy("query_id", "depth").count().collect()
    number = {q: i for i, q in enumerate(asked)}
    sums = np.zeros((len(asked), symbols + 1))
    held = found.where(sampled).groupBy("vec_id", "level").agg(F.sum("n").alias("n"))
    for r in held.collect():
        sums[number[r["vec_id"]], r["level"]] = r["n"]
    times = np.array([r["count"] for r in met], "int64")
    owner = np.repeat(np.array([number[r["query_id"]] for r in met], "int64"), times)
    depth = np.repeat(np.array([r["depth"] for r in met], "int64"), times)
    return goal_for(sums, owner, depth, RECALL, least)


def _keep(query: np.ndarray, low: np.ndarray, high: np.ndarray, k: int) -> np.ndarray:
    """Places of the pairs that can be among the best ``k`` of their query.

    A pair goes only if ``k`` pairs of its query have a lower bound above its upper one.
    """
    order = np.lexsort((-low, query))
    of = query[order]
    begin = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
    sizes = np.diff(np.append(begin, len(of)))
    least = np.where(sizes >= k, low[order][np.minimum(begin + k, len(of)) - 1], -np.inf)
    return order[high[order] >= np.repeat(least, sizes)]


def _scan(k: int, lows: bool = False):
    """Task function over (block, slice, kind): rows of a block first, then its queries.

    ``least`` is a score that as many others of the query reach as it wants, as far as known.
    With ``lows`` only the ``k`` pairs of the largest lower bounds are returned, block by block.
    """

    def score(rows: list[pd.DataFrame], asks: pd.DataFrame) -> pd.DataFrame | None:
        index = pd.concat(rows)
        small = np.frombuffer(b"".join(index["packed"]), "int8").reshape(len(index), -1).astype("float32")
        queries = np.stack([np.frombuffer(v, "float32") for v in asks["packed"]])
        dims = queries.shape[1]
        if dims != small.shape[1]:
            # Two forests can meet in a block; their ranges never do.
            return None
        at = index["low"].to_numpy("int64")[None, :]
        ids = index["id"].to_numpy("int64")
        scale, off = index["scale"].to_numpy("float64"), index["off"].to_numpy("float64")
        length = np.linalg.norm(small, axis=1) * scale
        # Rounding of sums in single precision.
        slack = dims * 1.2e-7
        found = []
        for begin in range(0, len(asks), SCORED_QUERIES):
            part, those = asks.iloc[begin : begin + SCORED_QUERIES], queries[begin : begin + SCORED_QUERIES]
            mine = part["id"].to_numpy("int64")
            inside = (at >= part["low"].to_numpy("int64")[:, None]) & (at < part["high"].to_numpy("int64")[:, None])
            inside &= mine[:, None] != ids[None, :]
            q_scale, q_off = part["scale"].to_numpy("float64"), part["off"].to_numpy("float64")
            q_length = np.linalg.norm(those, axis=1) * q_scale
            near = (those @ small.T).astype("float64")
            near *= q_scale[:, None]
            near *= scale[None, :]
            error = np.outer(q_off, length + off) + np.outer(q_length, off + slack * length)
            low = np.where(inside, near - error, -np.inf)
            least = part["least"].to_numpy("float64")
            if low.shape[1] > k:
                least = np.maximum(least, np.partition(low, low.shape[1] - k, axis=1)[:, low.shape[1] - k])
            near += error
            q, c = np.nonzero(inside & ((low if lows else near) >= least[:, None]))
            found.append(pd.DataFrame({"query_id": mine[q], "vec_id": ids[c], "low": low[q, c], "high": near[q, c]}))
        return pd.concat(found)

    def merge(found: list[pd.DataFrame]) -> pd.DataFrame:
        """What can be among the best of each query over the blocks of this task, every pair once."""
        both = pd.concat(found, ignore_index=True).drop_duplicates(["query_id", "vec_id"])
        return both.iloc[_keep(both["query_id"].to_numpy(), both["low"].to_numpy(), both["high"].to_numpy(), k)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for found in blocks(batches):
            if lows:
                yield found
                continue
            held.append(found)
            size += len(found)
            if size > HELD_ROWS:
                held = [merge(held)]
                size = len(held[0])
                if size > HELD_ROWS // 2:
                    yield held[0]
                    held, size = [], 0
        if held:
            yield merge(held)

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, rows = None, []
        for pdf in batches:
            for block_key, part in pdf.groupby(["block", "slice"], sort=False):
                if block_key != key:
                    key, rows = block_key, []
                of_index = part["kind"].to_numpy() == 0
                if of_index.any():
                    rows.append(part[of_index])
                asks = part[~of_index]
                # Queries of one length at a time.
                for _, same in asks.groupby(asks["packed"].map(len).to_numpy()) if len(asks) else ():
                    for _, kin in _of_length(rows, len(same["packed"].iloc[0]) // 4):
                        found = score(kin, same)
                        if found is not None and len(found):
                            yield found

    return run


def _scanned(index: DataFrame, probes: DataFrame, k: int, lows: bool = False) -> DataFrame:
    """(query_id, vec_id, low, high): the pairs that can be among the best ``k`` of their query; see ``_scan``."""
    # A block that many queries reach is copied to as many tasks as they need.
    load = probes.groupBy("block").agg(F.ceil(F.count("*") / BLOCK_QUERIES).alias("slices"))
    vector = ["scale", "off", "packed"]
    rows = (
        index.withColumn("block", F.floor(F.col("at") / BLOCK_ROWS)).join(load, "block")
        .withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)))
        .select(
            "block", "slice", F.lit(0).alias("kind"), F.col("vec_id").alias("id"), F.col("at").alias("low"), F.col("at").alias("high"), *vector,
            F.lit(-math.inf).alias("least"),
        )
    )
    asks = probes.join(load, "block").select(
        "block", F.pmod(F.xxhash64("vec_id", "low"), F.col("slices")).alias("slice"), F.lit(1).alias("kind"),
        F.col("vec_id").alias("id"), "low", "high", *vector, "least",
    )
    dealt = rows.union(asks).repartition("block", "slice").sortWithinPartitions("block", "slice", "kind", "low")
    near = dealt.mapInPandas(_scan(k, lows), "query_id long, vec_id long, low double, high double")
    return near.groupBy("query_id", "vec_id").agg(F.max("low").alias("low"), F.min("high").alias("high"))


def _of_length(rows: list[pd.DataFrame], length: int) -> list[tuple[int, list[pd.DataFrame]]]:
    kin = [r[r["packed"].map(len).to_numpy() == length] for r in rows]
    kin = [r for r in kin if len(r)]
    return [(length, kin)] if kin else []


def inner_product(a: Column, b: Column) -> Column:
    """Inner product in double precision, summed in order."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def merged(left: DataFrame, right: DataFrame, on: str | list[str]) -> DataFrame:
    """Join whose sides both grow with the table: neither is ever sent to the driver.

    Spark takes the files of a written table for its size, and neither packed columns (the codes
    and vectors of 40 trees) nor rows made by ``explode`` count in them: it would broadcast
    gigabytes as 10 MB.
    """
    return left.join(right.hint("merge"), on)


def _classes(plain: DataFrame, k: int) -> DataFrame:
    """Equal vectors as one row: its key, whether any of them asks, the ``k`` + 1 smallest ids.

    Only so many rows of a vector leave a task, however often it occurs.  The key (``vec_id``)
    is the smallest id; ``search`` numbers the classes anew where ids have several vectors.
    """
    first = F.row_number().over(W.partitionBy("embedding").orderBy("vec_id"))
    few = plain.select("vec_id", "embedding").withColumn("__at", first).where(F.col("__at") <= k + 1)
    ids = few.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    asks = plain.groupBy("embedding").agg(F.max("asks").alias("asks"))
    return merged(ids, asks, "embedding").select(F.col("ids")[0].alias("vec_id"), "embedding", "asks", "ids")


def search(
    vectors: DataFrame, is_query: Column, k: int = 20, trees: int = TREES, symbols: int | None = None,
    min_candidates: int = MIN_CANDIDATES, seed: int = SEED,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found by largest inner product.

    ``is_query`` selects the queries among the rows; every other row is a candidate.  Needs
    vec_id and embedding.  Null, zero and non-finite vectors and rows without an id take no
    part; rows that repeat both id and vector are one row, unlike vectors of one id are rows of
    their own, as candidates and as queries, and none of them answers its own id.  Equal scores
    go to the smaller id.  Vectors are compared with those of their own length only.  No queries, no rows.

    Equal vectors are one candidate and one query; their ids come back at the end.  Trees ascend
    to at least ``min_candidates`` candidates, and to as many as a sample of the queries needs to
    meet RECALL of its true neighbours.  Candidates are scored on 8-bit copies, block by block of
    the sorted arrays; all that the error of the copies leaves possible are scored again on the
    original vectors.
    """
    good = vectors.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull())
    plain = cut(
        good.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.coalesce(is_query, F.lit(False)).alias("asks"))
        .groupBy("vec_id", "embedding").agg(F.max("asks").alias("asks")),
        "forest-vectors",
    )
    # A query sets aside all vectors of its own id; so many more have to be found.
    repeats = plain.groupBy("vec_id").count().agg(F.max("count")).first()[0] or 1
    wanted, k = k, k + repeats - 1
    classes = _classes(plain, k)
    if repeats > 1:
        classes = numbered(classes, ["vec_id", "embedding"], "__no", leading=1).withColumn("vec_id", F.col("__no")).drop("__no")
    classes = cut(classes, "forest-classes")
    symbols = symbols or symbols_for(classes.count(), trees)
    strings = "vec_id long, tree int, code string, scale double, off double, packed binary"
    sorted_rows = classes.select("vec_id", "embedding").mapInPandas(_strings(trees, symbols, seed, "int8"), strings)
    index = cut(numbered(sorted_rows, ["tree", "code", "vec_id"], "at"), "forest")
    levels = F.explode(F.sequence(F.lit(0), F.lit(symbols)))
    prefix = F.expr("substring(code, 1, if(level = 0, 0, level + 1))")
    # Every prefix is one range of the sorted array: where it begins and how long it is.
    ranges = (
        index.select("tree", "code", "at").withColumn("level", levels).withColumn("prefix", prefix)
        .groupBy("tree", "level", "prefix").agg(F.min("at").alias("low"), F.count("*").alias("n"))
    )
    asked = classes.where("asks").select("vec_id", "embedding").mapInPandas(_strings(trees, symbols, seed, "float32"), strings)
    asked = cut(asked, "forest-queries")
    steps = asked.select("vec_id", "tree", "code").withColumn("level", levels).withColumn("prefix", prefix)
    found = cut(merged(steps, ranges, ["tree", "level", "prefix"]).select("vec_id", "tree", "level", "low", "n"), "forest-ranges")
    # At the root one tree holds everything.
    root = found.where((F.col("level") > 0) | (F.col("tree") % 4096 == 0))
    goal = _measured_goal(classes, root, k, trees, symbols, min_candidates, seed)
    sums = root.groupBy("vec_id", "level").agg(F.sum("n").alias("n"))
    # As levels_for: the deepest level that holds enough, but the root if that one holds no less.
    stop = sums.groupBy("vec_id").agg(
        F.max(F.when((F.col("n") >= goal) | (F.col("level") == 0), F.struct("level", "n"))).alias("stop"),
        F.max(F.when(F.col("level") == 0, F.col("n"))).alias("all"),
    ).select("vec_id", F.when(F.col("stop.n") >= F.col("all"), 0).otherwise(F.col("stop.level")).alias("level"))
    ends = F.col("low") + F.col("n")
    blocks = F.explode(F.sequence(F.floor(F.col("low") / BLOCK_ROWS), F.floor((ends - 1) / BLOCK_ROWS)))
    probes = root.join(stop, ["vec_id", "level"]).withColumn("high", ends).withColumn("block", blocks)
    probes = cut(probes.select("vec_id", "block", "low", "high"), "forest-probes")
    whole = asked.where(F.col("tree") % 4096 == 0).select("vec_id", "scale", "off", "packed")
    # The rows next to the query in a few trees give a score that its best ones reach: without it
    # every task would return ``k`` pairs of every query.
    own = root.where((F.col("tree") % 4096 < FIRST_TREES) & (F.col("level") == symbols)).select("vec_id", F.col("low").alias("__own"))
    beside = merged(probes, own.withColumn("block", F.floor(F.col("__own") / BLOCK_ROWS)), ["vec_id", "block"])
    beside = merged(beside.where((F.col("low") <= F.col("__own")) & (F.col("__own") < F.col("high"))).drop("__own"), whole, "vec_id")
    first = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("low").desc()))
    beside = cut(beside.withColumn("least", F.lit(-math.inf)), "forest-beside")
    seen = _scanned(index, beside, math.ceil(FIRST_SHARES * k / FIRST_TREES), lows=True).withColumn("__at", first)
    reached = seen.where(F.col("__at") == k).select(F.col("query_id").alias("vec_id"), F.col("low").alias("least"))
    whole = whole.join(reached.hint("merge"), "vec_id", "left").fillna(-math.inf, ["least"])
    once = _scanned(index, cut(merged(probes, whole, "vec_id"), "forest-asks"), k)
    of_query = W.partitionBy("query_id")
    nth = once.withColumn("__at", F.row_number().over(of_query.orderBy(F.col("low").desc())))
    bound = F.max(F.when(F.col("__at") == k, F.col("low"))).over(of_query)
    short = nth.withColumn("__least", bound).where(F.col("__least").isNull() | (F.col("high") >= F.col("__least"))).select("query_id", "vec_id")
    left = classes.where("asks").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("__q"))
    score = inner_product(F.col("__q"), F.col("embedding")).alias("score")
    others = merged(merged(short, left, "query_id"), classes.select("vec_id", "embedding", "ids"), "vec_id").select("query_id", "vec_id", "ids", score)
    best = F.row_number().over(of_query.orderBy(F.col("score").desc(), "vec_id"))
    others = others.withColumn("__at", best).where(F.col("__at") <= k).select("query_id", "ids", "score")
    # The equals of a query are candidates too.
    equals = classes.where("asks").select(F.col("vec_id").alias("query_id"), "ids", inner_product(F.col("embedding"), F.col("embedding")).alias("score"))
    # Per class one id more than asked for: a query is not its own neighbour.
    each = others.union(equals).select("query_id", "score", F.explode("ids").alias("id"))
    ranked = each.withColumn("__at", F.row_number().over(of_query.orderBy(F.col("score").desc(), "id"))).where(F.col("__at") <= k + 1)
    lists = ranked.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("__at", "id", "score"))).alias("list"))
    answers = merged(left, lists, "query_id").select(F.col("__q").alias("embedding"), "list")
    mine = merged(plain.where("asks").select(F.col("vec_id").alias("query_id"), "embedding"), answers, "embedding")
    rest = F.slice(F.filter("list", lambda x: x["id"] != F.col("query_id")), 1, wanted)
    ranks = mine.select("query_id", F.posexplode(rest).alias("__no", "__hit"))
    return ranks.select("query_id", (F.col("__no") + 1).alias("rank"), F.col("__hit.id").alias("vec_id"), F.col("__hit.score").alias("score"))
