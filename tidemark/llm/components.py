"""Connected components of a link table, without a driver-side graph."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

MAX_ROUNDS = 60


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star forest with the components of the links ``a - b``: (node, smallest node)."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        for side in (x, y):
            np.minimum.at(new, label[side], low)
            np.minimum.at(new, side, low)
        while True:
            jumped = new[new]
            if np.array_equal(jumped, new):
                break
            new = jumped
        if np.array_equal(new, label):
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _contract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        high, low = forest(pdf["a"].to_numpy("int64"), pdf["b"].to_numpy("int64"))
        yield pd.DataFrame({"a": high, "b": low})


def _stars(links: DataFrame) -> DataFrame:
    """One large-star and one small-star step; links run from the larger to the smaller id."""
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    large = (
        both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    )
    least = large.groupBy("a").agg(F.min("b").alias("m"))
    moved = large.join(least, "a")
    return (
        moved.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        .union(least.select("a", F.col("m").alias("b")))
        .distinct()
    )


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node that has a link; the component is its smallest node.

    Links are long ids.  Batches of links are first reduced to star forests in place, then
    large-star and small-star steps alternate until nothing changes; each round is written to
    the shared folder, which cuts the lineage.  Null ends and self links are left out; no
    links give an empty table.
    """
    plain = links.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b"))
    state = cut(
        plain.where("a <> b").mapInPandas(_contract, "a long, b long").distinct(), "components"
    )
    seen = None
    for _ in range(MAX_ROUNDS):
        mark = state.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if mark == seen or not mark[0]:
            break
        seen = mark
        state = cut(_stars(state), "components")
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    pairs = state.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return pairs.union(pairs.select("component", "component").distinct())
