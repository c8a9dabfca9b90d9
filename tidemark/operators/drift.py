"""Histogram drift: distances between two distributions and their status.

Histograms are arrays of one entry per bin, so a distance is a single expression per
(endpoint, window, feature) row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import SpecError
from .stats import MAX_FLOAT, as_number, settled_bin

METRICS = ("tvd", "hellinger", "kld")

# Result kinds and statuses.
RESULT_KINDS = {
    "data_drift": 0,
    "concept_drift": 1,
    "model_performance": 2,
    "system_performance": 3,
    "mm_app_anomaly": 4,
}
STATUSES = {"irrelevant": -1, "no_detection": 0, "potential_detection": 1, "detected": 2}


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def tvd(p: Column, q: Column) -> Column:
    """Total variance distance."""
    return _total(F.zip_with(p, q, lambda a, b: F.abs(a - b))) / 2


def hellinger(p: Column, q: Column) -> Column:
    overlap = _total(F.zip_with(p, q, lambda a, b: F.sqrt(a * b)))
    return F.sqrt(F.greatest(1 - overlap, F.lit(0.0)))


def kld(p: Column, q: Column, zero_scaling: float = 1e-4, cap: float | None = None) -> Column:
    """Symmetric Kullback-Leibler divergence; an empty bin of the other side is scaled up."""

    def one_way(a: Column, b: Column) -> Column:
        filled = F.when(b == 0, F.lit(zero_scaling)).otherwise(b)
        return F.when(a == 0, F.lit(0.0)).otherwise(a * F.log(a / filled))

    value = _total(F.zip_with(p, q, one_way)) + _total(F.zip_with(q, p, one_way))
    if cap is None:
        return value
    return F.when(value == F.lit(float("inf")), F.lit(float(cap))).otherwise(value)


DISTANCES = {"tvd": tvd, "hellinger": hellinger, "kld": kld}


def counts_array(hist: DataFrame, groups: list[str] | None = None) -> DataFrame:
    """(groups, column, counts, total) from a long (column, bin, n) histogram."""
    return (
        hist.groupBy(*(groups or []), "column")
        .agg(
            F.transform(
                F.sort_array(F.collect_list(F.struct("bin", "n"))), lambda c: c["n"]
            ).alias("counts"),
            F.sum("n").alias("total"),
        )
    )


def normalize(counts: DataFrame) -> DataFrame:
    """Add ``p``: counts as shares of the total."""
    total = F.greatest(F.col("total"), F.lit(1)).cast("double")
    return counts.withColumn("p", F.transform("counts", lambda c: c / total))


def per_feature(
    sample: DataFrame,
    reference: DataFrame,
    groups: list[str] | None = None,
    reference_groups: list[str] | None = None,
) -> DataFrame:
    """Distances of every feature that has reference data.

    ``sample`` and ``reference`` come from ``counts_array``; ``reference_groups`` are the
    groups (a subset of ``groups``) that have a reference of their own.
    """
    groups, shared = groups or [], [*(reference_groups or []), "column"]
    left = normalize(sample).select(*groups, "column", "p", "total")
    right = normalize(reference).select(
        *[F.col(c).alias(f"__{c}") for c in shared], F.col("p").alias("q")
    )
    match = reduce(lambda a, b: a & b, [F.col(c) == F.col(f"__{c}") for c in shared])
    joined = left.join(right, match).drop(*[f"__{c}" for c in shared])
    return joined.select(
        *groups,
        "column",
        "total",
        *[DISTANCES[m](F.col("p"), F.col("q")).alias(m) for m in METRICS],
    )


# Sums of shares may leave [0, 1] by the last bits.
ROUNDING = 1e-9


def check_thresholds(potential: float, detected: float) -> None:
    if not 0 < potential < detected < 1:
        raise SpecError("thresholds must satisfy 0 < potential < detected < 1")


def classify(value: Column, potential: float = 0.5, detected: float = 0.7) -> Column:
    """2 detected, 1 potential, 0 none; a value outside [0, 1] beyond rounding is an error."""
    check_thresholds(potential, detected)
    problem = F.concat(F.lit("drift value outside [0, 1]: "), value.cast("string"))
    return (
        F.when((value < -ROUNDING) | (value > 1 + ROUNDING), F.raise_error(problem).cast("int"))
        .when(value >= detected, F.lit(STATUSES["detected"]))
        .when(value >= potential, F.lit(STATUSES["potential_detection"]))
        .otherwise(F.lit(STATUSES["no_detection"]))
    )


def general(
    features: DataFrame,
    groups: list[str] | None = None,
    potential: float = 0.5,
    detected: float = 0.7,
) -> DataFrame:
    """Mean of each distance over the features, the general drift value and its status."""
    means = features.groupBy(*(groups or [])).agg(
        *[F.avg(m).alias(f"{m}_mean") for m in METRICS]
    )
    value = (F.col("hellinger_mean") + F.col("tvd_mean")) / 2
    return means.withColumn("general_drift", value).withColumn(
        "status", classify(F.col("general_drift"), potential, detected)
    )


def drift_table(
    sample_stats: DataFrame,
    input_stats: DataFrame,
    features: DataFrame,
    potential: float = 0.5,
    detected: float = 0.7,
    groups: list[str] | None = None,
) -> DataFrame:
    """One row per group (endpoint) and feature: mean/min/max of both sides, distances, status."""
    keys = [*(groups or []), "column"]

    def side(stats: DataFrame, name: str) -> DataFrame:
        return stats.select(*keys, *[F.col(s).alias(f"{name}_{s}") for s in ("mean", "min", "max")])

    value = (F.col("hellinger") + F.col("tvd")) / 2
    return (
        features.select(*keys, *METRICS)
        .join(side(sample_stats, "sample"), keys)
        .join(side(input_stats, "input"), keys)
        .withColumn("status", classify(value, potential, detected))
    )


def histogram_per_group(
    df: DataFrame, groups: list[str], edges: DataFrame, edge_groups: list[str]
) -> DataFrame:
    """Counts per (groups, column, bin) where every ``edge_groups`` has edges of its own.

    ``edges`` is (edge_groups, column, edges), one row per endpoint and feature, with equal
    widths.  All endpoints and windows are one plan.  The edges of an endpoint are one row, so
    rows meet them before they are split into features; features are counted where they are
    split, and the shuffle carries bin counts.
    """
    names = [c for c in df.columns if c not in groups]
    size = F.size("edges")
    padded = (F.get("edges", F.lit(0)) == -MAX_FLOAT) & (F.get("edges", size - 1) == MAX_FLOAT)
    inner = F.when(padded, F.slice("edges", F.lit(2), size - 2)).otherwise(F.col("edges"))
    layout = F.struct(
        F.col("bounds"), F.col("padded"), (F.size("bounds") - 1).alias("bins"),
        F.element_at("bounds", 1).alias("low"), F.element_at("bounds", -1).alias("high"),
        ((F.element_at("bounds", -1) - F.element_at("bounds", 1)) / (F.size("bounds") - 1)).alias("width"),
    )
    layouts = (
        edges.select(*edge_groups, "column", inner.alias("bounds"), padded.alias("padded"))
        .groupBy(*edge_groups)
        .agg(F.map_from_entries(F.collect_list(F.struct("column", layout))).alias("__layouts"))
    )
    cells = F.array(
        *[
            F.struct(F.lit(n).alias("column"), as_number(df, n).alias("x"), F.try_element_at("__layouts", F.lit(n)).alias("l"))
            for n in names
        ]
    )
    placed = (
        df.join(layouts, edge_groups)
        .select(*groups, F.inline(cells))
        .where(F.col("x").isNotNull() & F.col("l").isNotNull())
        .select(*groups, "column", "x", "l.*")
        .withColumn(
            "p",
            F.when(
                F.col("x").between(F.col("low"), F.col("high")),
                F.floor((F.col("x") - F.col("low")) / F.col("width")).cast("int"),
            ),
        )
    )
    bin_ = settled_bin(
        F.col("x"), F.col("p"), F.col("bounds"), F.col("bins"), F.col("low"), F.col("high"),
        F.col("padded"), F.col("padded").cast("int"),
    )
    counted = (
        placed.withColumn("bin", bin_)
        .where(F.col("bin").isNotNull())
        .groupBy(*groups, "column", "bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    wide = counted.groupBy(*groups, "column").agg(
        F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("m")
    )
    sized = edges.select(*edge_groups, "column", (F.size("edges") - 1).alias("bins"))
    full = F.transform(
        F.sequence(F.lit(0), F.col("bins") - 1),
        lambda b: F.struct(b.alias("bin"), F.coalesce(F.element_at("m", b), F.lit(0)).cast("long").alias("n")),
    )
    return wide.join(sized, [*edge_groups, "column"]).select(*groups, "column", F.inline(full))
