"""Statistics of a table that grows: stored per increment, merged instead of a rescan.

An increment is summarized as one small row per column: moments, a quantile sketch (KLL) and a
distinct-value sketch (HyperLogLog).  Merged rows have the same form, so they may be merged again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..errors import SpecError
from .stats import as_number

# Sizes of the sketches, and what follows: a quantile is off by this share of the rows (99 % sure),
# a distinct count by this share of itself (three standard errors).
KLL_SIZE, RANK_ERROR = 2000, 0.002
HLL_LOG_SIZE, DISTINCT_ERROR = 14, 0.025
QUANTILES = {"p25": 0.25, "p50": 0.5, "p75": 0.75}


def summarize(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per column of an increment: rows, count, mean, m2, min, max and two sketches.

    All columns are summarized in one pass, partially where the rows are.  Times count as epoch
    seconds, booleans as 0 and 1; nulls and NaN count as rows only.  ``m2`` is the sum of
    squared differences from the mean.
    """
    missing = [c for c in columns if c not in df.columns]
    if missing or not columns:
        raise SpecError(f"columns {missing} are not in the data" if missing else "no columns to summarize")
    numbers = df.select(*[as_number(df, c).alias(f"__{i}") for i, c in enumerate(columns)])
    aggs, rows = [F.count(F.lit(1)).alias("rows")], []
    for i, name in enumerate(columns):
        x = F.col(f"__{i}")
        # The sketch takes no doubles; -0.0 and 0.0 are one value.
        key = F.when(x.isNotNull(), F.xxhash64(x + F.lit(0.0)))
        each = {
            "count": F.count(x), "mean": F.avg(x), "m2": F.var_pop(x) * F.count(x), "min": F.min(x), "max": F.max(x),
            "quantiles": F.kll_sketch_agg_double(x, F.lit(KLL_SIZE)), "distinct": F.hll_sketch_agg(key, F.lit(HLL_LOG_SIZE)),
        }
        aggs += [value.alias(f"{part}{i}") for part, value in each.items()]
        rows.append(F.struct(F.lit(name).alias("column"), F.col("rows"), *[F.col(f"{p}{i}").alias(p) for p in each]))
    return numbers.agg(*aggs).select(F.inline(F.array(*rows)))


def merge(summaries: DataFrame) -> DataFrame:
    """Summaries of several increments as one: same rows as of the union, but for the sketches' errors."""
    whole = W.partitionBy("column")
    total = F.sum("count").over(whole)
    mean = F.sum(F.col("mean") * F.col("count")).over(whole) / F.when(total > 0, total)
    centred = summaries.withColumn("__mean", mean)
    # Around the common mean, so that large means lose no digits.
    spread = F.col("m2") + F.col("count") * F.pow(F.col("mean") - F.col("__mean"), 2)
    return centred.groupBy("column").agg(
        F.sum("rows").alias("rows"), F.sum("count").alias("count"), F.max("__mean").alias("mean"),
        F.sum(spread).alias("m2"), F.min("min").alias("min"), F.max("max").alias("max"),
        F.kll_merge_agg_double("quantiles", F.lit(KLL_SIZE)).alias("quantiles"), F.hll_union_agg("distinct").alias("distinct"),
    )


def describe(summary: DataFrame, quantiles: dict[str, float] = QUANTILES) -> DataFrame:
    """(column, rows, count, mean, std, min, max, quantiles, distinct) of merged summaries.

    Quantiles and distinct counts are within RANK_ERROR and DISTINCT_ERROR; the rest is exact.
    A column without values has nulls and zero counts.
    """
    known = F.col("count") > 0
    std = F.when(F.col("count") > 1, F.sqrt(F.col("m2") / (F.col("count") - 1)))
    ranks = [F.when(known, F.kll_sketch_get_quantile_double("quantiles", F.lit(p))).alias(n) for n, p in quantiles.items()]
    return summary.select(
        "column", "rows", "count", "mean", std.alias("std"), "min", "max", *ranks, F.hll_sketch_estimate("distinct").alias("distinct")
    )
