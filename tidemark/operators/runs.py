"""Run tables: flattening of parameters and results, and picking the best run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import SpecError


# Columns that a flattened map may have.
MAX_KEYS = 2000


def expand_iterations(runs: DataFrame, iterations: str = "iterations") -> DataFrame:
    """One row per iteration; runs without iterations stay one row.

    ``iterations`` is an array of structs (iter, state, parameters, results).
    """
    fields = ("iter", "state", "parameters", "results")
    rows = runs.withColumn("__i", F.explode_outer(iterations)).drop(iterations)
    return rows.withColumns(
        {f: F.when(F.col("__i").isNotNull(), F.col(f"__i.{f}")).otherwise(F.col(f)) for f in fields}
    ).drop("__i")


def flatten_maps(df: DataFrame, maps: dict[str, tuple[str, list[str]]]) -> DataFrame:
    """Turn map columns into ``{prefix}{key}`` columns: ``{column: (prefix, keys)}``."""
    added = {
        f"{prefix}{key}": F.try_element_at(F.col(column), F.lit(key))
        for column, (prefix, keys) in maps.items()
        for key in keys
    }
    return df.withColumns(added).drop(*maps)


def map_keys_of(df: DataFrame, column: str, most: int = MAX_KEYS) -> list[str]:
    """Distinct keys of a map column: the column list of the flattened table.

    More than ``most`` different keys are refused: they would be that many columns.
    """
    keys = df.select(F.explode(F.map_keys(column)).alias("k")).distinct()
    rows = keys.limit(most + 1).collect()
    if len(rows) > most:
        raise SpecError(f"{column} has {keys.count()} different keys; {most} columns at most, or name the keys")
    return sorted(r["k"] for r in rows)


def best_run(
    df: DataFrame, criteria: str, value: Column, state: str = "state", order: str = "iter",
    groups: list[str] | None = None,
) -> DataFrame:
    """Best row by ``[min|max.]metric``: failed rows are skipped, the first wins ties."""
    op, dot, _ = criteria.rpartition(".")
    op = op if dot else "max"
    if op not in ("min", "max"):
        raise SpecError(f"selector {criteria!r} must be [min.|max.]<metric>")
    number = value.try_cast("double")
    usable = df.withColumn("__v", number).where(
        F.col("__v").isNotNull() & ~F.isnan("__v") & (F.col(state) != "error")
    )
    rank = F.struct((F.col("__v") if op == "max" else -F.col("__v")).alias("v"), (-F.col(order)).alias("o"))
    best = usable.groupBy(*(groups or [])).agg(F.max_by(F.struct(*df.columns), rank).alias("__b"))
    return best.where(F.col("__b").isNotNull()).select("__b.*")
