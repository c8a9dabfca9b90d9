"""Distributed numbering: global row numbers without gathering the rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut


def before(df: DataFrame, value: str, order: list, out: str, group: list | None = None) -> DataFrame:
    """Sum of ``value`` over the rows that come earlier in ``order`` (within ``group``).

    For small tables of per-part sums; rows themselves go through ``numbered``.
    """
    frame = W.partitionBy(*(group or [])).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return df.withColumn(out, F.coalesce(F.sum(value).over(frame), F.lit(0)))


def numbered(df: DataFrame, order: list[Column | str], out: str, leading: int | None = None) -> DataFrame:
    """``df`` with its row number in ``order`` from 0, computed by range parts.

    Rows are dealt by range, each part is numbered on its own and shifted by the rows of the
    parts before it.  The parts are written once, so a lost executor cannot deal them anew.
    Rows that are equal in ``order`` share a part; give enough columns that this is small.
    The driver holds a sample of the columns that rows are dealt by; ``leading`` is how many of
    ``order`` these are (all by default), if the others are large.  An empty table stays empty.
    """
    ranged = df.repartitionByRange(*order[:leading]).withColumn("__part", F.spark_partition_id())
    stored = cut(ranged, "numbered")
    sizes = before(stored.groupBy("__part").agg(F.count("*").alias("__n")), "__n", ["__part"], "__before")
    inner = F.row_number().over(W.partitionBy("__part").orderBy(*order)) - 1
    return (
        stored.withColumn("__at", inner)
        .join(sizes.drop("__n"), "__part")
        .withColumn(out, (F.col("__before") + F.col("__at")).cast("long"))
        .drop("__part", "__at", "__before")
    )
