"""Feature validators: rows stay, violations are counted in one pass."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import SpecError
from ..types import INTEGER_BITS, integer_bounds, spark_type


@dataclass(frozen=True)
class Validator:
    """Checks that a value fits its declared type (nulls pass)."""

    value_type: str | None = None
    severity: str = "info"

    def violation(self, column: Column, data_type: T.DataType) -> Column:
        return self.type_violation(column, data_type)

    def type_violation(self, column: Column, data_type: T.DataType) -> Column:
        if self.value_type is None:
            return F.lit(False)
        if self.value_type in INTEGER_BITS:
            low, high = integer_bounds(self.value_type)
            wide = 10**38 - 1
            number = column.try_cast(T.DecimalType(38, 0))
            fits = number.between(
                F.lit(str(max(low, -wide))).cast(T.DecimalType(38, 0)),
                F.lit(str(min(high, wide))).cast(T.DecimalType(38, 0)),
            )
            return column.isNotNull() & ~F.coalesce(fits, F.lit(False))
        converted = column.try_cast(spark_type(self.value_type))
        return column.isNotNull() & converted.isNull()


@dataclass(frozen=True)
class MinMax(Validator):
    """Value range; a null violates as soon as a bound is set, NaN passes."""

    low: float | None = None
    high: float | None = None

    def violation(self, column, data_type):
        bad = self.type_violation(column, data_type)
        if self.low is None and self.high is None:
            return bad
        number = isinstance(data_type, (T.FloatType, T.DoubleType))
        beyond = column.isNull()
        if self.low is not None:
            beyond = beyond | F.coalesce(column < F.lit(self.low), F.lit(False))
        if self.high is not None:
            over = F.coalesce(column > F.lit(self.high), F.lit(False))
            beyond = beyond | (over & ~F.isnan(column) if number else over)
        return bad | beyond


@dataclass(frozen=True)
class MinMaxLen(Validator):
    """Length range of text, bytes or an array."""

    low: int | None = None
    high: int | None = None

    def violation(self, column, data_type):
        bad = self.type_violation(column, data_type)
        if self.low is None and self.high is None:
            return bad
        if isinstance(data_type, (T.ArrayType, T.MapType)):
            size = F.size(column)
        elif isinstance(data_type, T.BinaryType):
            size = F.octet_length(column)
        else:
            size = F.char_length(column.cast("string"))
        beyond = column.isNull()
        if self.low is not None:
            beyond = beyond | F.coalesce(size < self.low, F.lit(False))
        if self.high is not None:
            beyond = beyond | F.coalesce(size > self.high, F.lit(False))
        return bad | beyond


@dataclass(frozen=True)
class Regex(Validator):
    """Full match of a regular expression."""

    pattern: str | None = None

    def violation(self, column, data_type):
        bad = self.type_violation(column, data_type)
        if self.pattern is None:
            return bad
        matched = column.cast("string").rlike(rf"\A(?:{self.pattern})\z")
        return bad | ~F.coalesce(matched, F.lit(False))


def violations(df: DataFrame, validators: dict[str, Validator]) -> dict[str, Column]:
    missing = [c for c in validators if c not in df.columns]
    if missing:
        raise SpecError(f"columns {missing} to validate are not in the data")
    return {
        name: v.violation(F.col(name), df.schema[name].dataType) for name, v in validators.items()
    }


def tallies(df: DataFrame, validators: dict[str, Validator]) -> list[Column]:
    """Aggregates per feature: violation count and the smallest violating value."""
    aggs = []
    for i, (name, condition) in enumerate(violations(df, validators).items()):
        aggs.append(F.count_if(condition).alias(f"__n{i}"))
        aggs.append(F.min(F.when(condition, F.col(name).cast("string"))).alias(f"__e{i}"))
    return aggs


def report(df: DataFrame, validators: dict[str, Validator]) -> DataFrame:
    """One row per feature: violation count and the smallest violating value."""
    rows = F.array(
        *[
            F.struct(
                F.lit(name).alias("feature"),
                F.lit(v.severity).alias("severity"),
                F.col(f"__n{i}").alias("violations"),
                F.col(f"__e{i}").alias("example"),
            )
            for i, (name, v) in enumerate(validators.items())
        ]
    )
    return df.agg(*tallies(df, validators)).select(F.inline(rows))


def flag(df: DataFrame, validators: dict[str, Validator], out: str = "violated") -> DataFrame:
    """Keep all rows, list the features each one violates."""
    bad = violations(df, validators)
    names = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in bad.items()]))
    return df.withColumn(out, names)
