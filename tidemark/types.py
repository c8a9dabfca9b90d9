"""Value types of features and their Spark types."""

from __future__ import annotations

from pyspark.sql import types as T

from .errors import SpecError

# Value type name -> Spark type.
SPARK_TYPES = {
    "bool": T.BooleanType(),
    "int8": T.ByteType(),
    "int16": T.ShortType(),
    "int32": T.IntegerType(),
    "int": T.LongType(),
    "int128": T.DecimalType(38, 0),
    "uint8": T.ShortType(),
    "uint16": T.IntegerType(),
    "uint32": T.LongType(),
    "uint64": T.DecimalType(20, 0),
    "uint128": T.DecimalType(38, 0),
    "float16": T.FloatType(),
    "float": T.DoubleType(),
    "float32": T.FloatType(),
    "bfloat16": T.FloatType(),
    "bytes": T.BinaryType(),
    "str": T.StringType(),
    "datetime": T.TimestampType(),
    "bool_list": T.ArrayType(T.BooleanType()),
    "int_list": T.ArrayType(T.LongType()),
    "float_list": T.ArrayType(T.DoubleType()),
    "str_list": T.ArrayType(T.StringType()),
    "datetime_list": T.ArrayType(T.TimestampType()),
}

# Integer type name -> (bits, signed).
INTEGER_BITS = {
    **{f"int{b}": (b, True) for b in (8, 16, 32, 128)},
    "int": (64, True),
    **{f"uint{b}": (b, False) for b in (8, 16, 32, 64, 128)},
}


def integer_bounds(name: str) -> tuple[int, int]:
    bits, signed = INTEGER_BITS[name]
    return (-(2 ** (bits - 1)), 2 ** (bits - 1) - 1) if signed else (0, 2**bits - 1)


def spark_type(name: str) -> T.DataType:
    if name not in SPARK_TYPES:
        raise SpecError(f"unknown value type {name!r}")
    return SPARK_TYPES[name]


def value_type(data_type: T.DataType) -> str:
    """Value type inferred from a Spark type (all integers infer as ``int``)."""
    if isinstance(data_type, T.BooleanType):
        return "bool"
    if isinstance(data_type, T.IntegralType):
        return "int"
    if isinstance(data_type, (T.FloatType, T.DoubleType)):
        return "float"
    if isinstance(data_type, T.DecimalType):
        return "decimal"
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "datetime"
    if isinstance(data_type, T.BinaryType):
        return "bytes"
    if isinstance(data_type, T.ArrayType):
        return "list"
    if isinstance(data_type, (T.MapType, T.StructType)):
        return "dict"
    if isinstance(data_type, (T.DayTimeIntervalType, T.YearMonthIntervalType)):
        return "int"
    return "str"


def orderable(data_type: T.DataType) -> bool:
    """Whether values of the type can be compared (maps cannot)."""
    if isinstance(data_type, T.ArrayType):
        return orderable(data_type.elementType)
    if isinstance(data_type, T.StructType):
        return all(orderable(f.dataType) for f in data_type)
    return not isinstance(data_type, (T.MapType, T.VariantType))
