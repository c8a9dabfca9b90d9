"""Feature engineering steps: each takes a frame and returns a frame."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import SpecError
from ..functions.names import category_name
from ..specs import FeatureSet


def _literal_type(df: DataFrame, values) -> T.DataType:
    """Type all mapped values share; a number mix widens to double, else to string."""
    kinds = {type(v) for v in values if v is not None}
    if kinds <= {bool}:
        return T.BooleanType()
    if kinds <= {int}:
        return T.LongType() if any(abs(v) > 2**31 - 1 for v in values if v is not None) else T.IntegerType()
    if kinds <= {int, float}:
        return T.DoubleType()
    return T.StringType()


def _same_family(a: T.DataType, b: T.DataType) -> bool:
    numeric = (T.NumericType,)
    return type(a) is type(b) or (isinstance(a, numeric) and isinstance(b, numeric))


def _number(bound):
    return {"inf": math.inf, "-inf": -math.inf}.get(bound, bound)


def _range_chain(column: Column, ranges: dict) -> Column:
    chain = None
    for label, (low, high) in ranges.items():
        low, high = _number(low), _number(high)
        inside = F.lit(True)
        if low != -math.inf:
            inside = inside & (column >= F.lit(low))
        if high != math.inf:
            inside = inside & (column < F.lit(high))
        inside = inside & column.isNotNull()
        chain = F.when(inside, F.lit(label)) if chain is None else chain.when(inside, F.lit(label))
    return chain


def map_values(
    df: DataFrame,
    mapping: dict[str, dict],
    with_original: bool = False,
    suffix: str = "mapped",
) -> DataFrame:
    """Replace values by dictionary or by ``{"ranges": {label: [low, high)}}``.

    A value the dictionary does not name is kept.  If the mapped type differs, every value
    must be named: the frame then fails at run time on the first other non-null value.
    Without originals the result has only the mapped columns.
    """
    missing = [c for c in mapping if c not in df.columns]
    if missing:
        raise SpecError(f"columns {missing} to map are not in the data")
    mapped = {}
    for name, rule in mapping.items():
        column, source = F.col(name), df.schema[name].dataType
        if "ranges" in rule:
            labels = list(rule["ranges"])
            chain = _range_chain(column, rule["ranges"])
            if with_original:
                mapped[name] = chain
                continue
            target = _literal_type(df, labels)
            keep = column if _same_family(source, target) else column.cast("string")
            if not _same_family(source, target) and not isinstance(target, T.StringType):
                raise SpecError(f"range labels of {name!r} must be text or match its type")
            mapped[name] = F.coalesce(chain, keep)
            continue
        target = _literal_type(df, rule.values())
        chain = None
        for old, new in rule.items():
            hit = column.eqNullSafe(F.lit(old)) if old is None else column == F.lit(old)
            value = F.lit(new).cast(target)
            chain = F.when(hit, value) if chain is None else chain.when(hit, value)
        if _same_family(source, target):
            mapped[name] = chain.otherwise(column)
        else:
            problem = F.concat(F.lit(f"value of {name} has no mapping: "), column.cast("string"))
            mapped[name] = chain.when(column.isNull(), F.lit(None).cast(target)).otherwise(
                F.raise_error(problem).cast(target)
            )
    if with_original:
        return df.withColumns({f"{n}_{suffix}": c for n, c in mapped.items()})
    return df.select(*[c.alias(n) for n, c in mapped.items()])


def impute(df: DataFrame, mapping: dict | None = None, default=None) -> DataFrame:
    """Fill null and NaN by column, other columns with ``default`` where its type fits."""
    mapping = mapping or {}
    unknown = [c for c in mapping if c not in df.columns]
    if unknown:
        raise SpecError(f"columns {unknown} to impute are not in the data")
    filled = {}
    for field in df.schema:
        value = mapping.get(field.name, default)
        if value is None or (field.name not in mapping and not _fits(field.dataType, value)):
            continue
        column = F.col(field.name)
        if isinstance(field.dataType, (T.FloatType, T.DoubleType)):
            column = F.when(F.isnan(column), None).otherwise(column)
        filled[field.name] = F.coalesce(column, F.lit(value).cast(field.dataType))
    return df.withColumns(filled) if filled else df


def _fits(data_type: T.DataType, value) -> bool:
    if isinstance(value, bool):
        return isinstance(data_type, T.BooleanType)
    if isinstance(value, (int, float)):
        return isinstance(data_type, T.NumericType)
    return isinstance(data_type, T.StringType)


def impute_with_stats(
    df: DataFrame, policy: dict, stats: DataFrame, features: list[str] | None = None
) -> DataFrame:
    """Fill null, NaN and infinities by constant or ``$mean/$min/$max/$std/$count``.

    ``stats`` is the small per-column statistics table (one row per column); ``*`` is the
    default for the other features.
    """
    names = features or list(df.columns)
    unknown = [c for c in policy if c != "*" and c not in names]
    if unknown:
        raise SpecError(f"features {unknown} of the impute policy are not in the vector")
    chosen = {n: policy.get(n, policy.get("*")) for n in names}
    chosen = {n: v for n, v in chosen.items() if v is not None}
    named = {n: v[1:] for n, v in chosen.items() if isinstance(v, str) and v.startswith("$")}
    if named:
        # One small row per column of the data; read once on the driver.
        picked = stats.where(F.col("column").isin(list(named)))
        known = {r["column"]: r for r in picked.select("column", *set(named.values())).collect()}
        chosen |= {n: known[n][stat] for n, stat in named.items()}
    filled = {}
    for name, value in chosen.items():
        data_type = df.schema[name].dataType
        column = F.col(name)
        bad = column.isNull()
        if isinstance(data_type, (T.FloatType, T.DoubleType)):
            bad = bad | F.isnan(column) | (F.abs(column) == F.lit(math.inf))
        filled[name] = F.when(bad, F.lit(value).cast(data_type)).otherwise(column)
    return df.withColumns(filled) if filled else df


def one_hot(df: DataFrame, mapping: dict[str, list]) -> DataFrame:
    """Replace each column by 0/1 columns ``{column}_{category}``."""
    added: dict[str, Column] = {}
    for name, categories in mapping.items():
        for value in dict.fromkeys(categories):
            out = f"{name}_{category_name(value)}"
            if out in added or (out in df.columns and out not in mapping):
                raise SpecError(f"one-hot column {out!r} occurs twice")
            added[out] = F.coalesce((F.col(name) == F.lit(value)).cast("int"), F.lit(0))
    kept = [c for c in df.columns if c not in mapping]
    return df.select(*kept, *[c.alias(n) for n, c in added.items()])


def drop_features(df: DataFrame, features: list[str], feature_set: FeatureSet) -> DataFrame:
    """Drop columns, but never an entity, the label or the time column."""
    special = {*feature_set.entities, feature_set.label_column, feature_set.timestamp_key}
    refused = [f for f in features if f in special]
    if refused:
        raise SpecError(f"{refused} are keys, label or time column and stay")
    missing = [f for f in features if f not in df.columns]
    if missing:
        raise SpecError(f"columns {missing} to drop are not in the data")
    return df.drop(*features)


def rename(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed(names)


def extend(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    return df.withColumns(columns)


def event_metadata(
    df: DataFrame,
    id_path: str | None = None,
    key_path: str | None = None,
    random_id: bool = False,
) -> DataFrame:
    """Add ``event_id``/``event_key`` from (nested) columns, or a random id."""
    if random_id and id_path:
        raise SpecError("give an id path or random_id, not both")
    added = {}
    if random_id:
        added["event_id"] = F.uuid()
    elif id_path:
        added["event_id"] = F.col(id_path).cast("string")
    if key_path:
        added["event_key"] = F.col(key_path).cast("string")
    return df.withColumns(added) if added else df


def flat_map(df: DataFrame, array: Column | str, out: str, position: str | None = None) -> DataFrame:
    """One row per element of an array."""
    column = F.col(array) if isinstance(array, str) else array
    if position:
        return df.select("*", F.posexplode(column).alias(position, out))
    return df.select("*", F.explode(column).alias(out))


def flatten(df: DataFrame, array_of_structs: Column | str) -> DataFrame:
    """One row per struct of an array, its fields as columns."""
    column = F.col(array_of_structs) if isinstance(array_of_structs, str) else array_of_structs
    return df.select("*", F.inline(column))


def choice(df: DataFrame, branches: dict[str, Column], default: str, out: str = "branch") -> DataFrame:
    """Label each row with the first branch whose predicate holds."""
    chain = None
    for name, predicate in branches.items():
        hit = F.coalesce(predicate, F.lit(False))
        chain = F.when(hit, F.lit(name)) if chain is None else chain.when(hit, F.lit(name))
    return df.withColumn(out, chain.otherwise(F.lit(default)))


def partition(df: DataFrame, predicate: Column) -> tuple[DataFrame, DataFrame]:
    """(rows that satisfy the predicate, the rest)."""
    hit = F.coalesce(predicate, F.lit(False))
    return df.where(hit), df.where(~hit)


def split_errors(
    df: DataFrame, attempts: dict[str, Column], out: str = "error"
) -> tuple[DataFrame, DataFrame]:
    """(good rows, error rows): ``attempts`` are ``try_*`` columns, null where they failed.

    Error rows keep their data and name the first column that failed.
    """
    tried = df.withColumns(attempts)
    failed = F.coalesce(*[F.when(F.col(n).isNull(), F.lit(n)) for n in attempts])
    tried = tried.withColumn(out, failed)
    return tried.where(F.col(out).isNull()).drop(out), tried.where(F.col(out).isNotNull())


def apply_step(df: DataFrame, step: Callable[..., DataFrame], **arguments) -> DataFrame:
    """User step: any ``DataFrame -> DataFrame`` callable, or an object with ``validate``/``do``."""
    if hasattr(step, "do"):
        if hasattr(step, "validate"):
            step.validate(df)
        return step.do(df)
    return df.transform(step, **arguments)
