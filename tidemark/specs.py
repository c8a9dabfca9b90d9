"""Declarative specs: what to read, key on, compute, join and write."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame

from .errors import SpecError
from .functions.time import duration_seconds

# Aggregation operations.
AGG_OPS = ("count", "sum", "sqr", "max", "min", "first", "last", "avg", "stdvar", "stddev")


@dataclass(frozen=True)
class Aggregation:
    """Operations on one column over one or more time windows."""

    column: str
    operations: tuple[str, ...]
    windows: tuple[str, ...]
    period: str | None = None
    name: str | None = None

    def __post_init__(self):
        for attr in ("operations", "windows"):
            value = getattr(self, attr)
            object.__setattr__(self, attr, (value,) if isinstance(value, str) else tuple(value))
        for op in self.operations:
            if op not in AGG_OPS:
                raise SpecError(f"operation {op!r} is not one of {', '.join(AGG_OPS)}")
        for window in self.windows:
            size = duration_seconds(window)
            if self.period and size % duration_seconds(self.period):
                raise SpecError(f"period {self.period} does not divide window {window}")

    def step(self, window: str) -> int:
        return duration_seconds(self.period or window)

    def output(self, op: str, window: str) -> str:
        return f"{self.name or self.column}_{op}_{window}"


@dataclass(frozen=True)
class FeatureSet:
    """A keyed table: frame, entities, time column, relations and transform steps."""

    name: str
    entities: tuple[str, ...] = ()
    timestamp_key: str | None = None
    label_column: str | None = None
    relations: dict[str, str] = field(default_factory=dict)
    steps: tuple[Callable[[DataFrame], DataFrame], ...] = ()
    reader: Callable[..., DataFrame] | None = None
    df: DataFrame | None = None

    def __post_init__(self):
        object.__setattr__(self, "entities", tuple(self.entities))
        if self.timestamp_key in self.entities:
            raise SpecError(f"time column {self.timestamp_key!r} may not be an entity")

    def with_df(self, df: DataFrame) -> "FeatureSet":
        return replace(self, df=df)

    def transform(self, df: DataFrame) -> DataFrame:
        for step in self.steps:
            df = df.transform(step)
        return df

    def frame(self) -> DataFrame:
        """Materialized frame, or the source read and transformed lazily (passthrough)."""
        if self.df is not None:
            return self.df
        if self.reader is None:
            raise SpecError(f"feature set {self.name!r} has no data")
        return self.transform(self.reader())

    def check_special_columns(self, columns: list[str]) -> None:
        wanted = [*self.entities, self.timestamp_key, self.label_column]
        missing = [c for c in wanted if c and c not in columns]
        if missing:
            raise SpecError(f"columns {missing} of feature set {self.name!r} are not in the data")

    def feature_names(self) -> list[str]:
        skip = {*self.entities, self.timestamp_key}
        return [c for c in self.frame().columns if c not in skip]


@dataclass(frozen=True)
class JoinStep:
    """One join of the chain: the set joined from the right, how, and on which keys."""

    right: str
    how: str | None = None
    asof: bool = False
    left_keys: tuple[str, ...] = ()
    right_keys: tuple[str, ...] = ()


class JoinGraph:
    """Explicit ordered joins: ``JoinGraph("a").inner("b").left("c", asof=True)``."""

    def __init__(self, first: str):
        self.steps = [JoinStep(first, "first")]

    def _add(self, name: str, how: str, asof: bool = False) -> "JoinGraph":
        if any(s.right == name for s in self.steps):
            raise SpecError(f"feature set {name!r} is already in the join graph")
        self.steps.append(JoinStep(name, how, asof))
        return self

    def inner(self, name: str) -> "JoinGraph":
        return self._add(name, "inner")

    def outer(self, name: str) -> "JoinGraph":
        return self._add(name, "outer")

    def left(self, name: str, asof: bool = False) -> "JoinGraph":
        return self._add(name, "left", asof)

    def right(self, name: str) -> "JoinGraph":
        return self._add(name, "right")


@dataclass(frozen=True)
class FeatureVector:
    """Ordered feature strings, an optional label and how to join the sets."""

    features: tuple[str, ...]
    label: str | None = None
    join_graph: JoinGraph | None = None
    relations: dict[str, dict[str, str]] = field(default_factory=dict)
    with_indexes: bool = False

    def __post_init__(self):
        object.__setattr__(self, "features", tuple(self.features))
