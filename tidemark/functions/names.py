"""Column-name rules and feature strings."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import SpecError


def normalize_columns(df: DataFrame) -> DataFrame:
    """Drop parentheses, turn blanks into ``_``; a clash is an error."""
    names = [re.sub(r"\s", "_", re.sub(r"[()]", "", c)) for c in df.columns]
    if len(set(names)) != len(names):
        clashes = sorted({n for n in names if names.count(n) > 1})
        raise SpecError(f"column names clash after normalizing: {clashes}")
    return df.toDF(*names)


def metric_name(name: str) -> str:
    """Series attribute name: ``-`` becomes ``_``, a leading digit gets ``_``."""
    name = name.replace("-", "_")
    return f"_{name}" if name[:1].isdigit() else name


def metric_names_column(map_column: Column) -> Column:
    """``metric_name`` applied to the keys of a map column."""

    def rule(key: Column, _value: Column) -> Column:
        safe = F.replace(key, F.lit("-"), F.lit("_"))
        return F.when(safe.rlike("^[0-9]"), F.concat(F.lit("_"), safe)).otherwise(safe)

    return F.transform_keys(map_column, rule)


def category_name(value) -> str:
    """One-hot suffix of a category value."""
    return str(value).replace(" ", "_").replace("-", "_")


def parse_feature(text: str) -> tuple[str | None, str, str, str | None]:
    """``[project/]set.name[ as alias]`` -> (project, set, name, alias)."""
    body, alias = text.strip(), None
    pieces = re.split(r"\s+as\s+", body)
    if len(pieces) == 2:
        body, alias = pieces[0].strip(), pieces[1].strip()
    elif len(pieces) > 2:
        raise SpecError(f"invalid feature {text!r}")
    project = None
    if "/" in body:
        project, body = body.split("/", 1)
    owner, dot, name = body.rpartition(".")
    if not dot or not owner or not name:
        raise SpecError(f"feature {text!r} must look like <set>.<name>")
    return project, owner, name, alias
