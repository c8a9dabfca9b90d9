"""Key columns for key-value targets and endpoint ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _text(name: str) -> Column:
    return F.col(name).cast("string")


def hash_keys(names: list[str]) -> Column:
    """SHA-1 of the concatenated key texts."""
    return F.sha1(F.concat(*[F.coalesce(_text(n), F.lit("None")) for n in names]))


def composite_sort_key(names: list[str]) -> Column | None:
    """Secondary key: none for one entity, the text for two, a hash beyond."""
    if len(names) == 1:
        return None
    if len(names) == 2:
        return _text(names[1])
    return hash_keys(names[1:])


def static_store_key(names: list[str]) -> Column:
    """``k0}:static``, ``k0.k1}:static`` or ``k0.sha1(k1..)}:static``."""
    second = composite_sort_key(names)
    head = [_text(names[0])] if second is None else [_text(names[0]), F.lit("."), second]
    return F.concat(*head, F.lit("}:static"))
