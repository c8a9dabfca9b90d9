"""Model endpoint ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Layout of a function address: project/function:tag@hash.
_ADDRESS = r"^(?:([^/]+)/)?([^:@/]+)(?::([^@]*))?(?:@(.*))?$"


def _part(uri: Column, group: int) -> Column:
    found = F.regexp_extract(uri, _ADDRESS, group)
    return F.when(found != "", found)


def versioned_model(model: Column, version: Column) -> Column:
    """``model:version``, ``latest`` when no version is given."""
    given = F.when(version != "", version)
    return F.concat(model, F.lit(":"), F.coalesce(given, F.lit("latest")))


def endpoint_id(function_uri: Column, model: Column, version: Column) -> Column:
    """SHA-1 over project, function with tag or hash, and model with version.

    Null when the project, function or model is missing.
    """
    missing = F.lit("N/A")
    reference = F.concat(
        _part(function_uri, 2),
        F.lit("_"),
        F.coalesce(_part(function_uri, 3), _part(function_uri, 4), missing),
    )
    named = F.when(model != "", model)
    text = F.concat(
        _part(function_uri, 1),
        F.lit("_"),
        reference,
        F.lit("_"),
        named,
        F.lit("_"),
        F.coalesce(F.when(version != "", version), F.lit("latest")),
    )
    return F.sha1(text)
