"""Offline retrieval: a feature vector compiled to one lazy chain of joins."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import SpecError
from ..functions.names import parse_feature
from ..operators import filters
from ..operators.joins import AsOf, asof_join_many, equi_join
from ..specs import FeatureSet, FeatureVector, JoinStep

ROWS = "__entity_rows__"


def vector_fields(
    vector: FeatureVector, sets: dict[str, FeatureSet]
) -> dict[str, list[tuple[str, str]]]:
    """Set name -> [(column, output name)], in the order the vector names them."""
    fields: dict[str, list[tuple[str, str]]] = {}
    used: dict[str, None] = {}
    label = parse_feature(vector.label)[1:3] if vector.label else None

    def add(owner: str, name: str, alias: str | None) -> None:
        out = alias or name
        if out in used:
            out = f"{out}_{owner}"
        if out in used:
            raise SpecError(f"output name {out!r} is used twice")
        used[out] = None
        fields.setdefault(owner, []).append((name, out))

    for text in [*vector.features, *([vector.label] if vector.label else [])]:
        _, owner, name, alias = parse_feature(text)
        if owner not in sets:
            raise SpecError(f"feature set {owner!r} is not known")
        names = sets[owner].feature_names()
        if name == "*":
            for n in names:
                if (owner, n) != label:
                    add(owner, n, f"{alias}_{n}" if alias else None)
        elif name not in names:
            raise SpecError(f"feature {name!r} not found in feature set {owner!r}")
        else:
            add(owner, name, alias)
    if not fields:
        raise SpecError("the vector has no features")
    return fields


def label_output(vector: FeatureVector, fields: dict[str, list[tuple[str, str]]]) -> str | None:
    """Output name of the label: it is the last field added for its set."""
    if not vector.label:
        return None
    return fields[parse_feature(vector.label)[1]][-1][1]


def relation_keys(left: FeatureSet, right: FeatureSet, relations: dict[str, str] | None) -> list[str]:
    """Left columns that hold the entities of ``right``; empty when not connectable."""
    if set(right.entities) <= set(left.entities):
        return list(left.entities if len(left.entities) == len(right.entities) else right.entities)
    by_entity = {entity: column for column, entity in (relations or {}).items()}
    found = [by_entity.get(e) for e in right.entities]
    return found if all(found) else []


def _right_keys(left_keys: list[str], right: FeatureSet) -> tuple[str, ...]:
    """Right keys in the order of the left ones."""
    if set(left_keys) == set(right.entities):
        return tuple(left_keys)
    return right.entities


def plan_joins(
    vector: FeatureVector,
    sets: dict[str, FeatureSet],
    names: list[str],
    row_columns: list[str] | None,
) -> list[JoinStep]:
    """Ordered join steps with keys, from the explicit graph or from shared keys."""

    def relations(name):
        return {**sets[name].relations, **vector.relations.get(name, {})}

    def connect(joined: list[str], name: str):
        right = sets[name]
        if row_columns and set(right.entities) <= set(row_columns):
            return right.entities, right.entities
        for left in joined:
            keys = relation_keys(sets[left], right, relations(left))
            if keys:
                return tuple(keys), _right_keys(keys, right)
        return None

    if vector.join_graph:
        steps, joined = [], []
        for i, step in enumerate(vector.join_graph.steps):
            found = connect(joined, step.right)
            if i == 0:
                how = "inner" if row_columns else "first"
                found = found or ((), ())
                if row_columns and not found[0]:
                    raise SpecError(f"{step.right!r} has no key among the entity rows")
            else:
                how = step.how
                if not found:
                    raise SpecError(f"no relation leads to {step.right!r}")
            steps.append(replace(step, how=how, left_keys=found[0], right_keys=found[1]))
            joined.append(step.right)
        return steps

    if row_columns:
        return _walk(names, [], connect)
    for first in names:
        try:
            return _walk(names, [first], connect)
        except SpecError:
            continue
    raise SpecError(f"feature sets {names} cannot be connected by keys or relations")


def _walk(names, joined, connect) -> list[JoinStep]:
    """Join every set as soon as it is reachable, in the order the vector names them."""
    steps = [JoinStep(n, "first") for n in joined]
    joined = list(joined)
    while len(joined) < len(names):
        for name in names:
            if name not in joined and (found := connect(joined, name)):
                steps.append(JoinStep(name, None, False, *found))
                joined.append(name)
                break
        else:
            raise SpecError(f"feature sets {sorted(set(names) - set(joined))} cannot be connected")
    return steps


def offline_features(
    vector: FeatureVector,
    sets: dict[str, FeatureSet],
    entity_rows: DataFrame | None = None,
    entity_timestamp: str | None = None,
    start=None,
    end=None,
    time_filter: str | dict[str, str] | None = None,
    additional_filters=None,
    query: str | None = None,
    order_by: str | list[str] | None = None,
    drop_columns: list[str] | None = None,
    with_indexes: bool | None = None,
    now=None,
) -> DataFrame:
    """Training set of a vector.

    Without an explicit join graph a set with a time column is joined point-in-time
    whenever the left side has one, otherwise by an inner join.  Keys and time columns are
    left out unless ``with_indexes``.
    """
    fields = vector_fields(vector, sets)
    keep_keys = vector.with_indexes if with_indexes is None else with_indexes
    row_columns = entity_rows.columns if entity_rows is not None else None
    names = list(fields)
    if vector.join_graph:
        graph = [s.right for s in vector.join_graph.steps]
        missing = [n for n in names if n not in graph]
        if missing:
            raise SpecError(f"feature sets {missing} are not in the join graph")
        names = graph
    steps = plan_joins(vector, sets, names, row_columns)
    named = [out for pairs in fields.values() for _, out in pairs]
    clash = sorted({c for c in row_columns or [] if c in named or c.startswith("__")})
    if clash:
        raise SpecError(f"columns {clash} of the entity rows are also features of the vector; rename them")
    if start is not None and end is None:
        end = "now"

    result, time_column, filtered = entity_rows, entity_timestamp, False
    outputs: dict[str, str] = {}
    hidden: list[str] = []
    # Neighbouring point-in-time joins on the same left keys run as one stacked pass.
    pending: list[AsOf] = []
    pending_keys: list[str] = []
    for step in steps:
        owner = sets[step.right]
        ts = owner.timestamp_key
        frame, used = _read(owner, time_filter, start, end, additional_filters, now)
        filtered = filtered or used
        saved = _linking_columns(vector, sets, owner)
        wanted = dict.fromkeys([n for n, _ in fields.get(owner.name, [])] + saved)
        # Names of our own: no caller's column and no other set can hold them.
        unique = {c: f"__{owner.name}__{c}" for c in wanted if c not in owner.entities and c != ts}
        for column, out in fields.get(owner.name, []):
            outputs[out] = unique.get(column, column)
        keep_ts = [ts] if ts else []
        frame = frame.select(
            *owner.entities, *keep_ts, *[F.col(c).alias(u) for c, u in unique.items()]
        )
        for column in saved:
            frame = frame.withColumn(column, F.col(unique[column])) if column not in frame.columns else frame
        if result is None:
            result, time_column = frame, ts
            hidden += [*owner.entities, *keep_ts]
            continue
        left_keys, right_keys = list(step.left_keys), list(step.right_keys)
        pointwise = bool(ts and time_column) and (step.how is None or step.asof)
        present = {*result.columns, *[c for side in pending for c in side.outputs]}
        overlap = [c for c in frame.columns if c in present and c not in right_keys and c != ts]
        frame = frame.drop(*overlap)
        if pointwise:
            if pending and pending_keys != left_keys:
                result, pending = asof_join_many(result, pending, pending_keys, time_column), []
            pending_keys = left_keys
            pending.append(AsOf(frame, tuple(right_keys), ts))
        else:
            if pending:
                result, pending = asof_join_many(result, pending, pending_keys, time_column), []
            if ts and ts in result.columns:
                frame = frame.drop(ts)
            how = step.how if step.how in ("inner", "outer", "left", "right") else "inner"
            result = equi_join(result, frame, left_keys, right_keys, how)
            time_column = time_column or ts
        hidden += [*left_keys, *keep_ts]
    if pending:
        result = asof_join_many(result, pending, pending_keys, time_column)
    if (start is not None or end is not None) and not filtered:
        raise SpecError("a time range needs a feature set with a time column")

    return _finish(
        result, vector, outputs, hidden, keep_keys, row_columns, entity_timestamp, time_column,
        drop_columns, query, order_by, fields,
    )


def _read(owner: FeatureSet, time_filter, start, end, additional, now) -> tuple[DataFrame, bool]:
    frame = filters.additional_filters(
        owner.frame(), [f for f in additional or [] if f and f[0] in owner.frame().columns]
    )
    column = owner.timestamp_key
    if isinstance(time_filter, dict):
        column = time_filter.get(owner.name, column)
    elif time_filter:
        column = time_filter
    if column and column not in frame.columns:
        raise SpecError(f"feature set {owner.name!r} has no column {column!r} to filter on")
    if column and (start is not None or end is not None):
        return filters.time_range(frame, column, start, end, now), True
    return frame, False


def _linking_columns(vector, sets, owner: FeatureSet) -> list[str]:
    """Foreign-key columns other sets are reached through."""
    return list({**owner.relations, **vector.relations.get(owner.name, {})})


def _finish(
    result, vector, outputs, hidden, keep_keys, row_columns, entity_timestamp, time_column,
    drop_columns, query, order_by, fields,
) -> DataFrame:
    index = []
    if keep_keys:
        index = list(dict.fromkeys([c for c in hidden if c in result.columns]))
        if time_column and time_column in result.columns and time_column not in index:
            index.append(time_column)
    extra = []
    if row_columns:
        keys = {*hidden, entity_timestamp}
        extra = [c for c in row_columns if c not in keys and c not in outputs]
    taken = [*index, *extra]
    columns = [F.col(c) for c in taken]
    columns += [F.col(c).alias(out) for out, c in outputs.items() if out not in taken]
    result = result.select(*columns)
    if vector.label:
        result = filters.label_not_null(result, label_output(vector, fields))
    if query:
        result = filters.by_query(result, query)
    if order_by:
        origin = {n: out for pairs in fields.values() for n, out in pairs}
        names = [order_by] if isinstance(order_by, str) else order_by
        active = [n if n in result.columns else origin.get(n) for n in names]
        if None in active or any(n not in result.columns for n in active):
            raise SpecError(f"cannot order by {names}, columns are {result.columns}")
        result = result.orderBy(*[F.col(n).asc_nulls_last() for n in active])
    return result.drop(*(drop_columns or []))
