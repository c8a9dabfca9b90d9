"""Batch scoring, ensembles and parallel branches."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import SpecError

# Groups that samples are dealt into, each one call of the user's rule, and samples whose votes a
# call holds as Python objects.
SLOTS = 1 << 12
SAMPLES = 1000


def score(
    df: DataFrame,
    load: Callable[[], object],
    features: list[str],
    outputs: list[str],
    time_column: str | None = None,
    time_value=None,
) -> DataFrame:
    """Append a model's predictions.

    ``load()`` runs once per task; ``model.predict(frame)`` gets Arrow-sized batches and
    returns one column per output.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for batch in batches:
            predicted = pd.DataFrame(model.predict(batch), index=batch.index)
            if predicted.shape[1] != len(outputs):
                raise SpecError(f"model gave {predicted.shape[1]} columns for {len(outputs)} outputs")
            yield pd.DataFrame({name: predicted.iloc[:, i].astype("float64") for i, name in enumerate(outputs)})

    # Only the features go to Python and only the predictions come back.
    predict = F.pandas_udf(run, T.StructType([T.StructField(o, T.DoubleType()) for o in outputs]))
    kept = [c for c in df.columns if c not in outputs]
    scored = df.withColumn("__p", predict(F.struct(*features))).select(*kept, *[F.col(f"__p.{o}").alias(o) for o in outputs])
    if time_column:
        scored = scored.withColumn(time_column, F.lit(time_value).cast("timestamp") if time_value else F.current_timestamp())
    return scored


def vote_weights(models: list[str], weights: dict[str, float] | None = None) -> dict[str, float]:
    """Equal weights by default; sums below 1 are rescaled, models left out weigh 0."""
    if weights is None:
        return {m: 1 / len(models) for m in models}
    unknown = set(weights) - set(models)
    if unknown:
        raise SpecError(f"weights for unknown models {sorted(unknown)}")
    total = sum(weights.values())
    if total <= 0:
        raise SpecError("weights must sum to more than 0")
    scale = total if 1 - total > 1e-5 else 1
    return {m: weights.get(m, 0) / scale for m in models}


def majority_vote(df: DataFrame, models: list[str], weights: dict[str, float] | None = None) -> Column:
    """Class with the largest weight; the smallest class wins ties.  No shuffle."""
    share = vote_weights(models, weights)
    ballots = F.array(
        *[F.struct(F.col(m).cast("long").alias("c"), F.lit(float(w)).alias("w")) for m, w in share.items()]
    )
    classes = F.array_sort(F.array_distinct(F.transform(ballots, lambda b: b["c"])))
    scored = F.transform(
        classes,
        lambda c: F.struct(
            F.round(
                F.aggregate(
                    F.filter(ballots, lambda b: b["c"] == c), F.lit(0.0), lambda a, b: a + b["w"]
                ),
                9,
            ).alias("w"),
            (-c).alias("c"),
        ),
    )
    return -F.array_max(scored)["c"]


def mean_vote(df: DataFrame, models: list[str], weights: dict[str, float] | None = None) -> Column:
    share = vote_weights(models, weights)
    return reduce(lambda a, b: a + b, [F.col(m).cast("double") * F.lit(float(w)) for m, w in share.items()])


def vote_kind(df: DataFrame, models: list[str]) -> str:
    """classification when every prediction is a whole number, else regression."""
    whole = reduce(
        lambda a, b: a & b, [F.coalesce(F.col(m) == F.floor(F.col(m)), F.lit(True)) for m in models]
    )
    return "classification" if df.agg(F.bool_and(whole)).first()[0] else "regression"


def vote(
    df: DataFrame, models: list[str], weights: dict[str, float] | None = None,
    kind: str | None = None, out: str = "vote",
    logic: Callable[[DataFrame, list[str], dict | None], Column] | None = None,
) -> DataFrame:
    """Ensemble prediction; ``logic`` replaces the built-in rules."""
    if logic is None:
        kind = kind or vote_kind(df, models)
        if kind not in ("classification", "regression"):
            raise SpecError(f"unknown vote kind {kind!r}")
        logic = majority_vote if kind == "classification" else mean_vote
    return df.withColumn(out, logic(df, models, weights))


def vote_long(
    df: DataFrame, sample: list[str], model: str, prediction: str,
    weights: dict[str, float] | None = None, out: str = "vote",
) -> DataFrame:
    """Majority vote of (sample, model, prediction) rows, combined map-side per class."""
    if weights is None:
        weight = F.lit(1.0)
    else:
        known = F.create_map(*[x for m, w in weights.items() for x in (F.lit(m), F.lit(float(w)))])
        weight = F.coalesce(known[F.col(model)], F.lit(0.0))
    per_class = df.groupBy(*sample, F.col(prediction).alias("__c")).agg(F.round(F.sum(weight), 9).alias("__w"))
    best = F.max(F.struct(F.col("__w"), (-F.col("__c")).alias("c")))
    return per_class.groupBy(*sample).agg(best.alias("__b")).select(*sample, (-F.col("__b.c")).alias(out))


def vote_aggregate(
    df: DataFrame, sample: list[str], model: str, prediction: str,
    logic: Callable[[list[float], list[float]], float], weights: dict[str, float] | None = None, out: str = "vote",
) -> DataFrame:
    """(sample, vote) by a user's own rule over the (model, prediction) rows of each sample.

    ``logic(predictions, weights)`` is Python code run in a grouped aggregate over slots of samples; it gets the votes
    by model name, then prediction, so a rerun agrees.  Null models count as ''.  Models left out of ``weights`` weigh 0.
    Null predictions do not vote; a sample without votes has none.  A call of it
    holds the votes of one sample only.
    """
    if weights is None:
        weight = F.lit(1.0)
    else:
        known = F.create_map(*[x for m, w in weights.items() for x in (F.lit(m), F.lit(float(w)))])
        weight = F.coalesce(known[F.col(model)], F.lit(0.0))

    def decide(samples: pa.Array, ballots: pa.Array) -> list[dict]:
        # Many samples a call: an Arrow batch per sample would cost more than the rule.
        fields, edges = ballots.values, ballots.offsets.to_pylist()
        decided, names = [], samples.to_pylist()
        for first in range(0, len(names), SAMPLES):
            some = edges[first : first + SAMPLES + 1]
            columns = [fields.field(i).slice(some[0], some[-1] - some[0]).to_pylist() for i in range(3)]
            for name, i, j in zip(names[first:], some, some[1:]):
                cast = [c[i - some[0] : j - some[0]] for c in columns]
                voted = sorted((n, v, w) for n, v, w in zip(*cast) if v is not None and v == v)
                decision = logic([v for _, v, _ in voted], [w for *_, w in voted]) if voted else None
                decided.append({"s": name, "v": None if decision is None else float(decision)})
        return decided

    ballot = F.struct(F.coalesce(F.col(model).cast("string"), F.lit("")).alias("n"), F.col(prediction).cast("double").alias("v"), weight.alias("w"))
    key = T.StructType([T.StructField(f"k{i}", df.schema[k].dataType) for i, k in enumerate(sample)])
    aggregate = F.arrow_udf(decide, T.ArrayType(T.StructType([T.StructField("s", key), T.StructField("v", T.DoubleType())])))
    slot = F.pmod(F.xxhash64(*sample), F.lit(SLOTS)).alias("__slot")
    # Dealt by slot once: neither grouping moves a row again.
    dealt = df.select(slot, *sample, ballot.alias("__ballot")).repartition("__slot")
    held = dealt.groupBy("__slot", *sample).agg(F.collect_list("__ballot").alias("__ballots"))
    names = F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(sample)])
    found = held.groupBy("__slot").agg(aggregate(names, "__ballots").alias("__d")).select(F.inline("__d"))
    return found.select(*[F.col(f"s.k{i}").alias(k) for i, k in enumerate(sample)], F.col("v").alias(out))


def apply_handler(
    df: DataFrame, load: Callable[[], Callable[..., pd.Series]], columns: list[str], out: str, kind: str | T.DataType
) -> DataFrame:
    """Append ``handler(*columns)``, where ``load()`` makes the handler once per task.

    The handler gets one pandas Series per column, a batch at a time, and returns one of equal
    length.
    """
    if not columns:
        raise SpecError("a handler needs at least one column")

    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        handler = load()
        for values in batches:
            result = pd.Series(handler(*values))
            if len(result) != len(values[0]):
                raise SpecError(f"handler gave {len(result)} values for {len(values[0])} rows")
            yield result

    def run_one(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from run((values,) for values in batches)

    return df.withColumn(out, F.pandas_udf(run if len(columns) > 1 else run_one, kind)(*columns))


def parallel_merge(
    df: DataFrame, branches: list[Callable[[DataFrame], dict[str, Column]]], extend_input: bool = True
) -> DataFrame:
    """Run several column-producing branches on one frame; later branches overwrite."""
    merged: dict[str, Column] = {}
    for branch in branches:
        merged |= branch(df)
    if extend_input:
        return df.withColumns(merged)
    return df.select(*[c.alias(n) for n, c in merged.items()])
