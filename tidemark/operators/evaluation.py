"""Model evaluation from counts: confusion, ROC, calibration and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import SpecError
from .ordered import MAX_ROWS, running
from .stats import exact_quantiles


def _pair_counts(df: DataFrame, truth: str, predicted: str, weight: str | None = None) -> DataFrame:
    """(truth, predicted, n): one row per pair of labels that occurs."""
    w = F.sum(F.col(weight)) if weight else F.count(F.lit(1))
    return df.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(w.cast("double").alias("n"))


def confusion(
    df: DataFrame, truth: str, predicted: str, weight: str | None = None, normalize: str | None = None
) -> DataFrame:
    """(truth, predicted, value) over every pair of labels, zeros included.

    A missing label or prediction is a label of its own (null), so no row drops out.  The grid
    is a product of the label list with itself, laid out after the rows were counted.
    """
    if normalize not in (None, "true", "pred", "all"):
        raise SpecError("normalize is None, 'true', 'pred' or 'all'")
    counted = _pair_counts(df, truth, predicted, weight)
    labels = counted.select("truth").union(counted.select("predicted")).distinct()
    grid = labels.toDF("truth").crossJoin(labels.toDF("predicted"))
    found = counted.toDF("__t", "__p", "n")
    same = F.col("truth").eqNullSafe(F.col("__t")) & F.col("predicted").eqNullSafe(F.col("__p"))
    full = grid.join(found, same, "left").select("truth", "predicted", F.coalesce("n", F.lit(0.0)).alias("n"))
    if normalize is None:
        return full.withColumnRenamed("n", "value")
    side = {"true": "truth", "pred": "predicted", "all": None}[normalize]
    if side:
        totals = counted.groupBy(F.col(side).alias("__side")).agg(F.sum("n").alias("t"))
        full = full.join(totals, F.col(side).eqNullSafe(F.col("__side")), "left")
    else:
        full = full.crossJoin(counted.agg(F.sum("n").alias("t")))
    return full.select("truth", "predicted", F.when(F.col("t") > 0, F.col("n") / F.col("t")).otherwise(0.0).alias("value"))


def roc_points(
    df: DataFrame, truth: str, score: str, max_rows: int | None = MAX_ROWS
) -> DataFrame:
    """(threshold, tp, fp, p, n) per distinct score, from the highest down.

    Rows shrink to distinct scores first; the cumulative counts are a sliced ordered scan,
    so nothing passes through one task.
    """
    per_score = df.groupBy(F.col(score).alias("threshold")).agg(
        F.count_if(F.col(truth) == 1).alias("pos"), F.count_if(F.col(truth) != 1).alias("neg")
    )
    down = per_score.withColumn("__down", -F.col("threshold"))
    counted = running(
        down, [], ["__down"], {"tp": ("sum", F.col("pos")), "fp": ("sum", F.col("neg"))}, max_rows
    )
    return counted.drop("__down")


def roc_curve(df: DataFrame, truth: str, score: str, max_rows: int | None = MAX_ROWS) -> DataFrame:
    """(threshold, fpr, tpr), starting at the origin with an infinite threshold."""
    totals = df.agg(
        F.count_if(F.col(truth) == 1).alias("p"), F.count_if(F.col(truth) != 1).alias("n")
    ).first()
    points = roc_points(df, truth, score, max_rows).select(
        F.col("threshold").cast("double").alias("threshold"),
        F.try_divide(F.col("fp"), F.lit(totals["n"])).alias("fpr"),
        F.try_divide(F.col("tp"), F.lit(totals["p"])).alias("tpr"),
    )
    origin = df.sparkSession.range(1).select(
        F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")
    )
    return points.unionByName(origin)


def auc(df: DataFrame, truth: str, score: str, max_rows: int | None = MAX_ROWS) -> DataFrame:
    """Area under the ROC curve (trapezoids over distinct scores), one row ``auc``."""
    points = roc_points(df, truth, score, max_rows)
    area = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2))
    return points.agg(F.try_divide(area, F.sum("pos").cast("double") * F.sum("neg")).alias("auc"))


def class_roc_points(
    df: DataFrame, truth: str, scores: dict, weight: str | None = None, max_rows: int | None = MAX_ROWS
) -> DataFrame:
    """(label, threshold, pos, neg, tp, fp): one class against the rest, for every class.

    ``scores`` maps each label to the column of its score.  Weights default to 1.  Rows shrink
    to distinct scores per class before anything is ordered.
    """
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    cells = F.array(*[
        F.struct(
            F.lit(label).alias("label"), F.col(column).cast("double").alias("threshold"),
            F.when(F.col(truth) == label, w).otherwise(0.0).alias("p"), F.when(F.col(truth) == label, 0.0).otherwise(w).alias("n"),
        )
        for label, column in scores.items()
    ])
    known = df.where(F.col(truth).isNotNull()).select(F.inline(cells)).where(F.col("threshold").isNotNull())
    per_score = known.groupBy("label", "threshold").agg(F.sum("p").alias("pos"), F.sum("n").alias("neg"))
    down = per_score.withColumn("__down", -F.col("threshold"))
    sums = {"tp": ("sum", F.col("pos")), "fp": ("sum", F.col("neg"))}
    return running(down, ["label"], ["__down"], sums, max_rows).drop("__down")


def class_roc(
    df: DataFrame, truth: str, scores: dict, weight: str | None = None, drop_intermediate: bool = False,
    max_rows: int | None = MAX_ROWS,
) -> DataFrame:
    """(label, threshold, fpr, tpr) of every class, each starting at the origin.

    ``drop_intermediate`` leaves out points on a straight line between their neighbours.
    """
    points = class_roc_points(df, truth, scores, weight, max_rows)
    if drop_intermediate:
        # A point is on a line if the next step goes on in the direction of its own.
        ahead = running(
            points.withColumn("__up", F.col("threshold")), ["label"], ["__up"],
            {"__pos": ("last", F.col("pos")), "__neg": ("last", F.col("neg"))}, max_rows, inclusive=False,
        )
        straight = F.col("__pos").isNotNull() & (F.col("pos") * F.col("__neg") == F.col("neg") * F.col("__pos"))
        points = ahead.where(~straight).drop("__up", "__pos", "__neg")
    totals = _class_totals(points)
    rates = points.join(totals, "label").select(
        "label", "threshold", F.try_divide("fp", "n").alias("fpr"), F.try_divide("tp", "p").alias("tpr")
    )
    origin = totals.select(
        "label", F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")
    )
    return rates.unionByName(origin)


def _class_totals(points: DataFrame) -> DataFrame:
    """(label, p, n): weight of the class and of the rest, the ends of the running sums."""
    return points.groupBy("label").agg(F.max("tp").alias("p"), F.max("fp").alias("n"))


def class_auc(
    df: DataFrame, truth: str, scores: dict, weight: str | None = None, max_rows: int | None = MAX_ROWS
) -> DataFrame:
    """(label, auc) of every class against the rest."""
    points = class_roc_points(df, truth, scores, weight, max_rows)
    area = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2))
    return points.groupBy("label").agg(F.try_divide(area, F.sum("pos") * F.sum("neg")).alias("auc"))


def calibration(
    df: DataFrame, truth: str, score: str, bins: int = 5, strategy: str = "uniform"
) -> DataFrame:
    """Mean prediction against observed rate per score bin; empty bins are left out.

    A score on the edge of two bins belongs to the lower one.
    """
    if strategy == "uniform":
        edges = [i * (1 / bins) for i in range(1, bins)]
    elif strategy == "quantile":
        found = exact_quantiles(df, {"s": F.col(score).cast("double")}, [i / bins for i in range(1, bins)])
        edges = found["s"]
    else:
        raise SpecError("strategy is 'uniform' or 'quantile'")
    chain = None
    for i, edge in enumerate(edges):
        hit = F.col(score) <= edge
        chain = F.when(hit, F.lit(i)) if chain is None else chain.when(hit, F.lit(i))
    return df.groupBy(chain.otherwise(F.lit(bins - 1)).alias("bin")).agg(
        F.avg(score).alias("mean_predicted"),
        F.avg(F.col(truth).cast("double")).alias("observed"),
        F.count(F.lit(1)).alias("n"),
    )


def classification_scores(df: DataFrame, truth: str, predicted: str, average: str = "binary") -> DataFrame:
    """accuracy, precision, recall and f1 (binary for class 1, macro or weighted).

    A row without a prediction counts as wrong; no prediction is not a class of its own.  Rows
    without a truth are left out.  Only pairs of labels that occur are counted.
    """
    if average not in ("binary", "macro", "weighted"):
        raise SpecError("average is 'binary', 'macro' or 'weighted'")
    cells = _pair_counts(df.where(F.col(truth).isNotNull()), truth, predicted)
    right = F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0.0)
    both = F.array(
        F.struct(F.col("truth").alias("label"), right.alias("tp"), F.lit(0.0).alias("p"), F.col("n").alias("t")),
        F.struct(F.col("predicted").alias("label"), F.lit(0.0).alias("tp"), F.col("n").alias("p"), F.lit(0.0).alias("t")),
    )
    per_label = cells.select(F.inline(both)).where(F.col("label").isNotNull()).groupBy("label").agg(
        F.sum("tp").alias("tp"), F.sum("p").alias("p"), F.sum("t").alias("t")
    )

    def ratio(a: Column, b: Column) -> Column:
        return F.when(b > 0, a / b).otherwise(F.lit(0.0))

    scored = per_label.select(
        "label", "tp", "t",
        ratio(F.col("tp"), F.col("p")).alias("precision"),
        ratio(F.col("tp"), F.col("t")).alias("recall"),
    ).withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))

    def mean(name: str) -> Column:
        if average == "macro":
            return F.avg(name)
        if average == "weighted":
            return F.try_divide(F.sum(F.col(name) * F.col("t")), F.sum("t"))
        return F.max(F.when(F.col("label") == 1, F.col(name)))

    return scored.agg(
        F.try_divide(F.sum("tp"), F.sum("t")).alias("accuracy"),
        *[mean(m).alias(m) for m in ("precision", "recall", "f1")],
    )


def regression_scores(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """mae, mse, rmse and r2 (1 - SSE / SST)."""
    y = F.col(truth).cast("double")
    e = y - F.col(predicted).cast("double")
    sst = F.var_pop(y) * F.count(y)
    return df.where(y.isNotNull() & e.isNotNull()).agg(
        F.avg(F.abs(e)).alias("mae"),
        F.avg(e * e).alias("mse"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.when(sst > 0, 1 - F.sum(e * e) / sst).alias("r2"),
    )
