"""Bounded training samples, and the optimizer the small models share."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``: which documents are held out."""
    return (F.crc32(doc_id.cast("string").cast("binary")) % parts).cast("int")


def sample(
    marked: DataFrame, docs: DataFrame, label: str, per_label: int, max_labels: int
) -> pd.DataFrame:
    """(label, text): at most ``per_label`` documents of each label, for training on the driver.

    ``marked`` has (doc_id, label).  Ids are chosen by hash first, from the narrow table; only
    the chosen texts are read.  This is the only bounded read of the models: what they score is
    never sampled.  Their texts are whole.  The sample holds ``per_label * max_labels`` documents at most: with more labels than
    ``max_labels`` each gives fewer, one at least, and beyond that many labels the most frequent
    are learned.  Null ids and texts do not train.
    """
    spark = marked.sparkSession
    known = marked.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).select("doc_id", label)
    most = per_label * max_labels
    labels = [r[0] for r in known.groupBy(label).count().orderBy(F.desc("count"), label).limit(most).collect()]
    order = F.xxhash64("doc_id")
    if len(labels) > max_labels:
        # One pass for many labels; only the first of each leave a task.
        first = F.row_number().over(W.partitionBy(label).orderBy(order, "doc_id"))
        picks = known.withColumn("__at", first).where(F.col("__at") <= max(most // len(labels), 1)).drop("__at")
        if len(labels) == most:
            picks = picks.join(F.broadcast(spark.createDataFrame([(v,) for v in labels], known.select(label).schema)), label)
        chosen = sorted(((r["doc_id"], r[label]) for r in picks.collect()), key=lambda r: (r[1], r[0]))
    else:
        chosen = [
            (row["doc_id"], value)
            for value in sorted(labels)
            for row in known.where(F.col(label) == value).select("doc_id").orderBy(order, "doc_id").limit(per_label).collect()
        ]
    schema = marked.select("doc_id", label).schema
    picked = spark.createDataFrame(list(dict.fromkeys(chosen)), schema)
    # At most per_label * max_labels ids are sent to the tasks.
    texts = docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    found = texts.select(label, "text", order.alias("__at")).limit(2 * len(chosen) + 1).toPandas()
    return found.sort_values([label, "__at", "text"], ignore_index=True)[[label, "text"]]


class Adam:
    """Adam steps on a dictionary of arrays."""

    def __init__(self, weights: dict[str, np.ndarray], rate: float):
        self.weights, self.rate, self.step = weights, rate, 0
        self.mean = {k: np.zeros_like(v) for k, v in weights.items()}
        self.var = {k: np.zeros_like(v) for k, v in weights.items()}

    def update(self, grads: dict[str, np.ndarray]) -> None:
        self.step += 1
        for k, g in grads.items():
            self.mean[k] += 0.1 * (g - self.mean[k])
            self.var[k] += 0.001 * (g * g - self.var[k])
            mean = self.mean[k] / (1 - 0.9**self.step)
            var = self.var[k] / (1 - 0.999**self.step)
            self.weights[k] -= self.rate * mean / (np.sqrt(var) + 1e-8)
