"""Quality classifier (operator 6): attention-based multiple-instance learning.

A document is a bag of passages.  Every passage is encoded, a gated attention learned from the
document labels weighs the passages, and the weighted representation is scored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import release, small_batches
from .training import Adam, fold, sample

PASSAGE = 384
PAIRS = 256
GRAMS = 1024
ENCODED = 24
GATE = 12
EXTRA = 8
FEATURES = 256 + PAIRS + EXTRA
# Bound of the training sample.
PER_LABEL = 1200
EPOCHS = 12
_SLAB = 256


def _passages(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """All passages of all texts as rows of bytes (0 fills up), and the passages per text."""
    sizes, parts = [], []
    for text in texts:
        data = np.frombuffer((text or "").encode("utf-8", "replace"), "uint8")
        n = max(1, -(-len(data) // PASSAGE))
        row = np.zeros(n * PASSAGE, "uint8")
        row[: len(data)] = data
        parts.append(row)
        sizes.append(n)
    rows = np.concatenate(parts) if parts else np.zeros(0, "uint8")
    return rows.reshape(-1, PASSAGE), np.array(sizes, "int64")


def _features(rows: np.ndarray) -> np.ndarray:
    """Features of passages: byte shares, hashed byte pairs, repetition and letter case."""
    out = np.zeros((len(rows), FEATURES), "float32")
    for at in range(0, len(rows), _SLAB):
        part = rows[at : at + _SLAB]
        n = len(part)
        real = part != 0
        length = np.maximum(real.sum(axis=1), 1).astype("float32")[:, None]
        base = np.arange(n)[:, None]
        single = np.bincount((base * 256 + part).ravel(), minlength=n * 256).reshape(n, 256).astype("float32")
        single[:, 0] = 0
        wide = part.astype("uint32")
        pair = (wide[:, :-1] * 40503 + wide[:, 1:] * 30029) >> 3 & (PAIRS - 1)
        both = np.bincount((base * PAIRS + pair).ravel(), minlength=n * PAIRS).reshape(n, PAIRS).astype("float32")
        gram = wide[:, :-5] * 2654435 + wide[:, 1:-4] * 40503 + wide[:, 2:-3] * 30029 + wide[:, 3:-2] * 7919 + wide[:, 4:-1] * 104729 + wide[:, 5:] * 611953
        seen = np.zeros((n, GRAMS), bool)
        seen[base, (gram >> 5) & (GRAMS - 1)] = True
        spaces = single[:, 32] + single[:, 10]
        upper = single[:, 65:91].sum(axis=1)
        lower = single[:, 97:123].sum(axis=1)
        high = single[:, 128:].sum(axis=1)
        digits = single[:, 48:58].sum(axis=1)
        other = single[:, 33:127].sum(axis=1) - upper - lower - digits
        extra = np.stack([
            seen.sum(axis=1) / length[:, 0], spaces / length[:, 0], upper / (upper + lower + 1), high / length[:, 0],
            digits / length[:, 0], other / length[:, 0], other / (spaces + 1), length[:, 0] / PASSAGE,
        ], axis=1)
        block = out[at : at + _SLAB]
        block[:, :256] = np.sqrt(single / length)
        block[:, 256 : 256 + PAIRS] = np.sqrt(both / length)
        block[:, 256 + PAIRS :] = 2 * extra
    return out


def _begin(seed: int) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    return {
        "encode": rng.normal(0, FEATURES**-0.5, (FEATURES, ENCODED)), "encode_bias": np.zeros(ENCODED),
        "tanh": rng.normal(0, ENCODED**-0.5, (ENCODED, GATE)), "gate": rng.normal(0, ENCODED**-0.5, (ENCODED, GATE)),
        "attend": rng.normal(0, GATE**-0.5, GATE), "out": rng.normal(0, 0.3, ENCODED), "out_bias": np.zeros(1),
    }


def _forward(w: dict, x: np.ndarray, bag: np.ndarray, bags: int):
    """Probability per bag of passages, with what the gradient needs."""
    h = np.tanh(x @ w["encode"] + w["encode_bias"])
    t, g = np.tanh(h @ w["tanh"]), 1 / (1 + np.exp(-(h @ w["gate"])))
    level = (t * g) @ w["attend"]
    top = np.full(bags, -np.inf)
    np.maximum.at(top, bag, level)
    a = np.exp(level - top[bag])
    a /= np.bincount(bag, a, bags)[bag]
    z = np.zeros((bags, ENCODED))
    np.add.at(z, bag, a[:, None] * h)
    p = 1 / (1 + np.exp(-(z @ w["out"] + w["out_bias"])))
    return p, h, t, g, a, z


def _gradients(w: dict, x: np.ndarray, bag: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    p, h, t, g, a, z = _forward(w, x, bag, len(y))
    d = (p - y) / len(y)
    dz = d[:, None] * w["out"][None, :]
    da = (dz[bag] * h).sum(axis=1)
    mean = np.bincount(bag, a * da, len(y))
    dl = a * (da - mean[bag])
    dtg = dl[:, None] * w["attend"][None, :]
    dt, dg = dtg * g * (1 - t * t), dtg * t * g * (1 - g)
    dh = a[:, None] * dz[bag] + dt @ w["tanh"].T + dg @ w["gate"].T
    de = dh * (1 - h * h)
    grads = {
        "out": z.T @ d, "out_bias": np.array([d.sum()]), "attend": (t * g).T @ dl,
        "tanh": h.T @ dt, "gate": h.T @ dg, "encode": x.T @ de, "encode_bias": de.sum(axis=0),
    }
    return {k: v + 1e-4 * w[k] if k != "out_bias" else v for k, v in grads.items()}


def train(texts: list[str], labels: list[int], share: float, seed: int = 3) -> dict:
    """Weights learned from documents labelled 0 or 1; ``share`` is the true share of label 1."""
    rows, sizes = _passages(texts)
    x, y = _features(rows), np.asarray(labels, "float64")
    ends = np.cumsum(sizes)
    w = _begin(seed)
    adam, rng = Adam(w, 0.01), np.random.default_rng(seed)
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for at in range(0, len(order), 32):
            batch = order[at : at + 32]
            pick = np.concatenate([np.arange(ends[i] - sizes[i], ends[i]) for i in batch])
            adam.update(_gradients(w, x[pick].astype("float64"), np.repeat(np.arange(len(batch)), sizes[batch]), y[batch]))
    # The sample is balanced by label; the scores go back to the labels' own shares.
    drawn = y.mean()
    w["out_bias"] = w["out_bias"] + np.log(share / (1 - share)) - np.log(drawn / (1 - drawn))
    return w


def probabilities(model: dict, texts: list) -> np.ndarray:
    """Probability of label 1 for every whole text, from all of its passages."""
    out = []
    held, size = [], 0

    def flush():
        rows, sizes = _passages(held)
        if len(sizes):
            out.append(_forward(model, _features(rows), np.repeat(np.arange(len(sizes)), sizes), len(sizes))[0])

    for text in texts:
        held.append(text)
        size += len(text or "")
        if size > 1 << 20:
            flush()
            held, size = [], 0
    flush()
    return np.concatenate(out) if out else np.empty(0)


def fit(docs: DataFrame, labels: DataFrame, holdout: int | None = 1, parts: int = 3) -> dict | float:
    """The model learned from labelled documents that are not held out.

    At most PER_LABEL documents of each label, chosen by hash, train it with all their passages;
    the shares of the labels are counted over all.  If only one label occurs the model is that
    constant, without labels it is 0.5.  A document with several labels counts as often; null
    labels, texts and ids do not train.
    """
    marked = labels.where(F.col("quality").isin(0, 1)).select("doc_id", "quality")
    if holdout is not None:
        marked = marked.where(fold(F.col("doc_id"), parts) != holdout)
    counts = {r[0]: r[1] for r in marked.groupBy("quality").count().collect()}
    if len(counts) < 2:
        return float(next(iter(counts), 0.5))
    picked = sample(marked, docs, "quality", PER_LABEL, 2)
    if picked["quality"].nunique() < 2:
        return counts[1] / (counts[0] + counts[1])
    return train(list(picked["text"]), list(picked["quality"]), counts[1] / (counts[0] + counts[1]))


def scored(docs: DataFrame, model: dict | float, out: str = "quality_score") -> DataFrame:
    """``docs`` with the probability of label 1; only the text is an input."""

    small_batches(docs.sparkSession)

    @F.pandas_udf("double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            if isinstance(model, float):
                yield pd.Series(np.full(len(texts), model))
            else:
                yield pd.Series(probabilities(model, texts.tolist()))
        release()

    return docs.withColumn(out, predict(F.col("text").cast("string")))


def classify(docs: DataFrame, labels: DataFrame, model: dict | float | None = None) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document.

    Trains on labels whose crc32(doc_id) mod 3 is not 1, unless a model is given.  Null and
    empty texts are one empty passage and get its score.  A null id is not held out; repeated
    rows are kept; an empty table gives an empty one.  Other columns are ignored.
    """
    model = fit(docs, labels) if model is None else model
    held = F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False))
    found = scored(docs.select("doc_id", "text"), model, "score")
    return found.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
