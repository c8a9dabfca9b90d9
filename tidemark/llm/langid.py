"""Language identification (operator 7): a byte convolutional network in numpy.

Bytes are embedded, filters of several widths run over them, the maximum of each filter over a
window of fixed length feeds a softmax.  All windows of a text are scored, and their
log-probabilities are averaged by length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import release, small_batches
from .training import Adam, fold, sample

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 12
EMBEDDING = 8
# Bounds of the training sample.
PER_LANGUAGE = 600
MAX_LANGUAGES = 64
# Passes over the windows, fewer (two at least) if these would meet more windows than VISITS.
EPOCHS = 8
VISITS = 200_000
# The windows of a longer text weigh as much as so many together.
LONG = 16
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")


def windows(text: str) -> np.ndarray:
    """The bytes of a text in rows of WINDOW, the last one filled up with byte 0."""
    data = np.frombuffer(text.encode("utf-8", "replace"), "uint8")
    out = np.zeros((max(1, -(-len(data) // WINDOW)), WINDOW), "uint8")
    out.ravel()[: len(data)] = data
    return out


def _begin(classes: int, seed: int) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    weights = {"embed": rng.normal(0, 0.3, (256, EMBEDDING))}
    for w in WIDTHS:
        weights[f"filter{w}"] = rng.normal(0, (w * EMBEDDING) ** -0.5, (w * EMBEDDING, FILTERS))
        weights[f"bias{w}"] = np.zeros(FILTERS)
    weights["out"] = rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, classes))
    weights["out_bias"] = np.zeros(classes)
    return weights


def _forward(weights: dict, rows: np.ndarray):
    """Softmax probabilities of windows, with what the gradient needs."""
    x = weights["embed"][rows]
    peaks, places, patches = [], [], []
    for w in WIDTHS:
        view = np.lib.stride_tricks.sliding_window_view(x, (w, EMBEDDING), axis=(1, 2))[:, :, 0]
        flat = view.reshape(len(rows), WINDOW - w + 1, w * EMBEDDING)
        response = flat @ weights[f"filter{w}"] + weights[f"bias{w}"]
        at = response.argmax(axis=1)
        places.append(at)
        peaks.append(np.take_along_axis(response, at[:, None, :], 1)[:, 0])
        patches.append(np.take_along_axis(flat, at[:, :, None], 1))
    pooled = np.concatenate(peaks, axis=1)
    hidden = np.maximum(pooled, 0)
    logits = hidden @ weights["out"] + weights["out_bias"]
    logits -= logits.max(axis=1, keepdims=True)
    prob = np.exp(logits)
    return prob / prob.sum(axis=1, keepdims=True), hidden, places, patches


def _gradients(weights: dict, rows: np.ndarray, labels: np.ndarray, share: np.ndarray | None = None) -> dict[str, np.ndarray]:
    prob, hidden, places, patches = _forward(weights, rows)
    delta = prob.copy()
    delta[np.arange(len(rows)), labels] -= 1
    delta /= len(rows)
    if share is not None:
        delta *= share[:, None]
    grads = {"out": hidden.T @ delta, "out_bias": delta.sum(axis=0), "embed": np.zeros_like(weights["embed"])}
    back = (delta @ weights["out"].T) * (hidden > 0)
    for n, w in enumerate(WIDTHS):
        part = back[:, n * FILTERS : (n + 1) * FILTERS]
        grads[f"bias{w}"] = part.sum(axis=0)
        grads[f"filter{w}"] = np.einsum("bfk,bf->kf", patches[n], part)
        to_input = part[:, :, None] * weights[f"filter{w}"].T[None]
        for offset in range(w):
            bytes_at = np.take_along_axis(rows, places[n] + offset, 1)
            np.add.at(grads["embed"], bytes_at, to_input[:, :, offset * EMBEDDING : (offset + 1) * EMBEDDING])
    return grads


def train(texts: list[str], labels: list[str], seed: int = 5) -> dict:
    """Weights and class names learned from labelled texts."""
    names = sorted(set(labels))
    rows, target, share = [], [], []
    rng = np.random.default_rng(seed)
    for text, label in zip(texts, labels):
        part = windows(text)
        # A short stretch of each text as well: windows at the end of texts are not full.
        short = part[rng.integers(len(part))][None].copy()
        short[:, rng.integers(12, WINDOW // 2) :] = 0
        rows += [part, short]
        target.append(np.full(len(part) + 1, names.index(label)))
        share.append(np.append(np.full(len(part), min(1.0, LONG / len(part))), 1.0))
    rows, target, share = np.concatenate(rows), np.concatenate(target), np.concatenate(share)
    weights = _begin(len(names), seed)
    adam = Adam(weights, 0.01)
    for _ in range(max(2, min(EPOCHS, VISITS // len(rows))) if len(names) > 1 else 0):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), 64):
            batch = order[at : at + 64]
            adam.update(_gradients(weights, rows[batch], target[batch], share[batch]))
    return {"names": names, **weights}


class Scorer:
    """The trained network for whole texts.

    Embedding and filters are folded into two tables over byte pairs, so a filter's response is
    the sum of two look-ups.
    """

    def __init__(self, model: dict):
        self.names, self.model = model["names"], model
        tables = []
        for first in (0, 2):
            columns = []
            for w in WIDTHS:
                parts = [
                    model["embed"] @ model[f"filter{w}"][o * EMBEDDING : (o + 1) * EMBEDDING]
                    if o < w else np.zeros((256, FILTERS)) for o in (first, first + 1)
                ]
                bias = model[f"bias{w}"] if first == 0 else 0
                columns.append((parts[0][:, None] + parts[1][None, :] + bias).reshape(65536, FILTERS))
            tables.append(np.ascontiguousarray(np.concatenate(columns, axis=1), "float32"))
        self.head, self.tail = tables

    def log_probabilities(self, rows: np.ndarray) -> np.ndarray:
        """Log-probabilities of windows, a few windows at a time."""
        out = np.empty((len(rows), len(self.names)))
        for at in range(0, len(rows), 64):
            part = rows[at : at + 64].astype("uint16")
            pairs = (part[:, :-1] << 8) | part[:, 1:]
            # Filters narrower than four bytes also fit at the end of a window.
            head, tail = self.head[pairs], self.tail[pairs]
            response = head[:, :-2] + tail[:, 2:]
            peaks = response.max(axis=1)
            for n, w in enumerate(WIDTHS):
                cols = slice(n * FILTERS, (n + 1) * FILTERS)
                for begin in range(WINDOW - 3, WINDOW - w + 1):
                    late = head[:, begin, cols]
                    if w > 2:
                        last = self._third(w, part[:, begin + 2])
                        late = late + last
                    peaks[:, cols] = np.maximum(peaks[:, cols], late)
            logits = np.maximum(peaks, 0) @ self.model["out"] + self.model["out_bias"]
            top = logits.max(axis=1, keepdims=True)
            out[at : at + 64] = logits - top - np.log(np.exp(logits - top).sum(axis=1, keepdims=True))
        return out

    def _third(self, w: int, data: np.ndarray) -> np.ndarray:
        table = self.model["embed"] @ self.model[f"filter{w}"][2 * EMBEDDING : 3 * EMBEDDING]
        return table[data].astype("float32")

    def score(self, texts: list) -> tuple[list[str], list[float]]:
        """Language and probability of each text; ``und`` without a letter."""
        parts, weights, sizes = [], [], []
        for text in texts:
            known = bool(text) and bool(_LETTER.search(text))
            part = windows(text) if known else np.zeros((0, WINDOW), "uint8")
            parts.append(part)
            sizes.append(len(part))
        rows = np.concatenate(parts) if parts else np.zeros((0, WINDOW), "uint8")
        weights = (rows != 0).sum(axis=1)[:, None]
        each = self.log_probabilities(rows) * weights
        ends = np.cumsum(sizes)
        names, scores = [], []
        for begin, end in zip(ends - np.asarray(sizes, "int64"), ends):
            if begin == end or not self.names:
                names.append(UNKNOWN)
                scores.append(0.0)
                continue
            mean = each[begin:end].sum(axis=0) / max(1, weights[begin:end].sum())
            prob = np.exp(mean - mean.max())
            prob /= prob.sum()
            names.append(self.names[int(prob.argmax())])
            scores.append(float(prob.max()))
        return names, scores


def fit(docs: DataFrame, holdout: int | None = 2, parts: int = 4) -> dict:
    """The network learned from text and non-null lang of documents that are not held out.

    At most PER_LANGUAGE documents a language, chosen by hash, train it with all their windows.
    Without labelled texts the model has no language.
    """
    rows = docs.select("doc_id", "lang")
    if holdout is not None:
        rows = rows.where(F.coalesce(fold(F.col("doc_id"), parts) != holdout, F.lit(True)))
    picked = sample(rows, docs, "lang", PER_LANGUAGE, MAX_LANGUAGES)
    picked = picked[[bool(_LETTER.search(t)) for t in picked["text"]]]
    if not len(picked):
        return {"names": [], **_begin(1, 0)}
    return train(list(picked["text"]), list(picked["lang"]))


def detected(docs: DataFrame, model: dict, lang: str = "lang_pred", score: str = "lang_score") -> DataFrame:
    """``docs`` with the predicted language and its probability; only the text is an input."""

    small_batches(docs.sparkSession)

    @F.pandas_udf("lang string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(model)
        for texts in batches:
            names, scores = scorer.score(texts.tolist())
            yield pd.DataFrame({"lang": names, "score": scores})
        release()

    found = docs.withColumn("__lang", predict(F.col("text").cast("string")))
    return found.withColumns({lang: F.col("__lang.lang"), score: F.col("__lang.score")}).drop("__lang")


def identify(docs: DataFrame, model: dict | None = None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every document.

    Trains on the documents whose crc32(doc_id) mod 4 is not 2, unless a model is given.  Null
    texts and texts without a letter are ``und`` with score 0, as are all texts if nothing is
    labelled.  A null id is not held out; repeated rows are kept; an empty table gives an empty
    one.  Other columns, whatever their names, are ignored.
    """
    model = model or fit(docs)
    plain = docs.select(F.col("doc_id").alias("doc_id"), "text")
    held = F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False))
    found = detected(plain, model, "lang_pred", "score")
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")
