"""Quality classifier: naive Bayes support vectors.

A text's features are indicators of its byte n-grams (1 to 3 bytes), of its words, hashed to BUCKETS, and of words
said again at once.  Each indicator is scaled by its class log-count ratio; a linear model with hinge loss is fitted
to the scaled rows, each of unit length, by dual coordinate descent, classes weighted evenly.  A logistic curve fitted to the
margins of a second part of the sample, which the weights never saw, turns margins into scores.

The model is fitted on a bounded sample: at most TRAIN_ROWS labelled rows, those with the smallest xxhash64 of
their id; only their hashed features reach the driver, as a compressed bitmap of (BUCKETS + REPEATS) / 8 bytes a row
at most.

Defined results: null and empty texts are scored as texts without features; with no labelled rows, or one
class only, every score is that class's share (0.5 with no rows); a null id or label is not learned from;
repeated rows give one row each; extra columns are ignored.  Whole texts are read, however long.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylink.llm.common import id_and_text, id_remainder, is_held_out, map_batches

BUCKETS = 1 << 18
TRAIN_ROWS = 4000
COST = 1.0
EPOCHS = 10
#: Indicators of a word said again at once, up to so many times in a row.
REPEATS = 4
FEATURES = BUCKETS + REPEATS


def features(text: str | None) -> np.ndarray:
    """Sorted numbers of the indicators that a text has."""
    if not text:
        return np.zeros(0, np.int32)
    data = text.encode()
    raw = np.frombuffer(data, np.uint8).astype(np.uint32)
    grams = [raw]
    if len(raw) > 1:
        grams.append((raw[:-1] << 8 | raw[1:]) + np.uint32(1 << 24))
    if len(raw) > 2:
        grams.append((raw[:-2] << 16 | raw[1:-1] << 8 | raw[2:]) + np.uint32(1 << 25))
    hashed = (np.concatenate(grams) * np.uint32(2654435761)) >> np.uint32(14)
    hash_of = xxhash.xxh3_64_intdigest
    words = np.fromiter((hash_of(w) & (BUCKETS - 1) for w in data.split()), np.uint32)
    seen = np.zeros(FEATURES, bool)
    seen[hashed] = True
    seen[words] = True
    run = same = words[1:] == words[:-1]
    for n in range(REPEATS):
        if not run.any():
            break
        seen[BUCKETS + n] = True
        run = run[:-1] & same[n + 1 :]
    return np.flatnonzero(seen).astype(np.int32)


def packed(found: np.ndarray) -> bytes:
    """The features as a compressed bitmap."""
    seen = np.zeros(FEATURES, bool)
    seen[found] = True
    return zlib.compress(np.packbits(seen).tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(np.frombuffer(zlib.decompress(data), np.uint8), count=FEATURES)).astype(np.int32)


@dataclass
class Classifier:
    """``weights`` already hold the log-count ratios; a row is scaled to unit length by ``ratios``."""

    weights: np.ndarray
    ratios: np.ndarray
    bias: float
    slope: float
    intercept: float

    def margin(self, found: np.ndarray) -> float:
        length = float(np.sqrt((self.ratios[found] ** 2).sum()))
        return self.bias + (float(self.weights[found].sum()) / length if length else 0.0)

    def score(self, found: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(found) + self.intercept, -40, 40))))


def log_count_ratios(rows: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    counts = np.ones((2, FEATURES))
    for found, y in zip(rows, labels, strict=True):
        counts[int(y), found] += 1
    share = counts / counts.sum(axis=1, keepdims=True)
    return np.log(share[1] / share[0])


def dual_coordinate_descent(rows: list[np.ndarray], values: list[np.ndarray], signs: np.ndarray, cost: np.ndarray, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Weights and the weight of a constant feature 1 that minimise half the squared norm plus cost times hinge losses."""
    weights, bias = np.zeros(FEATURES), 0.0
    alpha = np.zeros(len(rows))
    square = np.array([float((v * v).sum()) for v in values]) + 1
    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            slope = signs[i] * (bias + float((weights[rows[i]] * values[i]).sum())) - 1
            new = min(max(alpha[i] - slope / square[i], 0.0), cost[i])
            if new != alpha[i]:
                weights[rows[i]] += (new - alpha[i]) * signs[i] * values[i]
                bias += (new - alpha[i]) * signs[i]
                alpha[i] = new
    return weights, bias


def logistic_curve(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and intercept by Newton's method, with a slight pull of the slope towards 0."""
    at = np.zeros(2)
    x = np.stack([margins, np.ones(len(margins))], axis=1)
    ridge = np.diag([1e-2, 1e-3])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -40, 40)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (labels - p) - ridge @ at)
        at = at + np.clip(step, -4, 4)
    return float(at[0]), float(at[1])


def fit(rows: list[np.ndarray], labels: np.ndarray) -> Classifier:
    nothing = np.zeros(FEATURES)
    n, ones = len(labels), int(labels.sum()) if len(labels) else 0
    if ones in (0, n):
        share = 0.5 if not n else (ones + 0.5) / (n + 1)
        return Classifier(nothing, nothing, 0.0, 0.0, float(np.log(share / (1 - share))))

    def learn(part: np.ndarray, slope: float = 1.0, intercept: float = 0.0) -> Classifier:
        own = [rows[i] for i in part]
        ratios = log_count_ratios(own, labels[part])
        values = [ratios[r] / max(float(np.sqrt((ratios[r] ** 2).sum())), 1e-12) for r in own]
        y = labels[part]
        cost = COST * len(y) / (2 * np.where(y == 1, max(1, y.sum()), max(1, len(y) - y.sum())))
        weights, bias = dual_coordinate_descent(own, values, np.where(y == 1, 1.0, -1.0), cost)
        return Classifier(weights * ratios, ratios, bias, slope, intercept)

    first, second = np.arange(0, n, 2), np.arange(1, n, 2)
    half = learn(first)
    curve = logistic_curve(np.array([half.margin(rows[i]) for i in second]), labels[second]) if len(second) else (1.0, 0.0)
    return learn(np.arange(n), *curve)


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str, text_col: str, limit: int) -> DataFrame:
    """text, label of the sample: ids are chosen from the labels alone; at most ``limit`` of them are broadcast."""
    known = labels.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{label_col}`").cast("int").alias("label"))
    known = known.where((id_remainder("doc_id") != 1) & F.col("label").isin(0, 1)).distinct()
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(limit)
    return id_and_text(docs, id_col, text_col).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "label")


def learn(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", limit: int = TRAIN_ROWS) -> Classifier:
    def make():
        return lambda rows: {"doc_id": rows["doc_id"], "label": rows["label"], "found": [packed(features(x)) for x in rows["text"]]}

    sample = labelled_sample(docs, labels, label_col, id_col, text_col, limit)
    hashed = map_batches(sample, make, f"doc_id {dict(docs.dtypes)[id_col]}, label int, found binary").toPandas()
    hashed = hashed.sort_values(["doc_id", "label", "found"])
    return fit([unpacked(x) for x in hashed["found"]], hashed["label"].to_numpy(dtype=float))


def score(docs: DataFrame, model: Classifier, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted.  The model's size is fixed by BUCKETS."""

    def make():
        return lambda rows: {"doc_id": rows["doc_id"], "score": [model.score(features(x)) for x in rows["text"]]}

    done = map_batches(id_and_text(docs, id_col, text_col), make, f"doc_id {dict(docs.dtypes)[id_col]}, score double")
    return done.select("doc_id", is_held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def classify(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", limit: int = TRAIN_ROWS) -> DataFrame:
    return score(docs, learn(docs, labels, label_col, id_col, text_col, limit), id_col, text_col)
