"""Quality classifier: random Fourier features of document statistics, ridge regression, isotonic calibration.

The features approximate a Gaussian kernel. Each task adds up its rows' normal equations; their sum, of fixed size, is
solved on the driver. A second part of the sample calibrates the scores by pooling adjacent violators.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut_lineage, fold_of, map_texts

STATISTICS = ("symbols", "bars", "shouts", "capitals", "digits", "stops", "short_lines", "word_length", "same_next", "distinct_words", "repeated_windows", "letters")
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&<>")] = True
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def document_statistics(text: str | None) -> list[float]:
    """Shares and means of a whole text; all 0 for null, empty and blank ones."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    if not n:
        return [0.0] * len(STATISTICS)
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    upper, lower, wide = int(count[65:91].sum()), int(count[97:123].sum()), int(count[128:].sum())
    windows = len(set(zip(words, words[1:], words[2:])))
    return [
        count[_SYMBOLS].sum() / n,
        count[ord("|")] / n,
        count[ord("!")] / n,
        upper / max(1, upper + lower),
        count[48:58].sum() / len(raw),
        (count[ord(".")] + count[ord(",")]) / n,
        count[10] / n,
        np.log(len(raw) / n),
        sum(map(bytes.__eq__, words, words[1:])) / n,
        len(set(words)) / n**0.9,
        1 - windows / (n - 2) if n > 2 else 0.0,
        (upper + lower + wide) / len(raw),
    ]


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    phase: np.ndarray
    coefficients: np.ndarray
    knots: tuple[np.ndarray, np.ndarray]

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.hstack([np.cos(z @ self.weights + self.phase) * np.sqrt(2 / len(self.phase)), np.ones((len(z), 1))])

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.knots[0]):
            return np.full(len(x), float(self.coefficients[-1]))
        return np.clip(np.interp(self.features(x) @ self.coefficients, *self.knots), 0.0, 1.0)


def pooled_violators(raw: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression of labels on scores: block centres and values; blocks get one imaginary row of either label, so no value is 0 or 1."""
    order = np.argsort(raw, kind="stable")
    blocks: list[list[float]] = []  # sum of labels, rows, sum of scores
    for s, y in zip(raw[order], label[order]):
        blocks.append([float(y), 1.0, float(s)])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    y, n, s = np.array(blocks).T
    return s / n, np.maximum.accumulate((y + 0.5) / (n + 1))


def fit_quality(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, n_features: int = 256, gamma: float = 0.05, ridge: float = 1e-3, seed: int = 7) -> Model:
    """labels (doc_id, label 0/1): at most max_rows of them (those of the least hashed ids) are used, half to fit and half to calibrate.

    Labels that are null or of ids without a text are left out. Without rows of both labels the score is their mean, or 0.5.
    """
    rng = np.random.default_rng(seed)
    k = len(STATISTICS)
    # Broadcast: max_rows ids at most.
    chosen = labels.filter("doc_id is not null and label in (0, 1)").select("doc_id", F.col("label").cast("double").alias("label"), F.xxhash64("doc_id", F.lit(seed)).alias("_h")).orderBy("_h", "label").limit(max_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").withColumn("fit", F.col("_h").bitwiseAND(1) == 0).select("text", "label", "fit")
    stats = map_texts(rows, lambda texts: {"x": [document_statistics(t) for t in texts]}, [T.StructField("x", T.ArrayType(T.DoubleType()))], keep=["label", "fit"])
    stats = cut_lineage(stats)
    moments = stats.agg(*[F.avg(F.col("x")[i]) for i in range(k)], *[F.stddev_pop(F.col("x")[i]) for i in range(k)], F.count("*"), F.avg("label"), F.count_if("fit")).first()
    n, rate, n_fit = moments[-3:]
    if not n or rate in (0.0, 1.0) or n_fit in (0, n):
        return Model(np.zeros(k), np.ones(k), np.zeros((k, 0)), np.zeros(0), np.array([0.5 if rate is None else rate]), (np.zeros(0), np.zeros(0)))
    scale = np.array(moments[k : 2 * k])
    model = Model(np.array(moments[:k]), np.where(scale > 1e-9, scale, 1.0), rng.normal(0, np.sqrt(2 * gamma), (k, n_features)), rng.uniform(0, 2 * np.pi, n_features), np.zeros(n_features + 1), (np.zeros(0), np.zeros(0)))

    def sums(batches):
        total = np.zeros((n_features + 1, n_features + 2))
        for batch in batches:
            x = np.array(batch.column("x").to_pylist(), float).reshape(-1, k)
            f = model.features(x)
            total += f.T @ np.hstack([f, batch.column("label").to_numpy(zero_copy_only=False)[:, None]])
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    parts = stats.filter("fit").coalesce(16).mapInArrow(sums, "sums binary").toArrow().column("sums").to_pylist()  # 16 tasks at most
    total = np.sum([np.frombuffer(p).reshape(n_features + 1, n_features + 2) for p in parts], axis=0)
    penalty = ridge * n_fit / n_features * np.eye(n_features + 1)
    penalty[-1, -1] = 0
    model.coefficients = np.linalg.solve(total[:, :-1] + penalty + 1e-9 * np.eye(n_features + 1), total[:, -1])
    held = stats.filter("not fit").select("x", "label").toArrow()  # max_rows / 2 rows of a dozen numbers
    raw = model.features(np.array(held.column("x").to_pylist(), float).reshape(-1, k)) @ model.coefficients
    model.knots = pooled_violators(raw, held.column("label").to_numpy())
    return model


def score_quality(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None, only_good: bool = False) -> DataFrame:
    """docs with score (0 to 1) and predicted (1 if score >= 0.5). only_good drops rows that are predicted 0."""

    def score(texts):
        got = model.score(np.array([document_statistics(t) for t in texts], float).reshape(-1, len(STATISTICS)))
        return {"score": got, "predicted": (got >= 0.5).astype(np.int32)}

    made = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    return map_texts(docs, score, made, text_col, keep, (lambda m: m["predicted"] == 1) if only_good else None)


def training_labels(labels: DataFrame, column: str = "quality", folds: int = 3, held_out: int = 1) -> DataFrame:
    return labels.filter(fold_of(F.col("doc_id"), folds) != held_out).select("doc_id", F.col(column).alias("label"))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row; labels of held-out documents are never used.

    Null and empty texts are scored as texts whose statistics are all 0. Null ids are not held out and stay; repeated rows get equal scores; equal
    scores of different texts are calibrated alike. Without labels of both kinds every score is the labels' mean, or 0.5.
    """
    rows = docs.select("doc_id", "text")
    model = fit_quality(rows, training_labels(labels))
    scored = score_quality(rows, model, keep=["doc_id"])
    return scored.select("doc_id", (fold_of(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted")
