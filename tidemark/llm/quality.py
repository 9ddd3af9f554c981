"""Quality classifier: Bradley-Terry scores learned from preference pairs.

A document labelled 1 is preferred to one labelled 0. The chance that it wins is the logistic function of
the difference of two scores, each a weighted sum of text features, so the weights are fitted to feature
differences by logistic loss. A quantile of the labelled rows' scores is the threshold.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import fields, slices

#: Labelled rows the model is fitted on: those with the smallest hash of their id. The bound of the sample.
SAMPLE_ROWS = 20_000
#: Preference pairs per labelled row of the rarer class.
PAIRS_PER_ROW = 24
RIDGE = 1e-3
NEWTON_STEPS = 25
#: Score at the threshold.
CUT = 0.3

_CLASSES = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", " \t", "\n\r", ".", ",", "!?", "|", "$%*#&", "<>/\\=", ":;@_", "-'\"()[]{}")


def _class_of_byte() -> np.ndarray:
    table = np.full(256, len(_CLASSES), dtype=np.int64)
    for k, chars in enumerate(_CLASSES):
        table[np.frombuffer(chars.encode(), np.uint8)] = k
    table[128:] = len(_CLASSES) + 1
    return table


_BYTE_CLASS = _class_of_byte()
_N_CLASSES = len(_CLASSES) + 2
N_FEATURES = 2 * _N_CLASSES + 5


def features(text: str | None) -> np.ndarray:
    """Shares of byte classes (also as roots), word length, repetition and length of a whole text."""
    raw = (text or "").encode()
    out = np.zeros(N_FEATURES)
    if not raw:
        return out
    counts = np.bincount(_BYTE_CLASS, np.bincount(np.frombuffer(raw, np.uint8), minlength=256), _N_CLASSES)
    shares = counts / len(raw)
    words = raw.lower().split()
    lines = raw.split(b"\n")
    n = max(1, len(words))
    out[:_N_CLASSES] = shares
    out[_N_CLASSES : 2 * _N_CLASSES] = np.sqrt(shares)
    out[2 * _N_CLASSES :] = (
        math.log1p(len(words)), math.log1p(len(raw) / n), len(set(words)) / n / (1.0 + 1.0 / math.log1p(n)),
        len(set(lines)) / len(lines), sum(1 for w in words if len(w) <= 3) / n,
    )
    return out


@dataclass(frozen=True)
class QualityModel:
    """Weights on standardised features, and the raw score at the threshold."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float

    def score(self, rows: np.ndarray) -> np.ndarray:
        """0 to 1; ``CUT`` or more is at or above the threshold."""
        z = ((rows - self.mean) / self.scale) @ self.weights - self.threshold + math.log(CUT / (1 - CUT))
        return 1.0 / (1.0 + np.exp(-np.clip(z, -700, 700)))


def fit_pairs(rows: np.ndarray, labels: np.ndarray, seed: int = 11) -> QualityModel:
    """Weights that maximise the likelihood of the pairs; a table without both labels gives equal scores."""
    good, bad = np.flatnonzero(labels == 1), np.flatnonzero(labels == 0)
    if not len(good) or not len(bad):
        return QualityModel(np.zeros(N_FEATURES), np.ones(N_FEATURES), np.zeros(N_FEATURES), 0.0)
    mean, scale = rows.mean(0), rows.std(0)
    scale[scale < 1e-9] = 1.0
    x = (rows - mean) / scale
    rng = np.random.default_rng(seed)
    rare, other = (bad, good) if len(bad) <= len(good) else (good, bad)
    n = max(PAIRS_PER_ROW, -(-len(other) // len(rare)))  # every row is in a pair
    a = np.repeat(rare, n)
    b = np.resize(rng.permutation(other), len(a))
    winner, loser = (b, a) if rare is bad else (a, b)
    d = x[winner] - x[loser]
    w = np.zeros(N_FEATURES)
    for _ in range(NEWTON_STEPS):
        p = 1.0 / (1.0 + np.exp(np.clip(d @ w, -500, 500)))  # chance of the wrong order
        gradient = RIDGE * w - (d * p[:, None]).mean(0)
        hessian = (d * (p * (1 - p))[:, None]).T @ d / len(d) + RIDGE * np.eye(N_FEATURES)
        step = np.linalg.solve(hessian, gradient)
        w -= step * min(1.0, 4.0 / (1e-12 + np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return QualityModel(mean, scale, w, _threshold(x @ w, labels))


def _threshold(raw: np.ndarray, labels: np.ndarray) -> float:
    """The quantile of the scores that tells the labels apart best: equal weight for both labels."""
    order = np.argsort(raw, kind="stable")
    s, y = raw[order], labels[order]
    bad_below = np.concatenate([[0], np.cumsum(y == 0)]) / max(1, (y == 0).sum())
    good_below = np.concatenate([[0], np.cumsum(y == 1)]) / max(1, (y == 1).sum())
    gain = bad_below - good_below
    gain[1:-1][s[1:] == s[:-1]] = -1  # no cut between equal scores
    best = np.flatnonzero(gain >= gain.max() - 1e-12)
    k = int(best[len(best) // 2])
    if k == 0 or k == len(s):
        return float(s[0] if k == 0 else s[-1] + 1e-6)
    return float((s[k - 1] + s[k]) / 2)


def fold(doc_id, folds: int):
    """crc32 of the id as text, modulo ``folds``."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds


def fit_quality(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", folds: int = 5, held_out: int = 0) -> QualityModel:
    """Fit on at most ``SAMPLE_ROWS`` labelled rows whose fold is not the held-out one.

    Null labels and ids, and ids without a document, are left out.
    """
    marked = (
        fields(labels, doc_id=doc_id, label=label)
        .where(F.col("label").isNotNull() & F.col("doc_id").isNotNull() & (fold("doc_id", folds) != held_out))
        .groupBy("doc_id").agg(F.min("label").cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS)
    )
    # The sample has at most SAMPLE_ROWS ids, so it is sent to the documents.
    rows = fields(docs, doc_id=doc_id, text=text).join(F.broadcast(marked), "doc_id")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            values = [features(t).tolist() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("label"), batch.column("key"), pa.array(values, pa.list_(pa.float64()))], names=["label", "key", "x"])

    keyed = rows.select("label", F.xxhash64("doc_id").alias("key"), "text")
    sample = keyed.mapInArrow(measure, "label int, key bigint, x array<double>").orderBy("key", "x").limit(SAMPLE_ROWS).collect()
    if not sample:
        return fit_pairs(np.zeros((0, N_FEATURES)), np.zeros(0))
    return fit_pairs(np.array([r["x"] for r in sample]), np.array([r["label"] for r in sample]))


def score_quality(docs: DataFrame, model: QualityModel, text: str = "text", score: str = "score") -> DataFrame:
    """The table with a score of each whole text added; a null text scores as an empty one."""
    from pyspark.sql.types import DoubleType, StructField, StructType

    kept = [c for c in docs.columns if c != score]
    rest = docs.select(*[docs[c] for c in kept])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column(text).to_pylist()
            values = model.score(np.array([features(t) for t in texts])) if texts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(values, pa.float64())], names=[*kept, score])

    return rest.mapInArrow(run, StructType([*rest.schema.fields, StructField(score, DoubleType())]))


def keep_good(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that score ``CUT`` or more, with the columns they had.

    Learns from all folds but the held-out one; see ``fit_quality`` and ``score_quality`` for nulls. Repeated
    rows stay, an empty table stays empty.
    """
    name = "_".join(["score", *docs.columns])
    return score_quality(docs, fit_quality(docs, labels, doc_id, text), text, name).where(F.col(name) >= CUT).drop(name)
