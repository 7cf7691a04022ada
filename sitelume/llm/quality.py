"""Quality scores from preference pairs: a Bradley-Terry model over features of the text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .samples import share_of, with_labels
from .scratch import only
from .textbytes import slices, string_bytes, words

#: Byte shares by value, then the features of `_shape`.
FEATURES = 256 + 8


def text_features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Features of each whole text, a row each: square roots of byte shares, repetition and shape."""
    rows = len(offsets) - 1
    length = np.diff(offsets)
    owner = np.repeat(np.arange(rows, dtype=np.int64), length)
    share = np.bincount(owner * 256 + data, minlength=rows * 256).reshape(rows, 256)
    out = np.zeros((rows, FEATURES))
    out[:, :256] = np.sqrt(share / np.maximum(length, 1)[:, None])
    value, at = words(data, offsets)
    count = np.diff(at)
    of_word = np.repeat(np.arange(rows), count)
    out[:, 256:] = _shape(value, of_word, count, length, share, rows)
    return out


def _shape(
    value: np.ndarray, owner: np.ndarray, count: np.ndarray, length: np.ndarray, share: np.ndarray, rows: int
) -> np.ndarray:
    n = np.maximum(count, 1)
    same = np.zeros(len(value), bool)
    same[1:] = (value[1:] == value[:-1]) & (owner[1:] == owner[:-1])
    again = np.bincount(owner[same], minlength=rows) / n  # words that repeat the word before them
    order = np.lexsort((value, owner))
    v, o = value[order], owner[order]
    fresh = np.ones(len(v), bool)
    fresh[1:] = (v[1:] != v[:-1]) | (o[1:] != o[:-1])
    distinct = np.bincount(o[fresh], minlength=rows)
    runs = np.diff(np.append(np.flatnonzero(fresh), len(v)))
    most = np.zeros(rows)
    np.maximum.at(most, o[fresh], runs)
    upper = share[:, 65:91].sum(axis=1) / np.maximum(share[:, 65:91].sum(axis=1) + share[:, 97:123].sum(axis=1), 1)
    return np.stack(
        [
            np.sqrt(again),
            distinct / n,
            np.sqrt(most / n),
            upper,
            np.log1p(count),
            np.log1p(length / n),
            np.log1p(share[:, 10]) - np.log1p(count),
            (count == 0).astype(float),
        ],
        axis=1,
    )


@dataclass
class QualityModel:
    """Standardised linear score, the quantile threshold, and the slope that maps it to 0 to 1."""

    mean: np.ndarray = field(default_factory=lambda: np.zeros(FEATURES))
    weight: np.ndarray = field(default_factory=lambda: np.zeros(FEATURES))
    threshold: float = 0.0
    slope: float = 1.0

    def raw(self, features: np.ndarray) -> np.ndarray:
        return (features - self.mean) @ self.weight

    def score(self, features: np.ndarray, at_threshold: float = 0.3) -> np.ndarray:
        """The logistic of the raw score, placed so that the threshold scores `at_threshold`."""
        x = self.slope * (self.raw(features) - self.threshold) + np.log(at_threshold / (1 - at_threshold))
        return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_pairs(features: np.ndarray, label: np.ndarray, pairs: int = 100_000, rounds: int = 400) -> QualityModel:
    """Fit by the logistic loss of score differences of (good, bad) pairs, then threshold by a quantile.

    Pairs are drawn pseudorandomly, each bad document equally often. The
    threshold is the score quantile at the share of bad documents. Labels of
    one kind only: all scores are at the threshold.
    """
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    if not len(good) or not len(bad):
        return QualityModel()
    mean, spread = features.mean(axis=0), features.std(axis=0)
    spread = np.where(spread > 1e-9, np.maximum(spread, 1e-3), np.inf)
    x = (features - mean) / spread
    random = np.random.default_rng(2)
    i = good[random.integers(0, len(good), pairs)]
    j = bad[np.arange(pairs) % len(bad)]
    w, speed = np.zeros(x.shape[1]), np.zeros(x.shape[1])
    rate, pull = 2.0, 1e-4
    for turn in range(rounds):
        s = x @ w
        miss = 1 / (1 + np.exp(np.clip(s[i] - s[j], -40, 40)))  # what the model gives to the wrong order
        push = np.bincount(i, miss, len(x)) - np.bincount(j, miss, len(x))
        slope = x.T @ push / pairs - pull * w
        speed = 0.9 * speed + slope
        w = w + rate / (1 + turn / 100) * 0.1 * speed
    model = QualityModel(mean, w / spread)
    s = model.raw(features)
    ordered = np.sort(s)
    cut = len(bad)
    model.threshold = float((ordered[cut - 1] + ordered[min(cut, len(s) - 1)]) / 2)
    model.slope = float(4 / max(s.std(), 1e-9))
    return model


def learn_quality(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    sample_rows: int = 12_000,
) -> QualityModel:
    """Learn from a bounded sample: about `sample_rows` labelled rows, chosen by a hash of their id (and text).

    Rows with null id, label or text are not learned from; of several labels of
    one id the smallest holds. Texts equal in all features count once.
    """
    told = (
        only(labels, id=id_col, label=label_col)
        .where("id IS NOT NULL AND label IS NOT NULL")
        .groupBy("id")
        .agg(F.min("label").cast("int").alias("label"))
    )
    n = told.count()
    rate = min(1.0, sample_rows / max(n, 1))
    chosen = told.where(share_of("id") < rate)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets, _ = string_bytes(batch.column(1))
            for a, b in slices(offsets, rows=2048):
                x = text_features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]).astype("<f4")
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[a:b], pa.array([r.tobytes() for r in x], pa.binary())], ["label", "x"]
                )

    rows = (
        with_labels(only(docs, id=id_col, text=text_col).where("text IS NOT NULL"), chosen, 2 * sample_rows)
        .select("label", "text")
        .mapInArrow(measure, "label int, x binary")
        .dropDuplicates()
        .collect()
    )
    rows.sort(key=lambda r: (r["x"], r["label"]))
    if not rows:
        return QualityModel()
    x = np.stack([np.frombuffer(r["x"], "<f4") for r in rows]).astype(float)
    return fit_pairs(x, np.array([r["label"] for r in rows]))


def score_quality(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score every whole text: doc_id, score (0 to 1), predicted (score >= 0.3).

    Null text is scored as the empty text. A very long text is scored whole, by
    itself. Each row is scored alone, so ties, repeated rows and null ids keep
    their rows; an empty table gives no rows; extra columns are ignored.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # two arrays of FEATURES numbers

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets, _ = string_bytes(batch.column(1))
            for a, b in slices(offsets, rows=2048):
                x = text_features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                value = held.value.score(x)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[a:b], pa.array(value), pa.array((value >= 0.3).astype(np.int32))],
                    ["doc_id", "score", "predicted"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    return only(docs, doc_id=id_col, text=text_col).mapInArrow(score, f"doc_id {kind}, score double, predicted int")
