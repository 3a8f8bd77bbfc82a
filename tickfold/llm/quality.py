"""Quality classifier: regularised quadratic discriminant over transformed document statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remainder, texts, utf8, written

NAMES = (
    "log_bytes", "log_words", "word_length", "word_length_sd", "long_words", "upper", "digits", "marks", "bars", "breaks",
    "high_bytes", "distinct_words", "repeated_next", "sentence_ends", "top_word", "marked_ends",
)
#: Weights of the shared covariance and of a multiple of the identity in each class's covariance.
POOLED, IDENTITY = 0.1, 0.02
#: Log odds beyond this say no more.
MOST_LOG_ODDS = 30.0
_KIND = np.zeros(256, np.uint8)  # 1 upper, 2 digit, 3 mark, 4 bar, 5 line break, 6 beyond ASCII
_KIND[65:91] = 1
_KIND[48:58] = 2
for _c in b"!\"#$%&'()*+-/:;<=>?@[\\]^_`{}~":
    _KIND[_c] = 3
_KIND[ord("|")] = 4
_KIND[10] = 5
_KIND[128:] = 6
_ENDS = (b".", b"?", b"\xe2\x80\xa6")
_MARKS = tuple(bytes([c]) for c in b"!#$%&*|~^@<>=_")


def _share(part: float, whole: float) -> float:
    """A share as its log odds, held off 0 and 1 by half a case."""
    return float(np.log((part + 0.5) / (max(whole - part, 0) + 0.5)))


def statistics(text: bytes | None) -> list[float]:
    """The transformed statistics of a whole text; of an empty one those of no words."""
    text = text or b""
    n = len(text)
    kinds = np.bincount(_KIND[np.frombuffer(text, np.uint8)], minlength=7).tolist() if n else [0] * 7
    words = text.split()
    k = len(words)
    lens = np.fromiter(map(len, words), np.float64, k)
    low = text.lower().split()
    _, counts = np.unique(np.fromiter(map(hash, low), np.int64, k), return_counts=True) if k else (0, np.zeros(1))
    again = sum(map(bytes.__eq__, low[1:], low))
    return [
        float(np.log1p(n)),
        float(np.log1p(k)),
        float(np.log1p(lens.mean())) if k else 0.0,
        float(np.log1p(lens.std())) if k else 0.0,
        _share(float((lens > 20).sum()), k),
        _share(kinds[1], n),
        _share(kinds[2], n),
        _share(kinds[3], n),
        _share(kinds[4], n),
        _share(kinds[5], n),
        _share(kinds[6], n),
        _share(len(counts) if k else 0, k),
        _share(again, k),
        _share(sum(w.endswith(_ENDS) for w in words), k),
        _share(float(counts.max()), k),
        _share(sum(w.endswith(_MARKS) for w in words), k),
    ]


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = [statistics(t) for t in utf8(batch, "text")]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(x, pa.list_(pa.float64()))], [*batch.schema.names[:-1], "x"])


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per class, the sums of 1, x and x xT over these rows, as one flat row each."""
    d = len(NAMES) + 1
    total = np.zeros((2, d, d))
    for batch in batches:
        if batch.num_rows:
            label = np.asarray(batch.column(0))
            x = np.array(batch.column(1).to_pylist())
            x = np.hstack([np.ones((len(x), 1)), x])
            for c in (0, 1):
                total[c] += x[label == c].T @ x[label == c]
    values = total.reshape(-1)
    yield pa.RecordBatch.from_arrays([pa.array(range(len(values)), pa.int32()), pa.array(values)], ["i", "v"])


@dataclass
class Discriminant:
    """Class means, inverse Cholesky factors of the shrunken covariances, and constants of the log densities."""

    center: np.ndarray
    scale: np.ndarray
    means: np.ndarray
    inverse: np.ndarray
    constant: np.ndarray

    @classmethod
    def fit(cls, sums: np.ndarray) -> Discriminant | None:
        """From the sums that ``_moments`` adds up; None unless both classes have rows."""
        n = sums[:, 0, 0]
        if (n < 1).any():
            return None
        whole = sums.sum(0)
        center = whole[0, 1:] / n.sum()
        spread = np.diag(whole)[1:] / n.sum() - center**2
        scale = np.sqrt(np.maximum(spread, 1e-6))
        means = (sums[:, 0, 1:] / n[:, None] - center) / scale
        cov = []
        for c in (0, 1):
            m = sums[c, 0, 1:] / n[c]
            cov.append((sums[c, 1:, 1:] / n[c] - np.outer(m, m)) / np.outer(scale, scale))
        pooled = (n[0] * cov[0] + n[1] * cov[1]) / n.sum()
        d = len(center)
        inverse, constant = [], []
        for c in (0, 1):
            own = d / (d + n[c])  # few rows lean more on the others
            shared = POOLED + (1 - POOLED) * own
            s = (1 - shared) * cov[c] + shared * pooled
            s = (1 - IDENTITY) * s + IDENTITY * max(np.trace(s) / d, 1e-3) * np.eye(d)
            factor = np.linalg.cholesky(s)
            inverse.append(np.linalg.inv(factor))
            constant.append(np.log(n[c] / n.sum()) - np.log(np.diag(factor)).sum())
        return cls(center, scale, means, np.array(inverse), np.array(constant))

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.center) / self.scale
        log = [self.constant[c] - 0.5 * (((z - self.means[c]) @ self.inverse[c].T) ** 2).sum(1) for c in (0, 1)]
        return 1 / (1 + np.exp(-np.clip(log[1] - log[0], -MOST_LOG_ODDS, MOST_LOG_ODDS)))


def _scored(model: Discriminant | None, rate: float):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column(batch.num_columns - 1).to_pylist()).reshape(-1, len(NAMES))
            score = model.scores(x) if model else np.full(len(x), rate)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(score)], [*batch.schema.names[:-1], "score"])

    return kernel


def score_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 5, held: int = 0, limit: float = 0.3
) -> DataFrame:
    """Per row of ``docs``: id, held_out (crc32 of the id as text modulo folds is ``held``), score (0 to 1,
    higher: label 1 likelier), predicted (1 if score >= limit).

    Only labels of rows that aren't held out are learned, all of them. Texts alone make a score; null
    and empty ones get the score of no words. Null labels and labels without a document are ignored;
    repeated rows count as often. Without labels of both classes, every score is the smoothed share of
    label 1. Other columns are not looked at.
    """
    base = texts(docs, id_col, text_col)
    kind = dict(base.dtypes)["id"]
    seen = written(base.mapInArrow(_features, f"id {kind}, x array<double>"))
    fold = (remainder("id", folds) == held).alias("held_out")
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("label in (0, 1)")
    train = seen.join(known, "id").where(~fold).select("label", "x")
    parts = train.mapInArrow(_moments, "i int, v double").groupBy("i").agg(F.sum("v").alias("v"))
    d = len(NAMES) + 1
    sums = np.zeros(2 * d * d)
    for i, v in parts.collect():  # 2 d d rows
        sums[i] = v
    sums = sums.reshape(2, d, d)
    rate = (sums[1, 0, 0] + 1) / (sums[:, 0, 0].sum() + 2)
    scored = seen.select("id", fold, "x").mapInArrow(_scored(Discriminant.fit(sums), float(rate)), f"id {kind}, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= limit).cast("int")).withColumnRenamed("id", id_col)
