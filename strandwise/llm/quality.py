"""Document quality by regularised quadratic discriminant analysis.

One pass turns every whole text into a dozen transformed statistics.  Class means and covariances come from exact
sums over all labelled training rows (no sample), the covariances are shrunk towards the pooled one and its
diagonal, and a document's score is the logistic of the difference of the two Gaussian log densities, taken from
Mahalanobis distances through Cholesky factors that are computed once.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from .common import free_name, materialize, word_chunks

FEATURES = [
    "words", "word_length", "upper", "digits", "symbols", "bars", "distinct", "top_word",
    "repeats", "repeated_lines", "line_length", "short_words", "symbol_ends", "high_bytes",
]
_UPPER, _DIGIT = np.arange(65, 91), np.arange(48, 58)
_LETTER = np.concatenate([_UPPER, np.arange(97, 123), np.arange(128, 256)])
_SYMBOL = np.array([c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:'\"!?()-"])
_ENDS = frozenset(b"!#$%&*+/<=>@\\^_`|~")


def _share(part: float, whole: float) -> float:
    """Variance-stabilised share."""
    return math.asin(math.sqrt(min(1.0, part / whole))) if whole else 0.0


def statistics(data: bytes) -> list[float]:
    """The transformed statistics of one text, in the order of FEATURES; all defined for an empty text."""
    counts: Counter[bytes] = Counter()
    n = length = repeats = short = ends = 0
    last = None
    for words in word_chunks(data):
        if not words:
            continue
        counts.update(words)
        n += len(words)
        sizes = [len(w) for w in words]
        length += sum(sizes)
        short += sum(1 for s in sizes if s <= 3)
        repeats += sum(map(bytes.__eq__, words[1:], words)) + (words[0] == last)
        ends += sum(1 for w in words if w[-1] in _ENDS)
        last = words[-1]
    signs = np.bincount(np.frombuffer(data, np.uint8), minlength=256) if data else np.zeros(256, np.int64)
    lines = [x for x in data.split(b"\n") if x.strip()]
    letters, marks = signs[_LETTER].sum(), len(data) - signs[32] - signs[9:14].sum()
    return [
        math.log1p(n),
        math.log1p(length / n) if n else 0.0,
        _share(signs[_UPPER].sum(), letters),
        _share(signs[_DIGIT].sum(), marks),
        _share(signs[_SYMBOL].sum(), marks),
        _share(signs[124], n),
        math.log1p(len(counts)) / math.log1p(n) if n else 1.0,
        _share(max(counts.values(), default=0), n),
        _share(repeats, n),
        _share(len(lines) - len(set(lines)), len(lines)),
        math.log1p(n / len(lines)) if lines else 0.0,
        _share(short, n),
        _share(ends, n),
        _share(signs[128:].sum(), marks),
    ]


def _statistics_kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = np.array([statistics((t.as_py() or "").encode()) for t in batch.column(1)], np.float64).reshape(-1, len(FEATURES))
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(rows[:, i]) for i in range(len(FEATURES)))], ["doc_id", *FEATURES])


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, FEATURES...) per row of ``docs``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_statistics_kernel, "doc_id long, " + ", ".join(f"{f} double" for f in FEATURES))


@dataclass(frozen=True)
class Discriminant:
    """log p(label 1 | x) - log p(label 0 | x) = bias + (|W0 (x - m0)|^2 - |W1 (x - m1)|^2) / 2, W the inverse factors."""

    means: np.ndarray
    whiten: np.ndarray
    bias: float

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        far = [(((x - m) @ w.T) ** 2).sum(1) for m, w in zip(self.means, self.whiten, strict=True)]
        return self.bias + 0.5 * (far[0] - far[1])


def fit(train: DataFrame, label: str, shrink: float = 0.1, ridge: float = 0.05) -> Discriminant | float:
    """Fit on rows of FEATURES with a 0/1 ``label``; other labels are ignored.

    ``shrink`` is the weight of the pooled covariance, ``ridge`` that of its diagonal.  One aggregate row per class
    reaches the driver, whatever the size of ``train``.  With one class only, or none, there is nothing to
    discriminate: the share of label 1 (0.5 without rows) is returned in place of a model.
    """
    d, pairs = len(FEATURES), [(i, j) for i in range(len(FEATURES)) for j in range(i + 1)]
    sums = (
        train.where(F.col(label).isin(0, 1))
        .groupBy(F.col(label).cast("int").alias("y"))
        .agg(
            F.count("*").alias("n"),
            F.array(*(F.sum(f) for f in FEATURES)).alias("s"),
            F.array(*(F.sum(F.col(FEATURES[i]) * F.col(FEATURES[j])) for i, j in pairs)).alias("ss"),
        )
        .collect()
    )
    by = {r.y: r for r in sums}
    if len(by) < 2:
        return float(next(iter(by), 0.5))
    means, scatter = [], []
    for y in (0, 1):
        r = by[y]
        m, outer = np.array(r.s) / r.n, np.zeros((d, d))
        for (i, j), v in zip(pairs, r.ss, strict=True):
            outer[i, j] = outer[j, i] = v
        means.append(m)
        scatter.append(outer - r.n * np.outer(m, m))
    n = [by[0].n, by[1].n]
    pooled = (scatter[0] + scatter[1]) / max(1, sum(n) - 2)
    whiten, logdet = [], []
    for y in (0, 1):
        own = scatter[y] / max(1, n[y] - 1)
        cov = (1 - ridge) * ((1 - shrink) * own + shrink * pooled) + ridge * np.diag(np.diag(pooled)) + 1e-6 * np.eye(d)
        factor = np.linalg.cholesky(cov)
        whiten.append(np.linalg.inv(factor))
        logdet.append(2 * np.log(np.diag(factor)).sum())
    return Discriminant(np.array(means), np.array(whiten), math.log(n[1] / n[0]) + 0.5 * (logdet[0] - logdet[1]))


def _score_kernel(model: Discriminant | float):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if isinstance(model, Discriminant):
                x = np.stack([batch.column(1 + i).to_numpy(zero_copy_only=False) for i in range(len(FEATURES))], 1)
                score = 1 / (1 + np.exp(-np.clip(model.log_odds(x), -700, 700)))
            else:
                score = np.full(len(batch), model)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], ["doc_id", "score"])

    return kernel


def held_out(fold: int = 2, folds: int = 4) -> Column:
    """Rows kept from training: crc32 of the doc_id's text, modulo ``folds``."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == fold, F.lit(False))


def _train(rows: DataFrame, labels: DataFrame, label: str) -> Discriminant | float:
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).alias("label")).where("label is not null")
    return fit(rows.withColumn("doc_id", F.col("doc_id").cast("long")).where(~held_out()).join(marks, "doc_id"), "label")


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted) per row of ``docs`` (doc_id, text; other columns are ignored).

    Learns ``label`` of ``labels`` (doc_id, label) from documents that are not held out.  Null texts count as
    empty; empty texts are scored like any other; null ids and labels train nothing; repeated rows count and are
    returned as often as they occur; without labels of both classes every score is the share of label 1 (0.5
    without any).  Scores are probabilities of label 1, 1 is predicted from ``threshold`` up.
    """
    rows = materialize(features(docs), "features")
    model = _train(rows, labels, label)
    scored = rows.mapInArrow(_score_kernel(model), "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def _with_features_kernel(text: int, name: str):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [statistics((t.as_py() or "").encode()) for t in batch.column(text)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, pa.list_(pa.float64()))], [*batch.schema.names, name])

    return kernel


def _keep_kernel(model: Discriminant, features: int, least: float):
    """Rows whose log odds reach ``least``, without their statistics."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(features).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
            rows = pa.RecordBatch.from_arrays(batch.columns[:features], batch.schema.names[:features])
            yield rows.filter(pa.array(model.log_odds(x) >= least))

    return kernel


def keep_good(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` whose score reaches ``threshold``, all columns kept; see :func:`classify`.  Without labels
    of both classes nothing is known against any row, and all are kept.

    Statistics are taken once, and written beside the rows; rows are scored where they are read, so no text is shuffled
    and repeated or null ids need no care.
    """
    name = free_name(docs, "_features")
    kernel = _with_features_kernel(docs.columns.index("text"), name)
    rows = materialize(docs.mapInArrow(kernel, StructType([*docs.schema.fields, StructField(name, ArrayType(DoubleType()))])), "features")
    model = _train(rows.select("doc_id", *(F.get(name, i).alias(f) for i, f in enumerate(FEATURES))), labels, label)
    if not isinstance(model, Discriminant):
        return docs
    return rows.mapInArrow(_keep_kernel(model, len(docs.columns), math.log(threshold / (1 - threshold))), docs.schema)
