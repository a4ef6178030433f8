"""Quality by a regularised quadratic discriminant over transformed document statistics.

Statistics of every text are computed once. Each class gets a mean and a covariance shrunk towards a multiple of the
identity; a score is the posterior from the difference of log densities, with Mahalanobis distances through Cholesky
factors that a worker keeps. Class moments are sums over all labelled training rows, so nothing is sampled, and only
sums reach the driver.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .labels import fold, training_labels

FEATURES = (
    "log_words", "log_word_chars", "distinct_words", "top_word", "top_five", "repeated_lines", "line_words",
    "letters", "upper", "digits", "symbols", "bars", "symbol_ends", "short_words", "squeezed", "doubled",
)
_LETTER = re.compile(r"[^\W\d_]+")
_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]+")
_DIGIT = re.compile(r"\d+")
_SYMBOL = re.compile(r"[^\w\s.,;:'\"()-]+")
CLIP = 6.0


def _count(pattern: re.Pattern, text: str) -> int:
    return sum(map(len, pattern.findall(text)))


def statistics(text: str) -> list[float]:
    """Transformed statistics of a whole text; an empty one has zeros."""
    words = text.split()
    if not words:
        return [0.0] * len(FEATURES)
    chars, n = len(text), len(words)
    counts = Counter(words)
    top = [c for _, c in counts.most_common(5)]
    lines = [x for x in text.split("\n") if x.strip()]
    raw = text.encode()
    ends = sum(1 for w in counts if not w[-1].isalnum() and w[-1] not in ".,;:")
    doubled = sum(a == b for a, b in zip(words, words[1:], strict=False))
    return [
        np.log1p(n),
        np.log(chars / n),
        len(counts) / n**0.8,
        np.log(1e-3 + top[0] / n),
        np.log(1e-3 + sum(top) / n),
        np.sqrt(1 - len(set(lines)) / len(lines)),
        np.log1p(n / len(lines)),
        np.log(1.001 - _count(_LETTER, text) / chars),
        np.log(1e-3 + _count(_UPPER, text) / chars),
        np.sqrt(_count(_DIGIT, text) / chars),
        np.log(1e-3 + _count(_SYMBOL, text) / chars),
        np.sqrt(text.count("|") / n),
        np.sqrt(ends / len(counts)),
        sum(c for w, c in counts.items() if len(w) <= 3) / n,
        np.log(len(zlib.compress(raw, 1)) / len(raw)),
        np.sqrt(doubled / n),
    ]


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, x``: a vector for each row; null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [statistics(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "x"])

    slim = docs.select(F.col(id_col).cast("long"), F.coalesce(F.col(text_col), F.lit("")))
    return slim.mapInArrow(run, "doc_id long, x array<double>")


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Count, sum and sum of outer products by class: a row per class and task."""
    d = len(FEATURES)
    total = {y: [0, np.zeros(d), np.zeros((d, d))] for y in (0, 1)}
    for batch in batches:
        y = batch.column(0).to_numpy()
        x = batch.column(1).flatten().to_numpy().reshape(-1, d)
        for c, t in total.items():
            own = x[y == c]
            t[0] += len(own)
            t[1] += own.sum(0)
            t[2] += own.T @ own
    rows = [(y, n, *s, *p.ravel()) for y, (n, s, p) in total.items() if n]
    yield pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int32()), pa.array([[float(v) for v in r[1:]] for r in rows], pa.list_(pa.float64()))],
        names=["y", "m"],
    )


class Discriminant:
    """Two shrunk Gaussians. One class alone, or no label, gives a constant score."""

    def __init__(self, moments: dict[int, np.ndarray], shrink: float = 0.05, floor: float = 0.05):
        d = len(FEATURES)
        n = {y: m[0] for y, m in moments.items()}
        total = sum(moments.values()) if moments else None
        self.constant = None
        if len(moments) < 2:
            self.constant = float(1 in moments)
            return
        self.center = total[1 : d + 1] / total[0]
        spread = np.sqrt(np.maximum(np.diag(total[d + 1 :].reshape(d, d)) / total[0] - self.center**2, 1e-12))
        self.scale = np.where(spread > 1e-6, spread, 1.0)
        self.classes = []
        for y in (0, 1):
            mean = moments[y][1 : d + 1] / n[y]
            cov = moments[y][d + 1 :].reshape(d, d) / n[y] - np.outer(mean, mean)
            cov /= np.outer(self.scale, self.scale)
            a = min(1.0, shrink + d / (n[y] + d))  # few rows lean on the sphere
            cov = (1 - a) * cov + a * (np.trace(cov) / d + floor) * np.eye(d)
            factor = np.linalg.cholesky(cov)
            inverse = np.linalg.solve(factor, np.eye(d))
            prior = np.log(n[y] / total[0]) - np.log(np.diag(factor)).sum()
            self.classes.append(((mean - self.center) / self.scale, inverse, prior))

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        z = np.clip((x - self.center) / self.scale, -CLIP, CLIP)
        log = [prior - 0.5 * (((z - mean) @ inverse.T) ** 2).sum(1) for mean, inverse, prior in self.classes]
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -700, 700)))


def fit(statistics_: DataFrame, labels: DataFrame) -> Discriminant:
    """``labels(doc_id, y)`` against ``document_statistics``; a row of sums per task reaches the driver, merged in order."""
    joined = statistics_.join(labels, "doc_id").select("y", "x")
    parts = joined.mapInArrow(_moments, "y int, m array<double>")
    width = 1 + len(FEATURES) * (1 + len(FEATURES))
    sums = parts.groupBy("y").agg(*[F.sum(F.col("m")[i]).alias(f"m{i}") for i in range(width)]).collect()
    return Discriminant({r["y"]: np.array([r[f"m{i}"] for i in range(width)]) for r in sums})


def score_quality(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, threshold: float = 0.3) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row; labels of the held-out fold are never seen.

    Null and empty texts have zero statistics and a score like any other; null ids are scored and count as held out;
    repeated rows are scored each; other columns are ignored; empty tables give an empty result.
    """
    known = materialise(document_statistics(docs), "quality")
    model = fit(known, training_labels(labels, "quality", folds, held_out))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(x))], names=["doc_id", "score"])

    scored = known.mapInArrow(run, "doc_id long, score double")
    out = F.coalesce(fold(F.col("doc_id"), folds) == held_out, F.lit(True))
    return scored.select(
        "doc_id", out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
