"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

The lexicon is a short list of common insults and what the labelled training rows add: words and word beginnings that
toxic texts use far more often than others, picked so that each explains texts that the others do not. Trees and lexicon are fitted on a
bounded, repeatable sample of the training rows; features, scores and calibration cover every whole text.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .labels import bounded_sample, fold, training_labels

#: Bounds of the fit: labelled rows of each class, and learned lexicon entries.
SAMPLE_PER_CLASS = 6_000
LEXICON = 2_000
STEMS = (4, 5, 6)
NEAR = 6
#: Terms that are passed on at once.
PASSED = 32_768

# Common insults, second-person words, look-alike characters.
INSULTS = frozenset(
    "idiot idiots stupid moron morons loser losers dumb fool scum trash garbage worthless pathetic disgusting clown "
    "imbecile jerk vermin filth filthy hateful bastard retard dumbass freak coward liar pig".split()
)
SECOND = frozenset(
    "you your yours yourself u ur du dich dir dein deine ihr euch tu toi te ton ta tes vous votre vos tú ti usted ustedes "
    "vosotros".split()
)
LOOK_ALIKE = str.maketrans("013457@$!", "oieastasi")

_WORD = re.compile(r"\S+")
_EDGE = ".,;:!?\"'()[]{}*%#&$-_…«»“”"
_HIDDEN = re.compile(r"[^\W\d_][0-9@$!*][^\W\d_]")
_CAPITAL = re.compile(r"[A-ZÀ-ÖØ-Þ]+")
_LETTER = re.compile(r"[^\W\d_]+")
_MARK = re.compile(r"[^\w\s]+")
FEATURES = (
    "hits", "hit_rate", "distinct_hits", "insults", "insult_rate", "stems", "stem_rate", "weight", "near_second",
    "near_rate", "second_rate", "capitals", "capital_words", "exclaims", "marks", "hidden_rate", "log_words",
)


def normal(word: str) -> str:
    """Lower case, edges stripped, look-alikes undone inside a word that has letters."""
    w = word.lower().strip(_EDGE)
    return w.translate(LOOK_ALIKE) if _HIDDEN.search(w) else w


class Reader:
    """Features of texts under a lexicon ``{word or stem + '*': weight}``; knows the words it met lately."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon, self.seen = lexicon, {}

    def _learn(self, word: str) -> tuple[int, float, str] | None:
        """Kind (1 word, 2 insult, 4 stem, 8 second person, 16 hidden letters, 32 capitals), weight, and the word; None for others."""
        w = normal(word)
        kind, weight = 8 * (w in SECOND) + 16 * bool(_HIDDEN.search(word)) + 32 * word.isupper(), 0.0
        if w in self.lexicon:
            kind, weight = kind | 1, self.lexicon[w]
        if w in INSULTS:
            kind |= 2
        for size in STEMS:
            if len(w) >= size and (stem := w[:size] + "*") in self.lexicon:
                kind, weight = kind | 4, max(weight, self.lexicon[stem])
        if len(self.seen) > 400_000:
            self.seen.clear()
        found = (kind, weight, w) if kind else None
        if len(word) <= 48:
            self.seen[word] = found
        return found

    def features(self, text: str) -> list[float]:
        words = _WORD.findall(text)
        n, chars = len(words), len(text)
        if not n:
            return [0.0] * len(FEATURES)
        seen, learn = self.seen, self._learn
        marked = [(i, m) for i, w in enumerate(words) if (m := seen[w] if w in seen else learn(w))]
        hits = [(i, m) for i, m in marked if m[0] & 7]
        second = [i for i, m in marked if m[0] & 8]
        near = sum(1 for i, _ in hits if bisect_right(second, i + NEAR) > bisect_right(second, i - NEAR - 1))
        count = lambda bit: sum(1 for _, m in hits if m[0] & bit)
        a, b, c = count(1), count(2), count(4)
        letters = sum(map(len, _LETTER.findall(text))) or 1
        return [
            np.log1p(a), a / n, np.log1p(len({m[2] for _, m in hits})), np.log1p(b), b / n, np.log1p(c), c / n,
            max((m[1] for _, m in hits), default=0.0), np.log1p(near), near / n, len(second) / n,
            sum(map(len, _CAPITAL.findall(text))) / letters, sum(1 for _, m in marked if m[0] & 32) / n,
            text.count("!") / n, sum(map(len, _MARK.findall(text))) / chars,
            sum(1 for _, m in marked if m[0] & 16) / n, np.log1p(n),
        ]


class Trees:
    """Boosted regression trees on the logistic loss, grown over binned features."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, least: float = 3.0):
        self.rounds, self.depth, self.rate, self.bins, self.least = rounds, depth, rate, bins, least

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)], 1)

    def fit(self, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> Trees:
        q = np.linspace(0, 1, self.bins + 1)[1:-1]
        self.edges = [np.unique(np.concatenate([[1e-12], np.quantile(c, q), np.quantile(c[c > 0], q) if (c > 0).any() else []])) for c in x.T]
        b, width = self._binned(x), max(map(len, self.edges)) + 1
        p = np.clip((w * y).sum() / w.sum(), 1e-4, 1 - 1e-4)
        self.start, self.trees = float(np.log(p / (1 - p))), []
        f = np.full(len(y), self.start)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-f))
            g, h = w * (y - p), np.maximum(w * p * (1 - p), 1e-9)
            node, tree = np.zeros(len(y), np.int64), {}
            for level in range(self.depth):
                for k in range((1 << level) - 1, (2 << level) - 1):
                    own = np.flatnonzero(node == k)
                    if len(own) < 2 * self.least:
                        continue
                    best = (1e-6, -1, 0)
                    for j in range(x.shape[1]):
                        n = np.bincount(b[own, j], minlength=width).cumsum()[:-1]
                        gs = np.bincount(b[own, j], g[own], width).cumsum()
                        hs = np.bincount(b[own, j], h[own], width).cumsum()
                        gain = gs[:-1] ** 2 / (hs[:-1] + 1) + (gs[-1] - gs[:-1]) ** 2 / (hs[-1] - hs[:-1] + 1) - gs[-1] ** 2 / (hs[-1] + 1)
                        gain[(n < self.least) | (n > len(own) - self.least)] = 0
                        if gain.max() > best[0]:
                            best = (gain.max(), j, int(gain.argmax()))
                    if best[1] >= 0:
                        tree[k] = best[1:]
                        node[own] = 2 * k + 1 + (b[own, best[1]] > best[2])
            leaf = {int(k): float(self.rate * g[node == k].sum() / (h[node == k].sum() + 1)) for k in np.unique(node)}
            self.trees.append((tree, leaf))
            f += np.vectorize(leaf.get, otypes=[float])(node)
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        b, f = self._binned(x), np.full(len(x), self.start)
        for tree, leaf in self.trees:
            node = np.zeros(len(x), np.int64)
            for k, (j, at) in sorted(tree.items()):
                own = node == k
                node[own] = 2 * k + 1 + (b[own, j] > at)
            value = np.zeros(2 << self.depth)
            value[list(leaf)] = list(leaf.values())
            f += value[node]
        return f


def isotonic(s: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: steps ``(from score, value)``, values rising."""
    at, group = np.unique(s, return_inverse=True)
    blocks: list[list[float]] = []
    for block in zip(at, np.bincount(group, y * w), np.bincount(group, w), strict=True):
        blocks.append(list(block))
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            _, a, b = blocks.pop()
            blocks[-1][1] += a
            blocks[-1][2] += b
    return np.array([b[0] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


class Model:
    """Trees and calibration; without both classes a constant."""

    def __init__(self, x: np.ndarray, y: np.ndarray, w: np.ndarray, calibrate: np.ndarray):
        self.constant = None
        if len(y) == 0 or y.min() == y.max():
            self.constant = float(len(y) and y[0])
            return
        enough = all((y[m] == c).sum() >= 20 for m in (calibrate, ~calibrate) for c in (0, 1))
        grow, check = (~calibrate, calibrate) if enough else (slice(None), slice(None))
        self.trees = Trees().fit(x[grow], y[grow], w[grow])
        self.at, self.value = isotonic(self.trees.margin(x[check]), y[check], w[check])

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        m = self.trees.margin(x)
        value = self.value[np.clip(np.searchsorted(self.at, m, "right") - 1, 0, len(self.at) - 1)]
        return np.clip(0.999 * value + 0.001 / (1 + np.exp(-m)), 0, 1)  # a trace of the margin orders equal steps


def _cover(doc: np.ndarray, term: np.ndarray, odds: np.ndarray, least: float) -> list[int]:
    """Terms that explain the documents: again and again the one with most documents left, times its log odds.

    A family of near copies counts as explained once one of its words is picked, so its other words are not learned.
    """
    docs, doc = np.unique(doc, return_inverse=True)
    order = np.argsort(doc, kind="stable")
    by_doc = np.split(term[order], np.cumsum(np.bincount(doc, minlength=len(docs)))[:-1])
    order = np.argsort(term, kind="stable")
    by_term = np.split(doc[order], np.cumsum(np.bincount(term, minlength=len(odds)))[:-1])
    left, gain, picked = np.ones(len(docs), bool), np.bincount(term, minlength=len(odds)).astype(float), []
    while len(gain):
        best = int((gain * odds).argmax())
        if gain[best] < least:
            return picked
        picked.append(best)
        for d in np.unique(by_term[best]):
            if left[d]:
                left[d] = False
                np.subtract.at(gain, by_doc[d], 1.0)
    return picked


def term_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``doc, term, y`` of ``doc_id, text, y``; passed on after each text that fills ``PASSED`` rows, so memory does not
    grow with a batch."""

    def told(held: list[tuple]) -> pa.RecordBatch:
        sizes = [len(terms) for _, terms, _ in held]
        doc, y = (np.repeat(np.array([h[i] for h in held], kind), sizes) for i, kind in ((0, np.int64), (2, np.int32)))
        return pa.RecordBatch.from_arrays([pa.array(doc), pa.array([t for _, terms, _ in held for t in terms], pa.string()), pa.array(y)], names=["doc", "term", "y"])

    held, size = [], 0
    for batch in batches:
        for doc, text, y in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            words = {normal(w) for w in set(_WORD.findall(text))} - {""}
            terms = {w for w in words if len(w) <= 40} | {w[:n] + "*" for w in words for n in STEMS if len(w) >= n}
            held.append((doc, sorted(terms), y))
            size += len(terms)
            if size >= PASSED:
                yield told(held)
                held, size = [], 0
    if held:
        yield told(held)


def learn_lexicon(texts: DataFrame, entries: int = LEXICON) -> dict[str, float]:
    """``texts(doc_id, text, y)`` of a bounded sample -> entries with their log odds; stems end in ``*``.

    The candidates are at most ``entries`` terms, each in as many documents of the sample as it may be.
    """

    seen = materialise(texts.select("doc_id", "text", "y").mapInArrow(term_batches, "doc long, term string, y int").distinct(), "toxic-terms")
    size = {r["y"]: r["n"] for r in texts.groupBy("y").agg(F.countDistinct("doc_id").alias("n")).collect()}
    t, n = size.get(1, 0), size.get(0, 0)
    if not t or not n:
        return {}
    least = max(3, 0.004 * t)
    counts = seen.groupBy("term").agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b"))
    odds = F.log((F.col("a") + 0.5) / (t + 1)) - F.log((F.col("b") + 0.5) / (n + 1))
    strong = counts.withColumn("odds", odds).where((F.col("a") >= least) & (F.col("odds") >= 3.0))
    top = strong.orderBy((F.col("a") * F.col("odds")).desc(), "term").limit(entries).select("term", "odds").collect()
    place = {r["term"]: i for i, r in enumerate(top)}
    if not place:
        return {}
    index = texts.sparkSession.createDataFrame(list(place.items()), "term string, i int")
    where = seen.where("y = 1").join(F.broadcast(index), "term").select("doc", "i").toPandas()  # entries and sample are bounded
    picked = _cover(where["doc"].to_numpy(), where["i"].to_numpy(), np.array([r["odds"] for r in top]), least)
    return {top[i]["term"]: float(top[i]["odds"]) for i in picked}


def _mix(word: str) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(word) >> 1


def document_features(docs: DataFrame, lexicon: dict[str, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, x``: a vector for each row; null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(lexicon)
        for batch in batches:
            x = [reader.features(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "x"])

    slim = docs.select(F.col(id_col).cast("long"), F.coalesce(F.col(text_col), F.lit("")))
    return slim.mapInArrow(run, "doc_id long, x array<double>")


def fit(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> tuple[dict[str, float], Model]:
    """``labels(doc_id, y)``: lexicon and model from at most ``per_class`` labelled rows of each class."""
    sample = materialise(bounded_sample(labels, per_class), "toxic-sample")
    few = F.broadcast(sample)  # at most two classes of per_class rows
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(few, "doc_id")
    texts = materialise(known, "toxic-texts")
    lexicon = learn_lexicon(texts)
    vectors = document_features(texts, lexicon).dropDuplicates(["doc_id"])
    rows = vectors.join(F.broadcast(sample), "doc_id").orderBy("doc_id").collect()  # bounded as the sample is
    x = np.array([r["x"] for r in rows]).reshape(-1, len(FEATURES))
    y = np.array([r["y"] for r in rows], float)
    w = np.array([r["weight"] for r in rows])
    part = np.array([_mix(str(r["doc_id"])) % 4 == 0 for r in rows], bool)
    return lexicon, Model(x, y, w, part)


def score_toxicity(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1, threshold: float = 0.7) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row; labels of the held-out fold are never seen.

    Null and empty texts have zero features and a score like any other; null ids are scored and count as held out;
    repeated rows are scored each; other columns are ignored; empty tables give an empty result.
    """
    lexicon, model = fit(docs, training_labels(labels, "toxic", folds, held_out))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(lexicon)
        for batch in batches:
            x = np.array([reader.features(t) for t in batch.column(1).to_pylist()]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(x))], names=["doc_id", "score"])

    slim = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")))
    out = F.coalesce(fold(F.col("doc_id"), folds) == held_out, F.lit(True))
    return slim.mapInArrow(run, "doc_id long, score double").select(
        "doc_id", out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def without_toxic(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1, threshold: float = 0.7) -> DataFrame:
    """The rows that score under the threshold, all columns kept; rows whose text alone decides are judged one by one."""
    lexicon, model = fit(docs, training_labels(labels, "toxic", folds, held_out))

    def toxic(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        reader = Reader(lexicon)
        for s in texts:
            x = np.array([reader.features(t or "") for t in s]).reshape(-1, len(FEATURES))
            yield pd.Series(model.scores(x) >= threshold)

    toxic.__annotations__ = {"texts": Iterator[pd.Series], "return": Iterator[pd.Series]}  # the hints as objects
    return docs.where(~F.pandas_udf(toxic, "boolean")(F.col("text")))
