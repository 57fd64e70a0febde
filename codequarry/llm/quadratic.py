"""Quality classifier: regularised quadratic discriminant (operator 5).

Every whole text becomes a vector of transformed statistics.  Each class has a
mean and a covariance, shrunk towards the pooled one and a multiple of unity;
the score is the logistic of the difference of the two log densities, from Mahalanobis
distances by the covariances' Cholesky factors, which are made once.

Fitting is exact over all labelled rows: partitions send sums of x and x x',
so only a few numbers for each partition pass the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import held_out, only, prepare, save
from ._words import BLANK, text_bytes, words
from .fertility import _dup_lines, repeated

TO_POOLED, TO_UNIT = 0.05, 0.02  #: shrinkage
NAMES = ["log_words", "word_length", "upper", "digits", "symbols", "bars", "bangs", "stops", "dup_lines", "repeats", "log_line", "distinct", "common", "non_ascii", "odd_ends"]


def _is(chars: bytes) -> np.ndarray:
    t = np.zeros(256, dtype=np.float64)
    t[list(chars)] = 1
    return t


_CLASSES = {"upper": _is(bytes(range(65, 91))), "digits": _is(b"0123456789"), "symbols": _is(b"#*$%&<>{}[]~^=\\@"), "bars": _is(b"|"), "bangs": _is(b"!?"), "stops": _is(b".,;:"), "non_ascii": _is(bytes(range(0xC2, 0xF5)))}


def text_features(col: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """First row, and float64[documents, NAMES], for chunks of whole documents."""
    data, off = text_bytes(col)
    for w in words(col, BLANK):
        at = off[w.row : w.row + len(w) + 1] - off[w.row]
        sums = lambda x: (s := np.concatenate(([0.0], np.cumsum(x))))[at[1:]] - s[at[:-1]]
        n = np.diff(w.off).astype(np.float64)
        some = np.maximum(n, 1)
        size = w.end - w.start
        byte_n = np.bincount(w.doc(), weights=size, minlength=len(w))
        by = {k: sums(t[w.data]) for k, t in _CLASSES.items()}
        share = {k: v / np.maximum(byte_n, 1) for k, v in by.items()}
        dup = np.array([_dup_lines(w.data[a:b].tobytes()) for a, b in zip(at, at[1:], strict=False)], dtype=np.float64)
        lines = sums(w.data == 10) + 1
        distinct, common = np.zeros(len(w)), np.zeros(len(w))
        for i in range(len(w)):
            h = w.hash[w.off[i] : w.off[i + 1]]
            if len(h):
                count = np.unique(h, return_counts=True)[1]
                distinct[i], common[i] = len(count) / len(h) ** 0.9, count.max() / len(h)
        last = w.data[w.end - 1] if len(w.end) else np.zeros(0, np.uint8)
        odd = ~(((last >= 48) & (last < 58)) | ((last | 32) >= 97) & ((last | 32) < 123) | (last >= 128) | np.isin(last, list(b".,;:!?\"')")))
        root = lambda x: np.sqrt(np.maximum(x, 0))
        yield w.row, np.column_stack([
            np.log1p(n), np.log1p(byte_n / some), root(share["upper"]), root(share["digits"]), root(share["symbols"]), root(share["bars"]), root(share["bangs"]), root(share["stops"]),
            root(dup / lines), root(repeated(w) / some), np.log1p(n / lines), distinct, root(common), root(share["non_ascii"]), root(np.bincount(w.doc(), weights=odd, minlength=len(w)) / some),
        ])


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, x in text_features(batch.column("text")):
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(row, len(x)), lists], names=["doc_id", "x"])


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.asarray(batch.column("x").flatten()).reshape(batch.num_rows, -1)


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each class in a partition: rows, sum of x, sum of x x'."""
    total: dict[int, list] = {}
    for batch in batches:
        y, x = np.asarray(batch.column("y")), _matrix(batch)
        for c in (0, 1):
            part = x[y == c]
            have = total.setdefault(c, [0, 0.0, 0.0])
            have[0], have[1], have[2] = have[0] + len(part), have[1] + part.sum(axis=0), have[2] + part.T @ part
    for c, (n, s, q) in total.items():
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([c]), pa.array([n]), pa.array([np.concatenate([s, q.ravel()])], pa.list_(pa.float64()))], names=["y", "n", "sums"])


class QuadraticModel:
    """Gaussian of each class with shrunk covariance; Cholesky factors are kept."""

    def __init__(self, moments: dict[int, tuple[int, np.ndarray, np.ndarray]]) -> None:
        self.classes = {}
        n = sum(m[0] for m in moments.values())
        if set(moments) != {0, 1}:
            self.constant = 1.0 if set(moments) == {1} else 0.0 if set(moments) == {0} else 0.5
            return
        self.constant = None
        mean = sum(m[1] for m in moments.values()) / n
        var = sum(np.diag(m[2]) for m in moments.values()) / n - mean**2
        self.mean, self.scale = mean, np.sqrt(np.maximum(var, 1e-12)) + 1e-6
        cov = {}
        for c, (k, s, q) in moments.items():
            mu = s / k
            cov[c] = (k, (mu - self.mean) / self.scale, (q / k - np.outer(mu, mu)) / np.outer(self.scale, self.scale))
        pooled = sum(k * v for k, _, v in cov.values()) / n
        for c, (k, mu, v) in cov.items():
            v = (1 - TO_POOLED) * v + TO_POOLED * pooled
            v = (1 - TO_UNIT) * v + TO_UNIT * max(np.trace(v) / len(v), 1e-6) * np.eye(len(v))
            factor = np.linalg.cholesky(v)
            self.classes[c] = (mu, np.linalg.inv(factor), np.log(np.diag(factor)).sum(), np.log(k / n))

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        z = (x - self.mean) / self.scale
        log = {}
        for c, (mu, inverse, half_log_det, prior) in self.classes.items():
            d = (z - mu) @ inverse.T
            log[c] = prior - half_log_det - 0.5 * (d**2).sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(log[1] - log[0], -700, 700)))


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(_matrix(batch)) if batch.num_rows else [], pa.float64())], names=["doc_id", "score"])

    return run


def fit(features: DataFrame, labels: DataFrame) -> QuadraticModel:
    """From features (doc_id, x) and labels (doc_id, quality 0 or 1) of rows that aren't held out.

    Other labels and nulls are left out; a doc_id with several labels counts once for each different one.
    """
    y = only(labels, ("doc_id", "bigint"), ("quality", "int")).filter(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"))).distinct()
    rows = features.join(y.withColumnRenamed("quality", "y"), "doc_id").select(F.col("y").cast("long").alias("y"), "x")
    parts = rows.mapInArrow(_moments, "y long, n long, sums array<double>")
    k, got = len(NAMES), {}
    folded = parts.select("y", "n", F.posexplode("sums").alias("i", "v")).groupBy("y", "i").agg(F.sum("n").alias("n"), F.sum("v").alias("v"))
    by: dict[int, list] = {}
    for r in folded.collect():  # two classes of len(NAMES) * (len(NAMES) + 1) numbers
        by.setdefault(r.y, []).append((r.i, r.n, r.v))
    for c, vals in by.items():
        v = np.array([x[2] for x in sorted(vals)])
        got[int(c)] = (int(vals[0][1]), v[:k], v[k:].reshape(k, k))
    return QuadraticModel(got)


def quality_scores(docs: DataFrame, labels: DataFrame, least: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of every document.

    docs: doc_id (a whole number), text; labels: doc_id, quality; more columns are ignored.
    score: from 0 to 1, higher where label 1 is likelier; predicted: 1 if score >= ``least``.
    A null or empty text is scored by its statistics, which are 0.  Without labels
    of both classes the score is that of the only class, or 0.5 without any.
    Rows that repeat a doc_id are scored each by its own text.  A null doc_id has no
    label and is not held out.  An empty table gives an empty result.
    """
    prepare(docs.sparkSession)
    features = save(only(docs, ("doc_id", "bigint"), ("text", "string")).mapInArrow(_measure, "doc_id long, x array<double>"), "statistics")
    model = fit(features, labels)
    got = features.mapInArrow(_score(model), "doc_id long, score double")
    return got.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))
