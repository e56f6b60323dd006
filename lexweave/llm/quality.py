"""Quality classifier: regularised quadratic discriminant analysis.

Each whole text becomes a row of transformed document statistics (ratios by
byte class, word shapes, repetition, line shape).  Each class gets a mean and a
covariance, shrunk towards the pooled covariance and its diagonal.  A text's
score is the logistic function of the difference of the classes' log densities,
each a Mahalanobis term through the cached inverse of a Cholesky factor.

Fitting uses sums (count, sum, products) that executors form and Spark adds up:
it covers every labelled row, and only one row per statistic pair reaches the
driver.

Defined cases: null and empty texts have all counts 0 and get a score like any
other text; label values other than 0 and 1 and conflicting labels of one id
teach nothing; without labels of both classes the score is the share of label 1
(1/2 with none at all); repeated rows get equal scores; empty tables give an
empty result; existing columns named like the outputs are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WordHasher, map_arrow, nonspace_table, text_slices

_CLASSES = 12


def _byte_classes() -> np.ndarray:
    """0 lower, 1 upper, 2 digit, 3 space, 4 newline, 5 . and comma, 6 ! and ?, 7 pipe, 8 symbols of junk, 9 other ASCII marks, 10 bytes from 80, 11 control."""
    t = np.full(256, 9, np.uint8)
    t[:32] = 11
    t[97:123], t[65:91], t[48:58] = 0, 1, 2
    t[[32, 9, 11, 12, 13]] = 3
    t[10] = 4
    t[[46, 44]], t[[33, 63]], t[124] = 5, 6, 7
    for c in b"$%&*#@^~<>{}[]\\_=+":
        t[c] = 8
    t[128:], t[127] = 10, 11
    return t


STATISTICS = (
    "upper", "digit", "stop_marks", "excited", "pipe", "symbol", "other_mark", "high", "control", "word_length", "word_spread",
    "long_words", "adjacent_repeats", "distinct_words", "line_length", "upper_starts"
)
#: Rates of ordinary prose; a short text's rates are drawn towards them, as if it held this many further bytes or words of prose.
PROSE = {1: 0.03, 2: 0.005, 5: 0.02, 6: 0.002, 7: 0.001, 8: 0.001, 9: 0.005, 10: 0.02, 11: 0.001}
PROSE_BYTES, PROSE_WORDS = 120, 20


def _hasher() -> WordHasher:
    return WordHasher(nonspace_table(), lower=True)


def statistics(data: np.ndarray, offsets: np.ndarray, hasher: WordHasher) -> np.ndarray:
    """(documents, statistics) for concatenated UTF-8 texts."""
    n, size = len(offsets) - 1, np.diff(offsets).astype(float)
    classes = _byte_classes()[data]
    at = np.flatnonzero((classes != 0) & (classes != 3))  # letters and spaces, most of a text, are not asked for
    doc = np.searchsorted(offsets, at, "right") - 1
    counts = np.bincount(doc * _CLASSES + classes[at], minlength=n * _CLASSES).reshape(n, _CLASSES).astype(float)
    hashes, before = hasher(data, offsets)
    starts, ends, _ = hasher.spans(data, offsets)
    words = np.diff(before).astype(float)
    owner = np.repeat(np.arange(n), np.diff(before))
    length = (ends - starts).astype(float)
    total = lambda x: np.bincount(owner, weights=x, minlength=n)
    w = np.maximum(words, 1)
    mean = total(length) / w
    same = np.zeros(len(hashes))
    if len(hashes) > 1:
        same[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    # 44 bits of a word's hash tell the words of one text apart
    kinds = np.sort(owner.astype(np.uint64) << np.uint64(44) | hashes >> np.uint64(20))
    distinct = np.bincount((kinds[np.diff(kinds, prepend=~kinds[:1]) != 0] >> np.uint64(44)).astype(np.int64), minlength=n)
    upper_start = total(((data[starts] >= 65) & (data[starts] <= 90)).astype(float)) if len(starts) else np.zeros(n)
    ratio = lambda k: np.log((counts[:, k] + PROSE_BYTES * PROSE[k]) / (size + PROSE_BYTES) + 1e-3)
    share = lambda x, usual: np.log((x + PROSE_WORDS * usual) / (words + PROSE_WORDS) + 1e-2)
    return np.stack([
        *(ratio(k) for k in PROSE),
        np.log((total(length) + 6 * PROSE_WORDS) / (words + PROSE_WORDS)), np.log(
            (total((length - mean[owner]) ** 2) + 9 * PROSE_WORDS) / (words + PROSE_WORDS)
        ),
        share(total((length > 20).astype(float)), 0.01), share(total(same), 0.005), np.log(distinct + 5) - 0.85 * np.log(words + 5),
        np.log((size + 3 * PROSE_BYTES) / (counts[:, 4] + 1)), share(upper_start, 0.1),
    ], 1)


def document_statistics(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, stats array<double>) of every whole text."""
    source = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    schema = T.StructType([source.schema["key"], T.StructField("stats", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = _hasher()
        for batch in batches:
            x = [statistics(data, offsets, hasher) for _, _, data, offsets in text_slices(batch, "text")]
            x = np.concatenate(x) if x else np.zeros((0, len(STATISTICS)))
            stats = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(STATISTICS), pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("key"), stats], ["key", "stats"])

    return map_arrow(source, run, schema)


@dataclass
class QuadraticDiscriminant:
    prior: float  # share of label 1
    means: np.ndarray | None = None
    factors: np.ndarray | None = None  # inverse Cholesky factors
    logdets: np.ndarray | None = None

    @classmethod
    def from_moments(
        cls, count: np.ndarray, total: np.ndarray, products: np.ndarray, shrink: float = 0.1, diagonal: float = 0.1, floor: float = 1e-4
    ) -> QuadraticDiscriminant:
        """count (2,), sums (2, k) and sums of products (2, k, k) of the classes 0 and 1."""
        if count.sum() == 0:
            return cls(0.5)
        prior = float(count[1] / count.sum())
        if count.min() < 2:
            return cls(prior)
        means = total / count[:, None]
        cov = products / count[:, None, None] - means[:, :, None] * means[:, None, :]
        pooled = (cov * count[:, None, None]).sum(0) / count.sum()
        cov = (1 - shrink) * cov + shrink * pooled
        k = cov.shape[1]
        cov = (1 - diagonal) * cov + diagonal * (cov * np.eye(k)) + floor * np.eye(k)
        chol = np.linalg.cholesky(cov)
        return cls(prior, means, np.linalg.inv(chol), 2 * np.log(np.diagonal(chol, axis1=1, axis2=2)).sum(1))

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1."""
        if self.means is None:
            return np.full(len(x), self.prior)
        d = [-0.5 * (np.square((x - self.means[c]) @ self.factors[c].T).sum(1) + self.logdets[c]) for c in (0, 1)]
        z = d[1] - d[0] + np.log(self.prior / (1 - self.prior))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def fit(stats: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", **options) -> QuadraticDiscriminant:
    """Fit on all rows of (key, stats) whose key has a label in ``labels``."""
    known = labels.select(
        F.col(f"`{key}`").alias("key"), F.col(f"`{label}`").cast("int").alias("y")
    ).filter("key IS NOT NULL AND y IN (0, 1)").groupBy("key").agg(F.min("y").alias("y"), F.max("y").alias("hi")).filter("y = hi")
    joined = stats.join(known.select("key", "y"), "key").select("y", "stats")
    k = len(STATISTICS)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc = np.zeros((2, 1 + k + k * k))
        for batch in batches:
            y = batch.column("y").to_numpy(zero_copy_only=False)
            x = np.asarray(batch.column("stats").flatten()).reshape(-1, k)
            for c in (0, 1):
                own = x[y == c]
                acc[c] += np.concatenate([[len(own)], own.sum(0), (own.T @ own).ravel()])
        c, i = np.indices(acc.shape)
        yield pa.RecordBatch.from_arrays([pa.array(c.ravel(), pa.int32()), pa.array(i.ravel(), pa.int32()), pa.array(acc.ravel())], ["c", "i", "v"])

    rows = map_arrow(joined, moments, "c int, i int, v double").groupBy("c", "i").agg(F.sum("v").alias("v")).collect()
    acc = np.zeros((2, 1 + k + k * k))
    for r in rows:
        acc[r["c"], r["i"]] = r["v"]
    return QuadraticDiscriminant.from_moments(acc[:, 0], acc[:, 1 : 1 + k], acc[:, 1 + k :].reshape(2, k, k), **options)


def score(stats: DataFrame, model: QuadraticDiscriminant, score_col: str = "score") -> DataFrame:
    """(key, score) from (key, stats)."""
    schema = T.StructType([stats.schema["key"], T.StructField(score_col, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch.column("stats").flatten()).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(model.score(x))], ["key", score_col])

    return map_arrow(stats.select("key", "stats"), run, schema)


def score_documents(docs: DataFrame, model: QuadraticDiscriminant, text: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with the score of every whole text, in one pass."""
    kept = [c for c in docs.columns if c != score_col]
    source = docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*kept, text])])
    schema = T.StructType([source.schema[c] for c in kept] + [T.StructField(score_col, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = _hasher()
        for batch in batches:
            x = [model.score(statistics(data, offsets, hasher)) for _, _, data, offsets in text_slices(batch, text)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [pa.array(np.concatenate(x) if x else np.zeros(0))], [*kept, score_col])

    return map_arrow(source, run, schema)
