"""Ordinal quality classifier: a cumulative-link model over hashed text.

A grade ``y`` in ``0..K-1`` has ``P(y <= k) = sigmoid(theta_k - s)``; the score ``s = w . x`` shares one
weight vector over all thresholds and ``theta_0 < theta_1 < ...`` hold by construction.  The expected
grade and the tail probability ``P(y >= K-1)`` follow, and selection asks for the tail.

Features: the square roots of the shares that each hashed word, and each hashed run of punctuation,
has in the document (so a document's vector has length one for either kind), and three surface
figures: the shares of upper-case letters, of words that repeat their predecessor, and of
punctuation.  Whole texts count.

Fitting uses at most ``train_rows`` labelled documents, those of the least id hash; that bound is
the only sample.  Scoring is one narrow pass, no shuffle; the weights travel in the task closure and
their size is fixed by ``bits``.

Defined cases: a null, empty or wordless text has expected grade 0 and tail probability 0 and is
never selected.  Label rows with a null in id, quality or toxic are left out; of several labels for an
id the lowest grade counts; several rows of an id are all used and all scored.  With no usable label,
or one grade only, the model is constant and selects every text that has words.  Columns named as an
added column are replaced; other extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docquarry.llm.common import documents_only, lean, with_columns
from docquarry.llm.tokens import U64, WORD_BYTE, Words, runs, slices, span_hashes, string_buffers

BITS = 16
TRAIN_ROWS = 8000
KEEP_AT = 0.7
RIDGE = 1e-5
LEAST_ROWS = 3
SURFACE = 3

_SPACE = np.zeros(256, bool)
_SPACE[list(b" \t\r\n\f\v")] = True
_MARK_BYTE = ~(WORD_BYTE | _SPACE)
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = _UPPER.copy()
_LETTER[97:123] = True


def _shares(rows: np.ndarray, hashes: np.ndarray, n_rows: int, bits: int, kind: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, sqrt of the bucket's share in its row), buckets of a kind apart from the other's."""
    half = bits - 1
    bucket = (hashes >> U64(64 - half)).astype(np.int64) + (kind << half)
    key, count = np.unique((rows << bits) | bucket, return_counts=True)
    row, total = key >> bits, np.bincount(rows, minlength=n_rows)
    return row, key & ((1 << bits) - 1), np.sqrt(count / total[row]).astype(np.float32)


def features(texts: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sparse (row, feature, value), sorted by row, and whether each row has words."""
    n = len(texts)
    words = Words(texts)
    lengths = np.diff(words.row)
    rows = np.repeat(np.arange(n), lengths)
    parts = [_shares(rows, words.hashes, n, bits, 0)]

    data, offsets = words.data, words.offsets
    starts, ends = runs(_MARK_BYTE[data], offsets)
    marks = np.searchsorted(offsets, starts, "right") - 1
    parts.append(_shares(marks, span_hashes(data, starts, ends), n, bits, 1))

    raw, at = string_buffers(texts)
    count = lambda member: np.diff(np.concatenate([[0], np.cumsum(member)])[at])
    upper = count(_UPPER[raw]) / np.maximum(1, count(_LETTER[raw]))
    same = np.zeros(len(rows), bool)
    same[1:] = (words.hashes[1:] == words.hashes[:-1]) & (rows[1:] == rows[:-1])
    repeated = np.bincount(rows[same], minlength=n) / np.maximum(1, lengths)
    marked = count(_MARK_BYTE[raw]) / np.maximum(1, np.diff(at))
    for k, figure in enumerate((upper, repeated, marked)):
        parts.append((np.arange(n), np.full(n, (1 << bits) + k), figure.astype(np.float32)))
    row, feature, value = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(row, kind="stable")
    return row[order], feature[order], value[order], lengths > 0


@dataclass(frozen=True)
class CumulativeLink:
    """Weights over hashed features and ordered thresholds, one fewer than the grades."""

    weights: np.ndarray
    thresholds: np.ndarray
    bits: int = BITS

    def scores(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        row, feature, value, worded = features(texts, self.bits)
        return np.bincount(row, weights=self.weights[feature] * value, minlength=len(texts)), worded

    def grades(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Expected grade and P(highest grade) of each text."""
        score, worded = self.scores(texts)
        above = 1.0 / (1.0 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -500, 500)))
        return np.where(worded, above.sum(1), 0.0), np.where(worded, above[:, -1], 0.0)


def fit_cumulative_link(row: np.ndarray, feature: np.ndarray, value: np.ndarray, grade: np.ndarray, n_grades: int = 3, bits: int = BITS, steps: int = 250, rate: float = 0.3, ridge: float = RIDGE, least_rows: int = LEAST_ROWS, balanced: bool = False) -> CumulativeLink:
    """Maximum likelihood with a ridge by full-batch Adam; deterministic.

    A feature of fewer than ``least_rows`` rows gets no weight: it could only memorise them.
    """
    size, n = (1 << bits) + SURFACE, len(grade)
    if n == 0 or len(np.unique(grade)) < 2:
        return CumulativeLink(np.zeros(size), np.full(n_grades - 1, -20.0), bits)
    common = np.bincount(feature, minlength=size)[feature] >= min(least_rows, n)
    row, feature, value = row[common], feature[common], value[common]
    seen, compact = np.unique(feature, return_inverse=True)
    weight = np.zeros(len(seen))
    below = np.clip([(grade <= k).mean() for k in range(n_grades - 1)], 0.5 / n, 1 - 0.5 / n)
    cuts = np.log(below / (1 - below))
    free = np.concatenate([[cuts[0]], np.log(np.maximum(np.diff(cuts), 1e-3))])
    counts = np.bincount(grade, minlength=n_grades)
    share = (1.0 / (counts[grade] * np.count_nonzero(counts))) if balanced else np.full(n, 1.0 / n)
    moment = [np.zeros(len(seen) + len(free)), np.zeros(len(seen) + len(free))]
    for step in range(1, steps + 1):
        gap = np.exp(np.clip(free[1:], -20, 10))
        theta = free[0] + np.concatenate([[0.0], np.cumsum(gap)])
        score = np.bincount(row, weights=weight[compact] * value, minlength=n)
        edge = np.concatenate([[-np.inf], theta, [np.inf]])
        with np.errstate(over="ignore"):
            cdf = 1.0 / (1.0 + np.exp(-(edge[None, :] - score[:, None])))
        low, high = cdf[np.arange(n), grade], cdf[np.arange(n), grade + 1]
        p = np.maximum(high - low, 1e-12)
        slope_low, slope_high = low * (1 - low), high * (1 - high)
        d_score = (slope_high - slope_low) / p * share  # of the negative log-likelihood
        d_edge = np.zeros(n_grades + 1)
        np.add.at(d_edge, grade + 1, -slope_high / p * share)
        np.add.at(d_edge, grade, slope_low / p * share)
        d_theta = d_edge[1:-1]
        tail = np.cumsum(d_theta[::-1])[::-1]
        gradient = np.concatenate([np.bincount(compact, weights=d_score[row] * value, minlength=len(seen)) + ridge * weight, [tail[0]], tail[1:] * gap])
        moment[0] = 0.9 * moment[0] + 0.1 * gradient
        moment[1] = 0.99 * moment[1] + 0.01 * gradient**2
        move = rate * (moment[0] / (1 - 0.9**step)) / (np.sqrt(moment[1] / (1 - 0.99**step)) + 1e-8)
        weight -= move[: len(seen)]
        free -= move[len(seen) :]
    full = np.zeros(size)
    full[seen] = weight
    return CumulativeLink(full, free[0] + np.concatenate([[0.0], np.cumsum(np.exp(np.clip(free[1:], -20, 10)))]), bits)


def grade_column() -> F.Column:
    """The graded rating: one point for quality and one for not being toxic."""
    return (F.col("quality").cast("int") + 1 - F.col("toxic").cast("int")).cast("int")


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, bits: int = BITS) -> CumulativeLink:
    """Fit on at most ``train_rows`` labelled ids; their features come to the driver, so its share is bounded."""
    rated = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), grade_column().alias("grade"))
        .where("doc_id is not null and grade between 0 and 2")
        .groupBy("doc_id").agg(F.min("grade").alias("grade"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    )
    chosen = documents_only(docs).where("text is not null").join(rated, "doc_id")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column("text")):
                row, feature, value, worded = features(batch.column("text").slice(a, b - a), bits)
                at = np.searchsorted(row, np.arange(b - a + 1))
                keep = pa.array(worded)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(a, b - a).filter(keep),
                        batch.column("grade").slice(a, b - a).filter(keep),
                        pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(feature, pa.int32())).filter(keep),
                        pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(value, pa.float32())).filter(keep),
                    ],
                    names=["doc_id", "grade", "feature", "value"],
                )

    got = chosen.mapInArrow(lean(extract), "doc_id long, grade int, feature array<int>, value array<float>").toArrow().combine_chunks()
    if got.num_rows == 0:
        return fit_cumulative_link(np.zeros(0, int), np.zeros(0, int), np.zeros(0), np.zeros(0, int), bits=bits)
    got = got.sort_by("doc_id").combine_chunks()
    lists = got["feature"].combine_chunks()
    row = np.repeat(np.arange(got.num_rows), lists.value_lengths().to_numpy())
    return fit_cumulative_link(row, lists.flatten().to_numpy(), got["value"].combine_chunks().flatten().to_numpy(), got["grade"].to_numpy().astype(int), bits=bits)


def score(docs: DataFrame, model: CumulativeLink, text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` with ``expected_grade`` and ``tail_probability``."""
    schema = with_columns(docs.schema, [("expected_grade", T.DoubleType()), ("tail_probability", T.DoubleType())])
    kept = schema.names[:-2]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text_col)
            for a, b in slices(texts):
                expected, tail = model.grades(texts.slice(a, b - a))
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([part.column(c) for c in kept] + [pa.array(np.round(expected, 6)), pa.array(np.round(tail, 6))], names=schema.names)

    return docs.mapInArrow(lean(apply), schema)


def select(docs: DataFrame, labels: DataFrame, keep_at: float = KEEP_AT, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """The documents whose tail probability is ``keep_at`` or more, with both figures."""
    return score(docs, fit(docs, labels, train_rows)).where(F.col("tail_probability") >= keep_at)


def kept(docs: DataFrame, model: CumulativeLink, keep_at: float = KEEP_AT, text_col: str = "text") -> DataFrame:
    """The rows that ``select`` would keep, with their own columns and no others."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text_col)
            for a, b in slices(texts):
                yield batch.slice(a, b - a).filter(pa.array(np.round(model.grades(texts.slice(a, b - a))[1], 6) >= keep_at))

    return docs.mapInArrow(lean(apply), docs.schema)
