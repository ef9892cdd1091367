"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Features are the distinct character n-grams of a whole lower-cased text, hashed into 2**bits buckets.
Over at most ``counted`` labelled documents of either class, spread by a hash of the id over the training
folds, Spark counts in how many a bucket occurs.  Its log ratio r, smoothed, scales the feature; buckets in fewer than ``least``
documents, or whose ratio is within ``sigmas`` of chance, get weight zero.  A logistic regression over
the scaled features, fitted on a bounded sample, gives weights and a calibrated score.

Driver: 2**bits counts of three longs, and the chosen buckets (at most ``most``) of at most ``per_class``
documents of either class, each counted over whole texts.

Edge cases: null and empty texts have no features and get the intercept's score; without labels of
both classes every score is the share of label 1 (0.5 without any); repeated rows each get a row; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from lociform.llm.common import label_share, labelled_sample, prepare

ORDERS = (3, 4, 5)
BITS = 18


def grams(text: str | None, bits: int = BITS, orders: tuple[int, ...] = ORDERS) -> list[np.ndarray]:
    """Buckets of all n-grams of each order, in place."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    out = []
    for n in orders:
        m = len(points) - n + 1
        if m < 1:
            break
        h = np.full(m, n, np.uint32)
        for k in range(n):
            h = (h ^ points[k : k + m]) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
        out.append(h >> np.uint32(32 - bits))
    return out


@dataclass
class Linear:
    """Weight of each bucket (ratio times slope, zero for most) and the intercept."""

    weight: np.ndarray
    intercept: float
    bits: int = BITS

    def chosen(self, text: str | None) -> np.ndarray:
        """The distinct buckets of a text that have a weight."""
        found = [h[self.weight[h] != 0] for h in grams(text, self.bits)]
        return np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint32)

    def score(self, text: str | None) -> float:
        margin = self.intercept + float(self.weight[self.chosen(text)].sum())
        return float(1 / (1 + np.exp(-np.clip(margin, -40, 40))))


def texts_of(b: pa.RecordBatch, k: int) -> list[str | None]:
    return b.column(k).to_pylist()


def class_counts(labelled: DataFrame, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents of label 0 and 1 that have each bucket, and the number of either, from (text, label)."""
    size = 1 << bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, docs = np.zeros((2, size + 1), np.int64), np.zeros(2, np.int64)
        for b in batches:
            for text, label in zip(texts_of(b, 0), b.column(1).to_pylist()):
                found = grams(text, bits)
                if found:
                    counts[label, np.unique(np.concatenate(found))] += 1
                docs[label] += 1
        counts[:, size] = docs
        used = np.flatnonzero(counts.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[0, used]), pa.array(counts[1, used])], ["bucket", "n0", "n1"])

    sums = labelled.select("text", "label").mapInArrow(run, "bucket long, n0 long, n1 long").groupBy("bucket").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    got = sums.toArrow()
    out = np.zeros((2, size + 1), np.int64)
    at = got.column("bucket").to_numpy()
    out[0, at], out[1, at] = got.column("n0").to_numpy(), got.column("n1").to_numpy()
    return out[:, :size], out[:, size]


def ratios(counts: np.ndarray, docs: np.ndarray, least: int, sigmas: float, most: int, smooth: float = 1.0) -> np.ndarray:
    """Naive Bayes log-count ratios; zero where a bucket is rare or its ratio within chance."""
    rate = (counts + smooth) / (docs[:, None] + 2 * smooth)
    r = np.log(rate[1]) - np.log(rate[0])
    spread = np.sqrt(1 / (counts[0] + smooth) + 1 / (counts[1] + smooth))
    z = np.abs(r) / spread
    keep = (counts.sum(axis=0) >= least) & (z >= sigmas)
    if keep.sum() > most:
        keep &= z >= np.partition(z[keep], -most)[-most]
    return np.where(keep, r, 0.0)


def logistic(x: list[np.ndarray], scale: np.ndarray, y: np.ndarray, weight: np.ndarray, start: float, ridge: float = 1.0, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Slopes on the scaled features and intercept; x lists the features of each row.  Accelerated descent."""
    rows = np.repeat(np.arange(len(x)), [len(f) for f in x])
    cols = np.concatenate(x) if x else np.zeros(0, np.int64)
    vals = scale[cols]
    k = len(scale)
    curve = weight * 0.25
    # a bound of the curvature from row sums and column sums of the design
    width = np.bincount(rows, np.abs(vals), len(x))
    bound = max(1e-9, float(np.bincount(cols, np.abs(vals) * (curve * (width + 1))[rows], k).max(initial=0)), float((curve * (width + 1)).sum())) + ridge
    w, b = np.ones(k) * 0.0, start
    vw, vb, t = w.copy(), b, 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(rows, vals * vw[cols], len(x)) + vb, -30, 30)))
        e = weight * (p - y)
        after_w = vw - (np.bincount(cols, vals * e[rows], k) + ridge * vw) / bound
        after_b = vb - e.sum() / bound
        t, last = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        vw, vb = after_w + (last - 1) / t * (after_w - w), after_b + (last - 1) / t * (after_b - b)
        w, b = after_w, after_b
    return w, float(b)


def fit(documents: DataFrame, labels: DataFrame, label: str = "toxic", counted: int = 20_000, per_class: int = 3000, bits: int = BITS, least: int = 5, sigmas: float = 5.0, most: int = 4000) -> Linear:
    """Counts over at most counted, weights from at most per_class documents of either class outside the left-out fold.

    Only the ids of the samples are broadcast (2 * counted rows); no text is shuffled.
    """
    prepare(documents.sparkSession)
    empty = np.zeros(1 << bits, np.float64)
    share = label_share(labels, label)
    share = 0.5 if share is None else min(max(share, 1e-6), 1 - 1e-6)
    counts, docs = class_counts(labelled_sample(documents, labels, label, counted), bits)
    if not docs.all():
        return Linear(empty, float(np.log(share / (1 - share))), bits)
    r = ratios(counts, docs, least, sigmas, most)
    picked = Linear(r, 0.0, bits)
    rows = labelled_sample(documents, labels, label, per_class)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [picked.chosen(t).astype(np.int32) for t in texts_of(b, 1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(found, pa.list_(pa.int32()))], ["doc_id", "label", "found"])

    # Arrow keeps the lists as one flat array
    got = rows.select("doc_id", "text", "label").mapInArrow(run, f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, label int, found array<int>").toArrow().sort_by("doc_id").combine_chunks()
    at = np.flatnonzero(r)
    place = np.zeros(1 << bits, np.int64)
    place[at] = np.arange(len(at))
    y = got.column("label").to_numpy().astype(np.float64)
    if not len(y) or y.min() == y.max():
        return Linear(empty, float(np.log(share / (1 - share))), bits)
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    slopes, intercept = logistic([place[x.values.to_numpy()] for x in got.column("found")], r[at], y, weight, float(np.log(share / (1 - share))))
    empty[at] = r[at] * slopes
    return Linear(empty, intercept, bits)


def score(documents: DataFrame, model: Linear, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns named in keep and score, the calibrated probability of label 1."""
    prepare(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = pa.array([model.score(t) for t in texts_of(b, len(keep))], pa.float64())
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(len(keep))), values], [*keep, "score"])

    schema = StructType([*(documents.schema[c] for c in keep), StructField("score", DoubleType())])
    return documents.select(*keep, F.col(text_col).alias("_scored")).mapInArrow(run, schema)
