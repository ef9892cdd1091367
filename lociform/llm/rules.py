"""Quality rules: gradient-boosted trees over document statistics.

Statistics of a whole text (word and symbol counts, repeated lines and windows, shares of letter kinds)
feed boosted regression trees.  Trees are grown on histograms of at most ``bins`` quantile bins; chosen
features are monotone: more repetition or more symbols never raises a score.  A fitted model is flat
numpy node arrays, walked for all documents and trees of a batch at once.

The trees are fitted on the statistics (never the texts) of at most ``per_class`` labelled documents of
either class; statistics and scores cover all rows and whole texts.

Edge cases: null and empty texts have zero statistics; without labels of both classes the verdict is
true for all that pass the base rules; repeated rows each get a row; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType

from lociform.llm.common import label_share, labelled_sample, prepare

WINDOW = 8
SPACE_BYTES = b" \t\n\x0b\x0c\r"
SYMBOL_BYTES = b"#*$%&|<>"
UPPER = bytes(range(65, 91))
DIGITS = b"0123456789"
MARKS = b".,;:!?\"'()[]{}"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Feature names and what a larger value may do to the score: -1 only lower it, 0 anything.
FEATURES = (
    ("mean_word", 0), ("symbol_share", -1), ("dup_line_share", -1), ("repeat_share", -1), ("upper_share", 0), ("digit_share", 0),
    ("mark_share", 0), ("distinct_share", 0), ("same_next_share", -1), ("line_words", 0), ("log_words", 0), ("byte_share", 0),
)


def repeated_words(words: list[bytes], width: int = WINDOW) -> int:
    """Words inside windows of width words that occur at least twice, the first occurrence included."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    number = {w: k for k, w in enumerate(dict.fromkeys(words))}
    if len(number) == len(words):
        return 0
    ids = np.fromiter(map(number.__getitem__, words), np.uint64, len(words))
    mixed = (ids + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    rolled = np.zeros(n, np.uint64)
    for k in range(width):
        rolled = rolled * np.uint64(0xBF58476D1CE4E5B9) + mixed[k : k + n]
    ordered = np.sort(rolled)
    same = ordered[1:] == ordered[:-1]
    if not same.any():
        return 0
    # windows of equal hash are compared word by word
    at = np.flatnonzero(np.isin(rolled, ordered[1:][same]))
    _, group, counts = np.unique(ids[at[:, None] + np.arange(width)], axis=0, return_inverse=True, return_counts=True)
    at = at[counts[group.ravel()] > 1]
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + width, -1)
    return int((np.cumsum(edges) > 0).sum())


def statistics(text: bytes | None) -> tuple[list[int], list[float]]:
    """The base counts and the features of one UTF-8 text."""
    text = text or b""
    words = text.split()
    n = len(words)
    raw = np.frombuffer(text, np.uint8)
    points = int(((raw & 0xC0) != 0x80).sum())
    solid = len(text.translate(None, SPACE_BYTES))
    word_chars = points - (len(text) - solid)
    share = lambda kind: (len(text) - len(text.translate(None, kind))) / max(1, word_chars)
    n_symbols = len(text) - len(text.translate(None, SYMBOL_BYTES))
    lines = [x for x in text.split(b"\n") if x.strip(SPACE_BYTES)]
    dup_lines = len(lines) - len(set(lines))
    repeat = repeated_words(words)
    features = [
        word_chars / max(1, n), n_symbols / max(1, n), dup_lines / max(1, len(lines)), repeat / max(1, n), share(UPPER), share(DIGITS),
        share(MARKS), len(set(words)) / max(1, n), sum(map(eq, words, words[1:])) / max(1, n), n / max(1, len(lines)), float(np.log1p(n)), solid / max(1, word_chars),
    ]
    return [n, word_chars, n_symbols, dup_lines, repeat], features


# ---- boosted trees ----------------------------------------------------------------------------


@dataclass
class Trees:
    """Flat nodes of all trees; a leaf points at itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    start: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not len(self.roots) or not len(x):
            return np.full(len(x), 1 / (1 + np.exp(-self.start)))
        node = np.broadcast_to(self.roots, (len(x), len(self.roots)))
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            node = np.where(x[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
        return 1 / (1 + np.exp(-(self.start + self.value[node].sum(axis=1))))


def grow(x: np.ndarray, y: np.ndarray, weight: np.ndarray, monotone: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.2, ridge: float = 1.0, bins: int = 64, least: float = 5.0) -> Trees:
    """Boosted trees for the logistic loss by Newton leaf values; monotone: -1, 0 or 1 for each feature."""
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], axis=1)
    share = float(np.average(y, weights=weight))
    start = float(np.log((share + 1e-3) / (1 - share + 1e-3)))
    margin = np.full(len(y), start)
    nodes: list[list[float]] = []  # feature, threshold, left, right, value
    roots = []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = weight * (y - p), weight * p * (1 - p)

        def leaf(rows: np.ndarray, low: float, high: float) -> float:
            return float(np.clip(g[rows].sum() / (h[rows].sum() + ridge), low, high))

        def build(rows: np.ndarray, level: int, low: float, high: float) -> int:
            at = len(nodes)
            value = leaf(rows, low, high)
            nodes.append([0, np.inf, at, at, value * rate])
            best = (1e-6, -1, -1, 0.0, 0.0)
            if level < depth and len(rows) > 1:
                total_g, total_h = g[rows].sum(), h[rows].sum()
                gain_of = lambda v, a, b: a * v - 0.5 * (b + ridge) * v * v
                whole = gain_of(value, total_g, total_h)
                for f in range(x.shape[1]):
                    if not len(cuts[f]):
                        continue
                    k = len(cuts[f]) + 1
                    gl = np.cumsum(np.bincount(binned[rows, f], g[rows], k))[:-1]
                    hl = np.cumsum(np.bincount(binned[rows, f], h[rows], k))[:-1]
                    nl = np.cumsum(np.bincount(binned[rows, f], weight[rows], k))[:-1]
                    vl = np.clip(gl / (hl + ridge), low, high)
                    vr = np.clip((total_g - gl) / (total_h - hl + ridge), low, high)
                    gain = gain_of(vl, gl, hl) + gain_of(vr, total_g - gl, total_h - hl) - whole
                    gain[(nl < least) | (nl > weight[rows].sum() - least)] = -1
                    if monotone[f]:
                        gain[(vr - vl) * monotone[f] < 0] = -1
                    j = int(gain.argmax())
                    if gain[j] > best[0]:
                        best = (float(gain[j]), f, j, float(vl[j]), float(vr[j]))
            if best[1] >= 0:
                _, f, j, vl, vr = best
                goes_left = binned[rows, f] <= j
                middle = (vl + vr) / 2
                bounds = {0: ((low, high), (low, high)), 1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle))}[int(monotone[f])]
                left = build(rows[goes_left], level + 1, *bounds[0])
                right = build(rows[~goes_left], level + 1, *bounds[1])
                nodes[at] = [f, float(cuts[f][j]), left, right, 0.0]
            else:
                margin[rows] += value * rate
            return at

        roots.append(build(np.arange(len(y)), 0, -np.inf, np.inf))
    flat = np.array(nodes, np.float64).reshape(-1, 5)
    return Trees(*(flat[:, k].astype(np.int64) if k in (0, 2, 3) else flat[:, k] for k in range(5)), np.array(roots, np.int64), depth, start)


# ---- over tables ------------------------------------------------------------------------------


def measured(df: DataFrame, keep: list[str], text_col: str = "text", model: Trees | None = None) -> DataFrame:
    """The columns in keep, the base counts, the features (array) and, with a model, score."""
    prepare(df.sparkSession)
    fields = [*(df.schema[c] for c in keep), *(StructField(c, LongType()) for c in BASE), StructField("score", DoubleType())]
    if model is None:
        fields += [StructField(c, DoubleType()) for c, _ in FEATURES]
    schema = StructType(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            stats = [statistics(t) for t in b.column(len(keep)).cast(pa.binary()).to_pylist()]
            counts = np.array([s[0] for s in stats], np.int64).reshape(-1, len(BASE))
            x = np.array([s[1] for s in stats]).reshape(-1, len(FEATURES))
            score = model.scores(x) if model is not None else np.zeros(len(x))
            columns = [*(b.column(k) for k in range(len(keep))), *(pa.array(counts[:, k]) for k in range(len(BASE))), pa.array(score)]
            if model is None:
                columns += [pa.array(x[:, k]) for k in range(len(FEATURES))]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return df.select(*keep, F.col(text_col).alias("_measured")).mapInArrow(run, schema)


def fit(documents: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = 3000, **grown) -> Trees | None:
    """Trees for label 1, from statistics of a bounded sample; None without labels of both classes."""
    rows = measured(labelled_sample(documents, labels, label, per_class), ["doc_id", "label"]).drop("score", *BASE)
    got = sorted(tuple(r) for r in rows.collect())
    y = np.array([r[1] for r in got], np.float64)
    if not len(got) or y.min() == y.max():
        return None
    known = label_share(labels, label)
    weight = np.where(y == 1, known / y.mean(), (1 - known) / (1 - y.mean()))
    x = np.array([r[2:] for r in got], np.float64)
    return grow(x, y, weight, np.array([m for _, m in FEATURES]), **grown)


def judge(documents: DataFrame, model: Trees | None, keep: list[str], text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The columns in keep, base counts, base_failed, score and kept."""
    empty = Trees(*(np.zeros(0) for _ in range(5)), np.zeros(0, np.int64), 0, 0.0)
    out = measured(documents, keep, text_col, model if model is not None else empty)
    failed = (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)
    return out.withColumn("base_failed", failed.cast(BooleanType())).withColumn("kept", ~F.col("base_failed") & (F.col("score") >= least))
