"""Quality by compression: which of two zstandard dictionaries shortens a text more.

One dictionary is trained on good and one on bad labelled text.  A text is compressed with both, in
pieces of ``piece`` bytes so that a long text stays as dependent on the dictionaries as a short one.
Two normalised sizes come out: the difference of the compressed sizes for each byte of text, and the
smaller of them for each byte (repetition).  A logistic curve over these, fitted on labelled rows that
trained neither dictionary and weighted to the labels' shares, gives the calibrated score.

The model is fitted on a bounded sample of at most ``per_class`` labelled documents of either class.  Half of
them train the dictionaries: of their pieces, whole texts through, a hash picks as many as make about
``pieces`` of either class.  The sizes of the other half, of whole texts, are computed where the texts lie
and fit the curve: two numbers a document reach the driver.  Scores read whole texts of all rows.

Edge cases: null and empty texts have normalised sizes 0 and get the curve's value there; without labels of
both classes every score is the share of label 1 among the labels (0.5 without any); repeated rows each
get a row; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from lociform.llm.common import label_share, labelled_sample, prepare

LEVEL = 3


@dataclass
class Compressors:
    """Both dictionaries, the piece size and the curve over the normalised sizes."""

    good: bytes
    bad: bytes
    piece: int
    slopes: tuple[float, float] = (0.0, 0.0)
    intercept: float = 0.0

    def sizes(self, texts: list[bytes | None]) -> np.ndarray:
        """Rows ((bad size - good size) / bytes, smaller size / bytes); zeros for empty texts."""
        out = np.zeros((len(texts), 2))
        if not self.good or not self.bad:
            return out
        packers = []
        for content in (self.good, self.bad):
            known = zstandard.ZstdCompressionDict(content)
            known.precompute_compress(level=LEVEL)
            packers.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_content_size=False, write_checksum=False).compress)
        for k, text in enumerate(texts):
            good = bad = 0
            for at in range(0, len(text or b""), self.piece):
                part = text[at : at + self.piece]
                good += len(packers[0](part))
                bad += len(packers[1](part))
            if text:
                out[k] = (bad - good) / len(text), min(good, bad) / len(text)
        return out

    def scores(self, texts: list[bytes | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.sizes(texts) @ np.array(self.slopes) + self.intercept, -40, 40)))


def logistic_curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> tuple[tuple, float]:
    """Slopes and intercept by Newton steps on the standardised columns of x."""
    mean, sd = x.mean(axis=0), np.where(x.std(axis=0) > 0, x.std(axis=0), 1.0)
    design = np.column_stack([(x - mean) / sd, np.ones(len(x))])
    w = np.zeros(design.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        gradient = design.T @ (weight * (p - y)) + ridge * w
        hessian = (design * (weight * p * (1 - p))[:, None]).T @ design + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    slopes = w[:-1] / sd
    return tuple(map(float, slopes)), float(w[-1] - slopes @ mean)


def train_dictionary(pieces: list[bytes], size: int) -> bytes:
    """A dictionary with entropy tables; of few pieces, which zstandard refuses, the pieces themselves."""
    try:
        return zstandard.train_dictionary(size, pieces, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(pieces)[:size]


def sampled_pieces(rows: DataFrame, label: int, piece: int, share: float) -> list[bytes]:
    """A share of the pieces of all texts of a label, chosen and ordered by a hash of their place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()):
                for at in range(0, len(text), piece):
                    h = xxhash.xxh64_intdigest(f"{doc_id}:{at}")
                    if h < share * 2.0**64:
                        found.append((h >> 1, text[at : at + piece]))
            yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in found], pa.int64()), pa.array([t for _, t in found], pa.binary())], ["h", "piece"])

    got = rows.where(F.col("label") == label).select("doc_id", "text").mapInArrow(run, "h long, piece binary").toArrow()
    return [t for _, t in sorted(zip(got.column("h").to_pylist(), got.column("piece").to_pylist()))]


def fit(documents: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = 3000, pieces: int = 16_000, dictionary_bytes: int = 1 << 16, piece: int = 1024) -> Compressors:
    """Half of the sampled documents train the dictionaries, the other half the curve.

    The driver gets about 2 * pieces pieces (32 MB at the defaults) and 2 * per_class pairs of numbers.
    """
    prepare(documents.sparkSession)
    share = label_share(labels, label)
    share = 0.5 if share is None else share
    rows = labelled_sample(documents, labels, label, per_class).where("text <> ''").withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(2)))
    model = Compressors(b"", b"", piece, intercept=math.log((share + 1e-3) / (1 - share + 1e-3)))
    size = F.sum(F.ceil(F.octet_length("text") / piece))
    there = {(r.label, r.half): r.n for r in rows.groupBy("label", "half").agg(size.alias("n")).collect()}
    if len(there) < 4:
        return model
    model.good, model.bad = (train_dictionary(sampled_pieces(rows.where("half = 0"), y, piece, pieces / there[y, 0]), dictionary_bytes) for y in (1, 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = model.sizes(b.column(2).cast(pa.binary()).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(x[:, 0]), pa.array(x[:, 1])], ["doc_id", "label", "gap", "size"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    got = sorted(map(tuple, rows.where("half = 1").select("doc_id", "label", "text").mapInArrow(run, f"doc_id {kind}, label int, gap double, size double").collect()))
    y = np.array([r[1] for r in got], np.float64)
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    model.slopes, model.intercept = logistic_curve(np.array([r[2:] for r in got]), y, weight)
    return model


def score(documents: DataFrame, model: Compressors, keep: list[str], text_col: str = "text", out_col: str = "score") -> DataFrame:
    """The columns named in keep and out_col, the calibrated probability of label 1."""
    prepare(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = pa.array(model.scores(b.column(len(keep)).cast(pa.binary()).to_pylist()))
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(len(keep))), values], [*keep, out_col])

    schema = StructType([*(documents.schema[c] for c in keep), StructField(out_col, DoubleType())])
    return documents.select(*keep, F.col(text_col).alias("_scored")).mapInArrow(run, schema)
