"""Windows of linkage matrices: compressed symmetric matrices that hold one triangle, read in parts.

A window chr{C}_{start}_{end}.npz has the arrays row, col and data of its stored triangle (or indptr, indices
and data by rows), beside it a .gz list of its variants.  A task reads a range of entries: at their offset where
the arrays are stored plain, else by decompressing the stream in pieces, so that no task holds a matrix.
"""

from __future__ import annotations

import ast
import os
import re
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from lociform.functions.scalar import complement
from lociform.sources.genotypes import _opened, qualified

#: Entries read at once.
PIECE = 1 << 18
WINDOW = re.compile(r"(?:chr)?([^_/]+)_(\d+)_(\d+)\.npz$")


class Member:
    """One array of an archive: its type, length and where its numbers begin."""

    def __init__(self, archive: zipfile.ZipFile, name: str) -> None:
        self.archive, self.info = archive, archive.getinfo(f"{name}.npy")
        with archive.open(self.info) as f:
            head = f.read(10)
            if head[:6] != b"\x93NUMPY":
                raise ValueError(f"{name} is not an array")
            size = 2 if head[6] == 1 else 4
            length = int.from_bytes((head[8:10] + (f.read(2) if size == 4 else b"")), "little")
            about = ast.literal_eval(f.read(length).decode("latin-1"))
        self.dtype, self.shape, self.start = np.dtype(about["descr"]), about["shape"], 8 + size + length

    def __len__(self) -> int:
        return int(self.shape[0]) if self.shape else 1

    @property
    def plain(self) -> bool:
        return self.info.compress_type == zipfile.ZIP_STORED

    def pieces(self, first: int, last: int) -> Iterator[np.ndarray]:
        """Numbers first to last, last not included, a piece at a time."""
        width = self.dtype.itemsize
        with self.archive.open(self.info) as f:
            # a plain member seeks; a compressed one is read through
            f.seek(self.start + first * width)
            for at in range(first, last, PIECE):
                yield np.frombuffer(f.read(min(PIECE, last - at) * width), self.dtype)


class Entries(InputPartition):
    """Entries first to last of one window."""

    def __init__(self, path: str, window: str, first: int, last: int) -> None:
        self.path, self.window, self.first, self.last = path, window, first, last


class MatrixWindows(DataSource):
    """spark.read.format("matrix_windows"): option path (one .npz or a folder), chr, start and end (the span a window must hold), entries (to a task)."""

    @classmethod
    def name(cls) -> str:
        return "matrix_windows"

    def schema(self) -> str:
        return "window string, i long, j long, r double"

    def reader(self, schema: StructType) -> DataSourceReader:
        return MatrixReader(self.options)


class MatrixReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.entries = options["path"], int(options.get("entries", 4_000_000))
        self.span = (options["chr"], int(options["start"]), int(options["end"])) if "chr" in options else None

    def files(self) -> list[str]:
        where, name = _opened(self.path)
        if where.get_file_info(name).type == fs.FileType.File:
            return [name]
        held = sorted(f.path for f in where.get_file_info(fs.FileSelector(name)) if WINDOW.search(f.path))
        return held if self.span is None else [f for f in held if os.path.basename(f) == best_window([os.path.basename(h) for h in held], *self.span)]

    def partitions(self) -> list[Entries]:
        where, _ = _opened(self.path)
        out = []
        for path in self.files():
            with where.open_input_file(path) as f, zipfile.ZipFile(f) as archive:
                data = Member(archive, "data")
                # what is compressed as one stream is read by one task
                step = self.entries if data.plain else max(1, len(data))
                out += [Entries(path, os.path.basename(path).removesuffix(".npz"), at, min(at + step, len(data))) for at in range(0, len(data), step)]
        return out

    def read(self, partition: Entries | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # Spark asks so where there are no partitions
            return
        where, _ = _opened(self.path)
        with where.open_input_file(partition.path) as f, zipfile.ZipFile(f) as archive:
            span = (partition.first, partition.last)
            if "indptr.npy" in archive.namelist():
                indptr = Member(archive, "indptr")
                ends = np.concatenate(list(indptr.pieces(0, len(indptr)))).astype(np.int64)
                rows = (np.searchsorted(ends, np.arange(at, min(at + PIECE, span[1])), "right") - 1 for at in range(*span, PIECE))
                columns = Member(archive, "indices").pieces(*span)
            else:
                rows, columns = Member(archive, "row").pieces(*span), Member(archive, "col").pieces(*span)
            for i, j, r in zip(rows, columns, Member(archive, "data").pieces(*span)):
                yield pa.RecordBatch.from_arrays([pa.array([partition.window] * len(i)), pa.array(i.astype(np.int64)), pa.array(j.astype(np.int64)), pa.array(r.astype(np.float64))], names=["window", "i", "j", "r"])


def best_window(names: list[str], chrom: str, start: int, end: int) -> str | None:
    """Of the windows that hold start to end the one whose middle is nearest to theirs; ties go to the first."""
    best = None
    for name in sorted(names):
        if m := WINDOW.search(name):
            a, b = int(m[2]), int(m[3])
            if m[1] == str(chrom).removeprefix("chr") and a <= start and end < b:
                off = abs((a + b) - (start + end))
                best = min(best, (off, name)) if best else (off, name)
    return best[1] if best else None


def read_matrix(spark: SparkSession, path: str, chrom: str | None = None, start: int | None = None, end: int | None = None, entries: int = 4_000_000) -> DataFrame:
    """window, i, j, r: the stored triangle of one window, of all windows of a folder, or of the one that fits a span best."""
    spark.dataSource.register(MatrixWindows)
    reader = spark.read.format("matrix_windows").option("entries", entries)
    if chrom is not None:
        reader = reader.option("chr", str(chrom).removeprefix("chr")).option("start", start).option("end", end)
    return reader.load(qualified(spark, path))


def read_window_variants(spark: SparkSession, path: str) -> DataFrame:
    """window, k (place in the matrix from 0), pos, a1, a2 of the lists beside matrices (white space between columns, named in the first line).

    A list is one compressed stream, so that one task reads it, in order.
    """
    spark.dataSource.register(WindowLists)
    return spark.read.format("matrix_window_lists").load(qualified(spark, path))


class WindowLists(DataSource):
    @classmethod
    def name(cls) -> str:
        return "matrix_window_lists"

    def schema(self) -> str:
        return "window string, k long, pos long, a1 string, a2 string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return ListReader(self.options)


class ListReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"]

    def partitions(self) -> list[Entries]:
        where, name = _opened(self.path)
        held = [name] if where.get_file_info(name).type == fs.FileType.File else sorted(f.path for f in where.get_file_info(fs.FileSelector(name)) if f.path.endswith(".gz"))
        return [Entries(path, os.path.basename(path).removesuffix(".gz"), 0, 0) for path in held]

    def read(self, partition: Entries | None) -> Iterator[tuple]:
        if partition is None:
            return
        where, _ = _opened(self.path)
        with where.open_input_stream(partition.path, compression="gzip") as stream:
            rest, head, k = b"", None, 0
            while True:
                raw = stream.read(1 << 20)
                lines = (rest + raw).split(b"\n")
                rest = lines.pop() if raw else b""
                for line in lines:
                    cells = line.decode().split()
                    if not cells:
                        continue
                    if head is None:
                        head = [cells.index(c) for c in ("position", "allele1", "allele2")]
                        continue
                    yield partition.window, k, int(cells[head[0]]), cells[head[1]].upper(), cells[head[2]].upper()
                    k += 1
                if not raw:
                    return


def window_linkage(entries: DataFrame, listed: DataFrame, wanted: DataFrame) -> DataFrame:
    """(window, pos_a, pos_b, r): correlations of the wanted variants, both ways round and with themselves.

    entries: read_matrix(); listed: read_window_variants(); wanted: (pos, a1, a2), a1 the allele that scores refer
    to.  A variant whose alleles are the other way round in the window, on either strand, turns the sign of its
    correlations.  Pairs that the triangle does not store are not there; what both halves store is added up.
    """
    w = wanted.select(F.col("pos"), F.upper("a1").alias("w1"), F.upper("a2").alias("w2"))
    met = listed.join(w, "pos")
    same = ((F.col("w1") == F.col("a1")) & (F.col("w2") == F.col("a2"))) | ((complement(F.col("w1")) == F.col("a1")) & (complement(F.col("w2")) == F.col("a2")))
    turned = ((F.col("w1") == F.col("a2")) & (F.col("w2") == F.col("a1"))) | ((complement(F.col("w1")) == F.col("a2")) & (complement(F.col("w2")) == F.col("a1")))
    known = met.withColumn("sign", F.when(same, 1.0).when(turned, -1.0)).where("sign is not null")
    # of several listed variants of a position the first that fits counts
    known = known.groupBy("window", "pos").agg(F.min_by(F.struct("k", "sign"), "k").alias("f")).select("window", "pos", F.col("f.k").alias("k"), F.col("f.sign").alias("sign"))
    side = lambda s: known.select("window", F.col("k").alias({"a": "i", "b": "j"}[s]), F.col("pos").alias(f"pos_{s}"), F.col("sign").alias(f"sign_{s}"))
    half = entries.where("i <> j").join(side("a"), ["window", "i"]).join(side("b"), ["window", "j"]).select("window", "pos_a", "pos_b", (F.col("r") * F.col("sign_a") * F.col("sign_b")).alias("r"))
    both = half.unionByName(half.select("window", F.col("pos_b").alias("pos_a"), F.col("pos_a").alias("pos_b"), "r"))
    whole = both.groupBy("window", "pos_a", "pos_b").agg(F.sum("r").alias("r"))
    return whole.unionByName(known.select("window", F.col("pos").alias("pos_a"), F.col("pos").alias("pos_b"), F.lit(1.0).alias("r")))
