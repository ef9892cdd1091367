"""Genotype matrices in packed form (.bed), variant call text and score files.

A packed matrix holds, after three bytes, a row of ceil(people / 4) bytes for each variant; ranges of
variants are read by offset, so a matrix of any size spreads over tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

#: Fixed values of the format: its first bytes and the count of the first allele for each pair of bits (None is missing).
BED_HEAD = bytes([0x6C, 0x1B, 0x01])
BED_CALLS = (2, None, 1, 0)


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme of the session's default file system where it names none, as tasks cannot ask for that; local paths as they are."""
    if ":" in path.split("/")[0]:
        return path
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    full = there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(there).toString()
    return path if full.startswith("file:") else full


class Span(InputPartition):
    """Variants first to last, last not included."""

    def __init__(self, first: int, last: int) -> None:
        self.first, self.last = first, last


class PackedGenotypes(DataSource):
    """spark.read.format("packed_genotypes"): options path, people, and first, last (variants wanted) and rows (variants a task)."""

    @classmethod
    def name(cls) -> str:
        return "packed_genotypes"

    def schema(self) -> str:
        return "variant long, calls array<tinyint>"

    def reader(self, schema: StructType) -> DataSourceReader:
        return PackedReader(self.options)


class PackedReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.people, self.rows = options["path"], int(options["people"]), int(options.get("rows", 20_000))
        self.width = (self.people + 3) // 4
        where, name = _opened(self.path)
        with where.open_input_file(name) as f:
            if f.read(3) != BED_HEAD:
                raise ValueError(f"{self.path} is not a packed matrix by variants")
            held, odd = divmod(f.size() - 3, self.width)
        if odd:
            raise ValueError(f"{self.path} does not hold whole rows of {self.people} people")
        self.first, self.last = max(0, int(options.get("first", 0))), min(held, int(options.get("last", held)))

    def partitions(self) -> list[Span]:
        return [Span(at, min(at + self.rows, self.last)) for at in range(self.first, self.last, self.rows)]

    def read(self, partition: Span | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # Spark asks so where there are no partitions
            return
        where, name = _opened(self.path)
        calls = np.array([-1 if c is None else c for c in BED_CALLS], np.int8)
        step = max(1, (1 << 22) // self.people)
        with where.open_input_file(name) as f:
            for at in range(partition.first, partition.last, step):
                n = min(step, partition.last - at)
                raw = np.frombuffer(f.read_at(n * self.width, 3 + at * self.width), np.uint8).reshape(n, self.width)
                bits = (raw[:, :, None] >> np.array([0, 2, 4, 6], np.uint8)) & 3
                flat = calls[bits.reshape(n, -1)[:, : self.people]].ravel()
                values = pa.array(flat, mask=flat < 0)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * self.people), values)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + n, dtype=np.int64)), lists], names=["variant", "calls"])


def read_genotypes(spark: SparkSession, path: str, people: int, first: int = 0, last: int | None = None) -> DataFrame:
    """variant (its row in the matrix) and calls (count of the first allele of each person, null where missing) of a range of variants."""
    spark.dataSource.register(PackedGenotypes)
    reader = spark.read.format("packed_genotypes").option("people", people).option("first", first)
    return (reader if last is None else reader.option("last", last)).load(qualified(spark, path))


def filled(df: DataFrame, calls: str = "calls") -> DataFrame:
    """Missing calls replaced by the variant's mean, as doubles; all zero where every call is missing."""
    known = F.filter(calls, lambda x: x.isNotNull())
    mean = F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda s, x: s + x) / F.size(known)).otherwise(0.0)
    # the mean is bound to a variable, else it would be computed for each person
    return df.withColumn(calls, F.transform(F.array(mean), lambda m: F.transform(F.col(calls).cast("array<double>"), lambda x: F.coalesce(x, m)))[0])


def read_variant_calls(spark: SparkSession, path: str) -> DataFrame:
    """chr, pos, rsid, ref, alts of variant call text, compressed or not; rows without a position are left out.

    A filter on chr and pos after this reads all text: write it once as a table partitioned by chr for many searches.
    """
    cell = F.split("value", "\t")
    rows = spark.read.text(path).where(~F.startswith("value", F.lit("#"))).where(F.size(cell) >= 5)
    out = rows.select(F.regexp_replace(cell[0], "^chr", "").alias("chr"), cell[1].try_cast("long").alias("pos"), F.nullif(cell[2], F.lit(".")).alias("rsid"), cell[3].alias("ref"), F.split(cell[4], ",").alias("alts"))
    return out.where("pos is not null")


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    """chr, pos, l2, maf of linkage score files; of several rows at a position that of the least l2 counts."""
    rows = spark.read.option("sep", "\t").option("header", True).csv(path)
    out = rows.select(F.col("CHR").alias("chr"), F.col("BP").try_cast("long").alias("pos"), F.col("L2").try_cast("double").alias("l2"), F.col("MAF").try_cast("double").alias("maf")).where("pos is not null and l2 is not null")
    return out.groupBy("chr", "pos").agg(F.min_by(F.struct("l2", "maf"), F.struct("l2", "maf")).alias("s")).select("chr", "pos", "s.l2", "s.maf")


def read_score_total(spark: SparkSession, path: str) -> float:
    """The number of variants behind linkage scores: the sum over count files, a number each (or one for each annotation); a word that is no number is an error."""
    words = spark.read.text(path).select(F.explode(F.split(F.trim("value"), r"\s+")).alias("w")).where("w <> ''")
    total, n, bad = words.agg(F.sum(F.col("w").try_cast("double")), F.count("*"), F.first(F.when(F.col("w").try_cast("double").isNull(), F.col("w")), ignorenulls=True)).first()
    if bad is not None or not n:
        raise ValueError(f"{path} has no counts" if not n else f"{path} has {bad} in place of a count")
    return float(total)


def read_deleteriousness(spark: SparkSession, path: str) -> DataFrame:
    """chr, pos, ref, alt, raw and phred of a tab-separated score file with # comments."""
    cell = F.split("value", "\t")
    rows = spark.read.text(path).where(~F.startswith("value", F.lit("#"))).where(F.size(cell) >= 6)
    return rows.select(cell[0].alias("chr"), cell[1].try_cast("long").alias("pos"), cell[2].alias("ref"), cell[3].alias("alt"), cell[4].try_cast("double").alias("raw"), cell[5].try_cast("double").alias("phred")).where("pos is not null")


def read_links(spark: SparkSession, path: str) -> DataFrame:
    """Element-gene links, with the second build's coordinates decoded from their differences."""
    t = spark.read.option("sep", "\t").option("header", True).csv(path)
    n = lambda c: F.col(c).try_cast("long")
    d = lambda c: F.col(c).try_cast("double")
    start_b = n("start") + n("d38")
    return t.select(
        "chr", n("start").alias("start"), n("end").alias("end"), "class", "gene", n("tss").alias("tss"), d("e2g").alias("score"), d("abc").alias("abc"),
        start_b.alias("start_b"), (start_b + n("end") - n("start") + n("dlen38")).alias("end_b"), (n("tss") + n("d38") + n("dtss38")).alias("tss_b"),
    )


def encoded_links(links: DataFrame) -> DataFrame:
    """The other way: the second build's coordinates as differences d38, dtss38 and dlen38; null stays null."""
    d = F.col("start_b") - F.col("start")
    rest = [c for c in links.columns if c not in ("start_b", "end_b", "tss_b")]
    return links.select(*rest, d.alias("d38"), (F.col("tss_b") - F.col("tss") - d).alias("dtss38"), ((F.col("end_b") - F.col("start_b")) - (F.col("end") - F.col("start"))).alias("dlen38"))
