"""Helpers that all training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space; everything between two of these is a word.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def prepare(spark: SparkSession) -> None:
    """Small Arrow batches: a batch of the longest texts must fit beside its decoded words."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    spark.conf.set("spark.sql.execution.arrow.pyspark.enabled", "true")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one of our own only where that is unset and Spark is this one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lociform-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def free_name(taken: Iterable[str], name: str) -> str:
    """name, followed by as many underscores as it takes to differ from all that are taken."""
    lower = {c.lower() for c in taken}
    while name.lower() in lower:
        name += "_"
    return name


#: Elements to a chunk of running().
CHUNK = 256


def running(df: DataFrame, arrays: dict[str, Column], greatest: bool = False) -> DataFrame:
    """df with a column for each array of whole numbers: the sum (or the greatest) of the elements before each.

    An array that grows inside aggregate() is copied at each step.  Here every step carries one number: sums
    within chunks, over chunks, and both added up, so that n elements take about n * CHUNK small steps.
    The greatest of no elements is -2**62.
    """
    zero = F.lit(-(1 << 62) if greatest else 0).cast("long")
    merge = F.greatest if greatest else lambda a, x: a + x
    total = lambda part: F.aggregate(part, zero, lambda a, x: merge(a, x))
    chunks = {n: partial(lambda n, k: F.slice(n, k * CHUNK + 1, F.lit(CHUNK)), n) for n in arrays}
    before = {n: partial(lambda n, _, k: total(F.slice(f"{n}_sums", F.lit(1), k)), n) for n in arrays}
    df = df.withColumns({n: c.cast("array<bigint>") for n, c in arrays.items()})
    df = df.withColumns({n: F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.size(n), F.lit(1)) - 1) / CHUNK).cast("int")), chunks[n]) for n in arrays})
    df = df.withColumns({f"{n}_sums": F.transform(n, total) for n in arrays})
    df = df.withColumns({f"{n}_sums": F.transform(f"{n}_sums", before[n]) for n in arrays})
    within = lambda part, first: F.transform(part, lambda _, i: merge(first, total(F.slice(part, F.lit(1), i))))
    return df.withColumns({n: F.flatten(F.zip_with(n, f"{n}_sums", within)) for n in arrays}).drop(*(f"{n}_sums" for n in arrays))


def utf32(text: Column) -> Column:
    """Four bytes a code point, from which between() cuts in time of what it cuts; substr() of a text reads it from its start."""
    return F.encode(text, "UTF-32")


def between(whole: Column, start: Column, end: Column) -> Column:
    """Code points [start, end) of utf32(text); the byte order mark is one that decode() takes off again."""
    return F.decode(F.concat(F.lit(b"\x00\x00\xfe\xff"), F.substring(whole, (4 * start + 1).cast("int"), (4 * (end - start)).cast("int"))), "UTF-32")


def materialise(df: DataFrame, name: str = "table") -> DataFrame:
    """Write df once to the shared folder and read it back: lineage ends, all executors see it.

    Unlike localCheckpoint it survives lost executors; unlike checkpoint() later readers decode only
    the columns they use.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lociform_path = path
    return out


def forget(df: DataFrame | None) -> None:
    """Delete a materialised table that no later plan reads."""
    path = getattr(df, "_lociform_path", None)
    if path:
        spark = df.sparkSession
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


#: A key of fewer rows than this is never treated as hot.
HOT = 1000


def joined(left: DataFrame, right: DataFrame, key: str, rows: int) -> DataFrame:
    """left joined on key with right, which has one row for each key and n, the number of left's rows with that key.

    rows: the rows of left.  Keys of more than a ten-thousandth of them are at most 10,000, whatever the data; these
    are broadcast, so that no task gets all rows of a hot key.  Both tables are read twice.
    """
    limit = max(HOT, rows // 10_000)
    hot = F.broadcast(right.where(F.col("n") > limit))
    rest = left.join(hot.select(key), key, "left_anti").join(right.where(F.col("n") <= limit), key)
    return left.join(hot, key).unionByName(rest).drop("n")


def fold(doc_id: Column | str, modulus: int) -> Column:
    """crc32 of the decimal text of doc_id, modulo; a null id is fold 0."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string")) % modulus, F.lit(0))


def label_share(labels: DataFrame, label: str, modulus: int = 4, left_out: int = 2) -> float | None:
    """The share of label 1 among labels 0 and 1 outside the left-out fold; None without any."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & (fold("doc_id", modulus) != left_out))
    return known.agg(F.avg(F.col(label).cast("double"))).first()[0]


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, per_class: int, modulus: int = 4, left_out: int = 2) -> DataFrame:
    """At most per_class documents of either class, spread by a hash of the id: doc_id, text, label; written once.

    Only ids outside the left-out fold count.  Null ids, null labels and labels besides 0 and 1 are
    skipped; an id labelled both ways counts as its larger label; of documents that share an id the one
    of the smallest text counts, so that rows are bounded as ids are.  The ids chosen are at most
    2 * per_class rows, which is what gets broadcast; texts stay distributed.
    """
    wanted = (
        labels.select("doc_id", F.col(label).cast("int").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & (fold("doc_id", modulus) != left_out))
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
        .withColumn("_h", F.xxhash64("doc_id"))
    )
    classes = [wanted.where(F.col("label") == k).orderBy("_h", "doc_id").limit(per_class) for k in (0, 1)]
    # materialised: the sample must be the same rows however often it is read
    ids = materialise(classes[0].union(classes[1]).drop("_h"), "sample-ids")
    found = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id")
    return materialise(found.groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("doc_id", "text", "label"), "sample")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
