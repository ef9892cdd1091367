"""The corpus pipeline: quality, near-duplicates, benchmark passages, personal data, mixture.

Each stage is a function of (spark, docs, sf_dir); its result is written as Parquet in the shared folder
and read again as the next stage's docs.  All but the last return the columns of documents.

Edge cases are those of the operators: null and empty texts go through every stage (an empty text has
the quality score of the labels' share), repeated rows end in one row at the near-duplicate stage, and
an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociform.llm import compression, decontamination, mixing, nearcopies, pii
from lociform.llm.common import free_name, materialise, table

#: A document of a lower score than this is rejected.
LEAST_QUALITY = 0.5


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier, fitted on the labelled documents of sf_dir, finds good."""
    model = compression.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    own = free_name(docs.columns, "quality_score")
    return compression.score(docs, model, docs.columns, out_col=own).where(F.col(own) >= LEAST_QUALITY).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more."""
    return nearcopies.deduplicate(docs)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind; n_chars is that of the new text."""
    redacted = pii.redact(docs)
    return redacted.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which the mix takes copies: the columns of documents, size, source_size, target, copies, taken.

    Where documents have a column of such a name, the added one has underscores at its end.  Rows equal in id
    and text are one document here, with the copies of all.
    """
    key = F.struct(F.col("doc_id").alias("id"), F.unhex(F.sha2("text", 256)).alias("digest"))
    packed = docs.select(F.struct("*").alias("row"), key.alias("key"), "source", "text")
    mixed = mixing.mix(packed, id_col="key").where("copies > 0")
    added = mixed.groupBy("key").agg(*(F.max(c).alias(c) for c in ("size", "source_size", "target")), *(F.sum(c).alias(c) for c in ("copies", "taken")), F.count("*").alias("rows"))
    added = materialise(added, "mixture")
    rows = packed.select("row", "key")
    if not added.where("rows > 1").isEmpty():
        rows = rows.dropDuplicates(["key"])
    # null ids and null texts are equal to themselves here
    id_, digest = F.col("key.id"), F.col("key.digest")
    left = rows.select("row", id_.alias("id"), digest.alias("digest"))
    right = added.select(id_.alias("its_id"), digest.alias("its_digest"), "size", "source_size", "target", "copies", "taken").hint("shuffle_hash")
    met = left.join(right, F.col("id").eqNullSafe(F.col("its_id")) & F.col("digest").eqNullSafe(F.col("its_digest")))
    names, taken = [], list(docs.columns)
    for c in ("size", "source_size", "target", "copies", "taken"):
        names.append(F.col(c).alias(free_name(taken, c)))
        taken.append(free_name(taken, c))
    return met.select(*(F.col("row").getField(c).alias(c) for c in docs.columns), *names)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("benchmark_free", benchmark_free), ("personal_data", personal_data), ("mixture", mixture)]

#: SQL can express neither the classifier nor the latent search; the stages are tested on their own.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
