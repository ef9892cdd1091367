"""Coordinates from one genome build to another: alignment blocks as intervals, joined by bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lociform.operators.ranges import overlapping, points_in


def read_chains(spark: SparkSession, path: str) -> DataFrame:
    """Aligned blocks of a chain file: chain, score, chr, start, end (1-based, inclusive), chr_to, start_to, size_to, strand_to.

    A chain is a paragraph; its lines hold the size of a block and the gaps behind it in both builds.
    """
    text = spark.read.option("lineSep", "\n\n").text(path).where("trim(value) <> ''")
    lines = text.select(F.monotonically_increasing_id().alias("part"), F.filter(F.split(F.trim("value"), "\n"), lambda x: ~x.startswith("#") & (F.trim(x) != "")).alias("lines"))
    head = F.split(F.element_at("lines", 1), r"\s+")
    chains = lines.where(F.size("lines") > 1).select("part", head.alias("h"), F.posexplode(F.slice("lines", 2, F.size("lines"))).alias("k", "line"))
    cell = F.split(F.trim("line"), r"\s+")
    whole = lambda i: F.coalesce(F.try_element_at(cell, F.lit(i)).cast("long"), F.lit(0).cast("long"))
    blocks = chains.select("part", "h", "k", whole(1).alias("size"), whole(2).alias("gap"), whole(3).alias("gap_to"))
    before = Window.partitionBy("part").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    done = lambda gap: F.coalesce(F.sum(F.col("size") + F.col(gap)).over(before), F.lit(0).cast("long"))
    at = blocks.withColumn("a", done("gap")).withColumn("b", done("gap_to"))
    h = lambda i: F.col("h")[i]
    start = h(5).cast("long") + F.col("a") + 1
    return at.select(
        h(12).alias("chain"), h(1).cast("double").alias("score"), h(2).alias("chr"), start.alias("start"), (start + F.col("size") - 1).alias("end"),
        h(7).alias("chr_to"), (h(10).cast("long") + F.col("b") + 1).alias("start_to"), h(8).cast("long").alias("size_to"), h(9).alias("strand_to"),
    )


def _placed(pos: str) -> Column:
    forward = F.col("start_to") + F.col(pos) - F.col("start")
    return F.when(F.col("strand_to") == "-", F.col("size_to") - forward + 1).otherwise(forward)


def lift_points(points: DataFrame, blocks: DataFrame, key: str) -> DataFrame:
    """points with chr_to, pos_to and state (mapped or unmapped); of several blocks that of the best score counts."""
    own = blocks.drop("chain")
    hits = points_in(points.select(key, "chr", "pos"), own).withColumn("pos_to", _placed("pos"))
    best = hits.groupBy(key).agg(F.max_by(F.struct("chr_to", "pos_to"), F.struct("score", F.col("chr_to"), F.col("pos_to"))).alias("_b"))
    return points.join(best, key, "left").select(*points.columns, "_b.chr_to", "_b.pos_to", F.when(F.col("_b").isNull(), "unmapped").otherwise("mapped").alias("state"))


def lift_regions(regions: DataFrame, blocks: DataFrame, key: str, least: float = 0.95) -> DataFrame:
    """regions (key, chr, start, end) lifted as one interval each, with the share of it that blocks of one target cover.

    Unmapped where no target covers the share `least`; of several targets that with more cover counts, then the smaller name.
    """
    own = blocks.select("chr", "start", "end", "chr_to", "start_to", "size_to", "strand_to")
    o = overlapping(regions.select(key, "chr", "start", "end"), own)
    o = o.withColumn("_l", F.greatest("start", "start_b")).withColumn("_r", F.least("end", "end_b"))
    o = o.withColumnsRenamed({"start": "_s", "end": "_e"}).select(key, "_s", "_e", "_l", "_r", F.col("start_b").alias("start"), *(F.col(f"{c}_b").alias(c) for c in ("chr_to", "start_to", "size_to", "strand_to")))
    ends = o.withColumn("_x", _placed("_l")).withColumn("_y", _placed("_r"))
    by = ends.groupBy(key, "chr_to").agg(F.min(F.least("_x", "_y")).alias("start_to"), F.max(F.greatest("_x", "_y")).alias("end_to"), (F.sum(F.col("_r") - F.col("_l") + 1) / F.first(F.col("_e") - F.col("_s") + 1)).alias("cover"))
    best = by.groupBy(key).agg(F.min_by(F.struct("chr_to", "start_to", "end_to", "cover"), F.struct((-F.col("cover")).alias("c"), "chr_to")).alias("_b"))
    ok = F.col("_b.cover") >= least
    to = lambda c: F.when(ok, F.col(f"_b.{c}")).alias(c)
    return regions.join(best, key, "left").select(*regions.columns, to("chr_to"), to("start_to"), to("end_to"), F.coalesce("_b.cover", F.lit(0.0)).alias("cover"), F.when(ok, "mapped").otherwise("unmapped").alias("state"))
