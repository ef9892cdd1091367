"""Null sets of positions that keep their distance to the nearest gene start, and their empirical p."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lociform.operators.loci import BIN, islands
from lociform.operators.ranges import nearest, points_in
from lociform.operators.stats import placed


def numbered(places: DataFrame) -> DataFrame:
    """places (chr, pos) numbered from 0 by chromosome and position: numbers within chromosomes, then the counts before each."""
    own = placed(places.select("chr", "pos").distinct(), ["chr"], F.floor(F.col("pos") / BIN), ["pos"])
    # a row for each chromosome
    sizes = own.groupBy("chr").agg(F.max("total").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("chr").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return own.join(F.broadcast(sizes), "chr").select((F.col("place") - 1 + F.col("_before")).cast("long").alias("number"), "chr", "pos")


def within(points: DataFrame, key: list[str], elements: DataFrame, limits: dict[str, int]) -> DataFrame:
    """(key, limit) of points (key, chr, pos) that have an element no further than the limit.

    Widened elements are merged first, so a point meets at most one for each limit.
    """
    merged = None
    for name, reach in limits.items():
        wide = elements.select("chr", (F.col("start") - reach).alias("start"), (F.col("end") + reach).alias("end"))
        own = islands(wide, 0).groupBy("chr", "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).select("chr", "start", "end", F.lit(name).alias("limit"))
        merged = own if merged is None else merged.unionByName(own)
    return points_in(points.select(*key, "chr", "pos"), merged).select(*key, "limit")


def matched_null(points: DataFrame, key: str, starts: DataFrame, elements: DataFrame, limits: dict[str, int], sets: int = 1000, draw: Callable[[Column, Column, Column], Column] | None = None) -> DataFrame:
    """limit, observed, expected, p: points near elements against sets of positions with the same signed distance to a gene start.

    draw(key, set, number of starts) names the start; by default a hash does.  Each set has a position
    for each point, so the work is sets times points and spreads over both.  Positions before 1 stay and
    meet nothing.  p is (1 + sets as large) / (1 + sets).
    """
    draw = draw or (lambda k, s, n: F.pmod(F.xxhash64(k, s), n))
    own = numbered(starts)
    n = own.agg(F.count("*").alias("_n"))  # one row
    near = nearest(points.select(key, "chr", "pos"), own.select("chr", F.col("pos").alias("start"), F.col("pos").alias("end"), "number"), "number").where("near is not null")
    at = near.join(own.select(F.col("number").alias("near"), F.col("pos").alias("_tss")), "near").select(key, (F.col("pos") - F.col("_tss")).alias("_off"))
    drawn = at.crossJoin(F.broadcast(n)).select(key, "_off", "_n", F.explode(F.sequence(F.lit(1), F.lit(sets))).alias("set"))
    drawn = drawn.withColumn("number", draw(F.col(key), F.col("set"), F.col("_n")).cast("long"))
    placed = drawn.join(own, "number").select(key, "set", "chr", (F.col("pos") + F.col("_off")).alias("pos"))
    every = placed.unionByName(points.select(key, F.lit(0).alias("set"), "chr", "pos"))  # set 0 is what was observed
    counts = within(every, ["set", key], elements, limits).groupBy("limit", "set").agg(F.count("*").alias("c"))
    # a number for each set
    by = counts.groupBy("limit").agg(F.coalesce(F.max(F.when(F.col("set") == 0, F.col("c"))), F.lit(0)).alias("observed"), F.collect_list(F.when(F.col("set") > 0, F.col("c"))).alias("_c"))
    names = points.sparkSession.createDataFrame([(x,) for x in limits], "limit string")
    whole = names.join(by, "limit", "left").select("limit", F.coalesce("observed", F.lit(0).cast("long")).alias("observed"), F.coalesce("_c", F.array().cast("array<long>")).alias("_c"))
    # sets without any position near an element have no number: they are as large only where nothing was observed
    ge = F.when(F.col("observed") == 0, F.lit(sets)).otherwise(F.size(F.filter("_c", lambda c: c >= F.col("observed"))))
    total = F.aggregate("_c", F.lit(0).cast("long"), lambda t, c: t + c)
    return whole.select("limit", "observed", (total / F.lit(float(sets))).alias("expected"), ((ge + 1) / F.lit(sets + 1.0)).alias("p"))
