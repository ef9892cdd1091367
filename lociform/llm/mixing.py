"""Mixing sources to target weights by entropy balancing.

Every source shall give a target number of words.  Of all document rates r between 0 and ``most`` that
meet the targets, entropy balancing takes those closest to 1 in relative entropy:

    r = min(most, exp(lambda * x)),   x = size / mean size of the source

with one dual variable lambda for each source.  The dual is convex; its gradient is the source's words
at rate r less its target.  Newton steps (kept in a bracket) find lambda for all sources at once.  They
run as Spark aggregations over the counts of (source, size), which carry all that rates depend on.

Rates become whole copies: the running sum of rates over a source's sizes is rounded, so errors cancel
instead of adding up; what then still lacks or exceeds the target is given to or taken from the
smallest documents, one copy each.  Copies of one (source, size) go to its documents in the order of a
hash of the id.

All sums that decide anything are over integers (rates in units of 2**-30), so reruns agree whatever
the order of tasks.  A source of W words has at most sqrt(2 W) distinct sizes, which bounds every
window here.  Rows that are equal in id, source and size are one row with a count, whatever their number;
such rows of one size are spread over cells salted by a hash of the id, as many as keep a cell near PART rows.

Edge cases: a null text has size 0, a null source is a source of its own, last in order; documents
of size 0 are taken once and give no words; repeated rows count and are taken like others; an empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lociform.llm.common import WORD, forget, materialise

UNIT = 1 << 30
#: Distinct rows of one (source, size) are dealt by a hash to so many parts at least, and as many more as keep a part near
#: PART rows; equal rows are handed out again in pieces of PART.
SALTS, PART = 64, 100_000
ROUNDS = 80


def matched(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on equal keys, null equal to null; the keys come from the left."""
    other = right.select(*(F.col(c).alias(f"_{c}") if c in keys else c for c in right.columns))
    on = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys]
    return left.join(other, on, how).drop(*(f"_{c}" for c in keys))


def sizes(df: DataFrame, text_col: str = "text") -> Column:
    """Number of words in each text."""
    return F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long")


def numbered(sources: DataFrame) -> DataFrame:
    """A number from 0 for each source by code point, null last, without one task seeing all of them."""
    ordered = materialise(
        sources.withColumn("_null", F.col("source").isNull().cast("int")).repartitionByRange("_null", "source").withColumn("_part", F.spark_partition_id()),
        "mix-order",
    )
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = ordered.groupBy("_part").count().withColumn("_before", F.coalesce(F.sum("count").over(before), F.lit(0)))
    within = Window.partitionBy("_part").orderBy("_null", "source")
    return ordered.join(parts, "_part").withColumn("number", F.col("_before") + F.row_number().over(within) - 1).drop("_null", "_part", "_before", "count")


def targets(sources: DataFrame, weights: tuple = (1, 2, 3), most: int = 3) -> DataFrame:
    """Add target to (source, number, source_size): shares of all words by weight, at most most times a source.

    What a capped source cannot take is shared again by weight, until none is above its cap.
    """
    level_weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("number") % len(weights) + 1).cast("int"))
    known = materialise(sources.withColumn("weight", level_weight), "mix-sources")
    total = known.agg(F.sum("source_size")).first()[0] or 0
    level, cap = 0.0, F.col("source_size") * most
    while True:
        # level: words for each unit of weight; a capped source stays capped as the level rises
        over = cap < F.col("weight") * F.lit(level)
        fixed, weight = known.agg(F.sum(F.when(over, cap).otherwise(0)), F.sum(F.when(over, 0).otherwise(F.col("weight")))).first()
        after = (total - (fixed or 0)) / weight if weight else level
        if after <= level:
            break
        level = after
    return known.withColumn("target", F.least(cap.cast("double"), F.col("weight") * F.lit(float(level)))).drop("weight")


def rate(lam: Column, x: Column, most: int) -> Column:
    """Rate in units of 2**-30."""
    return F.when(lam.isNull(), F.lit(float(most))).otherwise(F.least(F.lit(float(most)), F.exp(F.least(F.lit(30.0), lam * x)))).cast("double") * UNIT


def balance(cells: DataFrame, aims: DataFrame, most: int = 3, tolerance: float = 1e-7) -> DataFrame:
    """aims with lam for each source: the dual's solution; null where every document is taken most times.

    cells: (source, size, n); aims: (source, source_size, n_docs, target).
    """
    mean = F.col("source_size") / F.greatest(F.col("n_docs"), F.lit(1))
    state = materialise(
        aims.withColumn("mean", F.when(mean > 0, mean).otherwise(1.0))
        .withColumn("full", F.col("target") >= F.col("source_size") * most * (1 - 1e-9))
        .withColumn("lam", F.lit(0.0)).withColumn("low", F.lit(None).cast("double")).withColumn("high", F.lit(None).cast("double"))
        .withColumn("done", F.col("full") | (F.col("target") <= 0)),
        "mix-state",
    )
    for _ in range(ROUNDS):
        joined = matched(cells.where("size > 0"), state.where(~F.col("done")).select("source", "lam", "mean"), ["source"])
        x = F.col("size") / F.col("mean")
        units = F.round(rate(F.col("lam"), x, most)).cast("long")
        words = F.col("n").cast("decimal(20,0)") * F.col("size").cast("decimal(18,0)")
        slope = F.when(units < most * UNIT, F.round(x * units / 1024).cast("long")).otherwise(0)
        sums = joined.groupBy("source").agg(
            F.sum(words * units.cast("decimal(12,0)")).alias("taken"), F.sum(words * slope.cast("decimal(19,0)")).alias("grows")
        )
        taken, grows = F.col("taken").cast("double") / UNIT, F.col("grows").cast("double") / (UNIT / 1024)
        gap = taken - F.col("target")
        low = F.when(gap < 0, F.col("lam")).otherwise(F.col("low"))
        high = F.when(gap > 0, F.col("lam")).otherwise(F.col("high"))
        # Newton on log(words), nearly straight in lambda; halving or doubling where it leaves the bracket
        newton = F.col("lam") - F.when((taken > 0) & (grows > 0), taken / grows * F.ln(taken / F.col("target")))
        middle = F.when(low.isNotNull() & high.isNotNull(), (low + high) / 2).when(low.isNotNull(), F.greatest(low * 2, low + 1)).otherwise(F.least(high * 2, high - 1))
        inside = newton.isNotNull() & F.coalesce(newton > low, F.lit(True)) & F.coalesce(newton < high, F.lit(True)) & (F.abs(newton) < 1e6)
        met = F.coalesce(F.abs(gap) <= F.greatest(F.lit(0.5), F.col("target") * tolerance), F.lit(True))
        after = matched(state, sums, ["source"], "left").select(
            "source", "source_size", "n_docs", "target", "mean", "full",
            F.when(F.col("done") | met, F.col("lam")).when(inside, newton).otherwise(middle).alias("lam"),
            F.when(F.col("done"), F.col("low")).otherwise(low).alias("low"),
            F.when(F.col("done"), F.col("high")).otherwise(high).alias("high"),
            (F.col("done") | met).alias("done"),
        )
        after = materialise(after, "mix-state")
        forget(state)
        state = after
        if state.where(~F.col("done")).isEmpty():
            break
    none = (F.col("target") <= 0) & (F.col("source_size") > 0)
    return state.select("source", "source_size", "target", "mean", F.when(F.col("full"), None).when(none, -1e9).otherwise(F.col("lam")).alias("lam"))


def quotas(cells: DataFrame, solved: DataFrame, most: int = 3) -> DataFrame:
    """Copies m for each (source, size) of n documents, near n times the rate, whose words meet the target."""
    joined = matched(cells, solved, ["source"])
    units = F.round(rate(F.col("lam"), F.col("size") / F.col("mean"), most)).cast("long")
    upward = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, 0)
    share = F.col("n").cast("decimal(20,0)") * units.cast("decimal(12,0)")
    running = F.sum(share).over(upward)
    whole = lambda c: F.floor((c + F.lit(UNIT // 2)) / F.lit(UNIT))
    rounded = joined.withColumn("upto", running).withColumn("share", share)
    rounded = rounded.withColumn("m", (whole(F.col("upto")) - whole(F.col("upto") - F.col("share"))).cast("long"))
    rounded = rounded.withColumn("m", F.greatest(F.lit(0), F.least(F.col("m"), F.col("n") * most)))
    # what is still missing (or too much) goes to the smallest documents, one copy each
    everyone = Window.partitionBy("source")
    rest = F.col("target") - F.sum(F.col("m") * F.col("size")).over(everyone)
    gap = rounded.withColumn("rest", rest)
    room = F.when(F.col("size") == 0, 0).when(F.col("rest") > 0, F.least("n", F.col("n") * most - F.col("m"))).otherwise(F.least("n", "m"))
    gap = gap.withColumn("room", room).withColumn("until", F.sum(F.col("room") * F.col("size")).over(upward))
    left = F.abs("rest") - (F.col("until") - F.col("room") * F.col("size"))
    shift = F.when(F.col("size") == 0, 0).otherwise(F.greatest(F.lit(0), F.least(F.col("room"), F.floor(left / F.greatest("size", F.lit(1))))))
    return gap.withColumn("m", F.col("m") + F.when(F.col("rest") > 0, shift).otherwise(-shift)).select("source", "size", "n", "m", "source_size", "target")


def mix(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: tuple = (1, 2, 3), most: int = 3) -> DataFrame:
    """A row for each row of df: id_col, size, source_size, target, copies, taken = copies * size.

    weights repeat over the sources in order of code points.
    """
    docs = df.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), sizes(df, text_col).alias("size"))
    docs = materialise(docs.groupBy("id", "source", "size").agg(F.count("*").alias("c")), "mix-sizes")
    rows, largest = docs.agg(F.count("*"), F.max("c")).first()
    docs = docs.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(max(SALTS, -(-rows // PART)))).cast("int"))
    salted = materialise(docs.groupBy("source", "size", "salt").agg(F.sum("c").alias("k")), "mix-cells")
    cells = materialise(salted.groupBy("source", "size").agg(F.sum("k").alias("n")), "mix-cells")
    sources = cells.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("n_docs"))
    aims = targets(numbered(sources), weights, most)
    copies = quotas(cells, balance(cells, aims, most), most)
    # a cell's copies are dealt to its salted parts by rounding a running sum again, then in order within a part
    along = Window.partitionBy("source", "size").orderBy("salt").rowsBetween(Window.unboundedPreceding, 0)
    parts = matched(salted, copies, ["source", "size"])
    given = F.expr("((m % n) * cast(upto as decimal(20,0))) div n - ((m % n) * cast(upto - k as decimal(20,0))) div n")
    parts = parts.withColumn("upto", F.sum("k").over(along)).withColumn("each", F.expr("m div n")).withColumn("given", given.cast("long")).drop("upto", "n", "m", "k")
    order = Window.partitionBy("source", "size", "salt").orderBy(F.xxhash64("id", F.lit(1)), "id").rowsBetween(Window.unboundedPreceding, 0)
    out = matched(docs.withColumn("upto", F.sum("c").over(order)), parts, ["source", "size", "salt"])
    # of equal rows so many get one copy more
    more = F.greatest(F.lit(0), F.least(F.col("c"), F.col("given") - (F.col("upto") - F.col("c")))).cast("long")
    kinds = F.array(F.struct((F.col("each") + 1).alias("copies"), F.col("more").alias("times")), F.struct(F.col("each").alias("copies"), (F.col("c") - F.col("more")).alias("times")))
    out = out.withColumn("more", more).select("id", "source", "size", "source_size", "target", F.explode(F.filter(kinds, lambda k: k["times"] > 0)).alias("kind"))
    out = out.select("*", "kind.copies", "kind.times").drop("kind")
    if (largest or 0) > PART:
        piece = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("times") - 1) / PART)))
        out = out.withColumn("piece", piece).withColumn("times", F.least(F.lit(PART), F.col("times") - F.col("piece") * PART)).repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))).drop("piece")
    out = out.select("*", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).drop("col", "times")
    return out.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
