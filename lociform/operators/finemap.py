"""Single-signal fine-mapping by approximate Bayes factors, and colocalisation of two traits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def log_bayes_factor(beta: Column, se: Column, w: float = 0.04) -> Column:
    v = se * se
    return F.lit(0.5) * F.ln(v / (v + w)) + beta * beta / v * w / (F.lit(2.0) * (v + w))


def posterior(df: DataFrame, keys: list[str], log_bf: str = "lbf") -> DataFrame:
    """df with pip: the softmax of log Bayes factors within keys."""
    w = Window.partitionBy(*keys)
    e = df.withColumn("_e", F.exp(F.col(log_bf) - F.max(log_bf).over(w)))
    return e.withColumn("pip", F.col("_e") / F.sum("_e").over(w)).drop("_e")


def credible_set(df: DataFrame, keys: list[str], order: list[Column], coverage: float = 0.95) -> DataFrame:
    """Rows of the smallest prefix in order whose pip sums to the coverage, with rank and cumulated pip."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cum = df.withColumn("cum_pip", F.sum("pip").over(w)).withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))
    return cum.where(F.round(F.col("cum_pip") - F.col("pip"), 9) < coverage)


def colocalisation(pairs: DataFrame, keys: list[str], p1: float = 1e-4, p2: float = 1e-4, p12: float = 1e-5) -> DataFrame:
    """Posteriors of H0..H4 from lbf1 and lbf2 of the variants that both traits have."""
    top = Window.partitionBy(*keys)
    d = pairs.withColumn("_m1", F.max("lbf1").over(top)).withColumn("_m2", F.max("lbf2").over(top))
    s = d.groupBy(*keys).agg(
        F.count("*").alias("n"), F.max("_m1").alias("m1"), F.max("_m2").alias("m2"), F.sum(F.exp(F.col("lbf1") - F.col("_m1"))).alias("s1"),
        F.sum(F.exp(F.col("lbf2") - F.col("_m2"))).alias("s2"), F.sum(F.exp(F.col("lbf1") + F.col("lbf2") - F.col("_m1") - F.col("_m2"))).alias("s12"),
    )
    # all in units of exp(m1 + m2)
    shift = -(F.col("m1") + F.col("m2"))
    h = [F.exp(shift), F.exp(-F.col("m2")) * F.col("s1") * p1, F.exp(-F.col("m1")) * F.col("s2") * p2, (F.col("s1") * F.col("s2") - F.col("s12")) * (p1 * p2), F.col("s12") * p12]
    total = h[0] + h[1] + h[2] + h[3] + h[4]
    return s.select(*keys, "n", *((x / total).alias(f"h{k}") for k, x in enumerate(h)))
