"""Meta-analysis of cohorts: genomic control of each, then fixed and random effects of each variant."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociform.functions.scalar import MEDIAN_CHI2, z_to_p
from lociform.operators.programs import bound
from lociform.operators.stats import medians


def usable(rows: DataFrame) -> DataFrame:
    """Rows with a known effect and a positive standard error."""
    return rows.where(F.col("beta").isNotNull() & ~F.isnan("beta") & (F.col("se") > 0) & ~F.isnan("se"))


def genomic_control(rows: DataFrame, cohort: str) -> DataFrame:
    """Usable rows with the standard errors of each cohort widened by the root of its inflation, if that is above one, and inflation."""
    z = F.col("beta") / F.col("se")
    own = usable(rows)
    spread = medians(own.withColumn("_chi2", z * z), [cohort], "_chi2").select(cohort, (F.col("median") / MEDIAN_CHI2).alias("inflation"))
    # a row for each cohort
    return own.join(F.broadcast(spread), cohort).withColumn("se", F.col("se") * F.sqrt(F.greatest(F.lit(1.0), F.col("inflation"))))


def _total(records: Column, term: Callable[[Column], Column]) -> Column:
    return F.aggregate(records, F.lit(0.0), lambda a, r: a + term(r))


def combined(rows: DataFrame, key: list[str], cohort: str, cohorts: list) -> DataFrame:
    """Fixed and random effects of each key over its cohorts, effects turned to the alleles of its first cohort.

    rows: key, cohort, ea, nea, beta, se; a cohort's row with the smallest (ea, nea, beta, se) counts if it
    has several.  Rows that are not usable and rows of other alleles are left out.  Returns key, ea, nea, n
    (cohorts), beta, se, p, q (heterogeneity), i2 (share of q beyond its degrees of freedom), tau2, beta_random,
    se_random, p_random and direction: a sign for each of cohorts in order, ? where one is missing.

    The cohorts of a key come together as one list, no longer than there are cohorts; the rest is expressions on it.
    """
    kind = rows.schema[cohort].dataType
    one = usable(rows).groupBy(*key, F.col(cohort).alias("_cohort")).agg(F.min(F.struct(F.upper("ea").alias("ea"), F.upper("nea").alias("nea"), F.col("beta").cast("double").alias("beta"), F.col("se").cast("double").alias("se"))).alias("_r"))
    lists = one.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("_cohort", "_r.ea", "_r.nea", "_r.beta", "_r.se"))).alias("_l"))
    lead = F.get("_l", F.lit(0))
    lists = lists.withColumn("_ea", lead["ea"]).withColumn("_nea", lead["nea"])
    same = lambda r: (r["ea"] == F.col("_ea")) & (r["nea"] == F.col("_nea"))
    other = lambda r: (r["ea"] == F.col("_nea")) & (r["nea"] == F.col("_ea"))
    fit = F.filter("_l", lambda r: F.coalesce(same(r) | other(r), F.lit(False)))
    turned = F.transform(fit, lambda r: F.struct(r["_cohort"].alias("cohort"), F.when(same(r), r["beta"]).otherwise(-r["beta"]).alias("b"), (F.lit(1.0) / (r["se"] * r["se"])).alias("w")))

    def told(records: Column) -> Column:
        w, wb = _total(records, lambda r: r["w"]), _total(records, lambda r: r["w"] * r["b"])
        ww, wbb = _total(records, lambda r: r["w"] * r["w"]), _total(records, lambda r: r["w"] * r["b"] * r["b"])
        return F.struct(F.size(records).cast("long").alias("n"), w.alias("w"), (wb / w).alias("beta"), F.greatest(F.lit(0.0), wbb - wb * wb / w).alias("q"), (w - ww / w).alias("c"))

    sums = lists.withColumn("_t", turned).withColumn("_s", bound(F.col("_t"), told)).where(F.size("_t") > 0)
    q, df = F.col("_s.q"), F.col("_s.n") - 1
    over = F.greatest(F.lit(0.0), q - df)
    sums = sums.withColumn("i2", F.when(q > 0, over / q).otherwise(0.0)).withColumn("tau2", F.when(F.col("_s.c") > 0, over / F.col("_s.c")).otherwise(0.0))
    less = lambda r: F.lit(1.0) / (F.lit(1.0) / r["w"] + F.col("tau2"))
    sums = sums.withColumn("_w", _total(F.col("_t"), less)).withColumn("_wb", _total(F.col("_t"), lambda r: less(r) * r["b"]))
    sign = F.map_from_entries(F.transform("_t", lambda r: F.struct(r["cohort"].alias("k"), F.when(r["b"] > 0, "+").when(r["b"] < 0, "-").otherwise("0").alias("v"))))
    direction = F.concat(*(F.coalesce(F.element_at("_signs", F.lit(c).cast(kind)), F.lit("?")) for c in cohorts))
    se, se_random = F.sqrt(F.lit(1.0) / F.col("_s.w")), F.sqrt(F.lit(1.0) / F.col("_w"))
    return sums.withColumn("_signs", sign).select(
        *key, F.col("_ea").alias("ea"), F.col("_nea").alias("nea"), F.col("_s.n").alias("n"), F.col("_s.beta").alias("beta"), se.alias("se"), z_to_p(F.col("_s.beta") / se).alias("p"), q.alias("q"), "i2", "tau2",
        (F.col("_wb") / F.col("_w")).alias("beta_random"), se_random.alias("se_random"), z_to_p(F.col("_wb") / F.col("_w") / se_random).alias("p_random"), direction.alias("direction"),
    )
