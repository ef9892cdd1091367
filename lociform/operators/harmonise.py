"""Orientation of association rows to the first allele of a reference panel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociform.functions.scalar import complement, match_class, palindromic

#: No frequency within half the band of 0.5 tells a strand, and the two readings must differ by the margin.
BAND, MARGIN = 0.10, 0.10


def strand_by_frequency(eaf: Column, panel: Column) -> Column:
    """FORWARD or REVERSE for alleles that are their own complement, from the effect allele's and the panel's frequency; null if unclear."""
    known = lambda c: F.when((c > 0) & (c < 1), c)
    own, other = known(eaf), known(panel)
    unclear = (F.abs(own - 0.5) < BAND / 2) | (F.abs(other - 0.5) < BAND / 2)
    same, turned = F.abs(own - other), F.abs(own - (F.lit(1.0) - other))
    return F.when(own.isNull() | other.isNull() | unclear, None).when(same + MARGIN < turned, "FORWARD").when(turned + MARGIN < same, "REVERSE")


def harmonised(df: DataFrame) -> DataFrame:
    """df (ea, nea, eaf, a1, a2, a1_freq, beta, odds, ...) with action, and ea, nea, beta and odds turned to the panel's a1.

    Rows whose alleles are not the panel's have the action dropped, those of unclear strand dropped_palindromic;
    their values stay as they are.
    """
    ea, nea, a1 = F.upper("ea"), F.upper("nea"), F.col("a1")
    by_letters = match_class(ea, nea, a1, F.col("a2"))
    twin = palindromic(ea, nea) & by_letters.isin("FORWARD", "REVERSE")
    cls = F.when(twin, F.coalesce(strand_by_frequency(F.col("eaf"), F.col("a1_freq")), F.lit("UNCLEAR"))).otherwise(by_letters)
    odds = F.col("odds")

    def results(kind: Column) -> Column:
        out, turned, other = kind.isin("NONE", "UNCLEAR"), kind.isin("REVERSE", "REVERSE_COMPLEMENT"), kind.isin("COMPLEMENT", "REVERSE_COMPLEMENT")
        action = (
            F.when(kind == "NONE", "dropped").when(kind == "UNCLEAR", "dropped_palindromic").when(turned & other, "complement_flipped")
            .when(turned, "flipped").when(other, "complemented").otherwise("kept")
        )
        first, second = F.when(other & ~out, complement(ea)).otherwise(ea), F.when(other & ~out, complement(nea)).otherwise(nea)
        return F.struct(
            action.alias("action"), F.when(turned, second).otherwise(first).alias("ea"), F.when(turned, first).otherwise(second).alias("nea"),
            F.when(turned, -F.col("beta")).otherwise(F.col("beta")).alias("beta"), F.when(turned & (odds != 0), F.lit(1.0) / odds).otherwise(odds).alias("odds"),
        )

    # the class is computed once for each row: a column of it would be put in for each of its uses
    done = df.withColumn("_done", F.transform(F.array(cls), results)[0])
    return done.withColumns({c: F.col(f"_done.{c}") for c in ("action", "ea", "nea", "beta", "odds")}).drop("_done")
