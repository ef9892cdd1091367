"""Scalar functions as Column expressions; all but the exact test of tables stay inside generated code."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Coefficients of a Chebyshev fit of erfc, error below 1.2e-7.
ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)
#: Rational approximation of the normal quantile, central and tail numerators and denominators.
QNORM_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
QNORM_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
QNORM_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
QNORM_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)
#: Lanczos coefficients of log gamma.
LANCZOS = (76.18009172947146, -86.50532032941677, 24.01409824083091, -1.231739572450155, 0.1208650973866179e-2, -0.5395239384953e-5)
MEDIAN_CHI2 = 0.454936423


def horner(x: Column, coefficients: tuple[float, ...]) -> Column:
    """Highest power first."""
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + F.lit(c)
    return out


def erfc(x: Column) -> Column:
    """Complementary error function of x >= 0."""
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(0.5) * x)
    return t * F.exp(-x * x + horner(t, ERFC[::-1]))


def z_to_p(z: Column) -> Column:
    """Two-sided p of a z score."""
    return erfc(F.abs(z) / F.lit(math.sqrt(2)))


def qnorm(p: Column) -> Column:
    """Standard normal quantile; null outside (0, 1)."""
    q, low = p - 0.5, 0.02425
    central = horner(q * q, QNORM_A) * q / horner(q * q, QNORM_B)
    tail = lambda u: horner(F.sqrt(-2 * F.ln(u)), QNORM_C) / horner(F.sqrt(-2 * F.ln(u)), QNORM_D)
    return F.when((p > 0) & (p < low), tail(p)).when((p >= low) & (p <= 1 - low), central).when((p > 1 - low) & (p < 1), -tail(1 - p))


def log_gamma(x: Column) -> Column:
    t = x + 5.5
    series = F.lit(1.000000000190015)
    for k, c in enumerate(LANCZOS):
        series = series + F.lit(c) / (x + (k + 1))
    return -(t - (x + 0.5) * F.ln(t)) + F.ln(series * 2.5066282746310005 / x)


def neglog10(p: Column, most: float = 308.0) -> Column:
    """-log10 p, and most where p has underflowed to zero."""
    return F.when(p > 0, -F.log10(p)).otherwise(F.lit(most))


def normal_chr(c: Column) -> Column:
    """Chromosome label without its prefix, upper case."""
    return F.upper(F.regexp_replace(F.trim(c), "^(chr|Chr|CHR)(?=.)", ""))


def bare_chr(c: Column) -> Column:
    """Chromosome label without its prefix in any case, otherwise as it is; null where nothing is left."""
    return F.nullif(F.regexp_replace(F.trim(c), "^(?i:chr)", ""), F.lit(""))


def prefixed_chr(c: Column) -> Column:
    """Chromosome label with the prefix chr, which is added where it is not there in lower case."""
    t = F.trim(c)
    return F.when(F.startswith(t, F.lit("chr")), t).otherwise(F.concat(F.lit("chr"), t))


def is_rsid(c: Column) -> Column:
    """Whether a value is an rs number, in either case; false for null."""
    return F.coalesce(c.rlike(r"(?i)^rs\d+$"), F.lit(False))


def liability_scale(h2: Column, prevalence: Column, cases: Column) -> Column:
    """Heritability on the liability scale from the observed one, for a population prevalence and a share of cases; null outside (0, 1)."""
    t = qnorm(prevalence)
    height = F.exp(-0.5 * t * t) / math.sqrt(2 * math.pi)
    spread, sampled = prevalence * (F.lit(1.0) - prevalence), cases * (F.lit(1.0) - cases)
    return F.when((prevalence > 0) & (prevalence < 1) & (sampled > 0), h2 * spread * spread / (height * height * sampled))


def chr_order(c: Column) -> Column:
    """Sort key of a chromosome label: numbers, then X, Y, mitochondrial, unknown."""
    n = normal_chr(c)
    return F.when(n == "X", 23).when(n == "Y", 24).when(n.isin("M", "MT"), 25).otherwise(F.coalesce(n.try_cast("int"), F.lit(99)))


def optional_double(c: Column) -> Column:
    """A number, or null for the missing tokens and what does not parse."""
    t = F.trim(c)
    return F.when(t.isin("", ".") | F.lower(t).isin("na", "nan"), None).otherwise(t.try_cast("double"))


def display_id(rsid: Column, varid: Column, chrom: Column, pos: Column) -> Column:
    blank = lambda c: F.nullif(F.nullif(F.trim(c), F.lit("")), F.lit("."))
    return F.coalesce(blank(rsid), blank(varid), F.concat_ws(":", chrom, pos))


def stable_id(chrom: Column, pos: Column, a: Column, b: Column) -> Column:
    """Key of a variant whatever the order of its alleles."""
    return F.concat_ws(":", chrom.cast("string"), pos.cast("string"), F.least(F.upper(a), F.upper(b)), F.greatest(F.upper(a), F.upper(b)))


def complement(allele: Column) -> Column:
    return F.translate(F.upper(allele), "ACGT", "TGCA")


def palindromic(a: Column, b: Column) -> Column:
    return F.upper(F.concat(a, b)).isin("AT", "TA", "CG", "GC")


def match_class(ea: Column, nea: Column, a1: Column, a2: Column) -> Column:
    """How a variant's alleles correspond to those of a panel."""
    ca, cb = complement(ea), complement(nea)
    return (
        F.when((ea == a1) & (nea == a2), "FORWARD").when((ea == a2) & (nea == a1), "REVERSE")
        .when((ca == a1) & (cb == a2), "COMPLEMENT").when((ca == a2) & (cb == a1), "REVERSE_COMPLEMENT").otherwise("NONE")
    )


def effect_value(beta: Column, odds: Column) -> Column:
    """The effect on the linear scale: beta, else the logarithm of a positive odds ratio, else null."""
    return F.when(beta.isNotNull() & ~F.isnan(beta), beta).when(odds > 0, F.log(odds))


def tier(z: Column) -> Column:
    """Significance tier of an absolute z score: p below 5e-8, 5e-5, 5e-3."""
    return F.when(z > 5.4513, 3).when(z > 4.0556, 2).when(z > 2.8070, 1).otherwise(0)


def in_mhc(chrom: Column, start: Column, end: Column, build: int = 37) -> Column:
    low, high = (28_477_897, 33_448_354) if build == 37 else (28_510_120, 33_480_577)
    return (chrom == 6) & (start <= high) & (end >= low)


def ancestry_code(c: Column) -> Column:
    return F.upper(F.regexp_extract(F.trim(c), "^[^ (,;]*", 0))


def haldane_odds_ratio(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Odds ratio of a 2x2 table with half a count added throughout where any cell is zero."""
    h = F.when((a == 0) | (b == 0) | (c == 0) | (d == 0), 0.5).otherwise(0.0)
    return (a + h) * (d + h) / ((b + h) * (c + h))


def round4(v: Column) -> Column:
    """Half up at four decimals."""
    return F.floor(v * 1e4 + 0.5) / 1e4


def file_safe(c: Column) -> Column:
    return F.regexp_replace(c, "[^A-Za-z0-9._-]", "_")


#: Fixed value: weights of tables that differ by less than this, as logarithms, are equal.
FISHER_TIE = 1e-9


def _mass(ratio, x: int, end: int, step: int) -> float:
    """Sum of the weights of x, x + step, ... end in units of that of x, by ratio(x) of neighbours, until they vanish."""
    total, last = 0.0, 1.0
    while (x - end) * step <= 0 and last > 1e-30:
        part = np.arange(x, x + step * min(4096, (end - x) * step + 1), step, dtype=np.float64)
        weights = last * np.concatenate([[1.0], np.cumprod(ratio(part[:-1]))])
        total += float(weights.sum())
        last = float(weights[-1] * ratio(part[-1:])[0])
        x = int(part[-1]) + step
    return total


def fisher_p(a: int, b: int, c: int, d: int) -> float:
    """Exact two-sided p of a 2x2 table: all tables of the margins no likelier than the observed one.

    Weights fall on either side of the likeliest table, so that both tails are sums of ratios from where they
    begin, which end where terms vanish: about as many terms as standard deviations, whatever the counts.
    """
    rows, column, total = a + b, a + c, a + b + c + d
    low, high = max(0, rows + column - total), min(rows, column)
    up = lambda x: (rows - x) * (column - x) / ((x + 1.0) * (total - rows - column + x + 1.0))
    down = lambda x: x * (total - rows - column + x) / ((rows - x + 1.0) * (column - x + 1.0))
    fact = lambda x: math.lgamma(x + 1.0)
    weight = lambda x: -(fact(x) + fact(rows - x) + fact(column - x) + fact(total - rows - column + x))
    mode = min(high, max(low, (rows + 1) * (column + 1) // (total + 2)))
    top, observed = weight(mode), weight(a) + FISHER_TIE
    everything = _mass(up, mode, high, 1) + _mass(down, mode, low, -1) - 1.0

    def tail(inner: int, end: int, step: int) -> float:
        # the first table from the mode outwards that is no likelier than the observed one
        near, far = 0, (end - inner) * step + 1
        while near < far:
            middle = (near + far) // 2
            near, far = (near, middle) if weight(inner + step * middle) <= observed else (middle + 1, far)
        x = inner + step * near
        return math.exp(weight(x) - top) * _mass(up if step > 0 else down, x, end, step) if (end - x) * step >= 0 else 0.0

    both = tail(mode, high, 1) + tail(mode - 1, low, -1)
    return min(1.0, both / everything)


@F.pandas_udf(DoubleType())
def fisher_two_sided(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    """fisher_p of each row; null where a count is."""
    known = a.notna() & b.notna() & c.notna() & d.notna()
    out = pd.Series(np.nan, index=a.index)
    out[known] = [fisher_p(*map(int, t)) for t in zip(a[known], b[known], c[known], d[known])]
    return out.where(known, None)
