"""Programs over loci: linkage, sum of single effects, score regression, rankings, clustering, edits.

Per-locus numerical work runs in ``applyInPandas`` over one locus at a time, whose variants are bounded
by a window; programs over datasets (tens of them) run on the driver from one small aggregate.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType
from pyspark.sql.window import Window

from lociform.operators.ranges import points_in

# ---- linkage ----------------------------------------------------------------------------------


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once: inlined into a lambda it would be computed for each element."""
    return F.transform(F.array(value), body)[0]


def centred(df: DataFrame, dosages: str) -> DataFrame:
    """df with its dosage array centred and scaled to length 1; null where it does not vary."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    length = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x * x))
    less_mean = lambda d: bound(total(d) / F.size(d), lambda m: F.transform(d, lambda x: x - m))
    unit = lambda c: bound(length(c), lambda n: F.when(n > 0, F.transform(c, lambda x: x / n)))
    return df.withColumn(dosages, bound(F.col(dosages).cast("array<double>"), lambda d: bound(less_mean(d), unit)))


def linkage(df: DataFrame, place: str, dosages: str, reach: int) -> DataFrame:
    """(i, j, r) for variants at most reach places apart, i < j, by equality on blocks of reach places.

    What follows a variant lies in its own block or the next one, so each variant makes two rows,
    whatever the size of its region.
    """
    c = centred(df.select(F.col(place).alias("i"), F.col(dosages).alias("d")), "d")
    block = F.floor(F.col("i") / reach)
    after = c.select(F.explode(F.array(block - 1, block)).alias("block"), F.col("i").alias("j"), F.col("d").alias("e"))
    pairs = c.withColumn("block", block).join(after, "block").where((F.col("j") > F.col("i")) & (F.col("j") <= F.col("i") + reach))
    r = F.aggregate(F.zip_with("d", "e", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    return pairs.select("i", "j", r.alias("r"))


def linkage_check(pairs: DataFrame, z: DataFrame) -> DataFrame:
    """Residual of each variant against its best neighbour of .5 < |r| < .99, with flags at 10.83 and 15.14.

    pairs: (i, j, r); z: (i, z).
    """
    both = pairs.unionByName(pairs.select(F.col("j").alias("i"), F.col("i").alias("j"), "r")).where((F.abs("r") > 0.5) & (F.abs("r") < 0.99))
    best = both.groupBy("i").agg(F.max_by(F.struct("j", "r"), F.struct(F.round(F.abs("r"), 9), -F.col("j"))).alias("b")).select("i", "b.j", "b.r")
    t = best.join(z, "i").join(z.select(F.col("i").alias("j"), F.col("z").alias("zj")), "j")
    residual = (F.col("z") - F.col("r") * F.col("zj")) * (F.col("z") - F.col("r") * F.col("zj")) / (1 - F.col("r") * F.col("r"))
    return t.select("i", "j", residual.alias("residual"), (residual > 10.83).alias("flagged"), (residual > 15.14).alias("severe"))


# ---- sum of single effects --------------------------------------------------------------------


def single_effects(z: np.ndarray, r: np.ndarray, n: int, effects: int = 10, rounds: int = 100, prior: float = 0.2) -> np.ndarray:
    """Posterior inclusion probabilities of the sum of single effects from z scores and their correlation."""
    p = len(z)
    xty, scale = z * np.sqrt(n), float(n)
    alpha, mu = np.full((effects, p), 1 / p), np.zeros((effects, p))
    variance = prior * prior
    for _ in range(rounds):
        before = alpha.copy()
        for k in range(effects):
            others = (alpha * mu).sum(axis=0) - alpha[k] * mu[k]
            left = xty - scale * (r @ others)
            shrink = variance / (variance + 1 / scale)
            mu[k] = shrink * left / scale
            log = 0.5 * np.log(1 - shrink) + 0.5 * shrink * left * left / scale
            e = np.exp(log - log.max())
            alpha[k] = e / e.sum()
        if np.abs(alpha - before).max() < 1e-4:
            break
    # an effect spread over everything says nothing
    told = alpha.max(axis=1) > 2 / p
    return 1 - np.prod(1 - alpha[told], axis=0) if told.any() else np.zeros(p)


def fine_mapped(df: DataFrame, key: str, n: int, shrink: float = 0.1, effects: int = 10) -> DataFrame:
    """(key, variant, pip) from rows (key, variant, z, dosages array); correlations shrunk towards the identity."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("variant")
        d = np.array(pdf["dosages"].tolist(), np.float64)
        d -= d.mean(axis=1, keepdims=True)
        length = np.linalg.norm(d, axis=1, keepdims=True)
        d = np.divide(d, length, out=np.zeros_like(d), where=length > 0)
        r = (1 - shrink) * (d @ d.T) + shrink * np.eye(len(d))
        return pd.DataFrame({key: pdf[key].to_numpy(), "variant": pdf["variant"].to_numpy(), "pip": single_effects(pdf["z"].to_numpy(np.float64), r, n, effects)})

    return df.select(key, "variant", "z", "dosages").groupBy(key).applyInPandas(run, f"{key} {df.schema[key].dataType.simpleString()}, variant long, pip double")


# ---- score regression -------------------------------------------------------------------------


def score_regression(sums: Iterable[tuple], m: float, n: float) -> tuple[float, float, float, float]:
    """(h2, its error, intercept, its error) from blocks (n, sx, sy, sxx, sxy) of chi-square on LD score; jackknife errors."""
    b = np.array([list(x) for x in sums], np.float64)
    whole = b.sum(axis=0)

    def fit(s: np.ndarray) -> np.ndarray:
        den = s[0] * s[3] - s[1] * s[1]
        slope = (s[0] * s[4] - s[1] * s[2]) / den if den else 0.0
        return np.array([slope * m / n, (s[2] - slope * s[1]) / s[0]])

    full = fit(whole)
    k = len(b)
    if k < 2:
        return float(full[0]), float("nan"), float(full[1]), float("nan")
    pseudo = np.array([k * full - (k - 1) * fit(whole - x) for x in b])
    mean, error = pseudo.mean(axis=0), pseudo.std(axis=0, ddof=1) / np.sqrt(k)
    return float(mean[0]), float(error[0]), float(mean[1]), float(error[1])


# ---- special functions ------------------------------------------------------------------------


def incomplete_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Regularised incomplete beta by its continued fraction (Lentz)."""
    from math import lgamma

    a, b, x = np.broadcast_arrays(*(np.asarray(v, np.float64) for v in (a, b, x)))
    flip = x > (a + 1) / (a + b + 2)
    p, q, y = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
    tiny = 1e-300
    c, d = np.ones_like(y), 1 - (p + q) * y / (p + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for k in range(1, rounds):
        for t in (k * (q - k) * y / ((p + 2 * k - 1) * (p + 2 * k)), -(p + k) * (p + q + k) * y / ((p + 2 * k) * (p + 2 * k + 1))):
            d = 1 + t * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + t / np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
    log = np.vectorize(lambda u, v: lgamma(u + v) - lgamma(u) - lgamma(v), otypes=[float])(p, q)
    with np.errstate(divide="ignore"):
        front = np.exp(log + p * np.log(y) + q * np.log1p(-y)) / p
    value = np.where(y <= 0, 0.0, front * h)
    return np.where(flip, 1 - value, value)


@pandas_udf(DoubleType())
def f_upper(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    """Upper tail of the F distribution; 0 at infinity, null where f is null."""
    finite = f.replace(np.inf, np.nan)
    x = d2 / (d2 + d1 * finite.fillna(0))
    out = pd.Series(incomplete_beta(d2 / 2, d1 / 2, x), index=f.index)
    return out.where(~np.isinf(f), 0.0).where(f.notna())


# ---- rankings ---------------------------------------------------------------------------------


def linear_scores(df: DataFrame, keys: list[str], model: list[tuple[str, float, float, float]], intercept: float = 0.0) -> Column:
    """Sum of coefficient * (feature - mean) / sd; missing features count as their mean.  model: (name, mean, sd, coefficient)."""
    out = F.lit(intercept)
    for name, mean, sd, weight in model:
        out = out + F.coalesce((F.col(name) - mean) / sd, F.lit(0.0)) * weight
    return out


def reasons(df: DataFrame, key: str, row: str, model: list[tuple[str, float, float, float]], top: int = 3) -> DataFrame:
    """The top features by which a row's score exceeds its group's mean: (key, row, feature, gain, rank)."""
    w = Window.partitionBy(key)
    terms = [F.coalesce((F.col(n) - m) / s, F.lit(0.0)) * c for n, m, s, c in model]
    wide = df.select(key, row, *((t - F.avg(t).over(w)).alias(n) for (n, *_), t in zip(model, terms)))
    gains = wide.unpivot([key, row], [n for n, *_ in model], "feature", "gain").where(F.round("gain", 9) > 0)
    rank = F.row_number().over(Window.partitionBy(key, row).orderBy(F.desc(F.round("gain", 9)), "feature")).cast("long")
    return gains.withColumn("rank", rank).where(F.col("rank") <= top)


# ---- clustering of datasets -------------------------------------------------------------------


def average_linkage(distance: np.ndarray) -> list[tuple[int, int, float]]:
    """Merges (cluster, cluster, height) by average linkage; ties by the smaller numbers."""
    n = len(distance)
    groups = {k: [k] for k in range(n)}
    merges = []
    while len(groups) > 1:
        h, a, b = min((float(distance[np.ix_(groups[a], groups[b])].mean()), a, b) for a in groups for b in groups if a < b)
        merges.append((a, b, h))
        groups[n + len(merges) - 1] = groups.pop(a) + groups.pop(b)
    return merges


def cut(merges: list[tuple[int, int, float]], n: int, k: int) -> np.ndarray:
    """Labels of the k clusters that are left before the last k - 1 merges."""
    groups = {i: [i] for i in range(n)}
    for at, (a, b, _) in enumerate(merges[: n - k]):
        groups[n + at] = groups.pop(a) + groups.pop(b)
    out = np.zeros(n, int)
    for label, rows in enumerate(sorted(groups.values(), key=min)):
        out[rows] = label
    return out


def silhouette(distance: np.ndarray, labels: np.ndarray) -> float:
    """Mean silhouette; rows alone in their cluster count 0."""
    out = []
    for i, mine in enumerate(labels):
        same = np.flatnonzero((labels == mine) & (np.arange(len(labels)) != i))
        if not len(same):
            out.append(0.0)
            continue
        a = distance[i, same].mean()
        b = min(distance[i, labels == g].mean() for g in set(labels.tolist()) if g != mine)
        out.append((b - a) / max(a, b) if max(a, b) else 0.0)
    return float(np.mean(out))


def best_cut(distance: np.ndarray, most: int | None = None) -> tuple[np.ndarray, float] | None:
    """Labels and mean silhouette of the number of clusters with the best one, the fewest at ties; nothing below three rows.

    most: the largest number tried, by default half the rows.  Silhouettes no more than 1e-9 apart are ties.
    """
    n = len(distance)
    if n < 3:
        return None
    merges = average_linkage(distance)
    cuts = [cut(merges, n, k) for k in range(2, min(most or max(2, n // 2), n - 1) + 1)]
    scores = [silhouette(distance, c) for c in cuts]
    at = next(k for k, x in enumerate(scores) if x >= max(scores) - 1e-9)
    return cuts[at], scores[at]


def adjusted_rand(a: np.ndarray, b: np.ndarray) -> float:
    table = pd.crosstab(np.asarray(a), np.asarray(b)).to_numpy().astype(float)
    pairs = lambda x: (x * (x - 1) / 2).sum()
    cells, rows, cols, n = pairs(table), pairs(table.sum(axis=1)), pairs(table.sum(axis=0)), len(a)
    expected = rows * cols / (n * (n - 1) / 2)
    most = (rows + cols) / 2
    return 1.0 if most == expected else float((cells - expected) / (most - expected))


def permanova(distance: np.ndarray, labels: np.ndarray, permutations: int = 999, seed: int = 1) -> tuple[float, float, float]:
    """(F, share of variance, p) of groups in a distance matrix."""
    labels = np.unique(labels, return_inverse=True)[1]
    n, k = len(labels), labels.max() + 1
    sq = distance**2
    total = sq[np.triu_indices(n, 1)].sum() / n

    def f(x: np.ndarray) -> tuple[float, float]:
        within = sum(sq[np.ix_(g, g)][np.triu_indices(len(g), 1)].sum() / len(g) for g in (np.flatnonzero(x == c) for c in range(k)))
        return ((total - within) / (k - 1)) / (within / (n - k)) if within > 0 else float("inf"), 1 - within / total

    found, share = f(labels)
    rng = np.random.default_rng(seed)
    as_far = sum(f(rng.permutation(labels))[0] >= found - 1e-12 for _ in range(permutations))
    return float(found), float(share), (1 + as_far) / (1 + permutations)


# ---- edits of loci ----------------------------------------------------------------------------


def renumbered(loci: DataFrame) -> DataFrame:
    return loci.drop("locus").withColumn("locus", F.row_number().over(Window.orderBy("chr", "start", "end")).cast("long"))


def merged(loci: DataFrame, wanted: list[int]) -> DataFrame:
    """The wanted loci of one chromosome become one; all are numbered again."""
    one = loci.where(F.col("locus").isin(wanted)).groupBy("chr").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return renumbered(loci.where(~F.col("locus").isin(wanted)).select("chr", "start", "end").unionByName(one))


def split(loci: DataFrame, locus: int, left_end: int, right_start: int, gap: int = 250_000) -> DataFrame:
    """A locus becomes two, at least gap apart and inside its bounds."""
    if right_start - left_end < gap:
        raise ValueError(f"the parts must be {gap} apart")
    hit = F.col("locus") == locus
    halves = F.when(hit & (F.col("start") <= left_end) & (F.col("end") >= right_start), F.array(F.struct("start", F.lit(left_end).cast("long").alias("end")), F.struct(F.lit(right_start).cast("long").alias("start"), "end"))).otherwise(F.array(F.struct("start", "end")))
    return renumbered(loci.select("locus", "chr", F.explode(halves).alias("h")).select("locus", "chr", "h.start", "h.end"))


def resized(loci: DataFrame, locus: int, start: int, end: int) -> DataFrame:
    if start > end:
        raise ValueError("start is after end")
    hit = F.col("locus") == locus
    return renumbered(loci.withColumn("start", F.when(hit, start).otherwise(F.col("start")).cast("long")).withColumn("end", F.when(hit, end).otherwise(F.col("end")).cast("long")))


def deleted(loci: DataFrame, locus: int) -> DataFrame:
    return renumbered(loci.where(F.col("locus") != locus))


def created(loci: DataFrame, chr: int, start: int, end: int) -> DataFrame:
    """One more locus; an end before the start is an error."""
    if start > end:
        raise ValueError("start is after end")
    one = loci.sparkSession.createDataFrame([(chr, start, end)], "chr int, start long, end long")
    return renumbered(loci.select("chr", "start", "end").unionByName(one))


def extended(loci: DataFrame, locus: int, before: int, after: int) -> DataFrame:
    """A locus longer by so many bases on either side, not below the first base."""
    hit = F.col("locus") == locus
    first = F.when(hit, F.greatest(F.lit(1), F.col("start") - before)).otherwise(F.col("start"))
    return renumbered(loci.select("locus", "chr", first.cast("long").alias("start"), F.when(hit, F.col("end") + after).otherwise(F.col("end")).cast("long").alias("end")))


#: How many versions can be gone back.
UNDO = 20


def undone(versions: list[DataFrame], steps: int = 1) -> DataFrame:
    """The loci as they were so many edits before the last; UNDO edits at most, else an error."""
    if not 0 <= steps <= min(UNDO, len(versions) - 1):
        raise ValueError(f"{steps} edits cannot be undone")
    return versions[len(versions) - 1 - steps]


def split_checks(parts: DataFrame, key: str, gap: int = 250_000) -> DataFrame:
    """(key, parts, least_gap, overlaps, valid) of the proposed parts (key, start, end) of each locus: valid if none ends before it starts and all are gap apart."""
    before = F.lag("end").over(Window.partitionBy(key).orderBy("start", "end"))
    w = parts.withColumn("_gap", F.col("start") - before).withColumn("_over", F.col("start") < before)
    ok = F.bool_and(F.col("start") <= F.col("end")) & F.coalesce(F.min("_gap") >= gap, F.lit(True))
    return w.groupBy(key).agg(F.count("*").alias("parts"), F.min("_gap").alias("least_gap"), F.coalesce(F.bool_or("_over"), F.lit(False)).alias("overlaps"), ok.alias("valid"))


def split_linkage(parts: DataFrame, panel: DataFrame, key: str, least_r2: float = 0.2, most: int = 10) -> DataFrame:
    """(key, part_a, part_b, pos_a, pos_b, r2): pairs of variants in different parts of a locus that are linked above least_r2.

    parts: key, chr, start, end, numbered from 0 by start within their key.  panel: chr, pos, dosages.  Of each part
    most variants are taken, drawn by a hash of their place, so that a locus of a few parts has a few hundred
    pairs at most; a variant that does not vary is linked with none, one inside two parts not with itself.
    """
    number = F.row_number().over(Window.partitionBy(key).orderBy("start", "end")) - 1
    named = parts.withColumn("_part", number).select(key, "_part", "chr", "start", "end")
    inside = points_in(panel.select("chr", "pos", "dosages"), named).select(key, "_part", "chr", "pos", "dosages")
    drawn = F.row_number().over(Window.partitionBy(key, "_part").orderBy(F.md5(F.concat_ws(":", F.col("chr").cast("string"), F.col("pos").cast("string"))), "pos"))
    taken = centred(inside.withColumn("_k", drawn).where(F.col("_k") <= most), "dosages").where(F.col("dosages").isNotNull())
    side = lambda s: taken.select(key, F.col("_part").cast("int").alias(f"part_{s}"), F.col("pos").alias(f"pos_{s}"), F.col("dosages").alias(f"_{s}"))
    r = F.aggregate(F.zip_with("_a", "_b", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    pairs = side("a").join(side("b"), key).where((F.col("part_a") < F.col("part_b")) & (F.col("pos_a") != F.col("pos_b"))).withColumn("r2", r * r)
    return pairs.where(F.round("r2", 9) > least_r2).select(key, "part_a", "part_b", "pos_a", "pos_b", "r2")


def split_verdicts(parts: DataFrame, panel: DataFrame, key: str, gap: int = 250_000, least_r2: float = 0.2, most: int = 10) -> DataFrame:
    """split_checks() with n_linked, the linked pairs across parts, and top_r2; a split with any is not valid."""
    linked = split_linkage(parts, panel, key, least_r2, most).groupBy(key).agg(F.count("*").alias("n_linked"), F.max("r2").alias("top_r2"))
    both = split_checks(parts, key, gap).join(linked, key, "left").withColumn("n_linked", F.coalesce("n_linked", F.lit(0)).cast("long"))
    return both.withColumn("valid", F.col("valid") & (F.col("n_linked") == 0))


def allele_frequencies(panel: DataFrame, dosages: str = "dosages") -> DataFrame:
    """panel with freq of the first allele, the sum of known dosages over twice their number, maf and n_known; null where none is known."""
    known = F.filter(dosages, lambda x: x.isNotNull())
    total = bound(known, lambda k: F.struct(F.aggregate(k, F.lit(0.0), lambda a, x: a + x).alias("s"), F.size(k).alias("n")))
    out = panel.withColumn("_t", total)
    freq = F.when(F.col("_t.n") > 0, F.col("_t.s") / (2 * F.col("_t.n")))
    return out.withColumn("freq", freq).withColumn("maf", F.least(F.col("freq"), F.lit(1.0) - F.col("freq"))).withColumn("n_known", F.coalesce("_t.n", F.lit(0))).drop("_t")
