"""Programs over loci: closed forms, simulations and small brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lociform.operators import loci, programs


def test_incomplete_beta_closed_forms():
    assert programs.incomplete_beta(1.0, 1.0, 0.3) == pytest.approx(0.3)
    assert programs.incomplete_beta(2.0, 1.0, 0.3) == pytest.approx(0.09)
    assert programs.incomplete_beta(1.0, 3.0, 0.3) == pytest.approx(1 - 0.7**3)
    assert programs.incomplete_beta(5.0, 5.0, 0.5) == pytest.approx(0.5)


def test_f_tail(spark):
    df = spark.createDataFrame([(27.0, 2.0, 6.0), (float("inf"), 2.0, 6.0), (0.0, 2.0, 6.0), (None, 2.0, 6.0)], "f double, a double, b double")
    got = [r.p for r in df.select(programs.f_upper("f", "a", "b").alias("p")).collect()]
    assert got == [pytest.approx(0.001), 0.0, pytest.approx(1.0), None]


def test_linkage_against_numpy(spark):
    d = np.random.default_rng(0).normal(size=(12, 20))
    d[5] = 1.0
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(d)], "i long, d array<double>")
    got = {(r.i, r.j): r.r for r in programs.linkage(df, "i", "d", 4).collect()}
    assert set(got) == {(i, j) for i in range(12) for j in range(i + 1, min(12, i + 5))}
    for (i, j), r in got.items():
        assert r is None if 5 in (i, j) else r == pytest.approx(np.corrcoef(d[i], d[j])[0, 1])


def test_single_effects_find_the_causal_variants():
    rng = np.random.default_rng(1)
    n, p = 2000, 30
    x = rng.normal(size=(n, p))
    x[:, 1:] += 0.6 * x[:, :-1]
    x = (x - x.mean(axis=0)) / x.std(axis=0)
    y = 0.3 * x[:, 4] - 0.3 * x[:, 20] + rng.normal(size=n)
    z = x.T @ y / np.sqrt(n) / y.std()
    pip = programs.single_effects(z, np.corrcoef(x.T), n)
    assert set(np.argsort(-pip)[:2]) == {4, 20} and pip[[4, 20]].min() > 0.9
    assert programs.single_effects(np.zeros(p), np.eye(p), n).max() == 0


def test_score_regression_recovers_slope():
    rng = np.random.default_rng(2)
    m, n, h2 = 1e6, 1e5, 0.25
    x = rng.gamma(2, 50, 100_000)
    chi2 = (1.05 + n * h2 * x / m) * rng.normal(size=len(x)) ** 2
    blocks = [(len(a), a.sum(), b.sum(), (a * a).sum(), (a * b).sum()) for a, b in zip(np.array_split(x, 200), np.array_split(chi2, 200))]
    got, error, intercept, intercept_error = programs.score_regression(blocks, m, n)
    assert abs(got - h2) < 4 * error and abs(intercept - 1.05) < 4 * intercept_error


def test_clustering_statistics():
    d = np.abs(np.subtract.outer([0.0, 1.0, 10.0, 11.5], [0.0, 1.0, 10.0, 11.5]))
    merges = programs.average_linkage(d)
    assert [m[2] for m in merges] == [1.0, 1.5, 10.25]
    labels = programs.cut(merges, 4, 2)
    assert labels.tolist() == [0, 0, 1, 1]
    assert programs.silhouette(d, labels) > 0.8 and programs.silhouette(d, np.array([0, 1, 0, 1])) < 0
    assert programs.adjusted_rand(labels, np.array([5, 5, 2, 2])) == 1.0
    assert programs.adjusted_rand(np.array([0, 0, 1, 1]), np.array([0, 1, 0, 1])) == pytest.approx(-0.5)
    assert programs.adjusted_rand(np.array([0, 0, 0, 1, 1, 1]), np.array([0, 0, 1, 1, 2, 2])) == pytest.approx(0.8 / 3.3)
    f, share, p = programs.permanova(d, labels)
    assert f > 50 and share > 0.9 and 0 < p < 0.5


def frame(spark):
    return spark.createDataFrame([(1, 1, 100, 900_000), (2, 1, 2_000_000, 2_100_000), (3, 2, 5, 9)], "locus long, chr int, start long, end long")


def rows(df):
    return sorted((r.locus, r.chr, r.start, r.end) for r in df.collect())


def test_edits_of_loci(spark):
    assert rows(programs.merged(frame(spark), [1, 2])) == [(1, 1, 100, 2_100_000), (2, 2, 5, 9)]
    assert rows(programs.split(frame(spark), 1, 200_000, 600_000)) == [(1, 1, 100, 200_000), (2, 1, 600_000, 900_000), (3, 1, 2_000_000, 2_100_000), (4, 2, 5, 9)]
    assert rows(programs.resized(frame(spark), 3, 1, 20))[2] == (3, 2, 1, 20)
    assert rows(programs.deleted(frame(spark), 1)) == [(1, 1, 2_000_000, 2_100_000), (2, 2, 5, 9)]
    with pytest.raises(ValueError):
        programs.split(frame(spark), 1, 200_000, 300_000)


def test_scores_and_reasons(spark):
    df = spark.createDataFrame([("l", 1, 3.0, 1.0), ("l", 2, 1.0, None)], "l string, v int, a double, b double")
    model = [("a", 1.0, 2.0, 1.5), ("b", 0.0, 1.0, 0.5)]
    assert [r.s for r in df.select(programs.linear_scores(df, ["l"], model, 1.0).alias("s")).collect()] == [3.0, 1.0]
    got = [(r.v, r.feature, r.gain, r["rank"]) for r in programs.reasons(df, "l", "v", model).collect()]
    assert got == [(1, "a", 0.75, 1), (1, "b", 0.25, 2)]


def test_pruning_and_clumps(spark):
    pos = [(1, 1_000_000 + 100 * k) for k in range(100)] + [(1, 10_000_000), (2, 5_000_000), (3, 5_000_000)]
    assert loci.distance_pruned(spark.createDataFrame(pos, "chr int, pos long"), 250_000).count() == 4
    best = spark.createDataFrame([(1, 0, 6.0), (1, 200, 9.0), (1, 350, 7.0), (1, 500, 8.0), (2, 1, 6.0)], "chr int, pos long, z double")
    assert sorted((r.chr, r.pos, r.lead) for r in loci.clumped(best, 250).collect()) == [(1, 0, 200), (1, 200, 200), (1, 350, 200), (1, 500, 500), (2, 1, 1)]


def test_fine_mapping_by_locus(spark):
    rng = np.random.default_rng(3)
    d = rng.normal(size=(20, 50))
    df = spark.createDataFrame(pd.DataFrame({"locus": np.repeat([1, 2], 10), "variant": np.arange(20), "z": [8.0] + [0.1] * 19, "dosages": d.tolist()}))
    got = {r.variant: r.pip for r in programs.fine_mapped(df, "locus", 1000).select("variant", F.col("pip")).collect()}
    assert len(got) == 20 and got[0] > 0.95 and max(got[k] for k in range(10, 20)) == 0


def test_edits_and_split_checks(spark):
    base = spark.createDataFrame([(1, 1, 10, 20), (2, 1, 400_000, 500_000), (3, 2, 5, 9)], "locus long, chr int, start long, end long")
    rows = lambda df: sorted((r.locus, r.chr, r.start, r.end) for r in df.collect())
    longer = programs.extended(base, 3, 100, 1)
    assert rows(longer) == [(1, 1, 10, 20), (2, 1, 400_000, 500_000), (3, 2, 1, 10)]
    more = programs.created(longer, 1, 30, 40)
    assert rows(more) == [(1, 1, 10, 20), (2, 1, 30, 40), (3, 1, 400_000, 500_000), (4, 2, 1, 10)]
    assert rows(programs.undone([base, longer, more], 2)) == rows(base)
    for bad in (lambda: programs.undone([base, longer], 2), lambda: programs.undone([base] * 30, 21), lambda: programs.created(base, 1, 5, 4)):
        with pytest.raises(ValueError):
            bad()
    parts = spark.createDataFrame([(1, 0, 10), (1, 250_010, 250_020), (2, 0, 10), (2, 5, 9), (3, 0, 10), (3, 250_009, 250_010), (4, 7, 6), (5, 1, 2)], "k int, start long, end long")
    got = {r.k: (r.parts, r.least_gap, r.overlaps, r.valid) for r in programs.split_checks(parts, "k").collect()}
    assert got == {1: (2, 250_000, False, True), 2: (2, -5, True, False), 3: (2, 249_999, False, False), 4: (1, None, False, False), 5: (1, None, False, True)}


def test_best_cut():
    m = np.full((6, 6), 0.9)
    for g in (slice(0, 2), slice(2, 4), slice(4, 6)):
        m[g, g] = 0.1
    np.fill_diagonal(m, 0)
    labels, score = programs.best_cut(m)
    assert labels.tolist() == [0, 0, 1, 1, 2, 2] and score == pytest.approx((0.9 - 0.1) / 0.9)
    assert programs.best_cut(np.ones((4, 4)) - np.eye(4))[0].max() == 1  # ties: the fewest
    assert programs.best_cut(np.zeros((2, 2))) is None
