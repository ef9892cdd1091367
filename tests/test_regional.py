"""Liftover, null sets, regional programs and genotype readers against brute force and known values."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lociform.operators import liftover, permutation, programs, regional
from lociform.sources import genotypes


def test_lifted_points_and_regions(spark, tmp_path):
    path = tmp_path / "a.chain"
    path.write_text("chain 900 chr1 1000 + 100 300 chr9 2000 + 500 690 1\n50 10 0\n140\n\nchain 800 chr2 1000 + 0 100 chr8 1000 - 0 100 2\n100\n\n")
    blocks = liftover.read_chains(spark, str(path))
    got = sorted((r.chr, r.start, r.end, r.chr_to, r.start_to, r.strand_to) for r in blocks.collect())
    assert got == [("chr1", 101, 150, "chr9", 501, "+"), ("chr1", 161, 300, "chr9", 551, "+"), ("chr2", 1, 100, "chr8", 1, "-")]
    points = spark.createDataFrame([(1, "chr1", 101), (2, "chr1", 155), (3, "chr1", 161), (4, "chr2", 1), (5, "chr7", 1)], "k int, chr string, pos long")
    at = {r.k: (r.chr_to, r.pos_to, r.state) for r in liftover.lift_points(points, blocks, "k").collect()}
    assert at == {1: ("chr9", 501, "mapped"), 2: (None, None, "unmapped"), 3: ("chr9", 551, "mapped"), 4: ("chr8", 1000, "mapped"), 5: (None, None, "unmapped")}
    regions = spark.createDataFrame([(1, "chr1", 101, 300), (2, "chr1", 140, 170), (3, "chr2", 11, 20)], "k int, chr string, start long, end long")
    to = {r.k: (r.start_to, r.end_to, round(r.cover, 4)) for r in liftover.lift_regions(regions, blocks, "k").collect()}
    assert to == {1: (501, 690, 0.95), 2: (None, None, round(21 / 31, 4)), 3: (981, 990, 1.0)}
    assert liftover.lift_points(points.limit(0), blocks, "k").count() == 0


def test_matched_null_against_loop(spark):
    starts = [("1", 1000 * k * k + 5) for k in range(1, 30)] + [("2", 3000 * k) for k in range(1, 9)]
    elements = [("1", 2000 * k, 2000 * k + 300) for k in range(1, 200)] + [("2", 500, 20_000)]
    points = [(k, "1" if k % 3 else "2", 777 * k + 13) for k in range(1, 25)]
    limits, sets = {"inside": 0, "near": 400}, 20
    out = permutation.matched_null(
        spark.createDataFrame(points, "id long, chr string, pos long"), "id", spark.createDataFrame(starts, "chr string, pos long"), spark.createDataFrame(elements, "chr string, start long, end long"),
        limits, sets, lambda k, s, n: (k * 31 + s * 17) % n,
    ).collect()
    order = sorted(starts)
    hit = lambda c, p, reach: any(e[0] == c and e[1] - reach <= p <= e[2] + reach for e in elements)
    for r in out:
        reach = limits[r["limit"]]
        counts = []
        for s in range(1, sets + 1):
            n = 0
            for i, c, p in points:
                off = min((abs(p - t), t, p - t) for d, t in starts if d == c)[2]
                chrom, at = order[(i * 31 + s * 17) % len(order)]
                n += hit(chrom, at + off, reach)
            counts.append(n)
        seen = sum(hit(c, p, reach) for _, c, p in points)
        assert (r.observed, r.expected, r.p) == (seen, pytest.approx(sum(counts) / sets), pytest.approx((1 + sum(c >= seen for c in counts)) / (1 + sets)))
    assert len(out) == 2


def linked(rng, people, variants):
    base = rng.normal(size=(people, variants))
    for k in range(1, variants):
        base[:, k] = 0.7 * base[:, k - 1] + math.sqrt(1 - 0.49) * base[:, k]
    return base


def test_stepwise_finds_the_effects():
    rng = np.random.default_rng(3)
    g = linked(rng, 4000, 30)
    y = 0.25 * g[:, 5] + 0.2 * g[:, 20] + rng.normal(size=4000)
    r = np.corrcoef(g.T)
    b = np.array([np.corrcoef(g[:, k], y)[0, 1] for k in range(30)])
    z = b * np.sqrt(4000) / np.sqrt(1 - b * b)
    chosen = regional.stepwise(z, r, 4000)
    assert sorted(chosen) == [5, 20]
    stat, _ = regional.conditional(b, r, [5, 20], 4000)
    assert np.delete(stat, [5, 20]).max() < regional.GENOME_WIDE_CHI2
    # given the others, a variant's statistic is that of its coefficient in the joint regression
    x = np.column_stack([g[:, 5], g[:, 20]])
    x, w = x - x.mean(axis=0), y - y.mean()
    coefficient = np.linalg.solve(x.T @ x, x.T @ w)
    error = np.sqrt(((w - x @ coefficient) ** 2).sum() / 3997 * np.linalg.inv(x.T @ x)[1, 1])
    assert regional.conditional(b, r, [5], 4000)[0][20] == pytest.approx((coefficient[1] / error) ** 2, rel=0.1)
    assert regional.stepwise(np.zeros(4), np.eye(4), 100) == []


def test_local_heritability_is_recovered():
    rng = np.random.default_rng(5)
    r = np.corrcoef(linked(rng, 3000, 60).T)
    chol, estimates, n = np.linalg.cholesky(r + 1e-9 * np.eye(60)), [], 50_000
    effect = np.zeros(60)
    effect[[10, 40]] = 0.05
    truth = effect @ r @ effect
    for _ in range(40):
        estimates.append(regional.local_heritability(math.sqrt(n) * (r @ effect) + chol @ rng.normal(size=60), r, n, 60)[0])
    assert np.mean(estimates) == pytest.approx(truth, abs=4 * np.std(estimates) / math.sqrt(40) + 2e-4)
    z = math.sqrt(n) * (r @ effect)
    z[40] = -z[40]
    assert 40 in regional.misfits(z, r)


def test_regions_spread_and_empty(spark):
    rng = np.random.default_rng(1)
    rows = [(k, i, float(rng.normal() + 9 * (i == 3)), [float(x) for x in rng.normal(size=40)]) for k in range(3) for i in range(8)]
    df = spark.createDataFrame(rows, "locus int, variant long, z double, dosages array<double>").withColumn("spare", F.lit(1))
    assert {(r.locus, r.variant) for r in regional.independent_signals(df, "locus", 5000).collect()} >= {(k, 3) for k in range(3)}
    assert regional.heritability_by_region(df, "locus", 1000.0).count() == 0
    assert regional.heritability_by_region(df, "locus", 1000.0, least=5).count() == 3


def test_disequilibrium(spark):
    df = spark.createDataFrame([([0, 1, 2, 1, 0, 2], [0, 1, 2, 1, 0, 2]), ([0, 0, 2, 2], [2, 2, 0, 0]), ([1, 1], [0, 2])], "a array<int>, b array<int>")
    r, r2, d = regional.disequilibrium(df, "a", "b")
    rows = [tuple(x) for x in df.select(r, r2, d).collect()]
    assert rows[0] == pytest.approx((1, 1, 1 if 2 / 3 / 2 >= 0.25 else rows[0][2]))
    assert rows[1] == pytest.approx((-1, 1, 1))
    assert rows[2] == (None, None, None)


def test_shared_datasets(spark):
    rows = [(0, i) for i in range(100)] + [(1, i) for i in range(5, 60)] + [(2, i) for i in range(90, 100)] + [(3, i) for i in range(40)]
    df = spark.createDataFrame(rows, "ds int, item int")
    assert regional.shared_datasets(df, "ds", ["item"], [0, 1, 2, 3], 30) == [0, 1, 3]
    assert regional.shared_datasets(df, "ds", ["item"], [2, 0, 1], 1, 0.5) == [2, 0]


def test_centred_dosages(spark):
    rows = [(1, [1.0, 2.0, 4.0]), (2, [3.0, 3.0, 3.0]), (3, None)]
    got = {r.i: r.d for r in programs.centred(spark.createDataFrame(rows, "i int, d array<double>"), "d").collect()}
    want = np.array([1, 2, 4]) - 7 / 3
    assert got[1] == pytest.approx(list(want / np.linalg.norm(want)))
    assert not got[2] or all(x is None for x in got[2])
    assert not got[3]


def test_packed_genotypes(spark, tmp_path):
    rng = np.random.default_rng(2)
    people, variants = 13, 57
    code = rng.integers(0, 4, size=(variants, people)).astype(np.uint8)
    padded = np.zeros((variants, 16), np.uint8)
    padded[:, :people] = code
    quads = padded.reshape(variants, 4, 4)
    packed = quads[:, :, 0] | quads[:, :, 1] << 2 | quads[:, :, 2] << 4 | quads[:, :, 3] << 6
    path = tmp_path / "x.bed"
    path.write_bytes(genotypes.BED_HEAD + packed.astype(np.uint8).tobytes())
    want = {i: [genotypes.BED_CALLS[c] for c in row] for i, row in enumerate(code)}
    whole = genotypes.read_genotypes(spark, str(path), people)
    assert {r.variant: r.calls for r in whole.collect()} == want
    assert [r.variant for r in genotypes.read_genotypes(spark, str(path), people, 50, 99).orderBy("variant").collect()] == list(range(50, 57))
    means = {r.variant: r.calls for r in genotypes.filled(whole).collect()}
    for i, calls in want.items():
        known = [c for c in calls if c is not None]
        assert means[i] == pytest.approx([sum(known) / len(known) if c is None else c for c in calls])
    with pytest.raises(Exception, match="whole rows"):
        genotypes.read_genotypes(spark, str(path), 17 * 4).count()


def test_call_text_scores_and_links(spark, tmp_path):
    (tmp_path / "a.vcf").write_text("##x\n#CHROM\tPOS\tID\tREF\tALT\nchr1\t10\trs1\tA\tC,G\n2\tbad\trs2\tA\tC\n3\t7\t.\tT\tA\nshort\n")
    assert [tuple(r) for r in genotypes.read_variant_calls(spark, str(tmp_path / "a.vcf")).orderBy("pos").collect()] == [("3", 7, None, "T", ["A"]), ("1", 10, "rs1", "A", ["C", "G"])]
    (tmp_path / "l2.txt").write_text("CHR\tSNP\tBP\tL2\tMAF\n1\ta\t5\t2.5\t0.1\n1\tb\t5\t1.5\t0.2\n1\tc\tx\t1\t0.2\n")
    assert [tuple(r) for r in genotypes.read_scores(spark, str(tmp_path / "l2.txt")).collect()] == [("1", 5, 1.5, 0.2)]
    (tmp_path / "c.tsv").write_text("## v\n#Chrom\tPos\n1\t5\tA\tC\t0.5\t12.5\n")
    assert genotypes.read_deleteriousness(spark, str(tmp_path / "c.tsv")).first().phred == 12.5
    (tmp_path / "k.tsv").write_text("chr\tstart\tend\tclass\tgene\ttss\te2g\tabc\td38\tdtss38\tdlen38\n1\t100\t200\tgenic\tG\t500\t0.9\t0.1\t30\t-4\t2\n1\t1\t2\tgenic\tH\t5\t0.9\t0.1\t\t\t\n")
    links = genotypes.read_links(spark, str(tmp_path / "k.tsv"))
    a = links.where("gene = 'G'").first()
    assert (a.start_b, a.end_b, a.tss_b) == (130, 232, 526)
    back = genotypes.encoded_links(links).orderBy("start").collect()
    assert [(r.d38, r.dtss38, r.dlen38) for r in back] == [(None, None, None), (30, -4, 2)]


def test_linked_clumps(spark):
    base = [float(x) for x in np.random.default_rng(4).normal(size=50)]
    other = [float(x) for x in np.random.default_rng(9).normal(size=50)]
    rows = [(1, 10, 9.0, base), (1, 12, 4.0, base), (1, 13, 6.0, other), (1, 90, 5.0, base), (1, 14, 1.0, base), (2, 1, 4.0, base)]
    df = spark.createDataFrame(rows, "locus int, variant long, z double, dosages array<double>")
    assert sorted(map(tuple, regional.linked_clumps(df, "locus", 25).collect())) == [(1, 10, 10), (1, 12, 10), (1, 13, 13)]


def test_two_step_regression_recovers(spark):
    rng = np.random.default_rng(8)
    size, m, n = 100_000, 1e6, 1e5
    l2 = rng.gamma(2.0, 40.0, size) + 1
    rows = []
    for g, (h2, a) in enumerate([(0.25, 1.0), (0.05, 1.08)]):
        chi2 = (a + h2 * n / m * l2) * rng.normal(size=size) ** 2
        rows += [(g, k * 200 // size, float(x), float(y)) for k, (x, y) in enumerate(zip(l2, chi2))]
    df = spark.createDataFrame(rows, "g int, block int, l2 double, chi2 double")
    got = regional.two_step_regression(df, "g", "block", "l2", "chi2", m, n, ceiling=1e9)
    for (_, h2, se, a, ase, ratio, _), (want, intercept) in zip(got, [(0.25, 1.0), (0.05, 1.08)]):
        assert abs(h2 - want) < 4 * se and 0 < se < 0.05
        assert abs(a - intercept) < 4 * ase and 0 < ase < 0.1
        assert ratio == pytest.approx((a - 1) / (np.mean([r[3] for r in rows if r[0] == (want == 0.05)]) - 1), abs=0.02)
    assert regional.two_step_regression(df.limit(0), "g", "block", "l2", "chi2", m, n) == []


def test_liability():
    # half of both: the threshold is 0, where the density is 1 / sqrt(2 pi)
    assert regional.liability(0.2, 0.5, 0.5) == pytest.approx(0.2 * 0.25 * 2 * math.pi)


def haplotypes_by_hand(x, y):
    """The likeliest frequency by a fine grid over the likelihood of the genotypes."""
    n, pa, pb = 2 * len(x), x.sum() / 2 / len(x), y.sum() / 2 / len(y)
    both = (x == 1) & (y == 1)
    k = [np.where(both, 0, v).sum() for v in (x * y / 2, x * (2 - y) / 2, (2 - x) * y / 2, (2 - x) * (2 - y) / 2)]
    p = np.linspace(max(0, pa + pb - 1), min(pa, pb), 400_001)[1:-1]
    h = [p, pa - p, pb - p, 1 - pa - pb + p]
    log = sum(c * np.log(v) for c, v in zip(k, h)) + both.sum() * np.log(h[0] * h[3] + h[1] * h[2])
    assert n > 0
    return p[log.argmax()], pa, pb


def test_haplotypes_against_the_likelihood(spark):
    rng = np.random.default_rng(5)
    rows = []
    for k in range(40):
        first = rng.random((60, 2)) < rng.uniform(0.1, 0.9)
        second = np.where(rng.random((60, 2)) < rng.uniform(0, 1), first if k % 3 else ~first, rng.random((60, 2)) < rng.uniform(0.2, 0.8))
        rows.append((k, first.sum(axis=1).tolist(), second.sum(axis=1).tolist()))
    rows += [(100, [0, 1, 2, None, 1], [0, 1, 2, 1, 1]), (101, [1, 1, 1], [0, 1, 2]), (102, [2, 2], [1, 0]), (103, [], [])]
    df = spark.createDataFrame(rows, "k int, a array<int>, b array<int>")
    got = {r.k: r.h for r in df.select("k", regional.haplotype_disequilibrium("a", "b").alias("h")).collect()}
    for k, a, b in rows[:40]:
        p, pa, pb = haplotypes_by_hand(np.array(a), np.array(b))
        d = p - pa * pb
        limit = min(pa * (1 - pb), (1 - pa) * pb) if d >= 0 else min(pa * pb, (1 - pa) * (1 - pb))
        assert got[k].p == pytest.approx(p, abs=2e-3) and got[k].d_prime == pytest.approx(min(1.0, abs(d) / limit), abs=2e-2)
    assert got[100].d_prime == pytest.approx(1.0, abs=1e-6) and got[102] is None and got[103] is None


def test_haplotypes_of_a_stretch(spark):
    """All pairs of a stretch in batches: those of the expression over rows of pairs."""
    rng = np.random.default_rng(11)
    g = rng.integers(0, 3, (30, 12)).tolist() + [[1] * 12, [2] * 12, [0] * 11 + [1]]
    df = spark.createDataFrame([(k % 2, 10 * k, x) for k, x in enumerate(g)], "stretch int, pos long, dosages array<int>")
    pairs = df.withColumnRenamed("pos", "pos_a").join(df.select("stretch", F.col("pos").alias("pos_b"), F.col("dosages").alias("other")), "stretch").where("pos_a < pos_b")
    want = pairs.select("pos_a", "pos_b", regional.haplotype_disequilibrium("dosages", "other").alias("h")).where("h is not null")
    want = {(r.pos_a, r.pos_b): (r.h.p, r.h.d_prime) for r in want.collect()}
    got = {(r.pos_a, r.pos_b): (r.p, r.d_prime) for r in regional.haplotype_stretches(df, ["stretch"], rows=4).collect()}
    assert got.keys() == want.keys() and len(got) > 200
    assert all(got[k] == pytest.approx(want[k], abs=1e-6) for k in want)
