"""Operators over several studies against brute force on small tables."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lociform.functions import scalar as S
from lociform.operators import identifiers, loci, metaanalysis, programs, regional, stats

# ---- identifiers ------------------------------------------------------------------------------

KNOWN = "chr int, pos long, ref string, alts array<string>, rsid string, build int, line long"
ROWS = "id int, ds int, chr int, pos long, ea string, nea string"


def by_hand(row, known):
    """(rsid, reason, candidate, number of records) of a row."""
    _, _, chr, pos, ea, nea = row
    at = [k for k in known if k[:2] == (chr, pos)]

    def newest(records):
        told = [k for k in records if k[5] is not None]
        return max(told, key=lambda k: (k[5], -k[6])) if told else max(records, key=lambda k: k[6])

    if not at:
        return None, "no_pos", None, 0
    up = lambda x: None if x is None else x.upper()
    forward = [k for k in at if ea and nea and k[2] == up(nea) and up(ea) in k[3]]
    reverse = [k for k in at if ea and nea and k[2] == up(ea) and up(nea) in k[3]]
    if forward:
        return newest(forward)[4], "matched_forward", None, len(at)
    if reverse:
        return newest(reverse)[4], "matched_reverse", None, len(at)
    return None, "pos_only_allele_mismatch", newest(at)[4], len(at)


def test_newest_build_of_matching_records(spark):
    rng = random.Random(5)
    known = [(rng.randint(1, 2), rng.randint(1, 6), *rng.choice([("A", ["C", "T"]), ("C", ["A"]), ("G", ["T"])]), f"rs{k}", rng.choice([None, None, 151, 152]), k) for k in range(60)]
    rows = [(k, 1, rng.randint(1, 2), rng.randint(1, 8), rng.choice(["A", "c", "T", None]), rng.choice(["a", "C", "G"])) for k in range(200)]
    got = {r.id: (r.rsid, r.reason, r.candidate, r.n_candidates) for r in identifiers.matched(spark.createDataFrame(rows, ROWS), spark.createDataFrame(known, KNOWN)).collect()}
    assert got == {r[0]: by_hand(r, known) for r in rows}
    assert {x[1] for x in got.values()} == {"no_pos", "matched_forward", "matched_reverse", "pos_only_allele_mismatch"}
    nothing = identifiers.matched(spark.createDataFrame(rows, ROWS), spark.createDataFrame([], KNOWN))
    assert {r.reason for r in nothing.collect()} == {"no_pos"}


def test_chain_of_recovery_and_its_cap(spark):
    known = spark.createDataFrame([(1, 10, "A", ["C"], "rs1", 150, 1)], KNOWN)
    rows = spark.createDataFrame([(1, 1, 1, 10, "C", "A"), (2, 1, 1, 20, "C", "A"), (3, 1, 1, 30, "C", "A"), (4, 2, 1, 20, "A", "C"), (5, 2, 1, 30, "C", "A"), (6, 2, 1, 40, "C", "A"), (7, 3, 1, 10, "A", "C")], ROWS)
    answers = spark.createDataFrame([("1:20:A:C", "rs2"), ("1:40:A:C", None)], "key string, rsid string")
    others = spark.createDataFrame([(8, 1, 20, "C", "A", "rs28"), (9, 1, 20, "C", "A", "rs29"), (9, 1, 30, "A", "C", "rs39"), (9, 1, 30, "A", "C", "rs38")], "ds int, chr int, pos long, ea string, nea string, rsid string")
    got = {r.id: (r.rsid, r.step, r.asked, r.from_dataset) for r in identifiers.recovered(rows, known, answers, others, most=3).collect()}
    assert got == {
        1: ("rs1", "local", False, None), 2: ("rs2", "service", True, None), 3: ("rs38", "other file", True, 9),
        4: ("rs28", "other file", False, 8), 5: ("rs38", "other file", False, 9), 6: (None, "missing", False, None), 7: ("rs1", "local", False, None),
    }


# ---- meta-analysis ----------------------------------------------------------------------------

COHORT = "v string, ds int, ea string, nea string, beta double, se double"


def test_fixed_and_random_effects(spark):
    rng = np.random.default_rng(3)
    rows, kept = [], {}
    for v in ("a", "b", "c", "d"):
        for ds in range(1, 5):
            if (v, ds) in (("b", 1), ("c", 3)):
                continue
            beta, se = float(rng.normal(0, 0.3)), float(rng.uniform(0.05, 0.2))
            turned = ds == 2
            rows.append((v, ds, "g" if turned else "A", "A" if turned else "G", -beta if turned else beta, se))
            kept.setdefault(v, {})[ds] = (beta, se)
    # the first cohort of b is turned itself, so its effects are told for the other allele
    kept["b"] = {ds: (-b, s) for ds, (b, s) in kept["b"].items()}
    rows += [("a", 9, "A", "C", 1.0, 0.1), ("a", 5, "A", "G", None, 0.1), ("a", 6, "A", "G", 1.0, 0.0), ("a", 7, "A", "G", float("nan"), 0.1), ("e", 1, "A", "G", 0.0, 0.1)]
    got = {r.v: r for r in metaanalysis.combined(spark.createDataFrame(rows, COHORT), ["v"], "ds", [1, 2, 3, 4]).collect()}
    assert set(got) == {"a", "b", "c", "d", "e"} and (got["b"].ea, got["a"].ea) == ("G", "A")
    for v, own in kept.items():
        b, w = np.array([x[0] for x in own.values()]), np.array([1 / x[1] ** 2 for x in own.values()])
        mean = (w * b).sum() / w.sum()
        q = (w * (b - mean) ** 2).sum()
        over = max(0.0, q - (len(b) - 1))
        tau2 = over / (w.sum() - (w**2).sum() / w.sum())
        w2 = 1 / (1 / w + tau2)
        r = got[v]
        assert (r.n, r.beta, r.se, r.q) == (len(b), pytest.approx(mean), pytest.approx(w.sum() ** -0.5), pytest.approx(q))
        assert (r.i2, r.tau2, r.beta_random, r.se_random) == (pytest.approx(over / q), pytest.approx(tau2), pytest.approx((w2 * b).sum() / w2.sum()), pytest.approx(w2.sum() ** -0.5))
        assert r.p == pytest.approx(math.erfc(abs(r.beta / r.se) / math.sqrt(2)), rel=1e-5)
        assert r.direction == "".join("?" if ds not in own else "+" if own[ds][0] > 0 else "-" for ds in range(1, 5))
    assert (got["e"].beta, got["e"].q, got["e"].i2, got["e"].tau2, got["e"].direction) == (0.0, 0.0, 0.0, 0.0, "0???")
    assert metaanalysis.combined(spark.createDataFrame([], COHORT), ["v"], "ds", [1]).count() == 0


def test_genomic_control_widens_inflated_cohorts_only(spark):
    rng = np.random.default_rng(4)
    rows = [(f"v{k}", ds, "A", "G", float(rng.normal(0, 0.1 * scale)), 0.1) for ds, scale in ((1, 2.0), (2, 0.5)) for k in range(401)]
    got = metaanalysis.genomic_control(spark.createDataFrame(rows, COHORT), "ds").toPandas()
    for ds in (1, 2):
        own = got[got.ds == ds]
        spread = np.median([(r[4] / r[5]) ** 2 for r in rows if r[1] == ds]) / S.MEDIAN_CHI2
        assert np.allclose(own.inflation, spread) and np.allclose(own.se, 0.1 * math.sqrt(max(1.0, spread)))
    assert np.median((got[got.ds == 1].beta / got[got.ds == 1].se) ** 2) == pytest.approx(S.MEDIAN_CHI2)


# ---- levels and the genome --------------------------------------------------------------------


def f_of(groups):
    n, k, every = sum(map(len, groups)), len(groups), np.concatenate(groups)
    if k < 2 or n <= k:
        return None
    between = sum(len(g) * (np.mean(g) - every.mean()) ** 2 for g in groups)
    return between / (k - 1) / (sum(((np.array(g) - np.mean(g)) ** 2).sum() for g in groups) / (n - k))


def test_nested_anova_against_numpy(spark):
    rng = np.random.default_rng(6)
    rows = [(k % 3, ["x", "y", "z"][k % 5 % 3], int(rng.integers(0, 3)), float(rng.normal()), None if k % 11 == 0 else float(rng.normal())) for k in range(180)]
    rows += [(0, None, 1, 5.0, 5.0), (9, "x", 1, 1.0, float("nan"))]
    df = spark.createDataFrame(rows, "gene int, disease string, ds int, a double, b double")
    got = {(r.gene, r.scale, r.disease): (r.n_groups, r.n, r.f) for r in stats.nested_anova(df, ["gene"], "disease", "ds", {"a": F.col("a"), "b": F.col("b")}).collect()}
    for gene in range(3):
        for at, scale in ((3, "a"), (4, "b")):
            own = [r for r in rows if r[0] == gene and r[1] is not None and r[at] is not None]
            groups = [[r[at] for r in own if r[1] == x] for x in "xyz"]
            assert got[gene, scale, None] == (3, len(own), pytest.approx(f_of(groups)))
            for x in "xyz":
                inside = [g for g in ([r[at] for r in own if r[1] == x and r[2] == ds] for ds in range(3)) if g]
                assert got[gene, scale, x] == (len(inside), sum(map(len, inside)), pytest.approx(f_of(inside)))
    assert got[9, "a", None] == (1, 1, None) and (9, "b", None) not in got


def test_cohesion_counts_absent_pairs_as_far(spark):
    rng = np.random.default_rng(7)
    level = {k: ["p", "q", "r"][k % 3] if k < 7 else None for k in range(8)} | {20: "alone"}
    near = {(a, b): float(rng.uniform(0, 1)) for a in range(8) for b in range(a + 1, 8) if rng.uniform() < 0.6}
    got = {r.level: r for r in stats.level_cohesion(spark.createDataFrame([(a, b, x) for (a, b), x in near.items()], "a int, b int, distance double"), spark.createDataFrame(list(level.items()), "item int, level string")).collect()}
    named = [k for k in level if level[k]]
    pairs = [(a, b) for i, a in enumerate(named) for b in named[i + 1 :]]
    for x in ("p", "q", "r", "alone"):
        inside = [near.get(k, 1.0) for k in pairs if level[k[0]] == level[k[1]] == x]
        outside = [near.get(k, 1.0) for k in pairs if (level[k[0]] == x) != (level[k[1]] == x)]
        assert got[x].cohesion == (pytest.approx(1 - np.mean(inside)) if inside else None)
        assert got[x].separation == pytest.approx(np.mean(outside)) and got[x].n == sum(v == x for v in level.values())


def test_skyline_bins_a_table_of_lengths(spark):
    rows = [("1", 5, 1.0), ("chr1", 7, 3.0), ("2", 1, 2.0), ("X", 50, 9.0), ("Y", 1, 99.0), ("2", 3, None), ("1", 31, 0.0), ("2", 9, float("nan"))]
    got = loci.skyline(spark.createDataFrame(rows, "chr string, pos long, s double"), "s", {"1": 40, "2": 41, "X": 20}, 10)
    # 101 places in ten bins: eleven places each, and what is beyond belongs to the last
    assert {r.bin: (r.top, r.n) for r in got.collect()} == {0: (3.0, 2), 3: (2.0, 1), 9: (9.0, 1)}
    assert sum(loci.LENGTHS.values()) == 3_031_042_417 and len(loci.LENGTHS) == 23


# ---- splits -----------------------------------------------------------------------------------


def test_linked_parts_against_numpy(spark):
    rng = np.random.default_rng(8)
    common = rng.normal(size=40)
    d = {pos: np.clip(np.round(1 + 0.6 * rng.normal(size=40) + (0.9 * common if pos % 30 == 0 else 0)), 0, 2) for pos in range(10, 400, 10)}
    d[50] = np.ones(40)
    panel = spark.createDataFrame([(1, pos, x.tolist()) for pos, x in d.items()], "chr int, pos long, dosages array<double>")
    spans = {7: [(5, 95), (105, 205), (215, 395)], 8: [(10, 20), (1000, 2000)], 9: [(10, 100), (90, 200)]}
    parts = spark.createDataFrame([(k, 1, a, b) for k, x in spans.items() for a, b in reversed(x)], "locus int, chr int, start long, end long")
    want = set()
    for k, x in spans.items():
        for i, (a, b) in enumerate(x):
            for j, (c, e) in enumerate(x[i + 1 :], i + 1):
                for p in d:
                    for q in d:
                        if a <= p <= b and c <= q <= e and p != q and 50 not in (p, q) and np.corrcoef(d[p], d[q])[0, 1] ** 2 > 0.2:
                            want.add((k, i, j, p, q))
    got = programs.split_linkage(parts, panel, "locus", most=100).collect()
    assert {(r.locus, r.part_a, r.part_b, r.pos_a, r.pos_b) for r in got} == want and any(k == 7 for k, *_ in want)
    assert all(r.r2 == pytest.approx(np.corrcoef(d[r.pos_a], d[r.pos_b])[0, 1] ** 2) for r in got)
    few = programs.split_linkage(parts, panel, "locus", most=3).collect()
    assert {tuple(r)[:5] for r in few} <= want and all(len({r.pos_a for r in few if (r.locus, r.part_a) == x}) <= 3 for x in {(r.locus, r.part_a) for r in few})
    told = {r.locus: r for r in programs.split_verdicts(parts, panel, "locus", gap=5, most=100).collect()}
    assert not told[7].valid and told[7].n_linked == sum(k == 7 for k, *_ in want) and not told[7].overlaps
    assert told[8].valid and told[8].n_linked == 0 and told[8].top_r2 is None
    assert not told[9].valid and told[9].overlaps


def test_allele_frequencies(spark):
    df = spark.createDataFrame([(1, [0.0, 1.0, 2.0, 2.0]), (2, [None, 1.0]), (3, [None]), (4, []), (5, None)], "k int, dosages array<double>")
    got = {r.k: (r.freq, r.maf, r.n_known) for r in programs.allele_frequencies(df).collect()}
    assert got == {1: (0.625, 0.375, 4), 2: (0.5, 0.5, 1), 3: (None, None, 0), 4: (None, None, 0), 5: (None, None, 0)}


# ---- labels and scales ------------------------------------------------------------------------


def test_chromosome_names_identifiers_and_liability(spark):
    names = [("chrX", "X", "X", "chrX"), (" CHRx ", "X", "x", "chrCHRx"), ("cHr7", "CHR7", "7", "chrcHr7"), ("mt", "MT", "mt", "chrmt"), ("chr", "CHR", None, "chr"), (None, None, None, None)]
    df = spark.createDataFrame([(x[0],) for x in names], "c string")
    c = F.col("c")
    assert [tuple(r) for r in df.select("c", S.normal_chr(c), S.bare_chr(c), S.prefixed_chr(c)).collect()] == names
    ids = spark.createDataFrame([("rs12", True), ("RS1", True), ("rs", False), ("xrs1", False), ("rs1a", False), (None, False)], "id string, want boolean")
    assert all(r.got == r.want for r in ids.select(S.is_rsid(F.col("id")).alias("got"), "want").collect())
    scale = spark.createDataFrame([(0.2, 0.01, 0.5), (0.1, 0.2, 0.1), (0.1, 0.0, 0.5), (0.1, 0.5, 1.0)], "h double, k double, p double")
    got = [r.x for r in scale.select(S.liability_scale(F.col("h"), F.col("k"), F.col("p")).alias("x")).collect()]
    assert got == [pytest.approx(regional.liability(0.2, 0.01, 0.5)), pytest.approx(regional.liability(0.1, 0.2, 0.1)), None, None]
