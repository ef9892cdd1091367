"""Fine-mapping: planted effects recovered, artifacts flagged, populations of different linkage."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lociform.operators import regional, signals


def genotypes(rng, people, variants, runs=8):
    """Dosages of blocks of linked variants: neighbours of a block share most of their haplotypes."""
    out = np.empty((variants, people), int)
    for k in range(variants):
        if k % runs == 0:
            base = rng.random((people, 2)) < rng.uniform(0.2, 0.5)
        flip = rng.random((people, 2)) < rng.uniform(0.02, 0.2)
        out[k] = (base ^ flip).sum(axis=1)
    return out


def correlated(g):
    return regional.correlations(pd.Series(list(g.astype(float))))


def scores(rng, g, effects, noise=1.0):
    """Marginal z of a trait with the given effects on standardised dosages."""
    x = (g - g.mean(axis=1, keepdims=True)) / g.std(axis=1, keepdims=True)
    y = sum(b * x[k] for k, b in effects.items()) + rng.normal(0, noise, g.shape[1])
    y = (y - y.mean()) / y.std()
    b = x @ y / len(y)
    return b * np.sqrt((len(y) - 2) / (1 - b * b))


def test_sets_cover_planted_effects():
    rng = np.random.default_rng(1)
    covered = sets = found = 0
    for _ in range(40):
        g = genotypes(rng, 2000, 80)
        r, causal = correlated(g), rng.choice(80, 2, replace=False)
        fit = signals.sum_of_effects(scores(rng, g, {int(c): 0.2 for c in causal})[:, None], [r], np.array([2000.0]))
        for _, members, purity in signals.credible_sets(fit, [r]):
            sets += 1
            covered += bool(set(members) & set(causal))
            assert purity >= 0.5
        found += sum(any(c in m for _, m, _ in signals.credible_sets(fit, [r])) for c in causal)
    assert covered >= 0.93 * sets and found >= 0.9 * 80


def test_no_effect_no_set():
    rng = np.random.default_rng(2)
    sets = 0
    for _ in range(30):
        g = genotypes(rng, 1000, 60)
        r = correlated(g)
        fit = signals.sum_of_effects(scores(rng, g, {})[:, None], [r], np.array([1000.0]))
        sets += len(signals.credible_sets(fit, [r]))
    assert sets <= 2


def test_shared_and_private_effects():
    """Three traits: one variant acts on all of them, another on the third only."""
    rng = np.random.default_rng(3)
    right = 0
    for _ in range(10):
        g = genotypes(rng, 2000, 60)
        r = correlated(g)
        z = np.column_stack([scores(rng, g, {10: 0.15}), scores(rng, g, {10: 0.15}), scores(rng, g, {10: 0.15, 45: 0.2})])
        fit = signals.sum_of_effects(z, [r] * 3, np.full(3, 2000.0))
        active = {}
        for e, members, _ in signals.credible_sets(fit, [r]):
            for c in (10, 45):
                if c in members:
                    active[c] = [t for t in range(3) if fit.lfsr[e][t] < 0.05]
        right += active == {10: [0, 1, 2], 45: [2]}
    assert right >= 8


def test_weak_effects_add_up_over_traits():
    rng = np.random.default_rng(4)
    g = genotypes(rng, 1500, 60)
    r = correlated(g)
    z = np.column_stack([scores(rng, g, {20: 0.1}) for _ in range(5)])
    joint = signals.sum_of_effects(z, [r] * 5, np.full(5, 1500.0))
    alone = [signals.sum_of_effects(z[:, [t]], [r], np.array([1500.0])) for t in range(5)]
    assert joint.alpha.max(axis=0)[20] > np.mean([a.alpha.max(axis=0)[20] for a in alone])


def test_two_populations_shrink_the_set():
    """In each population the causal variant has other close companions; together only it is left."""
    rng = np.random.default_rng(5)
    smaller = covered = 0
    for _ in range(12):
        panels = []
        for shift in (0, 3):
            g = genotypes(rng, 3000, 40)
            base = g[16].copy()
            for k in range(17 - shift, 20 - shift):  # companions: 17 to 19, and 14 to 16
                copy = base.copy()
                odd = rng.random(3000) < 0.04
                copy[odd] = g[0][odd]
                g[k] = copy
            g[16] = base
            panels.append(g)
        z = np.column_stack([scores(rng, g, {16: 0.13}) for g in panels])
        r = [correlated(g) for g in panels]
        priors = [np.eye(2), np.diag([1.0, 0.0]), np.diag([0.0, 1.0])]
        fit = signals.sum_of_effects(z, r, np.full(2, 3000.0), priors=priors)
        size = lambda sets: min((len(m) for _, m, _ in sets if 16 in m), default=40)
        both = signals.credible_sets(fit, r)
        own = [signals.credible_sets(signals.sum_of_effects(z[:, [t]], [r[t]], np.array([3000.0])), [r[t]]) for t in range(2)]
        covered += any(16 in m for _, m, _ in both)
        smaller += size(both) <= min(size(o) for o in own)
    assert covered >= 11 and smaller >= 10


def test_inconsistency_and_check():
    rng = np.random.default_rng(6)
    g = genotypes(rng, 3000, 80)
    r = correlated(g)
    z = scores(rng, g, {30: 0.25})
    wrong = z.copy()
    turned = [k for k in (26, 28, 31) if abs(z[k]) > 4]
    wrong[turned] *= -1
    assert signals.inconsistency(z, r) < 0.05 < signals.inconsistency(wrong, r)
    keep, s, used = signals.checked(wrong[:, None], r)
    assert not set(keep) & set(turned) and len(keep) >= 70
    assert used == pytest.approx(min(0.5, max(0.1, s)))


def test_joint_model_of_two_signals():
    rng = np.random.default_rng(7)
    g = genotypes(rng, 4000, 60)
    r = correlated(g)
    m = signals.joint_model(scores(rng, g, {5: 0.25, 40: 0.2}), r, 4000)
    assert all(any(abs(r[c, k]) > 0.6 for k in m["chosen"]) for c in (5, 40)) and len(m["chosen"]) == 2
    assert m["verdict"] == "ok" and m["explained"] and not m["again"]
    x = g[m["chosen"]].T - g[m["chosen"]].mean(axis=1)
    assert m["least"] > 5e-8 and len(m["others"]) == 58 and x.shape == (4000, 2)


def test_joint_effects_are_those_of_a_regression():
    rng = np.random.default_rng(8)
    g = genotypes(rng, 500, 20)
    x = ((g - g.mean(axis=1, keepdims=True)) / g.std(axis=1, keepdims=True)).T
    y = x @ rng.normal(0, 0.1, 20) + rng.normal(0, 1, 500)
    y = (y - y.mean()) / y.std()
    b, r, chosen = x.T @ y / 500, correlated(g), [2, 9, 15]
    effect, chi2 = signals.joint_effects(b, r, chosen, 500)
    design = x[:, chosen]
    want, left, *_ = np.linalg.lstsq(design, y, rcond=None)
    assert effect == pytest.approx(want, abs=1e-9)
    variance = float(left[0]) / 500 * np.diagonal(np.linalg.inv(design.T @ design))
    assert chi2 == pytest.approx(want**2 / variance, rel=1e-6)


def test_artifacts_are_flagged_and_refitted():
    """Two variants correlated 0.85 whose scores differ as no sample's do: the joint effects explode, the safe refit takes one."""
    r = np.array([[1, 0.85, 0], [0.85, 1, 0], [0, 0, 1]], float)
    m = signals.joint_model(np.array([12.0, 0.2, 1.0]), r, 10_000)
    assert m["verdict"] == "likely_artifact" and m["again"] and m["chosen"] == [0] and not any(m["flags"])
    assert signals.flags_of(0.01, 0.3, 0.06, 1e-3) == ["effect_inflation"]
    assert signals.flags_of(0.01, 0.3, -0.02, 1e-3) == ["sign_flip"]
    assert signals.flags_of(0.01, 0.005, -0.02, 1e-3) == []
    assert signals.flags_of(0.01, 0.3, 0.02, 1e-30) == ["marginal_joint_inconsistency"]
    assert signals.reliability([["sign_flip"], []]) == "suspect"
    assert signals.reliability([[]] * 21) == "likely_artifact" and signals.reliability([]) == "ok"


# ---- over tables


@pytest.fixture(scope="module")
def study():
    rng = np.random.default_rng(9)
    g = genotypes(rng, 1000, 60)
    z = {0: scores(rng, g, {12: 0.3}), 1: scores(rng, g, {12: 0.3, 50: 0.3})}
    return g, z


def frames(spark, g, z, panels=1):
    rows = [(1, t, 100 * k, float(x), 1000.0) for t, own in z.items() for k, x in enumerate(own)]
    told = spark.createDataFrame(rows, "locus long, trait int, pos long, z double, n double")
    panel = spark.createDataFrame([(1, p, 100 * k, x.tolist()) for p in range(panels) for k, x in enumerate(g)], "locus long, panel int, pos long, dosages array<int>")
    return told, panel


def test_fine_mapped_tables(spark, study):
    told, panel = frames(spark, *study)
    few = spark.createDataFrame([(2, 0, 5, 3.0, None)], told.schema)
    got = {(r.locus, r.trait): r for r in signals.fine_mapped(told.unionByName(few), panel).collect()}
    assert got[1, 0].n_variants == 60 and len(got[1, 0].variants) == 60 - got[1, 0].n_removed
    held = lambda r: {v.pos for v in r.variants if v.set}
    assert 1200 in held(got[1, 0]) and {1200, 5000} <= held(got[1, 1])
    assert all(s.coverage >= 0.95 - 1e-9 for r in got.values() for s in r.sets)
    assert got[2, 0].n_variants == 0 and got[2, 0].sets == [] and got[2, 0].max_pip is None


def test_jointly_mapped_tables(spark, study):
    told, panel = frames(spark, *study)
    residual = spark.createDataFrame([(0, 1, 5000, 0.1)], "a int, b int, n long, r double")
    (r,) = signals.jointly_mapped(told, panel, residual).collect()
    assert r.trait == 2
    active = {s.lead: s.active for s in r.sets}
    of = {v.pos: v.set for v in r.variants}
    assert of[1200] and of[5000] and sorted(map(tuple, active.values())) == [(0, 1), (1,)]
    assert signals.jointly_mapped(told.where("trait = 0"), panel).count() == 0


def test_cross_mapped_tables(spark, study):
    told, panel = frames(spark, study[0], study[1], 2)
    (r,) = signals.cross_mapped(told.where("trait = 0 or pos < 4000"), panel).collect()
    assert r.trait == 2 and {v.pos: v.set for v in r.variants}[1200]
    # a population without a panel says nothing
    (r,) = signals.cross_mapped(told, panel.where("panel = 0")).collect()
    assert r.trait == 1


def test_joint_models_tables(spark, study):
    told, panel = frames(spark, *study)
    got = {r.trait: r for r in signals.joint_models(told, panel).collect()}
    assert got[0].n_signals == 1 and got[1].n_signals == 2 and got[1].reliability == "ok" and got[1].explained
    assert len(got[1].conditional) == 58 and all(0 <= c.p <= 1 for c in got[1].conditional)


def test_wide_loci_are_named(spark, study, monkeypatch):
    monkeypatch.setattr(signals, "MOST", 50)
    from pyspark.errors import PythonException

    with pytest.raises(PythonException, match="locus 1 has 60 variants"):
        signals.fine_mapped(*frames(spark, *study)).collect()


def test_alignment(spark):
    v = spark.createDataFrame(
        [(1, 1, 10, "a", "C", 0.2, 0.1, 100.0, 0), (2, 1, 20, "C", "A", 0.2, 0.1, 90.0, 0), (3, 1, 30, "T", "G", 0.2, 0.1, 100.0, 0), (4, 1, 40, "G", "T", 0.2, 0.1, 100.0, 0), (5, 1, 50, "A", "T", 0.2, 0.1, 100.0, 0),
         (6, 1, 60, "A", "G", 0.2, 0.1, 100.0, 0), (7, 1, 70, "A", "C", 0.2, 0.1, 79.0, 0), (8, 1, 80, "A", "C", 0.2, 0.0, 100.0, 0), (9, 1, 90, "A", "C", None, 0.1, 100.0, 0), (10, 1, 95, "A", "C", 0.2, 0.1, None, 0),
         (11, 1, 10, "A", "C", 9.0, 0.1, 100.0, 0), (12, 1, 70, "A", "C", 0.2, 0.1, 79.0, 1), (13, 1, 95, "A", "C", 0.2, 0.1, None, 1), (14, 1, 20, "A", "C", 0.2, 0.1, None, 1)],
        "vid long, chr int, pos long, ea string, nea string, beta double, se double, n double, ds int",
    )
    panel = spark.createDataFrame([(1, p, "A", "C") for p in range(10, 100, 5)], "chr int, pos long, a1 string, a2 string")
    loci = spark.createDataFrame([(7, 1, 1, 100)], "locus long, chr int, start long, end long")
    got = {(r.trait, r.pos): round(r.z, 6) for r in signals.aligned(v, panel, loci).collect()}
    assert got == {(0, 10): 2.0, (0, 20): -2.0, (0, 30): 2.0, (0, 40): -2.0, (1, 70): 2.0, (1, 95): 2.0, (1, 20): 2.0}


def test_windows_stand_around_the_lead(spark):
    v = spark.createDataFrame([(1, 500_000, 6.0, 0), (1, 600_000, 9.0, 1), (1, 300_000, 2.0, 0), (2, 100, 7.0, 0)], "chr int, pos long, z double, ds int")
    got = signals.windows(v, 250_000).orderBy("chr").select("chr", "start", "end").collect()
    assert [tuple(r) for r in got] == [(1, 350_000, 850_000), (2, 1, 250_100)]
    assert signals.windows(v.where(F.col("z") < 3)).count() == 0


def test_loci_of_more_variants_than_people(spark, monkeypatch):
    """A locus of more variants than the bound in a panel of few people was an error; its sets are those of the matrix of correlations."""
    rng = np.random.default_rng(10)
    g = genotypes(rng, 24, 300)
    g = g[g.std(axis=1) > 0]
    z = rng.normal(size=len(g)) + 8 * correlated(g)[100]
    dense, factored = correlated(g), regional.Linkage.of_dosages(pd.Series(list(g)))
    monkeypatch.setattr(signals, "MOST", 100)
    told, panel = frames(spark, g, {0: z, 1: -z})
    (one,) = signals.fine_mapped(told.where("trait = 0"), panel).collect()
    keep, s, used = signals.checked(z[:, None], dense)
    fit = signals.sum_of_effects(z[keep, None], [(1 - used) * dense[np.ix_(keep, keep)] + used * np.eye(len(keep))], np.array([1000.0]))
    assert one.n_variants == len(g) > 250 and one.inconsistency == pytest.approx(s, abs=1e-5)
    assert [v.pip for v in one.variants] == pytest.approx(fit.pip.tolist(), abs=1e-6)
    assert factored.x.shape[1] == 24 and factored.block([3, 5], [5, 9]) == pytest.approx(dense[np.ix_([3, 5], [5, 9])])
    assert signals.jointly_mapped(told, panel).count() == 1 and signals.cross_mapped(told, panel).count() == 1
    assert signals.joint_models(told, panel).count() == 2
    mean, variance = regional.given_others(z, factored.shrunk(0.1))
    inverse = np.linalg.inv(0.9 * dense + 0.1 * np.eye(len(g)))
    assert variance == pytest.approx(1 / np.diagonal(inverse)) and mean == pytest.approx(z - inverse @ z / np.diagonal(inverse))
