"""Gene tests, set regressions and plug-ins."""

import json
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lociform.operators import genes, plugins, regional
from tests.test_signals import genotypes


def simulated_tail(rng, q, w, n):
    """P(sum > q) by drawing all but the largest weight and taking that one's tail exactly."""
    rest = (rng.chisquare(1, (n, len(w) - 1)) * w[1:]).sum(axis=1)
    x = np.maximum(q - rest, 0) / w[0]
    return float(np.mean(np.vectorize(math.erfc)(np.sqrt(x / 2))))


def test_tail_of_single_and_equal_weights():
    for z in (0.1, 1.0, 1.959964, 5.0, 12.0, 30.0):
        assert genes.log_tail(2.5 * z * z, np.array([2.5])) == pytest.approx(math.log(math.erfc(z / math.sqrt(2))), abs=1e-8)
    for q in (0.01, 2.0, 9.0, 60.0, 500.0):  # four degrees: exp(-q/2) (1 + q/2)
        assert genes.log_tail(q, np.ones(4)) == pytest.approx(-q / 2 + math.log1p(q / 2), abs=1e-8)
    assert genes.log_tail(3.841459, np.array([1.0, 0, 0, 0])) == pytest.approx(math.log(0.05), rel=1e-6)
    # very small sums, near the mean, and many weights: few steps, and the lower tail's complement
    for q in (1e-12, 1e-6, 1e-3):
        assert -genes.log_tail(q, np.ones(4)) == pytest.approx(q * q / 8, rel=1e-2, abs=1e-16)
        assert math.exp(genes.log_tail(q, np.array([1.0]))) == pytest.approx(math.erfc(math.sqrt(q / 2)), abs=1e-9)
    for m in (2, 40, 400):
        w = np.linspace(0.1, 2, m)
        assert 0.3 < math.exp(genes.log_tail(float(w.sum()), w)) < 0.5
    assert genes.log_tail(0.0, np.ones(3)) == 0.0 and genes.log_tail(1.0, np.zeros(2)) == -math.inf


@pytest.mark.parametrize("w", [[3.0, 1.0, 0.5], [5.0, 4.9, 0.1, 0.1, 0.01], [1.5] + [0.2] * 40])
def test_tail_agrees_with_simulation(w):
    rng, w = np.random.default_rng(1), np.array(w)
    for target in (0.5, 0.05, 1e-3, 1e-6):
        low, high = 0.0, 1000.0
        for _ in range(60):
            q = (low + high) / 2
            low, high = (q, high) if genes.log_tail(q, w) > math.log(target) else (low, q)
        assert simulated_tail(rng, q, w, 400_000) == pytest.approx(target, rel={0.5: 0.02, 0.05: 0.02, 1e-3: 0.08}.get(target, 0.3))


def test_tail_agrees_with_integration():
    """Two weights: the tail of one integrated over the density of the other."""
    t = np.linspace(0, 14, 100_001)
    density = 2 * np.exp(-t * t / 2) / math.sqrt(2 * math.pi)
    for q in (20.0, 66.0, 136.0):
        tail = [math.erfc(math.sqrt(max(q - 4.9 * x * x, 0) / 10)) for x in t]
        assert math.exp(genes.log_tail(q, np.array([5.0, 4.9]))) == pytest.approx(float(np.trapezoid(tail * density, t)), rel=1e-5)


def test_quantile_of_tails():
    for x in (-3.0, 0.0, 1.0, 5.0, 9.0, 30.0):
        log = math.log(0.5 * math.erfc(x / math.sqrt(2)))
        assert genes.upper_quantile(log) == pytest.approx(x, abs=1e-4)


def test_p_values_are_uniform_without_effects():
    rng = np.random.default_rng(2)
    g = genotypes(rng, 300, 24)
    r = regional.correlations(pd.Series(list(g.astype(float))))
    z = np.linalg.cholesky(r + 1e-9 * np.eye(24)) @ rng.normal(size=(24, 600))
    p = np.sort([math.exp(genes.gene_log_p(x, r)) for x in z.T])
    assert np.abs(p - (np.arange(600) + 0.5) / 600).max() < 0.06


@pytest.fixture(scope="module")
def study(spark):
    rng = np.random.default_rng(3)
    g = genotypes(rng, 200, 160)
    z = rng.normal(size=160)
    z[40:48] += 4
    variants = spark.createDataFrame([(1, 100 * k, float(x)) for k, x in enumerate(z)], "chr int, pos long, z double")
    panel = spark.createDataFrame([(1, 100 * k, x.tolist()) for k, x in enumerate(g)] + [(1, 99_999, [1] * 200)], "chr int, pos long, dosages array<int>")
    spans = spark.createDataFrame([(k, 1, 800 * k - 1, 800 * k + 750) for k in range(20)], "gene int, chr int, start long, end long")
    return g, z, variants, panel, spans


def test_gene_tests(spark, study):
    g, z, variants, panel, spans = study
    rows = genes.gene_rows(variants, panel, spans)
    got = {r.gene: r for r in genes.gene_tests(rows).collect()}
    assert set(got) == set(range(20)) and all(r.n_variants == 8 for r in got.values())
    own = regional.correlations(pd.Series(list(g[40:48].astype(float))))
    assert got[5].log_p == pytest.approx(genes.gene_log_p(z[40:48], own)) == min(r.log_p for r in got.values())
    assert got[5].score == pytest.approx(genes.upper_quantile(got[5].log_p)) and got[5].score > 3
    assert genes.gene_tests(rows.limit(0)).count() == 0


def test_gene_correlations(spark, study):
    g, _, variants, panel, spans = study
    wide = spans.withColumn("end", F.col("end") + 400)  # genes share half of their variants with the next
    rows = genes.gene_rows(variants, panel, wide)
    got = {(r.a, r.b): r.r for r in genes.gene_correlations(rows, wide, 400, least=0).collect()}
    assert set(got) == {(k, k + 1) for k in range(19)}
    a, b = range(24, 36), range(32, 44)
    r = regional.correlations(pd.Series(list(g.astype(float)))) ** 2
    want = r[np.ix_(a, b)].sum() / math.sqrt(r[np.ix_(a, a)].sum() * r[np.ix_(b, b)].sum())
    assert got[3, 4] == pytest.approx(want, rel=1e-5)


def test_set_regressions_against_matrices(spark):
    rng = np.random.default_rng(4)
    n = 120
    size = rng.integers(1, 50, n).astype(float)
    v = np.eye(n)
    pairs = [(k, k + 1, float(rng.uniform(0.1, 0.8))) for k in range(0, n - 1, 2)]
    for a, b, r in pairs:
        v[a, b] = v[b, a] = r
    y = 0.02 * size + np.linalg.cholesky(v) @ rng.normal(size=n)
    sets = {"even pairs": list(range(0, 20)), "strong": list(range(50, 70)), "single": [3], "all": list(range(n))}
    y[50:70] += 1.5
    scores = spark.createDataFrame([(k, float(y[k]), float(size[k])) for k in range(n)], "gene int, score double, size double")
    members = spark.createDataFrame([(k, s) for s, own in sets.items() for k in [*own, own[0], 999]], "gene int, set string")
    near = spark.createDataFrame(pairs, "a int, b int, r double")
    got = {r.set: r for r in genes.set_regressions(scores, members, near, ["size"]).collect()}
    assert set(got) == {"even pairs", "strong"}
    for name, r in got.items():
        x = np.column_stack([np.ones(n), size, np.isin(np.arange(n), sets[name])])
        inverse = np.linalg.inv(x.T @ x)
        beta = inverse @ x.T @ y
        noise = float(((y - x @ beta) ** 2).sum()) / (n - 3)
        error = math.sqrt(noise * (inverse @ x.T @ v @ x @ inverse)[2, 2])
        assert (r.n, r.effect, r.error) == (len(sets[name]), pytest.approx(beta[2]), pytest.approx(error))
    assert got["strong"].p < 1e-4 < got["even pairs"].p
    alone = genes.set_regressions(scores, members, near.limit(0), ["size"]).where("set = 'even pairs'").first()
    assert alone.effect == pytest.approx(got["even pairs"].effect) and alone.error < got["even pairs"].error


# ---- plug-ins


def described(**changes):
    told = {"tool": "t", "version": "1.0", "requires": ["z"], "outputs": [{"raw": "two", "name": "doubled", "scope": "per_snp", "type": "double"}], "parameters": [{"name": "by", "type": "float", "default": "2"}, {"name": "how", "type": "select", "default": "plain", "options": ["plain", "other"]}]}
    return plugins.Descriptor.read(json.dumps(told | changes))


def test_descriptors_are_checked():
    assert described().parameters[0].value("2") == 2.0
    for changes, said in (
        ({"outputs": []}, "at least one"), ({"outputs": [{"raw": "a", "name": "a", "scope": "per_cell", "type": "int"}]}, "'a' has invalid scope"), ({"outputs": [{"raw": "a", "name": "a", "scope": "per_snp", "type": "date"}]}, "'a' has invalid type"),
        ({"parameters": [{"name": "p", "type": "colour", "default": 1}]}, "'p' has invalid type"), ({"outputs": [{"raw": "a", "name": "a", "scope": "per_credible_set", "type": "int"}]}, "set_column"),
    ):
        with pytest.raises(plugins.ContractError, match=said):
            described(**changes)
    for given, said in (({"by": "much"}, "'by' is not of type float"), ({"how": "odd"}, "'how' is none of"), ({"what": 1}, "no parameter 'what'")):
        with pytest.raises(plugins.ContractError, match=said):
            plugins.settled(described(), given)
    assert plugins.settled(described(), {"by": "3"}) == {"by": 3.0, "how": "plain"}
    with pytest.raises(plugins.ContractError, match="no tool 'none'"):
        plugins.descriptor_of("none")
    with pytest.raises(plugins.ContractError, match="registered already"):
        plugins.register(plugins.descriptor_of("single_effects"), lambda pdf, p: pdf)
    assert [d.tool for d in plugins.tools()][:2] == ["joint_selection", "single_effects"]


@pytest.mark.parametrize(
    "result, said",
    [
        ({"variant": [1, 2], "one": [1.0, 2.0]}, "'one' is not declared"), ({"variant": [1, 2]}, "'two' is missing"), ({"two": [1.0]}, "key column 'variant' is missing"),
        ({"variant": [1, None], "two": [1.0, 2.0]}, "has no 'variant'"), ({"variant": [1, 1], "two": [1.0, 2.0]}, "comes twice"), ({"variant": [1], "two": ["x"]}, "'doubled' is not of type double"),
    ],
)
def test_results_are_held_to_the_contract(result, said):
    with pytest.raises(plugins.ContractError, match=said):
        plugins.held_to(described(), pd.DataFrame(result))


def test_scopes_and_types():
    d = described(outputs=[{"raw": "s", "name": "s", "scope": "per_snp", "type": "int"}, {"raw": "c", "name": "c", "scope": "per_credible_set", "type": "double"}, {"raw": "g", "name": "g", "scope": "per_group", "type": "string"}], set_column="s")
    good = {"variant": [1, 2, 3, 4], "s": [1, 1, 2, None], "c": [0.9, 0.9, 0.8, None], "g": ["x"] * 4}
    assert plugins.held_to(d, pd.DataFrame(good)).columns.tolist() == ["variant", "s", "c", "g"]
    for change, said in (({"c": [0.9, 0.8, 0.8, None]}, "'c' of scope per_credible_set"), ({"g": ["x", "x", "y", "x"]}, "'g' of scope per_group"), ({"s": [1, 1.5, 2, None]}, "'s' is not of type int")):
        with pytest.raises(plugins.ContractError, match=said):
            plugins.held_to(d, pd.DataFrame(good | change))


def test_registered_programs_run_by_group(spark):
    from pyspark.errors import PythonException

    df = spark.createDataFrame([(g, v, float(v)) for g in ("a", "b") for v in range(3)], "locus string, variant long, z double").withColumn("spare", F.lit(1))
    plugins.register(described(), lambda pdf, p: pd.DataFrame({"variant": pdf["variant"], "two": pdf["z"] * p["by"]}), replace=True)
    got = plugins.run("t", df, "locus", {"by": 3})
    assert got.columns == ["locus", "variant", "doubled", "method", "method_version"]
    assert sorted(map(tuple, got.collect())) == [(g, v, 3.0 * v, "t", "1.0") for g in ("a", "b") for v in range(3)]
    with pytest.raises(plugins.ContractError, match="requires column 'z'"):
        plugins.run("t", df.drop("z"), "locus")
    plugins.register(described(), lambda pdf, p: pd.DataFrame({"variant": pdf["variant"], "three": pdf["z"]}), replace=True)
    with pytest.raises(PythonException, match="'three' is not declared"):
        plugins.run("t", df, "locus").collect()


def test_programs_of_the_library(spark):
    rng = np.random.default_rng(5)
    rows = []
    for locus in (1, 2):
        g = genotypes(rng, 800, 40)
        x = (g - g.mean(axis=1, keepdims=True)) / g.std(axis=1, keepdims=True)
        y = 0.35 * x[10 * locus] + rng.normal(size=800)
        b = x @ ((y - y.mean()) / y.std()) / 800
        rows += [(locus, k, float(b[k] * math.sqrt(798 / (1 - b[k] ** 2))), g[k].tolist()) for k in range(40)]
    df = spark.createDataFrame(rows, "locus int, variant long, z double, dosages array<int>")
    sets = plugins.run("single_effects", df, "locus", {"n": 800}).where("credible_set is not null").collect()
    assert {1, 2} == {r.locus for r in sets if r.variant == 10 * r.locus} and all(r.set_coverage >= 0.95 - 1e-9 for r in sets)
    signals = plugins.run("joint_selection", df, "locus", {"n": 800}).collect()
    assert sorted({r.locus for r in signals if r.selected}) == [1, 2] and {r.reliability for r in signals} == {"ok"} and all(r.p_given is not None for r in signals)


def test_genes_of_many_variants_need_no_rows_of_their_own(spark, monkeypatch):
    """Runs of more variants than the bound: the same results as from a row for each gene and variant, which was an error."""
    rng = np.random.default_rng(6)
    g = genotypes(rng, 20, 300)
    varies = g.std(axis=1) > 0
    variants = spark.createDataFrame([(1, 10_000 * k, float(x)) for k, x in enumerate(rng.normal(size=300) * 2)], "chr int, pos long, z double")
    panel = spark.createDataFrame([(1, 10_000 * k, x.tolist()) for k, x in enumerate(g)], "chr int, pos long, dosages array<int>")
    spans = spark.createDataFrame([(k, 1, a, b) for k, (a, b) in enumerate([(0, 2_990_000), (5_000, 6_000), (15_000, 400_000), (1_000_000, 1_000_000), (700_000, 1_350_000), (2_000_000, 9_000_000)])], "gene int, chr int, start long, end long")
    monkeypatch.setattr(genes, "MOST", 50)
    got = {r.gene: r for r in genes.gene_range_tests(variants, panel, spans).collect()}
    want = {r.gene: r for r in genes.gene_tests(genes.gene_rows(variants, panel, spans)).collect()}
    assert got.keys() == want.keys() and got[0].n_variants == varies.sum() > 250 and 1 not in got
    for k, r in want.items():
        assert (got[k].n_variants, got[k].statistic, got[k].log_p) == (r.n_variants, pytest.approx(r.statistic, abs=1e-9), pytest.approx(r.log_p, abs=1e-8))
