"""Golden facts, brute force for ranges, and every query against its SQL at the smallest scale."""

import math
import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from lociform.functions import scalar
from lociform.operators import finemap, loci, ranges, stats
from lociform.plans.queries import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def other():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_against_sql(spark, other, name):
    got = QUERIES[name](spark, FOLDER)
    columns = sorted(got.columns)
    rows = sorted(map(repr, (tuple(r[c] for c in columns) for r in got.collect())))
    if name not in SQL:
        assert rows
        return
    result = other.execute(SQL[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert rows == sorted(map(repr, (tuple(r[k] for k in order) for r in result.fetchall())))


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_normal_tail_and_quantile(spark):
    r = one(spark, scalar.z_to_p(F.lit(5.4513)).alias("p"), scalar.qnorm(F.lit(2.5e-8)).alias("q"), scalar.log_gamma(F.lit(10.0)).alias("g"))
    assert r.p == pytest.approx(5e-8, rel=1e-3)
    assert r.q * r.q == pytest.approx(29.7164, abs=1e-3)
    assert r.g == pytest.approx(math.log(math.factorial(9)), abs=1e-8)


def test_labels_and_alleles(spark):
    c = F.lit
    r = one(
        spark, scalar.normal_chr(c("chrX")).alias("a"), scalar.chr_order(c("MT")).alias("b"), scalar.chr_order(c("odd")).alias("c"), scalar.optional_double(c("NaN")).alias("d"), scalar.optional_double(c("1e-3")).alias("e"),
        scalar.display_id(c("."), c(""), c("1"), c("5")).alias("f"), scalar.stable_id(c("1"), c(7), c("t"), c("C")).alias("g"), scalar.match_class(c("A"), c("C"), c("G"), c("T")).alias("h"), scalar.haldane_odds_ratio(c(3), c(2), c(2), c(8)).alias("i"),
    )
    assert tuple(r) == ("X", 25, 99, None, 1e-3, "1:5", "1:7:C:T", "REVERSE_COMPLEMENT", 6.0)


def test_ranges_against_brute_force(spark):
    rng = random.Random(1)
    iv = [(k, rng.randint(1, 2), s := rng.randint(1, 900), s + rng.randint(0, 300)) for k in range(60)]
    pts = [(k, rng.randint(1, 3), rng.randint(1, 1200)) for k in range(80)]
    i = spark.createDataFrame(iv, "iid long, chr int, start long, end long")
    p = spark.createDataFrame(pts, "pid long, chr int, pos long")
    inside = {(a, k) for a, c, x in pts for k, d, s, e in iv if c == d and s <= x <= e}
    assert {(r.pid, r.iid) for r in ranges.points_in(p, i, width=64).collect()} == inside
    assert ranges.points_in(p, i, width=64).count() == len(inside)
    assert {r.pid for r in ranges.points_in(p, i, "left_semi", 64).collect()} == {a for a, _ in inside}
    assert {r.pid for r in ranges.points_in(p, i, "left_anti", 64).collect()} == {a for a, *_ in pts} - {a for a, _ in inside}
    lap = [(a, k) for a, c, s, e in iv for k, d, x, y in iv if c == d and s <= y and e >= x]
    assert sorted((r.iid, r.iid_b) for r in ranges.overlapping(i, i, 64).collect()) == sorted(lap)
    best = {a: min((max(0, s - x, x - e) for k, d, s, e in iv if d == c), default=None) for a, c, x in pts}
    near = ranges.nearest(p, i, "iid", 64).collect()
    by = {k: (d, s, e) for k, d, s, e in iv}
    assert {r.pid: r.distance for r in near} == best
    assert all(r.near is None or max(0, by[r.near][1] - r.pos, r.pos - by[r.near][2]) == r.distance for r in near)


def test_islands_touch_and_nest(spark):
    rows = spark.createDataFrame([(1, 1, 100), (1, 20, 30), (1, 150, 160), (1, 211, 220), (2, 5, 6)], "chr int, start long, end long")
    got = loci.islands(rows, 50).groupBy("chr", "island").agg(F.min("start"), F.max("end")).collect()
    assert sorted((r[0], r[2], r[3]) for r in got) == [(1, 1, 160), (1, 211, 220), (2, 5, 6)]


def test_anova_and_ranks(spark):
    rows = [("k", g, float(v)) for g, vs in (("a", (3, 4, 5)), ("b", (6, 7, 8)), ("c", (9, 10, 11))) for v in vs] + [("one", "a", 1.0)]
    got = {r.k: r.f for r in stats.one_way_anova(spark.createDataFrame(rows, "k string, g string, v double"), ["k"], "g", "v").collect()}
    assert got == {"k": pytest.approx(27.0), "one": None}
    u = spark.createDataFrame([(1, v, a) for v, a in ((1, True), (2, True), (2, True), (2, False), (3, False), (4, False))], "k int, v int, a boolean")
    r = stats.mann_whitney(u, ["k"], "v", F.col("a")).first()
    assert (r.n1, r.n2, r.u) == (3, 3, 1.0)


def test_false_discovery_is_monotone(spark):
    p = spark.createDataFrame([(1, x) for x in (0.01, 0.04, 0.03, 0.5)], "k int, p double")
    got = {r.p: r.q for r in stats.benjamini_hochberg(p, ["k"], "p").collect()}
    assert got == {0.01: pytest.approx(0.04), 0.03: pytest.approx(0.16 / 3), 0.04: pytest.approx(0.16 / 3), 0.5: pytest.approx(0.5)}


def test_credible_set_stops_at_coverage(spark):
    d = spark.createDataFrame([(1, k, b) for k, b in enumerate((10.0, 9.0, 1.0, 0.0))], "k int, vid int, lbf double")
    kept = finemap.credible_set(finemap.posterior(d, ["k"]), ["k"], [F.desc("lbf")]).collect()
    assert [r.vid for r in sorted(kept, key=lambda r: r["rank"])] == [0, 1]


def test_shared_pairs_against_brute_force(spark):
    rng = random.Random(2)
    rows = [(i, g) for i in range(60) for g in range(5) if rng.random() < 0.6]
    sets = {i: {g for j, g in rows if j == i} for i in range(60)}
    every = sorted(((-len(sets[a] & sets[b]), a, b) for a in range(60) for b in range(a + 1, 60) if len(sets[a] & sets[b]) >= 2))[:40]
    got = loci.shared_pairs(spark.createDataFrame(rows + rows[:5], "i long, g int"), "i", "g", 40).collect()
    assert [(-r.n, r.a, r.b) for r in got] == every


# ---- quantiles, ranks, pairs and pruning


def test_one_strong_signal_does_not_widen_the_bins(spark):
    """A chi-square of 10,000 among many small ones: no bin holds more than a thousandth of the rows."""
    df = spark.range(200_000).select((F.randn(3) * F.randn(3)).alias("x"), F.lit(1).alias("k")).withColumn("v", F.col("x") * F.col("x"))
    df = df.select("k", "v").unionByName(spark.createDataFrame([(1, 1e4), (1, None), (1, float("nan"))], "k int, v double"))
    largest = df.where("v is not null and not isnan(v)").groupBy(stats.order_bin(F.col("v"))).count().agg(F.max("count")).first()[0]
    assert largest <= 200
    values = sorted(r.v for r in df.collect() if r.v is not None and r.v == r.v)
    (r,) = stats.medians(df, ["k"], "v").collect()
    assert r.n == 200_001 and r.median == values[100_000] and r["mean"] == pytest.approx(sum(values) / len(values))


def test_values_at_any_rank(spark):
    rng = random.Random(4)
    rows = [(k, float(rng.choice([-1e300, -5.0, -1e-9, 0.0, 0.0, 1e-300, 1.0, 1.0000001, 2.5, 1e9]) * rng.choice([1, 1, 1.5]))) for k in (1, 2) for _ in range(60)] + [(3, 4.0)]
    got = {r.k: r for r in stats.values_at(spark.createDataFrame(rows, "k int, v double"), ["k"], "v", {"a": F.lit(0), "b": F.floor(F.col("n") / 3), "c": F.col("n") - 1}).collect()}
    for k in (1, 2, 3):
        own = sorted(v for j, v in rows if j == k)
        assert (got[k].n, got[k].a, got[k].b, got[k].c) == (len(own), own[0], own[len(own) // 3], own[-1])


def test_pair_moments_against_loops(spark):
    rng = random.Random(5)
    rows = [(k, g, rng.uniform(-3, 3)) for k in range(3000) for g in "abcd" if rng.random() < 0.6] + [(9999, "a", None)]
    got = {(r.a, r.b): r for r in stats.pair_moments(spark.createDataFrame(rows, "k int, g string, v double").repartition(3), "k", "g", "v").collect()}
    of = {(k, g): v for k, g, v in rows if v is not None}
    assert set(got) == {(a, b) for a in "abcd" for b in "abcd" if a < b}
    for (a, b), r in got.items():
        pairs = [(of[k, a], of[k, b]) for k in range(3000) if (k, a) in of and (k, b) in of]
        want = [len(pairs), *(sum(f(x, y) for x, y in pairs) for f in (lambda x, y: x, lambda x, y: y, lambda x, y: x * x, lambda x, y: y * y, lambda x, y: x * y))]
        assert list(r[2:]) == pytest.approx(want)


def test_distance_pruning_by_bins(spark):
    rng = random.Random(6)
    for gap, most in ((250_000, 9_000_000), (1000, 3_000_000), (400_000, 30_000_000)):
        rows = [(c, rng.randint(1, most)) for c in (1, 2) for _ in range(700)] + [(3, 5), (4, 999_999), (4, 1_000_000), (4, 1_249_999)]
        want = []
        for c in {c for c, _ in rows}:
            last = None
            for p in sorted({p for d, p in rows if d == c}):
                if last is None or p >= last + gap:
                    want.append((c, p))
                    last = p
        got = loci.distance_pruned(spark.createDataFrame(rows, "chr int, pos long"), gap)
        assert sorted(map(tuple, got.collect())) == sorted(want)


def test_shared_pairs_against_all_pairs(spark):
    rng = random.Random(7)
    rows = [(i, g) for i in range(60) for g in range(12) if rng.random() < 0.1 + (i % 7) / 10] + [(i, g) for i in (70, 71, 72) for g in range(9)]
    sets = {i: {g for j, g in rows if j == i} for i, _ in rows}
    want = sorted(((-len(sets[a] & sets[b]), a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 2))
    for k in (1, 5, 40, 5000):
        got = loci.shared_pairs(spark.createDataFrame(rows, "i int, g int"), "i", "g", k).collect()
        assert [(-r.n, r.a, r.b) for r in got] == want[:k]


def test_cell_types_beyond_a_hundred_keep_their_own_regions(spark):
    k = spark.createDataFrame([(1, 127, 10, 20), (2, 27, 15, 30), (1, 127, 18, 25), (1, 27, 10, 12)], "chr int, eid int, start long, end long").withColumn("chr", F.struct("chr", "eid"))
    got = loci.islands(k, -1).groupBy("chr", "island").agg(F.min("start").alias("a"), F.max("end").alias("b"))
    assert sorted((r.chr.chr, r.chr.eid, r.a, r.b) for r in got.collect()) == [(1, 27, 10, 12), (1, 127, 10, 25), (2, 27, 15, 30)]


def test_exact_test_of_large_tables():
    """Against sums of exact fractions, and at once for margins of millions."""
    from math import comb

    rng = random.Random(8)
    for _ in range(200):
        a, b, c, d = (rng.randint(0, rng.choice([3, 30, 200])) for _ in range(4))
        rows, column, total = a + b, a + c, a + b + c + d
        weights = [comb(rows, x) * comb(total - rows, column - x) for x in range(max(0, rows + column - total), min(rows, column) + 1)]
        own = comb(rows, a) * comb(total - rows, column - a)
        want = sum(w for w in weights if w <= own * (1 + 1e-9)) / sum(weights)
        assert scalar.fisher_p(a, b, c, d) == pytest.approx(want, rel=1e-6)
    assert scalar.fisher_p(180_942, 2_000_000, 20_000_000, 269_015_376) == pytest.approx(0.0, abs=1e-12)
    assert 0.5 < scalar.fisher_p(1_000_000, 2_000_000, 2_000_000, 4_000_000) <= 1
    assert scalar.fisher_p(5000, 5200, 5100, 5000) == pytest.approx(0.036, abs=3e-3)
