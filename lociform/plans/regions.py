"""More fixed queries: row filters, panel and build joins, reports over loci, elements and gene sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lociform.functions import scalar as S
from lociform.operators import loci, ranges
from lociform.plans.queries import VIEW, erfc_sql, qnorm_sql, query
from lociform.sources.tables import catalog, genes, peaks, table, variants

SPANS = ("locus", "chr", "start", "end")


def spans(spark: SparkSession, d: str) -> DataFrame:
    return loci.seed_loci(variants(spark, d)).select(*SPANS)


# ---- row filters ------------------------------------------------------------------------------


@query("f05_merged_rows", "SELECT chr, pos, count(*) AS n, count(DISTINCT ds) AS n_datasets FROM v WHERE z >= 2.8070337e0 AND z < 38e0 GROUP BY chr, pos", "v")
def f05(spark: SparkSession, d: str) -> DataFrame:
    """Rows of 0 < p <= 5e-3, merged by position; the bounds are those of |z|."""
    return variants(spark, d).where((F.col("z") >= 2.8070337) & (F.col("z") < 38)).groupBy("chr", "pos").agg(F.count("*").alias("n"), F.count_distinct("ds").alias("n_datasets"))


@query("f06_valid_rows", "SELECT ds, count(*) FILTER (z > 0 AND isfinite(z)) AS n_valid, count(*) FILTER (NOT (z > 0 AND isfinite(z))) AS n_invalid FROM v GROUP BY ds", "v")
def f06(spark: SparkSession, d: str) -> DataFrame:
    z = F.col("z")
    valid = z.isNotNull() & ~F.isnan(z) & (z > 0) & (z < float("inf"))
    return variants(spark, d).groupBy("ds").agg(F.count_if(valid).alias("n_valid"), F.count_if(~valid).alias("n_invalid"))


@query("f07_derived_effects", f""", q AS (SELECT *, {erfc_sql("(z / sqrt(2e0))")} / 2e0 AS h FROM v), r AS (SELECT *, {qnorm_sql("h")} AS t FROM q)
  SELECT vid, round(CASE WHEN vid % 5 = 0 THEN ln(exp(beta)) ELSE beta END, 6) + 0e0 AS beta, round(CASE WHEN vid % 5 = 0 THEN abs(ln(exp(beta)) / nullif(t, 0e0)) ELSE se END, 5) AS se FROM r""", "v")  # fmt: skip
def f07(spark: SparkSession, d: str) -> DataFrame:
    """Effect and error from odds ratio and p where either is missing (every fifth row); no error where p is one."""
    missing, derived = F.col("vid") % 5 == 0, F.ln(F.exp("beta"))
    # the tail is bound to a variable: inlined, the quantile would repeat it past what can be compiled
    quantile = F.transform(F.array(S.z_to_p(F.col("z")) / 2), S.qnorm)[0]
    return variants(spark, d).select(
        "vid", (F.round(F.when(missing, derived).otherwise(F.col("beta")), 6) + 0.0).alias("beta"),
        F.round(F.when(missing, F.abs(F.try_divide(derived, quantile))).otherwise(F.col("se")), 5).alias("se"),
    )


@query("f08_recomputed_p", f"SELECT vid, round(-log10(CASE WHEN vid % 7 < 2 THEN {erfc_sql('(z / sqrt(2e0))')} ELSE (vid % 97 + 1) / 100e0 END), 6) + 0e0 AS neglog10p FROM v", "v")
def f08(spark: SparkSession, d: str) -> DataFrame:
    """A p that is zero or not finite (here two of seven rows) is computed again from |z|; every other is kept."""
    p = F.when(F.col("vid") % 7 == 0, F.lit(0.0)).when(F.col("vid") % 7 == 1, F.lit(float("nan"))).otherwise((F.col("vid") % 97 + 1) / 100.0)
    v = variants(spark, d).withColumn("p", p)
    valid = ~F.isnan("p") & (F.col("p") > 0) & (F.col("p") < float("inf"))
    return v.select("vid", (F.round(S.neglog10(F.when(valid, F.col("p")).otherwise(S.z_to_p(F.col("z")))), 6) + 0.0).alias("neglog10p"))


@query("f11_index_windows", """, b AS (SELECT chr, arg_min(pos, (-round(z, 9), pos)) AS lead FROM v GROUP BY chr)
  SELECT v.chr, lead, v.ds, count(*) AS n FROM v JOIN b ON v.chr = b.chr AND v.pos BETWEEN lead - 250000 AND lead + 250000 GROUP BY 1, 2, 3""", "v")  # fmt: skip
def f11(spark: SparkSession, d: str) -> DataFrame:
    """Rows within 250,000 positions of the chromosome's strongest."""
    v = variants(spark, d)
    lead = v.groupBy("chr").agg(F.min_by("pos", F.struct((-F.round("z", 9)).alias("s"), F.col("pos"))).alias("lead"))
    near = v.join(F.broadcast(lead), "chr").where(F.abs(F.col("pos") - F.col("lead")) <= 250_000)  # a row for each chromosome
    return near.groupBy("chr", "lead", "ds").agg(F.count("*").alias("n"))


@query("f21_score_filter", """, x AS (SELECT ds, z * z AS x, CASE WHEN vid % 11 = 0 THEN 0 ELSE 1000 + vid % 90000 END AS n FROM v)
  SELECT ds, count(*) AS n_kept, round(max(x), 5) AS top FROM x WHERE n > 0 AND x <= greatest(80e0, 0.001e0 * (SELECT max(n) FROM x o WHERE o.ds = x.ds)) GROUP BY ds""", "v")  # fmt: skip
def f21(spark: SparkSession, d: str) -> DataFrame:
    x = variants(spark, d).select("ds", (F.col("z") * F.col("z")).alias("x"), F.when(F.col("vid") % 11 == 0, 0).otherwise(1000 + F.col("vid") % 90_000).alias("n"))
    most = x.groupBy("ds").agg(F.greatest(F.lit(80.0), F.max("n") * 0.001).alias("most"))
    return x.join(F.broadcast(most), "ds").where("n > 0 and x <= most").groupBy("ds").agg(F.count("*").alias("n_kept"), F.round(F.max("x"), 5).alias("top"))


#: Named selections of cell types (fixed values of the fixed queries).
PRESETS = {"blood": (0, 1), "brain": (2,), "all": (0, 1, 2, 3, 4)}


@query("f23_presets", "SELECT preset, k.mark, count(*) AS n, round(max(k.signal), 6) AS top FROM (VALUES ('blood', 0), ('blood', 1), ('brain', 2), ('all', 0), ('all', 1), ('all', 2), ('all', 3), ('all', 4)) AS t(preset, eid) JOIN k USING (eid) GROUP BY 1, 2", "k")
def f23(spark: SparkSession, d: str) -> DataFrame:
    wanted = spark.createDataFrame([(name, e) for name, of in PRESETS.items() for e in of], "preset string, eid int")
    return peaks(spark, d).join(F.broadcast(wanted), "eid").groupBy("preset", "mark").agg(F.count("*").alias("n"), F.round(F.max("signal"), 6).alias("top"))


@query("f24_searchable", "SELECT chr, pos, min(ds) AS first_ds, count(*) AS n FROM v WHERE z >= 5.45131e0 GROUP BY chr, pos", "v")
def f24(spark: SparkSession, d: str) -> DataFrame:
    """What search may show: positions of p <= 5e-8."""
    return variants(spark, d).where(F.col("z") >= 5.45131).groupBy("chr", "pos").agg(F.min("ds").alias("first_ds"), F.count("*").alias("n"))


# ---- joins ------------------------------------------------------------------------------------


@query("j11_elements_in_window", 'SELECT g.gid, count(*) AS n, round(max(k.signal), 6) AS top FROM g JOIN k ON k.chr = g.chr AND k."end" >= g."start" - 50000 AND k."start" <= g."end" + 50000 GROUP BY g.gid', "g k")
def j11(spark: SparkSession, d: str) -> DataFrame:
    around = genes(spark, d).select("gid", "chr", (F.col("start") - 50_000).alias("start"), (F.col("end") + 50_000).alias("end"))
    k = peaks(spark, d).where("start <= end").select("chr", "start", "end", "signal")
    # an element overlaps a window if it starts in it, or began before and holds its start
    within = ranges.folded(k.withColumn("pos", F.col("start")), around, ["gid"], tops=["signal"])
    begun = ranges.covered(around.where("start <= end").withColumn("pos", F.col("start")), k.withColumn("start", F.col("start") + 1), ["gid"], tops=["signal"])
    return within.unionByName(begun).groupBy("gid").agg(F.sum("n").alias("n"), F.round(F.max("signal"), 6).alias("top"))


@query("j15_panel_ids", """, p AS (SELECT chr, pos, max(vid) AS pid FROM v WHERE ds = 0 AND chr % 5 <> 0 GROUP BY chr, pos), o AS (SELECT DISTINCT chr FROM p)
  SELECT vid, coalesce(pid, vid) AS panel_id FROM v LEFT JOIN p ON p.chr = v.chr AND p.pos = v.pos WHERE ds = 1 AND (pid IS NOT NULL OR v.chr NOT IN (SELECT chr FROM o))""", "v")  # fmt: skip
def j15(spark: SparkSession, d: str) -> DataFrame:
    """The panel's identifiers; a chromosome that the panel lacks keeps all its rows."""
    v = variants(spark, d)
    panel = v.where("ds = 0 and chr % 5 <> 0").groupBy("chr", "pos").agg(F.max("vid").alias("pid"))
    has = panel.select("chr").distinct().withColumn("has", F.lit(True))
    m = v.where("ds = 1").join(panel, ["chr", "pos"], "left").join(F.broadcast(has), "chr", "left")
    return m.where("pid is not null or has is null").select("vid", F.coalesce("pid", "vid").alias("panel_id"))


@query("j20_score_join", """, f AS (SELECT ds, chr, pos, arg_min(z, vid) AS z FROM v GROUP BY 1, 2, 3), s AS (SELECT CAST(p_partkey % 22 + 1 AS INT) AS chr, p_partkey * 4999 % 10000000 + 1 AS pos, min(p_size) AS l2 FROM part GROUP BY 1, 2)
  SELECT ds, count(*) AS n, CAST(sum(l2) AS BIGINT) AS sum_l2, round(sum(z * z * l2), 3) AS sxy FROM f JOIN s USING (chr, pos) GROUP BY ds""", "v")  # fmt: skip
def j20(spark: SparkSession, d: str) -> DataFrame:
    """The first row of each position with its linkage score."""
    first = variants(spark, d).groupBy("ds", "chr", "pos").agg(F.min_by("z", "vid").alias("z"))
    key = F.col("p_partkey")
    scores = table(spark, d, "part").select((key % 22 + 1).cast("int").alias("chr"), (key * 4999 % 10_000_000 + 1).alias("pos"), "p_size").groupBy("chr", "pos").agg(F.min("p_size").alias("l2"))
    return first.join(scores, ["chr", "pos"]).groupBy("ds").agg(F.count("*").alias("n"), F.sum("l2").cast("long").alias("sum_l2"), F.round(F.sum(F.col("z") * F.col("z") * F.col("l2")), 3).alias("sxy"))


@query("j28_shared_nulls", """, b AS (SELECT ds, chr, pos FROM v GROUP BY 1, 2, 3 HAVING max(z) < 2e0) SELECT a.ds AS ds_a, b.ds AS ds_b, count(*) AS n FROM b a JOIN b ON a.chr = b.chr AND a.pos = b.pos AND a.ds < b.ds GROUP BY 1, 2""", "v")
def j28(spark: SparkSession, d: str) -> DataFrame:
    """Positions without a signal that two datasets share: equal sets of datasets are counted before they make pairs."""
    null = variants(spark, d).groupBy("chr", "pos", "ds").agg(F.max("z").alias("z")).where("z < 2")
    sets = null.groupBy("chr", "pos").agg(F.array_sort(F.collect_set("ds")).alias("s")).groupBy("s").agg(F.count("*").alias("k"))
    pairs = sets.select(F.explode("s").alias("ds_a"), "s", "k").select("ds_a", F.explode("s").alias("ds_b"), "k").where("ds_a < ds_b")
    return pairs.groupBy("ds_a", "ds_b").agg(F.sum("k").alias("n"))


@query("j30_search_by_build", """, q AS (SELECT gid, chr, "start" AS pos FROM g), b AS (SELECT ds, CASE WHEN ds % 3 = 2 THEN 38 ELSE 37 END AS build FROM (SELECT DISTINCT ds FROM v))
  SELECT q.gid, b.ds, b.build, CASE WHEN b.build = 37 THEN 'compared' ELSE 'not compared' END AS state, count(v.vid) AS n FROM q CROSS JOIN b LEFT JOIN v ON b.build = 37 AND v.ds = b.ds AND v.chr = q.chr AND v.pos BETWEEN q.pos - 100000 AND q.pos + 100000 GROUP BY ALL""", "v g")  # fmt: skip
def j30(spark: SparkSession, d: str) -> DataFrame:
    """Rows near the positions asked for, in datasets of their genome build; the others are listed as not compared."""
    asked = genes(spark, d).select("gid", "chr", (F.col("start") - 100_000).alias("start"), (F.col("start") + 100_000).alias("end"))
    v = variants(spark, d)
    build = F.when(F.col("ds") % 3 == 2, 38).otherwise(37)
    known = v.select("ds", build.alias("build")).distinct()
    hits = ranges.folded(v.where(build == 37), asked, ["gid"], group="ds").groupBy("gid", "ds").agg(F.sum("n").alias("n"))
    every = asked.select("gid").join(F.broadcast(known))  # a row for each question and dataset is the report
    state = F.when(F.col("build") == 37, "compared").otherwise("not compared")
    return every.join(hits, ["gid", "ds"], "left").select("gid", "ds", "build", state.alias("state"), F.coalesce("n", F.lit(0).cast("long")).alias("n"))


# ---- aggregates -------------------------------------------------------------------------------


@query("a02_panel_lead", """, p AS (SELECT DISTINCT chr, pos FROM v WHERE ds = 0), i AS (SELECT l.locus, v.* FROM v JOIN loci l ON v.chr = l.chr AND v.pos BETWEEN l."start" AND l."end" WHERE (v.chr, v.pos) IN (SELECT (chr, pos) FROM p))
  SELECT locus, arg_min(vid, (-round(z, 9), pos, vid)) AS lead, count(*) AS n_rows FROM i GROUP BY locus""", "v loci")  # fmt: skip
def a02(spark: SparkSession, d: str) -> DataFrame:
    """The strongest row of each locus among positions that the panel has."""
    v = variants(spark, d)
    matched = v.join(v.where("ds = 0").select("chr", "pos").distinct(), ["chr", "pos"], "left_semi")
    return loci.lead_by_locus(matched, loci.seed_loci(v)).select("locus", "lead", "n_rows")


@query("a07_unique_variants", 'SELECT l.locus, count(DISTINCT v.pos) AS n_positions, count(DISTINCT v.ds) AS n_datasets FROM v JOIN loci l ON v.chr = l.chr AND v.pos BETWEEN l."start" AND l."end" GROUP BY l.locus', "v loci")
def a07(spark: SparkSession, d: str) -> DataFrame:
    inside = ranges.points_in(variants(spark, d), spans(spark, d)).select("locus", "pos", "ds")
    return inside.groupBy("locus").agg(F.count_distinct("pos").alias("n_positions"), F.count_distinct("ds").alias("n_datasets"))


@query("a08_merged_aggregates", """, s AS (SELECT ds, chr, pos, max(z) AS z FROM v WHERE z > 5.4513e0 GROUP BY 1, 2, 3),
  a AS (SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY ds, chr ORDER BY pos) <= 250000 THEN 0 ELSE 1 END AS f FROM s), b AS (SELECT *, sum(f) OVER (PARTITION BY ds, chr ORDER BY pos) AS isl FROM a),
  o AS (SELECT ds, chr, isl, min(pos) AS s, max(pos) AS e, count(*) AS n, max(z) AS z FROM b GROUP BY ds, chr, isl),
  m AS (SELECT *, CASE WHEN s > max(e) OVER (PARTITION BY chr ORDER BY s, e, ds ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 250000 OR lag(s) OVER (PARTITION BY chr ORDER BY s, e, ds) IS NULL THEN 1 ELSE 0 END AS f FROM o),
  k AS (SELECT *, sum(f) OVER (PARTITION BY chr ORDER BY s, e, ds ROWS UNBOUNDED PRECEDING) AS isl2 FROM m)
  SELECT chr, min(s) AS "start", max(e) AS "end", CAST(sum(n) AS BIGINT) AS n_seeds, count(*) AS n_members, count(DISTINCT ds) AS n_datasets, round(max(z), 6) AS top FROM k GROUP BY chr, isl2""", "v")  # fmt: skip
def a08(spark: SparkSession, d: str) -> DataFrame:
    """Loci of each dataset, merged over datasets with their members counted."""
    seeds = variants(spark, d).where(F.col("z") > loci.GENOME_WIDE).groupBy("ds", "chr", "pos").agg(F.max("z").alias("z"))
    w = Window.partitionBy("ds", "chr").orderBy("pos")
    fresh = F.when(F.col("pos") - F.lag("pos").over(w) <= 250_000, 0).otherwise(1)
    own = seeds.withColumn("_f", fresh).withColumn("isl", F.sum("_f").over(w)).groupBy("ds", "chr", "isl").agg(F.min("pos").alias("start"), F.max("pos").alias("end"), F.count("*").alias("n"), F.max("z").alias("z"))
    merged = loci.islands(own.drop("isl"), 250_000).groupBy("chr", "island")
    return merged.agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n").alias("n_seeds"), F.count("*").alias("n_members"), F.count_distinct("ds").alias("n_datasets"), F.round(F.max("z"), 6).alias("top")).drop("island")


@query("a20_consistent_loci", """, h AS (SELECT locus, ds % 2 AS category, count(*) AS a FROM dl WHERE n_suggestive > 0 GROUP BY 1, 2), z AS (SELECT ds % 2 AS category, count(DISTINCT ds) AS size FROM v GROUP BY 1),
  t AS (SELECT locus, category, a, size - a AS b, sum(a) OVER (PARTITION BY locus) - a AS c, (SELECT sum(size) FROM z) - size - sum(a) OVER (PARTITION BY locus) + a AS d FROM h JOIN z USING (category)),
  s AS (SELECT locus, category, a, CAST(b AS BIGINT) AS b, CAST(c AS BIGINT) AS c, CAST(d AS BIGINT) AS d FROM t WHERE a >= 2 AND a >= b AND a * (c + d) > c * (a + b)),
  w AS (SELECT *, list_transform(range(greatest(0, a - d), least(a + b, a + c) + 1), lambda x: -(lgamma(x + 1e0) + lgamma(a + b - x + 1e0) + lgamma(a + c - x + 1e0) + lgamma(d - a + x + 1e0))) AS logs,
    -(lgamma(a + 1e0) + lgamma(b + 1e0) + lgamma(c + 1e0) + lgamma(d + 1e0)) AS own FROM s),
  p AS (SELECT locus, category, a, b, c, d, round(list_sum(list_transform(list_filter(logs, lambda x: x <= own + 1e-9), lambda x: exp(x - own))) / list_sum(list_transform(logs, lambda x: exp(x - own))), 6) AS p FROM w)
  SELECT *, p < 0.05e0 AS significant FROM p ORDER BY p, category, locus LIMIT 25""", "v loci dl")  # fmt: skip
def a20(spark: SparkSession, d: str) -> DataFrame:
    """Loci that a category of datasets shares: at least two of it, half of it, more than outside, exact p < .05; 25 at most."""
    v = variants(spark, d)
    hit = loci.dataset_by_locus(v, loci.seed_loci(v)).select("locus", "ds", (F.col("n_suggestive") > 0).alias("hit"))
    sizes = v.select("ds").distinct().groupBy((F.col("ds") % 2).alias("category")).agg(F.count("*").alias("size"))
    own = hit.where("hit").groupBy("locus", (F.col("ds") % 2).alias("category")).agg(F.count("*").alias("a"))
    total = own.groupBy("locus").agg(F.sum("a").alias("hits"))
    t = own.join(total, "locus").join(F.broadcast(sizes), "category").join(F.broadcast(sizes.agg(F.sum("size").alias("all"))))
    t = t.select("locus", "category", "a", (F.col("size") - F.col("a")).alias("b"), (F.col("hits") - F.col("a")).alias("c"), (F.col("all") - F.col("size") - F.col("hits") + F.col("a")).alias("d"))
    shared = t.where((F.col("a") >= 2) & (F.col("a") >= F.col("b")) & (F.col("a") * (F.col("c") + F.col("d")) > F.col("c") * (F.col("a") + F.col("b"))))
    p = F.round(S.fisher_two_sided(*(F.col(x) for x in "abcd")), 6)
    return shared.withColumn("p", p).withColumn("significant", F.col("p") < 0.05).orderBy("p", "category", "locus").limit(25)


VIEW["e"] = """o AS (SELECT k.peak, g.gid, CASE WHEN k."end" < g."start" THEN 1 ELSE 0 END AS pro FROM k JOIN g ON k.chr = g.chr AND k."end" >= g."start" - 2000 AND k."start" <= g."end"),
e AS (SELECT k.*, CASE WHEN n IS NULL THEN 'intergenic' WHEN pro = 1 THEN 'promoter' ELSE 'genic' END AS class FROM k LEFT JOIN (SELECT peak, max(pro) AS pro, count(*) AS n FROM o GROUP BY peak) USING (peak))"""


@query("a26_region_classes", """SELECT l.locus, CASE WHEN count(*) FILTER (e.class = 'promoter') > 0 THEN 'promoter' WHEN count(*) FILTER (e.class = 'genic') >= count(*) FILTER (e.class = 'intergenic') THEN 'genic' ELSE 'intergenic' END AS class, count(*) AS n
  FROM loci l JOIN e ON l.chr = e.chr AND l."start" <= e."end" AND l."end" >= e."start" GROUP BY l.locus""", "v loci g k e")  # fmt: skip
def a26(spark: SparkSession, d: str) -> DataFrame:
    """A region with a promoter is one; else genic where genic elements are no fewer than the others."""
    g = genes(spark, d).select("gid", "chr", (F.col("start") - 2000).alias("start"), "end")
    k = peaks(spark, d).select("peak", "chr", "start", "end")
    near = ranges.overlapping(k, g).groupBy("peak").agg(F.max(F.when(F.col("end") < F.col("start_b") + 2000, 1).otherwise(0)).alias("pro"))
    classed = k.join(near, "peak", "left").withColumn("class", F.when(F.col("pro").isNull(), "intergenic").when(F.col("pro") == 1, "promoter").otherwise("genic"))
    found = ranges.overlapping(spans(spark, d), classed.select("chr", "start", "end", "class"))
    n = lambda c: F.count_if(F.col("class_b") == c)
    return found.groupBy("locus").agg(F.when(n("promoter") > 0, "promoter").when(n("genic") >= n("intergenic"), "genic").otherwise("intergenic").alias("class"), F.count("*").alias("n"))


@query("a30_recovery_rate", """, db AS (SELECT DISTINCT chr, pos, ea, nea FROM v WHERE ds = 0), m AS (SELECT ds, EXISTS (SELECT 1 FROM db WHERE db.chr = v.chr AND db.pos = v.pos AND least(db.ea, db.nea) = least(v.ea, v.nea) AND greatest(db.ea, db.nea) = greatest(v.ea, v.nea)) AS hit FROM v WHERE ds > 0)
  SELECT ds, count(*) AS n, count(*) FILTER (hit) AS n_recovered, round(100e0 * count(*) FILTER (hit) / count(*), 4) AS percent FROM m GROUP BY ds""", "v")  # fmt: skip
def a30(spark: SparkSession, d: str) -> DataFrame:
    """The share of rows whose position and alleles, in either order, are known."""
    v = variants(spark, d).withColumn("lo", F.least("ea", "nea")).withColumn("hi", F.greatest("ea", "nea"))
    known = v.where("ds = 0").select("chr", "pos", "lo", "hi").distinct().withColumn("hit", F.lit(True))
    m = v.where("ds > 0").join(known, ["chr", "pos", "lo", "hi"], "left")
    hits = F.count("hit")
    return m.groupBy("ds").agg(F.count("*").alias("n"), hits.alias("n_recovered"), F.round(hits * 100.0 / F.count("*"), 4).alias("percent"))


@query("a34_joint_runs", """, r AS (SELECT user_id % 40 AS locus, event_id % 2 AS mode, event_type AS disease, arg_max(value, (ts, event_id)) AS v FROM events GROUP BY 1, 2, 3)
  SELECT disease, count(*) AS n_runs, count(*) FILTER (v >= 20) AS n_ok, count(*) FILTER (v >= 50) AS n_with_sets, count(*) FILTER (v >= 50 AND v < 80) AS n_single FROM r GROUP BY disease""")  # fmt: skip
def a34(spark: SparkSession, d: str) -> DataFrame:
    """The latest joint run of each locus, mode and disease (events stand for runs), summed up by disease."""
    e = table(spark, d, "events").select((F.col("user_id") % 40).alias("locus"), (F.col("event_id") % 2).alias("mode"), F.col("event_type").alias("disease"), "ts", "event_id", "value")
    last = e.groupBy("locus", "mode", "disease").agg(F.max_by("value", F.struct("ts", "event_id")).alias("v"))
    return last.groupBy("disease").agg(
        F.count("*").alias("n_runs"), F.count_if(F.col("v") >= 20).alias("n_ok"), F.count_if(F.col("v") >= 50).alias("n_with_sets"), F.count_if((F.col("v") >= 50) & (F.col("v") < 80)).alias("n_single")
    )


@query("a35_locus_genes", """, lp AS (SELECT dl.locus, dl.ds, v.chr, v.pos FROM dl JOIN v ON v.vid = dl.lead AND v.ds = dl.ds), x AS (SELECT lp.locus, lp.ds, g.gid, greatest(0, g."start" - lp.pos, lp.pos - g."end") AS d, CASE WHEN g."start" > lp.pos THEN 1 ELSE 0 END AS rt, g."start", g."end" FROM (SELECT DISTINCT * FROM lp) lp JOIN g USING (chr)),
  y AS (SELECT *, row_number() OVER (PARTITION BY locus, ds ORDER BY d, rt, CASE WHEN rt = 1 THEN "start" ELSE -"end" END, gid) AS k FROM x) SELECT locus, gid, count(*) AS votes, min(d) AS distance FROM y WHERE k = 1 GROUP BY locus, gid""", "v loci dl g")  # fmt: skip
def a35(spark: SparkSession, d: str) -> DataFrame:
    """The nearest gene of each dataset's lead in a locus: votes of datasets and least distance."""
    v = variants(spark, d)
    order = F.struct((-F.round("z", 9)).alias("s"), F.col("pos"), F.col("vid"))
    leads = ranges.points_in(v, spans(spark, d)).groupBy("locus", "chr", "ds").agg(F.min_by("pos", order).alias("pos"))
    near = ranges.nearest(leads, genes(spark, d), "gid").where("near is not null")
    return near.groupBy("locus", F.col("near").alias("gid")).agg(F.count("*").alias("votes"), F.min("distance").alias("distance"))


@query("a36_locus_to_gene", 'SELECT g.gid, round(max(c.mlogp), 6) AS score, count(DISTINCT c.trait) AS n_studies FROM c JOIN g ON c.chr = g.chr AND c.pos BETWEEN g."start" AND g."end" GROUP BY g.gid', "c g")
def a36(spark: SparkSession, d: str) -> DataFrame:
    """The best score of each gene and the number of studies that support it."""
    found = ranges.folded(catalog(spark, d), genes(spark, d), ["gid"], tops=["mlogp"], group="trait")
    return found.groupBy("gid").agg(F.round(F.max("mlogp"), 6).alias("score"), F.count_distinct("trait").alias("n_studies"))


# ---- windows and sets -------------------------------------------------------------------------


@query("w08_nearest_panel_position", """, h AS (SELECT l.*, arg_min(c.pos, (-c.mlogp, c.cid)) AS lead FROM loci l JOIN c ON l.chr = c.chr AND c.pos BETWEEN l."start" AND l."end" GROUP BY ALL), p AS (SELECT DISTINCT chr, pos FROM v WHERE ds = 0)
  SELECT h.locus, h.lead, arg_min(p.pos, (abs(p.pos - h.lead), p.pos)) AS at, min(abs(p.pos - h.lead)) AS off FROM h JOIN p ON p.chr = h.chr AND p.pos BETWEEN h."start" AND h."end" GROUP BY 1, 2""", "v c loci")  # fmt: skip
def w08(spark: SparkSession, d: str) -> DataFrame:
    """The panel position of each locus's best catalogue hit: the same one, else the nearest within the locus."""
    places = spans(spark, d)
    best = ranges.points_in(catalog(spark, d), places).groupBy(*SPANS).agg(F.min_by("pos", F.struct((-F.col("mlogp")).alias("m"), "cid")).alias("lead"))
    panel = variants(spark, d).where("ds = 0").select("chr", "pos").distinct()
    off = F.abs(F.col("pos") - F.col("lead"))
    return ranges.points_in(panel, best).groupBy("locus", "lead").agg(F.min_by("pos", F.struct(off.alias("o"), F.col("pos"))).alias("at"), F.min(off).alias("off"))


@query("w17_best_runs", "SELECT event_type, user_id % 40 AS locus, arg_max(event_id, (ts, event_id)) AS run, count(*) AS n FROM events WHERE value >= 20 GROUP BY 1, 2")
def w17(spark: SparkSession, d: str) -> DataFrame:
    """The latest successful run of each tool at each locus."""
    ok = table(spark, d, "events").where("value >= 20")
    return ok.groupBy("event_type", (F.col("user_id") % 40).alias("locus")).agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("run"), F.count("*").alias("n"))


@query("u05_gene_sets", """, f AS (SELECT DISTINCT g.gid FROM g JOIN loci l ON g.chr = l.chr AND g."start" <= l."end" AND g."end" >= l."start")
  SELECT brand, count(*) AS n_background, count(*) FILTER (gid IN (SELECT gid FROM f)) AS n_foreground FROM g GROUP BY brand""", "v loci g")  # fmt: skip
def u05(spark: SparkSession, d: str) -> DataFrame:
    """Genes in loci against all genes, which hold them."""
    g = genes(spark, d).select("gid", "chr", "start", "end", "brand")
    inside = ranges.overlapping(g.select("gid", "chr", "start", "end"), spans(spark, d)).select("gid").distinct().withColumn("fg", F.lit(True))
    return g.join(inside, "gid", "left").groupBy("brand").agg(F.count("*").alias("n_background"), F.count("fg").alias("n_foreground"))


# ---- scalar expressions -----------------------------------------------------------------------


@query("m09_residual_p", f"SELECT vid, round(-log10({erfc_sql('sqrt(z * z / 2e0)')}), 6) + 0e0 AS neglog10p FROM v", "v")
def m09(spark: SparkSession, d: str) -> DataFrame:
    """The upper tail of chi-square with one degree of freedom, exact."""
    return variants(spark, d).select("vid", (F.round(S.neglog10(S.erfc(F.sqrt(F.col("z") * F.col("z") / 2))), 6) + 0.0).alias("neglog10p"))


@query("m12_feature_defaults", "SELECT gid, round(ln(1e0 + coalesce(CASE WHEN gid % 3 > 0 THEN size END, 30)), 6) AS log_score, coalesce(CASE WHEN gid % 4 > 0 THEN size / 10e0 END, 2e0) AS deleteriousness, coalesce(CASE WHEN gid % 5 > 0 THEN 1e0 END, 0.5e0) AS direction FROM g", "g")
def m12(spark: SparkSession, d: str) -> DataFrame:
    missing = lambda k, value, default: F.coalesce(F.when(F.col("gid") % k > 0, value), F.lit(default))
    return genes(spark, d).select("gid", F.round(F.log1p(missing(3, F.col("size"), 30).cast("double")), 6).alias("log_score"), missing(4, F.col("size") / 10.0, 2.0).alias("deleteriousness"), missing(5, F.lit(1.0), 0.5).alias("direction"))


@query("m14_half_up", "SELECT vid, floor(round(beta, 9) * 1e4 + 0.5e0) / 1e4 AS shown FROM v WHERE z > 4.0556e0", "v")
def m14(spark: SparkSession, d: str) -> DataFrame:
    return variants(spark, d).where(F.col("z") > loci.SUGGESTIVE).select("vid", S.round4(F.round("beta", 9)).alias("shown"))


@query("x05_parsed_properties", "SELECT event_type, count(*) AS n, CAST(sum(CAST(props ->> 'k' AS BIGINT)) AS BIGINT) AS k FROM events GROUP BY event_type")
def x05(spark: SparkSession, d: str) -> DataFrame:
    k = F.from_json("props", "k long")["k"]
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(k).alias("k"))


@query("x08_category_map", "SELECT p_brand AS brand, count(*) FILTER (p_size > 25) AS big, count(*) FILTER (p_size <= 25) AS small FROM part GROUP BY p_brand")
def x08(spark: SparkSession, d: str) -> DataFrame:
    """Categories held as a map on each row, read by key."""
    kind = F.when(F.col("size") > 25, "big").otherwise("small")
    g = genes(spark, d).select(F.map_from_arrays(F.array(F.lit("brand"), F.lit("kind")), F.array("brand", kind)).alias("m"))
    return g.groupBy(F.col("m")["brand"].alias("brand")).agg(F.count_if(F.col("m")["kind"] == "big").alias("big"), F.count_if(F.col("m")["kind"] == "small").alias("small"))


# ---- coordinates and reports ------------------------------------------------------------------


@query("s22_offset_coordinates", """SELECT peak, "start" + 1000 + chr AS start_b, "end" + 1000 + chr - peak % 3 AS end_b FROM k""", "k")
def s22(spark: SparkSession, d: str) -> DataFrame:
    """A second build's coordinates, held as differences and read back (S13 is the reading half)."""
    k = peaks(spark, d).withColumn("start_b", F.col("start") + 1000 + F.col("chr")).withColumn("end_b", F.col("end") + 1000 + F.col("chr") - F.col("peak") % 3)
    held = k.select("peak", "start", "end", (F.col("start_b") - F.col("start")).alias("d"), ((F.col("end_b") - F.col("start_b")) - (F.col("end") - F.col("start"))).alias("dlen"))
    first = F.col("start") + F.col("d")
    return held.select("peak", first.alias("start_b"), (first + F.col("end") - F.col("start") + F.col("dlen")).alias("end_b"))


@query("s27_extra_columns", "SELECT v.vid, c2.trait, c2.mlogp FROM v LEFT JOIN (SELECT chr, pos, arg_min(trait, cid) AS trait, arg_min(mlogp, cid) AS mlogp FROM c GROUP BY chr, pos) c2 ON c2.chr = v.chr AND c2.pos = v.pos WHERE v.z > 5.4513e0", "v c")
def s27(spark: SparkSession, d: str) -> DataFrame:
    """Columns of another file, by position, for significant rows; its first row counts."""
    extra = catalog(spark, d).groupBy("chr", "pos").agg(F.min_by(F.struct("trait", "mlogp"), "cid").alias("x"))
    v = variants(spark, d).where(F.col("z") > loci.GENOME_WIDE).select("vid", "chr", "pos")
    return v.join(extra, ["chr", "pos"], "left").select("vid", "x.trait", "x.mlogp")


@query("s29_catalogue_report", 'SELECT l.locus, l.chr, l."start", l."end", c.rsid, c.trait, c.mlogp FROM loci l LEFT JOIN c ON l.chr = c.chr AND c.pos BETWEEN l."start" AND l."end"', "v c loci")
def s29(spark: SparkSession, d: str) -> DataFrame:
    """A row for each locus and hit; a locus without hits has one."""
    places = spans(spark, d)
    hits = ranges.points_in(catalog(spark, d), places).select("locus", "rsid", "trait", "mlogp")
    return places.join(hits, "locus", "left").select(*SPANS, "rsid", "trait", "mlogp")


@query("p07_single_seed_clumps", "SELECT chr, pos, max(z) > 5.4513e0 AS seed, count(*) AS n FROM v WHERE z > 4.0556e0 GROUP BY chr, pos", "v")
def p07(spark: SparkSession, d: str) -> DataFrame:
    """Without linkage every seed is a clump of one."""
    best = variants(spark, d).where(F.col("z") > loci.SUGGESTIVE).groupBy("chr", "pos").agg(F.max("z").alias("z"), F.count("*").alias("n"))
    return best.select("chr", "pos", (F.col("z") > loci.GENOME_WIDE).alias("seed"), "n")


@query("p27_override", "SELECT c.cid, CASE WHEN p.p_partkey IS NULL THEN c.rsid ELSE 'rs' || p.p_size END AS rsid, p.p_partkey IS NOT NULL AS manual FROM c LEFT JOIN part p ON p.p_partkey = c.cid", "c")
def p27(spark: SparkSession, d: str) -> DataFrame:
    """Identifiers given by hand win over those found."""
    given = genes(spark, d).select(F.col("gid").alias("cid"), F.concat(F.lit("rs"), F.col("size").cast("string")).alias("given"))
    return catalog(spark, d).join(given, "cid", "left").select("cid", F.coalesce("given", "rsid").alias("rsid"), F.col("given").isNotNull().alias("manual"))
