"""Fixed queries on the linkage of regions, builds and matched null sets."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lociform.functions import scalar as S
from lociform.operators import genes as gene_programs
from lociform.operators import liftover, loci, permutation, programs, ranges, regional
from lociform.plans.queries import query
from lociform.plans.regions import SPANS, a36, spans
from lociform.sources.tables import dosages, genes, peaks, variants

# ---- builds -----------------------------------------------------------------------------------


def blocks(spark: SparkSession, d: str) -> DataFrame:
    """Simulated alignment: 100,000 positions a block, every seventh missing, every fifth reversed."""
    b = spark.range(100).select(F.col("id").alias("b")).join(F.broadcast(spark.range(1, 23).select(F.col("id").cast("int").alias("chr"))))
    start = F.col("b") * 100_000 + 1
    chosen = b.where((F.col("b") + F.col("chr")) % 7 != 0)
    return chosen.select(
        F.lit("1").alias("chain"), F.lit(1.0).alias("score"), "chr", start.alias("start"), (start + 99_999).alias("end"), F.col("chr").alias("chr_to"),
        F.when(F.col("b") % 5 == 0, 20_000_000 - start - 99_999 + 1).otherwise(start + 5000).alias("start_to"), F.lit(20_000_000).cast("long").alias("size_to"), F.when(F.col("b") % 5 == 0, "-").otherwise("+").alias("strand_to"),
    )


@query("j31_lifted_positions", """, x AS (SELECT DISTINCT chr, pos, (pos - 1) // 100000 AS b FROM v)
  SELECT chr, pos, CASE WHEN (b + chr) % 7 <> 0 THEN CASE WHEN b % 5 = 0 THEN b * 100000 + 100000 - (pos - b * 100000 - 1) ELSE pos + 5000 END END AS pos_to, CASE WHEN (b + chr) % 7 <> 0 THEN 'mapped' ELSE 'unmapped' END AS state FROM x""", "v")  # fmt: skip
def j31(spark: SparkSession, d: str) -> DataFrame:
    points = variants(spark, d).select("chr", "pos").distinct().withColumn("key", F.col("chr").cast("long") * 100_000_000 + F.col("pos"))
    return liftover.lift_points(points, blocks(spark, d), "key").select("chr", "pos", "pos_to", "state")


@query("j31b_lifted_genes", """, x AS (SELECT *, ("start" - 1) // 100000 AS b, ("end" - 1) // 100000 AS c FROM g),
  y AS (SELECT gid, x.chr, i AS b, greatest("start", i * 100000 + 1) AS l, least("end", i * 100000 + 100000) AS r, "end" - "start" + 1 AS n FROM x, range(0, 100) t(i) WHERE i BETWEEN b AND c AND (i + x.chr) % 7 <> 0),
  z AS (SELECT gid, n, r - l + 1 AS m, CASE WHEN b % 5 = 0 THEN b * 200000 + 100001 - r ELSE l + 5000 END AS s, CASE WHEN b % 5 = 0 THEN b * 200000 + 100001 - l ELSE r + 5000 END AS e FROM y),
  w AS (SELECT gid, min(s) AS s, max(e) AS e, CAST(sum(m) AS DOUBLE) / min(n) AS cover FROM z GROUP BY gid)
  SELECT g.gid, CASE WHEN cover >= 0.95e0 THEN s END AS start_to, CASE WHEN cover >= 0.95e0 THEN e END AS end_to, round(coalesce(cover, 0e0), 6) AS cover, CASE WHEN cover >= 0.95e0 THEN 'mapped' ELSE 'unmapped' END AS state FROM g LEFT JOIN w USING (gid)""", "g")  # fmt: skip
def j31b(spark: SparkSession, d: str) -> DataFrame:
    """Genes lifted as one interval each."""
    lifted = liftover.lift_regions(genes(spark, d).select("gid", "chr", "start", "end"), blocks(spark, d), "gid")
    return lifted.select("gid", "start_to", "end_to", F.round("cover", 6).alias("cover"), "state")


# ---- matched null sets ------------------------------------------------------------------------


@query("p20_matched_null", """, l AS (SELECT CAST(chr AS BIGINT) * 100000000 + pos AS id, chr, pos FROM (SELECT DISTINCT chr, pos FROM v WHERE z > 5.4513e0)), u AS (SELECT DISTINCT chr, "start" AS pos FROM g),
  t AS (SELECT row_number() OVER (ORDER BY chr, pos) - 1 AS number, chr, pos FROM u), nt AS (SELECT count(*) AS n FROM t),
  o AS (SELECT id, arg_min(l.pos - t.pos, (abs(l.pos - t.pos), t.pos)) AS off FROM l JOIN t USING (chr) GROUP BY id),
  q AS (SELECT id, s, t.chr, t.pos + off AS pos FROM o, range(1, 1001) r(s), nt, t WHERE t.number = (id % 1000003 * 7919 + s * 104729 + id % 9973 * s) % nt.n),
  m AS (SELECT * FROM (VALUES ('inside', 0), ('kb1', 1000), ('kb10', 10000)) x("limit", reach)), ks AS (SELECT chr, "start", "end" FROM k WHERE eid = 1),
  c AS (SELECT "limit", s, count(*) AS c FROM q, m WHERE EXISTS (SELECT 1 FROM ks WHERE ks.chr = q.chr AND q.pos BETWEEN ks."start" - reach AND ks."end" + reach) GROUP BY 1, 2),
  ob AS (SELECT "limit", count(*) AS observed FROM l, m WHERE EXISTS (SELECT 1 FROM ks WHERE ks.chr = l.chr AND l.pos BETWEEN ks."start" - reach AND ks."end" + reach) GROUP BY 1)
  SELECT m."limit", coalesce(observed, 0) AS observed, round(coalesce(sum(c), 0) / 1000e0, 6) AS expected, round((1 + CASE WHEN coalesce(observed, 0) = 0 THEN 1000 ELSE count(*) FILTER (c >= observed) END) / 1001e0, 6) AS p FROM m LEFT JOIN ob USING ("limit") LEFT JOIN c USING ("limit") GROUP BY 1, 2""", "v g k")  # fmt: skip
def p20(spark: SparkSession, d: str) -> DataFrame:
    """Significant positions near elements of one cell type against a thousand sets matched by distance to gene starts."""
    points = variants(spark, d).where(F.col("z") > loci.GENOME_WIDE).select("chr", "pos").distinct().withColumn("id", F.col("chr").cast("long") * 100_000_000 + F.col("pos"))
    draw = lambda k, s, n: (k % 1_000_003 * 7919 + s * 104_729 + k % 9973 * s) % n  # noqa: E731 - what both engines compute alike
    starts, elements = genes(spark, d).select("chr", F.col("start").alias("pos")), peaks(spark, d).where("eid = 1").select("chr", "start", "end")
    out = permutation.matched_null(points, "id", starts, elements, {"inside": 0, "kb1": 1000, "kb10": 10_000}, 1000, draw)
    return out.withColumn("expected", F.round("expected", 6)).withColumn("p", F.round("p", 6))


# ---- linkage ----------------------------------------------------------------------------------


@query("p01_lead_linkage", ", l AS (SELECT i // 50 AS region, min(i) AS lead FROM nor GROUP BY 1) SELECT region, lead, b.i AS variant, round(list_dot_product(a.d, b.d) * list_dot_product(a.d, b.d), 6) AS r2 FROM l JOIN nor a ON a.i = l.lead JOIN nor b ON b.i // 50 = l.region", "ld")
def p01(spark: SparkSession, d: str) -> DataFrame:
    """Squared correlation of each variant with the lead of its region of fifty."""
    c = programs.centred(dosages(spark, d), "d").withColumn("region", F.floor(F.col("i") / 50).cast("long"))
    lead = c.groupBy("region").agg(F.min_by(F.struct("i", "d"), "i").alias("l"))
    r = F.aggregate(F.zip_with("d", "l.d", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return c.join(lead, "region").select("region", F.col("l.i").alias("lead"), F.col("i").alias("variant"), F.round(r * r, 6).alias("r2"))


@query("p03_region_triangle", """, x AS (SELECT i, (i * 37 % 101) AS s FROM nor), k AS (SELECT *, row_number() OVER (PARTITION BY i // 50 ORDER BY s DESC, i) AS k FROM x), n AS (SELECT i, i // 50 AS region, row_number() OVER (PARTITION BY i // 50 ORDER BY i) AS number FROM k WHERE k <= 300)
  SELECT a.region, a.number AS row_a, b.number AS row_b, round(list_dot_product(x.d, y.d), 6) AS r FROM n a JOIN n b ON a.region = b.region AND a.number < b.number JOIN nor x ON x.i = a.i JOIN nor y ON y.i = b.i""", "ld")  # fmt: skip
def p03(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of the 300 strongest variants of each region, numbered by place (the drawn triangle's limit)."""
    c = programs.centred(dosages(spark, d), "d").where("d is not null").select("i", "d", F.floor(F.col("i") / 50).cast("long").alias("region"), (F.col("i") * 37 % 101).alias("s"))
    t = regional.thinned_places(c, ["region"], "i", [F.desc("s"), F.col("i")], 300)
    a, b = t.select("region", F.col("number").alias("row_a"), "d"), t.select("region", F.col("number").alias("row_b"), F.col("d").alias("e"))
    r = F.aggregate(F.zip_with("d", "e", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return a.join(b, "region").where("row_a < row_b").select("region", "row_a", "row_b", F.round(r, 6).alias("r"))


@query("p04_disequilibrium", """, q AS (SELECT i, list_transform(d, lambda x: CASE WHEN x > 0.15e0 THEN 2e0 WHEN x > -0.15e0 THEN 1e0 ELSE 0e0 END) AS g FROM nor), p AS (SELECT a.i, b.i AS j, list_avg(a.g) AS mx, list_avg(b.g) AS my, list_dot_product(a.g, b.g) / 64 AS xy, list_dot_product(a.g, a.g) / 64 AS xx, list_dot_product(b.g, b.g) / 64 AS yy FROM q a JOIN q b ON b.i = a.i + 1),
  c AS (SELECT i, j, mx / 2 AS p, my / 2 AS q, xy - mx * my AS c, xx - mx * mx AS vx, yy - my * my AS vy FROM p)
  SELECT i, j, round(c / sqrt(vx * vy), 6) AS r, round(c * c / (vx * vy), 6) AS r2, round(least(1e0, abs(c / 2) / CASE WHEN c >= 0 THEN least(p * (1 - q), (1 - p) * q) ELSE least(p * q, (1 - p) * (1 - q)) END), 6) AS d_prime FROM c""", "ld")  # fmt: skip
def p04(spark: SparkSession, d: str) -> DataFrame:
    """Signed r, r squared and D' of neighbouring variants' genotypes, called from the dosages."""
    call = lambda x: F.when(x > 0.15, 2.0).when(x > -0.15, 1.0).otherwise(0.0)
    g = programs.centred(dosages(spark, d), "d").select("i", F.transform("d", call).alias("g"))
    pairs = g.join(g.select((F.col("i") - 1).alias("i"), F.col("i").alias("j"), F.col("g").alias("h")), "i")
    r, r2, d_prime = regional.disequilibrium(pairs, "g", "h")
    return pairs.select("i", "j", F.round(r, 6).alias("r"), F.round(r2, 6).alias("r2"), F.round(d_prime, 6).alias("d_prime"))


def simulated(spark: SparkSession, d: str, width: int) -> DataFrame:
    """Regions of `width` variants with dosages; every seventeenth has an effect, which the three on either side share by linkage."""
    off = F.least(F.col("i") % 17, 17 - F.col("i") % 17)
    z = F.greatest(F.lit(0.0), 8 - 2.0 * off) + (F.col("i") * 37 % 41 - 20) / 25.0
    return dosages(spark, d).select(F.floor(F.col("i") / width).cast("long").alias("locus"), F.col("i").alias("variant"), z.alias("z"), F.col("d").alias("dosages"))


@query("p09_independent_signals")
def p09(spark: SparkSession, d: str) -> DataFrame:
    """Stepwise conditional selection in windows of fifty."""
    out = regional.independent_signals(simulated(spark, d, 50), "locus", 10_000)
    return out.withColumn("chi2", F.round("chi2", 5)).withColumn("joint_chi2", F.round("joint_chi2", 5))


@query("p14_local_heritability")
def p14(spark: SparkSession, d: str) -> DataFrame:
    out = regional.heritability_by_region(simulated(spark, d, 100), "locus", 10_000.0)
    return out.withColumn("h2", F.round("h2", 7)).withColumn("se", F.round("se", 7))


@query("a31_gene_tests")
def a31(spark: SparkSession, d: str) -> DataFrame:
    """Linked variants of windows of ten tested together."""
    out = gene_programs.gene_tests(simulated(spark, d, 10).withColumnsRenamed({"locus": "gene", "variant": "pos"}))
    return out.select(F.col("gene").alias("locus"), "n_variants", F.round(F.col("statistic") / F.col("n_variants"), 6).alias("mean_chi2"), F.round(-F.col("log_p") / math.log(10), 5).alias("neglog10p"))


@query("p13_gene_sets", """, s AS (SELECT g.gid, g.brand, round(max(c.mlogp), 6) AS s FROM c JOIN g ON c.chr = g.chr AND c.pos BETWEEN g."start" AND g."end" GROUP BY 1, 2), t AS (SELECT count(*) AS nn, sum(s) AS t, sum(s * s) AS tq FROM s), o AS (SELECT brand, count(*) AS n, sum(s) AS a FROM s GROUP BY brand),
  x AS (SELECT brand, n, nn, a / n - (t - a) / (nn - n) AS difference, tq - a * a / n - (t - a) * (t - a) / (nn - n) AS w FROM o, t WHERE n > 1 AND nn - n > 1) SELECT brand, n, round(difference, 6) AS difference, round(difference / sqrt(w / (nn - 2) * (1e0 / n + 1e0 / (nn - n))), 6) AS t FROM x""", "c g")  # fmt: skip
def p13(spark: SparkSession, d: str) -> DataFrame:
    """Scores of a set's genes against those of all others."""
    scored = a36(spark, d)
    out = regional.gene_set_tests(scored, genes(spark, d).select("gid", "brand"), "gid", "brand", "score")
    return out.withColumn("difference", F.round("difference", 6)).withColumn("t", F.round("t", 6))


@query("u02_shared_datasets", """, sets AS (SELECT s, count(*) AS n FROM (SELECT list_sort(list(DISTINCT ds)) AS s FROM v GROUP BY chr, pos) GROUP BY s), ord AS (SELECT ds, row_number() OVER (ORDER BY round(max(z), 9) DESC, ds) AS k FROM v GROUP BY ds),
  r(k, kept, least) AS (SELECT k, [ds], greatest(300e0, 0.1e0 * (SELECT sum(n) FROM sets WHERE list_contains(s, ds))) FROM ord WHERE k = 1
    UNION ALL SELECT o.k, CASE WHEN (SELECT coalesce(sum(n), 0) FROM sets WHERE list_has_all(s, list_append(r.kept, o.ds))) >= r.least THEN list_append(r.kept, o.ds) ELSE r.kept END, r.least FROM r JOIN ord o ON o.k = r.k + 1)
  SELECT CAST(step AS INT) AS step, kept[step] AS ds FROM (SELECT kept, unnest(range(1, len(kept) + 1)) AS step FROM r WHERE k = (SELECT max(k) FROM ord))""", "v")  # fmt: skip
def u02(spark: SparkSession, d: str) -> DataFrame:
    """Datasets kept together, the strongest first, and their order."""
    v = variants(spark, d)
    order = [r.ds for r in v.groupBy("ds").agg(F.round(F.max("z"), 9).alias("z")).orderBy(F.desc("z"), "ds").collect()]  # a row for each dataset
    kept = regional.shared_datasets(v, "ds", ["chr", "pos"], order)
    return spark.createDataFrame([(k + 1, ds) for k, ds in enumerate(kept)], "step int, ds int")


@query("u03_overlapping_sets", """, best AS (SELECT ds, chr, pos, max(round(z, 9)) AS z FROM v WHERE z > 4.0556e0 GROUP BY 1, 2, 3), i AS (SELECT l.locus, b.ds, b.pos, row_number() OVER (PARTITION BY l.locus, b.ds ORDER BY b.z DESC, b.pos) AS k FROM best b JOIN loci l ON l.chr = b.chr AND b.pos BETWEEN l."start" AND l."end"),
  s AS (SELECT * FROM i WHERE k <= 3) SELECT a.locus, a.ds AS ds_a, b.ds AS ds_b, count(*) AS n_shared FROM s a JOIN s b ON a.locus = b.locus AND a.pos = b.pos AND a.ds < b.ds GROUP BY 1, 2, 3""", "v loci")  # fmt: skip
def u03(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of datasets whose strongest three positions of a locus meet."""
    best = variants(spark, d).where(F.col("z") > loci.SUGGESTIVE).groupBy("ds", "chr", "pos").agg(F.max(F.round("z", 9)).alias("z"))
    inside = ranges.points_in(best, spans(spark, d).select(*SPANS))
    top = inside.withColumn("k", F.row_number().over(Window.partitionBy("locus", "ds").orderBy(F.desc("z"), "pos"))).where("k <= 3").select("locus", "pos", "ds")
    pairs = top.withColumnRenamed("ds", "ds_a").join(top.withColumnRenamed("ds", "ds_b"), ["locus", "pos"]).where("ds_a < ds_b")
    return pairs.groupBy("locus", "ds_a", "ds_b").agg(F.count("*").alias("n_shared"))


# ---- clumps, regression, selections and reports ----------------------------------------------


@query("p06b_linked_clumps")
def p06b(spark: SparkSession, d: str) -> DataFrame:
    """Clumps by linkage in regions of a hundred variants."""
    return regional.linked_clumps(simulated(spark, d, 100), "locus", 25, least_r2=0.3)


@query("p15b_two_step_regression")
def p15b(spark: SparkSession, d: str) -> DataFrame:
    """Two-step weighted regression of each dataset; blocks are stretches of a twentieth of a chromosome here."""
    v = variants(spark, d).select("ds", (F.col("chr") * 20 + F.floor(F.col("pos") / 500_001)).alias("block"), (F.col("maf") * 100).alias("l2"), (F.col("z") * F.col("z")).alias("chi2"))
    rows = regional.two_step_regression(v, "ds", "block", "l2", "chi2", 1e6, 1e5)
    return spark.createDataFrame([(r[0], *(round(x, 6) for x in r[1:])) for r in rows], "ds int, h2 double, h2_error double, intercept double, intercept_error double, ratio double, ratio_error double")


@query("p16_joint_selection", """, s AS (SELECT locus, ds, n_significant, z FROM dl WHERE n_significant > 0), n AS (SELECT locus, count(*) AS n FROM s GROUP BY locus HAVING count(*) >= 2)
  SELECT s.locus, arg_min(ds, (-n_significant, -z, ds)) AS anchor, max(n) AS n_datasets, CASE WHEN count(DISTINCT ds % 2) = 1 THEN 'within' ELSE 'cross' END AS mode FROM s JOIN n USING (locus) GROUP BY s.locus""", "v loci dl")  # fmt: skip
def p16(spark: SparkSession, d: str) -> DataFrame:
    """Loci fit for a joint run: two significant datasets or more, the best supported as anchor, of one category or across."""
    v = variants(spark, d)
    s = loci.dataset_by_locus(v, loci.seed_loci(v)).where("n_significant > 0")
    order = F.struct((-F.col("n_significant")).alias("a"), (-F.col("z")).alias("b"), F.col("ds"))
    by = s.groupBy("locus").agg(F.min_by("ds", order).alias("anchor"), F.count("*").alias("n_datasets"), F.when(F.count_distinct(F.col("ds") % 2) == 1, "within").otherwise("cross").alias("mode"))
    return by.where("n_datasets >= 2")


@query("p26_identifier_chain", """, db AS (SELECT DISTINCT chr, pos, least(ea, nea) AS lo, greatest(ea, nea) AS hi FROM v WHERE ds = 0), q AS (SELECT DISTINCT chr, pos, least(ea, nea) AS lo, greatest(ea, nea) AS hi FROM v WHERE ds = 3),
  o AS (SELECT chr, pos, least(ea, nea) AS lo, greatest(ea, nea) AS hi, min(ds) AS ds FROM v WHERE ds IN (1, 2) GROUP BY 1, 2, 3, 4)
  SELECT CASE WHEN db.chr IS NOT NULL THEN 'local' WHEN o.chr IS NOT NULL THEN 'other file' ELSE 'missing' END AS step, o.ds, count(*) AS n FROM (SELECT q.*, db.chr IS NOT NULL AS hit FROM q LEFT JOIN db USING (chr, pos, lo, hi)) q LEFT JOIN db USING (chr, pos, lo, hi) LEFT JOIN o ON NOT q.hit AND o.chr = q.chr AND o.pos = q.pos AND o.lo = q.lo AND o.hi = q.hi GROUP BY 1, 2""", "v")  # fmt: skip
def p26(spark: SparkSession, d: str) -> DataFrame:
    """Identifiers from the local list, then from the first other file that has them; the rest is missing."""
    v = variants(spark, d).select("ds", "chr", "pos", F.least("ea", "nea").alias("lo"), F.greatest("ea", "nea").alias("hi"))
    key = ["chr", "pos", "lo", "hi"]
    asked = v.where("ds = 3").select(*key).distinct()
    known = v.where("ds = 0").select(*key).distinct().withColumn("local", F.lit(True))
    others = v.where("ds in (1, 2)").groupBy(*key).agg(F.min("ds").alias("other"))
    m = asked.join(known, key, "left").join(others, key, "left")
    step = F.when(F.col("local"), "local").when(F.col("other").isNotNull(), "other file").otherwise("missing")
    return m.groupBy(step.alias("step"), F.when(F.col("local").isNull(), F.col("other")).alias("ds")).agg(F.count("*").alias("n"))


@query("j25_linkage_by_position", """, l AS (SELECT i // 50 AS region, min(i) AS lead FROM nor GROUP BY 1), r AS (SELECT CAST(b.i % 22 + 1 AS INT) AS chr, b.i * 4999 % 10000000 + 1 AS pos, round(list_dot_product(a.d, b.d) * list_dot_product(a.d, b.d), 6) AS r2 FROM l JOIN nor a ON a.i = l.lead JOIN nor b ON b.i // 50 = l.region)
  SELECT v.vid, r.r2 FROM v LEFT JOIN r ON r.chr = v.chr AND r.pos = v.pos WHERE v.z > 4.0556e0""", "ld v")  # fmt: skip
def j25(spark: SparkSession, d: str) -> DataFrame:
    """Linkage with a region's lead joined to variants by position; null where the panel lacks them."""
    i = F.col("variant")
    linked = p01(spark, d).select((i % 22 + 1).cast("int").alias("chr"), (i * 4999 % 10_000_000 + 1).alias("pos"), "r2")
    return variants(spark, d).where(F.col("z") > loci.SUGGESTIVE).select("vid", "chr", "pos").join(linked, ["chr", "pos"], "left").select("vid", "r2")


@query("s28_matrix_sheet", "SELECT locus, " + ", ".join(f"max(z) FILTER (ds = {k}) AS ds{k}" for k in range(6)) + " FROM dl GROUP BY locus", "v loci dl")
def s28(spark: SparkSession, d: str) -> DataFrame:
    """The locus matrix with a column for each dataset, as a sheet has it."""
    v = variants(spark, d)
    wide = loci.dataset_by_locus(v, loci.seed_loci(v)).groupBy("locus").pivot("ds", list(range(6))).agg(F.max("z"))
    return wide.withColumnsRenamed({str(k): f"ds{k}" for k in range(6)})


@query("p25_rederived_genes", """, o AS (SELECT l.locus, g.gid FROM loci l JOIN g ON l.chr = g.chr AND l."start" <= g."end" AND l."end" >= g."start") SELECT locus, count(*) AS n_genes, min(gid) AS first_gene FROM o GROUP BY locus""", "v loci g")
def p25(spark: SparkSession, d: str) -> DataFrame:
    """The genes of every stored locus, found anew."""
    found = ranges.overlapping(spans(spark, d), genes(spark, d).select("gid", "chr", "start", "end"))
    return found.groupBy("locus").agg(F.count("*").alias("n_genes"), F.min("gid_b").alias("first_gene"))


@query("a29_summary_sheet", "SELECT ds, count(*) AS n_rows, count(DISTINCT chr || ':' || pos) AS n_positions, count(*) FILTER (z >= 2.8070337e0) AS n_tier1, count(*) FILTER (z >= 4.0557e0) AS n_tier2, count(*) FILTER (z >= 5.45131e0) AS n_tier3 FROM v GROUP BY ds", "v")
def a29(spark: SparkSession, d: str) -> DataFrame:
    """Rows, positions and rows of p <= 5e-3, 5e-5 and 5e-8 of each dataset."""
    over = lambda least, name: F.count_if(F.col("z") >= least).alias(name)
    by = variants(spark, d).groupBy("ds")
    return by.agg(F.count("*").alias("n_rows"), F.count_distinct("chr", "pos").alias("n_positions"), over(2.8070337, "n_tier1"), over(4.0557, "n_tier2"), over(5.45131, "n_tier3"))


@query("j02_rows_in_loci", """SELECT l.locus, v.ds, count(*) AS n, min(v.pos) AS first, max(v.pos) AS last FROM v JOIN loci l ON v.chr = l.chr AND v.pos BETWEEN l."start" AND l."end" GROUP BY 1, 2""", "v loci")
def j02(spark: SparkSession, d: str) -> DataFrame:
    """Rows of each dataset within the loci as they are, without padding; chromosome labels are made equal first."""
    label = lambda df: df.withColumn("chr", S.normal_chr(F.col("chr").cast("string")))
    marked = variants(spark, d).withColumn("chr", F.concat(F.lit("chr"), F.col("chr").cast("string")))
    inside = ranges.points_in(label(marked).select("chr", "pos", "ds"), label(spans(spark, d)))
    return inside.groupBy("locus", "ds").agg(F.count("*").alias("n"), F.min("pos").alias("first"), F.max("pos").alias("last"))


@query("u01_best_of_union", "SELECT chr, pos, arg_min(vid, (-round(z, 9), vid)) AS vid, count(DISTINCT ds) AS n_datasets FROM v WHERE ds IN (0, 1, 4) GROUP BY chr, pos", "v")
def u01(spark: SparkSession, d: str) -> DataFrame:
    """Datasets put together, the best row of each position kept."""
    v = variants(spark, d)
    together = v.where("ds = 0").unionByName(v.where("ds = 1")).unionByName(v.where("ds = 4"))
    return together.groupBy("chr", "pos").agg(F.min_by("vid", F.struct((-F.round("z", 9)).alias("s"), F.col("vid"))).alias("vid"), F.count_distinct("ds").alias("n_datasets"))


@query("w06_locus_distances", """SELECT locus, CASE WHEN lag("end") OVER w IS NULL THEN 'start' ELSE CAST(greatest(0, "start" - lag("end") OVER w) AS VARCHAR) END AS distance FROM loci WINDOW w AS (PARTITION BY chr ORDER BY "start")""", "v loci")
def w06(spark: SparkSession, d: str) -> DataFrame:
    """Distance to the locus before on the chromosome; its first says start."""
    before = F.lag("end").over(Window.partitionBy("chr").orderBy("start"))
    return spans(spark, d).select("locus", F.when(before.isNull(), "start").otherwise(F.greatest(F.lit(0).cast("long"), F.col("start") - before).cast("string")).alias("distance"))


@query("w13_model_ranks", "SELECT locus, ds, row_number() OVER (PARTITION BY locus ORDER BY n_significant DESC, z DESC, ds) AS rank FROM dl", "v loci dl")
def w13(spark: SparkSession, d: str) -> DataFrame:
    """Ranks in a locus by score, then by significance."""
    v = variants(spark, d)
    w = Window.partitionBy("locus").orderBy(F.desc("n_significant"), F.desc("z"), "ds")
    return loci.dataset_by_locus(v, loci.seed_loci(v)).select("locus", "ds", F.row_number().over(w).cast("long").alias("rank"))
