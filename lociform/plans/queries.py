"""Fixed queries of the association engine over the test tables, each with its SQL for another engine.

Keys are operator ids of the survey and a name.  Floats are rounded on both sides; rows are never chosen
by a computed float without rounding it first.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lociform.functions import scalar as S
from lociform.operators import finemap, harmonise, loci, programs, ranges, stats
from lociform.sources import exports
from lociform.sources.tables import SQL as VIEW
from lociform.sources.tables import catalog, dosages, genes, peaks, table, variants

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Common table expressions that several checks share.
VIEW = VIEW | {
    "loci": """seeds AS (SELECT chr, pos, max(z) AS z FROM v WHERE z > 5.4513e0 GROUP BY chr, pos),
s2 AS (SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY chr ORDER BY pos) <= 250000 THEN 0 ELSE 1 END AS n FROM seeds),
s3 AS (SELECT *, sum(n) OVER (PARTITION BY chr ORDER BY pos) AS isl FROM s2),
loci AS (SELECT row_number() OVER (ORDER BY chr, min(pos)) AS locus, chr, min(pos) AS "start", max(pos) AS "end", count(*) AS n_seeds, max(z) AS top_z FROM s3 GROUP BY chr, isl)""",
    "dl": """inl AS (SELECT l.locus, v.* FROM v JOIN loci l ON v.chr = l.chr AND v.pos BETWEEN l."start" AND l."end"),
dl AS (SELECT locus, ds, arg_min(vid, (-round(z, 9), pos, vid)) AS lead, round(arg_min(beta, (-round(z, 9), pos, vid)), 9) AS beta, round(max(z), 9) AS z,
  count(*) FILTER (z > 4.0556e0) AS n_suggestive, count(*) FILTER (z > 5.4513e0) AS n_significant, count(*) AS n_rows FROM inl GROUP BY locus, ds)""",
}


def query(name: str, sql: str = "", views: str = "") -> Callable:
    """Register a query; views: names of the common table expressions that its SQL uses, in order."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = f
        if sql:
            heads = ",\n".join(VIEW[k] for k in views.split())
            # text that opens with a comma goes on with the list of common table expressions
            SQL[name] = f"WITH RECURSIVE {heads}{sql}" if heads and sql[0] == "," else f"WITH {heads}\n{sql}" if heads else sql.replace(", ", "WITH ", 1) if sql[0] == "," else sql
        return f

    return add


def erfc_sql(x: str) -> str:
    poly = f"({S.ERFC[-1]!r}e0)"
    for c in S.ERFC[-2::-1]:
        poly = f"({poly} * (1e0 / (1e0 + 0.5e0 * {x})) + ({c!r}e0))"
    return f"((1e0 / (1e0 + 0.5e0 * {x})) * exp(-({x}) * ({x}) + {poly}))"


def qnorm_sql(x: str) -> str:
    """The normal quantile's three pieces; x must be cheap, it is repeated."""

    def horner(y: str, coefficients: tuple[float, ...]) -> str:
        out = f"({coefficients[0]!r}e0)"
        for c in coefficients[1:]:
            out = f"({out} * {y} + ({c!r}e0))"
        return out.replace("e-03e0", "e-03").replace("e00e0", "e00").replace("e01e0", "e01").replace("e02e0", "e02")

    q = f"({x} - 0.5e0)"
    tail = lambda y: f"{horner(f'sqrt(-2e0 * ln({y}))', S.QNORM_C)} / {horner(f'sqrt(-2e0 * ln({y}))', S.QNORM_D)}"
    central = f"{horner(f'({q} * {q})', S.QNORM_A)} * {q} / {horner(f'({q} * {q})', S.QNORM_B)}"
    low = f"CASE WHEN {x} > 0e0 AND {x} < 0.02425e0 THEN {tail(x)} WHEN {x} >= 0.02425e0 AND {x} <= 1e0 - 0.02425e0 THEN {central}"
    return f"{low} WHEN {x} > 1e0 - 0.02425e0 AND {x} < 1e0 THEN -({tail(f'(1e0 - {x})')}) END"


# ---- filters and scalar expressions -----------------------------------------------------------


@query("f03_prefilter", "SELECT ds, count(*) AS n, round(max(z), 6) AS top FROM v WHERE z >= 2.807e0 GROUP BY ds", "v")
def f03(spark: SparkSession, d: str) -> DataFrame:
    return variants(spark, d).where(F.col("z") >= 2.807).groupBy("ds").agg(F.count("*").alias("n"), F.round(F.max("z"), 6).alias("top"))


@query("f04_seeded_chromosomes", "SELECT ds, chr, count(*) AS n FROM v WHERE EXISTS (SELECT 1 FROM v s WHERE s.z > 5.4513e0 AND s.ds = v.ds AND s.chr = v.chr) GROUP BY ds, chr", "v")
def f04(spark: SparkSession, d: str) -> DataFrame:
    v = variants(spark, d)
    seeded = v.where(F.col("z") > loci.GENOME_WIDE).select("ds", "chr").distinct()
    return v.join(seeded, ["ds", "chr"], "left_semi").groupBy("ds", "chr").agg(F.count("*").alias("n"))


@query("f09_stable_ids", "SELECT chr || ':' || pos || ':' || least(ea, nea) || ':' || greatest(ea, nea) AS id, count(*) AS n, count(DISTINCT ds) AS n_ds FROM v GROUP BY 1", "v")
def f09(spark: SparkSession, d: str) -> DataFrame:
    return variants(spark, d).groupBy(S.stable_id(F.col("chr"), F.col("pos"), F.col("ea"), F.col("nea")).alias("id")).agg(F.count("*").alias("n"), F.count_distinct("ds").alias("n_ds"))


@query("f10_sample_size_filter", """SELECT ds, count(*) AS n_kept FROM (SELECT ds, CASE WHEN vid % 10 = 3 THEN NULL ELSE 1000 + vid % 600 END AS n FROM v),
  (SELECT ds AS d2, max(CASE WHEN vid % 10 = 3 THEN NULL ELSE 1000 + vid % 600 END) AS m, avg(CASE WHEN vid % 10 = 3 THEN 0e0 ELSE 1e0 END) AS share FROM v GROUP BY ds)
  WHERE ds = d2 AND (share <= 0.5e0 OR n >= 0.8e0 * m) GROUP BY ds""", "v")  # fmt: skip
def f10(spark: SparkSession, d: str) -> DataFrame:
    v = variants(spark, d).select("ds", F.when(F.col("vid") % 10 != 3, 1000 + F.col("vid") % 600).alias("n"))
    most = v.groupBy("ds").agg(F.max("n").alias("m"), F.avg(F.col("n").isNotNull().cast("double")).alias("share"))
    return v.join(F.broadcast(most), "ds").where((F.col("share") <= 0.5) | (F.col("n") >= 0.8 * F.col("m"))).groupBy("ds").agg(F.count("*").alias("n_kept"))


@query("f12_palindromic", "SELECT ea || nea AS alleles, (ea || nea) IN ('AT','TA','CG','GC') AS palindromic, count(*) AS n FROM v GROUP BY 1, 2", "v")
def f12(spark: SparkSession, d: str) -> DataFrame:
    return variants(spark, d).groupBy(F.concat("ea", "nea").alias("alleles"), S.palindromic(F.col("ea"), F.col("nea")).alias("palindromic")).agg(F.count("*").alias("n"))


@query("f13_mhc_genes", 'SELECT gid, "start", "end" FROM g WHERE chr = 6 AND "start" * 10 <= 33448354 AND "end" * 10 >= 28477897', "g")
def f13(spark: SparkSession, d: str) -> DataFrame:
    return genes(spark, d).where(S.in_mhc(F.col("chr"), F.col("start") * 10, F.col("end") * 10)).select("gid", "start", "end")


@query("f14_tiers", "SELECT ds, CASE WHEN z > 5.4513e0 THEN 3 WHEN z > 4.0556e0 THEN 2 WHEN z > 2.807e0 THEN 1 ELSE 0 END AS tier, count(*) AS n FROM v GROUP BY 1, 2", "v")
def f14(spark: SparkSession, d: str) -> DataFrame:
    return variants(spark, d).groupBy("ds", S.tier(F.col("z")).alias("tier")).agg(F.count("*").alias("n"))


@query("f15_direction", "SELECT ds, beta > 0 AS risk, count(*) AS n FROM v WHERE z > 4.0556e0 GROUP BY 1, 2", "v")
def f15(spark: SparkSession, d: str) -> DataFrame:
    return variants(spark, d).where(F.col("z") > loci.SUGGESTIVE).groupBy("ds", (F.col("beta") > 0).alias("risk")).agg(F.count("*").alias("n"))


@query("f17_odds_ratios", "SELECT vid, round(exp(beta), 6) AS odds_ratio, round(exp(beta - 1.959964e0 * se), 6) AS low, round(exp(beta + 1.959964e0 * se), 6) AS high FROM v", "v")
def f17(spark: SparkSession, d: str) -> DataFrame:
    half = F.lit(1.959964) * F.col("se")
    bound = lambda x: F.round(F.exp(x), 6)
    return variants(spark, d).select("vid", bound(F.col("beta")).alias("odds_ratio"), bound(F.col("beta") - half).alias("low"), bound(F.col("beta") + half).alias("high"))


@query("f20_common_variants", "SELECT ds, count(*) AS n, round(avg(1e0 / (se * se * 2e0 * maf * (1e0 - maf))), 4) AS mean_n FROM v WHERE maf >= 0.05e0 AND NOT (chr = 6 AND pos > 2500000 AND pos < 3400000) GROUP BY ds", "v")
def f20(spark: SparkSession, d: str) -> DataFrame:
    v = variants(spark, d).where((F.col("maf") >= 0.05) & ~((F.col("chr") == 6) & (F.col("pos") > 2_500_000) & (F.col("pos") < 3_400_000)))
    implied = F.lit(1.0) / (F.col("se") * F.col("se") * 2.0 * F.col("maf") * (F.lit(1.0) - F.col("maf")))
    return v.groupBy("ds").agg(F.count("*").alias("n"), F.round(F.avg(implied), 4).alias("mean_n"))


@query("f22_trait_search", "SELECT cid, rsid, trait FROM c WHERE contains(lower(trait), 'urg') AND mlogp >= 30", "c")
def f22(spark: SparkSession, d: str) -> DataFrame:
    return catalog(spark, d).where(F.contains(F.lower("trait"), F.lit("urg")) & (F.col("mlogp") >= 30)).select("cid", "rsid", "trait")


@query("m02_p_values", f"SELECT vid, round(-log10({erfc_sql('(z / sqrt(2e0))')}), 6) + 0e0 AS neglog10p FROM v", "v")
def m02(spark: SparkSession, d: str) -> DataFrame:
    return variants(spark, d).select("vid", (F.round(S.neglog10(S.z_to_p(F.col("z"))), 6) + 0.0).alias("neglog10p"))


@query("m03_log_gamma", "SELECT p_partkey AS gid, round(lgamma(p_size + 0.5e0), 6) AS lg FROM part")
def m03(spark: SparkSession, d: str) -> DataFrame:
    return genes(spark, d).select("gid", F.round(S.log_gamma(F.col("size") + F.lit(0.5)), 6).alias("lg"))


@query("m01_normal_quantile", f""", m AS (SELECT DISTINCT maf FROM v), q AS (SELECT maf, {qnorm_sql("(maf + 0.001e0)")} AS q FROM m)
  SELECT maf, round(q, 6) AS q, round({erfc_sql("(abs(q) / sqrt(2e0))")}, 5) AS two_sided FROM q""", "v")  # fmt: skip
def m01(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("maf") + 0.001
    return variants(spark, d).select("maf").distinct().select("maf", F.round(S.qnorm(p), 6).alias("q"), F.round(S.z_to_p(S.qnorm(p)), 5).alias("two_sided"))


@query("x01_complement", "SELECT ea, translate(ea, 'ACGT', 'TGCA') AS complement, count(*) AS n FROM v GROUP BY 1, 2", "v")
def x01(spark: SparkSession, d: str) -> DataFrame:
    return variants(spark, d).groupBy("ea", S.complement(F.col("ea")).alias("complement")).agg(F.count("*").alias("n"))


@query("x06_fingerprints", "SELECT gid, sha256(gene || ':' || \"start\") AS print FROM g", "g")
def x06(spark: SparkSession, d: str) -> DataFrame:
    return genes(spark, d).select("gid", F.sha2(F.concat_ws(":", "gene", F.col("start").cast("string")), 256).alias("print"))


# ---- joins ------------------------------------------------------------------------------------


@query("j01_variants_in_genes", 'SELECT v.vid, g.gid FROM v JOIN g ON v.chr = g.chr AND v.pos BETWEEN g."start" AND g."end" WHERE v.z > 4.0556e0', "v g")
def j01(spark: SparkSession, d: str) -> DataFrame:
    g = genes(spark, d).select("gid", "chr", "start", "end")
    return ranges.points_in(variants(spark, d).where(F.col("z") > loci.SUGGESTIVE), g).select("vid", "gid")


@query("j03_gene_overlaps", 'SELECT a.gid, b.gid AS gid_b FROM g a JOIN g b ON a.chr = b.chr AND a."start" <= b."end" AND a."end" >= b."start" AND a.gid < b.gid', "g")
def j03(spark: SparkSession, d: str) -> DataFrame:
    g = genes(spark, d).select("gid", "chr", "start", "end")
    return ranges.overlapping(g, g).where("gid < gid_b").select("gid", "gid_b")


@query("j04_two_nearest_genes", """SELECT locus, gid, distance, k FROM (SELECT locus, gid, distance, row_number() OVER (PARTITION BY locus ORDER BY distance, gid) AS k FROM
  (SELECT l.locus, g.gid, greatest(0, g."start" - (l."start" + l."end") // 2, (l."start" + l."end") // 2 - g."end") AS distance FROM loci l JOIN g ON l.chr = g.chr AND l."start" <= g."end" AND l."end" >= g."start")) WHERE k <= 2""", "v loci g")  # fmt: skip
def j04(spark: SparkSession, d: str) -> DataFrame:
    found = ranges.overlapping(loci.seed_loci(variants(spark, d)).select("locus", "chr", "start", "end"), genes(spark, d).select("gid", "chr", "start", "end"))
    middle = F.floor((F.col("start") + F.col("end")) / 2)
    near = found.select("locus", F.col("gid_b").alias("gid"), F.greatest(F.lit(0), F.col("start_b") - middle, middle - F.col("end_b")).cast("long").alias("distance"))
    return near.withColumn("k", F.row_number().over(Window.partitionBy("locus").orderBy("distance", "gid")).cast("long")).where("k <= 2")


@query("j05_nearest_gene", """SELECT vid, min(distance) AS distance FROM (SELECT v.vid, greatest(0, g."start" - v.pos, v.pos - g."end") AS distance FROM v JOIN g ON v.chr = g.chr WHERE v.z > 5.4513e0) GROUP BY vid""", "v g")
def j05(spark: SparkSession, d: str) -> DataFrame:
    v = variants(spark, d).where(F.col("z") > loci.GENOME_WIDE).select("vid", "chr", "pos")
    return ranges.nearest(v, genes(spark, d), "gid").select("vid", "distance")


@query("j08_variants_in_peaks", """SELECT e.eid, count(*) AS n, count(DISTINCT v.chr || ':' || v.pos) AS n_pos FROM v, (SELECT DISTINCT eid FROM k) e WHERE EXISTS (SELECT 1 FROM k WHERE k.chr = v.chr AND v.pos BETWEEN k."start" AND k."end" AND k.eid = e.eid) GROUP BY 1""", "v k")
def j08(spark: SparkSession, d: str) -> DataFrame:
    """Rows and positions inside the elements of each cell type.

    Rows are counted by position first, so that the range join sees a position once.
    """
    places = variants(spark, d).groupBy("chr", "pos").agg(F.count("*").alias("rows"))
    found = ranges.points_in(places, peaks(spark, d).select("eid", "chr", "start", "end")).select("eid", "chr", "pos", "rows").distinct()
    return found.groupBy("eid").agg(F.sum("rows").alias("n"), F.count("*").alias("n_pos"))


@query("j09_peaks_by_locus", 'SELECT l.locus, k.mark, count(*) AS n, round(max(k.signal), 6) AS signal FROM loci l JOIN k ON l.chr = k.chr AND l."start" <= k."end" AND l."end" >= k."start" GROUP BY 1, 2', "v loci k")
def j09(spark: SparkSession, d: str) -> DataFrame:
    found = ranges.overlapping(loci.seed_loci(variants(spark, d)).select("locus", "chr", "start", "end"), peaks(spark, d))
    return found.groupBy("locus", F.col("mark_b").alias("mark")).agg(F.count("*").alias("n"), F.round(F.max("signal_b"), 6).alias("signal"))


@query("j13_catalog_hits", """, h AS (SELECT l.locus, c.cid, c.mlogp, row_number() OVER (PARTITION BY l.locus ORDER BY c.pos, c.cid) AS k FROM loci l JOIN c ON l.chr = c.chr AND c.pos BETWEEN l."start" AND l."end")
  SELECT locus, count(*) AS n_hits, arg_min(cid, (-mlogp, cid)) FILTER (k <= 200) AS best FROM h GROUP BY locus""", "v c loci")  # fmt: skip
def j13(spark: SparkSession, d: str) -> DataFrame:
    """All hits are counted; the best is taken among the first 200 by position, as is the report's rule."""
    hits = ranges.points_in(catalog(spark, d), loci.seed_loci(variants(spark, d)).select("locus", "chr", "start", "end"))
    hits = hits.withColumn("k", F.row_number().over(Window.partitionBy("locus").orderBy("pos", "cid")))
    return hits.groupBy("locus").agg(F.count("*").alias("n_hits"), F.min_by("cid", F.when(F.col("k") <= 200, F.struct((-F.col("mlogp")).alias("m"), "cid"))).alias("best"))


@query("j14_catalog_by_rsid", "SELECT rsid, count(*) AS n, count(DISTINCT trait) AS traits FROM c WHERE rsid IN (SELECT 'rs' || p_partkey FROM part) GROUP BY rsid", "c")
def j14(spark: SparkSession, d: str) -> DataFrame:
    wanted = genes(spark, d).select(F.concat(F.lit("rs"), F.col("gid").cast("string")).alias("rsid")).distinct()
    return catalog(spark, d).join(wanted, "rsid", "left_semi").groupBy("rsid").agg(F.count("*").alias("n"), F.count_distinct("trait").alias("traits"))


_PANEL = """p AS (SELECT DISTINCT chr, pos, ea AS a1, nea AS a2, maf AS a1_freq FROM v WHERE ds = 0),
t AS (SELECT vid, chr, pos, beta, exp(beta) AS odds, CASE ds % 3 WHEN 1 THEN 1e0 - maf ELSE maf END AS eaf, CASE ds % 3 WHEN 1 THEN nea WHEN 2 THEN translate(ea, 'ACGT', 'TGCA') ELSE ea END AS ea, CASE ds % 3 WHEN 1 THEN ea WHEN 2 THEN translate(nea, 'ACGT', 'TGCA') ELSE nea END AS nea FROM v WHERE ds > 0),
m AS (SELECT *, CASE WHEN ea = a1 AND nea = a2 THEN 'FORWARD' WHEN ea = a2 AND nea = a1 THEN 'REVERSE' WHEN translate(ea, 'ACGT', 'TGCA') = a1 AND translate(nea, 'ACGT', 'TGCA') = a2 THEN 'COMPLEMENT'
  WHEN translate(ea, 'ACGT', 'TGCA') = a2 AND translate(nea, 'ACGT', 'TGCA') = a1 THEN 'REVERSE_COMPLEMENT' ELSE 'NONE' END AS class FROM t JOIN p USING (chr, pos))"""
VIEW["panel"] = _PANEL


def panel_matches(spark: SparkSession, d: str) -> DataFrame:
    v = variants(spark, d)
    panel = v.where("ds = 0").select("chr", "pos", F.col("ea").alias("a1"), F.col("nea").alias("a2"), F.col("maf").alias("a1_freq")).distinct()
    kind = F.col("ds") % 3
    ea = F.when(kind == 1, F.col("nea")).when(kind == 2, S.complement(F.col("ea"))).otherwise(F.col("ea"))
    nea = F.when(kind == 1, F.col("ea")).when(kind == 2, S.complement(F.col("nea"))).otherwise(F.col("nea"))
    eaf = F.when(kind == 1, F.lit(1.0) - F.col("maf")).otherwise(F.col("maf"))
    t = v.where("ds > 0").select("vid", "chr", "pos", "beta", F.exp("beta").alias("odds"), eaf.alias("eaf"), ea.alias("ea"), nea.alias("nea"))
    return t.join(panel, ["chr", "pos"]).withColumn("class", S.match_class(F.col("ea"), F.col("nea"), F.col("a1"), F.col("a2")))


@query("j16_allele_matches", "SELECT class, count(*) AS n FROM m GROUP BY class", "v panel")
def j16(spark: SparkSession, d: str) -> DataFrame:
    return panel_matches(spark, d).groupBy("class").agg(F.count("*").alias("n"))


@query("j17_harmonised", """, h AS (SELECT *, CASE WHEN (ea || nea) NOT IN ('AT', 'TA', 'CG', 'GC') OR class NOT IN ('FORWARD', 'REVERSE') THEN class
    WHEN abs(a1_freq - 0.5e0) < 0.05e0 OR abs(eaf - 0.5e0) < 0.05e0 OR a1_freq <= 0 OR a1_freq >= 1 OR eaf <= 0 OR eaf >= 1 THEN 'UNCLEAR' WHEN abs(eaf - a1_freq) + 0.1e0 < abs(eaf - (1e0 - a1_freq)) THEN 'FORWARD'
    WHEN abs(eaf - (1e0 - a1_freq)) + 0.1e0 < abs(eaf - a1_freq) THEN 'REVERSE' ELSE 'UNCLEAR' END AS k FROM m),
  o AS (SELECT *, CASE WHEN k LIKE '%COMPLEMENT' THEN translate(ea, 'ACGT', 'TGCA') ELSE ea END AS x, CASE WHEN k LIKE '%COMPLEMENT' THEN translate(nea, 'ACGT', 'TGCA') ELSE nea END AS y FROM h)
  SELECT vid, CASE k WHEN 'NONE' THEN 'dropped' WHEN 'UNCLEAR' THEN 'dropped_palindromic' WHEN 'FORWARD' THEN 'kept' WHEN 'REVERSE' THEN 'flipped' WHEN 'COMPLEMENT' THEN 'complemented' ELSE 'complement_flipped' END AS action,
    CASE WHEN k LIKE 'REVERSE%' THEN y ELSE x END AS ea, CASE WHEN k LIKE 'REVERSE%' THEN x ELSE y END AS nea,
    round(CASE WHEN k LIKE 'REVERSE%' THEN -beta ELSE beta END, 9) + 0e0 AS beta, round(CASE WHEN k LIKE 'REVERSE%' THEN 1e0 / odds ELSE odds END, 9) AS odds FROM o""", "v panel")  # fmt: skip
def j17(spark: SparkSession, d: str) -> DataFrame:
    """Rows turned to the panel's first allele: effects change sign, odds ratios are inverted, palindromic alleles go by frequency."""
    m = harmonise.harmonised(panel_matches(spark, d))
    return m.select("vid", "action", "ea", "nea", (F.round("beta", 9) + F.lit(0.0)).alias("beta"), F.round("odds", 9).alias("odds"))


@query("f16_effects", "SELECT vid, round(CASE WHEN vid % 3 = 0 THEN beta WHEN vid % 3 = 1 THEN ln(exp(beta)) END, 9) + 0e0 AS effect FROM v", "v")
def f16(spark: SparkSession, d: str) -> DataFrame:
    """Effects of rows of which a third has a beta, a third an odds ratio and a third an impossible odds ratio."""
    kind = F.col("vid") % 3
    v = variants(spark, d).select("vid", F.when(kind == 0, F.col("beta")).alias("beta"), F.when(kind == 1, F.exp("beta")).when(kind == 2, 0.0).alias("odds"))
    return v.select("vid", (F.round(S.effect_value(F.col("beta"), F.col("odds")), 9) + F.lit(0.0)).alias("effect"))


@query("j29_neighbouring_loci", """SELECT locus, lag(locus) OVER (ORDER BY chr, "start") AS prev, lead(locus) OVER (ORDER BY chr, "start") AS next, "start" - lag("end") OVER (PARTITION BY chr ORDER BY "start") AS gap FROM loci""", "v loci")
def j29(spark: SparkSession, d: str) -> DataFrame:
    w, own = Window.orderBy("chr", "start"), Window.partitionBy("chr").orderBy("start")
    return loci.seed_loci(variants(spark, d)).select("locus", F.lag("locus").over(w).alias("prev"), F.lead("locus").over(w).alias("next"), (F.col("start") - F.lag("end").over(own)).alias("gap"))


# ---- aggregates -------------------------------------------------------------------------------


@query("a01_lead_by_locus", """, i AS (SELECT l.locus, v.* FROM v JOIN loci l ON v.chr = l.chr AND v.pos BETWEEN l."start" AND l."end")
  SELECT locus, arg_min(vid, (-round(z, 9), pos, vid)) AS lead, arg_min(pos, (-round(z, 9), pos, vid)) AS lead_pos, count(*) AS n_rows FROM i GROUP BY locus""", "v loci")  # fmt: skip
def a01(spark: SparkSession, d: str) -> DataFrame:
    v = variants(spark, d)
    return loci.lead_by_locus(v, loci.seed_loci(v))


@query("a03_dataset_by_locus", "SELECT * FROM dl", "v loci dl")
def a03(spark: SparkSession, d: str) -> DataFrame:
    """The locus matrix: variants of all datasets, merged into loci, summarised by locus and dataset."""
    v = variants(spark, d)
    return loci.dataset_by_locus(v, loci.seed_loci(v))


@query("a05_best_dataset", "SELECT locus, arg_min(ds, (-z, ds)) AS ds, max(z) AS z, count(*) AS n_datasets FROM dl GROUP BY locus", "v loci dl")
def a05(spark: SparkSession, d: str) -> DataFrame:
    v = variants(spark, d)
    return loci.best_dataset(loci.dataset_by_locus(v, loci.seed_loci(v)))


@query("a04_best_by_position", "SELECT chr, pos, round(max(z), 9) AS z, count(*) AS n FROM v GROUP BY chr, pos", "v")
def a04(spark: SparkSession, d: str) -> DataFrame:
    return variants(spark, d).groupBy("chr", "pos").agg(F.round(F.max("z"), 9).alias("z"), F.count("*").alias("n"))


@query("a06_skyline", "SELECT least(2999, ((chr - 1) * 10000000 + pos) // 73334) AS bin, round(max(z), 6) AS top FROM v GROUP BY 1 HAVING max(z) > 0", "v")
def a06(spark: SparkSession, d: str) -> DataFrame:
    """The strongest value in each of 3000 bins of the genome, here 22 chromosomes of ten million positions."""
    place = F.floor(((F.col("chr") - 1).cast("long") * 10_000_000 + F.col("pos")) / 73_334)
    return variants(spark, d).groupBy(F.least(F.lit(2999), place).cast("long").alias("bin")).agg(F.round(F.max("z"), 6).alias("top")).where("top > 0")


@query("a09_genomic_inflation", "SELECT ds, count(*) AS n, round(avg(z * z), 6) AS mean_chi2, round(quantile_cont(z * z, 0.5) / 0.454936423e0, 6) AS lambda_gc, round(quantile_cont(z * z, 0.5) / 0.454936423e0, 6) > 1.1e0 AS inflated FROM v GROUP BY ds", "v")
def a09(spark: SparkSession, d: str) -> DataFrame:
    out = stats.genomic_inflation(variants(spark, d), ["ds"])
    return out.withColumn("mean_chi2", F.round("mean_chi2", 6)).withColumn("lambda_gc", F.round("lambda_gc", 6))


@query("a11_gene_rollup", """SELECT g.brand, count(*) AS n_total, count(*) FILTER (v.z > 4.0556e0) AS n_significant, round(avg(CASE WHEN v.beta > 0 THEN 1e0 ELSE 0e0 END), 6) AS risk_share, round(max(v.z), 6) AS top
  FROM v JOIN g ON v.chr = g.chr AND v.pos BETWEEN g."start" AND g."end" GROUP BY g.brand""", "v g")  # fmt: skip
def a11(spark: SparkSession, d: str) -> DataFrame:
    up = F.col("beta") > 0
    v = variants(spark, d).select("chr", "pos", "z", (F.col("z") > loci.SUGGESTIVE).cast("double").alias("significant"), up.cast("double").alias("up"), up.isNotNull().cast("double").alias("told"))
    found = ranges.folded(v, genes(spark, d), ["brand"], ["significant", "up", "told"], ["z"])
    return found.groupBy("brand").agg(
        F.sum("n").alias("n_total"), F.sum("significant").cast("long").alias("n_significant"), F.round(F.sum("up") / F.sum("told"), 6).alias("risk_share"), F.round(F.max("z"), 6).alias("top")
    )


@query("a12_anova", """, per AS (SELECT chr, ds, count(*) AS n, sum(z) AS s, sum(z * z) AS q FROM v GROUP BY 1, 2),
  tot AS (SELECT chr, count(*) AS k, sum(n) AS n, sum(s) AS s, sum(q) AS q, sum(s * s / n) AS b FROM per GROUP BY chr)
  SELECT chr, k AS n_groups, CAST(n AS BIGINT) AS n, round(((b - s * s / n) / (k - 1)) / ((q - b) / (n - k)), 6) AS f FROM tot""", "v")  # fmt: skip
def a12(spark: SparkSession, d: str) -> DataFrame:
    return stats.one_way_anova(variants(spark, d), ["chr"], "ds", "z").withColumn("f", F.round("f", 6))


@query("a12b_anova_within", """, per AS (SELECT chr, ds % 2 AS disease, ds, count(*) AS n, sum(z) AS s, sum(z * z) AS q FROM v GROUP BY 1, 2, 3),
  tot AS (SELECT chr, disease, count(*) AS k, sum(n) AS n, sum(s) AS s, sum(q) AS q, sum(s * s / n) AS b FROM per GROUP BY chr, disease)
  SELECT chr, disease, k AS n_groups, CAST(n AS BIGINT) AS n, round(((b - s * s / n) / (k - 1)) / ((q - b) / (n - k)), 6) AS f FROM tot""", "v")  # fmt: skip
def a12b(spark: SparkSession, d: str) -> DataFrame:
    """Within each disease: whether its datasets differ."""
    v = variants(spark, d).withColumn("disease", F.col("ds") % 2)
    return stats.one_way_anova(v, ["chr", "disease"], "ds", "z").withColumn("f", F.round("f", 6))


@query("a14_shared_genes", """, s AS (SELECT DISTINCT v.ds, g.gid FROM v JOIN g ON v.chr = g.chr AND v.pos BETWEEN g."start" AND g."end" WHERE v.z > 4.0556e0)
  SELECT a.gid AS gid_a, b.gid AS gid_b, count(*) AS n FROM s a JOIN s b ON a.ds = b.ds AND a.gid < b.gid GROUP BY 1, 2 HAVING count(*) >= 2 ORDER BY n DESC, gid_a, gid_b LIMIT 150""", "v g")  # fmt: skip
def a14(spark: SparkSession, d: str) -> DataFrame:
    found = ranges.points_in(variants(spark, d).where(F.col("z") > loci.SUGGESTIVE), genes(spark, d).select("gid", "chr", "start", "end"))
    return loci.shared_pairs(found, "gid", "ds", 150).withColumnsRenamed({"a": "gid_a", "b": "gid_b"})


@query("a16_mann_whitney", """, t AS (SELECT ds, maf, count(*) AS t, count(*) FILTER (z > 4.0556e0) AS a FROM v GROUP BY 1, 2),
  r AS (SELECT *, sum(t) OVER (PARTITION BY ds ORDER BY maf) - (t - 1) / 2e0 AS r FROM t),
  u AS (SELECT ds, CAST(sum(a) AS BIGINT) AS n1, CAST(sum(t - a) AS BIGINT) AS n2, sum(r * a) AS r1, sum(CAST(t AS DOUBLE) * t * t - t) AS ties FROM r GROUP BY ds)
  SELECT ds, n1, n2, r1 - CAST(n1 AS DOUBLE) * (n1 + 1) / 2 AS u, round((r1 - CAST(n1 AS DOUBLE) * (n1 + 1) / 2 - CAST(n1 AS DOUBLE) * n2 / 2) / sqrt(CAST(n1 AS DOUBLE) * n2 / 12 * (n1 + n2 + 1 - ties / (CAST(n1 + n2 AS DOUBLE) * (n1 + n2 - 1)))), 6) AS z FROM u""", "v")  # fmt: skip
def a16(spark: SparkSession, d: str) -> DataFrame:
    return stats.mann_whitney(variants(spark, d), ["ds"], "maf", F.col("z") > loci.SUGGESTIVE).withColumn("z", F.round("z", 6))


@query("a17_peak_enrichment", """, b AS (SELECT chr, pos, max(z) AS z FROM v GROUP BY 1, 2), marks AS (SELECT DISTINCT eid, mark FROM k),
  i AS (SELECT m.eid, m.mark, b.z > 5.4513e0 AS fg, EXISTS (SELECT 1 FROM k WHERE k.mark = m.mark AND k.eid = m.eid AND k.chr = b.chr AND b.pos BETWEEN k."start" AND k."end") AS inside FROM b, marks m),
  n AS (SELECT eid, mark, count(*) FILTER (fg AND inside) AS a, count(*) FILTER (fg AND NOT inside) AS b, count(*) FILTER (NOT fg AND inside) AS c, count(*) FILTER (NOT fg AND NOT inside) AS d FROM i GROUP BY 1, 2)
  SELECT eid, mark, a, b, c, d, round((a + h) * (d + h) / ((b + h) * (c + h)), 6) AS odds_ratio FROM (SELECT *, CASE WHEN a = 0 OR b = 0 OR c = 0 OR d = 0 THEN 0.5e0 ELSE 0e0 END AS h FROM n)""", "v k")  # fmt: skip
def a17(spark: SparkSession, d: str) -> DataFrame:
    """Odds of lying in a peak of each cell type and mark, significant positions against all others."""
    best = loci.best_by_position(variants(spark, d)).withColumn("fg", F.col("z") > loci.GENOME_WIDE)
    k = peaks(spark, d)
    inside = ranges.points_in(best, k.select("chr", "start", "end", "eid", "mark")).select("chr", "pos", "fg", "eid", "mark").distinct()
    counts = inside.groupBy("eid", "mark").agg(F.count_if("fg").alias("a"), F.count_if(~F.col("fg")).alias("c"))
    totals = best.agg(F.count_if("fg").alias("fgs"), F.count_if(~F.col("fg")).alias("bgs"))
    # totals are one row, kinds the distinct marks of cell types
    every = k.select("eid", "mark").distinct().join(counts, ["eid", "mark"], "left").na.fill(0, ["a", "c"]).join(F.broadcast(totals))
    t = every.select("eid", "mark", "a", (F.col("fgs") - F.col("a")).alias("b"), "c", (F.col("bgs") - F.col("c")).alias("d"))
    return t.withColumn("odds_ratio", F.round(S.haldane_odds_ratio(*(F.col(x) for x in "abcd")), 6))


@query("a19_dataset_distances", """, best AS (SELECT ds, chr, pos, max(z) AS z FROM v GROUP BY 1, 2, 3), t AS (SELECT ds, chr, pos, CASE WHEN z > 5.4513e0 THEN 3 WHEN z > 4.0556e0 THEN 2 WHEN z > 2.807e0 THEN 1 ELSE 0 END AS t FROM best),
  n AS (SELECT ds, sum(t * t) AS n FROM t GROUP BY ds)
  SELECT a.ds AS a, b.ds AS b, round(1e0 - sum(a.t * b.t) / sqrt(CAST(max(na.n) AS DOUBLE) * CAST(max(nb.n) AS DOUBLE)), 6) AS distance FROM t a JOIN t b ON a.chr = b.chr AND a.pos = b.pos AND a.ds < b.ds JOIN n na ON na.ds = a.ds JOIN n nb ON nb.ds = b.ds GROUP BY 1, 2""", "v")  # fmt: skip
def a19(spark: SparkSession, d: str) -> DataFrame:
    """Cosine distance of the datasets' tiers over positions; a position has one row for each dataset at most."""
    t = variants(spark, d).groupBy("ds", "chr", "pos").agg(F.max("z").alias("z")).select("ds", F.struct("chr", "pos").alias("at"), S.tier(F.col("z")).alias("t"))
    norms = t.groupBy("ds").agg(F.sum(F.col("t") * F.col("t")).cast("double").alias("n"))
    pairs = stats.pair_moments(t, "at", "ds", "t").select("a", "b", F.col("xy").alias("dot"))
    na, nb = norms.select(F.col("ds").alias("a"), F.col("n").alias("na")), norms.select(F.col("ds").alias("b"), F.col("n").alias("nb"))
    return pairs.join(na, "a").join(nb, "b").select("a", "b", F.round(1 - F.col("dot") / F.sqrt(F.col("na") * F.col("nb")), 6).alias("distance"))


@query("a27_distance_bands", """, n AS (SELECT vid, min(greatest(0, g."start" - v.pos, v.pos - g."end")) AS d FROM v JOIN g ON v.chr = g.chr WHERE v.z > 4.0556e0 GROUP BY vid)
  SELECT CASE WHEN d = 0 THEN 'inside' WHEN d <= 10000 THEN '10 kb' WHEN d <= 100000 THEN '100 kb' ELSE 'further' END AS band, count(*) AS n FROM n GROUP BY 1""", "v g")  # fmt: skip
def a27(spark: SparkSession, d: str) -> DataFrame:
    near = ranges.nearest(variants(spark, d).where(F.col("z") > loci.SUGGESTIVE).select("vid", "chr", "pos"), genes(spark, d), "gid").where(F.col("distance").isNotNull())
    band = F.when(F.col("distance") == 0, "inside").when(F.col("distance") <= 10_000, "10 kb").when(F.col("distance") <= 100_000, "100 kb").otherwise("further")
    return near.groupBy(band.alias("band")).agg(F.count("*").alias("n"))


@query("a32_null_correlation", """, best AS (SELECT ds, chr, pos, arg_min(beta / se, vid) AS z FROM v WHERE z < 1.96e0 GROUP BY 1, 2, 3)
  SELECT a.ds AS a, b.ds AS b, count(*) AS n, round(corr(a.z, b.z), 6) AS r FROM best a JOIN best b ON a.chr = b.chr AND a.pos = b.pos AND a.ds < b.ds GROUP BY 1, 2 HAVING count(*) >= 100""", "v")  # fmt: skip
def a32(spark: SparkSession, d: str) -> DataFrame:
    null = variants(spark, d).where(F.col("z") < 1.96).groupBy("ds", "chr", "pos").agg(F.min_by(F.col("beta") / F.col("se"), "vid").alias("s"))
    return stats.pair_correlation(null.withColumn("at", F.struct("chr", "pos")), "at", "ds", "s", 100).select("a", "b", "n", F.round("r", 6).alias("r"))


# ---- windows and per-locus programs -----------------------------------------------------------


@query("w02_merged_loci", 'SELECT locus, chr, "start", "end", n_seeds, round(top_z, 9) AS top_z FROM loci', "v loci")
def w02(spark: SparkSession, d: str) -> DataFrame:
    return loci.seed_loci(variants(spark, d)).withColumn("top_z", F.round("top_z", 9))


@query("w05_merged_peaks", """, o AS (SELECT *, max("end") OVER (PARTITION BY eid, chr ORDER BY "start", "end", peak ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM k),
  i AS (SELECT *, sum(CASE WHEN reach IS NULL OR "start" >= reach THEN 1 ELSE 0 END) OVER (PARTITION BY eid, chr ORDER BY "start", "end", peak) AS isl FROM o)
  SELECT eid, chr, min("start") AS "start", max("end") AS "end", count(*) AS n FROM i GROUP BY eid, chr, isl""", "k")  # fmt: skip
def w05(spark: SparkSession, d: str) -> DataFrame:
    """Elements of each cell type merged where they overlap; those that only touch stay apart."""
    k = peaks(spark, d).withColumn("chr", F.struct("chr", "eid"))  # a cell type's chromosome is its own
    merged = loci.islands(k, -1).groupBy("chr", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n"))
    return merged.select("chr.eid", "chr.chr", "start", "end", "n")


@query("w10_credible_sets", """, inl AS (SELECT l.locus, v.ds, v.vid, v.beta, v.se FROM v JOIN loci l ON v.chr = l.chr AND v.pos BETWEEN l."start" AND l."end"),
  b AS (SELECT *, 0.5e0 * ln(se * se / (se * se + 0.04e0)) + beta * beta / (se * se) * 0.04e0 / (2e0 * (se * se + 0.04e0)) AS lbf FROM inl), e AS (SELECT *, exp(lbf - max(lbf) OVER (PARTITION BY ds, locus)) AS e FROM b),
  p AS (SELECT *, e / sum(e) OVER (PARTITION BY ds, locus) AS pip FROM e), c AS (SELECT *, sum(pip) OVER (PARTITION BY ds, locus ORDER BY round(lbf, 9) DESC, vid) AS cum, row_number() OVER (PARTITION BY ds, locus ORDER BY round(lbf, 9) DESC, vid) AS rank FROM p)
  SELECT locus, ds, vid, rank, round(pip, 6) AS pip FROM c WHERE round(cum - pip, 9) < 0.95e0""", "v loci")  # fmt: skip
def w10(spark: SparkSession, d: str) -> DataFrame:
    """Credible sets of each dataset in each locus."""
    v = variants(spark, d)
    inside = ranges.points_in(v, loci.seed_loci(v).select("locus", "chr", "start", "end")).withColumn("lbf", finemap.log_bayes_factor(F.col("beta"), F.col("se")))
    sets = finemap.credible_set(finemap.posterior(inside, ["ds", "locus"]), ["ds", "locus"], [F.desc(F.round("lbf", 9)), F.col("vid")])
    return sets.select("locus", "ds", "vid", "rank", F.round("pip", 6).alias("pip"))


@query("p11_colocalisation", """, b AS (SELECT ds, chr, pos, arg_min(beta, vid) AS beta, arg_min(se, vid) AS se FROM v WHERE ds IN (0, 1) GROUP BY 1, 2, 3),
  l AS (SELECT *, 0.5e0 * ln(se * se / (se * se + 0.04e0)) + beta * beta / (se * se) * 0.04e0 / (2e0 * (se * se + 0.04e0)) AS lbf FROM b),
  q AS (SELECT lo.locus, x.lbf AS l1, y.lbf AS l2 FROM l x JOIN l y ON x.chr = y.chr AND x.pos = y.pos JOIN loci lo ON lo.chr = x.chr AND x.pos BETWEEN lo."start" AND lo."end" WHERE x.ds = 0 AND y.ds = 1),
  s AS (SELECT locus, count(*) AS n, sum(exp(l1)) AS s1, sum(exp(l2)) AS s2, sum(exp(l1 + l2)) AS s12 FROM q GROUP BY locus), h AS (SELECT *, 1 + 1e-4 * s1 + 1e-4 * s2 + 1e-8 * (s1 * s2 - s12) + 1e-5 * s12 AS t FROM s)
  SELECT locus, n, round(1 / t, 6) AS h0, round(1e-4 * s1 / t, 6) AS h1, round(1e-4 * s2 / t, 6) AS h2, round(abs(1e-8 * (s1 * s2 - s12) / t), 6) AS h3, round(1e-5 * s12 / t, 6) AS h4 FROM h""", "v loci")  # fmt: skip
def p11(spark: SparkSession, d: str) -> DataFrame:
    v = variants(spark, d)
    best = v.where("ds < 2").groupBy("ds", "chr", "pos").agg(F.min_by("beta", "vid").alias("beta"), F.min_by("se", "vid").alias("se")).withColumn("lbf", finemap.log_bayes_factor(F.col("beta"), F.col("se")))
    both = best.where("ds = 0").select("chr", "pos", F.col("lbf").alias("lbf1")).join(best.where("ds = 1").select("chr", "pos", F.col("lbf").alias("lbf2")), ["chr", "pos"])
    pairs = ranges.points_in(both, loci.seed_loci(v).select("locus", "chr", "start", "end"))
    h = finemap.colocalisation(pairs, ["locus"])
    return h.select("locus", "n", *(F.round(F.abs(f"h{k}"), 6).alias(f"h{k}") for k in range(5)))


@query("w11_false_discovery", """, b AS (SELECT chr, pos, max(round(z, 6)) AS z FROM v GROUP BY 1, 2), p AS (SELECT *, exp(-z * z / 2) AS p FROM b), r AS (SELECT *, p * count(*) OVER (PARTITION BY chr) / count(*) OVER (PARTITION BY chr ORDER BY z DESC) AS q FROM p)
  SELECT chr, pos, round(least(1e0, min(q) OVER (PARTITION BY chr ORDER BY z)), 6) AS q FROM r""", "v")  # fmt: skip
def w11(spark: SparkSession, d: str) -> DataFrame:
    p = variants(spark, d).groupBy("chr", "pos").agg(F.max(F.round("z", 6)).alias("z")).withColumn("p", F.exp(-F.col("z") * F.col("z") / 2))
    return stats.benjamini_hochberg(p, ["chr"], "p").select("chr", "pos", F.round("q", 6).alias("q"))


@query("w12_average_ranks", "SELECT gid, rank() OVER (PARTITION BY brand ORDER BY size) + (count(*) OVER (PARTITION BY brand, size) - 1) / 2e0 AS avg_rank FROM g", "g")
def w12(spark: SparkSession, d: str) -> DataFrame:
    return stats.average_ranks(genes(spark, d), ["brand"], "size").select("gid", "avg_rank")


@query("w04_renumbered_genes", 'SELECT gid, row_number() OVER (PARTITION BY chr ORDER BY "start", gid) AS k FROM g', "g")
def w04(spark: SparkSession, d: str) -> DataFrame:
    return stats.placed(genes(spark, d), ["chr"], F.floor(F.col("start") / loci.BIN), ["start", "gid"]).select("gid", F.col("place").alias("k"))


@query("p05_ld_consistency", """, e AS (SELECT vec_id AS i, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS d FROM embeddings),
  c AS (SELECT i, list_transform(d, lambda x: x - list_avg(d)) AS d FROM e), r AS (SELECT a.i, b.i AS j, list_dot_product(a.d, b.d) / sqrt(list_dot_product(a.d, a.d) * list_dot_product(b.d, b.d)) AS r FROM c a JOIN c b ON b.i BETWEEN a.i + 1 AND a.i + 3)
  SELECT i, j, round(r * r, 6) AS r2 FROM r""")  # fmt: skip
def p05(spark: SparkSession, d: str) -> DataFrame:
    """Squared correlation of each variant's dosages with the next three, by equality on i + k: no range join."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("i"), F.col("embedding").cast("array<double>").alias("d"))
    mean = F.aggregate("d", F.lit(0.0), lambda a, x: a + x) / F.size("d")
    c = e.withColumn("m", mean).select("i", F.transform("d", lambda x: x - F.col("m")).alias("d"))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    after = c.select(F.explode(F.sequence(F.col("i") - 3, F.col("i") - 1)).alias("i"), F.col("i").alias("j"), F.col("d").alias("e"))
    r = dot(F.col("d"), F.col("e")) / F.sqrt(dot(F.col("d"), F.col("d")) * dot(F.col("e"), F.col("e")))
    return c.join(after, "i").select("i", "j", F.round(r * r, 6).alias("r2"))


@query("u04_uncatalogued_positions", "SELECT gid FROM g WHERE 'rs' || gid NOT IN (SELECT rsid FROM c)", "g c")
def u04(spark: SparkSession, d: str) -> DataFrame:
    return genes(spark, d).withColumn("rsid", F.concat(F.lit("rs"), F.col("gid").cast("string"))).join(catalog(spark, d).select("rsid").distinct(), "rsid", "left_anti").select("gid")


# ---- more joins, windows and programs ---------------------------------------------------------


@query("j10_nearest_peak", """SELECT chr, pos, eid, min(greatest(0, k."start" - s.pos, s.pos - k."end")) AS distance FROM (SELECT DISTINCT chr, pos FROM v WHERE z > 5.4513e0) s JOIN k USING (chr) GROUP BY chr, pos, eid""", "v k")
def j10(spark: SparkSession, d: str) -> DataFrame:
    """The distance to the nearest element of every cell type: cell types are told apart as chromosomes are."""
    own = F.struct("chr", "eid").alias("chr")
    k = peaks(spark, d)
    v = variants(spark, d).where(F.col("z") > loci.GENOME_WIDE).select("chr", "pos").distinct()
    kinds = k.select("eid").distinct()  # a row for each cell type
    v = v.crossJoin(F.broadcast(kinds)).select(own, "pos")
    near = ranges.nearest(v, k.select(own, "start", "end", "peak"), "peak").where("distance is not null")
    return near.select("chr.chr", "pos", "chr.eid", "distance")


@query("t06_top_targets", """, i AS (SELECT l.locus, g.gid, g.size FROM loci l JOIN g ON g.chr = l.chr AND g."start" <= l."end" + 100000 AND g."end" >= l."start" - 100000),
  r AS (SELECT *, row_number() OVER (PARTITION BY locus ORDER BY size DESC, gid) AS k FROM i) SELECT locus, k, gid FROM r WHERE k <= 5""", "v g loci")  # fmt: skip
def t06(spark: SparkSession, d: str) -> DataFrame:
    """The five best scored genes within 100 kb of each locus (a top-k report)."""
    near = loci.seed_loci(variants(spark, d)).select("locus", "chr", (F.col("start") - 100_000).alias("start"), (F.col("end") + 100_000).alias("end"))
    met = ranges.overlapping(near, genes(spark, d).select("gid", "size", "chr", "start", "end")).select("locus", F.col("gid_b").alias("gid"), F.col("size_b").alias("size"))
    best = met.withColumn("k", F.row_number().over(Window.partitionBy("locus").orderBy(F.desc("size"), "gid")).cast("long"))
    return best.where("k <= 5").select("locus", "k", "gid")


@query("t07_genes_in_order", """, b AS (SELECT g.gid, max(round(v.z, 9)) AS z FROM g JOIN v ON v.chr = g.chr AND v.pos BETWEEN g."start" AND g."end" GROUP BY g.gid) SELECT row_number() OVER (ORDER BY z DESC, gid) AS place, gid, z FROM b""", "v g")
def t07(spark: SparkSession, d: str) -> DataFrame:
    """Genes by their strongest variant, strongest first, numbered."""
    best = ranges.folded(variants(spark, d), genes(spark, d), ["gid"], tops=["z"]).groupBy("gid").agg(F.round(F.max("z"), 9).alias("z"))
    # bins of falling z; the key is the same for all
    ordered = stats.placed(best.withColumn("all", F.lit(1)), ["all"], -F.ceil(F.col("z") * 100), [F.desc("z"), "gid"])
    return ordered.select("place", "gid", "z").orderBy("place")


@query("j18_rsid_matches", """, db AS (SELECT DISTINCT chr, pos, ea AS ref, nea AS alt, 'rs' || pos AS rsid FROM v WHERE ds = 0)
  SELECT reason, count(*) AS n FROM (SELECT v.vid, CASE WHEN db.rsid IS NULL THEN 'no_pos' WHEN v.nea = ref AND v.ea = alt THEN 'forward' WHEN v.ea = ref AND v.nea = alt THEN 'reverse' ELSE 'pos_only_allele_mismatch' END AS reason
  FROM v LEFT JOIN db ON db.chr = v.chr AND db.pos = v.pos WHERE v.ds = 3) GROUP BY reason""", "v")  # fmt: skip
def j18(spark: SparkSession, d: str) -> DataFrame:
    v = variants(spark, d)
    db = v.where("ds = 0").select("chr", "pos", F.col("ea").alias("ref"), F.col("nea").alias("alt"), F.concat(F.lit("rs"), F.col("pos").cast("string")).alias("rsid")).distinct()
    m = v.where("ds = 3").join(db, ["chr", "pos"], "left")
    reason = F.when(F.col("rsid").isNull(), "no_pos").when((F.col("nea") == F.col("ref")) & (F.col("ea") == F.col("alt")), "forward").when((F.col("ea") == F.col("ref")) & (F.col("nea") == F.col("alt")), "reverse").otherwise("pos_only_allele_mismatch")
    return m.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query("j19_first_known_id", "SELECT chr, pos, arg_min(vid, (ds, vid)) AS vid, min(ds) AS ds FROM v WHERE ds > 0 AND NOT EXISTS (SELECT 1 FROM v o WHERE o.ds = 0 AND o.chr = v.chr AND o.pos = v.pos) GROUP BY chr, pos", "v")
def j19(spark: SparkSession, d: str) -> DataFrame:
    v = variants(spark, d)
    left = v.where("ds > 0").join(v.where("ds = 0").select("chr", "pos").distinct(), ["chr", "pos"], "left_anti")
    return left.groupBy("chr", "pos").agg(F.min_by("vid", F.struct("ds", "vid")).alias("vid"), F.min("ds").alias("ds"))


@query("j21_nearest_within", """, s AS (SELECT DISTINCT chr, pos FROM v WHERE ds = 1 AND z > 4.0556e0), l AS (SELECT DISTINCT chr, pos FROM v WHERE ds = 2 AND z > 2.807e0)
  SELECT s.chr, s.pos, min(abs(s.pos - l.pos)) AS distance FROM s JOIN l ON l.chr = s.chr AND abs(s.pos - l.pos) <= 100000 GROUP BY s.chr, s.pos""", "v")  # fmt: skip
def j21(spark: SparkSession, d: str) -> DataFrame:
    """The nearest annotated position within 100 kb."""
    v = variants(spark, d)
    s = v.where((F.col("ds") == 1) & (F.col("z") > loci.SUGGESTIVE)).select("chr", "pos").distinct()
    marks = v.where((F.col("ds") == 2) & (F.col("z") > 2.807)).select("chr", F.col("pos").alias("start"), F.col("pos").alias("end")).distinct().withColumn("at", F.col("start"))
    return ranges.nearest(s, marks, "at").where("distance <= 100000").select("chr", "pos", "distance")


@query("j26_overlapping_hits", """, x AS (SELECT locus, chr, "start", "end" FROM loci) SELECT a.locus, count(DISTINCT v.ds) AS n_ds, count(*) AS n FROM x a JOIN v ON v.chr = a.chr AND v.pos BETWEEN a."start" - 50000 AND a."end" + 50000 WHERE v.z > 4.0556e0 GROUP BY a.locus""", "v loci")
def j26(spark: SparkSession, d: str) -> DataFrame:
    v = variants(spark, d)
    wide = loci.seed_loci(v).select("locus", "chr", (F.col("start") - 50_000).alias("start"), (F.col("end") + 50_000).alias("end"))
    return ranges.points_in(v.where(F.col("z") > loci.SUGGESTIVE), wide).groupBy("locus").agg(F.count_distinct("ds").alias("n_ds"), F.count("*").alias("n"))


@query("j27_shared_positions", ", s AS (SELECT DISTINCT ds, chr, pos FROM v WHERE z > 4.0556e0) SELECT a.ds AS a, b.ds AS b, count(*) AS n FROM s a JOIN s b ON a.chr = b.chr AND a.pos = b.pos AND a.ds < b.ds GROUP BY 1, 2", "v")
def j27(spark: SparkSession, d: str) -> DataFrame:
    s = variants(spark, d).where(F.col("z") > loci.SUGGESTIVE).select("ds", "chr", "pos").distinct()
    return s.alias("a").join(s.alias("b"), ["chr", "pos"]).where("a.ds < b.ds").groupBy(F.col("a.ds").alias("a"), F.col("b.ds").alias("b")).agg(F.count("*").alias("n"))


@query("a10_attenuation", "SELECT ds, round(CASE WHEN m = 1 THEN NULL ELSE (i - 1) / (m - 1) END, 6) AS ratio FROM (SELECT ds, avg(z * z) AS m, regr_intercept(z * z, maf * 100) AS i FROM v GROUP BY ds)", "v")
def a10(spark: SparkSession, d: str) -> DataFrame:
    """(intercept - 1) / (mean chi-square - 1), the intercept being that of chi-square on linkage score; null where undefined."""
    chi2 = F.col("z") * F.col("z")
    m = variants(spark, d).groupBy("ds").agg(F.avg(chi2).alias("m"), F.regr_intercept(chi2, F.col("maf") * 100).alias("i"))
    return m.select("ds", F.round(F.when(F.col("m") != 1, (F.col("i") - 1) / (F.col("m") - 1)), 6).alias("ratio"))


@query("a15_category_counts", """, i AS (SELECT DISTINCT g.gid, g.biotype FROM g JOIN v ON v.chr = g.chr AND v.pos BETWEEN g."start" AND g."end" WHERE v.z > 5.4513e0)
  SELECT g.biotype, count(*) AS n_all, count(i.gid) AS n_loci FROM g LEFT JOIN i ON i.gid = g.gid GROUP BY g.biotype""", "v g")  # fmt: skip
def a15(spark: SparkSession, d: str) -> DataFrame:
    """Genes at significant variants by category; the background holds the foreground, as in the report."""
    g = genes(spark, d)
    hit = ranges.points_in(variants(spark, d).where(F.col("z") > loci.GENOME_WIDE), g.select("gid", "chr", "start", "end")).select("gid").distinct().withColumn("hit", F.lit(1))
    return g.join(hit, "gid", "left").groupBy("biotype").agg(F.count("*").alias("n_all"), F.count("hit").alias("n_loci"))


@query("a18_tertiles", ", s AS (SELECT ds, list_sort(list(se)) AS l FROM v GROUP BY ds) SELECT ds, round(l[CAST(len(l) // 3 + 1 AS INT)], 6) AS low, round(l[CAST(2 * len(l) // 3 + 1 AS INT)], 6) AS high FROM s", "v")
def a18(spark: SparkSession, d: str) -> DataFrame:
    """The values at n/3 and 2n/3 of each dataset in order."""
    t = stats.values_at(variants(spark, d), ["ds"], "se", {"low": F.floor(F.col("n") / 3), "high": F.floor(F.col("n") * 2 / 3)})
    return t.select("ds", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@query("a21_block_sums", """, o AS (SELECT ds, z * z AS y, maf * 100 AS x, (row_number() OVER (PARTITION BY ds ORDER BY chr, pos, vid) - 1) * 200 // count(*) OVER (PARTITION BY ds) AS block FROM v)
  SELECT ds, block, count(*) AS n, round(sum(x), 4) AS sx, round(sum(y), 4) AS sy, round(sum(x * x), 4) AS sxx, round(sum(x * y), 4) AS sxy FROM o GROUP BY ds, block""", "v")  # fmt: skip
def a21(spark: SparkSession, d: str) -> DataFrame:
    """Sufficient statistics of a weighted regression in 200 blocks of genome order."""
    v = stats.placed(variants(spark, d), ["ds"], F.col("chr") * 1_000_000 + F.floor(F.col("pos") / 100_000), ["pos", "vid"])
    o = v.withColumn("block", F.floor((F.col("place") - 1) * 200 / F.col("total")).cast("long"))
    x, y = F.col("maf") * 100, F.col("z") * F.col("z")
    return o.groupBy("ds", "block").agg(F.count("*").alias("n"), *(F.round(F.sum(c), 4).alias(k) for k, c in (("sx", x), ("sy", y), ("sxx", x * x), ("sxy", x * y))))


@query("a22_implied_sizes", "SELECT ds, round(quantile_cont(1e0 / (se * se * 2e0 * maf * (1e0 - maf)), 0.5), 4) AS median_n FROM v WHERE maf >= 0.05e0 GROUP BY ds", "v")
def a22(spark: SparkSession, d: str) -> DataFrame:
    implied = F.lit(1.0) / (F.col("se") * F.col("se") * 2.0 * F.col("maf") * (F.lit(1.0) - F.col("maf")))
    return stats.medians(variants(spark, d).where("maf >= 0.05").withColumn("implied", implied), ["ds"], "implied").select("ds", F.round("median", 4).alias("median_n"))


@query("a25_replication", """, inl AS (SELECT l.locus, v.* FROM v JOIN loci l ON v.chr = l.chr AND v.pos BETWEEN l."start" AND l."end"),
  f AS (SELECT *, 0.5e0 * ln(se * se / (se * se + 0.04e0)) + beta * beta / (se * se) * 0.04e0 / (2e0 * (se * se + 0.04e0)) AS lbf FROM inl), e AS (SELECT *, exp(lbf - max(lbf) OVER (PARTITION BY ds, locus)) AS e FROM f),
  p AS (SELECT *, e / sum(e) OVER (PARTITION BY ds, locus) AS pip FROM e), c AS (SELECT *, sum(pip) OVER (PARTITION BY ds, locus ORDER BY round(lbf, 9) DESC, vid) AS cum, row_number() OVER (PARTITION BY ds, locus, pos ORDER BY round(lbf, 9) DESC, vid) AS k FROM p),
  r AS (SELECT *, round(cum - pip, 9) < 0.95e0 AS cs FROM c WHERE k = 1), l AS (SELECT locus, ds, arg_min(pos, (-round(lbf, 9), pos)) AS lead FROM r GROUP BY 1, 2), n AS (SELECT locus, count(*) - 1 AS n FROM l GROUP BY 1),
  o AS (SELECT a.vid, a.locus, a.ds, a.pos, b.pip, b.cs, l.lead = b.pos AS lead, b.z > 5.4513e0 AS sig, CASE WHEN a.ea = b.ea AND a.nea = b.nea THEN 1 WHEN a.ea = b.nea AND a.nea = b.ea THEN -1 ELSE 0 END * sign(a.beta) * sign(b.beta) AS agrees
    FROM r a LEFT JOIN r b ON a.locus = b.locus AND a.pos = b.pos AND a.ds <> b.ds LEFT JOIN l ON l.locus = b.locus AND l.ds = b.ds)
  SELECT vid, ds, o.locus, round(count(*) FILTER (cs) / greatest(n, 1), 6) AS in_sets, round(coalesce(sum(pip), 0e0) / greatest(n, 1), 6) AS pip, round(count(*) FILTER (lead) / greatest(n, 1), 6) AS leads, round(count(*) FILTER (sig) / greatest(n, 1), 6) AS significant,
    CASE WHEN count(*) FILTER (agrees <> 0) = 0 THEN 0.5e0 ELSE round(count(*) FILTER (agrees > 0) / count(*) FILTER (agrees <> 0), 6) END AS same_direction, CAST(n > 0 AS INT) AS compared FROM o JOIN n USING (locus) GROUP BY vid, ds, o.locus, n""", "v loci")  # fmt: skip
def a25(spark: SparkSession, d: str) -> DataFrame:
    """How the other datasets of a locus see each position of a dataset: six features.

    Sums over all datasets less the own row, so no two datasets meet in pairs.
    """
    v = variants(spark, d)
    inside = ranges.points_in(v, loci.seed_loci(v).select("locus", "chr", "start", "end")).drop("start", "end").withColumn("lbf", finemap.log_bayes_factor(F.col("beta"), F.col("se")))
    own, order = ["ds", "locus"], [F.desc(F.round("lbf", 9)), F.col("vid")]
    p = finemap.posterior(inside, own).withColumn("cum", F.sum("pip").over(Window.partitionBy(*own).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    r = p.withColumn("k", F.row_number().over(Window.partitionBy(*own, "pos").orderBy(*order))).where("k = 1")
    lead = F.first("pos").over(Window.partitionBy(*own).orderBy(order[0], "pos")) == F.col("pos")
    # +1, -1 or 0 for the effect of the allele that is first in the alphabet
    direction = F.signum("beta") * F.when(F.col("ea") < F.col("nea"), 1).otherwise(-1)
    flags = {"cs": F.round(F.col("cum") - F.col("pip"), 9) < 0.95, "lead": lead, "sig": F.col("z") > loci.GENOME_WIDE, "up": direction > 0, "down": direction < 0}
    r = r.select("vid", *own, "pos", F.least("ea", "nea").alias("a1"), F.greatest("ea", "nea").alias("a2"), "pip", *(c.cast("int").alias(n) for n, c in flags.items()))
    here, alleles = Window.partitionBy("locus", "pos"), Window.partitionBy("locus", "pos", "a1", "a2")
    others = lambda c, w=here: F.sum(c).over(w) - F.col(c)
    # a row for each locus
    counts = r.groupBy("locus").agg((F.count_distinct("ds") - 1).alias("n"))
    wide = r.select("vid", *own, "up", "down", others("cs").alias("cs"), others("pip").alias("pip"), others("lead").alias("lead"), others("sig").alias("sig"), others("up", alleles).alias("ups"), others("down", alleles).alias("downs")).join(counts, "locus")
    share = lambda c: F.round(F.col(c) / F.greatest("n", F.lit(1)), 6)
    told = F.when(F.col("up") + F.col("down") > 0, F.col("ups") + F.col("downs")).otherwise(0)
    agrees = F.when(F.col("up") > 0, F.col("ups")).otherwise(F.col("downs"))
    return wide.select(
        "vid", *own, share("cs").alias("in_sets"), F.round(F.greatest("pip", F.lit(0.0)) / F.greatest("n", F.lit(1)), 6).alias("pip"), share("lead").alias("leads"), share("sig").alias("significant"),
        F.when(told == 0, 0.5).otherwise(F.round(F.try_divide(agrees, told), 6)).alias("same_direction"), (F.col("n") > 0).cast("int").alias("compared"),
    )


@query("a28_latest_runs", "SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS latest, max(ts) AS at, count(*) AS n FROM events GROUP BY user_id, event_type")
def a28(spark: SparkSession, d: str) -> DataFrame:
    """The latest run of each tool (event type) at each locus (user)."""
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("latest"), F.max("ts").alias("at"), F.count("*").alias("n"))


@query("w01_downsampled", ", k AS (SELECT ds, vid, z > 3.8906e0 AS s, row_number() OVER (PARTITION BY ds ORDER BY (z > 3.8906e0) DESC, vid * 7919 % 10007, vid) AS r FROM v) SELECT ds, count(*) AS n, count(*) FILTER (s) AS n_significant, CAST(sum(vid % 1000) AS BIGINT) AS mix FROM k WHERE s OR r <= 5000 GROUP BY ds", "v")
def w01(spark: SparkSession, d: str) -> DataFrame:
    """All rows below 1e-4 and others in a fixed pseudo-random order up to 5000 (a sampling operator)."""
    s, hashed = F.col("z") > 3.8906, F.col("vid") * 7919 % 10_007
    v = variants(spark, d).select("ds", "vid", s.alias("s"), hashed.alias("h"))
    # of each part of a dataset no more than 5000 others can be wanted, and those are ranked again
    parts = Window.partitionBy("ds", "s", F.pmod(F.xxhash64("vid"), F.lit(64))).orderBy("h", "vid")
    few = v.where(~F.col("s")).withColumn("r", F.row_number().over(parts)).where("r <= 5000")
    few = few.withColumn("r", F.row_number().over(Window.partitionBy("ds").orderBy("h", "vid"))).where("r <= 5000")
    taken = v.where("s").groupBy("ds").agg(F.count("*").alias("n_s"))
    rest = few.join(taken, "ds", "left").where(F.col("r") + F.coalesce("n_s", F.lit(0)) <= 5000)
    kept = v.where("s").select("ds", "vid", "s").unionByName(rest.select("ds", "vid", "s"))
    return kept.groupBy("ds").agg(F.count("*").alias("n"), F.count_if("s").alias("n_significant"), F.sum(F.col("vid") % 1000).alias("mix"))


@query("w03_distance_pruned", """, p AS (SELECT DISTINCT chr, pos FROM v), k AS (SELECT chr, min(pos) AS pos FROM p GROUP BY chr
  UNION ALL SELECT k.chr, (SELECT min(p.pos) FROM p WHERE p.chr = k.chr AND p.pos >= k.pos + 250000) FROM k WHERE k.pos IS NOT NULL) SELECT chr, pos FROM k WHERE pos IS NOT NULL""", "v")  # fmt: skip
def w03(spark: SparkSession, d: str) -> DataFrame:
    """Positions kept greedily, each at least 250 kb after the last kept one."""
    return loci.distance_pruned(variants(spark, d).select("chr", "pos"), 250_000)


@query("w07_lead_windows", """, p AS (SELECT chr, pos, max(z) AS z FROM v GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY chr ORDER BY pos) AS r FROM p), l AS (SELECT chr, arg_min(r, (-round(z, 9), pos)) AS lead FROM r GROUP BY chr)
  SELECT r.chr, r.pos, r.r - l.lead AS step FROM r JOIN l ON r.chr = l.chr WHERE abs(r.r - l.lead) <= 100""", "v")  # fmt: skip
def w07(spark: SparkSession, d: str) -> DataFrame:
    """The hundred positions on either side of each chromosome's lead."""
    r = stats.placed(loci.best_by_position(variants(spark, d)), ["chr"], F.floor(F.col("pos") / loci.BIN), ["pos"]).withColumnRenamed("place", "r")
    lead = r.groupBy("chr").agg(F.min_by("r", F.struct(-F.round("z", 9), "pos")).alias("lead"))
    return r.join(F.broadcast(lead), "chr").where(F.abs(F.col("r") - F.col("lead")) <= 100).select("chr", "pos", (F.col("r") - F.col("lead")).alias("step"))


@query("w15_softmax_scores", """, s AS (SELECT locus, ds, 0.3e0 * z + 0.1e0 * n_suggestive AS s FROM dl) SELECT locus, ds, round(exp(s - max(s) OVER (PARTITION BY locus)) / sum(exp(s - m)) OVER (PARTITION BY locus), 6) AS share FROM (SELECT *, max(s) OVER (PARTITION BY locus) AS m FROM s)""", "v loci dl")
def w15(spark: SparkSession, d: str) -> DataFrame:
    """Scores of a linear model as shares within their locus."""
    v = variants(spark, d)
    s = loci.dataset_by_locus(v, loci.seed_loci(v)).select("locus", "ds", (F.lit(0.3) * F.col("z") + F.lit(0.1) * F.col("n_suggestive")).alias("lbf"))
    return finemap.posterior(s, ["locus"]).select("locus", "ds", F.round("pip", 6).alias("share"))


@query("p12_meta_analysis", """, b AS (SELECT chr, pos, ds, arg_min(beta, vid) AS beta, arg_min(se, vid) AS se FROM v GROUP BY 1, 2, 3) SELECT chr, pos, count(*) AS n, round(sum(beta / (se * se)) / sum(1 / (se * se)), 6) AS beta, round(sqrt(1 / sum(1 / (se * se))), 6) AS se FROM b GROUP BY chr, pos""", "v")
def p12(spark: SparkSession, d: str) -> DataFrame:
    """Inverse-variance weighted meta-analysis over datasets."""
    b = variants(spark, d).groupBy("chr", "pos", "ds").agg(F.min_by("beta", "vid").alias("beta"), F.min_by("se", "vid").alias("se"))
    w = F.lit(1.0) / (F.col("se") * F.col("se"))
    return b.groupBy("chr", "pos").agg(F.count("*").alias("n"), F.round(F.sum(F.col("beta") * w) / F.sum(w), 6).alias("beta"), F.round(F.sqrt(F.lit(1.0) / F.sum(w)), 6).alias("se"))


@query("p21_search", """, s AS (SELECT l.locus, v.vid, v.chr, v.pos, round(v.z, 9) AS z FROM v JOIN loci l ON v.chr = l.chr AND v.pos BETWEEN l."start" AND l."end" WHERE v.z > 5.4513e0),
  i AS (SELECT g.gid, s.vid, 'contains' AS match, s.z FROM s JOIN g ON g.chr = s.chr AND s.pos BETWEEN g."start" AND g."end"),
  near AS (SELECT locus, gid, row_number() OVER (PARTITION BY locus ORDER BY distance, gid) AS k FROM (SELECT l.locus, g.gid, greatest(0, g."start" - (l."start" + l."end") // 2, (l."start" + l."end") // 2 - g."end") AS distance FROM loci l JOIN g ON l.chr = g.chr AND l."start" <= g."end" AND l."end" >= g."start"))
  SELECT gid, vid, match, round(z, 6) AS z FROM i UNION ALL SELECT near.gid, s.vid, 'nearest', round(s.z, 6) FROM s JOIN near ON near.locus = s.locus AND near.k <= 2 WHERE s.vid NOT IN (SELECT vid FROM i)""", "v loci g")  # fmt: skip
def p21(spark: SparkSession, d: str) -> DataFrame:
    """The search index of genes: significant rows inside each gene, or else under the two genes nearest to their locus; the strongest first."""
    v = variants(spark, d)
    found = loci.seed_loci(v).select("locus", "chr", "start", "end")
    hits = ranges.points_in(v.where(F.col("z") > loci.GENOME_WIDE).select("vid", "chr", "pos", F.round("z", 9).alias("z")), found).drop("start", "end")
    inside = ranges.points_in(hits, genes(spark, d).select("gid", "chr", "start", "end")).select("gid", "vid", F.lit("contains").alias("match"), "z")
    rest = hits.join(inside.select("vid").distinct(), "vid", "left_anti")
    near = rest.join(j04(spark, d).select("locus", "gid"), "locus").select("gid", "vid", F.lit("nearest").alias("match"), "z")
    return inside.unionByName(near).withColumn("z", F.round("z", 6)).orderBy("gid", F.desc("z"), "vid")


@query("p06_clumps")
def p06(spark: SparkSession, d: str) -> DataFrame:
    """Greedy clumps: each position at 5e-8 joins the strongest unclaimed one within 250 kb."""
    best = loci.best_by_position(variants(spark, d).where(F.col("z") > loci.GENOME_WIDE))
    return loci.clumped(best, 250_000).groupBy("chr", "lead").agg(F.count("*").alias("n"), F.min("pos").alias("start"), F.max("pos").alias("end"))


@query("m06_fisher_enrichment", """, b AS (SELECT chr, pos, max(z) AS z FROM v GROUP BY 1, 2), marks AS (SELECT DISTINCT eid, mark FROM k),
  i AS (SELECT m.eid, m.mark, b.z > 5.4513e0 AS fg, EXISTS (SELECT 1 FROM k WHERE k.mark = m.mark AND k.eid = m.eid AND k.chr = b.chr AND b.pos BETWEEN k."start" AND k."end") AS inside FROM b, marks m),
  n AS (SELECT eid, mark, count(*) FILTER (fg AND inside) AS a, count(*) FILTER (fg AND NOT inside) AS b, count(*) FILTER (NOT fg AND inside) AS c, count(*) FILTER (NOT fg AND NOT inside) AS d FROM i GROUP BY 1, 2),
  w AS (SELECT *, list_transform(range(greatest(0, a - d), least(a + b, a + c) + 1), lambda x: -(lgamma(x + 1e0) + lgamma(a + b - x + 1e0) + lgamma(a + c - x + 1e0) + lgamma(d - a + x + 1e0))) AS logs, -(lgamma(a + 1e0) + lgamma(b + 1e0) + lgamma(c + 1e0) + lgamma(d + 1e0)) AS own FROM n)
  SELECT eid, mark, round(list_sum(list_transform(list_filter(logs, lambda x: x <= own + 1e-9), lambda x: exp(x - list_max(logs)))) / list_sum(list_transform(logs, lambda x: exp(x - list_max(logs)))), 6) AS p FROM w""", "v k")  # fmt: skip
def m06(spark: SparkSession, d: str) -> DataFrame:
    """Two-sided exact p of the 2x2 table of each cell type's marks."""
    t = a17(spark, d)
    return t.select("eid", "mark", F.round(S.fisher_two_sided(*(F.col(x) for x in "abcd")), 6).alias("p"))


_DOSE = """w AS (SELECT a.vec_id AS i, list_transform(range(1, 65), lambda x: CAST(a.embedding[x] AS DOUBLE) + CAST(b.embedding[x] AS DOUBLE) + CAST(c.embedding[x] AS DOUBLE) + CAST(e.embedding[x] AS DOUBLE)) AS d
  FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 JOIN embeddings c ON c.vec_id = a.vec_id + 2 JOIN embeddings e ON e.vec_id = a.vec_id + 3),
cen AS (SELECT i, list_transform(d, lambda x: x - list_avg(d)) AS d FROM w), nor AS (SELECT i, list_transform(d, lambda x: x / sqrt(list_dot_product(d, d))) AS d FROM cen),
ld AS (SELECT a.i, b.i AS j, list_dot_product(a.d, b.d) AS r FROM nor a JOIN nor b ON b.i > a.i AND b.i <= a.i + 3)"""
VIEW["ld"] = _DOSE


@query("p02_linkage", "SELECT a.i, b.i AS j, round(list_dot_product(a.d, b.d), 6) AS r FROM nor a JOIN nor b ON b.i > a.i AND b.i <= a.i + 49", "ld")
def p02(spark: SparkSession, d: str) -> DataFrame:
    """Correlations of simulated dosages within windows of fifty variants: the upper half of each window's matrix."""
    return programs.linkage(dosages(spark, d), "i", "d", 49).select("i", "j", F.round("r", 6).alias("r"))


@query("p05b_linkage_check", """, both_ AS (SELECT i, j, r FROM ld UNION ALL SELECT j, i, r FROM ld), n AS (SELECT * FROM both_ WHERE abs(r) > 0.5e0 AND abs(r) < 0.99e0), b AS (SELECT i, arg_max(j, (round(abs(r), 9), -j)) AS j FROM n GROUP BY i),
  z AS (SELECT vec_id AS i, (vec_id * 37 % 101 - 50) / 20e0 AS z FROM embeddings), t AS (SELECT b.i, b.j, (x.z - n.r * y.z) * (x.z - n.r * y.z) / (1 - n.r * n.r) AS t FROM b JOIN n ON n.i = b.i AND n.j = b.j JOIN z x ON x.i = b.i JOIN z y ON y.i = b.j)
  SELECT i, j, round(t, 5) AS residual, t > 10.83e0 AS flagged, t > 15.14e0 AS severe FROM t""", "ld")  # fmt: skip
def p05b(spark: SparkSession, d: str) -> DataFrame:
    z = table(spark, d, "embeddings").select(F.col("vec_id").alias("i"), ((F.col("vec_id") * 37 % 101 - 50) / 20.0).alias("z"))
    return programs.linkage_check(programs.linkage(dosages(spark, d), "i", "d", 3), z).withColumn("residual", F.round("residual", 5))


@query("p08_single_effects")
def p08(spark: SparkSession, d: str) -> DataFrame:
    """Inclusion probabilities of simulated variants in windows of fifty; every seventeenth has an effect."""
    x = dosages(spark, d).select(F.floor(F.col("i") / 50).alias("locus"), F.col("i").alias("variant"), F.when(F.col("i") % 17 == 0, 6.0).otherwise((F.col("i") * 37 % 41 - 20) / 20.0).alias("z"), F.col("d").alias("dosages"))
    return programs.fine_mapped(x, "locus", 10_000).withColumn("pip", F.round("pip", 6))


@query("p15_score_regression")
def p15(spark: SparkSession, d: str) -> DataFrame:
    """Slope, intercept and jackknife errors for each dataset from its 200 blocks of sums."""
    b = a21(spark, d)
    blocks: dict[int, list] = {}
    for r in b.orderBy("ds", "block").collect():  # 200 rows for each dataset
        blocks.setdefault(r.ds, []).append((r.n, r.sx, r.sy, r.sxx, r.sxy))
    rows = [(ds, *(round(x, 6) for x in programs.score_regression(s, 1e6, 1e5))) for ds, s in sorted(blocks.items())]
    return spark.createDataFrame(rows, "ds int, h2 double, h2_error double, intercept double, intercept_error double")


@query("p18_ranked_variants", """, s AS (SELECT locus, ds, (0.8e0 * ((z - 5) / 2)) + 0.3e0 * ((n_suggestive - 1) / 1e0) + 0.1e0 * ((n_rows - 10) / 5e0) AS s FROM dl)
  SELECT locus, ds, round(s, 6) AS score, row_number() OVER (PARTITION BY locus ORDER BY round(s, 6) DESC, ds) AS rank FROM s""", "v loci dl")  # fmt: skip
def p18(spark: SparkSession, d: str) -> DataFrame:
    v = variants(spark, d)
    f = loci.dataset_by_locus(v, loci.seed_loci(v))
    score = programs.linear_scores(f, ["locus"], [("z", 5.0, 2.0, 0.8), ("n_suggestive", 1.0, 1.0, 0.3), ("n_rows", 10.0, 5.0, 0.1)])
    scored = f.select("locus", "ds", F.round(score, 6).alias("score"))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("locus").orderBy(F.desc("score"), "ds")).cast("long"))


@query("w16_reasons", """, t AS (SELECT locus, ds, 'z' AS feature, 0.8e0 * ((z - 5) / 2) AS t FROM dl UNION ALL SELECT locus, ds, 'n_suggestive', 0.3e0 * (n_suggestive - 1) FROM dl UNION ALL SELECT locus, ds, 'n_rows', 0.1e0 * ((n_rows - 10) / 5e0) FROM dl),
  g AS (SELECT locus, ds, feature, t - avg(t) OVER (PARTITION BY locus, feature) AS gain FROM t), k AS (SELECT *, row_number() OVER (PARTITION BY locus, ds ORDER BY round(gain, 9) DESC, feature) AS rank FROM g WHERE round(gain, 9) > 0)
  SELECT locus, ds, feature, round(gain, 6) AS gain, rank FROM k WHERE rank <= 3""", "v loci dl")  # fmt: skip
def w16(spark: SparkSession, d: str) -> DataFrame:
    v = variants(spark, d)
    f = loci.dataset_by_locus(v, loci.seed_loci(v)).select("locus", "ds", "z", F.col("n_suggestive").cast("double").alias("n_suggestive"), F.col("n_rows").cast("double").alias("n_rows"))
    return programs.reasons(f, "locus", "ds", [("z", 5.0, 2.0, 0.8), ("n_suggestive", 1.0, 1.0, 0.3), ("n_rows", 10.0, 5.0, 0.1)]).withColumn("gain", F.round("gain", 6))


@query("m05_anova_p")
def m05(spark: SparkSession, d: str) -> DataFrame:
    a = stats.one_way_anova(variants(spark, d), ["chr"], "ds", "z")
    return a.select("chr", F.round("f", 6).alias("f"), F.round(programs.f_upper("f", (F.col("n_groups") - 1).cast("double"), (F.col("n") - F.col("n_groups")).cast("double")), 6).alias("p"))


def _dataset_distances(spark: SparkSession, d: str) -> tuple[list[int], np.ndarray]:
    """Datasets and the matrix of their distances: a cell for each two datasets, whatever their rows."""
    pairs = a19(spark, d).collect()
    names = sorted({x for r in pairs for x in (r.a, r.b)})
    m = np.zeros((len(names), len(names)))
    for r in pairs:
        m[names.index(r.a), names.index(r.b)] = m[names.index(r.b), names.index(r.a)] = r.distance
    return names, m


@query("p19_dataset_clusters")
def p19(spark: SparkSession, d: str) -> DataFrame:
    """Merge heights of the datasets by average linkage of their cosine distances."""
    _, m = _dataset_distances(spark, d)
    return spark.createDataFrame([(k, a, b, round(h, 6)) for k, (a, b, h) in enumerate(programs.average_linkage(m))], "step int, a int, b int, height double")


@query("p19b_cluster_report")
def p19b(spark: SparkSession, d: str) -> DataFrame:
    """Each dataset's cluster under the number of clusters of best silhouette, and how well categories explain the distances."""
    names, m = _dataset_distances(spark, d)
    schema = "ds int, category int, cluster int, clusters int, silhouette double, adjusted_rand double, f double, share double, p double"
    chosen = programs.best_cut(m)
    if chosen is None:
        return spark.createDataFrame([], schema)
    labels, score = chosen
    category = np.array([x % 2 for x in names])
    rand = programs.adjusted_rand(labels, category)
    f, share, p = programs.permanova(m, category) if 1 < len(set(category.tolist())) < len(names) else (None, None, None)
    tell = [None if x is None else round(float(x), 6) for x in (score, rand, f, share, p)]
    return spark.createDataFrame([(x, int(c), int(k), int(labels.max()) + 1, *tell) for x, c, k in zip(names, category, labels)], schema)


@query("j23_trait_orientation", """, x AS (SELECT chr, pos, ea, nea, arg_min(beta, vid) AS beta FROM v WHERE ds = 0 GROUP BY 1, 2, 3, 4), y AS (SELECT chr, pos, nea AS ea, ea AS nea, arg_min(beta, vid) AS beta FROM v WHERE ds = 1 GROUP BY 1, 2, 3, 4)
  SELECT x.chr, x.pos, round(x.beta, 9) + 0e0 AS beta1, round(CASE WHEN x.ea = y.ea THEN y.beta ELSE -y.beta END, 9) + 0e0 AS beta2 FROM x JOIN y ON x.chr = y.chr AND x.pos = y.pos AND ((x.ea = y.ea AND x.nea = y.nea) OR (x.ea = y.nea AND x.nea = y.ea))""", "v")  # fmt: skip
def j23(spark: SparkSession, d: str) -> DataFrame:
    """Effects of two traits at shared positions, the second turned to the first's allele; others are dropped."""
    per = variants(spark, d).groupBy("ds", "chr", "pos", "ea", "nea").agg(F.min_by("beta", "vid").alias("beta"))
    y = per.where("ds = 1").select("chr", "pos", F.col("nea").alias("ea2"), F.col("ea").alias("nea2"), F.col("beta").alias("b2"))
    kind = S.match_class(F.col("ea2"), F.col("nea2"), F.col("ea"), F.col("nea"))
    both = per.where("ds = 0").join(y, ["chr", "pos"]).withColumn("kind", kind).where(F.col("kind").isin("FORWARD", "REVERSE"))
    return both.select("chr", "pos", (F.round("beta", 9) + F.lit(0.0)).alias("beta1"), (F.round(F.when(F.col("kind") == "FORWARD", F.col("b2")).otherwise(-F.col("b2")), 9) + F.lit(0.0)).alias("beta2"))


@query("a24_gene_scores", """SELECT g.gid, k.eid, round(sum(v.z * k.signal), 4) AS score, round(max(k.signal), 6) AS top, count(*) AS n FROM v JOIN k ON k.chr = v.chr AND v.pos BETWEEN k."start" AND k."end" JOIN g ON g.chr = v.chr AND v.pos BETWEEN g."start" AND g."end"
  WHERE v.z > 4.0556e0 GROUP BY 1, 2""", "v k g")  # fmt: skip
def a24(spark: SparkSession, d: str) -> DataFrame:
    """Scores of genes in each cell type over its elements that hold suggestive rows."""
    hits = variants(spark, d).where(F.col("z") > loci.SUGGESTIVE).groupBy("chr", "pos").agg(F.sum("z").alias("z"), F.count("*").alias("rows")).select("chr", "pos", F.col("chr").alias("on"), F.col("pos").alias("at"), "z", "rows")
    # all pairs of a position's rows and a cell type's elements over it: z times the sum of signals
    over = ranges.covered(hits, peaks(spark, d).withColumn("top", F.col("signal")), ["on", "at", "z", "rows"], ["signal"], ["top"], "eid")
    pairs = over.select(F.col("on").alias("chr"), F.col("at").alias("pos"), "eid", (F.col("z") * F.col("signal")).alias("score"), (F.col("rows") * F.col("n")).cast("double").alias("pairs"), "top")
    found = ranges.folded(pairs, genes(spark, d), ["gid"], ["score", "pairs"], ["top"], "eid")
    return found.groupBy("gid", "eid").agg(F.round(F.sum("score"), 4).alias("score"), F.round(F.max("top"), 6).alias("top"), F.sum("pairs").cast("long").alias("n"))


@query("p23_merged_edit", """SELECT chr, "start", "end", row_number() OVER (ORDER BY chr, "start", "end") AS locus FROM (SELECT chr, "start", "end" FROM loci WHERE locus NOT IN (1, 2) UNION ALL SELECT chr, min("start"), max("end") FROM loci WHERE locus IN (1, 2) GROUP BY chr)""", "v loci")
def p23(spark: SparkSession, d: str) -> DataFrame:
    return programs.merged(loci.seed_loci(variants(spark, d)), [1, 2])


@query("p23b_edit_history", """, l AS (SELECT locus, chr, "start", "end" FROM loci), e1 AS (SELECT chr, "start", CASE WHEN locus = 2 THEN "end" + 50000 ELSE "end" END AS "end" FROM l), n1 AS (SELECT row_number() OVER (ORDER BY chr, "start", "end") AS locus, * FROM e1),
  n2 AS (SELECT row_number() OVER (ORDER BY chr, "start", "end") AS locus, chr, "start", "end" FROM n1 WHERE locus <> 1), e3 AS (SELECT chr, "start", "end" FROM n2 UNION ALL SELECT 23, 1000, 2000), n3 AS (SELECT row_number() OVER (ORDER BY chr, "start", "end") AS locus, * FROM e3)
  SELECT 0 AS version, * FROM l UNION ALL SELECT 1, * FROM n1 UNION ALL SELECT 2, * FROM n2 UNION ALL SELECT 3, * FROM n3 UNION ALL SELECT 4, * FROM n2""", "v loci")  # fmt: skip
def p23b(spark: SparkSession, d: str) -> DataFrame:
    """Versions of the loci: as found, one made longer, one deleted, one created, and that undone."""
    v0 = loci.seed_loci(variants(spark, d)).select("locus", "chr", "start", "end")
    v1 = programs.extended(v0, 2, 0, 50_000)
    v2 = programs.deleted(v1, 1)
    v3 = programs.created(v2, 23, 1000, 2000)
    shown = [x.select(F.lit(k).alias("version"), "locus", "chr", "start", "end") for k, x in enumerate((v0, v1, v2, v3, programs.undone([v0, v1, v2, v3])))]
    out = shown[0]
    for x in shown[1:]:
        out = out.unionByName(x)
    return out


@query("p22_split_checks", """, l AS (SELECT locus, chr, "start", "end", ("start" + "end") // 2 AS m FROM loci WHERE "end" > "start"),
  x AS (SELECT locus, part, CASE WHEN part = 0 THEN "start" ELSE m + locus % 3 * 150000 END AS "start", CASE WHEN part = 0 THEN m ELSE "end" + 300000 END AS "end" FROM l, (VALUES (0), (1)) q(part)),
  w AS (SELECT *, lag("end") OVER (PARTITION BY locus ORDER BY "start", "end") AS before FROM x)
  SELECT locus, count(*) AS parts, min("start" - before) AS least_gap, bool_or("start" < before) AS overlaps, bool_and("start" <= "end") AND min("start" - before) >= 250000 AS valid FROM w GROUP BY locus""", "v loci")  # fmt: skip
def p22(spark: SparkSession, d: str) -> DataFrame:
    """Proposed splits of each locus in the middle, with no gap, one too small and one wide enough."""
    middle = F.floor((F.col("start") + F.col("end")) / 2)
    l = loci.seed_loci(variants(spark, d)).where(F.col("end") > F.col("start")).withColumn("m", middle)
    parts = F.array(F.struct("start", F.col("m").alias("end")), F.struct((F.col("m") + F.col("locus") % 3 * 150_000).alias("start"), (F.col("end") + 300_000).alias("end")))
    return programs.split_checks(l.select("locus", F.explode(parts).alias("p")).select("locus", "p.start", "p.end"), "locus")


# ---- reports ----------------------------------------------------------------------------------


@query("f18_disease_groups", "SELECT CASE WHEN trim(p_brand) = '' THEN 'ungrouped' ELSE lower(split_part(p_brand, '#', 1)) END AS disease, count(*) AS n FROM part GROUP BY 1")
def f18(spark: SparkSession, d: str) -> DataFrame:
    """Groups by the part of a name before its first mark."""
    name = F.when(F.trim("brand") == "", "ungrouped").otherwise(F.lower(F.substring_index("brand", "#", 1)))
    return genes(spark, d).groupBy(name.alias("disease")).agg(F.count("*").alias("n"))


@query("j06_nearest_start", """, t AS (SELECT gid, chr, CASE WHEN strand = '+' THEN "start" ELSE "end" END AS tss FROM g), s AS (SELECT vid, chr, pos FROM v WHERE z > 5.4513e0)
  SELECT s.vid, min(abs(t.tss - s.pos)) AS distance, round(min(log10(1 + abs(t.tss - s.pos))), 6) AS log_distance FROM s JOIN t ON t.chr = s.chr AND abs(t.tss - s.pos) <= 1000000 GROUP BY s.vid""", "v g")  # fmt: skip
def j06(spark: SparkSession, d: str) -> DataFrame:
    """Distance to the nearest strand-aware gene start within 1 Mb."""
    tss = F.when(F.col("strand") == "+", F.col("start")).otherwise(F.col("end"))
    t = genes(spark, d).select("gid", "chr", tss.alias("start"), tss.alias("end"))
    near = ranges.nearest(variants(spark, d).where(F.col("z") > loci.GENOME_WIDE).select("vid", "chr", "pos"), t, "gid").where("distance <= 1000000")
    return near.select("vid", "distance", F.round(F.log10(F.lit(1) + F.col("distance")), 6).alias("log_distance"))


@query("j07_membership_flags", """, p AS (SELECT DISTINCT chr, pos FROM v), f AS (SELECT chr, pos, CAST(EXISTS (SELECT 1 FROM g WHERE g.chr = p.chr AND p.pos BETWEEN g."start" AND g."end") AS INT) AS in_gene,
  CAST(EXISTS (SELECT 1 FROM k WHERE k.chr = p.chr AND p.pos BETWEEN k."start" AND k."end") AS INT) AS in_peak FROM p) SELECT vid, in_gene, in_peak FROM v JOIN f USING (chr, pos)""", "v g k")  # fmt: skip
def j07(spark: SparkSession, d: str) -> DataFrame:
    """Whether each row lies in a gene and in an element; positions are looked up once each."""
    v = variants(spark, d).select("vid", "chr", "pos")
    places = v.select("chr", "pos").distinct()
    flag = lambda i, name: ranges.points_in(places, i.select("chr", "start", "end"), "left_semi").select("chr", "pos", F.lit(1).alias(name))
    both = flag(genes(spark, d), "in_gene").join(flag(peaks(spark, d), "in_peak"), ["chr", "pos"], "full")
    return v.join(both, ["chr", "pos"], "left").select("vid", F.coalesce("in_gene", F.lit(0)).alias("in_gene"), F.coalesce("in_peak", F.lit(0)).alias("in_peak"))


@query("j12_best_target", """SELECT l.locus, k.mark, arg_max(k.peak, (k.signal, -k.peak)) AS peak, round(max(k.signal), 6) AS signal FROM loci l JOIN k ON k.chr = l.chr AND k."end" > l."start" - 1 AND k."start" < l."end" GROUP BY 1, 2""", "v loci k")
def j12(spark: SparkSession, d: str) -> DataFrame:
    """The strongest element of each mark in each locus; elements are half-open (start, end]."""
    k = peaks(spark, d).select("peak", "mark", "signal", "chr", (F.col("start") + 1).alias("start"), "end")
    found = ranges.overlapping(loci.seed_loci(variants(spark, d)).select("locus", "chr", "start", "end"), k)
    return found.groupBy("locus", F.col("mark_b").alias("mark")).agg(F.max_by("peak_b", F.struct("signal_b", -F.col("peak_b"))).alias("peak"), F.round(F.max("signal_b"), 6).alias("signal"))


@query("j22_either_order", """, s AS (SELECT DISTINCT chr, pos, nea AS a, ea AS b, pos % 40 / 2e0 AS score FROM v WHERE ds = 4), t AS (SELECT vid, chr, pos, ea, nea FROM v WHERE ds = 5)
  SELECT t.vid, coalesce(x.score, y.score, 2e0) AS score FROM t LEFT JOIN s x ON x.chr = t.chr AND x.pos = t.pos AND x.a = t.ea AND x.b = t.nea LEFT JOIN s y ON y.chr = t.chr AND y.pos = t.pos AND y.a = t.nea AND y.b = t.ea""", "v")  # fmt: skip
def j22(spark: SparkSession, d: str) -> DataFrame:
    """Annotation scores by position and alleles in either order, one join on the sorted pair; 2 where there is none."""
    v = variants(spark, d)
    key = lambda: (F.least("ea", "nea").alias("a"), F.greatest("ea", "nea").alias("b"))
    s = v.where("ds = 4").select("chr", "pos", *key(), (F.col("pos") % 40 / 2.0).alias("score")).distinct()
    t = v.where("ds = 5").select("vid", "chr", "pos", *key())
    return t.join(s, ["chr", "pos", "a", "b"], "left").select("vid", F.coalesce("score", F.lit(2.0)).alias("score"))


@query("j24_latest_result", """, r AS (SELECT l_orderkey AS k, arg_max(l_extendedprice, (l_shipdate, l_linenumber, l_extendedprice)) AS value FROM lineitem GROUP BY 1) SELECT c.cid, r.value FROM c LEFT JOIN r ON r.k = c.cid""", "c")
def j24(spark: SparkSession, d: str) -> DataFrame:
    """The latest result of each key, beside every exported row."""
    r = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("cid")).agg(F.max_by("l_extendedprice", F.struct("l_shipdate", "l_linenumber", "l_extendedprice")).alias("value"))
    return catalog(spark, d).select("cid").join(r, "cid", "left")


@query("a13_region_anova", """, per AS (SELECT locus, ds, count(*) AS n, sum(z) AS s, sum(z * z) AS q FROM inl GROUP BY 1, 2), tot AS (SELECT locus, count(*) AS k, sum(n) AS n, sum(s) AS s, sum(q) AS q, sum(s * s / n) AS b FROM per GROUP BY locus)
  SELECT locus, k AS n_groups, CAST(n AS BIGINT) AS n, round(((b - s * s / n) / (k - 1)) / ((q - b) / (n - k)), 4) AS f FROM tot WHERE k >= 2 AND n > k + 3""", "v loci dl")  # fmt: skip
def a13(spark: SparkSession, d: str) -> DataFrame:
    v = variants(spark, d)
    inside = ranges.points_in(v, loci.seed_loci(v).select("locus", "chr", "start", "end"))
    return stats.one_way_anova(inside, ["locus"], "ds", "z").where("n_groups >= 2 and n > n_groups + 3").withColumn("f", F.round("f", 4))


@query("a23_local_sums", "SELECT locus, round(sum(beta * beta), 6) AS h2, round(sqrt(sum(se * se)), 6) AS error FROM inl GROUP BY locus", "v loci dl")
def a23(spark: SparkSession, d: str) -> DataFrame:
    v = variants(spark, d)
    inside = ranges.points_in(v, loci.seed_loci(v).select("locus", "chr", "start", "end"))
    return inside.groupBy("locus").agg(F.round(F.sum(F.col("beta") * F.col("beta")), 6).alias("h2"), F.round(F.sqrt(F.sum(F.col("se") * F.col("se"))), 6).alias("error"))


@query("a33_failures_after_success", """, e AS (SELECT user_id, event_type, event_type = 'error' AS bad, ts, event_id FROM events), l AS (SELECT user_id, max(ts) FILTER (NOT bad) AS ok, max(ts) FILTER (bad) AS failed FROM e GROUP BY user_id)
  SELECT user_id, failed FROM l WHERE failed IS NOT NULL AND (ok IS NULL OR failed > ok)""")  # fmt: skip
def a33(spark: SparkSession, d: str) -> DataFrame:
    """Failures that are newer than the last success."""
    bad = F.col("event_type") == "error"
    last = table(spark, d, "events").groupBy("user_id").agg(F.max(F.when(~bad, F.col("ts"))).alias("ok"), F.max(F.when(bad, F.col("ts"))).alias("failed"))
    return last.where(F.col("failed").isNotNull() & (F.col("ok").isNull() | (F.col("failed") > F.col("ok")))).select("user_id", "failed")


@query("a37_inventory", "SELECT r_name AS region, n_name AS nation, count(c_custkey) AS n, round(coalesce(sum(c_acctbal), 0), 2) AS balance FROM region JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2")
def a37(spark: SparkSession, d: str) -> DataFrame:
    """A row for each project (nation) with its counts."""
    n, r, c = (table(spark, d, x) for x in ("nation", "region", "customer"))
    per = c.groupBy("c_nationkey").agg(F.count("*").alias("n"), F.sum("c_acctbal").alias("balance"))
    every = n.join(r, n.n_regionkey == r.r_regionkey).join(per, n.n_nationkey == per.c_nationkey, "left")
    return every.select(F.col("r_name").alias("region"), F.col("n_name").alias("nation"), F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.round(F.coalesce("balance", F.lit(0.0)), 2).alias("balance"))


@query("p28_panel_frequencies", "SELECT i, round(list_sum(list_transform(d, lambda x: abs(x))) / (2 * len(d)), 6) AS freq FROM w", "ld")
def p28(spark: SparkSession, d: str) -> DataFrame:
    """Allele frequency of each variant: the sum of its dosages over twice the people."""
    total = F.aggregate(F.transform("d", lambda x: F.abs(x)), F.lit(0.0), lambda a, x: a + x)
    return dosages(spark, d).select("i", F.round(total / (F.size("d") * 2), 6).alias("freq"))


@query("p09b_artifact_rules", """, m AS (SELECT chr, pos, arg_min(beta, vid) AS bm, arg_min(z, vid) AS zm FROM v WHERE ds = 0 GROUP BY 1, 2), j AS (SELECT v.vid, v.beta AS bj, v.z AS zj, m.bm, m.zm FROM v JOIN m USING (chr, pos) WHERE v.ds > 0)
  SELECT vid, CASE WHEN abs(bj) > 5e0 * abs(bm) THEN 'inflated' WHEN bj * bm < 0 AND zm < 2.575829e0 THEN 'sign flip' WHEN zm < 3.290527e0 AND zj > 9.336297e0 THEN 'p jump' ELSE 'ok' END AS flag FROM j""", "v")  # fmt: skip
def p09b(spark: SparkSession, d: str) -> DataFrame:
    """Joint effects that blow up, turn round or become significant from nothing; the first dataset has the marginal ones, the others the joint."""
    v = variants(spark, d)
    marginal = v.where("ds = 0").groupBy("chr", "pos").agg(F.min_by("beta", "vid").alias("bm"), F.min_by("z", "vid").alias("zm"))
    j = v.where("ds > 0").select("chr", "pos", "vid", F.col("beta").alias("bj"), F.col("z").alias("zj")).join(marginal, ["chr", "pos"])
    bj, bm = F.col("bj"), F.col("bm")
    # p above 0.01; p above 0.001 and then below 1e-20
    flag = F.when(F.abs(bj) > F.lit(5.0) * F.abs(bm), "inflated").when((bj * bm < 0) & (F.col("zm") < 2.575829), "sign flip").when((F.col("zm") < 3.290527) & (F.col("zj") > 9.336297), "p jump")
    return j.select("vid", F.coalesce(flag, F.lit("ok")).alias("flag"))


@query("x03_displayed_p", "SELECT cid, CASE WHEN mlogp > 30 THEN '<1e-' || CAST(floor(mlogp) AS INT) ELSE '1e-' || CAST(floor(mlogp) AS INT) END AS p FROM c", "c")
def x03(spark: SparkSession, d: str) -> DataFrame:
    whole = F.floor("mlogp").cast("int").cast("string")
    return catalog(spark, d).select("cid", F.concat(F.when(F.col("mlogp") > 30, "<1e-").otherwise("1e-"), whole).alias("p"))


@query("w09_thinned", """, p AS (SELECT chr, pos, row_number() OVER (PARTITION BY chr ORDER BY pos) - 1 AS r, count(*) OVER (PARTITION BY chr) AS n FROM (SELECT DISTINCT chr, pos FROM v)) SELECT p.chr, p.pos FROM p WHERE n <= 20 OR EXISTS (SELECT 1 FROM range(20) t(k) WHERE r = (2 * t.k * (n - 1) + 19) // 38)""", "v")
def w09(spark: SparkSession, d: str) -> DataFrame:
    """Twenty positions of each chromosome, evenly by rank, first and last included (a sampling operator)."""
    p = stats.placed(variants(spark, d).select("chr", "pos").distinct(), ["chr"], F.floor(F.col("pos") / loci.BIN), ["pos"])
    p = p.select("chr", "pos", (F.col("place") - 1).alias("r"), F.col("total").alias("n"))
    wanted = F.transform(F.sequence(F.lit(0), F.lit(19)), lambda k: F.floor((F.lit(2) * k * (F.col("n") - 1) + 19) / 38))
    return p.where((F.col("n") <= 20) | F.array_contains(wanted, F.col("r"))).select("chr", "pos")


@query("s26_variant_export", f""", l AS (SELECT locus, ds, arg_min(vid, (-round(z, 9), pos, vid)) AS lead, arg_min(pos, (-round(z, 9), pos, vid)) AS lead_pos FROM (SELECT l.locus, v.* FROM v JOIN loci l ON v.chr = l.chr AND v.pos BETWEEN l."start" AND l."end") GROUP BY 1, 2)
  SELECT l.locus AS locus_index, 'Locus ' || l.locus AS locus_name, CAST(x.chr AS VARCHAR) AS locus_chr, x."start" AS locus_start, x."end" AS locus_end, CAST(v.chr AS VARCHAR) AS chr, v.pos, v.ea, v.nea, round(-log10({erfc_sql("(v.z / sqrt(2e0))")}), 6) + 0e0 AS neglog,
    round(v.beta, 6) + 0e0 AS beta, round(exp(v.beta), 6) AS "or", round(v.se, 6) AS se, v.maf, v.vid = l.lead AS is_lead, v.pos - l.lead_pos AS dist_lead FROM v JOIN loci x ON v.chr = x.chr AND v.pos BETWEEN x."start" AND x."end" JOIN l ON l.locus = x.locus AND l.ds = v.ds""", "v loci")  # fmt: skip
def s26(spark: SparkSession, d: str) -> DataFrame:
    """The exported table of the variants in loci, with the lead of their dataset there."""
    v = variants(spark, d)
    found = loci.seed_loci(v).select("locus", "chr", "start", "end")
    inside = ranges.points_in(v, found)
    order = F.struct((-F.round("z", 9)).alias("s"), F.col("pos"), F.col("vid"))
    lead = inside.groupBy("locus", "ds").agg(F.min_by(F.struct("vid", "pos"), order).alias("lead"))
    rows = inside.join(lead, ["locus", "ds"]).select(
        F.col("locus").alias("locus_index"), F.concat(F.lit("Locus "), F.col("locus").cast("string")).alias("locus_name"), F.col("chr").alias("locus_chr"), F.col("start").alias("locus_start"), F.col("end").alias("locus_end"),
        "chr", "pos", "ea", "nea", (F.round(S.neglog10(S.z_to_p(F.col("z"))), 6) + 0.0).alias("neglog"), (F.round("beta", 6) + 0.0).alias("beta"), F.round(F.exp("beta"), 6).alias("or"), F.round("se", 6).alias("se"), "maf",
        (F.col("vid") == F.col("lead.vid")).alias("is_lead"), (F.col("pos") - F.col("lead.pos")).alias("dist_lead"), "ds",
    )
    return exports.exported(rows, headers=False)
