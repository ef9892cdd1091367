"""Fixed queries over several studies: meta-analysis, differences between diseases, identifiers, splits of loci."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lociform.functions import scalar as S
from lociform.operators import identifiers, loci, metaanalysis, programs, ranges, stats
from lociform.plans.queries import VIEW, a19, erfc_sql, qnorm_sql, query
from lociform.sources.tables import catalog, genes, panel, variants

# ---- meta-analysis ----------------------------------------------------------------------------


def cohort_rows(spark: SparkSession, d: str) -> DataFrame:
    """One row of each dataset and position; every other dataset names the alleles the other way round."""
    # rows of one dataset and position may share their id
    row = F.min(F.struct("vid", "beta", "se", "ea", "nea")).alias("r")
    one = variants(spark, d).groupBy("chr", "pos", "ds").agg(row).select("chr", "pos", "ds", "r.*").drop("vid")
    turned = F.col("ds") % 2 == 1
    return one.select("chr", "pos", "ds", F.when(turned, F.col("nea")).otherwise(F.col("ea")).alias("ea"), F.when(turned, F.col("ea")).otherwise(F.col("nea")).alias("nea"), "beta", "se")


VIEW["co"] = f"""co0 AS (SELECT chr, pos, ds, arg_min(ea, (vid, beta, se)) AS a, arg_min(nea, (vid, beta, se)) AS b, arg_min(beta, (vid, beta, se)) AS beta, arg_min(se, (vid, beta, se)) AS se FROM v GROUP BY 1, 2, 3),
gc AS (SELECT ds, quantile_cont((beta / se) * (beta / se), 0.5) / {S.MEDIAN_CHI2}e0 AS spread FROM co0 GROUP BY ds),
co1 AS (SELECT chr, pos, ds, CASE WHEN ds % 2 = 1 THEN b ELSE a END AS ea, CASE WHEN ds % 2 = 1 THEN a ELSE b END AS nea, beta, se * sqrt(greatest(1e0, spread)) AS se FROM co0 JOIN gc USING (ds)),
co AS (SELECT c.chr, c.pos, c.ds, f.ea, f.nea, CASE WHEN c.ea = f.ea THEN c.beta ELSE -c.beta END AS b, 1e0 / (c.se * c.se) AS w FROM co1 c JOIN (SELECT chr, pos, arg_min(ea, ds) AS ea, arg_min(nea, ds) AS nea FROM co1 GROUP BY 1, 2) f USING (chr, pos))"""


@query("p12b_genomic_control", f"SELECT ds, count(*) AS n, round(quantile_cont((beta / se) * (beta / se), 0.5) / {S.MEDIAN_CHI2}e0, 6) AS inflation, round(avg(se) * sqrt(greatest(1e0, quantile_cont((beta / se) * (beta / se), 0.5) / {S.MEDIAN_CHI2}e0)), 6) AS mean_se FROM co0 GROUP BY ds", "v co")
def p12b(spark: SparkSession, d: str) -> DataFrame:
    """Inflation of each dataset and its mean standard error after control."""
    out = metaanalysis.genomic_control(cohort_rows(spark, d), "ds").groupBy("ds")
    return out.agg(F.count("*").alias("n"), F.round(F.max("inflation"), 6).alias("inflation"), F.round(F.avg("se"), 6).alias("mean_se"))


@query("p12c_controlled_meta_analysis", """, s AS (SELECT chr, pos, any_value(ea) AS ea, any_value(nea) AS nea, count(*) AS n, sum(w) AS w, sum(w * b) / sum(w) AS beta, greatest(0e0, sum(w * b * b) - sum(w * b) * sum(w * b) / sum(w)) AS q, sum(w) - sum(w * w) / sum(w) AS c,
    string_agg(CASE WHEN b > 0 THEN '+' WHEN b < 0 THEN '-' ELSE '0' END, '' ORDER BY ds) AS signs, list(ds) AS known FROM co GROUP BY 1, 2),
  t AS (SELECT *, CASE WHEN n > 1 AND c > 0 THEN greatest(0e0, q - (n - 1)) / c ELSE 0e0 END AS tau2 FROM s),
  r AS (SELECT chr, pos, sum(b / (1 / co.w + tau2)) / sum(1 / (1 / co.w + tau2)) AS beta_random, sqrt(1 / sum(1 / (1 / co.w + tau2))) AS se_random FROM co JOIN t USING (chr, pos) GROUP BY 1, 2),
  dir AS (SELECT chr, pos, string_agg(coalesce(x.sign, '?'), '' ORDER BY k.ds) AS direction FROM (SELECT DISTINCT chr, pos FROM co) p CROSS JOIN (SELECT unnest(range(6)) AS ds) k LEFT JOIN (SELECT chr, pos, ds, CASE WHEN b > 0 THEN '+' WHEN b < 0 THEN '-' ELSE '0' END AS sign FROM co) x USING (chr, pos, ds) GROUP BY 1, 2)
  SELECT chr, pos, ea, nea, n, round(beta, 6) + 0e0 AS beta, round(sqrt(1 / w), 6) AS se, round(q, 5) AS q, round(tau2, 5) AS tau2, round(beta_random, 6) + 0e0 AS beta_random, round(se_random, 6) AS se_random, direction
  FROM t JOIN r USING (chr, pos) JOIN dir USING (chr, pos)""", "v co")  # fmt: skip
def p12c(spark: SparkSession, d: str) -> DataFrame:
    """Fixed and random effects of all datasets after genomic control, turned to the first dataset's alleles."""
    rows = metaanalysis.genomic_control(cohort_rows(spark, d), "ds")
    out = metaanalysis.combined(rows, ["chr", "pos"], "ds", list(range(6)))
    # a zero has no sign
    r = lambda c, k=6: (F.round(c, k) + 0.0).alias(c)
    return out.select("chr", "pos", "ea", "nea", "n", r("beta"), r("se"), r("q", 5), r("tau2", 5), r("beta_random"), r("se_random"), "direction")


# ---- diseases, levels and the genome ----------------------------------------------------------


P_SQL = erfc_sql("(z / sqrt(2e0))")


@query("a12c_gene_anova", f""", o AS (SELECT g.gid, v.ds % 2 AS disease, v.ds, v.z, v.beta FROM v JOIN g ON v.chr = g.chr AND v.pos BETWEEN g."start" AND g."end"),
  x AS (SELECT gid, disease, ds, 'neglog10_p' AS scale, -log10({P_SQL}) AS v FROM o UNION ALL SELECT gid, disease, ds, 'effect', CASE WHEN ds % 3 = 0 THEN ln(exp(beta)) ELSE beta END FROM o),
  per AS (SELECT gid, scale, disease, ds, count(*) AS n, sum(v) AS s, sum(v * v) AS q FROM x GROUP BY 1, 2, 3, 4), whole AS (SELECT gid, scale, disease, sum(n) AS n, sum(s) AS s, sum(q) AS q FROM per GROUP BY 1, 2, 3),
  every AS (SELECT gid, scale, disease, n, s, q FROM per UNION ALL SELECT gid, scale, NULL, n, s, q FROM whole),
  tot AS (SELECT gid, scale, disease, count(*) AS k, sum(n) AS n, sum(s) AS s, sum(q) AS q, sum(s * s / n) AS b FROM every GROUP BY 1, 2, 3)
  SELECT gid, scale, disease, k AS n_groups, CAST(n AS BIGINT) AS n, round(((b - s * s / n) / (k - 1)) / ((q - b) / (n - k)), 4) AS f FROM tot WHERE k >= 2 AND n >= k + 10""", "v g")  # fmt: skip
def a12c(spark: SparkSession, d: str) -> DataFrame:
    """Differences between diseases, and within each between its datasets, at each gene: on p values and on effects.

    Every third dataset tells odds ratios.  Genes with fewer than ten degrees of freedom within are left out.
    """
    beta, odds = F.when(F.col("ds") % 3 != 0, F.col("beta")), F.when(F.col("ds") % 3 == 0, F.exp("beta"))
    v = variants(spark, d).select("chr", "pos", "ds", (F.col("ds") % 2).alias("disease"), S.neglog10(S.z_to_p(F.col("z"))).alias("logp"), S.effect_value(beta, odds).alias("effect"))
    value = [F.nanvl(F.col(c), F.lit(None)) for c in ("logp", "effect")]
    moments = {f"{name}{k}": c for k, x in enumerate(value) for name, c in (("_n", x.isNotNull().cast("double")), ("_s", x), ("_q", x * x))}
    held = ranges.folded(v.select("chr", "pos", "ds", *(c.alias(n) for n, c in moments.items())), genes(spark, d), ["gid"], list(moments), group="ds")
    sums = held.groupBy("gid", (F.col("ds") % 2).alias("disease"), "ds").agg(*(F.sum(c).cast("long" if c.startswith("_n") else "double").alias(c) for c in moments))
    out = stats.nested_anova_of_sums(sums, ["gid"], "disease", "ds", ["neglog10_p", "effect"])
    return out.where("n_groups >= 2 and n >= n_groups + 10").select("gid", "scale", "disease", "n_groups", "n", F.round("f", 4).alias("f"))


@query("a20b_cohesion", """, best AS (SELECT ds, chr, pos, max(z) AS z FROM v GROUP BY 1, 2, 3), t AS (SELECT ds, chr, pos, CASE WHEN z > 5.4513e0 THEN 3 WHEN z > 4.0556e0 THEN 2 WHEN z > 2.807e0 THEN 1 ELSE 0 END AS t FROM best),
  nn AS (SELECT ds, sum(t * t) AS n FROM t GROUP BY ds), ids AS (SELECT DISTINCT ds FROM v),
  p AS (SELECT a.ds AS a, b.ds AS b, round(1e0 - sum(a.t * b.t) / sqrt(CAST(max(na.n) AS DOUBLE) * CAST(max(nb.n) AS DOUBLE)), 6) AS distance FROM t a JOIN t b ON a.chr = b.chr AND a.pos = b.pos AND a.ds < b.ds JOIN nn na ON na.ds = a.ds JOIN nn nb ON nb.ds = b.ds GROUP BY 1, 2),
  every AS (SELECT x.ds AS a, y.ds AS b, coalesce(p.distance, 1e0) AS distance FROM ids x JOIN ids y ON x.ds < y.ds LEFT JOIN p ON p.a = x.ds AND p.b = y.ds)
  SELECT l.level, (SELECT count(*) FROM ids WHERE ds % 2 = l.level) AS n, round(1 - avg(distance) FILTER (a % 2 = l.level AND b % 2 = l.level), 6) AS cohesion, round(avg(distance) FILTER ((a % 2 = l.level) <> (b % 2 = l.level)), 6) AS separation
  FROM every, (SELECT DISTINCT ds % 2 AS level FROM ids) l GROUP BY l.level""", "v")  # fmt: skip
def a20b(spark: SparkSession, d: str) -> DataFrame:
    """How alike the datasets of a category are, and how far from those of others."""
    labels = variants(spark, d).select("ds").distinct().select(F.col("ds").alias("item"), (F.col("ds") % 2).alias("level"))
    out = stats.level_cohesion(a19(spark, d), labels)
    return out.select("level", "n", F.round("cohesion", 6).alias("cohesion"), F.round("separation", 6).alias("separation"))


SIZES = ", ".join(f"({k + 1}, {sum(list(loci.LENGTHS.values())[:k])})" for k in range(22))
STEP = -(-sum(loci.LENGTHS.values()) // 3000)


@query("a06b_genome_skyline", f", o(chr, before) AS (VALUES {SIZES}) SELECT least(2999, (before + pos) // {STEP}) AS bin, round(max(z), 6) AS top, count(*) AS n FROM v JOIN o USING (chr) GROUP BY 1 HAVING max(z) > 0", "v")
def a06b(spark: SparkSession, d: str) -> DataFrame:
    """The strongest value in each of 3000 bins of the genome of build 38."""
    return loci.skyline(variants(spark, d), "z").select("bin", F.round("top", 6).alias("top"), "n")


# ---- identifiers ------------------------------------------------------------------------------


def named(c: Column) -> Column:
    return F.concat(F.lit("rs"), c.cast("string"))


def known_ids(spark: SparkSession, d: str) -> DataFrame:
    """A list of known variants from the first dataset: several records at a position, some without a build."""
    v = variants(spark, d).where("ds = 0")
    alts = F.when(F.col("vid") % 4 == 1, F.array("nea", S.complement(F.col("nea")))).otherwise(F.array("nea"))
    return v.select("chr", "pos", F.col("ea").alias("ref"), alts.alias("alts"), named(F.col("vid")).alias("rsid"), F.when(F.col("vid") % 7 > 2, 150 + F.col("vid") % 3).alias("build"), F.col("vid").alias("line"))


def asked_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows of two datasets; a third of one's, few of the other's, have alleles that the list does not have."""
    v = variants(spark, d).where("ds in (3, 4)")
    turned, wrong = F.col("vid") % 3 == 1, (F.col("vid") % F.when(F.col("ds") == 3, 3).otherwise(30)) == 2
    ea, nea = F.when(turned, F.col("nea")).otherwise(F.col("ea")), F.when(turned, F.col("ea")).otherwise(F.col("nea"))
    return v.select("vid", "ds", "chr", "pos", F.when(wrong, F.lit("G")).otherwise(ea).alias("ea"), F.when(wrong, F.lit("C")).otherwise(nea).alias("nea")).distinct()


VIEW["idm"] = """kn AS (SELECT chr, pos, ea AS ref, CASE WHEN vid % 4 = 1 THEN [nea, translate(nea, 'ACGT', 'TGCA')] ELSE [nea] END AS alts, 'rs' || vid AS rsid, CASE WHEN vid % 7 > 2 THEN 150 + vid % 3 END AS build, vid AS line FROM v WHERE ds = 0),
ask AS (SELECT DISTINCT vid, ds, chr, pos, CASE WHEN wrong THEN 'G' WHEN turned THEN nea ELSE ea END AS ea, CASE WHEN wrong THEN 'C' WHEN turned THEN ea ELSE nea END AS nea FROM (SELECT *, vid % 3 = 1 AS turned, vid % (CASE WHEN ds = 3 THEN 3 ELSE 30 END) = 2 AS wrong FROM v WHERE ds IN (3, 4))),
idp AS (SELECT a.*, k.rsid, k.build, k.line, CASE WHEN k.rsid IS NULL THEN 3 WHEN a.nea = k.ref AND list_contains(k.alts, a.ea) THEN 0 WHEN a.ea = k.ref AND list_contains(k.alts, a.nea) THEN 1 ELSE 2 END AS kind, count(k.rsid) OVER (PARTITION BY a.vid, a.ds) AS n_candidates FROM ask a LEFT JOIN kn k ON k.chr = a.chr AND k.pos = a.pos),
ido AS (SELECT *, min(kind) OVER (PARTITION BY vid, ds) AS best, row_number() OVER (PARTITION BY vid, ds ORDER BY kind, build DESC NULLS LAST, CASE WHEN build IS NULL THEN -line ELSE line END) AS k,
  row_number() OVER (PARTITION BY vid, ds ORDER BY build DESC NULLS LAST, CASE WHEN build IS NULL THEN -line ELSE line END) AS any_k FROM idp),
idm AS (SELECT vid, ds, chr, pos, ea, nea, CASE WHEN best < 2 THEN max(rsid) FILTER (k = 1) END AS rsid, ['matched_forward', 'matched_reverse', 'pos_only_allele_mismatch', 'no_pos'][best + 1] AS reason, CASE WHEN best = 2 THEN max(rsid) FILTER (any_k = 1) END AS candidate, n_candidates
  FROM ido GROUP BY vid, ds, chr, pos, ea, nea, best, n_candidates)"""


@query("j18b_newest_identifiers", "SELECT vid, rsid, reason, candidate, n_candidates FROM idm", "v idm")
def j18b(spark: SparkSession, d: str) -> DataFrame:
    """Identifiers of two datasets by alleles: forward before reverse, the newest build first."""
    return identifiers.matched(asked_rows(spark, d), known_ids(spark, d)).select("vid", "rsid", "reason", "candidate", "n_candidates")


@query("p26b_recovered_identifiers", """, kf AS (SELECT *, concat_ws(':', chr, pos, least(ea, nea), greatest(ea, nea)) AS key FROM idm), lf AS (SELECT ds, count(*) AS n FROM kf WHERE rsid IS NULL GROUP BY ds),
  an AS (SELECT concat_ws(':', chr, pos, 'C', 'G') AS key, min('rs' || (vid % 100000)) AS reply FROM v WHERE ds = 5 AND vid % 2 = 0 GROUP BY 1),
  ot AS (SELECT key, min(ds) AS file, arg_min(id, (ds, id)) AS other FROM (SELECT concat_ws(':', chr, pos, least(ea, nea), greatest(ea, nea)) AS key, ds, 'rs' || (pos % 100000) AS id FROM v WHERE ds IN (1, 2)) GROUP BY 1),
  j AS (SELECT kf.*, (kf.rsid IS NULL AND lf.n < 2000) AS asked, reply, ot.file, other FROM kf LEFT JOIN lf USING (ds) LEFT JOIN an USING (key) LEFT JOIN ot USING (key)),
  s AS (SELECT vid, ds, asked, CASE WHEN rsid IS NOT NULL THEN rsid WHEN asked AND reply IS NOT NULL THEN reply ELSE other END AS rsid, CASE WHEN rsid IS NOT NULL THEN 'local' WHEN asked AND reply IS NOT NULL THEN 'service' WHEN other IS NOT NULL THEN 'other file' ELSE 'missing' END AS step, file FROM j)
  SELECT vid, ds, rsid, step, asked, CASE WHEN step = 'other file' THEN file END AS from_dataset FROM s""", "v idm")  # fmt: skip
def p26b(spark: SparkSession, d: str) -> DataFrame:
    """The chain for two datasets: the local list, stored replies of a service where few are unmatched, other files, then missing."""
    v = variants(spark, d)
    at = [F.col("chr").cast("string"), F.col("pos").cast("string"), F.lit("C"), F.lit("G")]
    answers = v.where("ds = 5 and vid % 2 = 0").select(F.concat_ws(":", *at).alias("key"), named(F.col("vid") % 100_000).alias("rsid"))
    others = v.where("ds in (1, 2)").select("ds", "chr", "pos", "ea", "nea", named(F.col("pos") % 100_000).alias("rsid"))
    return identifiers.recovered(asked_rows(spark, d), known_ids(spark, d), answers, others).select("vid", "ds", "rsid", "step", "asked", "from_dataset")


# ---- splits and panels ------------------------------------------------------------------------


def proposed(spark: SparkSession, d: str) -> DataFrame:
    """Three parts of two million positions around each locus: with gaps of 300 kb, or of 200 kb in every fourth."""
    gap = F.when(F.col("locus") % 4 == 3, 200_000).otherwise(300_000)
    middle = F.floor((F.col("start") + F.col("end")) / 2)
    l = loci.seed_loci(variants(spark, d)).select("locus", "chr", middle.alias("m"), gap.alias("g"))
    part = lambda k: F.struct((F.col("m") + k * (2_000_000 + F.col("g"))).alias("start"), (F.col("m") + k * (2_000_000 + F.col("g")) + 2_000_000).alias("end"))
    return l.select("locus", "chr", F.explode(F.array(*map(part, range(3)))).alias("p")).select("locus", "chr", "p.start", "p.end")


VIEW["pr"] = """pr AS (SELECT locus, chr, part, m + part * (2000000 + g) AS "start", m + part * (2000000 + g) + 2000000 AS "end" FROM (SELECT locus, chr, ("start" + "end") // 2 AS m, CASE WHEN locus % 4 = 3 THEN 200000 ELSE 300000 END AS g FROM loci), (VALUES (0), (1), (2)) q(part)),
tk AS (SELECT * FROM (SELECT pr.locus, pr.part, pn.pos, pn.dosages, row_number() OVER (PARTITION BY locus, part ORDER BY md5(pn.chr || ':' || pn.pos), pn.pos) AS k FROM pr JOIN pn ON pn.chr = pr.chr AND pn.pos BETWEEN pr."start" AND pr."end") WHERE k <= 10),
un AS (SELECT locus, part, pos, unnest(dosages) AS x, unnest(range(len(dosages))) AS person FROM tk),
lk AS (SELECT a.locus, a.part AS part_a, b.part AS part_b, a.pos AS pos_a, b.pos AS pos_b, round(corr(a.x, b.x) * corr(a.x, b.x), 9) AS r2 FROM un a JOIN un b ON a.locus = b.locus AND a.person = b.person AND a.part < b.part AND a.pos <> b.pos GROUP BY 1, 2, 3, 4, 5 HAVING stddev_pop(a.x) > 0 AND stddev_pop(b.x) > 0)"""


@query("p22b_linked_parts", "SELECT locus, CAST(part_a AS INT) AS part_a, CAST(part_b AS INT) AS part_b, pos_a, pos_b, round(r2, 6) AS r2 FROM lk WHERE r2 > 0.2e0", "v loci pn pr")
def p22b(spark: SparkSession, d: str) -> DataFrame:
    """Variants in different parts of a proposed split that are linked: ten drawn from each part."""
    out = programs.split_linkage(proposed(spark, d), panel(spark, d), "locus")
    return out.select("locus", "part_a", "part_b", "pos_a", "pos_b", F.round("r2", 6).alias("r2"))


@query("p22c_split_verdicts", """, w AS (SELECT *, lag("end") OVER (PARTITION BY locus ORDER BY "start", "end") AS before FROM pr), c AS (SELECT locus, count(*) AS parts, min("start" - before) AS least_gap, bool_or("start" < before) AS overlaps FROM w GROUP BY locus),
  n AS (SELECT locus, count(*) AS n_linked, round(max(r2), 6) AS top_r2 FROM lk WHERE r2 > 0.2e0 GROUP BY locus)
  SELECT locus, parts, least_gap, "overlaps", (least_gap >= 250000 AND n_linked IS NULL) AS valid, coalesce(n_linked, 0) AS n_linked, top_r2 FROM c LEFT JOIN n USING (locus)""", "v loci pn pr")  # fmt: skip
def p22c(spark: SparkSession, d: str) -> DataFrame:
    """Whether each proposed split is valid: gaps, overlaps and linkage across its parts."""
    return programs.split_verdicts(proposed(spark, d), panel(spark, d), "locus").withColumn("top_r2", F.round("top_r2", 6))


@query("p28b_allele_frequencies", "SELECT chr, pos, a1, round(freq, 6) AS freq, round(least(freq, 1 - freq), 6) AS maf FROM pn", "pn")
def p28b(spark: SparkSession, d: str) -> DataFrame:
    """Frequency of the first allele of each variant of the panel, and of the rarer one."""
    out = programs.allele_frequencies(panel(spark, d).drop("freq"))
    return out.select("chr", "pos", "a1", F.round("freq", 6).alias("freq"), F.round("maf", 6).alias("maf"))


# ---- labels and scales ------------------------------------------------------------------------


@query("f01_display_ids", """SELECT vid, CASE WHEN vid % 3 = 0 THEN 'rs' || (vid % 1000) WHEN vid % 5 < 2 THEN 'v' || pos ELSE chr || ':' || pos END AS shown, least(ea, nea) || '/' || greatest(ea, nea) AS alleles FROM v""", "v")
def f01(spark: SparkSession, d: str) -> DataFrame:
    """The name that each row is shown by: rs number, else the file's own id, else the place; blanks and dots are no names."""
    rsid = F.when(F.col("vid") % 3 == 0, named(F.col("vid") % 1000)).when(F.col("vid") % 3 == 1, ".").otherwise(" ")
    own = F.when(F.col("vid") % 5 < 2, F.concat(F.lit("v"), F.col("pos").cast("string"))).otherwise("")
    return variants(spark, d).select("vid", S.display_id(rsid, own, F.col("chr").cast("string"), F.col("pos").cast("string")).alias("shown"), F.concat_ws("/", F.least("ea", "nea"), F.greatest("ea", "nea")).alias("alleles"))


@query("f02_parsed_numbers", """SELECT vid % 6 AS kind, count(*) AS n, count(CASE WHEN vid % 6 IN (0, 5) THEN 1 END) AS n_known, round(sum(CASE WHEN vid % 6 IN (0, 5) THEN pos END), 2) + 0e0 AS total FROM v GROUP BY 1""", "v")
def f02(spark: SparkSession, d: str) -> DataFrame:
    """Numbers read from text: missing tokens and what does not parse are null."""
    kind, text = F.col("vid") % 6, F.col("pos").cast("string")
    cell = F.when(kind == 0, F.concat(F.lit(" "), text)).when(kind == 1, "NA").when(kind == 2, ".").when(kind == 3, "nan").when(kind == 4, F.concat(text, F.lit("x"))).otherwise(F.concat(text, F.lit("e0")))
    read = variants(spark, d).select(kind.alias("kind"), S.optional_double(cell).alias("x"))
    return read.groupBy("kind").agg(F.count("*").alias("n"), F.count("x").alias("n_known"), F.round(F.sum("x"), 2).alias("total"))


@query("f19_ancestry_codes", """, t AS (SELECT gid % 4 AS kind, biotype, upper(split_part(biotype, ' ', 1)) AS code FROM g) SELECT CASE WHEN kind = 3 THEN '' ELSE code END AS code, count(*) AS n FROM t GROUP BY 1""", "g")
def f19(spark: SparkSession, d: str) -> DataFrame:
    """Codes of ancestry labels, here of types in four spellings: what follows a blank, bracket, comma or semicolon is left out."""
    kind = F.col("gid") % 4
    label = F.when(kind == 0, F.lower("biotype")).when(kind == 1, F.regexp_replace("biotype", " ", ";")).when(kind == 2, F.concat(F.lit(" "), F.regexp_replace("biotype", " ", "("))).otherwise(F.concat(F.lit(","), F.col("biotype")))
    return genes(spark, d).select(S.ancestry_code(label).alias("code")).groupBy("code").agg(F.count("*").alias("n"))


@query("x02_chromosome_names", """, t AS (SELECT CASE vid % 4 WHEN 0 THEN 'chr' || chr WHEN 1 THEN ' ' || chr WHEN 2 THEN 'CHR' || chr ELSE 'cHrx' END AS c, chr, vid % 4 AS kind FROM v)
  SELECT c AS name, CASE kind WHEN 3 THEN 'CHRX' ELSE CAST(chr AS VARCHAR) END AS plain, CASE kind WHEN 3 THEN 'x' ELSE CAST(chr AS VARCHAR) END AS bare, CASE kind WHEN 2 THEN 'chrCHR' || chr WHEN 3 THEN 'chrcHrx' ELSE 'chr' || chr END AS prefixed, count(*) AS n FROM t GROUP BY 1, 2, 3, 4""", "v")  # fmt: skip
def x02(spark: SparkSession, d: str) -> DataFrame:
    """The three ways of naming a chromosome: upper case without three spellings of its prefix, without any spelling of it, and with it."""
    kind, text = F.col("vid") % 4, F.col("chr").cast("string")
    c = F.when(kind == 0, F.concat(F.lit("chr"), text)).when(kind == 1, F.concat(F.lit(" "), text)).when(kind == 2, F.concat(F.lit("CHR"), text)).otherwise("cHrx")
    names = variants(spark, d).select(c.alias("name")).groupBy("name").agg(F.count("*").alias("n"))
    return names.select("name", S.normal_chr(F.col("name")).alias("plain"), S.bare_chr(F.col("name")).alias("bare"), S.prefixed_chr(F.col("name")).alias("prefixed"), "n")


@query("x04_identifier_shares", """SELECT trait, count(*) AS n, round(avg(CASE WHEN cid % 3 < 2 THEN 1e0 ELSE 0e0 END), 6) AS share, avg(CASE WHEN cid % 3 < 2 THEN 1e0 ELSE 0e0 END) >= 0.5e0 AS by_rsid FROM c GROUP BY trait""", "c")
def x04(spark: SparkSession, d: str) -> DataFrame:
    """Share of each trait's ids that are rs numbers, in either case, and whether they are at least half."""
    shown = F.when(F.col("cid") % 3 == 0, F.col("rsid")).when(F.col("cid") % 3 == 1, F.upper("rsid")).otherwise(F.concat("rsid", F.lit("a")))
    share = F.avg(S.is_rsid(shown).cast("double"))
    return catalog(spark, d).groupBy("trait").agg(F.count("*").alias("n"), F.round(share, 6).alias("share"), (share >= 0.5).alias("by_rsid"))


@query("x09_file_names", """SELECT gid, regexp_replace(gene || ' (' || biotype || ')/' || brand, '[^A-Za-z0-9._-]', '_', 'g') AS name FROM g""", "g")
def x09(spark: SparkSession, d: str) -> DataFrame:
    """Names of genes' files: all but letters, digits, dots, dashes and underscores replaced."""
    return genes(spark, d).select("gid", S.file_safe(F.concat("gene", F.lit(" ("), "biotype", F.lit(")/"), "brand")).alias("name"))


@query("m08_liability_scale", f"""SELECT ds, round(avg(h2), 6) AS observed, round(avg(h2) * k * k * (1 - k) * (1 - k) / (h * h * 0.25e0), 6) AS liability FROM (SELECT ds, z * z / (z * z + 10000e0) AS h2, (ds + 1) / 100e0 AS k FROM v), LATERAL (SELECT exp(-0.5e0 * t * t) / sqrt(2e0 * pi()) AS h FROM (SELECT {qnorm_sql('k')} AS t)) GROUP BY ds, k, h""", "v")
def m08(spark: SparkSession, d: str) -> DataFrame:
    """Mean share of variance explained by each dataset's rows on the observed and the liability scale, half of the sample being cases."""
    chi2 = F.col("z") * F.col("z")
    h2 = variants(spark, d).groupBy("ds").agg(F.avg(chi2 / (chi2 + 10_000.0)).alias("h2"))
    return h2.select("ds", F.round("h2", 6).alias("observed"), F.round(S.liability_scale(F.col("h2"), (F.col("ds") + 1) / 100.0, F.lit(0.5)), 6).alias("liability"))
