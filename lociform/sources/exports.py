"""The columns of exported tables: an ordered registry of variant and locus columns, applied as one select."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Key, header, group and kind of the exported columns, in the order of the tables.
VARIANT = (
    ("locus_index", "Locus", "Locus", "int"), ("locus_name", "Locus Name", "Locus", "text"), ("locus_chr", "Locus Chr", "Locus", "text"), ("locus_start", "Locus Start", "Locus", "int"), ("locus_end", "Locus End", "Locus", "int"),
    ("chr", "Chr", "GWAS", "text"), ("pos", "Position", "GWAS", "int"), ("ea", "EA", "GWAS", "text"), ("nea", "NEA", "GWAS", "text"), ("pvalue", "P-value", "GWAS", "scientific"), ("neglog", "-log10(P)", "GWAS", "double"),
    ("beta", "Beta", "GWAS", "double"), ("or", "OR", "GWAS", "double"), ("se", "SE", "GWAS", "double"), ("n", "N", "GWAS", "int"), ("maf", "MAF", "GWAS", "double"), ("info", "Info", "GWAS", "double"),
    ("rsid", "rsID", "Identity", "text"), ("is_lead", "Is Lead", "Computed", "bool"), ("dist_lead", "Dist to Lead (bp)", "Computed", "int"), ("r2_lead", "r² with Lead", "LD", "double"), ("nearest_gene", "Nearest Gene", "Gene", "text"), ("gene_dist", "Gene Dist (bp)", "Gene", "int"),
)
LOCUS = (
    ("index", "Locus", "Core", "int"), ("name", "Name", "Core", "text"), ("chr", "Chr", "Core", "text"), ("start", "Start", "Core", "int"), ("end", "End", "Core", "int"), ("imd", "IMD (bp)", "Core", "text"), ("size", "Size (bp)", "Core", "int"),
    ("lead_snp", "Lead SNP", "Lead", "text"), ("lead_pos", "Lead Pos", "Lead", "int"), ("lead_ea", "Lead EA", "Lead", "text"), ("lead_nea", "Lead NEA", "Lead", "text"), ("lead_p", "Lead P", "Lead", "scientific"), ("lead_beta", "Lead Beta", "Lead", "double"),
    ("lead_or", "Lead OR", "Lead", "double"), ("lead_se", "Lead SE", "Lead", "double"), ("lead_n", "Lead N", "Lead", "int"), ("lead_maf", "Lead MAF", "Lead", "double"), ("lead_info", "Lead Info", "Lead", "double"),
    ("nearest_gene", "Nearest Gene", "Gene", "text"), ("gene_dist", "Gene Dist (bp)", "Gene", "int"), ("n_snps", "N SNPs", "Counts", "int"), ("n_p5e3", "N p<5e-3", "Counts", "int"), ("n_p5e5", "N p<5e-5", "Counts", "int"), ("n_p5e8", "N p<5e-8", "Counts", "int"),
    ("ld_done", "LD Computed", "LD", "bool"), ("ref_panel", "Ref Panel", "LD", "text"),
)
TYPES = {"int": "bigint", "text": "string", "double": "double", "scientific": "double", "bool": "boolean"}


def exported(df: DataFrame, registry: tuple = VARIANT, wanted: list[str] | None = None, headers: bool = True) -> DataFrame:
    """The registry's columns that df has, in the registry's order, cast to their kinds and named by their headers.

    wanted: keys to keep, in any order; a key that the registry lacks is an error.  What df lacks is not
    available and left out; what only df has is not exported.
    """
    known = [k for k, *_ in registry]
    if odd := sorted(set(wanted or ()) - set(known)):
        raise ValueError(f"no exported column is named {', '.join(odd)}")
    keep = [(k, h, t) for k, h, _, t in registry if k in df.columns and (wanted is None or k in wanted)]
    return df.select(*(F.col(f"`{k}`").try_cast(TYPES[t]).alias(h if headers else k) for k, h, t in keep))
