"""Readers of association-study files into canonical tables, and writers of results.

All columns are read as text and parsed here: rows without a numeric position or p value are left out,
missing numbers are null, columns that are asked for but absent are an error.  Nothing is inferred from
row order: where order matters, the reader adds it as a column.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lociform.functions.scalar import normal_chr, optional_double

REQUIRED = ("chr", "pos", "p", "ea", "nea")


@dataclass(frozen=True)
class Mapping:
    """File column of each canonical column; optional ones may be left out, but not be wrong."""

    required: dict[str, str]
    optional: dict[str, str] = field(default_factory=dict)


def _find(columns: list[str], name: str) -> str:
    for c in columns:
        if c.lower() == name.lower():
            return c
    raise ValueError(f"column {name} is not there; the file has {', '.join(columns)}")


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether anything is at a path or pattern, in the store that the path names."""
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(there))


def read_overrides(spark: SparkSession, path: str) -> DataFrame:
    """(locus, snp) of a file of two columns that names the top variant of loci; comments are left out, the last line of a locus counts, no file is no rows."""
    found = spark.read.text(path) if _exists(spark, path) else spark.createDataFrame([], "value string")
    part = F.split(F.trim("value"), "\t")
    rows = found.where(~F.col("value").startswith("#")).select(F.trim(part[0]).try_cast("int").alias("locus"), F.trim(F.get(part, F.lit(1))).alias("snp"), F.monotonically_increasing_id().alias("row"))
    return rows.where("locus is not null and snp is not null").groupBy("locus").agg(F.max_by("snp", "row").alias("snp"))


def located(spark: SparkSession, path: str) -> str:
    """The path, or the path with .gz where only that is there."""
    return path if _exists(spark, path) or not _exists(spark, f"{path}.gz") else f"{path}.gz"


def sniffed_separator(spark: SparkSession, path: str) -> str:
    """The separator that the first line has most often: tab, comma, semicolon, or any white space."""
    line = (spark.read.text(path).limit(1).collect() or [("",)])[0][0]
    best = max("\t,;", key=line.count)
    return best if line.count(best) else SPACES


#: The separator of columns apart by any white space.
SPACES = r"\s+"


def read_text_table(spark: SparkSession, path: str, sep: str = "\t", header: bool = True, quote: str = '"') -> DataFrame:
    """All columns as text.  Columns apart by white space have no quotes; short rows are filled with nulls, and what is beyond the header is left out."""
    if sep != SPACES:
        return spark.read.csv(path, sep=sep, header=header, quote=quote, escape=quote, mode="PERMISSIVE")
    lines = spark.read.text(path).select(F.trim(F.regexp_replace("value", r"[\s\u00a0]+$", "")).alias("value")).where("value <> ''")
    head = lines.limit(1).collect()
    first = head[0][0].split() if head else []
    names = first if header else [f"_c{k}" for k in range(len(first))]
    part = F.split("value", SPACES)
    # every file of a pattern has the header
    rows = lines.where(F.col("value") != head[0][0]) if header and head else lines
    return rows.select(*(F.get(part, F.lit(k)).alias(c) for k, c in enumerate(names)))


def read_association(spark: SparkSession, path: str, mapping: Mapping, sep: str | None = None) -> DataFrame:
    """Canonical association rows; file columns that no mapping names come along in the map extra.

    sep: None looks at the first line.  Compressed files are read as they are, and in place of a plain one that is not there.
    """
    path = located(spark, path)
    raw = read_text_table(spark, path, sniffed_separator(spark, path) if sep is None else sep)
    found = {k: F.col(f"`{_find(raw.columns, v)}`") for k, v in (mapping.required | mapping.optional).items()}
    if missing := [k for k in REQUIRED[:3] if k not in found]:
        raise ValueError(f"the mapping lacks {', '.join(missing)}")
    text = {"chr": normal_chr, "ea": F.upper, "nea": F.upper, "rsid": lambda c: c, "varid": lambda c: c}
    out = {k: text[k](c) if k in text else optional_double(c) for k, c in found.items()}
    out["pos"] = F.trim(found["pos"]).try_cast("long")
    used = {_find(raw.columns, v) for v in (mapping.required | mapping.optional).values()}
    extra = [F.lit(x) if k % 2 == 0 else F.col(f"`{x}`") for c in raw.columns if c not in used for k, x in enumerate((c, c))]
    rest = F.create_map(*extra) if extra else F.create_map().cast("map<string,string>")
    return raw.select(*(c.alias(k) for k, c in out.items()), rest.alias("extra")).where(F.col("pos").isNotNull() & F.col("p").isNotNull())


def read_loci(spark: SparkSession, path: str) -> DataFrame:
    """(chr, start, end) of a locus file; bad rows are left out."""
    raw = read_text_table(spark, path)
    name = lambda x: F.col(f"`{_find(raw.columns, x)}`")
    out = raw.select(normal_chr(name("meta_chr")).alias("chr"), name("meta_start").try_cast("long").alias("start"), name("meta_end").try_cast("long").alias("end"))
    return out.where("start is not null and end is not null")


def attribute(name: str, column: str = "attributes") -> Column:
    return F.element_at(F.str_to_map(column, F.lit(";"), F.lit("=")), name)


def read_annotation(spark: SparkSession, path: str) -> DataFrame:
    """(kind, chr, start, end, strand, id, parent, name, biotype) of an annotation file of nine columns."""
    names = ["chr", "source", "kind", "start", "end", "score", "strand", "phase", "attributes"]
    raw = spark.read.csv(path, sep="\t", comment="#").toDF(*names)
    kind = F.coalesce(attribute("gene_type"), attribute("transcript_type"), attribute("biotype"))
    return raw.select(
        "kind", normal_chr(F.col("chr")).alias("chr"), F.col("start").try_cast("long").alias("start"), F.col("end").try_cast("long").alias("end"), "strand",
        attribute("ID").alias("id"), attribute("Parent").alias("parent"), F.coalesce(attribute("gene_name"), attribute("Name")).alias("name"), kind.alias("biotype"),
    ).where("start is not null and end is not null")


def owned(children: DataFrame, parents: DataFrame) -> DataFrame:
    """children (parent, ...) with owner, the id of parents that parent names: as it is, or else without its version."""
    ids = parents.select(F.col("id").alias("_id")).distinct()
    bare = F.regexp_extract("parent", r"^(.+)\.[^.]*$", 1)
    own = children.withColumn("_bare", F.nullif(bare, F.lit("")))
    exact, other = ids.withColumnRenamed("_id", "_exact"), ids.withColumnRenamed("_id", "_other")
    met = own.join(exact, own.parent == exact._exact, "left").join(other, F.when(F.col("_exact").isNull(), F.col("_bare")) == other._other, "left")
    return met.withColumn("owner", F.coalesce("_exact", "_other")).where("owner is not null").drop("_bare", "_exact", "_other")


def genes_with_transcripts(features: DataFrame) -> DataFrame:
    """Genes with their canonical transcript: protein-coding first, then the largest sum of exon lengths, then id.

    A transcript whose parent is not there by its full id belongs to the gene of that id without its version.
    """
    genes = features.where("kind = 'gene'").select("id", "chr", "start", "end", "strand", "name", "biotype")
    transcripts = owned(features.where("kind in ('mRNA', 'transcript')").select(F.col("id").alias("tid"), "parent", (F.col("biotype") == "protein_coding").alias("coding")), genes).withColumnRenamed("owner", "gene_id")
    spans = features.where("kind = 'exon'").groupBy(F.col("parent").alias("tid")).agg(F.sum(F.col("end") - F.col("start")).alias("span"))
    best = transcripts.join(spans, "tid", "left").groupBy("gene_id").agg(F.min_by("tid", F.struct(~F.coalesce("coding", F.lit(False)), -F.coalesce("span", F.lit(0)), F.col("tid"))).alias("transcript"))
    return genes.join(best, genes.id == best.gene_id, "left").drop("gene_id")


def read_panel(spark: SparkSession, path: str | list[str], first: bool = False, last: bool = False) -> DataFrame:
    """(chr, pos, id, a1, a2) of a reference panel's variant list, split at tabs, or at any white space where tabs make fewer than four columns.

    first, last: only the first or last line of each place counts, by file name and then by place in the file.
    """
    part = F.when(F.size(F.split("value", "\t")) >= 4, F.transform(F.split("value", "\t"), lambda x: F.trim(x))).otherwise(F.split(F.trim("value"), SPACES))
    at = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line")]
    lines = spark.read.text(path).select(part.alias("p"), F.struct(*at).alias("at")).where(F.size("p") >= 4)
    cell = lambda k: F.get("p", F.lit(k))
    rows = lines.select(normal_chr(cell(0)).alias("chr"), cell(3).try_cast("long").alias("pos"), cell(1).alias("id"), F.upper(cell(4)).alias("a1"), F.upper(cell(5)).alias("a2"), "at").where("pos is not null")
    if first or last:
        one = (F.min_by if first else F.max_by)(F.struct("id", "a1", "a2"), "at")
        rows = rows.groupBy("chr", "pos").agg(one.alias("x")).select("chr", "pos", "x.*", F.lit(None).alias("at"))
    return rows.drop("at")


def read_panel_of(spark: SparkSession, prefix: str, chromosomes: list[str], first: bool = False, last: bool = False) -> DataFrame:
    """The panel's variants of some chromosomes: of a chromosome's own file (prefix_chr1.bim) where it is there, else of prefix.bim.

    Of either only the rows of the chromosome itself count; a panel without files has no rows.
    """
    own = {c: f"{prefix}_chr{c}.bim" for c in chromosomes if _exists(spark, f"{prefix}_chr{c}.bim")}
    others = [c for c in chromosomes if c not in own]
    name = lambda c: normal_chr(F.lit(c))
    parts = [read_panel(spark, path, first, last).where(F.col("chr") == name(c)) for c, path in own.items()]
    if others and _exists(spark, f"{prefix}.bim"):
        parts.append(read_panel(spark, f"{prefix}.bim", first, last).where(F.col("chr").isin(*map(name, others))))
    out = spark.createDataFrame([], "chr string, pos long, id string, a1 string, a2 string")
    for x in parts:
        out = out.unionByName(x)
    return out


# Headers of a column of gene symbols, the first that is there counts.
GENE_HEADERS = ("gene", "gene_symbol", "symbol", "gene_name")


def read_evidence(spark: SparkSession, path: str, gene_col: str | None = None) -> DataFrame:
    """An uploaded table by gene: its columns trimmed, those of numbers only as doubles, the gene's named gene.

    The first line that is not blank is the header: a tab in it means tabs, else commas.  The gene's
    column is gene_col or found by its name, either without regard to case; none is an error.  Blank lines
    and quotes are allowed, missing values are empty strings in text and null among numbers.
    """
    head = spark.read.text(path).where("trim(value) <> ''").limit(1).collect()
    if not head:
        raise ValueError("the file has no header")
    sep = "\t" if "\t" in head[0][0] else ","
    raw = spark.read.csv(path, sep=sep, header=True, quote='"', escape='"', mode="PERMISSIVE", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    raw = raw.toDF(*(c.strip() for c in raw.columns))
    by_name = {c.lower(): c for c in reversed(raw.columns)}
    gene = next((by_name[c] for c in ([gene_col.strip().lower()] if gene_col else GENE_HEADERS) if c in by_name), None)
    if gene is None:
        raise ValueError(f"no column of gene symbols among {', '.join(raw.columns)}")
    others = [c for c in raw.columns if c != gene]
    text = raw.select(*(F.coalesce(F.trim(F.col(f"`{c}`")), F.lit("")).alias(c) for c in raw.columns))
    text = text.where(F.length(F.concat(*(F.col(f"`{c}`") for c in raw.columns))) > 0)
    # one pass: does any value of a column say something other than a number
    words = text.agg(*(F.coalesce(F.max((F.col(f"`{c}`") != "") & F.col(f"`{c}`").try_cast("double").isNull()), F.lit(False)).alias(str(k)) for k, c in enumerate(others))).first() if others else ()
    rest = [F.col(f"`{c}`") if odd else F.col(f"`{c}`").try_cast("double").alias(c) for c, odd in zip(others, words)]
    return text.select(F.col(f"`{gene}`").alias("gene"), *rest)


def read_peaks(spark: SparkSession, path: str) -> DataFrame:
    """(chr, start, end, signal) of peak files of at least seven columns; compressed files as they are, no file as no rows."""
    part = F.split("value", "\t")
    found = spark.read.text(path) if _exists(spark, path) else spark.createDataFrame([], "value string")
    return found.where(F.size(part) >= 7).select(normal_chr(part[0]).alias("chr"), part[1].try_cast("long").alias("start"), part[2].try_cast("long").alias("end"), part[6].try_cast("double").alias("signal")).where("start is not null and end is not null")


def first_of(c: Column) -> Column:
    """The first of several values, which semicolons or an x between blanks keep apart; an X on its own is a chromosome."""
    return F.trim(F.get(F.split(c, r"\s*;\s*|\s+[xX]\s+"), F.lit(0)))


def _catalog(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    raw = read_text_table(spark, path, quote="")  # quotes are letters of names here
    return raw.select(*(F.regexp_replace(F.col(f"`{_find(raw.columns, c)}`"), r"\r$", "").alias(f"c{k}") for k, c in enumerate(names)))


def read_catalog(spark: SparkSession, path: str, chr_col: str = "CHR_ID", pos_col: str = "CHR_POS", id_col: str = "SNPS", trait_col: str = "DISEASE/TRAIT", mlogp_col: str = "PVALUE_MLOG") -> DataFrame:
    """(chr, pos, rsids, trait, mlogp): the first of several places counts, ids stay a list; rows without a place are left out.

    Lines end with or without a carriage return.  catalog_counts() tells how many rows were left out.
    """
    c = _catalog(spark, path, [chr_col, pos_col, id_col, trait_col, mlogp_col])
    ids = F.filter(F.split("c2", r"\s*[;,]\s*|\s+[xX]\s+"), lambda x: F.trim(x) != "")
    out = c.select(normal_chr(first_of(F.col("c0"))).alias("chr"), first_of(F.col("c1")).try_cast("long").alias("pos"), ids.alias("rsids"), F.col("c3").alias("trait"), optional_double(F.col("c4")).alias("mlogp"))
    return out.where("pos >= 0 and chr <> ''")


def catalog_counts(spark: SparkSession, path: str, chr_col: str = "CHR_ID", pos_col: str = "CHR_POS", id_col: str = "SNPS") -> DataFrame:
    """One row: n_rows, n_placed (rows that read_catalog() returns), n_unplaced, n_without_id and n_ids (different ids), in one scan."""
    c = _catalog(spark, path, [chr_col, pos_col, id_col])
    ids = F.filter(F.split(F.coalesce("c2", F.lit("")), r"\s*[;,]\s*|\s+[xX]\s+"), lambda x: F.trim(x) != "")
    placed = F.coalesce((first_of(F.col("c1")).try_cast("long") >= 0) & (normal_chr(first_of(F.col("c0"))) != ""), F.lit(False))
    # ids are counted once each, rows by the first of their ids
    first = F.col("id").isNull() | (F.col("k") == 0)
    each = c.select(placed.alias("placed"), F.posexplode_outer(ids).alias("k", "id"))
    return each.agg(
        F.count_if(first).alias("n_rows"), F.count_if(first & F.col("placed")).alias("n_placed"), F.count_if(first & ~F.col("placed")).alias("n_unplaced"),
        F.count_if(F.col("id").isNull()).alias("n_without_id"), F.count_distinct("id").alias("n_ids"),
    )


def has_rsids(df: DataFrame, column: str, rows: int = 1000) -> Column | bool:
    """Whether at least half of the first rows of a column look like rs numbers."""
    share = df.select(F.col(column)).limit(rows).agg(F.avg(F.coalesce(F.col(column).rlike(r"(?i)^rs\d+$"), F.lit(False)).cast("double"))).first()[0]
    return bool(share is not None and share >= 0.5)


def write_documents(df: DataFrame, path: str, key: str) -> None:
    """One JSON document for each row, in a folder for each key."""
    df.select(F.col(key), F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").partitionBy(key).text(path)


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, sep="\t", header=True)
