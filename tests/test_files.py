"""Readers and writers over small files."""

import json
import os

import pytest

from lociform.functions import scalar
from lociform.sources import exports, readers


def put(tmp_path, name, text):
    (tmp_path / name).write_text(text)
    return str(tmp_path / name)


MAP = readers.Mapping({"chr": "CHR", "pos": "bp", "p": "P"}, {"beta": "beta", "rsid": "SNP"})


def test_association_rows(spark, tmp_path):
    path = put(tmp_path, "a.tsv", "chr\tBP\tp\tBeta\tsnp\tnote\nchr1\t100\t1e-9\tNA\trs1\tx\nX\tbad\t0.1\t1\trs2\ty\n2\t7\t.\t1\trs3\tz\n3\t8\t0.5\t-0.25\t.\t\n")
    got = sorted((r.chr, r.pos, r.p, r.beta, r.rsid, r.extra.get("note")) for r in readers.read_association(spark, path, MAP).collect())
    assert got == [("1", 100, 1e-9, None, "rs1", "x"), ("3", 8, 0.5, -0.25, ".", None)]
    with pytest.raises(ValueError, match="nothere"):
        readers.read_association(spark, path, readers.Mapping(MAP.required, {"se": "nothere"}))
    assert readers.has_rsids(readers.read_text_table(spark, path), "snp")
    assert not readers.has_rsids(readers.read_text_table(spark, path), "note")


def test_loci_panel_and_peaks(spark, tmp_path):
    loci = put(tmp_path, "l.txt", "meta_chr\tmeta_start\tmeta_end\n1\t5\t9\nchr2\tx\t9\n")
    assert [tuple(r) for r in readers.read_loci(spark, loci).collect()] == [("1", 5, 9)]
    panel = put(tmp_path, "p.bim", "1\trs1\t0\t100\ta\tG\n2  rs2  0  200  C  T\n\n")
    assert sorted(tuple(r) for r in readers.read_panel(spark, panel).collect()) == [("1", 100, "rs1", "A", "G"), ("2", 200, "rs2", "C", "T")]
    peaks = put(tmp_path, "k.bed", "chr1\t10\t20\tn\t0\t.\t4.5\t1\t1\t5\nchr1\t10\t20\n")
    assert [tuple(r) for r in readers.read_peaks(spark, peaks).collect()] == [("1", 10, 20, 4.5)]


def test_annotation_hierarchy(spark, tmp_path):
    rows = [
        "##gff-version 3", "chr1\ts\tgene\t1\t900\t.\t+\t.\tID=g1;gene_name=ONE;gene_type=protein_coding", "chr1\ts\ttranscript\t1\t900\t.\t+\t.\tID=t1;Parent=g1;transcript_type=lncRNA",
        "chr1\ts\ttranscript\t1\t500\t.\t+\t.\tID=t2;Parent=g1;transcript_type=protein_coding", "chr1\ts\texon\t1\t900\t.\t+\t.\tID=e1;Parent=t1", "chr1\ts\texon\t1\t100\t.\t+\t.\tID=e2;Parent=t2",
    ]
    features = readers.read_annotation(spark, put(tmp_path, "a.gff", "\n".join(rows) + "\n"))
    got = readers.genes_with_transcripts(features).collect()
    assert [(r.id, r.name, r.start, r.end, r.transcript) for r in got] == [("g1", "ONE", 1, 900, "t2")]


def test_catalog(spark, tmp_path):
    path = put(tmp_path, "c.tsv", "CHR_ID\tCHR_POS\tSNPS\tDISEASE/TRAIT\tPVALUE_MLOG\n1;2\t10;20\trs1; rs2\tAsthma\t8.5\nX x Y\t\trs3\tb\t1\n")
    assert [tuple(r) for r in readers.read_catalog(spark, path).collect()] == [("1", 10, ["rs1", "rs2"], "Asthma", 8.5)]


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    readers.write_documents(df, f"{tmp_path}/docs", "k")
    found = [json.loads(x) for d, _, names in os.walk(f"{tmp_path}/docs") for n in names if n.startswith("part") for x in open(f"{d}/{n}")]
    assert sorted(found, key=lambda x: x["k"]) == [{"k": 1, "v": "a"}, {"k": 2}]
    readers.write_table(df, f"{tmp_path}/table")
    assert readers.read_text_table(spark, f"{tmp_path}/table").count() == 2


def test_fisher(spark):
    from pyspark.sql import functions as F

    long = lambda *x: [F.lit(v).cast("long") for v in x]
    r = spark.range(1).select(scalar.fisher_two_sided(*long(3, 1, 1, 3)).alias("a"), scalar.fisher_two_sided(*long(4, 0, 0, 4)).alias("b"), scalar.fisher_two_sided(*long(2, 2, 2, 2)).alias("c")).first()
    assert tuple(r) == (pytest.approx(17 / 35), pytest.approx(1 / 35), pytest.approx(1.0))


def test_overrides_missing_files_and_separators(spark, tmp_path):
    (tmp_path / "top.tsv").write_text("# a comment\n1\trs1\n\n2\trs2\n1\trs9\nodd\trs3\n4\n")
    assert {tuple(r) for r in readers.read_overrides(spark, f"file://{tmp_path}/top.tsv").collect()} == {(1, "rs9"), (2, "rs2")}
    assert readers.read_overrides(spark, f"file://{tmp_path}/none.tsv").count() == 0
    assert readers.read_peaks(spark, f"file://{tmp_path}/none.gz").count() == 0
    for text, sep in (("a\tb c\td", "\t"), ("a,b,c", ","), ("a;b", ";"), ("a b  c", r"\s+"), ("", r"\s+")):
        (tmp_path / "one.txt").write_text(text)
        assert readers.sniffed_separator(spark, f"file://{tmp_path}/one.txt") == sep


def test_first_line_of_a_place(spark, tmp_path):
    path = put(tmp_path, "p.bim", "1 rs1 0 100 a g\nchr1 rs2 0 100 c t\n\n2\trs3\t0\t100\tA\tG\n1 rs4 0 x A G\n")
    assert sorted(r.id for r in readers.read_panel(spark, path).collect()) == ["rs1", "rs2", "rs3"]
    assert sorted(tuple(r) for r in readers.read_panel(spark, path, first=True).collect()) == [("1", 100, "rs1", "A", "G"), ("2", 100, "rs3", "A", "G")]


def test_evidence(spark, tmp_path):
    path = put(tmp_path, "e.csv", '\nSymbol, score,note\nA1,1.5,"x, y"\n\n B2 ,,z\nC3,2e3,\n')
    df = readers.read_evidence(spark, path)
    assert df.columns == ["gene", "score", "note"] and dict(df.dtypes)["score"] == "double"
    assert sorted(tuple(r) for r in df.collect()) == [("A1", 1.5, "x, y"), ("B2", None, "z"), ("C3", 2000.0, "")]
    tabs = readers.read_evidence(spark, put(tmp_path, "e.tsv", "id,x\tGENE_NAME\n1,2\tQ\n"), gene_col="gene_name")
    assert [tuple(r) for r in tabs.collect()] == [("Q", "1,2")]
    for text, col in (("a,b\n1,2\n", None), ("gene,b\n1,2\n", "c"), ("\n \n", None)):
        with pytest.raises(ValueError):
            readers.read_evidence(spark, put(tmp_path, f"bad{len(text)}.csv", text), col)


def test_exported_columns(spark):
    df = spark.createDataFrame([("7", 1, "x", 0.5)], "pos string, chr int, odd string, beta double")
    assert exports.exported(df).columns == ["Chr", "Position", "Beta"]
    assert [tuple(r) for r in exports.exported(df, wanted=["beta", "pos"], headers=False).collect()] == [(7, 0.5)]
    assert exports.exported(df, exports.LOCUS).columns == ["Chr"]
    with pytest.raises(ValueError):
        exports.exported(df, wanted=["odd"])
