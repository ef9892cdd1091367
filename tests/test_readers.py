"""Separators, versions of parents, files by chromosome, catalogue counts and count files."""

import gzip

import pytest

from lociform.sources import genotypes, readers

MAP = readers.Mapping({"chr": "CHR", "pos": "bp", "p": "P"}, {"beta": "beta", "rsid": "SNP"})
COLUMNS = [["SNP", "CHR", "BP", "P", "BETA", "N"], ["rs1", "chr1", "100", "1e-9", "0.5", "7"], ["rs2", "2", "bad", "0.1", "1", "8"], ["rs3", "X", "8", "0.5", "NA", "9"]]


@pytest.mark.parametrize("sep", ["\t", ",", ";", " ", "   "])
@pytest.mark.parametrize("packed", [False, True])
def test_association_rows_of_any_separator(spark, tmp_path, sep, packed):
    text = "\n".join(("  " if not sep.strip(" ") else "") + sep.join(x) for x in COLUMNS) + "\n"
    path = f"{tmp_path}/a.txt"
    if packed:
        with gzip.open(path + ".gz", "wt") as f:
            f.write(text)
    else:
        (tmp_path / "a.txt").write_text(text)
    # a plain name finds the compressed file
    got = sorted((r.chr, r.pos, r.p, r.beta, r.rsid, r.extra) for r in readers.read_association(spark, path, MAP).collect())
    assert got == [("1", 100, 1e-9, 0.5, "rs1", {"N": "7"}), ("X", 8, 0.5, None, "rs3", {"N": "9"})]


def test_white_space_tables(spark, tmp_path):
    (tmp_path / "a.txt").write_text("a  b\tc\r\n1 2\r\n\r\n 3\t4   5 6\r\n")
    assert [tuple(r) for r in readers.read_text_table(spark, str(tmp_path / "a.txt"), readers.SPACES).collect()] == [("1", "2", None), ("3", "4", "5")]
    assert readers.read_text_table(spark, str(tmp_path / "a.txt"), readers.SPACES, header=False).count() == 3
    (tmp_path / "none.txt").write_text("")
    assert readers.read_text_table(spark, str(tmp_path / "none.txt"), readers.SPACES).count() == 0


def test_parents_without_their_version(spark, tmp_path):
    row = lambda kind, start, end, rest: f"chr1\ts\t{kind}\t{start}\t{end}\t.\t+\t.\t{rest}"
    rows = [
        row("gene", 1, 900, "ID=g1;gene_name=ONE"), row("gene", 1, 900, "ID=g2.1;gene_name=TWO"), row("gene", 1, 900, "ID=g2;gene_name=OLD"), row("gene", 5, 6, "ID=g3;gene_name=BARE"),
        row("mRNA", 1, 9, "ID=t1;Parent=g1.12;transcript_type=protein_coding"), row("mRNA", 1, 9, "ID=t2;Parent=g2.1"), row("mRNA", 1, 9, "ID=t3;Parent=g9.1"), row("mRNA", 1, 9, "ID=t4;Parent=.1"),
        row("mRNA", 1, 9, "ID=t5;Parent=g1;transcript_type=protein_coding"), row("exon", 1, 9, "ID=e1;Parent=t1"), row("exon", 1, 90, "ID=e5;Parent=t5"), row("mRNA", 1, 9, "ID=t6"),
    ]
    (tmp_path / "a.gff").write_text("\n".join(rows) + "\n")
    got = readers.genes_with_transcripts(readers.read_annotation(spark, str(tmp_path / "a.gff"))).collect()
    assert sorted((r.id, r.transcript) for r in got) == [("g1", "t5"), ("g2", None), ("g2.1", "t2"), ("g3", None)]
    assert len(got) == 4


def test_a_panel_by_chromosome_first(spark, tmp_path):
    (tmp_path / "p.bim").write_text("1\trs1\t0\t100\ta\tg\n2\trs2\t0\t200\tC\tT\n2 rs3 0 200 C A\nX\trsx\t0\t5\tC\tT\n3\trs4\t0\n")
    (tmp_path / "p_chr1.bim").write_text("1 rs9 0 900 A C\n2 rs8 0 800 A C\n")
    read = lambda **k: sorted(tuple(r) for r in readers.read_panel_of(spark, f"{tmp_path}/p", ["1", "2", "chrX", "3"], **k).collect())
    assert read() == [("1", 900, "rs9", "A", "C"), ("2", 200, "rs2", "C", "T"), ("2", 200, "rs3", "C", "A"), ("X", 5, "rsx", "C", "T")]
    assert read(first=True)[1] == ("2", 200, "rs2", "C", "T") and read(last=True)[1] == ("2", 200, "rs3", "C", "A")
    assert readers.read_panel_of(spark, f"{tmp_path}/none", ["1"]).count() == 0


def test_catalogue_rows_and_counts(spark, tmp_path):
    lines = [
        "CHR_ID\tCHR_POS\tSNPS\tDISEASE/TRAIT\tPVALUE_MLOG", '1;2\t10;20\trs1; rs2\t"Asthma\t8.5', "X\t7\trs3 x rs1\tb\t1", "6 x 12\t70 x 80\trs4, rs5\tc\t2", "\t\trs6\td\t1", "4\tbad\t\te\t1", "5", "7\t-3\trs7\tf\tNA",
    ]
    for end in ("\n", "\r\n"):
        (tmp_path / "c.tsv").write_bytes((end.join(lines) + end).encode())
        got = sorted(tuple(r) for r in readers.read_catalog(spark, str(tmp_path / "c.tsv")).collect())
        assert got == [("1", 10, ["rs1", "rs2"], '"Asthma', 8.5), ("6", 70, ["rs4", "rs5"], "c", 2.0), ("X", 7, ["rs3", "rs1"], "b", 1.0)]
        assert readers.catalog_counts(spark, str(tmp_path / "c.tsv")).first().asDict() == {"n_rows": 7, "n_placed": 3, "n_unplaced": 4, "n_without_id": 2, "n_ids": 7}


def test_count_files_add_up(spark, tmp_path):
    for k, x in ((1, "100\n"), (2, "20.5 \n"), (3, "1\t2\n")):
        (tmp_path / f"{k}.l2.M_5_50").write_text(x)
    assert genotypes.read_score_total(spark, f"{tmp_path}/*.l2.M_5_50") == 123.5
    (tmp_path / "9.l2.M").write_text("many\n")
    with pytest.raises(ValueError, match="many"):
        genotypes.read_score_total(spark, f"{tmp_path}/9.l2.M")
    (tmp_path / "8.l2.M").write_text("\n")
    with pytest.raises(ValueError, match="no counts"):
        genotypes.read_score_total(spark, f"{tmp_path}/8.l2.M")


def test_paths_get_the_default_file_system(spark):
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    assert genotypes.qualified(spark, "/a/b c") == "/a/b c" and genotypes.qualified(spark, "s3://x/y") == "s3://x/y" and genotypes.qualified(spark, "file:/a") == "file:/a"
    before = conf.get("fs.defaultFS")
    try:
        conf.set("fs.defaultFS", "viewfs://store/")
        conf.set("fs.viewfs.mounttable.store.link./data", "file:///tmp")
        assert genotypes.qualified(spark, "/data/b") == "viewfs://store/data/b"
    finally:
        conf.unset("fs.viewfs.mounttable.store.link./data")
        conf.set("fs.defaultFS", before)
