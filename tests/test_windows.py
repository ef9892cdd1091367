"""Matrix windows, indexed regions of block-compressed text, and reuse by manifests."""

import gzip
import os
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lociform.sources import indexed, manifests, matrices

# ---- matrices


def triangle(rng, n):
    r = np.round(np.corrcoef(rng.normal(size=(n, 50)) + rng.normal(size=50)), 4)
    i, j = np.nonzero(np.tril(r, -1))
    return r, i.astype(np.int32), j.astype(np.int32), r[i, j].astype(np.float32)


def stored(folder, name, rng, n, save, rows):
    r, i, j, data = triangle(rng, n)
    if rows:
        order = np.lexsort((j, i))
        indptr = np.searchsorted(i[order], np.arange(n + 1)).astype(np.int32)
        save(os.path.join(folder, f"{name}.npz"), indptr=indptr, indices=j[order], data=data[order], format=np.array("csr"), shape=np.array([n, n]))
    else:
        save(os.path.join(folder, f"{name}.npz"), row=i, col=j, data=data, format=np.array("coo"), shape=np.array([n, n]))
    return r


@pytest.mark.parametrize("save", [np.savez, np.savez_compressed])
@pytest.mark.parametrize("rows", [True, False])
def test_matrix_equals_a_whole_read(spark, tmp_path, monkeypatch, save, rows):
    monkeypatch.setattr(matrices, "PIECE", 500)
    r = stored(tmp_path, "chr1_1_3000001", np.random.default_rng(1), 90, save, rows)
    df = matrices.read_matrix(spark, str(tmp_path / "chr1_1_3000001.npz"), entries=1000)
    parts = df.rdd.getNumPartitions()
    assert parts == (5 if save is np.savez else 1)  # 4,005 entries
    got = np.zeros((90, 90))
    for x in df.collect():
        got[x.i, x.j] = x.r
    assert np.abs(got - np.tril(r, -1)).max() < 1e-6


def test_window_that_fits(spark, tmp_path):
    rng = np.random.default_rng(2)
    for name in ("chr1_1_3000001", "chr1_1000001_4000001", "chr2_1_3000001"):
        stored(tmp_path, name, rng, 5, np.savez, True)
    names = os.listdir(tmp_path)
    assert matrices.best_window(names, "1", 1_500_000, 2_500_000) == "chr1_1_3000001.npz"  # both are as near: the first
    assert matrices.best_window(names, "chr1", 2_200_000, 2_900_000) == "chr1_1000001_4000001.npz"
    assert matrices.best_window(names, "1", 2_500_000, 3_500_000) == "chr1_1000001_4000001.npz"
    assert matrices.best_window(names, "1", 1, 3_500_000) is None and matrices.best_window(names, "3", 1, 2) is None
    assert {x.window for x in matrices.read_matrix(spark, str(tmp_path), "1", 2_500_000, 3_500_000).collect()} == {"chr1_1000001_4000001"}
    assert {x.window for x in matrices.read_matrix(spark, str(tmp_path)).collect()} == {n.removesuffix(".npz") for n in names}
    assert matrices.read_matrix(spark, str(tmp_path), "3", 1, 2).count() == 0


def test_signs_turn_with_alleles(spark, tmp_path):
    r = stored(tmp_path, "chr1_1_3000001", np.random.default_rng(3), 6, np.savez_compressed, False)
    lines = ["rsid chromosome position allele1 allele2", "a 1 100 A C", "b 1 200 g t", "c 1 300 A C", "d 1 300 A G", "e 1 400 C T", "f 1 500 A C"]
    with gzip.open(tmp_path / "chr1_1_3000001.gz", "wt") as f:
        f.write("\n".join(lines) + "\n")
    listed = matrices.read_window_variants(spark, str(tmp_path))
    assert [tuple(x)[1:] for x in listed.orderBy("k").collect()][:2] == [(0, 100, "A", "C"), (1, 200, "G", "T")]
    wanted = spark.createDataFrame([(100, "A", "C"), (200, "A", "C"), (300, "g", "a"), (400, "A", "C"), (999, "A", "C")], "pos long, a1 string, a2 string")
    got = {(x.pos_a, x.pos_b): x.r for x in matrices.window_linkage(matrices.read_matrix(spark, str(tmp_path)), listed, wanted).collect()}
    # 200: the other strand turned; 300: the second variant there, turned; 400 has other alleles
    sign, place = {100: 1, 200: -1, 300: -1}, {100: 0, 200: 1, 300: 3}
    assert got == {(a, b): 1.0 if a == b else pytest.approx(float(np.float32(r[place[a], place[b]])) * sign[a] * sign[b]) for a in sign for b in sign}


# ---- indexed text


def packed(path, lines, block, chrom=0, start=1, comment="#", zero_based=False):
    """Block-compressed lines and their index; block: bytes of text to a block, so that lines run over."""
    text = "".join(x + "\n" for x in lines).encode()
    out, at = bytearray(), []
    for a in range(0, len(text), block):
        squeeze = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = squeeze.compress(text[a : a + block]) + squeeze.flush()
        at.append(len(out))
        out += b"\x1f\x8b\x08\x04" + bytes(6) + struct.pack("<HBBHH", 6, 66, 67, 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(text[a : a + block]), len(text[a : a + block]))
    out += bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
    path.write_bytes(bytes(out))
    at.append(len(out) - 28)
    virtual = lambda offset: (at[offset // block] << 16) | (offset % block)
    names, bins, linear, offset = [], {}, {}, 0
    for x in lines:
        begin, offset = offset, offset + len(x.encode()) + 1
        if x.startswith(comment):
            continue
        cells = x.split("\t")
        c, p = cells[chrom], int(cells[start]) - (not zero_based)
        if c not in names:
            names.append(c)
        own = bins.setdefault(c, {}).setdefault(4681 + (p >> 14), [])
        if own and own[-1][1] == virtual(begin):
            own[-1] = (own[-1][0], virtual(offset))
        else:
            own.append((virtual(begin), virtual(offset)))
        lows = linear.setdefault(c, [])
        while len(lows) <= p >> 14:
            lows.append(virtual(begin))
    label = b"".join(n.encode() + b"\0" for n in names)
    raw = indexed.INDEX_HEAD + struct.pack("<8i", len(names), 0x10000 if zero_based else 2, chrom + 1, start + 1, 0, ord(comment), 0, len(label)) + label
    for n in names:
        raw += struct.pack("<i", len(bins[n]) + 1)
        for b, chunks in bins[n].items():
            raw += struct.pack("<Ii", b, len(chunks)) + b"".join(struct.pack("<QQ", *c) for c in chunks)
        raw += struct.pack("<Ii", indexed.META_BIN, 1) + struct.pack("<QQ", 0, 0)
        raw += struct.pack("<i", len(linear[n])) + b"".join(struct.pack("<Q", v) for v in linear[n])
    path.with_name(path.name + ".tbi").write_bytes(gzip.compress(raw))


def calls(rng, n):
    rows = [(c, int(p)) for c in ("chr1", "chr2") for p in np.sort(rng.integers(1, 3_000_000, n))]
    return ["##a header", "#CHROM\tPOS\tID\tREF\tALT"] + [f"{c}\t{p}\trs{k}\tA\tC,G\t{'x' * int(rng.integers(0, 60))}" for k, (c, p) in enumerate(rows)]


REGIONS = [["1:500,000-600,000"], ["chr2:1-40000", "chr1:2900000-3000000"], ["1:100000-100000"], ["2:1-3000000"], ["1:1-2000000", "1:1500000-2500000"], ["3:1-100"]]


@pytest.mark.parametrize("block", [300, 4000])
@pytest.mark.parametrize("regions", REGIONS)
def test_regions_equal_a_filter_of_all(spark, tmp_path, block, regions):
    lines = calls(np.random.default_rng(4), 800)
    path = tmp_path / "calls.vcf.gz"
    packed(path, lines, block)
    want = []
    for x in lines[2:]:
        c, p, *_ = x.split("\t")
        if any(c[3:] == r.split(":")[0].removeprefix("chr") and int(r.split(":")[1].split("-")[0].replace(",", "")) <= int(p) <= int(r.split("-")[1].replace(",", "")) for r in regions):
            want.append(x)
    for size in (16 << 20, 2000):  # whole chunks, and chunks cut into tasks
        got = [r.value for r in indexed.read_region(spark, str(path), regions, bytes_to_task=size).collect()]
        assert sorted(got) == sorted(want)


def test_only_named_blocks_are_opened(tmp_path, monkeypatch):
    path = tmp_path / "calls.vcf.gz"
    packed(path, calls(np.random.default_rng(5), 2000), 1000)
    opened = []
    original = indexed.blocks

    def watched(f, first, last):
        for at, text in original(f, first, last):
            opened.append(at)
            yield at, text

    monkeypatch.setattr(indexed, "blocks", watched)
    reader = indexed.IndexedReader({"path": str(path), "regions": "1:1000000-1020000"})
    rows = [r for p in reader.partitions() for r in reader.read(p)]
    assert rows and len(set(opened)) <= 6 < path.stat().st_size / 1000


def test_variants_and_scores_of_a_region(spark, tmp_path):
    path = tmp_path / "calls.vcf.gz"
    packed(path, calls(np.random.default_rng(6), 300), 700)
    got = indexed.read_variant_region(spark, str(path), ["1:1-1000000"])
    assert got.columns == ["chr", "pos", "rsid", "ref", "alts"] and {r.chr for r in got.collect()} == {"1"} and got.where(F.size("alts") == 2).count() == got.count() > 0
    scores = tmp_path / "scores.tsv.gz"
    packed(scores, ["## version", "#Chrom\tPos\tRef\tAlt\tRawScore\tPHRED"] + [f"7\t{p}\tA\tG\t{p / 1e6}\t{p % 30}" for p in range(1000, 900_000, 1000)], 500)
    got = indexed.read_deleteriousness_region(spark, str(scores), ["7:10000-12000"]).orderBy("pos").collect()
    assert [(r.chr, r.pos, r.phred) for r in got] == [("7", 10_000, 10.0), ("7", 11_000, 20.0), ("7", 12_000, 0.0)]


def test_wrong_files_are_named(tmp_path):
    with pytest.raises(ValueError, match="index"):
        indexed.parsed_index(b"nothing")
    (tmp_path / "plain.gz").write_bytes(gzip.compress(b"1\t5\n"))


# ---- manifests


def test_second_run_reads_and_changed_input_recomputes(spark, tmp_path):
    source, folder = tmp_path / "in", f"file://{tmp_path / 'out'}"
    spark.range(10).write.parquet(str(source))
    runs = []

    def build(factor=2):
        runs.append(factor)
        return spark.read.parquet(str(source)).select((F.col("id") * factor).alias("x"))

    first = manifests.reused(spark, folder, "doubled", build, inputs=[str(source)], version="1")
    again = manifests.reused(spark, folder, "doubled", build, inputs=[str(source)], version="1")
    assert sorted(r.x for r in first.collect()) == sorted(r.x for r in again.collect()) == list(range(0, 20, 2)) and runs == [2]
    other = manifests.reused(spark, folder, "doubled", lambda: build(3), inputs=[str(source)], parameters={"factor": 3}, version="1")
    assert max(r.x for r in other.collect()) == 27 and runs == [2, 3]
    manifests.reused(spark, folder, "doubled", build, inputs=[str(source)], version="2")
    assert runs == [2, 3, 2]
    spark.range(5).write.mode("append").parquet(str(source))
    grown = manifests.reused(spark, folder, "doubled", build, inputs=[str(source)], version="2")
    assert grown.count() == 15 and runs == [2, 3, 2, 2]
    # the table as it was is still there for those who had read it
    assert first.count() == 10


def test_unfinished_tables_are_not_reused(spark, tmp_path):
    folder = f"file://{tmp_path}"

    def fails():
        return spark.range(3).select(F.raise_error(F.lit("stopped")).alias("x"))

    with pytest.raises(Exception, match="stopped"):
        manifests.reused(spark, folder, "t", fails, inputs=[], version="1")
    assert manifests.reused(spark, folder, "t", lambda: spark.range(3), inputs=[], version="1").count() == 3


def test_missing_input_is_named(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="nowhere"):
        manifests.reused(spark, f"file://{tmp_path}", "t", lambda: spark.range(1), inputs=[str(tmp_path / "nowhere")], version="1")
    assert manifests.history(spark, f"file://{tmp_path}", "t") == []


def test_aggregates_of_pairs_without_pairs(spark):
    """folded() and covered() against loops over all pairs, groups and several bins included, and 300 million pairs in seconds."""
    import pandas as pd

    from lociform.operators import ranges

    rng = np.random.default_rng(0)
    p = pd.DataFrame({"chr": rng.integers(1, 3, 400), "pos": rng.integers(0, 5000, 400), "g": rng.choice(["a", "b"], 400), "x": rng.normal(size=400), "y": rng.normal(size=400)})
    i = pd.DataFrame({"id": range(90), "chr": rng.integers(1, 4, 90), "start": rng.integers(-50, 5000, 90), "g": rng.choice([1, 2], 90), "x": rng.normal(size=90), "y": rng.normal(size=90)})
    i["end"] = i["start"] + rng.choice([-1, 0, 3, 40, 700, 4000], 90)
    points, intervals = spark.createDataFrame(p), spark.createDataFrame(i)
    got = ranges.folded(points, intervals, ["id"], ["x"], ["y"], "g", width=128).groupBy("id", "g").agg(F.sum("n").alias("n"), F.sum("x").alias("x"), F.max("y").alias("y")).collect()
    inside = i[["id", "chr", "start", "end"]].merge(p, on="chr").query("start <= pos <= end").groupby(["id", "g"]).agg(n=("x", "size"), x=("x", "sum"), y=("y", "max"))
    assert {(r.id, r.g): (r.n, round(r.x, 9) + 0.0, r.y) for r in got} == {k: (r.n, round(r.x, 9) + 0.0, r.y) for k, r in inside.iterrows()}
    got = ranges.covered(points.withColumn("k", F.monotonically_increasing_id()), intervals, ["k", "pos"], ["x"], ["y"], "g", width=128).collect()
    q = p[["chr", "pos"]].assign(k=points.select(F.monotonically_increasing_id()).toPandas().iloc[:, 0])
    over = q.merge(i, on="chr").query("start <= pos <= end").groupby(["k", "g"]).agg(n=("x", "size"), x=("x", "sum"), y=("y", "max"))
    assert {(r.k, r.g): (r.n, round(r.x, 9) + 0.0, r.y) for r in got} == {k: (r.n, round(r.x, 9) + 0.0, r.y) for k, r in over.iterrows()}
    many = spark.range(20_000).select(F.lit(1).alias("chr"), F.col("id").alias("pos"))
    wide = spark.range(20_000).select(F.lit(1).alias("chr"), "id", F.col("id").alias("start"), (F.col("id") + 20_000).alias("end"))
    assert ranges.folded(many, wide, ["id"]).agg(F.sum("n")).first()[0] == 20_000 * 20_001 // 2
