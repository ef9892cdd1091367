"""Loci: merging of significant positions, lead variants, summaries by dataset and locus."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lociform.functions.scalar import normal_chr
from lociform.operators.ranges import points_in

GENOME_WIDE = 5.4513
SUGGESTIVE = 4.0556


#: Width of the bins of a chromosome in which intervals are merged before they are across bins.
BIN = 1_000_000


def islands(rows: DataFrame, gap: int, start: str = "start", end: str = "end") -> DataFrame:
    """rows with island: intervals of a chromosome no more than gap beyond the furthest end before share one.

    Rows are merged within bins of their starts; only the merged spans of the bins meet by chromosome.
    """

    def grouped(df: DataFrame, keys: list[str], a: str, b: str, name: str) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy(a, b)
        reach = F.max(b).over(w.rowsBetween(Window.unboundedPreceding, -1))
        fresh = F.when(reach.isNull() | (F.col(a) > reach + gap), 1).otherwise(0)
        return df.withColumn("_new", fresh).withColumn(name, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("_new")

    own = grouped(rows.withColumn("_bin", F.floor(F.col(start) / BIN)), ["chr", "_bin"], start, end, "_own")
    spans = own.groupBy("chr", "_bin", "_own").agg(F.min(start).alias("_a"), F.max(end).alias("_b"))
    met = grouped(spans, ["chr"], "_a", "_b", "island").select("chr", "_bin", "_own", "island")
    return own.join(met, ["chr", "_bin", "_own"]).drop("_bin", "_own").select(*rows.columns, "island")


def best_by_position(variants: DataFrame) -> DataFrame:
    """The strongest row of each position over all datasets."""
    return variants.groupBy("chr", "pos").agg(F.max("z").alias("z"))


def seed_loci(variants: DataFrame, gap: int = 250_000, least_z: float = GENOME_WIDE, least_members: int = 1) -> DataFrame:
    """Loci (locus, chr, start, end, n_seeds, top_z) around positions significant in any dataset."""
    seeds = best_by_position(variants.where(F.col("z") > least_z)).select("chr", F.col("pos").alias("start"), F.col("pos").alias("end"), "z")
    merged = islands(seeds, gap).groupBy("chr", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n_seeds"), F.max("z").alias("top_z"))
    number = F.row_number().over(Window.orderBy("chr", "start")).cast("long")  # loci are few: as many as islands of the genome
    return merged.where(F.col("n_seeds") >= least_members).select(number.alias("locus"), "chr", "start", "end", "n_seeds", "top_z")


#: Lengths of the chromosomes of build 38 in genome order.
LENGTHS = {
    "1": 248956422, "2": 242193529, "3": 198295559, "4": 190214555, "5": 181538259, "6": 170805979, "7": 159345973, "8": 145138636, "9": 138394717, "10": 133797422,
    "11": 135086622, "12": 133275309, "13": 114364328, "14": 107043718, "15": 101991189, "16": 90338345, "17": 83257441, "18": 80373285, "19": 58617616, "20": 64444167,
    "21": 46709983, "22": 50818468, "X": 156040895,
}


def skyline(rows: DataFrame, value: str, lengths: dict[str, int] = LENGTHS, bins: int = 3000) -> DataFrame:
    """(bin, top, n): the largest value in each bin of a genome laid end to end, from chr, pos and value; bins whose largest is positive.

    A bin is as wide as the genome over bins, rounded up; chromosomes that lengths does not name are left out.
    """
    starts, total = {}, 0
    for name, length in lengths.items():
        starts[name], total = total, total + length
    offset = F.element_at(F.create_map(*(F.lit(x) for k, v in starts.items() for x in (k, v))), normal_chr(F.col("chr").cast("string")))
    place = F.floor((offset + F.col("pos")) / -(-total // bins))
    # least() would pass over the null place of an unknown chromosome
    known = rows.withColumn("_bin", F.when(place >= bins, bins - 1).otherwise(place).cast("long")).where(F.col("_bin").isNotNull() & F.col(value).isNotNull() & ~F.isnan(value))
    return known.groupBy(F.col("_bin").alias("bin")).agg(F.max(value).alias("top"), F.count("*").alias("n")).where("top > 0")


def lead_by_locus(variants: DataFrame, loci: DataFrame) -> DataFrame:
    """The strongest variant row of each locus and the number of rows in it."""
    order = F.struct((-F.round("z", 9)).alias("s"), F.col("pos"), F.col("vid"))
    inside = points_in(variants, loci.select("locus", "chr", "start", "end"))
    return inside.groupBy("locus").agg(F.min_by(F.struct("vid", "pos"), order).alias("lead"), F.count("*").alias("n_rows")).select("locus", F.col("lead.vid").alias("lead"), F.col("lead.pos").alias("lead_pos"), "n_rows")


def dataset_by_locus(variants: DataFrame, loci: DataFrame) -> DataFrame:
    """Per locus and dataset: lead row, its beta, counts below 5e-5 and 5e-8."""
    order = F.struct((-F.round("z", 9)).alias("s"), F.col("pos"), F.col("vid"))
    inside = points_in(variants, loci.select("locus", "chr", "start", "end"))
    return inside.groupBy("locus", "ds").agg(
        F.min_by("vid", order).alias("lead"), F.round(F.min_by("beta", order), 9).alias("beta"), F.round(F.max("z"), 9).alias("z"),
        F.count_if(F.col("z") > SUGGESTIVE).alias("n_suggestive"), F.count_if(F.col("z") > GENOME_WIDE).alias("n_significant"), F.count("*").alias("n_rows"),
    )


def best_dataset(by_dataset: DataFrame) -> DataFrame:
    """The dataset with the strongest lead in each locus; ties by number."""
    return by_dataset.groupBy("locus").agg(F.min_by(F.struct("ds", "z"), F.struct((-F.col("z")).alias("s"), F.col("ds"))).alias("b"), F.count("*").alias("n_datasets")).select("locus", F.col("b.ds").alias("ds"), F.col("b.z").alias("z"), "n_datasets")


def shared_pairs(members: DataFrame, item: str, group: str, k: int, least: int = 2) -> DataFrame:
    """The k pairs of items that share most groups (a top-k report): (a, b, n), ties by a, then b.

    Items of equal sets of groups form classes, of which only the first k + 1 items can be in the report.  A
    class of c items makes c (c - 1) / 2 pairs that share all their groups; so many pairs of the largest sets
    bound the k-th best count from below, and smaller sets are left out.  Two sets that share as many groups as
    that have one in common among the rarest of each, so that only those are where classes meet.
    """
    sets = members.select(F.col(item).alias("item"), F.col(group).alias("g")).groupBy("item").agg(F.array_sort(F.collect_set("g")).alias("mask"))
    classes = sets.groupBy("mask").agg(F.count("*").alias("c")).withColumn("size", F.size("mask"))
    level, seen = least, 0.0
    within = classes.where("c > 1").groupBy("size").agg(F.sum(F.col("c").cast("double") * (F.col("c") - 1) / 2).alias("pairs"))
    for r in within.orderBy(F.desc("size")).collect():  # as many rows as groups
        seen += r.pairs
        if seen >= k:
            level = max(least, r["size"])
            break
    able = classes.where(F.col("size") >= level)
    often = able.select(F.explode("mask").alias("g"), "c").groupBy("g").agg(F.sum("c").alias("often"))
    rarest = able.select("mask", "c", "size", F.explode("mask").alias("g")).join(often, "g").groupBy("mask", "c", "size").agg(F.array_sort(F.collect_list(F.struct("often", "g"))).alias("l"))
    prefix = rarest.select("mask", "c", F.explode(F.slice("l", 1, F.col("size") - level + 1)).alias("x")).select("mask", "c", F.col("x.g").alias("g"))
    x, y = prefix.select("g", F.col("mask").alias("ma"), F.col("c").alias("ca")), prefix.select("g", F.col("mask").alias("mb"), F.col("c").alias("cb"))
    both = x.join(y, "g").where(F.col("ma") <= F.col("mb")).select("ma", "mb", "ca", "cb").distinct().withColumn("n", F.size(F.array_intersect("ma", "mb"))).where(F.col("n") >= level)
    made = F.when(F.col("ma") == F.col("mb"), F.col("ca") * (F.col("ca") - 1) / 2).otherwise(F.col("ca").cast("double") * F.col("cb"))
    seen = 0.0
    for r in both.groupBy("n").agg(F.sum(made).alias("pairs")).orderBy(F.desc("n")).collect():  # as many rows as groups
        level, seen = r.n, seen + r.pairs
        if seen >= k:
            break
    first = sets.withColumn("r", F.row_number().over(Window.partitionBy("mask").orderBy("item"))).where(F.col("r") <= k + 1).drop("r")
    wanted = both.where(F.col("n") >= level).select("ma", "mb", "n")
    pairs = first.withColumnsRenamed({"item": "x", "mask": "ma"}).join(wanted, "ma").join(first.withColumnsRenamed({"item": "y", "mask": "mb"}), "mb")
    pairs = pairs.where((F.col("ma") != F.col("mb")) | (F.col("x") < F.col("y")))
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.col("n").cast("long").alias("n")).orderBy(F.desc("n"), "a", "b").limit(k)


def distance_pruned(positions: DataFrame, gap: int) -> DataFrame:
    """Positions of each chromosome kept in order, each at least gap after the last one kept.

    The choice runs along a chromosome, but a bin of it hands on only its last kept position, which depends on
    where the first one stands: at most gap after the bin's start, or the first position at all.  So every bin
    tells its last kept position for each place where the choice may enter it (those of one end are one row);
    these few rows are followed along the chromosome, and then every bin makes its choice on its own.
    """
    width = max(BIN, 4 * gap)
    kind = positions.schema["chr"].dataType.simpleString()
    rows = positions.select("chr", F.col("pos").cast("long").alias("pos")).distinct().withColumn("bin", F.floor(F.col("pos") / width).cast("long"))

    def ends(pdf: pd.DataFrame) -> pd.DataFrame:
        pos, start = np.sort(pdf["pos"].to_numpy(np.int64)), int(pdf["bin"].iloc[0]) * width
        follow = np.searchsorted(pos, pos + gap, "left")
        last = pos.copy()
        for k in range(len(pos) - 1, -1, -1):
            if follow[k] < len(pos):
                last[k] = last[follow[k]]
        # enter at the first position from `least` on; after the gap the first one is always taken
        entries = int(np.searchsorted(pos, start + gap, "left")) + 1
        first = [k for k in range(min(entries, len(pos))) if k == min(entries, len(pos)) - 1 or last[k] != last[k + 1]]
        return pd.DataFrame({"chr": pdf["chr"].iloc[0], "bin": pdf["bin"].iloc[0], "upto": pos[first], "last": last[first]})

    def along(pdf: pd.DataFrame) -> pd.DataFrame:
        before, out = None, []
        for number, own in pdf.sort_values(["bin", "upto"]).groupby("bin", sort=True):
            out.append((number, before))
            least = -1 if before is None else before + gap
            at = int(np.searchsorted(own["upto"].to_numpy(), least, "left"))
            if at < len(own):
                before = int(own["last"].iloc[at])
        frame = pd.DataFrame(out, columns=["bin", "before"])
        frame["before"] = frame["before"].astype("Int64")
        return frame.assign(chr=pdf["chr"].iloc[0])[["chr", "bin", "before"]]

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        kept, last = [], pdf["before"].iloc[0]
        last = None if pd.isna(last) else int(last)
        for x in np.sort(pdf["pos"].to_numpy(np.int64)).tolist():
            if last is None or x >= last + gap:
                kept.append(x)
                last = x
        return pd.DataFrame({"chr": pdf["chr"].iloc[0], "pos": np.array(kept, np.int64)})

    told = rows.groupBy("chr", "bin").applyInPandas(ends, f"chr {kind}, bin long, upto long, last long")
    entered = told.groupBy("chr").applyInPandas(along, f"chr {kind}, bin long, before long")
    return rows.join(entered, ["chr", "bin"]).groupBy("chr", "bin").applyInPandas(choose, f"chr {kind}, pos long")


def clumped(best: DataFrame, reach: int) -> DataFrame:
    """(chr, pos, lead): strongest first, each lead claims the unclaimed positions within reach of it.

    Positions further apart than reach never meet, so islands of positions are the groups.
    """
    rows = islands(best.select("chr", F.col("pos").alias("start"), F.col("pos").alias("end"), F.round("z", 9).alias("z")), reach)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("start").reset_index(drop=True)
        pos = pdf["start"].to_numpy()
        lead = np.full(len(pos), -1, np.int64)
        # what a lead may claim is a slice of the positions in order
        first, end = np.searchsorted(pos, pos - reach, "left"), np.searchsorted(pos, pos + reach, "right")
        for k in np.lexsort((pos, -pdf["z"].to_numpy())):
            if lead[k] < 0:
                near = lead[first[k] : end[k]]
                near[near < 0] = pos[k]
        return pd.DataFrame({"chr": pdf["chr"], "pos": pos, "lead": lead})

    kind = best.schema["chr"].dataType.simpleString()
    return rows.groupBy("chr", "island").applyInPandas(run, f"chr {kind}, pos long, lead long")
