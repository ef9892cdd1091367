"""SimHash near-duplicates, compared bit-sliced.

Fingerprints are 64 bit votes over word shingles.  Pairs within ``radius`` bits are found exactly: the
64 bits are cut into radius + 2 segments, two of which must be equal in any such pair, so rows that
share two segments meet.  Where rows meet, 64 of them form a block whose bits are stored as vertical
planes; one row is compared with a whole block by carry-save counters, and a block is abandoned once
all its lanes exceed the radius.

Only spanning edges leave a meeting place, never all pairs; components are then joined by star
contraction.  Meeting places of over ``chunk`` rows are split into pairs of chunks.

Edge cases: null or empty text has fingerprint 0 and links like any other; repeated rows each get a
row; an empty table gives an empty result; other columns are not touched.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociform.llm.common import forget, joined, materialise, prepare

SEED = 42


def simhash(text: bytes | None, width: int = 4) -> int:
    """Fingerprint of one UTF-8 text."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = [n - 1 for n in accumulate(len(w) + 1 for w in words)]
    starts = [0, *(n + 1 for n in ends)]
    digest = xxhash.xxh64_digest
    hashes = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts, ends[width - 1 :])])
    bits = np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1)
    votes = bits.sum(axis=0, dtype=np.int64) * 2 > len(bits)
    return int.from_bytes(np.packbits(votes).tobytes(), "big")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """id_col and fp (the fingerprint as a signed long) for each row."""
    prepare(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([simhash(t, width) for t in b.column(1).cast(pa.binary()).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["id", "fp"])

    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, fp long").withColumnRenamed("id", id_col)


# ---- comparison -------------------------------------------------------------------------------

ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
#: LOW[k] has the k lowest bits set.
LOW = np.array([(1 << k) - 1 for k in range(65)], np.uint64)
AT_ONCE = 16384


def planes(fp: np.ndarray) -> np.ndarray:
    """For each block of 64 fingerprints 64 words: bit r of word p is bit p of the block's row r."""
    n = -(-len(fp) // 64) * 64
    padded = np.zeros(n, np.uint64)
    padded[: len(fp)] = fp
    bits = np.unpackbits(padded.view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    sliced = np.packbits(bits.reshape(-1, 64, 64).transpose(0, 2, 1), axis=2, bitorder="little")
    return np.ascontiguousarray(sliced).view(np.uint64).reshape(-1, 64)


def unite(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Join the sets of i and j; labels keep pointing at the smallest index of a set."""
    while True:
        a, b = labels[i], labels[j]
        if not (differ := a != b).any():
            return
        i, j, a, b = i[differ], j[differ], a[differ], b[differ]
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        while (deeper := labels[labels] != labels).any():
            labels[deeper] = labels[labels[deeper]]


def within(fp: np.ndarray, start: np.ndarray, end: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs i < j of the same group at most radius (up to 6) bits apart; row i's group is start[i]:end[i]."""
    sliced = planes(fp)
    rows = np.flatnonzero(end - np.arange(len(fp)) > 1)
    first, last = rows // 64, (end[rows] - 1) // 64
    spans = last - first + 1
    edges = np.concatenate([[0], np.cumsum(spans)])
    for lo in range(0, int(edges[-1]), AT_ONCE):
        k = np.arange(lo, min(lo + AT_ONCE, int(edges[-1])))
        at = np.searchsorted(edges, k, "right") - 1
        row, block = rows[at], first[at] + k - edges[at]
        mask = LOW[np.clip(end[row] - 64 * block, 0, 64)] & ~LOW[np.clip(row + 1 - 64 * block, 0, 64)]
        keep = mask != 0
        row, block, mask = row[keep], block[keep], mask[keep]
        ones, twos, fours, over = (np.zeros(len(row), np.uint64) for _ in range(4))
        far = ~mask
        for p in range(64):
            d = sliced[block, p] ^ (np.uint64(0) - ((fp[row] >> np.uint64(p)) & np.uint64(1)))
            carry = ones & d
            ones ^= d
            two = twos & carry
            twos ^= carry
            over |= fours & two
            fours ^= two
            if p % 8 == 7:
                # the count is over the radius where a counter has overflowed or reads more
                count_over = over.copy()
                for c in range(radius + 1, 8):
                    count_over |= (ones if c & 1 else ~ones) & (twos if c & 2 else ~twos) & (fours if c & 4 else ~fours)
                over |= count_over
                far |= over
                keep = far != ALL
                if not keep.all():
                    row, block, mask, ones, twos, fours, over, far = (x[keep] for x in (row, block, mask, ones, twos, fours, over, far))
                if not len(row):
                    break
        if len(row):
            entry, lane = np.nonzero(np.unpackbits((~far).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            yield row[entry], block[entry] * 64 + lane


def spanning(keys: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (row, smaller row) that connect what is linked in each run of equal keys."""
    n = len(fp)
    new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    sizes = np.diff(np.concatenate([new, [n]]))
    start, end = np.repeat(new, sizes), np.repeat(new + sizes, sizes)
    labels = np.arange(n)
    for i, j in within(fp, start, end, radius):
        unite(labels, i, j)
    moved = np.flatnonzero(labels != np.arange(n))
    return moved, labels[moved]


def edges_in_order(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Spanning edges over rows (place, fp) sorted by place, for whole places at a time."""
    held_key, held_fp = np.empty(0, np.int64), np.empty(0, np.int64)

    def out(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        a, b = spanning(key, fp.view(np.uint64), radius)
        u, v = fp[a], fp[b]
        return pa.RecordBatch.from_arrays([pa.array(np.maximum(u, v)), pa.array(np.minimum(u, v))], ["a", "b"])

    for batch in batches:
        held_key = np.concatenate([held_key, batch.column(0).to_numpy()])
        held_fp = np.concatenate([held_fp, batch.column(1).to_numpy()])
        if len(held_key) < 4096:
            continue
        cut = int(np.searchsorted(held_key, held_key[-1], "left"))
        if cut:
            yield out(held_key[:cut], held_fp[:cut])
            held_key, held_fp = held_key[cut:], held_fp[cut:]
    if len(held_key):
        yield out(held_key, held_fp)


def links(distinct: DataFrame, radius: int = 4, chunk: int = 16384) -> DataFrame:
    """Edges (a, b) of longs whose components are those of all pairs of distinct fp within radius bits.

    The number of rows is a few times that of fp, whatever the groups' sizes.
    """
    if not 0 <= radius <= 6:
        raise ValueError("radius must be 0 to 6: the counters have three bits")
    parts = radius + 2
    bounds = [64 * k // parts for k in range(parts + 1)]
    cut = [F.shiftrightunsigned("fp", lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)) for lo, hi in zip(bounds, bounds[1:])]
    size = max(hi - lo for lo, hi in zip(bounds, bounds[1:]))
    places = [
        F.lit(n << (2 * size)).cast("long").bitwiseOR(F.shiftleft(cut[i], size)).bitwiseOR(cut[j])
        for n, (i, j) in enumerate(combinations(range(parts), 2))
    ]
    met = distinct.select("fp", F.explode(F.array(*places)).alias("place"))
    # hot places are few: at most len(places) / chunk of the rows
    hot = met.groupBy("place").count().where(F.col("count") > chunk).select("place", F.ceil(F.col("count") / chunk).cast("int").alias("n"))
    hot = materialise(hot, "simhash-hot")
    if hot.isEmpty():
        dealt = met.select("place", "fp")
    else:
        cell = F.pmod(F.xxhash64("fp"), F.col("n")).cast("int")
        other = F.explode(F.sequence(F.lit(0), F.col("n") - 1))
        split = met.join(hot, "place").withColumn("cell", cell).withColumn("other", other)
        pair = F.xxhash64("place", F.least("cell", "other"), F.greatest("cell", "other"))
        dealt = met.join(hot, "place", "left_anti").select("place", "fp").unionByName(split.select(pair.alias("place"), "fp"))
    ordered = dealt.repartition("place").sortWithinPartitions("place")
    found = ordered.select("place", "fp").mapInArrow(lambda it: edges_in_order(it, radius), "a long, b long")
    return found.distinct()


def components(edges: DataFrame) -> DataFrame:
    """Node and root (its component's smallest node) for each node of the edges (a, b), a > b.

    Alternates large and small stars until nothing moves; each round is a written table.  Nodes of very many
    neighbours, the roots of large components, meet them by broadcast.
    """
    now = materialise(edges.where("a > b").select("a", "b").distinct(), "cc")
    mark, rows = None, now.count()
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialise(both.groupBy("a").agg(F.min("b").alias("m"), F.sum(F.when(F.col("b") > F.col("a"), 1).otherwise(0)).alias("n")).select("a", F.least("a", "m").alias("m"), "n"), "cc-least")
        large = joined(both.where("b > a"), least, "a", rows).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").distinct()
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lower, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b")
        after = materialise(small.unionByName(lower.select("a", F.col("m").alias("b"))).distinct(), "cc")
        rows, *seen = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        forget(now)
        forget(least)
        now = after
        if [rows, *seen] == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = [rows, *seen]


def named(reps: DataFrame, roots: DataFrame, key: str) -> DataFrame:
    """(key, component_id, n): the least of each component for each row (key, least, n) of reps, written."""
    rooted = reps.join(roots, F.col(key) == roots.node, "left").select(key, "least", F.col("n").alias("rows"), F.coalesce("root", key).alias("root"))
    rooted = materialise(rooted, "component-roots")
    names = materialise(rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n")), "component-names")
    return materialise(joined(rooted, names, "root", rooted.count()).select(key, "component_id", F.col("rows").alias("n")), "components")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, radius: int = 4) -> DataFrame:
    """id_col, fingerprint (16 hex digits) and component_id (the smallest id reachable) for each row.

    A null id gets a row like any other, but never names a component unless all ids in it are null.
    """
    docs = materialise(fingerprints(df, id_col, text_col, width).toDF("id", "fp"), "simhash-fp")
    reps = materialise(docs.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n")), "simhash-reps")
    classes = named(reps, components(links(reps.select("fp"), radius)), "fp")
    out = joined(docs, classes, "fp", docs.count())
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(df: DataFrame, id_col: str, text_col: str, grouping: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """df with one row of each component: that of the smallest id, then of the smallest hash of its text.

    grouping makes (key, component_id) of (key, text).  Null ids come last; of rows equal in id and text one stays.
    Rows are carried as one struct, so that columns may have any name.
    """
    key = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"))
    packed = df.select(F.struct("*").alias("row"), key.alias("key"), F.col(text_col).alias("text"))
    classes = grouping(packed.select("key", "text"))
    kept = materialise(classes.where(F.col("key") == F.col("component_id")).groupBy("key").count(), "kept")
    out = packed.select("row", "key").join(kept.select("key").hint("shuffle_hash"), "key", "left_semi")
    if not kept.where("count > 1").isEmpty():
        out = out.dropDuplicates(["key"])
    return out.select(*(F.col("row").getField(c).alias(c) for c in df.columns))


def deduplicate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, radius: int = 4) -> DataFrame:
    """df with one row of each component, as one_of_each() chooses it."""
    return one_of_each(df, id_col, text_col, lambda keyed: near_duplicates(keyed, "key", "text", width, radius))
