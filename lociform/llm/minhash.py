"""Near duplicates by exact Jaccard similarity of word shingles, candidates from circulant MinHash.

1. A document is the set of its distinct shingles of ``width`` lower-case words, each a hash of 64 bits.
   Documents of equal sets are one from here on: they meet on a digest of 128 bits.
2. All K signature coordinates come from two permutations of PLACES places.  The first one spreads the
   shingles over the places, the second one gives them values, circularly shifted by k for coordinate k.
   The K values of a shingle are thus one run of the second permutation, read at once.
3. BANDS keys of ROWS coordinates each: a pair of similarity s shares one with probability
   1 - (1 - s ** ROWS) ** BANDS, that is 0.99999996 at 0.85, 0.99997 at 0.8 and 0.15 at 0.3.
4. Only sets that share a key are compared, on the sets themselves, and only where earlier links have not
   joined them yet.  A candidate component of up to ``chunk`` shingles meets in one place, to which each text
   goes once.  Of a larger component every key is a place of its own (keys of the same sets once), and a key
   of more than ``chunk`` shingles is dealt into cells, each two of which meet.
5. Where ``fingerprint`` says so, the class of a set's SimHash fingerprints (linked at 4 bits, as ``simhash`` links
   them) is one more key: texts that meet there are compared like others.
6. Spanning edges of the links leave a place, never all pairs; star contraction joins them.

Edge cases: a text of fewer words than a shingle is one shingle; null texts and texts without words have
the empty set, which links with nothing, or with its like where ``empty`` says so.  A null id gets a row
like any other but names a component only where all its ids are null.  Repeated rows get a row each.  An
empty table gives an empty result; other columns are not touched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociform.llm.common import HOT, forget, free_name, joined, materialise, prepare
from lociform.llm.simhash import components, links, named, simhash, unite

BANDS, ROWS = 20, 4
COORDINATES = BANDS * ROWS
#: Places of the permutations; a text's shingles are few among them.
PLACES = 1 << 20
SEED = 7
#: A document weighs as much as its shingles and so many more.
FIXED = 100
#: Shingles read at once.
PART = 4096
_PERMUTATIONS: list[np.ndarray] = []


def permutations() -> tuple[np.ndarray, np.ndarray]:
    """The first permutation, and the runs of the second one: row s holds its values at s, s + 1, ... around the circle."""
    if not _PERMUTATIONS:
        rng = np.random.default_rng(SEED)
        first, second = (rng.permutation(PLACES).astype(np.uint32) for _ in range(2))
        runs = np.lib.stride_tricks.sliding_window_view(np.concatenate([second, second[: COORDINATES - 1]]), COORDINATES)
        _PERMUTATIONS.extend([first, runs])
    return _PERMUTATIONS[0], _PERMUTATIONS[1]


def shingles(text: bytes | None, width: int = 5) -> np.ndarray:
    """Distinct shingle hashes of one UTF-8 text, sorted; none without words."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    digest = xxhash.xxh64_intdigest
    w = np.array([digest(x) for x in words], np.uint64)
    n = len(w) - width + 1
    h = np.zeros(n, np.uint64)
    for k in range(width):
        # a polynomial in an odd number keeps the order of the words
        h = h * np.uint64(0x9E3779B97F4A7C15) + w[k : k + n]
        h ^= h >> np.uint64(29)
    return np.unique(h)


def signature(own: np.ndarray) -> np.ndarray:
    """The circulant MinHash coordinates of a set that is not empty."""
    first, runs = permutations()
    at = first[(own % np.uint64(PLACES)).astype(np.int64)]
    least = runs[at[:PART]].min(axis=0)
    for a in range(PART, len(at), PART):
        np.minimum(least, runs[at[a : a + PART]].min(axis=0), out=least)
    return least


def bands(own: np.ndarray) -> np.ndarray:
    """The BANDS keys of a set; none of the empty set."""
    if not len(own):
        return np.empty(0, np.int64)
    raw, step = signature(own).tobytes(), 4 * ROWS
    return np.array([xxhash.xxh64_intdigest(raw[step * k : step * (k + 1)], k) for k in range(BANDS)], np.uint64).view(np.int64)


def signed(df: DataFrame, width: int, fingerprint: bool = False) -> DataFrame:
    """(key, digest of the set, size of the set, its bands, fp) for each row (key, text); the key is any column.

    fp: the text's SimHash fingerprint as a signed long, where it is asked for.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).cast(pa.binary()).to_pylist()
            sets = [shingles(t, width) for t in texts]
            fps = np.array([simhash(t) for t in texts], np.uint64).view(np.int64) if fingerprint else [None] * len(texts)
            digests = pa.array([xxhash.xxh3_128_digest(s.tobytes(), SEED) for s in sets], pa.binary())
            keys = [bands(s) for s in sets]
            offsets = np.cumsum([0, *map(len, keys)])
            listed = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(keys or [np.empty(0, np.int64)])))
            yield pa.RecordBatch.from_arrays([b.column(0), digests, pa.array([len(s) for s in sets], pa.int64()), listed, pa.array(fps, pa.int64())], ["key", "digest", "size", "bands", "fp"])

    return df.select("key", "text").mapInArrow(run, f"key {df.schema['key'].dataType.simpleString()}, digest binary, size long, bands array<long>, fp long")


def linked(sets: list[np.ndarray], percent: int, keys: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Edges (set, other set) that connect all sets with 100 * shared >= percent * union.

    keys: a row of band keys for each set; sets without an equal key are not compared.
    """
    order = np.argsort([len(s) for s in sets], kind="stable")
    sizes = np.array([len(sets[k]) for k in order])
    ends = np.cumsum(sizes)
    starts = ends - sizes
    distinct, flat = np.unique(np.concatenate([sets[k] for k in order]), return_inverse=True)
    mark = np.zeros(len(distinct), np.int32)
    labels = np.arange(len(sets))
    keys = None if keys is None else keys[order]
    for i in range(len(sets)):
        # sizes rise, so the larger ones that may reach the similarity are neighbours
        last = int(np.searchsorted(sizes, sizes[i] * 100 // percent, "right"))
        other = i + 1 + np.flatnonzero(labels[i + 1 : last] != labels[i])
        if keys is not None and len(other):
            other = other[(keys[other] == keys[i]).any(axis=1)]
        if not len(other):
            continue
        mine = flat[starts[i] : ends[i]]
        mark[mine] = 1
        # a slice at a time, however many partners there are
        for a in range(0, len(other), 512):
            some = other[a : a + 512]
            n = sizes[some]
            offsets = np.cumsum(n) - n
            at = np.repeat(starts[some] - offsets, n) + np.arange(int(n.sum()))
            shared = np.add.reduceat(mark[flat[at]], offsets).astype(np.int64)
            near = some[100 * shared >= percent * (sizes[i] + n - shared)]
            unite(labels, np.full(len(near), i), near)
        mark[mine] = 0
    moved = np.flatnonzero(labels != np.arange(len(sets)))
    return order[moved], order[labels[moved]]


def edges_in_order(batches: Iterator[pa.RecordBatch], width: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Edges over rows (place, digest, near, text) sorted by place, a whole place at a time; near is a key, if any."""
    place, held, near = None, {}, {}

    def out() -> pa.RecordBatch:
        names, sets = list(held), list(held.values())
        keys = [bands(s) if near[d] is None else np.append(bands(s), np.int64(near[d])) for d, s in held.items()]
        a, b = linked(sets, percent, np.array(keys))
        pairs = [(names[i], names[j]) for i, j in zip(a.tolist(), b.tolist())]
        return pa.RecordBatch.from_arrays([pa.array([f(p) for p in pairs], pa.binary()) for f in (max, min)], ["a", "b"])

    for batch in batches:
        texts = batch.column(3).cast(pa.binary())
        for k, (p, digest, own) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3)))):
            if p != place:
                if len(held) > 1:
                    yield out()
                place, held, near = p, {}, {}
            if digest not in held:
                held[digest], near[digest] = shingles(texts[k].as_py(), width), own
    if len(held) > 1:
        yield out()


def by_key(members: DataFrame, chunk: int) -> DataFrame:
    """(least, digest, near, place) for the members (least, digest, size, root, bands, near) of large components: key by key.

    Keys that the same sets share are one.  A key over chunk becomes cells; pairs of cells are places.
    """
    each = members.select("least", "digest", "near", "root", (F.col("size") + FIXED).alias("w"), F.explode("bands").alias("band"))
    keys = each.groupBy("band").agg(F.min("root").alias("root"), F.count("*").alias("n"), F.sum("w").alias("w"), F.sum(F.xxhash64("digest").cast("decimal(38,0)")).alias("who"))
    keys = materialise(keys.where("n > 1").groupBy("root", "n", "w", "who").agg(F.min("band").alias("band")), "minhash-keys")
    cells = F.ceil(F.col("w") * 2 / chunk).cast("int")
    met = joined(each.select("least", "digest", "near", "band"), keys.select("band", "n", F.when(F.col("w") > chunk, cells).otherwise(1).alias("cells")), "band", keys.agg(F.sum("n")).first()[0] or 0)
    cell = F.pmod(F.xxhash64("digest"), F.col("cells")).cast("int")
    split = met.withColumn("cell", cell).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))
    pair = F.when(F.col("cells") == 1, F.col("band")).otherwise(F.xxhash64("band", F.least("cell", "other"), F.greatest("cell", "other")))
    return split.select("least", "digest", "near", pair.alias("place"))


def meetings(reps: DataFrame, chunk: int) -> DataFrame:
    """(least, digest, near, place): where each set that shares a key with another one is compared."""
    band = reps.select("digest", F.explode("bands").alias("band"))
    first = materialise(band.groupBy("band").agg(F.min("digest").alias("b"), F.count("*").alias("n")).where("n > 1"), "minhash-bands")
    star = joined(band, first, "band", first.agg(F.sum("n")).first()[0] or 0).where("digest > b").select(F.col("digest").alias("a"), "b").distinct()
    found = components(star).select(F.col("node").alias("digest"), "root")
    found = materialise(found.unionByName(found.select(F.col("root").alias("digest"), "root")).distinct(), "minhash-roots")
    forget(first)
    members = materialise(found.join(reps.select("digest", "least", "size", "bands", "near"), "digest"), "minhash-members")
    forget(found)
    # large components are few: at most the weight of all sets / chunk
    large = materialise(members.groupBy("root").agg(F.sum(F.col("size") + FIXED).alias("w")).where(F.col("w") > chunk).select("root"), "minhash-large")
    small = members.select("least", "digest", "near", F.xxhash64("root").alias("place"))
    if large.isEmpty():
        return small
    small = members.join(large, "root", "left_anti").select("least", "digest", "near", F.xxhash64("root").alias("place"))
    return small.unionByName(by_key(members.join(large, "root"), chunk))


def with_fingerprints(reps: DataFrame, marked: DataFrame) -> DataFrame:
    """reps with near, the class of the fingerprints of a set's texts, among their bands; sets without words have none.

    Fingerprints are of one class where they link or are those of one set.
    """
    told = materialise(marked.where("size > 0").select("digest", "fp").distinct(), "minhash-fp")
    least = told.groupBy("digest").agg(F.min("fp").alias("b"))
    same = told.join(least, "digest").where("fp > b").select(F.col("fp").alias("a"), "b")
    roots = components(links(told.select("fp").distinct()).unionByName(same))
    near = least.join(roots, F.col("b") == roots.node, "left").select("digest", F.coalesce("root", "b").alias("near"))
    out = reps.drop("near").join(near, "digest", "left")
    return out.withColumn("bands", F.when(F.col("near").isNull(), F.col("bands")).otherwise(F.concat("bands", F.array("near"))))


def classes(df: DataFrame, width: int = 5, percent: int = 85, chunk: int = 250_000, empty: bool = False, fingerprint: bool = False) -> DataFrame:
    """key, size (of its set) and component_id (the smallest key of its component) for each row (key, text).

    The key is any column that can be ordered; rows of equal keys have equal texts.  empty: whether empty sets
    are equal, or each one is alone and has its own key for component_id.  fingerprint: whether sets whose texts are
    of one class of fingerprints are compared too.
    """
    prepare(df.sparkSession)
    marked = materialise(signed(df, width, fingerprint), "minhash-sets")
    reps = marked if empty else marked.where("size > 0")
    reps = materialise(reps.groupBy("digest").agg(F.min("key").alias("least"), F.count("*").alias("n"), F.max("size").alias("size"), F.any_value("bands").alias("bands")).withColumn("near", F.lit(None).cast("long")), "minhash-reps")
    if fingerprint:
        reps = materialise(with_fingerprints(reps, marked), "minhash-reps")
    dealt = materialise(meetings(reps, chunk), "minhash-meetings")
    texts = df.select(F.col("key").alias("least"), "text")
    if not marked.groupBy("key").count().where(F.col("count") > HOT).isEmpty():
        # many equal rows: one of each leaves a task
        texts = texts.dropDuplicates(["least"])
    meeting = texts.join(dealt.hint("shuffle_hash"), "least").select("place", "digest", "near", "text").repartition("place").sortWithinPartitions("place")
    edges = meeting.mapInArrow(lambda it: edges_in_order(it, width, percent), "a binary, b binary")
    found = named(reps.select("digest", "least", "n"), components(edges), "digest")
    forget(reps)
    forget(dealt)
    out = joined(marked.select("key", "size", "digest"), found, "digest", marked.count()).select("key", "size", "component_id")
    return out if empty else out.unionByName(marked.where("size = 0").select("key", "size", F.col("key").alias("component_id")))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 85, chunk: int = 250_000) -> DataFrame:
    """id_col, n_shingles, component_id (the smallest id reachable) and kept (it is this row's id) for each row."""
    key = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"))
    own = free_name(["n_shingles", "component_id", "kept"], id_col)
    found = classes(df.select(key.alias("key"), F.col(text_col).alias("text")), width, percent, chunk)
    out = found.select(F.col("key.id").alias(own), F.col("size").alias("n_shingles"), F.col("component_id.id").alias("component_id"))
    return out.withColumn("kept", F.col(own).eqNullSafe(F.col("component_id")))
