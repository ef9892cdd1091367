"""Hard negatives by inner product: ball trees with branch and bound, one to a partition.

1. Each component becomes floor(256 * x), so scores are whole numbers and ties are real ones.
2. Points of one vector and label have equal scores everywhere, so that only the smallest ids among them can be
   among the first k; these are indexed.  Points are dealt to parts by the nearest of some centres, which are points
   chosen by a hash; a centre with many points has several parts.  A part's ball and labels are its summary.
3. A query goes to the part that promises most, and then, with the score of its k-th find, only to parts
   whose balls can hold a score in its window that is not beneath that one.
4. In a part, a tree of balls is built once and queries stream through it.  An inner product with the points
   of a ball lies between q.c - |q| r and q.c + |q| r: a node is left out where that interval misses
   the query's window, where the upper bound is strictly beneath the current k-th score, or where its labels
   cannot be wanted.  Leaves are visited from the highest upper bound down, each by all queries of a batch that want it.

Bounds: at most PARTS centres, which are what the driver holds and each task gets, with as many balls again.
A part holds about points / PARTS points, or LEAST_ROWS.  Where more than QUERIES queries want a part, it gets
copies, each of which answers some of them.

Edge cases: rows with a null label, a null vector, or a null or non-finite component take no part; vectors of fewer
components than others have zeros at their end.  Repeated rows each count as rows (each is a negative of its own);
rows that share the anchor's id are not its positives; a repeated anchor asks once.  A null id comes last among
ties.  Vectors whose scores would leave 64 bits are an error.  No anchors or no points give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lociform.llm.common import materialise, prepare

PARTS, LEAST_ROWS, LEAF = 4096, 1024, 128
QUERIES = 100_000
AT_ONCE = 512
SCALE = 256
LAST = np.iinfo(np.int64).max
POINT = "part long, id long, label int, v array<int>, far double"


def points(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, label, v): rows that take part, with whole components."""
    v = F.col(vector_col).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = df.where(F.col(label_col).isNotNull() & v.isNotNull() & finite)
    return whole.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label"), F.transform(v, lambda x: F.floor(x * SCALE)).alias("v"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows of doubles, zeros at the end of short ones."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(lengths), width))
    out[np.arange(width) < lengths[:, None]] = column.flatten().to_numpy()
    return out


# ---- index ------------------------------------------------------------------------------------


@dataclass
class Index:
    """Points in parts (POINT), the summary of each part, and whether doubles hold all scores."""

    rows: DataFrame
    part: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    labels: np.ndarray
    exact: bool

    @property
    def width(self) -> int:
        return self.centre.shape[1]


def build(found: DataFrame, most: int, parts: int = PARTS, least_rows: int = LEAST_ROWS) -> Index | None:
    """The index of (id, label, v) for searches of up to most finds; None without points."""
    prepare(found.sparkSession)
    # of one vector and label: the smallest most ids besides the one that a query leaves out, each at most most times
    each = found.groupBy("id", "label", "v").agg(F.least(F.count("*"), F.lit(most)).cast("int").alias("times"))
    first = each.withColumn("k", F.row_number().over(Window.partitionBy("label", "v").orderBy(F.asc_nulls_last("id")))).where(F.col("k") <= most + 1)
    found = materialise(first.select("id", "label", "v", F.explode(F.sequence(F.lit(1), "times"))).drop("col"), "ball-points")
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    n, width, widest, longest = found.agg(F.count("*"), F.max(F.size("v")), F.max(F.array_max(F.transform("v", F.abs))), F.max(norm)).first()
    if not n:
        return None
    if (widest or 0) >= 1 << 31 or longest >= 2.0**62:
        raise ValueError("scores of these vectors would leave 64 bits")
    width = max(width, 1)
    rows = max(least_rows, -(-n // parts))
    wanted = -(-n // rows)
    # by a hash of the row; what is chosen bounds nothing but the shape of the parts
    share = F.pmod(F.xxhash64("id", "v"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, 2 * wanted / n))
    chosen = found.where(share).select(F.col("v").cast("array<int>").alias("v")).distinct().limit(wanted).toArrow().column("v").combine_chunks()
    centres = matrix(chosen, width) if len(chosen) else np.zeros((1, width))
    half = (centres * centres).sum(axis=1) / 2

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = matrix(b.column(2), width)
            nearest = (v @ centres.T - half).argmax(axis=1) if len(v) else np.empty(0, np.int64)
            far = np.sqrt(((v - centres[nearest]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(nearest), *b.columns, pa.array(far)], ["part", "id", "label", "v", "far"])

    dealt = found.select("id", "label", F.col("v").cast("array<int>").alias("v")).mapInArrow(deal, POINT)
    dealt = materialise(dealt, "ball-dealt")
    sizes = dealt.groupBy("part").count().select("part", F.ceil(F.col("count") / rows).alias("n"))  # at most PARTS rows
    chunk = F.pmod(F.monotonically_increasing_id(), F.col("n"))  # a row's place in its file, since rows may be equal
    split = dealt.join(F.broadcast(sizes), "part").select((F.col("part") * (1 << 32) + chunk).alias("part"), "id", "label", "v", "far")
    index = materialise(split, "ball-index")
    balls = index.groupBy("part").agg(F.max("far").alias("far"), F.min("label").alias("low"), F.max("label").alias("high")).orderBy("part").collect()  # at most 2 * PARTS rows
    part = np.array([b.part for b in balls], np.int64)
    labels = np.array([(b.low, b.high) for b in balls], np.int64)
    return Index(index, part, centres[part >> 32], np.array([b.far for b in balls]), labels, longest <= 2.0**52)


# ---- one tree ---------------------------------------------------------------------------------


@dataclass
class Tree:
    """Balls over points in order: node k has the points start[k]:end[k] and the children left[k] and left[k] + 1."""

    v: np.ndarray
    id: np.ndarray
    label: np.ndarray
    start: np.ndarray
    end: np.ndarray
    left: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    labels: np.ndarray


def plant(id: np.ndarray, label: np.ndarray, v: np.ndarray, leaf: int = LEAF) -> Tree:
    """Halves at the median between two far points, until a node has `leaf` points or equal ones."""
    order = np.arange(len(v))
    start, end, left, centre, radius, labels = [0], [len(v)], [], [], [], []
    k = 0
    while k < len(start):
        a, b = start[k], end[k]
        own = v[order[a:b]]
        c = own.mean(axis=0)
        far = ((own - c) ** 2).sum(axis=1)
        centre.append(c)
        radius.append(float(np.sqrt(far.max())))
        labels.append((label[order[a:b]].min(), label[order[a:b]].max()))
        if b - a <= leaf or not far.max():
            left.append(-1)
        else:
            one = own[far.argmax()]
            other = own[((own - one) ** 2).sum(axis=1).argmax()]
            order[a:b] = order[a:b][np.argsort(own @ (other - one), kind="stable")]
            left.append(len(start))
            middle = (a + b) // 2
            start += [a, middle]
            end += [middle, b]
        k += 1
    return Tree(v[order], id[order], label[order], np.array(start), np.array(end), np.array(left), np.array(centre), np.array(radius), np.array(labels))


def bounds(q: np.ndarray, centre: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of inner products of each q with each ball's points, wider than rounding."""
    long = np.sqrt((q * q).sum(axis=1))[:, None]
    middle, reach = q @ centre.T, long * radius
    reach = reach + 1e-9 * (long * np.sqrt((centre * centre).sum(axis=1)) + reach) + 1e-6
    return middle - reach, middle + reach


def wanted(same: np.ndarray, label: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Whether a ball whose labels lie between labels[:, 0] and [:, 1] may hold one that a query wants."""
    low, high = labels[:, 0], labels[:, 1]
    own = label[:, None]
    return np.where(same[:, None], (low <= own) & (own <= high), (low != own) | (high != own))


@dataclass
class Asked:
    """Queries: vector, label, whether the same label or another is wanted, id that is not wanted, window and k-th score so far."""

    v: np.ndarray
    label: np.ndarray
    same: np.ndarray
    but: np.ndarray
    low: np.ndarray
    high: np.ndarray
    least: np.ndarray


def descend(tree: Tree, q: Asked, k: int, exact: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scores and ids (queries x k) of the best finds of each query, and how many there are; ties by id."""
    n = len(q.v)
    score, id, found = np.full((n, k), -LAST, np.int64), np.full((n, k), LAST, np.int64), np.zeros(n, np.int64)
    low = np.maximum(q.low, q.least)
    alive = np.zeros((n, len(tree.start)), bool)
    upper = np.full((n, len(tree.start)), -np.inf)
    alive[:, 0] = True
    # down the tree: only nodes that some query still wants are compared
    level = np.array([0])
    while len(level):
        lo, hi = bounds(q.v, tree.centre[level], tree.radius[level])
        alive[:, level] &= (hi >= low[:, None]) & (lo <= q.high[:, None]) & wanted(q.same, q.label, tree.labels[level])
        upper[:, level] = hi
        inner = level[(tree.left[level] >= 0) & alive[:, level].any(axis=0)]
        for side in (0, 1):
            alive[:, tree.left[inner] + side] = alive[:, inner]
        level = np.concatenate([tree.left[inner], tree.left[inner] + 1])
    leaves = np.flatnonzero(tree.left < 0)
    points = tree.v if exact else tree.v.astype(np.int64)
    asked = q.v if exact else q.v.astype(np.int64)
    # leaves from the highest upper bound down, each against all queries that still want it
    reach = np.where(alive[:, leaves], upper[:, leaves], -np.inf)
    for at in np.argsort(-reach.max(axis=0, initial=-np.inf), kind="stable"):
        # what is strictly beneath the k-th score so far is of no use
        beneath = np.where(found >= k, np.maximum(low, score[:, -1]), low)
        who = np.flatnonzero((reach[:, at] >= beneath) & (reach[:, at] > -np.inf))
        if not len(who):
            continue
        part = slice(tree.start[leaves[at]], tree.end[leaves[at]])
        s = (asked[who] @ points[part].T).astype(np.int64)
        label = tree.label[part]
        fit = (s >= beneath[who, None]) & (s <= q.high[who, None]) & ((label == q.label[who, None]) == q.same[who, None]) & (tree.id[part] != q.but[who, None])
        row, column = np.nonzero(fit)
        if not len(row):
            continue
        # what is found so far and now, in order: the first k of each query stay
        some = np.unique(row)
        old = np.arange(k) < found[who[some], None]
        rows = np.concatenate([np.broadcast_to(some[:, None], old.shape)[old], row])
        scores = np.concatenate([score[who[some]][old], s[row, column]])
        ids = np.concatenate([id[who[some]][old], tree.id[part][column]])
        order = np.lexsort((ids, -scores, rows))
        rows, scores, ids = rows[order], scores[order], ids[order]
        start = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
        nth = np.arange(len(rows)) - np.repeat(start, np.diff(np.append(start, len(rows))))
        first = nth < k
        at_query = who[rows[first]]
        score[at_query, nth[first]], id[at_query, nth[first]] = scores[first], ids[first]
        found[who[some]] = np.minimum(np.diff(np.append(start, len(rows))), k)
    return score, id, found


# ---- search -----------------------------------------------------------------------------------


def questions(b: pa.RecordBatch, width: int) -> Asked:
    """Queries of a batch that has v, label, same, but, low, high and least."""
    number = lambda c: b.column(c).to_numpy(zero_copy_only=False)
    return Asked(matrix(b.column("v"), width), *(number(c) for c in ("label", "same", "but", "low", "high", "least")))


def routed(index: Index, queries: DataFrame, rest: bool) -> DataFrame:
    """queries with the part that promises most, or (rest) with all others that may hold something better than least."""
    part, centre, radius, labels, width = index.part, index.centre, index.radius, index.labels, index.width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), AT_ONCE):
                b = batch.slice(a, AT_ONCE)
                q = questions(b, width)
                lo, hi = bounds(q.v, centre, radius)
                fit = (hi >= q.low[:, None]) & (lo <= q.high[:, None]) & wanted(q.same, q.label, labels)
                promise = np.where(fit, np.minimum(hi, q.high[:, None]), -np.inf)
                first = np.zeros_like(fit)
                first[np.arange(len(fit)), promise.argmax(axis=1)] = True
                who, at = np.nonzero(fit & ~first & (hi >= q.least[:, None]) if rest else fit & first)
                told = b.take(pa.array(who))
                yield pa.RecordBatch.from_arrays([pa.array(part[at]), *told.columns], ["part", *told.schema.names])

    return queries.mapInArrow(run, "part long, " + ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in queries.schema))


def answered(index: Index, sent: DataFrame, k: int) -> DataFrame:
    """(key, score, id): up to k finds of each row of sent in its part."""
    width, exact = index.width, index.exact
    # a part that very many ask gets copies; at most 2 * PARTS rows
    copies = F.broadcast(sent.groupBy("part").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("copies")))
    none = {c: F.lit(None).cast(sent.schema[c].dataType).alias(c) for c in ("key", "same", "but", "low", "high", "least")}
    data = index.rows.join(copies, "part").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    data = data.select("part", "copy", F.lit(0).alias("kind"), "id", "label", "v", *none.values())
    asked = sent.join(copies, "part").withColumn("copy", F.pmod(F.xxhash64("key"), F.col("copies")).cast("int"))
    asked = asked.select("part", "copy", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("id"), "label", "v", *none)
    names = data.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, tree, held = None, None, []
        for batch in batches:
            where = np.stack([batch.column(c).to_numpy() for c in range(3)])
            cuts = [0, *(np.flatnonzero((where[:, 1:] != where[:, :-1]).any(axis=0)) + 1).tolist(), len(batch)] if len(batch) else []
            for a, z in zip(cuts, cuts[1:]):
                b = batch.slice(a, z - a)
                if (own := tuple(where[:2, a].tolist())) != place:
                    place, tree, held = own, None, []
                if where[2, a] == 0:
                    held.append(b)
                    continue
                if tree is None:
                    id = np.concatenate([h.column("id").fill_null(LAST).to_numpy() for h in held])
                    tree = plant(id, np.concatenate([h.column("label").to_numpy() for h in held]), np.concatenate([matrix(h.column("v"), width) for h in held]))
                    held = []
                for s in range(0, len(b), AT_ONCE):
                    some = b.slice(s, AT_ONCE)
                    score, id, found = descend(tree, questions(some, width), k, exact)
                    who, nth = np.nonzero(np.arange(k) < found[:, None])
                    ids = id[who, nth]
                    yield pa.RecordBatch.from_arrays([some.column("key").take(pa.array(who)), pa.array(score[who, nth]), pa.array(ids, mask=ids == LAST)], ["key", "score", "id"])

    both = data.unionByName(asked).select(*names).repartition("part", "copy").sortWithinPartitions("part", "copy", "kind")
    return both.mapInArrow(run, f"key {sent.schema['key'].dataType.simpleString()}, score long, id long")


def best(finds: DataFrame, k: int) -> DataFrame:
    """(key, score, id, rank): the first k of each key by score, then id."""
    order = Window.partitionBy("key").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return finds.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(index: Index, queries: DataFrame, k: int) -> DataFrame:
    """(key, score, id, rank) of the k best points for each query (key, v, label, same, but, low, high).

    Wanted are points of the same label (or, where same is false, of another one) whose id is not `but` and
    whose score lies from low to high, both included.
    """
    asked = queries.select("key", "v", "label", "same", "but", "low", "high")
    first = materialise(answered(index, routed(index, asked.withColumn("least", F.lit(-(1 << 62)).cast("long")), False), k), "ball-first")
    kth = first.groupBy("key").agg(F.when(F.count("*") >= k, F.min("score")).alias("least"))
    again = asked.join(kth, "key", "left").withColumn("least", F.coalesce("least", F.lit(-(1 << 62)).cast("long")))
    return best(first.unionByName(answered(index, materialise(routed(index, again, True), "ball-routed"), k)), k)


def hard_negatives(
    df: DataFrame, anchors: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", positives: int = 5, negatives: int = 5, least_percent: int = 80
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    anchors: which rows are anchors.  An anchor's positives are the best other rows of its label; the negatives
    of each are the best rows of other labels that score at most as much and at least least_percent of it.
    """
    chosen = materialise(points(df.where(anchors), id_col, vector_col, label_col).distinct(), "ball-anchors")
    index = build(points(df, id_col, vector_col, label_col), max(positives, negatives))
    long = lambda c: F.lit(c).cast("long")
    if index is None:
        return chosen.select(*(F.lit(None).cast("int" if c == "rank" else "long").alias(c) for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))).limit(0)
    own = chosen.select(F.struct("id", "label", F.xxhash64("v").alias("h")).alias("anchor"), F.col("v").cast("array<int>").alias("v"), "label", F.col("id").alias("but"))
    asked = own.select(F.col("anchor").alias("key"), "v", "label", F.lit(True).alias("same"), F.coalesce("but", long(LAST)).alias("but"), long(-(1 << 62)).alias("low"), long(1 << 62).alias("high"))
    mates = search(index, asked, positives).select(F.col("key").alias("anchor"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), F.col("rank").alias("nth"))
    mates = materialise(mates, "ball-positives")
    key = F.struct("anchor", "nth", "positive_id", "positive_score")
    # the least whole number that is least_percent of the positive's score
    low = -F.floor(-F.col("positive_score").cast("decimal(38,0)") * least_percent / 100).cast("long")
    other = mates.join(own, "anchor").select(key.alias("key"), "v", "label", F.lit(False).alias("same"), long(-LAST).alias("but"), low.alias("low"), F.col("positive_score").alias("high"))
    found = search(index, other, negatives)
    return found.select(
        F.col("key.anchor.id").alias("anchor_id"), F.col("key.positive_id").alias("positive_id"), "rank", F.col("id").alias("negative_id"), F.col("key.positive_score").alias("positive_score"), F.col("score").alias("negative_score"),
    )


NEGATIVES_SQL = """
WITH r AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.id AS anchor_id, b.id, a.label = b.label AS same, CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM r a JOIN r b ON a.id % 100 = 0 AND a.id <> b.id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS k FROM s WHERE same),
n AS (SELECT p.anchor_id, positive_id, s.id AS negative_id, positive_score, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND k <= 5 AND 80 * positive_score <= 100 * s.score AND s.score <= positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INT) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""
