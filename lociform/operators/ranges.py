"""Range and nearest joins by genomic bins: equality on (chr, bin), the range as a residual.

Sums and largest values over such pairs need no pairs: folded() and covered() find them from running sums within a bin.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

WIDTH = 1 << 17


def _bin(c: Column | str, width: int) -> Column:
    return F.floor((F.col(c) if isinstance(c, str) else c) / width).cast("long")


def binned(intervals: DataFrame, width: int = WIDTH, start: str = "start", end: str = "end") -> DataFrame:
    """One row for each bin that an interval touches; empty intervals have none."""
    return intervals.where(F.col(start) <= F.col(end)).withColumn("_bin", F.explode(F.sequence(_bin(start, width), _bin(end, width))))


def points_in(points: DataFrame, intervals: DataFrame, how: str = "inner", width: int = WIDTH) -> DataFrame:
    """Points (chr, pos, ...) with the intervals (chr, start, end, ...) that hold them, both ends inclusive.

    A point has one bin, so no pair comes twice.  how: inner, left, left_semi or left_anti.  Other
    columns of both sides must differ in name.
    """
    p = points.withColumn("_bin", _bin("pos", width)).alias("p")
    i = binned(intervals, width).alias("i")
    on = (F.col("p.chr") == F.col("i.chr")) & (F.col("p._bin") == F.col("i._bin")) & (F.col("pos") >= F.col("i.start")) & (F.col("pos") <= F.col("i.end"))
    joined = p.join(i, on, how)
    if how in ("left_semi", "left_anti"):
        return joined.drop("_bin")
    return joined.select(*(F.col(f"p.{c}") for c in points.columns), *(F.col(f"i.{c}") for c in intervals.columns if c != "chr"))


def overlapping(a: DataFrame, b: DataFrame, width: int = WIDTH) -> DataFrame:
    """Pairs of intervals that overlap, both ends inclusive; b's columns get the suffix _b.

    A pair that shares several bins is kept in the first of them only.
    """
    other = b.select(*(F.col(c).alias(f"{c}_b") for c in b.columns))
    x, y = binned(a, width).withColumnRenamed("_bin", "_bin_a"), binned(other, width, "start_b", "end_b")
    on = (F.col("chr") == F.col("chr_b")) & (F.col("_bin_a") == F.col("_bin")) & (F.col("start") <= F.col("end_b")) & (F.col("end") >= F.col("start_b"))
    first = _bin(F.greatest("start", "start_b"), width) == F.col("_bin")
    return x.join(y, on & first).drop("_bin", "_bin_a", "chr_b")


def nearest(points: DataFrame, intervals: DataFrame, id_col: str, width: int = WIDTH) -> DataFrame:
    """Points with the nearest interval of their chromosome: near (its id), distance (0 inside); null where there is none.

    Ties: the interval at the left or around, then the smaller id.  What lies outside a point's bin comes
    from a summary of bins (last end before, first start after), at most a row for each bin of the
    genome; only within a bin are points and intervals sorted together, so no task sees a chromosome.
    """
    own = intervals.select("chr", "start", "end", F.col(id_col).alias("_id")).withColumn("_bin", _bin("start", width))
    left = F.struct("end", (-F.col("_id")).alias("n"))
    right = F.struct("start", F.col("_id").alias("n"))
    used = points.select("chr", _bin("pos", width).alias("_bin")).distinct()
    sums = own.groupBy("chr", "_bin").agg(F.max(left).alias("_l"), F.min(right).alias("_r"))
    bins = used.join(sums, ["chr", "_bin"], "full")
    by_bin = Window.partitionBy("chr").orderBy("_bin")
    before = F.max("_l").over(by_bin.rowsBetween(Window.unboundedPreceding, -1))
    after = F.min("_r").over(by_bin.rowsBetween(1, Window.unboundedFollowing))
    outside = bins.select("chr", "_bin", before.alias("_before"), after.alias("_after"))
    row = points.select("chr", "pos", _bin("pos", width).alias("_bin"), F.struct(*points.columns).alias("_row"), F.lit(None).cast(own.schema["_id"].dataType).alias("_id"), F.lit(None).cast("long").alias("end"), F.lit(1).alias("_last"))
    both = row.unionByName(own.select("chr", F.col("start").alias("pos"), "_bin", F.lit(None).cast(row.schema["_row"].dataType).alias("_row"), "_id", "end", F.lit(0).alias("_last")))
    within = Window.partitionBy("chr", "_bin").orderBy("pos", "_last")
    here_left = F.max(F.when(F.col("_last") == 0, F.struct("end", (-F.col("_id")).alias("n")))).over(within.rowsBetween(Window.unboundedPreceding, 0))
    here_right = F.min(F.when(F.col("_last") == 0, F.struct(F.col("pos").alias("start"), F.col("_id").alias("n")))).over(within.rowsBetween(0, Window.unboundedFollowing))
    seen = both.withColumn("_hl", here_left).withColumn("_hr", here_right).where("_last = 1")
    seen = seen.join(outside, ["chr", "_bin"], "left").withColumn("_l", F.greatest("_hl", "_before")).withColumn("_r", F.coalesce("_hr", "_after"))
    to_left = F.greatest(F.lit(0), F.col("pos") - F.col("_l.end"))
    to_right = F.col("_r.start") - F.col("pos")
    take_left = F.col("_l").isNotNull() & (F.col("_r").isNull() | (to_left <= to_right))
    return seen.select("_row.*", F.when(take_left, -F.col("_l.n")).otherwise(F.col("_r.n")).alias("near"), F.when(take_left, to_left).otherwise(to_right).alias("distance"))


# ---- aggregates of pairs ----------------------------------------------------------------------

#: Width of the bins of aggregates: wider, since work within a bin does not grow with its pairs.
WIDE = 1 << 20


def _levels(n: int) -> int:
    return max(1, n).bit_length()


def _tops_of_runs(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The largest value of each run first to last (exclusive, not empty), from the largest of all runs of powers of two."""
    out = np.empty(len(first))
    level = np.frexp(last - first)[1] - 1
    table = values
    for k in range(_levels(len(values))):
        own = level == k
        out[own] = np.maximum(table[first[own]], table[last[own] - (1 << k)])
        if len(table) <= 1 << k:
            break
        table = np.maximum(table[: -(1 << k)], table[1 << k :])
    return out


def _tops_of_covers(values: np.ndarray, first: np.ndarray, last: np.ndarray, n: int) -> np.ndarray:
    """The largest value of the runs that cover each of n places; -inf where none does."""
    level = np.frexp(last - first)[1] - 1
    table = np.full(n, -np.inf)
    for k in range(_levels(n) - 1, -1, -1):
        own = level == k
        np.maximum.at(table, first[own], values[own])
        np.maximum.at(table, last[own] - (1 << k), values[own])
        if k:
            # runs of 2^k places are two of half as many
            half = 1 << (k - 1)
            below = table.copy()
            below[half:] = np.maximum(below[half:], np.where(np.arange(n - half) + (1 << k) <= n, table[: n - half], -np.inf))
            table = below
    return table


def _running(values: pd.Series) -> np.ndarray:
    """Sums of all first values, a null being 0; wider than a double, so that differences keep its precision."""
    return np.concatenate([[0], np.cumsum(np.nan_to_num(values.to_numpy(np.float64)).astype(np.longdouble))])


def _largest(values: pd.Series) -> np.ndarray:
    return np.nan_to_num(values.to_numpy(np.float64), nan=-np.inf, posinf=np.inf, neginf=-np.inf)


def _met(a: DataFrame, b: DataFrame, keys: list[str], group: str | None, kind: DataFrame, sums: list[str], tops: list[str], program) -> DataFrame:
    """program(a's rows, b's rows of one group) in each bin of a and b, which have _bin; it returns a's rows and n, sums and tops."""
    names = [*keys, *([group] if group else []), "n", *sums, *tops]

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        for value, own in (right.groupby("_group", sort=False, dropna=False) if group else [(None, right)]):
            if len(left) and len(own):
                rows, columns = program(left, own)
                frame = left[keys].iloc[rows].reset_index(drop=True).assign(**columns)
                out.append(frame.assign(**{group: value}) if group else frame)
        return pd.concat(out)[names] if out else pd.DataFrame(columns=names)

    typed = [(c, a.schema[c].dataType.simpleString()) for c in keys] + ([(group, kind.schema[group].dataType.simpleString())] if group else []) + [("n", "bigint")] + [(c, "double") for c in (*sums, *tops)]
    other = b.withColumnsRenamed({"chr": "_chr", "_bin": "_at"} | ({group: "_group"} if group else {}))
    out = a.groupBy("chr", "_bin").cogroup(other.groupBy("_chr", "_at")).applyInPandas(run, ", ".join(f"`{c}` {t}" for c, t in typed))
    return out.select(*(F.when(F.col(c) > float("-inf"), F.col(c)).alias(c) if c in tops else F.col(c) for c in names))


def folded(points: DataFrame, intervals: DataFrame, keys: list[str], sums: list[str] = (), tops: list[str] = (), group: str | None = None, width: int = WIDE) -> DataFrame:
    """(keys, group, n, sums, tops): how many points (chr, pos, ...) an interval (chr, start, end, keys) holds, both ends
    inclusive, their sums and largest values, by the points' group: what an aggregate of points_in() gives, without its pairs.

    An interval has a row for each bin and group in which it holds points: sum and max over the keys make the whole.
    Points of a position are one row first, so that a bin holds at most its width of them for each group.
    """
    at = ["chr", "pos", *([group] if group else [])]
    rows = points.groupBy(*at).agg(F.count("*").alias("_n"), *(F.sum(F.col(c).cast("double")).alias(c) for c in sums), *(F.max(F.col(c).cast("double")).alias(c) for c in tops)).withColumn("_bin", _bin("pos", width))

    def program(own: pd.DataFrame, held: pd.DataFrame) -> tuple[np.ndarray, dict]:
        held = held.sort_values("pos")
        pos = held["pos"].to_numpy(np.int64)
        first, last = np.searchsorted(pos, own["start"].to_numpy(np.int64), "left"), np.searchsorted(pos, own["end"].to_numpy(np.int64), "right")
        some = np.flatnonzero(last > first)
        first, last = first[some], last[some]
        count = np.concatenate([[0], np.cumsum(held["_n"].to_numpy(np.int64))])
        running = {c: _running(held[c]) for c in sums}
        return some, {"n": count[last] - count[first]} | {c: (t[last] - t[first]).astype(np.float64) for c, t in running.items()} | {c: _tops_of_runs(_largest(held[c]), first, last) for c in tops}

    return _met(binned(intervals.select(*dict.fromkeys(["chr", "start", "end", *keys])), width), rows, keys, group, points, list(sums), list(tops), program)


def covered(points: DataFrame, intervals: DataFrame, keys: list[str], sums: list[str] = (), tops: list[str] = (), group: str | None = None, width: int = WIDE) -> DataFrame:
    """(keys, group, n, sums, tops): how many intervals hold a point (chr, pos, keys), their sums and largest values, by the
    intervals' group: one row for each row of points and group that holds it.  Pairs are not made.
    """

    def program(own: pd.DataFrame, over: pd.DataFrame) -> tuple[np.ndarray, dict]:
        place, at = np.unique(own["pos"].to_numpy(np.int64), return_inverse=True)
        begun, ended = over.sort_values("start"), over.sort_values("end")
        b, e = np.searchsorted(begun["start"].to_numpy(np.int64), place, "right"), np.searchsorted(ended["end"].to_numpy(np.int64), place, "left")
        told = {"n": b - e} | {c: (_running(begun[c])[b] - _running(ended[c])[e]).astype(np.float64) for c in sums}
        first, last = np.searchsorted(place, over["start"].to_numpy(np.int64), "left"), np.searchsorted(place, over["end"].to_numpy(np.int64), "right")
        some = last > first
        told |= {c: _tops_of_covers(_largest(over[c])[some], first[some], last[some], len(place)) for c in tops}
        rows = np.flatnonzero(told["n"][at] > 0)
        return rows, {c: v[at][rows] for c, v in told.items()}

    spans = binned(intervals.select("chr", "start", "end", *([group] if group else []), *dict.fromkeys([*sums, *tops])), width)
    return _met(points.select(*dict.fromkeys(["chr", "pos", *keys])).withColumn("_bin", _bin("pos", width)), spans, keys, group, intervals, list(sums), list(tops), program)
