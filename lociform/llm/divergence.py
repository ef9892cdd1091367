"""Divergence of sources: which sources of a language differ, and by which terms, from joint count histograms.

1. One pass over the texts counts terms and the documents that hold them by language and source, within each
   task first.  One shuffle by language and term puts a term's counts in all sources side by side; terms in
   fewer than ``least_docs`` documents of their language go.
2. A smoothed share p of a count depends on the count and its source only.  So the divergence of two sources,
   the sum of abs(p - q) over all kept terms, needs no walk over terms: for each pair of sources it is enough
   to tally the distinct (count, count) combinations and evaluate once per combination, times its number.
   Tasks tally the combinations of terms that both sources have.  Those with a zero are implied: by the
   histogram of each source's own counts, and by the number of kept terms.
3. Terms that a source has more of than its language are ranked beside.

All arithmetic is on whole numbers.  The number of pairs is that of the result's rows; a term's list is as
long as the sources that have it.

Edge cases: null text, language and source are empty strings; a language without kept terms has
divergences of 0; groups without terms take part; repeated rows count each; an empty table gives an empty
result; other columns are not touched.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lociform.llm.common import materialise, prepare

#: Letters a term is made of: ASCII letters, lower-cased, and every byte of what is not ASCII.
LETTERS = bytes(c if c > 127 else ord(chr(c).lower()) if chr(c).isalpha() else 32 for c in range(256))
#: Counts that a task holds before it hands them on, and pairs that it tallies at once.
HELD, AT_ONCE = 200_000, 1_000_000
UNIT = 1_000_000_000


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) of rows (text, lang, source); a null term counts a group's documents."""
    held: dict[tuple[bytes, bytes], tuple[Counter, Counter]] = {}
    size = 0

    def out() -> pa.RecordBatch:
        rows: list[list] = [[], [], [], [], []]
        for (lang, source), (n, docs) in held.items():
            for column, values in zip(rows, ([lang] * len(docs), [source] * len(docs), docs, (n[t] for t in docs), docs.values())):
                column.extend(values)
        text = [pa.array(c, pa.binary()).cast(pa.string()) for c in rows[:3]]
        return pa.RecordBatch.from_arrays([*text, *(pa.array(c, pa.int64()) for c in rows[3:])], ["lang", "source", "term", "n", "docs"])

    for b in batches:
        for text, lang, source in zip(*(b.column(k).cast(pa.binary()).to_pylist() for k in range(3))):
            terms = (text or b"").translate(LETTERS).split()
            own = held.setdefault((lang, source), (Counter(), Counter()))
            size -= len(own[1])
            own[0].update(terms)
            own[1].update(set(terms))
            own[1][None] += 1
            size += len(own[1])
            if size > HELD:
                yield out()
                held.clear()
                size = 0
    if held:
        yield out()


def side_by_side(df: DataFrame, text_col: str, lang_col: str, source_col: str, least_docs: int) -> DataFrame:
    """(lang, term, docs, n, cells: a list of source and n) of each kept term; a null term lists all sources."""
    blank = lambda c, name: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name)
    rows = df.select(F.col(text_col).alias("text"), blank(lang_col, "lang"), blank(source_col, "source"))
    # tasks have counted already; the shuffle by term serves both aggregates
    rows = rows.mapInArrow(counted, "lang string, source string, term string, n long, docs long").repartition("lang", "term")
    each = rows.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    terms = each.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"), F.collect_list(F.struct("source", "n")).alias("cells"))
    return terms.where(F.col("term").isNull() | (F.col("docs") >= least_docs))


def tallied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, a, b, x, y, m): in how many terms of rows (lang, sources, counts) source a has x and b has y; a < b."""
    numbers: dict[str, int] = {}
    held: dict[str, list[np.ndarray]] = {}
    pairs: Counter = Counter()

    def out(lang: str) -> pa.RecordBatch:
        flat = np.concatenate(held.pop(lang), axis=1)
        flat = flat[:, np.lexsort(flat)]
        new = np.flatnonzero(np.concatenate([[True], (flat[:, 1:] != flat[:, :-1]).any(axis=0)]))
        m = np.diff(np.append(new, flat.shape[1]))
        a, b, x, y = flat[:, new]
        names = pa.array(list(numbers), pa.string())
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(new), pa.string()), names.take(pa.array(a)), names.take(pa.array(b)), pa.array(x), pa.array(y), pa.array(m)], ["lang", "a", "b", "x", "y", "m"])

    for batch in batches:
        for lang, sources, counts in zip(*(batch.column(k).to_pylist() for k in range(3))):
            rows = sorted(zip(sources, counts))
            s = np.array([numbers.setdefault(x, len(numbers)) for x, _ in rows], np.int64)
            n = np.array([x for _, x in rows], np.int64)
            # of a long list some rows at a time meet those after them
            step = max(1, AT_ONCE // len(s))
            for k in range(0, len(s) - 1, step):
                i, j = np.nonzero(np.arange(k, min(k + step, len(s)))[:, None] < np.arange(len(s)))
                i += k
                held.setdefault(lang, []).append(np.stack([s[i], s[j], n[i], n[j]]))
                pairs[lang] += len(i)
                if pairs[lang] > AT_ONCE:
                    yield out(lang)
                    pairs[lang] = 0
    for lang in list(held):
        yield out(lang)


def share(n: Column | str, total: Column | str, kept: Column | str) -> Column:
    """1 + floor(UNIT * (n + 5) / (total + 5 * kept)) in whole numbers of any size; null where nothing is kept."""
    whole = lambda c: (F.col(c) if isinstance(c, str) else c).cast("decimal(18,0)")
    parts = [F.lit(UNIT).cast("decimal(10,0)") * (whole(n) + 5), whole(total) + 5 * whole(kept)]
    return F.when(parts[1] > 0, F.call_function("div", *parts) + 1)


def pair_divergence(terms: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, a, b, value) for each two sources a < b of a language.

    With f(x, y) the difference at the counts x and y, the sum over all terms is that of
    f(x, y) - f(x, 0) - f(0, y) + f(0, 0) over terms that both have, of f(x, 0) - f(0, 0) over each one's terms, and f(0, 0) for every kept term.
    """
    lists = terms.select("lang", F.col("cells.source").alias("sources"), F.col("cells.n").alias("counts"))
    cells = lists.where(F.size("sources") > 1).mapInArrow(tallied, "lang string, a string, b string, x long, y long, m long")
    cells = cells.groupBy("lang", "a", "b", "x", "y").agg(F.sum("m").alias("m"))
    own = terms.select("lang", F.explode("cells").alias("c")).groupBy("lang", F.col("c.source").alias("source"), F.col("c.n").alias("x")).agg(F.count("*").alias("m"))
    side = lambda s: groups.select("lang", F.col("source").alias(s), F.col("total").alias(f"n_{s}"), F.col("zero").alias(f"zero_{s}"), *(["kept"] if s == "a" else []))
    far = lambda p, q: F.abs(p - q)
    x, y = share("x", "n_a", "kept"), share("y", "n_b", "kept")
    a0, b0 = F.col("zero_a"), F.col("zero_b")
    both = cells.join(side("a"), ["lang", "a"]).join(side("b"), ["lang", "b"]).select("lang", "a", "b", (F.col("m") * (far(x, y) - far(x, b0) - far(a0, y) + far(a0, b0))).alias("value"))
    marginal = own.withColumnRenamed("source", "a").join(side("a"), ["lang", "a"]).withColumn("p", x).join(side("b"), "lang").where("a <> b")
    alone = marginal.select("lang", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), (F.col("m") * (far(F.col("p"), b0) - far(a0, b0))).alias("value"))
    base = side("a").join(side("b"), "lang").where("a < b").select("lang", "a", "b", F.coalesce(F.col("kept") * far(a0, b0), F.lit(0)).alias("value"))
    return both.unionByName(alone).unionByName(base).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def audit(df: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = 30, top: int = 50) -> DataFrame:
    """lang, source, part, item, value, rank: all other sources by divergence ("pair"), and the top terms that a source has more of than its language ("term")."""
    prepare(df.sparkSession)
    kept = materialise(side_by_side(df, text_col, lang_col, source_col, least_docs), "divergence-terms")
    terms = kept.where(F.col("term").isNotNull())
    cells = terms.select("lang", "term", F.col("n").alias("all"), F.explode("cells").alias("c")).select("lang", "term", "all", F.col("c.source").alias("source"), F.col("c.n").alias("n"))
    langs = terms.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("n").alias("lang_total"))
    named = kept.where(F.col("term").isNull()).select("lang", F.explode("cells.source").alias("source"))
    groups = named.join(cells.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left").join(langs, "lang", "left")
    none = F.lit(0).cast("long")
    groups = groups.select("lang", "source", *(F.coalesce(c, none).alias(c) for c in ("total", "kept", "lang_total")))
    groups = materialise(groups.withColumn("zero", share(none, "total", "kept")), "divergence-groups")
    pairs = pair_divergence(terms, groups)
    both = pairs.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value").unionByName(pairs.select("lang", F.col("b").alias("source"), F.col("a").alias("item"), "value"))
    more = cells.join(groups, ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), (share("n", "total", "kept") - share("all", "lang_total", "kept")).alias("value")).where("value > 0")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda rows, part: rows.withColumn("rank", F.row_number().over(order)).select("lang", "source", F.lit(part).alias("part"), "item", F.col("value").cast("long").alias("value"), "rank")
    return ranked(both, "pair").unionByName(ranked(more, "term").where(F.col("rank") <= top))


def audit_sql(least_docs: int = 30, top: int = 50) -> str:
    """The audit of documents, term by term, for another engine."""
    p = lambda n, total, kept: f"1 + ({UNIT}::HUGEINT * ({n} + 5)) // ({total} + 5 * {kept})"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
t AS (SELECT k, lang, source, term, count(*) AS n FROM (SELECT k, lang, source, unnest(terms) AS term FROM d) GROUP BY ALL),
kept AS (SELECT lang, term, CAST(sum(n) AS BIGINT) AS n_all FROM t GROUP BY ALL HAVING count(*) >= {least_docs}),
v AS (SELECT lang, count(*) AS kept, sum(n_all) AS total_all FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT g.lang, g.source, kept.term, n_all, coalesce(n, 0) AS n FROM g JOIN kept USING (lang)
  LEFT JOIN (SELECT lang, source, term, sum(n) AS n FROM t GROUP BY ALL) s ON s.lang = g.lang AND s.source = g.source AND s.term = kept.term),
total AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL),
p AS (SELECT c.*, {p("n", "total", "kept")} AS p, {p("n_all", "total_all", "kept")} AS q FROM c JOIN total USING (lang, source) JOIN v USING (lang)),
pair AS (SELECT a.lang, a.source, b.source AS item, coalesce((SELECT sum(abs(x.p - y.p)) FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term
    WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source),
term AS (SELECT lang, source, term AS item, p - q AS value FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
  FROM (SELECT *, 'pair' AS part FROM pair UNION ALL SELECT *, 'term' AS part FROM term))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INT) AS rank FROM r WHERE part = 'pair' OR rank <= {top}
"""
