r"""Personal data by weak supervision: labelers vote on candidate spans, EM weighs the labelers.

Candidates are the matches of strict patterns (base spans: e-mail, IP, card, phone) and of wider ones
(spelled-out e-mail, IPv6, cards and phone numbers that a longer run of digits hides from the strict
patterns, 15-digit or dotted cards, national phone numbers) that overlap no base span.
Five labelers vote 1, -1 or 0 on each: pattern, checksum or shape, gazetteer (top-level domains, address
ranges, issuer prefixes, dialling codes), words of the context, and the characters at the borders.
Expectation-maximisation over the counts of vote patterns estimates each labeler's reliability; its
posteriors are the soft targets of a logistic span classifier over votes, kind and separators.  Base
spans always stay; a wider candidate stays where the classifier says so.

Everything that touches rows is DataFrame functions.  What the driver sees are the counts of distinct
(kind, votes, separator) patterns, at most 4 * 3**5 * 2 rows whatever the corpus.  Within a text no
step compares hits with hits: offsets and overlaps come from running sums and maxima.

Offsets are code points, end exclusive.  Edge cases: null and empty texts have no spans; repeated rows
each get a row; without candidates the classifier rejects nothing and finds nothing; an empty table
gives an empty result; other columns may have any name.  Repetitions in patterns are possessive, so that very long runs neither recurse
nor backtrack.
"""

from __future__ import annotations

import math
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociform.llm.common import between, materialise, running, utf32

KINDS = ("email", "ip", "card", "phone")
#: The strict patterns, leftmost matches without overlap.  \G and the lookbehinds only
#: save attempts inside a run whose start has failed.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Wider patterns.
WIDE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?: ?\(at\) ?| ?\[at\] ?| at )[A-Za-z0-9-]++(?:(?: ?\(dot\) ?| ?\[dot\] ?| dot )[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Za-z:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}(?![0-9A-Za-z:])",
    "card": r"(?<![0-9])[0-9]{16}(?![0-9])|(?<![0-9.])[0-9]{4}(?:\.[0-9]{4}){3}(?![0-9.])|(?<![0-9])3[47][0-9]{2}[ -]?[0-9]{6}[ -]?[0-9]{5}(?![0-9])",
    "phone": r"(?<![0-9A-Za-z+(])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z-])",
}
#: Gazetteers.
TLDS = "com org net edu gov mil int info biz io dev app de fr es uk us eu ch at it nl be pl pt se no dk fi ie ca au nz jp cn in br mx ru".split()
DIAL_CODES = r"\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|2[1-69][0-9]|3[578][0-9]|42[0-9]|5[09][0-9]|6[789][0-9]|8[05789][0-9]|9[679][0-9])"
#: Words before a span that speak for or against it.
FOR = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|write|reach|kontakt|courriel|correo)\b",
    "ip": r"(?i)\b(?:ip|host|server|address|client|login|adresse)\b",
    "card": r"(?i)\b(?:card|visa|mastercard|amex|credit|payment|karte|carte|tarjeta)\b",
    "phone": r"(?i)\b(?:phone|tel|telephone|call|mobile|cell|fax|telefon|llame)\b",
}
AGAINST = r"(?i)\b(?:version|release|isbn|issn|doi|token|password|hash|serial|order|invoice|build|section|chapter)\b"
LABELERS = ("v_pattern", "v_shape", "v_gazetteer", "v_context", "v_border")
#: Texts without any of these have no candidates.
WORTH_A_LOOK = r"[0-9@]|\(dot\)|\[dot\]| dot |(?:[A-Fa-f]{1,4}:){7}"


def located(df: DataFrame, patterns: dict[str, str], text: str = "text") -> DataFrame:
    """df with a column for each pattern: (start, end, hit, 24 characters before, 1 after) of each of its hits in the text."""
    df = df.withColumns({f"{n}_p": F.split(text, rx, -1) for n, rx in patterns.items()} | {f"{n}_h": F.regexp_extract_all(text, F.lit(rx), F.lit(0)) for n, rx in patterns.items()})
    df = running(df, {n: F.zip_with(F.slice(f"{n}_p", F.lit(1), F.size(f"{n}_h")), f"{n}_h", lambda p, h: F.length(p) + F.length(h)) for n in patterns})

    def one(x: Column) -> Column:
        start = (x["at"] + F.length(x["p"])).cast("int")
        return F.struct(start.alias("start"), (start + F.length(x["h"])).cast("int").alias("end"), x["h"].alias("hit"), F.right(x["p"], F.lit(24)).alias("before"), F.left(x["n"], F.lit(1)).alias("after"))

    def rows(n: str) -> Column:
        pieces, hits = F.col(f"{n}_p"), F.col(f"{n}_h")
        return F.arrays_zip(F.slice(pieces, F.lit(1), F.size(hits)).alias("p"), hits.alias("h"), F.slice(pieces, F.lit(2), F.size(hits)).alias("n"), F.col(n).alias("at"))

    return df.withColumns({n: F.transform(rows(n), one) for n in patterns}).drop(*(f"{n}_{x}" for n in patterns for x in "ph"))


def apart(df: DataFrame) -> DataFrame:
    """df with wide left with those spans that overlap none in strict; both by start, seen from either side."""
    marked = lambda spans, base: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(base).alias("base"), s.alias("span")))
    both = F.when((F.size("strict") > 0) & (F.size("wide") > 0), F.array_sort(F.concat(marked(F.col("strict"), True), marked(F.col("wide"), False))))
    df = df.withColumn("both", both)
    none = F.lit(-1)
    df = running(df, {"ends": F.transform("both", lambda x: F.when(x["base"], x["end"]).otherwise(none)), "starts": F.transform(F.reverse("both"), lambda x: F.when(x["base"], -x["start"]).otherwise(-2147483647))}, greatest=True)
    rows = F.arrays_zip(F.col("both").alias("x"), F.col("ends").alias("end"), F.reverse("starts").alias("start"))
    free = F.filter(rows, lambda r: ~r["x"]["base"] & (r["end"] <= r["x"]["start"]) & (-r["start"] >= r["x"]["end"]))
    return df.withColumn("wide", F.when(F.col("both").isNull(), F.col("wide")).otherwise(F.transform(free, lambda r: r["x"]["span"]))).drop("both", "ends", "starts")


def digits(x: Column) -> Column:
    return F.regexp_replace(x["hit"], "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check; only asked of bounded lengths."""

    def step(acc: Column, k: Column) -> Column:
        d = F.substr(number, -k, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return acc + F.when(k % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(number), F.lit(1))), F.lit(0), step) % 10 == 0


def small_parts(x: Column) -> Column:
    """All parts of a dotted address are at most 255, leading zeros aside."""
    part = lambda p: F.regexp_replace(p, "^0+(?=.)", "")
    return F.forall(F.split(x["hit"], r"\."), lambda p: (F.length(part(p)) <= 3) & (F.left(part(p), F.lit(3)).cast("int") <= 255))


def valid(kind: str, x: Column) -> Column:
    """What a strict match must pass besides its pattern."""
    n = F.length(digits(x))
    if kind == "ip":
        return small_parts(x)
    if kind == "card":
        return F.when(n.between(16, 19), luhn(digits(x))).otherwise(False)
    return n.between(8, 15) if kind == "phone" else F.lit(True)


def vote(good: Column, bad: Column | None = None) -> Column:
    return F.when(good, 1).when(~good if bad is None else bad, -1).otherwise(0)


def votes(kind: str, x: Column, strict: bool) -> list[Column]:
    """The labelers' votes on one located hit."""
    d = digits(x)
    n = F.length(d)
    last = F.lower(F.regexp_extract(x["hit"], r"([A-Za-z0-9-]+)$", 1))
    if kind == "email":
        shape, known = vote(last.rlike(r"^[a-z]{2,}$")), vote(last.isin(TLDS))
    elif kind == "ip":
        shape = vote(small_parts(x)) if strict else F.lit(1)
        known = vote(~x["hit"].rlike(r"^(?:0+\.|127\.|2(?:2[4-9]|[3-5][0-9])\.)"))
    elif kind == "card":
        shape = F.when(n.between(13, 19), vote(luhn(d))).otherwise(-1)
        known = vote(d.rlike("^(?:4|5[1-5]|2[2-7]|3[47]|6)"))
    else:
        shape = vote(n.between(10, 15))
        known = vote(x["hit"].rlike(f"^{DIAL_CODES}")) if strict else vote(d.rlike("^[2-9]"))
    context = vote(x["before"].rlike(FOR[kind]), x["before"].rlike(AGAINST))
    border = vote(~(x["before"].rlike(r"[\p{L}\p{N}=_/#-]$") | x["after"].rlike(r"^[\p{L}\p{N}_/@]")))
    return [F.lit(1 if strict else 0), shape, known, context, border]


def candidates(df: DataFrame, text: Column, keep: Column) -> DataFrame:
    """(row, spans): keep, and an array of (kind, start, end, base, the votes, sep), by kind, base first."""
    df = df.select(keep.alias("row"), F.when(text.rlike(WORTH_A_LOOK), text).otherwise("").alias("text"))
    df = located(df, {f"b_{k}": BASE[k] for k in KINDS} | {f"w_{k}": WIDE[k] for k in KINDS}).drop("text")

    def spans(strict: bool, k: str, x: Column) -> Column:
        sep = x["hit"].rlike("[ ().-]").cast("int")
        return F.struct(F.lit(KINDS.index(k)).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), F.lit(strict).alias("base"), *(v.alias(name) for v, name in zip(votes(k, x, strict), LABELERS)), sep.alias("sep"))

    def possible(k: str, x: Column) -> Column:
        return F.when(F.length(digits(x)).between(13, 19), luhn(digits(x))).otherwise(False) if k == "card" else F.lit(True)

    # one-argument functions: a second one would get the position
    strict = F.concat(*(F.transform(F.filter(f"b_{k}", partial(valid, k)), partial(spans, True, k)) for k in KINDS))
    wide = F.concat(*(F.transform(F.filter(f"w_{k}", partial(possible, k)), partial(spans, False, k)) for k in KINDS))
    return apart(df.select("row", strict.alias("strict"), wide.alias("wide"))).select("row", F.concat("strict", "wide").alias("spans"))


# ---- weak supervision -------------------------------------------------------------------------


def posteriors(rows: list[tuple], rounds: int = 50) -> tuple[list[float], dict]:
    """EM over (kind, votes..., n): the posterior of each row, and reliabilities {(labeler, kind): P(vote = 1 | real)}.

    Labelers are independent given whether a span is real; each has a vote distribution per kind and
    class, smoothed towards honest votes.
    """
    p = [1 / (1 + math.exp(-sum(r[1:6]))) for r in rows]
    table: dict = {}
    for _ in range(rounds):
        table, prior, weight = {}, {}, {}
        for r, q in zip(rows, p):
            for y, w in ((1, q * r[6]), (0, (1 - q) * r[6])):
                prior[r[0], y] = prior.get((r[0], y), 1.0) + w
                for k, v in enumerate(r[1:6]):
                    weight[r[0], k, y, v] = weight.get((r[0], k, y, v), 0.0) + w
        for kind in {r[0] for r in rows}:
            for k in range(5):
                for y in (0, 1):
                    start = {v: 3.0 if v == (1 if y else -1) else 1.0 for v in (-1, 0, 1)}
                    total = sum(start.values()) + sum(weight.get((kind, k, y, v), 0.0) for v in (-1, 0, 1))
                    for v in (-1, 0, 1):
                        table[kind, k, y, v] = (start[v] + weight.get((kind, k, y, v), 0.0)) / total
        p = []
        for r in rows:
            log = [math.log(prior[r[0], y] / (prior[r[0], 0] + prior[r[0], 1])) + sum(math.log(table[r[0], k, y, v]) for k, v in enumerate(r[1:6])) for y in (0, 1)]
            p.append(1 / (1 + math.exp(min(700.0, max(-700.0, log[0] - log[1])))))
    return p, {(LABELERS[k], KINDS[kind]): t for (kind, k, y, v), t in table.items() if y == 1 and v == 1}


def features(kind: int, votes: tuple[int, ...], sep: int) -> list[float]:
    return [1.0, *(float(kind == k) for k in range(1, 4)), *map(float, votes), float(sep)]


def span_classifier(rows: list[tuple], targets: list[float], rounds: int = 150, ridge: float = 1e-3) -> list[float]:
    """Logistic weights over features of (kind, votes..., n, sep) rows with soft targets, by gradient descent."""
    w = [0.0] * len(features(0, (0,) * 5, 0))
    x = [features(r[0], r[1:6], r[7]) for r in rows]
    total = sum(r[6] for r in rows)
    for _ in range(rounds if total else 0):
        slope = [ridge * c for c in w]
        for r, f, t in zip(rows, x, targets):
            z = sum(a * b for a, b in zip(w, f))
            e = (1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - t) * r[6] / total
            for k, c in enumerate(f):
                slope[k] += e * c
        w = [a - 0.8 * s for a, s in zip(w, slope)]
    return w


def train(found: DataFrame) -> list[float]:
    """Weights of the span classifier, from the vote patterns of all spans in column spans."""
    flat = found.select(F.explode("spans").alias("s")).groupBy(*(F.col(f"s.{c}").alias(c) for c in ("kind", *LABELERS, "sep"))).agg(F.count("*").alias("n"))
    got = sorted((r.kind, *(r[c] for c in LABELERS), r.n, r.sep) for r in flat.collect())
    return span_classifier(got, posteriors(got)[0])


def accepted(weights: list[float], s: Column) -> Column:
    """Whether a span stays: base spans always do."""
    z = F.lit(weights[0])
    for k in range(1, 4):
        z = z + F.when(s["kind"] == k, weights[k]).otherwise(0.0)
    for k, name in enumerate(LABELERS):
        z = z + s[name] * F.lit(weights[4 + k])
    return s["base"] | (z + s["sep"] * F.lit(weights[9]) >= 0)


def ordered(spans: Column) -> Column:
    """Distinct (kind, start, end), sorted in that order."""
    return F.array_sort(F.array_distinct(F.transform(spans, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def detect(df: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns in keep with base (array of strict spans) and spans (all), both as (kind, start, end)."""
    found = materialise(candidates(df, F.col(text_col), F.struct(*keep)), "pii")
    weights = train(found)
    return found.select("row.*", ordered(F.filter("spans", lambda s: s["base"])).alias("base"), ordered(F.filter("spans", lambda s: accepted(weights, s))).alias("spans"))


def redact(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with every span in the text replaced by its kind in angle brackets; null texts stay null.

    Two passes over the texts: one trains, one writes.  Overlapping spans become one, of the first kind.
    """
    weights = train(materialise(candidates(df, F.col(text_col), F.lit(0)).select("spans"), "pii"))
    names = F.array(*(F.lit(f"<{k.upper()}>") for k in KINDS))
    found = candidates(df, F.col(text_col), F.struct("*"))
    by_start = F.array_sort(F.transform(F.filter("spans", lambda s: accepted(weights, s)), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    # a span that starts before the end of those before it is part of them
    found = running(found.select("row", by_start.alias("spans")), {"ends": F.transform("spans", lambda s: s["end"])}, greatest=True)
    merged = F.filter(F.arrays_zip(F.col("spans").alias("s"), F.transform("ends", lambda e: F.greatest(e, F.lit(0))).cast("array<int>").alias("from")), lambda x: x["s"]["start"] >= x["from"])
    text = F.col("row").getField(text_col)
    found = found.select("row", merged.alias("pieces"), F.array_max(F.transform("spans", lambda s: s["end"])).alias("last"), F.when(F.size("spans") > 0, utf32(text)).alias("whole"))
    parts = F.transform("pieces", lambda x: F.concat(between(F.col("whole"), x["from"], x["s"]["start"]), F.get(names, x["s"]["kind"])))
    clean = F.when(F.size("pieces") > 0, F.concat(F.array_join(parts, ""), between(F.col("whole"), F.col("last"), F.length(text)))).otherwise(text)
    return found.select(*((clean if c == text_col else F.col("row").getField(c)).alias(c) for c in df.columns))
