"""Hashed maximum-entropy language model with a class-factored softmax.

    P(token | context) = P(class | context) * P(token | class[, context])

The ``head`` most frequent training tokens form classes of ``width`` tokens, grouped by the company they
keep; all other tokens are dealt to ``RARE`` classes by a hash of their last two bytes.  The class
factor is a softmax whose scores sum weights of hashed features: the tokens 1, 2 and 3 places before
(the latter two skip features) and the pair of the last two.  In a head class a second hashed softmax
over its tokens uses the last two tokens; in a rare class a token of count c has (c + 1/2) / (sum of
the class + 1/2), so that unknown tokens keep a share and everything sums to one.

Training: counts of all training tokens by one Spark aggregation; then ``rounds`` rounds, which together
see every training document once.  In a round each task starts from the broadcast weights, makes
Adagrad steps over small batches of its documents and hands its change of each weight row to a Spark
sum, weighted by tokens.  Scoring works on numpy batches; the counts of tokens outside the ``known``
most frequent ones reach the documents by a join on the token.

Broadcast and held by the driver: the ``known`` tokens with counts, and weights of fixed size.

Edge cases: null and empty texts are one end token; repeated rows count and get a row each; without
training rows all counts are zero and the score is that of an unknown token; an empty table gives an
empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, DoubleType, LongType, StructField, StructType

from lociform.llm.common import materialise, prepare

#: No word holds a space, so this token is nothing else's.
END = b" "
HEAD, WIDTH, RARE, KNOWN, ROWS = 2048, 64, 32, 32768, 8192
CLASSES = HEAD // WIDTH + RARE
BATCH = 4096


def tokens(text: bytes | None) -> list[bytes]:
    words = (text or b"").lower().split()
    words.append(END)
    return words


def rare_class(word: bytes) -> int:
    """Of RARE classes, by the last two bytes."""
    return (word[-1] * 31 + word[-2:][0] * 17) % RARE


# ---- counts -----------------------------------------------------------------------------------


def token_counts(training: DataFrame, text_col: str) -> DataFrame:
    """(word, n) over all training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.int64())], ["word", "n"])

        for b in batches:
            for text in b.column(0).cast(pa.binary()).to_pylist():
                held.update(tokens(text))
            if len(held) > 400_000:
                yield out()
                held = Counter()
        yield out()

    return training.select(text_col).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """The most frequent tokens with their counts; the first of them are the head, in order of classes."""

    numbers: dict[bytes, int] = field(default_factory=dict)
    counts: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    #: Code of each known token: its place in the head, or HEAD plus its rare class.
    codes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int16))
    total: int = 0
    distinct: int = 0


def vocabulary(counts: DataFrame) -> Vocabulary:
    total, distinct = counts.agg(F.sum("n"), F.count("*")).first()
    top = counts.orderBy(F.desc("n"), "word").limit(KNOWN).collect()
    words = [bytes(r.word) for r in top]
    codes = np.array([k if k < HEAD else HEAD + rare_class(w) for k, w in enumerate(words)], np.int16)
    return Vocabulary({w: k for k, w in enumerate(words)}, np.array([r.n for r in top], np.int64), codes, total or 0, distinct)


def encoded(documents: DataFrame, keep: list[str], text_col: str, vocab: Vocabulary) -> DataFrame:
    """keep, codes (int16 bytes of all tokens), n_tokens, n_known and base (over known tokens), tail (the others).

    base sums log10(count + 1/2); rare_base the same over known tokens outside the head.
    """
    prepare(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast((vocab.numbers, vocab.counts, vocab.codes))
    schema = StructType([*(documents.schema[c] for c in keep), StructField("codes", BinaryType()), StructField("n_tokens", LongType()), StructField("n_known", LongType()), StructField("base", DoubleType()), StructField("rare_base", DoubleType()), StructField("tail", ArrayType(BinaryType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, counts, codes = shared.value
        logs = np.append(np.log10(counts + 0.5), 0.0)
        rare_logs = np.where(np.arange(len(logs)) < HEAD, 0.0, logs)
        extended = np.append(codes, np.int16(0))
        get = numbers.get
        missing = len(counts)
        for b in batches:
            rows = []
            for text in b.column(len(keep)).cast(pa.binary()).to_pylist():
                words = tokens(text)
                found = list(map(get, words))
                others = [w for w, k in zip(words, found) if k is None] if None in found else []
                ids = np.array([missing if k is None else k for k in found] if others else found, np.int64)
                code = extended[ids]
                if others:
                    code[ids == missing] = [HEAD + (w[-1] * 31 + w[-2:][0] * 17) % RARE for w in others]
                rows.append((code.tobytes(), len(words), len(words) - len(others), float(logs[ids].sum()), float(rare_logs[ids].sum()), others))
            data = list(zip(*rows)) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(len(keep))), *(pa.array(data[k], kind) for k, kind in enumerate((pa.binary(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.binary()))))], schema.names)

    return documents.select(*keep, F.col(text_col).alias("_text")).mapInArrow(run, schema)


# ---- model ------------------------------------------------------------------------------------

#: Multipliers of the hash of each feature: a token at a distance, or a pair.
_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F], np.uint32)
_SHIFT = np.uint32(32 - 13)
BEGIN = np.int64(HEAD + RARE)


def context_rows(codes: np.ndarray) -> np.ndarray:
    """(n, 4) rows of the class weights for each position of one text's codes."""
    padded = np.concatenate([np.full(3, BEGIN), codes]).astype(np.uint32)
    one, two, three = padded[2:-1], padded[1:-2], padded[:-3]
    pair = one * np.uint32(4099) + two
    keys = np.stack([one + np.uint32(1), two + np.uint32(1), three + np.uint32(1), pair + np.uint32(7)], axis=1)
    return ((keys * _MULTIPLIERS) >> _SHIFT).astype(np.int64)


def token_rows(codes: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """(n, 3) rows of the token weights: one for the class itself, two for it with each of the last two tokens."""
    padded = np.concatenate([np.full(2, BEGIN), codes]).astype(np.uint32)
    c = classes.astype(np.uint32)
    first = ((padded[1:-1] * np.uint32(67) + c) * _MULTIPLIERS[0]) >> _SHIFT
    second = ((padded[:-2] * np.uint32(71) + c + np.uint32(13)) * _MULTIPLIERS[1]) >> _SHIFT
    return np.stack([ROWS + c, first, second], axis=1).astype(np.int64)


@dataclass
class Weights:
    """Class weights (ROWS + 1, CLASSES), the last row the bias; token weights (ROWS + classes, WIDTH)."""

    by_class: np.ndarray
    by_token: np.ndarray

    @classmethod
    def start(cls, head_counts: np.ndarray, class_mass: np.ndarray) -> Weights:
        """Biases from counts, all else zero."""
        by_class = np.zeros((ROWS + 1, CLASSES), np.float32)
        by_class[-1] = np.log((class_mass + 0.5) / (class_mass.sum() + 0.5 * CLASSES))
        by_token = np.zeros((ROWS + HEAD // WIDTH, WIDTH), np.float32)
        by_token[ROWS:] = np.log(head_counts.reshape(-1, WIDTH) + 0.1)
        by_token[ROWS:] -= np.log(np.exp(by_token[ROWS:]).sum(axis=1, keepdims=True))
        return cls(by_class, by_token)


_ONES = {n: np.ones((n, 1), np.float32) for n in (CLASSES, WIDTH)}


def softmax(scores: np.ndarray) -> np.ndarray:
    np.clip(scores, -60, 60, out=scores)
    np.exp(scores, out=scores)
    scores /= scores @ _ONES[scores.shape[1]]
    return scores


def factors(w: Weights, codes: np.ndarray, context: np.ndarray, classes: np.ndarray, in_head: np.ndarray, inner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class and token distributions at each position (tokens only at in_head)."""
    s = np.take(w.by_class, context[:, 0], axis=0)
    for k in range(1, context.shape[1]):
        s += np.take(w.by_class, context[:, k], axis=0)
    s += w.by_class[-1]
    t = np.take(w.by_token, inner[:, 0], axis=0)
    for k in range(1, inner.shape[1]):
        t += np.take(w.by_token, inner[:, k], axis=0)
    return softmax(s), softmax(t)


def prepared(text_codes: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """codes, context rows, classes, positions in head classes and their token rows, of many texts."""
    codes = np.concatenate(text_codes).astype(np.int64)
    context = np.concatenate([context_rows(c) for c in text_codes])
    classes = np.where(codes < HEAD, codes // WIDTH, codes - HEAD + HEAD // WIDTH)
    own = np.concatenate([token_rows(c, np.where(c < HEAD, c // WIDTH, 0)) for c in text_codes])
    in_head = np.flatnonzero(codes < HEAD)
    return codes, context, classes, in_head, own[in_head]


def summed_by(rows: np.ndarray, gradient: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of rows (n, k) and for each the sum of its positions' gradients (n, width)."""
    flat = rows.astype(np.int16).ravel(order="F")
    at = np.argsort(flat, kind="stable")
    which = flat[at]
    at %= len(rows)
    starts = np.flatnonzero(np.concatenate([[True], which[1:] != which[:-1]]))
    ends = np.append(starts[1:], len(which))
    sums = np.take(gradient, at[starts], axis=0)
    # the second positions of all rows together, then the third ones; what is longer is summed row by row
    live = np.flatnonzero(ends - starts > 1)
    for k in range(1, 16):
        if not len(live):
            break
        sums[live] += np.take(gradient, at[starts[live] + k], axis=0)
        live = live[ends[live] - starts[live] > k + 1]
    for j in live.tolist():
        sums[j] += np.take(gradient, at[starts[j] + 16 : ends[j]], axis=0).sum(axis=0)
    return which[starts].astype(np.int64), sums


def add_rows(total: np.ndarray, squares: np.ndarray, rows: np.ndarray, gradient: np.ndarray, rate: float) -> None:
    """An Adagrad step of the weight rows that rows (n, k) name, each by the sum of its positions' gradients."""
    which, sums = summed_by(rows, gradient)
    squares[which] += np.einsum("ij,ij->i", sums, sums) / sums.shape[1]
    total[which] -= rate * sums / np.sqrt(squares[which] + 1.0)[:, None]


def train_task(w: Weights, texts: Iterator[np.ndarray], rate: float = 0.3) -> int:
    """Adagrad steps over batches of texts, in place; the number of tokens seen."""
    sq_class, sq_token = np.zeros(len(w.by_class), np.float32), np.zeros(len(w.by_token), np.float32)
    seen, held, n = 0, [], 0

    def step(group: list[np.ndarray]) -> None:
        codes, context, classes, in_head, inner = prepared(group)
        for lo in range(0, len(codes), BATCH):
            part = slice(lo, lo + BATCH)
            a, b = np.searchsorted(in_head, [lo, lo + BATCH])
            p, q = factors(w, codes[part], context[part], classes[part], in_head[a:b], inner[a:b])
            p[np.arange(len(p)), classes[part]] -= 1
            q[np.arange(len(q)), codes[in_head[a:b]] % WIDTH] -= 1
            add_rows(w.by_class, sq_class, context[part], p, rate)
            if len(q):
                add_rows(w.by_token, sq_token, inner[a:b], q, rate)

    for codes in texts:
        held.append(codes)
        n += len(codes)
        if n >= BATCH:
            step(held)
            seen, held, n = seen + n, [], 0
    if held:
        step(held)
    return seen + n


def trained(start: Weights, training: DataFrame, place: np.ndarray, rounds: int) -> Weights:
    """Rounds of local steps, each over the documents of one residue of a hash of their codes."""
    spark = training.sparkSession
    now = start
    for k in range(rounds):
        shared = spark.sparkContext.broadcast((now.by_class, now.by_token))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            a, b = shared.value
            w = Weights(a.copy(), b.copy())
            texts = (place[np.frombuffer(t, np.int16)] for batch in batches for t in batch.column(0).to_pylist())
            n = train_task(w, texts)
            if n:
                for table, change in ((0, w.by_class - a), (1, w.by_token - b)):
                    rows = np.flatnonzero(change.any(axis=1))
                    flat = pa.array((change[rows] * n).astype(np.float32).ravel())
                    width = change.shape[1]
                    lists = pa.ListArray.from_arrays(np.arange(0, (len(rows) + 1) * width, width, dtype=np.int32), flat)
                    yield pa.RecordBatch.from_arrays([pa.array(rows * 2 + table), lists, pa.array(np.full(len(rows), n))], ["row", "change", "n"])

        changes = training.where(F.pmod(F.xxhash64("codes"), F.lit(rounds)) == k).select("codes").mapInArrow(run, "row long, change array<float>, n long")
        # every row's change is divided by the tokens of the tasks that changed it
        sums = changes.groupBy("row").agg(F.sum("n").alias("n"), *(F.sum(F.get("change", F.lit(j)).cast("double")).alias(f"c{j}") for j in range(WIDTH)))
        got = sums.toArrow()
        if got.num_rows:
            row = got.column("row").to_numpy()
            change = np.stack([got.column(f"c{j}").to_numpy() for j in range(WIDTH)], axis=1) / got.column("n").to_numpy()[:, None]
            now = Weights(now.by_class.copy(), now.by_token.copy())
            for table, target in ((0, now.by_class), (1, now.by_token)):
                mine = row % 2 == table
                target[row[mine] // 2] += change[mine].astype(np.float32)
        shared.unpersist()
    return now


# ---- classes ----------------------------------------------------------------------------------


def company(training: DataFrame, columns: int = 256) -> np.ndarray:
    """How often each code stands right after each of the most frequent codes: (HEAD + RARE, columns)."""
    size = HEAD + RARE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size * columns, np.int64)
        for b in batches:
            for t in b.column(0).to_pylist():
                c = np.frombuffer(t, np.int16).astype(np.int64)
                after = np.flatnonzero(c[:-1] < columns)
                np.add.at(total, c[after + 1] * columns + c[after], 1)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["cell", "n"])

    out = np.zeros(size * columns)
    got = training.select("codes").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out[got.column("cell").to_numpy()] = got.column("n").to_numpy()
    return out.reshape(size, columns)


def grouped(counts: np.ndarray, groups: int = 8, rounds: int = 20) -> np.ndarray:
    """An order of the head tokens: by group of like company (k-means of direction), then by count."""
    head = np.sqrt(counts[:HEAD])
    x = head / np.maximum(np.linalg.norm(head, axis=1, keepdims=True), 1e-9)
    centres = [x[0]]
    for _ in range(groups - 1):
        centres.append(x[int(np.argmin(np.max(x @ np.array(centres).T, axis=1) + 1e3 * (head.sum(axis=1) == 0)))])
    c = np.array(centres)
    for _ in range(rounds):
        which = (x @ c.T).argmax(axis=1)
        c = np.array([x[which == g].sum(axis=0) if (which == g).any() else c[g] for g in range(groups)])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
    return np.lexsort((np.arange(HEAD), which))


def places(order: np.ndarray) -> np.ndarray:
    """The model's code for each code by frequency: head tokens by their place in order, rare classes as they are."""
    place = np.arange(HEAD + RARE, dtype=np.int16)
    place[order] = np.arange(HEAD, dtype=np.int16)
    return place


# ---- the operator -----------------------------------------------------------------------------


def model_scores(df: DataFrame, keep: list[str], w: Weights, place: np.ndarray, class_norm: np.ndarray) -> DataFrame:
    """keep and model: log10 probability of each text, less the log10(count + 1/2) of its rare tokens.

    class_norm: log10 of each rare class's denominator.
    """
    shared = df.sparkSession.sparkContext.broadcast((w.by_class, w.by_token, class_norm))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b_, norm = shared.value
        own = Weights(a, b_)
        norms = np.concatenate([np.zeros(HEAD // WIDTH), norm])
        for b in batches:
            texts = [place[np.frombuffer(t, np.int16)] for t in b.column(len(keep)).to_pylist()]
            sums = np.zeros(len(texts))
            at, k = 0, 0
            while at < len(texts):
                # some thousand tokens at a time
                n, k = 0, at
                while k < len(texts) and n < 4 * BATCH:
                    n += len(texts[k])
                    k += 1
                codes, context, classes, in_head, inner = prepared(texts[at:k])
                logs = np.empty(len(codes))
                for lo in range(0, len(codes), BATCH):
                    part = slice(lo, lo + BATCH)
                    x, y = np.searchsorted(in_head, [lo, lo + BATCH])
                    p, q = factors(own, codes[part], context[part], classes[part], in_head[x:y], inner[x:y])
                    logs[part] = np.log10(np.maximum(p[np.arange(len(p)), classes[part]], 1e-30)) - norms[classes[part]]
                    if y > x:
                        logs[in_head[x:y]] += np.log10(np.maximum(q[np.arange(len(q)), codes[in_head[x:y]] % WIDTH], 1e-30))
                ends = np.cumsum([len(t) for t in texts[at:k]])
                sums[at:k] = np.add.reduceat(logs, np.concatenate([[0], ends[:-1]]))
                at = k
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(len(keep))), pa.array(sums)], [*keep, "model"])

    schema = StructType([*(df.schema[c] for c in keep), StructField("model", DoubleType())])
    return df.select(*keep, "codes").mapInArrow(run, schema)


def score(documents: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", rounds: int = 3) -> DataFrame:
    """id_col, held_out, n_tokens, n_known, train_tokens, base_score and score of each row; rows not held out train."""
    spark = documents.sparkSession
    prepare(spark)
    rows = documents.select(F.col(id_col).alias("id"), F.coalesce(held_out, F.lit(False)).cast(BooleanType()).alias("held_out"), F.col(text_col).alias("text"))
    counts = materialise(token_counts(rows.where(~F.col("held_out")), "text"), "lm-counts")
    vocab = vocabulary(counts)
    raw = encoded(rows, ["id", "held_out"], "text", vocab)
    # a key of our own carries tail counts back to repeated ids
    coded = materialise(raw.withColumn("row", F.monotonically_increasing_id()), "lm-codes")
    order = grouped(company(coded.where(~F.col("held_out"))))
    place = places(order)
    head = np.zeros(HEAD, np.int64)
    head[: min(HEAD, len(vocab.counts))] = vocab.counts[:HEAD]
    head = head[order]
    rare = np.zeros(RARE + 1)
    known_rare = np.zeros(RARE)
    # the mass of rare classes, with 1/2 for each of their tokens
    last, before = F.conv(F.hex(F.substring("word", -1, 1)), 16, 10).cast("int"), F.conv(F.hex(F.substring(F.substring("word", -2, 2), 1, 1)), 16, 10).cast("int")
    masses = counts.groupBy(((last * 31 + before * 17) % RARE).alias("c")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()
    rare_tokens = np.zeros(RARE)
    for r in masses:
        rare[r.c], rare_tokens[r.c] = r.n, r.v
    for word, k in vocab.numbers.items():
        if k < HEAD:
            known_rare[rare_class(word)] += vocab.counts[k]
            rare_tokens[rare_class(word)] -= 1
    mass = rare[:RARE] - known_rare
    class_norm = np.log10(mass + 0.5 * rare_tokens + 0.5)
    start = Weights.start(head, np.concatenate([head.reshape(-1, WIDTH).sum(axis=1), mass]))
    w = trained(start, coded.where(~F.col("held_out")), place, rounds)

    # counts of the tokens outside the known ones
    tail = coded.select("row", F.explode("tail").alias("word"))
    unknown = counts.join(F.broadcast(counts.orderBy(F.desc("n"), "word").limit(KNOWN).select("word")), "word", "left_anti")
    added = tail.join(unknown, "word").groupBy("row").agg(F.sum(F.log10(F.col("n") + 0.5) - math.log10(0.5)).alias("more"), F.count("*").alias("seen"))
    scored = model_scores(coded, ["id", "held_out", "row", "n_tokens", "n_known", "base", "rare_base"], w, place, class_norm)
    out = scored.join(added, "row", "left")
    missing = F.col("n_tokens") - F.col("n_known")
    more = F.coalesce("more", F.lit(0.0)) + missing * F.lit(math.log10(0.5))
    norm = math.log10(vocab.total + 0.5 * (vocab.distinct + 1))
    return out.select(
        F.col("id").alias(id_col), "held_out", "n_tokens", (F.col("n_known") + F.coalesce("seen", F.lit(0))).alias("n_known"), F.lit(vocab.total).cast("long").alias("train_tokens"),
        (F.col("base") + more - F.col("n_tokens") * F.lit(norm)).alias("base_score"), (F.col("model") + F.col("rare_base") + more).alias("score"),
    )

