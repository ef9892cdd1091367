"""Benchmark decontamination by latent semantic retrieval.

1. Document frequencies of the benchmark's words, over all documents, give the idf weights.
2. A randomised SVD of TF-IDF passages (all benchmark items and all windows of all documents) gives a
   latent space of ``rank`` dimensions.  Up to ``MOMENT_WORDS`` words, one Spark pass sums the words x words
   moments of all passages, which give the range finder's products; with more words each product runs as a
   Spark job over the passages, and only words x rank matrices come back.  The space is whitened: its
   leading directions, which all passages of a language share, count no more than others.
3. Every window of every document is projected and compared by cosine with every item; those that reach
   ``cosine`` are the candidates.  The items are the stated queries, in an index that is broadcast.  A
   benchmark of more than ``MAX_WORDS`` words is searched in blocks, an index each, one after the other, so
   that neither the driver nor a task holds more vectors than that, however large the benchmark.
4. Candidates are verified on words: the longest common subsequence of item and window must cover
   ``copied`` of the item, or ``paraphrased`` of it together with its answer, the item's last sentence,
   most of whose words must stand in the window.

Windows have the size of the items they are compared with: items go by classes of length, each with
windows of one and a half times its longest item, a quarter apart; classes of equal windows are one.  Words are
projected once, as sums over blocks of ``STEP`` words from which the windows of all classes are added up.  Before a
candidate's subsequence is computed the words that it shares with the item are counted, those of the window and then
those of the item, neither of which a subsequence exceeds; nothing that the word rule admits is lost there.  Items of under ``shortest`` words must be there in full.

Edge cases: null and empty texts match nothing; null ids of documents and items are carried through and
are each a row of their own; repeated rows each get their rows; items without words are skipped; equal
items each match; empty tables give an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import repeat
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import BinaryType, DoubleType, StructField, StructType

from lociform.llm.common import forget, materialise, prepare

#: A bound for what is broadcast: words of the items of a block together, a vector of at most RANK floats each (51 MB).
MAX_WORDS = 100_000
RANK = 128
#: Up to so many distinct words the moments of all pairs of words fit a task and the driver (134 MB).
MOMENT_WORDS = 4096
#: Words of a document's passage.
WINDOW = 48

#: Upper case to lower case, punctuation to spaces; other bytes stay.
FOLD = bytes(c + 32 if 65 <= c <= 90 else 32 if chr(c) in ".,;:!?\"'()[]{}|*#$%&<>=~" else c for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    """Lower-case words, cut at white space and punctuation."""
    return (text or b"").translate(FOLD).split()


@dataclass
class Item:
    item_id: Any
    words: np.ndarray
    answer: np.ndarray

    def __post_init__(self) -> None:
        self.known = frozenset(self.words.tolist())


@dataclass
class Index:
    """What a task needs to search: vocabulary, idf, word vectors and items."""

    ids: dict[bytes, int] = field(default_factory=dict)
    idf: np.ndarray = field(default_factory=lambda: np.zeros(1, np.float32))
    vectors: np.ndarray = field(default_factory=lambda: np.zeros((1, 1), np.float32))
    items: list[Item] = field(default_factory=list)
    item_vectors: np.ndarray = field(default_factory=lambda: np.zeros((0, 1), np.float32))
    #: numbered(documents), on which the index was fitted; not for tasks.
    told: DataFrame | None = None


def numbers(words: list[bytes], ids: dict[bytes, int]) -> np.ndarray:
    """Word numbers; 0 for words that no item has."""
    return np.fromiter(map(ids.get, words, repeat(0)), np.int32, len(words))


def answer_of(text: str) -> str:
    """The last sentence."""
    parts = [p for p in re.split(r"(?<=[.!?])\s+|\n", text) if p.strip()]
    return parts[-1] if parts else text


def common_subsequence(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, with the rows of the table as bits of one integer."""
    places: dict[int, int] = {}
    for k, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << k
    full = (1 << len(a)) - 1
    state = full
    for y in b:
        if m := places.get(y, 0):
            u = state & m
            state = ((state + u) | (state - u)) & full
    return len(a) - state.bit_count()


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[Any, str]]]:
    """(id, text) of all items, null ids last, in blocks of about MAX_WORDS words; equal items fall into one block."""
    told = benchmark.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    size = told.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    # half full on average, as blocks are dealt by a hash
    blocks = 1 if size <= MAX_WORDS else -(-2 * size // MAX_WORDS)
    order = lambda r: (r[0] is None, r[0] or 0, r[1]) if not isinstance(r[0], str) else (False, r[0], r[1])
    for k in range(blocks):
        part = told if blocks == 1 else told.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == k)
        yield sorted(map(tuple, part.collect()), key=order)


# ---- latent space -----------------------------------------------------------------------------


def number_kind(ids: dict[bytes, int]) -> type:
    """Of the word numbers in the bytes of a text."""
    return np.uint16 if len(ids) < 1 << 16 else np.int32


def numbered(documents: DataFrame, ids: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """(id, words) of each document, written once: the bytes of the numbers of all its words."""
    kind = number_kind(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            told = [numbers(words_of(t), ids).astype(kind).tobytes() for t in b.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(told, pa.binary())], ["id", "words"])

    told = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return materialise(told.mapInArrow(run, StructType([told.schema["id"], StructField("words", BinaryType())])), "lsi-words")


def frequencies(told: DataFrame, ids: dict[bytes, int]) -> tuple[np.ndarray, int]:
    """In how many documents each known word occurs, and the number of documents."""
    out, kind = np.zeros(len(ids) + 1, np.int64), number_kind(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # word 0 stands for the documents themselves
        held = np.zeros(len(ids) + 1, np.int64)
        for b in batches:
            texts = [np.frombuffer(t, kind) for t in b.column(0).to_pylist()]
            words = np.concatenate([np.zeros(0, kind), *texts]).astype(np.int64)
            found = np.unique(np.repeat(np.arange(len(texts)), [len(t) for t in texts]) * len(held) + words) % len(held)
            held += np.bincount(found[found > 0], minlength=len(held))
            held[0] += len(texts)
        used = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(held[used])], ["word", "n"])

    for r in told.select("words").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect():
        out[r.word] = r.n
    return out, int(out[0])


def windows_of(told: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The known words of many texts and the window of WINDOW words, counted through the texts, that each stands in."""
    lengths = np.array([len(w) for w in told], np.int64)
    count = -(-lengths // WINDOW)
    place = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    window = np.repeat(np.cumsum(count) - count, lengths) + place // WINDOW
    words = np.concatenate([np.zeros(0, np.int32), *told])
    return words[words > 0], window[words > 0]


def weighted(words: np.ndarray, passage: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(passage, word, TF-IDF value) of the distinct words of each passage, in order; a passage's values have norm 1."""
    key, count = np.unique(passage.astype(np.int64) * len(idf) + words, return_counts=True)
    passage, word = key // len(idf), key % len(idf)
    value = idf[word].astype(np.float64) * count
    return passage, word, value / np.sqrt(np.bincount(passage, value**2))[passage]


def add_moments(total: np.ndarray, passage: np.ndarray, word: np.ndarray, value: np.ndarray) -> None:
    """Adds the products of values of words a <= b of a passage to total, at a * n_words + b."""
    n_words = math.isqrt(len(total))
    for lag in range(len(word)):
        pair = np.flatnonzero(passage[lag:] == passage[: len(passage) - lag])
        if not len(pair):
            break
        np.add.at(total, word[pair] * n_words + word[pair + lag], value[pair] * value[pair + lag])


def moments(told: DataFrame, ids: dict[bytes, int], idf: np.ndarray, items: list[Item]) -> np.ndarray:
    """Sum over all items and all windows of all documents of value times value, for each two words: (n_words, n_words)."""
    n_words, kind = len(idf), number_kind(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_words * n_words)
        for b in batches:
            add_moments(total, *weighted(*windows_of([np.frombuffer(t, kind) for t in b.column(0).to_pylist()]), idf))
        rows = total.reshape(n_words, n_words)
        used = np.flatnonzero(rows.any(axis=1))
        for a in range(0, len(used), 256):
            some = used[a : a + 256]
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array([rows[k, k:].astype(np.float32).tobytes() for k in some], pa.binary())], ["word", "v"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for word, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                held[word] = held.get(word, 0.0) + np.frombuffer(v, np.float32).astype(np.float64)
        for word, v in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([word]), pa.array([v.astype(np.float32).tobytes()], pa.binary())], ["word", "v"])

    out = np.zeros((n_words, n_words))
    add_moments(out.ravel(), *weighted(np.concatenate([it.words for it in items]), np.repeat(np.arange(len(items)), [len(it.words) for it in items]), idf))
    for r in told.select("words").mapInArrow(run, "word long, v binary").repartition("word").mapInArrow(add, "word long, v binary").toLocalIterator():
        out[r.word, r.word :] += np.frombuffer(r.v, np.float32)
    for k in range(n_words):
        out[k:, k] = out[k, k:]
    return out


def product_of(passages: DataFrame, idf: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """The product of the passages' moments with a words x rank block, as a Spark job row by row where the rows lie.

    passages: (words array<int>, known word numbers of one passage).
    """
    n_words = len(idf)

    def product(block: np.ndarray) -> np.ndarray:
        rank = block.shape[1]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((n_words, rank))
            for b in batches:
                for row in b.column(0).to_pylist():
                    w, k = np.unique(np.array(row or [], np.int64), return_counts=True)
                    value = idf[w] * k
                    norm = np.linalg.norm(value)
                    if norm:
                        value = value / norm
                        total[w] += value[:, None] * (value @ block[w])
            used = np.flatnonzero(total.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array([total[k].tobytes() for k in used], pa.binary())], ["word", "v"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, np.ndarray] = {}
            for b in batches:
                for word, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    held[word] = held.get(word, 0.0) + np.frombuffer(v, np.float64)
            yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.int64()), pa.array([v.tobytes() for v in held.values()], pa.binary())], ["word", "v"])

        out = np.zeros((n_words, rank))
        for r in passages.mapInArrow(run, "word long, v binary").repartition("word").mapInArrow(add, "word long, v binary").collect():
            out[r.word] = np.frombuffer(r.v, np.float64)
        return out

    return product


def latent(product: Callable[[np.ndarray], np.ndarray], n_words: int, rank: int, seed: int = 1, rounds: int = 2) -> np.ndarray:
    """Word vectors (n_words, rank): leading right singular vectors of the TF-IDF passage matrix over their singular values.

    product: that of the matrix's transpose and the matrix with a words x rank block.
    """
    rng = np.random.default_rng(seed)
    basis = np.linalg.qr(rng.standard_normal((n_words, rank)))[0].astype(np.float32)
    for _ in range(rounds):
        basis = np.linalg.qr(product(basis))[0].astype(np.float32)
    # Rayleigh-Ritz: rotate to the singular directions
    inner = basis.T @ product(basis)
    values, turn = np.linalg.eigh((inner + inner.T) / 2)
    firm = values > 1e-6 * max(float(values.max()), 1e-12)
    return (basis @ (turn[:, firm] / np.sqrt(values[firm]))).astype(np.float32)


def fit(documents: DataFrame, items: list[tuple[Any, str]], id_col: str = "doc_id", text_col: str = "text", rank: int = RANK) -> Index:
    """The latent index of the items, its space that of all windows of all documents and of the items."""
    ids: dict[bytes, int] = {}
    listed = []
    for item_id, text in items:
        words = words_of(text.encode())
        if words:
            known = np.array([ids.setdefault(w, len(ids) + 1) for w in words], np.int32)
            listed.append(Item(item_id, known, numbers(words_of(answer_of(text).encode()), ids)))
    if not listed:
        return Index()
    told = numbered(documents, ids, id_col, text_col)
    df, n_docs = frequencies(told, ids)
    df[0] = n_docs
    idf = np.log((n_docs + 1) / (df + 1)).astype(np.float32) + np.float32(0.1)
    idf[0] = 0
    if len(idf) <= MOMENT_WORDS:
        product = moments(told, ids, idf, listed).__matmul__
    else:

        kind = number_kind(ids)

        def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                words, window = windows_of([np.frombuffer(t, kind) for t in b.column(0).to_pylist()])
                rows = np.split(words, np.flatnonzero(np.diff(window)) + 1)
                yield pa.RecordBatch.from_arrays([pa.array([r.tolist() for r in rows], pa.list_(pa.int32()))], ["words"])

        own_rows = documents.sparkSession.createDataFrame([(it.words.tolist(),) for it in listed], "words array<int>")
        product = product_of(materialise(own_rows.unionByName(told.select("words").mapInArrow(windows, "words array<int>")), "lsi-passages"), idf)
    vectors = latent(product, len(idf), min(rank, len(idf))) * idf[:, None]
    item_vectors = np.stack([vectors[it.words].sum(axis=0) for it in listed])
    item_vectors /= np.maximum(np.linalg.norm(item_vectors, axis=1, keepdims=True), 1e-12)
    return Index(ids, idf, vectors, listed, item_vectors, told)


# ---- search -----------------------------------------------------------------------------------


@dataclass(frozen=True)
class Rules:
    cosine: float = 0.18
    copied: float = 0.7
    paraphrased: float = 0.5
    answered: float = 0.6
    shortest: int = 8
    #: Items of a length class are within this factor of each other.
    spread: float = 1.5

    def least(self, length: int) -> float:
        """Words in order that a match of an item of this length has at least."""
        return length * (1.0 if length < self.shortest else min(self.copied, self.paraphrased)) - 1e-9


#: Words are projected in blocks of so many.
STEP = 5
#: A window is so many strides, an item of its class at most four of them.
PIECES = 6
#: Words fall into so many slots when those that item and window share are counted; the first is that of words that no item has.
SLOTS = 4096
#: Windows compared at once, and items.
AT_ONCE, ITEMS_AT_ONCE = 512, 1024


@dataclass
class LengthClass:
    """Items of about one length, with the windows they need."""

    numbers: np.ndarray
    vectors: np.ndarray
    least: np.ndarray
    #: Blocks from one window to the next.
    stride: int
    #: The slots of each item's words, filled up with the first.
    slots: np.ndarray


def slots_of(words: np.ndarray) -> np.ndarray:
    return np.where(words > 0, words % (SLOTS - 1) + 1, 0)


def length_classes(index: Index, rules: Rules) -> list[LengthClass]:
    """Items by length and so by their windows, at most ITEMS_AT_ONCE to a class."""
    lengths = np.array([len(it.words) for it in index.items], np.int64)
    which = np.floor(np.log(np.maximum(lengths, 1)) / np.log(rules.spread)).astype(int)
    # classes of one stride have the same windows
    longest = np.array([lengths[which == c].max() for c in which], np.int64)
    strides = np.maximum(1, -(-longest // (4 * STEP)))
    out = []
    for stride in np.unique(strides):
        alike = np.flatnonzero(strides == stride)
        for mine in np.split(alike, range(ITEMS_AT_ONCE, len(alike), ITEMS_AT_ONCE)):
            slots = np.zeros((len(mine), int(lengths[mine].max())), np.int64)
            for row, k in enumerate(mine):
                slots[row, : lengths[k]] = slots_of(index.items[k].words)
            least = np.array([rules.least(int(n)) for n in lengths[mine]])
            out.append(LengthClass(mine, index.item_vectors[mine], least, int(stride), slots))
    return out


@dataclass
class Blocks:
    """The words of many texts in blocks of STEP, each text from a block of its own, and the sums of their vectors."""

    words: np.ndarray
    sums: np.ndarray
    #: The slots of the words; the row after the last is zero, as it is in sums.
    slots: np.ndarray
    #: The first block of each text, and the number of blocks.
    starts: np.ndarray

    @classmethod
    def of(cls, told: list[np.ndarray], index: Index) -> Blocks:
        counts = np.array([-(-len(w) // STEP) for w in told], np.int64)
        starts = np.concatenate([[0], np.cumsum(counts)])
        words = np.zeros((int(starts[-1]), STEP), np.int32)
        flat = words.ravel()
        for w, a in zip(told, (starts * STEP).tolist()):
            flat[a : a + len(w)] = w
        # the row after the last is the zero that ends of texts are filled up with
        sums = np.zeros((len(words) + 1, index.vectors.shape[1]), np.float32)
        for a in range(0, len(words), 4096):
            part = words[a : a + 4096]
            into = sums[a : a + len(part)]
            for k in range(STEP):
                into += index.vectors[part[:, k]]
        slots = np.zeros((len(words) + 1, STEP), np.int64)
        slots[:-1] = slots_of(words)
        return cls(words, sums, slots, starts)

    def strides(self, stride: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, first block, end block) of each stride of each text, then PIECES - 1 empty ones before the next text."""
        blocks = np.diff(self.starts)
        each = -(-blocks // stride) + np.where(blocks > 0, PIECES - 1, 0)
        text = np.repeat(np.arange(len(each)), each)
        place = np.arange(len(text)) - np.repeat(np.cumsum(each) - each, each)
        end = self.starts[text + 1]
        first = np.minimum(self.starts[text] + place * stride, end)
        return text, first, np.minimum(first + stride, end)


def candidates(blocks: Blocks, c: LengthClass, rules: Rules) -> Iterator[tuple[int, int, int, int, float]]:
    """(text, first word, end word, item of the class, cosine) of the windows near an item that may have enough of its words."""
    text, first, end = blocks.strides(c.stride)
    last = len(blocks.sums) - 1
    has = np.zeros((len(c.numbers), SLOTS), bool)
    has[np.arange(len(has))[:, None], c.slots] = True
    has[:, 0] = False
    # the last PIECES - 1 strides are empty, so every window is whole
    for lo in range(0, len(text) - PIECES + 1, AT_ONCE):
        hi = min(lo + AT_ONCE + PIECES - 1, len(text))
        at, stop = first[lo:hi], end[lo:hi]
        pieces = blocks.sums[np.where(at < stop, at, last)]
        for k in range(1, c.stride):
            pieces += blocks.sums[np.where(at + k < stop, at + k, last)]
        count = len(pieces) - PIECES + 1
        # sums of two, then of six neighbours; what is left over at the end stands in no window
        pairs = pieces[:-1] + pieces[1:]
        window = pairs[:count] + pairs[2 : count + 2]
        window += pairs[4 : count + 4]
        norm = np.maximum(np.sqrt(np.einsum("ij,ij->i", window, window)), 1e-9)
        cosines = window @ c.vectors.T
        cosines /= norm[:, None]
        near, items = np.nonzero(cosines >= rules.cosine)
        for a in range(0, len(near), 4096):
            k, i = near[a : a + 4096], items[a : a + 4096]
            # the words of the window that the item has, and then of the item that the window has, bound their common
            # subsequence; slots can only add to them
            begin = first[lo + k]
            until = np.minimum(begin + PIECES * c.stride, blocks.starts[text[lo + k] + 1])
            at = begin[:, None] + np.arange(PIECES * c.stride)
            there = blocks.slots[np.where(at < until[:, None], at, last)].reshape(len(k), -1)
            there += (i * SLOTS)[:, None]
            may = np.take(has, there, mode="clip").sum(axis=1, dtype=np.int32) >= c.least[i]
            k, i = k[may], i[may]
            some, place = np.unique(k, return_inverse=True)
            begin = first[lo + some]
            until = np.minimum(begin + PIECES * c.stride, blocks.starts[text[lo + some] + 1])
            for b in range(0, len(some), 1024):
                mine = (place >= b) & (place < b + 1024)
                there = np.zeros((min(1024, len(some) - b), SLOTS), bool)
                rows = np.arange(len(there))
                for r in range(PIECES * c.stride):
                    inside = begin[b : b + 1024] + r < until[b : b + 1024]
                    there[rows[inside, None], blocks.slots[begin[b : b + 1024][inside] + r]] = True
                there[:, 0] = False
                good = np.flatnonzero(mine)[there[place[mine, None] - b, c.slots[i[mine]]].sum(axis=1) >= c.least[i[mine]]]
                for j in good:
                    w = place[j]
                    yield int(text[lo + k[j]]), int(begin[w]) * STEP, int(until[w]) * STEP, int(i[j]), float(cosines[k[j], i[j]])


def verified(item: Item, words: list[int], rules: Rules) -> float:
    """Share of the item that the longest common subsequence covers; 0 where that is no match."""
    there = item.known.intersection(words)
    answered = sum(w in there for w in item.answer.tolist()) / len(item.answer) if len(item.answer) else 1.0
    own = item.words.tolist()
    if len(own) < rules.shortest:
        share = 1.0
    else:
        share = min(rules.copied, rules.paraphrased) if answered >= rules.answered else rules.copied
    # the subsequence is no longer than the item's words that are there
    if sum(w in there for w in own) < share * len(own) - 1e-9:
        return 0.0
    covered = common_subsequence(own, words) / len(own)
    return covered if covered >= share - 1e-9 else 0.0


def search(told: list[np.ndarray], index: Index, classes: list[LengthClass], rules: Rules) -> list[tuple[int, int, float, float]]:
    """(text, item number, cosine, covered share) of the items found in many texts of numbered words, the best window of each."""
    found: dict[tuple[int, int], tuple[float, float]] = {}
    blocks = Blocks.of(told, index)
    flat = blocks.words.ravel()
    for c in classes if len(flat) else ():
        for text, first, end, i, cosine in candidates(blocks, c, rules):
            key = text, int(c.numbers[i])
            best = found.get(key, (0.0, 0.0))
            if best[1] < 1:
                covered = verified(index.items[key[1]], flat[first:end].tolist(), rules)
                if covered > best[1]:
                    found[key] = cosine, covered
    return [(*key, *x) for key, x in sorted(found.items())]


def searcher(documents: DataFrame, items: list[tuple[Any, str]], id_col: str, text_col: str, rules: Rules, rank: int):
    """A function of texts, for use inside tasks, that gives (text, item id, cosine, covered share) of what is found of the items.

    A text is its bytes or its word numbers.  Also numbered(documents), None where no item has words.
    """
    prepare(documents.sparkSession)
    index = fit(documents, items, id_col, text_col, rank)
    # words and vectors of a block of items
    shared = documents.sparkSession.sparkContext.broadcast((index.ids, index.idf, index.vectors, [(x.item_id, x.words, x.answer) for x in index.items], index.item_vectors))
    known: list = []

    def look(texts: list[bytes | np.ndarray | None]) -> list[tuple[int, Any, float, float]]:
        if not known:
            ids, idf, vectors, listed, item_vectors = shared.value
            known.append(Index(ids, idf, vectors, [Item(*x) for x in listed], item_vectors))
            known.append(length_classes(known[0], rules))
        ids = known[0].ids
        parts = ([t if isinstance(t, np.ndarray) else numbers(words_of(t), ids) for t in texts[a : a + 64]] for a in range(0, len(texts), 64))
        hits = ((64 * n + k, *x) for n, part in enumerate(parts) for k, *x in search(part, *known, rules))
        return [(k, known[0].items[i].item_id, cosine, covered) for k, i, cosine, covered in hits]

    return look, index.told, number_kind(index.ids)


def matches(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", rules: Rules = Rules(), rank: int = RANK) -> DataFrame:
    """A row (id_col, item_col, cosine, covered) for each document and benchmark item found in it."""
    kind, item_kind = documents.schema[id_col].dataType, benchmark.schema[item_col].dataType
    schema = StructType([StructField(id_col, kind), StructField(item_col, item_kind), StructField("cosine", DoubleType()), StructField("covered", DoubleType())])
    arrow_kind = to_arrow_type(item_kind)

    def found(items: list[tuple[Any, str]]) -> DataFrame:
        look, told, number = searcher(documents, items, id_col, text_col, rules, rank)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                hits = look([np.frombuffer(t, number) for t in b.column(1).to_pylist()])
                columns = [b.column(0).take(pa.array([h[0] for h in hits], pa.int64())), pa.array([h[1] for h in hits], arrow_kind)]
                columns += [pa.array([h[k] for h in hits], pa.float64()) for k in (2, 3)]
                yield pa.RecordBatch.from_arrays(columns, schema.names)

        return documents.sparkSession.createDataFrame([], schema) if told is None else told.mapInArrow(run, schema)

    out = None
    for items in item_blocks(benchmark, item_col, item_text):
        out = found(items) if out is None else out.unionByName(found(items))
    return out


def decontaminate(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", rules: Rules = Rules(), rank: int = RANK) -> DataFrame:
    """The rows of documents in whose text no item is found, whatever their ids; no join, no shuffle."""
    at = documents.columns.index(text_col)

    def clean_of(docs: DataFrame, items: list[tuple[Any, str]]) -> DataFrame:
        # the space is fitted on all documents, whichever blocks came before
        look, told, _ = searcher(documents, items, id_col, text_col, rules, rank)
        forget(told)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                clean = np.ones(len(b), bool)
                clean[[h[0] for h in look(b.column(at).cast(pa.binary()).to_pylist())]] = False
                yield b.filter(pa.array(clean))

        return docs.mapInArrow(run, docs.schema)

    out = documents
    for items in item_blocks(benchmark, item_col, item_text):
        out = clean_of(out, items)
    return out
