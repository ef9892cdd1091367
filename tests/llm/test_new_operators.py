"""Divergence of sources, hard negatives and circulant MinHash against plain loops, and their edge cases."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lociform.llm import divergence, minhash, negatives
from tests.llm.test_operators import EDGES, frame, prose, words

# ---- 11 divergence


def audit_by_hand(rows, least):
    """rows: (text, lang, source)."""
    counts, docs, out = {}, {}, []
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        counts.setdefault(lang, {}).setdefault(source, Counter()).update(terms)
        docs.setdefault(lang, Counter()).update(set(terms))
    for lang, by in counts.items():
        kept = sorted(t for t, n in docs[lang].items() if n >= least)
        all_ = sum(by.values(), Counter())
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[u] for u in kept) + 5 * len(kept)) for t in kept}  # noqa: B023, E731
        p, q = {s: share(c) for s, c in by.items()}, share(all_)
        for s in by:
            found = {"pair": [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in by if o != s], "term": [(q[t] - p[s][t], t.encode(), t) for t in kept if by[s][t] and p[s][t] > q[t]]}
            for part, items in found.items():
                for k, (value, _, item) in enumerate(sorted(items), 1):
                    if part == "pair" or k <= 50:
                        out.append((lang, s, part, item, -value, k))
    return sorted(out)


def documents(spark, rows):
    return spark.createDataFrame([(k, t, la, s, "x", 3) for k, (t, la, s) in enumerate(rows)], "doc_id long, text string, lang string, source string, term string, n int")


def test_audit_against_a_walk_over_terms(spark, monkeypatch):
    rng = random.Random(31)
    told = ["alpha", "Beta", "gamma", "étude", "naïve", "Z", "w1x2", "日本", "x" * 500] + [prose(rng, 1) for _ in range(60)]
    rows = [(" ".join(rng.choice(told[k % 5 :]) for _ in range(rng.randint(0, 40))), rng.choice(["en", "de", None, "en"]), rng.choice(["a", "b", "ß", None, "B", "one source"])) for k in range(300)]
    rows += [(t, "en", "edges") for t in EDGES] + [("nothing kept", "xx", "a"), (None, "xx", "b"), (None, "yy", None)] + [rows[0]] * 40
    want = audit_by_hand(rows, 6)
    assert {r[2] for r in want} == {"pair", "term"} and any(r[0] == "xx" and r[4] == 0 for r in want)
    got = divergence.audit(documents(spark, rows), least_docs=6)
    assert sorted(map(tuple, got.collect())) == want


def test_long_lists_are_tallied_in_slices(monkeypatch):
    monkeypatch.setattr(divergence, "AT_ONCE", 7)
    rng = random.Random(32)
    import pyarrow as pa

    rows = [("en", sorted(rng.sample("abcdefghij", rng.randint(1, 10))), None) for _ in range(30)]
    rows = [(la, s, [rng.randint(1, 3) for _ in s]) for la, s, _ in rows]
    want = Counter((la, s[i], s[j], n[i], n[j]) for la, s, n in rows for i in range(len(s)) for j in range(i + 1, len(s)))
    got = Counter()
    for b in divergence.tallied([pa.RecordBatch.from_pylist([{"lang": a, "sources": s, "counts": n} for a, s, n in rows])]):
        for r in b.to_pylist():
            got[tuple(r[c] for c in ("lang", "a", "b", "x", "y"))] += r["m"]
    assert got == want


def test_audit_of_nothing(spark):
    assert divergence.audit(documents(spark, [("x", "en", "a")]).limit(0)).count() == 0
    assert divergence.audit(documents(spark, [("x", "en", "a")])).count() == 0


# ---- 12 hard negatives


def negatives_by_hand(rows):
    """rows: (id, vector, label); ids of anchors are multiples of 10."""
    good = [(i, [math.floor(256 * x) for x in v], la) for i, v, la in rows if la is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    last = lambda i: math.inf if i is None else i
    out = []
    for i, v, la in {(i, tuple(v), la) for i, v, la in good if i is not None and i % 10 == 0}:
        mates = sorted((-dot(v, w), last(j), j) for j, w, lb in good if lb == la and j != i)[:5]
        for s, _, p in mates:
            other = sorted((-dot(v, w), last(j), j) for j, w, lb in good if lb != la and 80 * -s <= 100 * dot(v, w) <= 100 * -s)[:5]
            out += [(i, p, k, j, -s, -t) for k, (t, _, j) in enumerate(other, 1)]
    return sorted(out, key=repr)


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, la, "x", 1.0) for i, v, la in rows], "vec_id long, embedding array<float>, label int, key string, part double")


def mined(spark, rows):
    got = negatives.hard_negatives(vectors(spark, rows), F.col("vec_id") % 10 == 0)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, got.collect()), key=repr)


@pytest.mark.parametrize("size", [300, 20])
def test_negatives_against_all_pairs(spark, monkeypatch, size):
    monkeypatch.setattr(negatives, "LEAF", 4)
    rng = np.random.default_rng(33)
    centres = rng.normal(0, 0.3, (12, 6))
    rows = [(k, [float(np.float32(x)) for x in centres[k % 12] + rng.normal(0, 0.05 + 0.1 * (k % 3), 6)], int(rng.integers(0, 4))) for k in range(size)]
    rows += [(1000 + k, [0.5] * 6, k % 3) for k in range(60)]  # ties
    rows += [(10_000, None, 1), (10_010, [0.1, None, 0.2, 0.1, 0.1, 0.1], 1), (10_020, [math.nan] + [0.1] * 5, 1), (10_030, [math.inf] * 6, 0), (10_040, [0.2] * 6, None), (None, [0.5] * 6, 2)]
    rows += [(20, rows[20 % size][1], 1)] * 3 + [rows[11]] * 8 + [(10_050, [], 1), (10_060, [0.4, 0.4], 2), (10_070, [-3.0] * 6, 3), (10_080, [0.0] * 6, 0)]
    original = negatives.build
    monkeypatch.setattr(negatives, "build", lambda found, most: original(found, most, parts=16, least_rows=12))
    want = negatives_by_hand(rows)
    assert len(want) > 100
    assert mined(spark, rows) == want


def test_tree_bounds_hold_every_product():
    rng = np.random.default_rng(34)
    v = rng.integers(-300, 300, (500, 8)).astype(float)
    tree = negatives.plant(np.arange(500), rng.integers(0, 3, 500), v)
    q = rng.integers(-300, 300, (40, 8)).astype(float)
    lo, hi = negatives.bounds(q, tree.centre, tree.radius)
    for k, (a, b) in enumerate(zip(tree.start, tree.end)):
        s = q @ tree.v[a:b].T
        assert (s.min(axis=1) >= lo[:, k]).all() and (s.max(axis=1) <= hi[:, k]).all()
    assert sorted(tree.id.tolist()) == list(range(500))


def test_negatives_edges(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(0, [1.0], None)]) == []
    assert mined(spark, [(0, [1.0], 1)]) == []
    assert mined(spark, [(1, [1.0], 1), (2, [1.0], 2)]) == []
    with pytest.raises(ValueError, match="64 bits"):
        mined(spark, [(0, [1e30], 1), (1, [1e30], 1)])


# ---- 13 circulant MinHash


def grams(t):
    w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in words(t)]
    return {" ".join(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {" ".join(w)} if w else set()


def components_by_hand(texts, percent=85):
    sets = [grams(t) for _, t in texts]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    least = {}
    for (k, _), c in zip(texts, label):
        known = [x for x in (least.get(c), k) if x is not None]
        least[c] = min(known) if known else None
    return sorted(((k, len(s), least[c], k == least[c]) for (k, _), s, c in zip(texts, sets, label)), key=repr)


@pytest.mark.parametrize("chunk", [900, 250_000])
def test_near_duplicates_against_all_pairs(spark, chunk):
    rng = random.Random(35)
    texts = [(k, prose(rng, rng.randint(1, 120))) for k in range(40)]
    for k in range(90):
        base = rng.choice(texts)[1].split()
        for _ in range(rng.randint(0, max(1, len(base) // 40))):
            base[rng.randrange(len(base))] = prose(rng, 1)
        texts.append((100 + k, " ".join(base)))
    texts += [(300, "A b c d E"), (301, "a b c d e"), (302, "a b c d"), (303, "a a a a a a"), (304, "a a a a a"), (305, "É a b c d"), (306, "é a b c d")]
    texts += [(400 + k, t) for k, t in enumerate(EDGES)] + [texts[0], texts[0], (None, texts[1][1]), (None, "only here and nowhere else at all"), (None, None), (500, None)]
    got = minhash.near_duplicates(frame(spark, texts), chunk=chunk)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert sorted(map(tuple, got.collect()), key=repr) == components_by_hand(texts)


def test_signature_is_one_permutation_shifted():
    first, runs = minhash.permutations()
    rng = random.Random(36)
    own = np.unique(np.array([rng.getrandbits(64) for _ in range(50)], np.uint64))
    at = first[(own % np.uint64(minhash.PLACES)).astype(np.int64)].astype(np.int64)
    second = runs[:, 0]
    want = [min(second[(at + k) % minhash.PLACES]) for k in range(minhash.COORDINATES)]
    assert minhash.signature(own).tolist() == want
    assert sorted(second[:10].tolist()) == sorted(set(second[:10].tolist()))


def test_coordinates_agree_as_often_as_sets_do():
    rng = random.Random(37)
    shares, similar = [], []
    for _ in range(60):
        base = [rng.getrandbits(64) for _ in range(300)]
        cut = rng.randint(0, 150)
        a, b = np.unique(np.array(base, np.uint64)), np.unique(np.array(base[cut:] + [rng.getrandbits(64) for _ in range(cut)], np.uint64))
        shares.append((minhash.signature(a) == minhash.signature(b)).mean())
        similar.append(len(set(a.tolist()) & set(b.tolist())) / len(set(a.tolist()) | set(b.tolist())))
    assert abs(np.mean(shares) - np.mean(similar)) < 0.02
    assert np.abs(np.array(shares) - similar).max() < 0.25


def test_near_duplicates_of_nothing(spark):
    assert minhash.near_duplicates(frame(spark, [])).count() == 0
    assert [tuple(r) for r in minhash.near_duplicates(frame(spark, [(3, None), (4, " ")])).orderBy("doc_id").collect()] == [(3, 0, 3, True), (4, 0, 4, True)]
