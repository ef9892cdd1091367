"""Near copies against exact Jaccard similarities of all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lociform.llm import minhash, nearcopies
from tests.llm.test_operators import frame, prose


def grams(t):
    w = (t or "").lower().split()
    return {" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))}


def jaccard(a, b):
    a, b = grams(a), grams(b)
    return len(a & b) / len(a | b)


def edited(rng, text, n):
    w = text.split()
    for k in rng.sample(range(len(w)), n):
        w[k] = f"new{rng.randint(0, 10**9)}"
    return " ".join(w)


def test_stage_removes_edited_copies(spark):
    """Copies of 0.8 to 0.97 go, those under 0.8 stay."""
    rng = random.Random(21)
    bases = [prose(rng, n) for n in (60, 120, 300, 600) for _ in range(12)]
    texts, near = list(enumerate(bases)), {}
    for k, base in enumerate(bases):
        for part in (0.004, 0.01, 0.02, 0.03, 0.05, 0.08):
            other = edited(rng, base, max(1, round(len(base.split()) * part)))
            near[len(texts)] = k, jaccard(base, other)
            texts.append((len(texts), other))
    left = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, frame(spark, texts), "").collect()}
    assert set(range(len(bases))) <= left
    copies = [k for k, (_, s) in near.items() if s >= 0.8]
    assert sum(near[k][1] < 0.9 for k in copies) > 30 and sum(near[k][1] >= 0.9 for k in copies) > 30
    assert not left & set(copies)
    # what stays out of all others' reach stays
    alone = [k for k, t in texts if k not in copies and k in near and all(jaccard(t, o) < 0.8 for j, o in texts if j != k)]
    assert alone and set(alone) <= left


@pytest.mark.parametrize("chunk", [600, 2_000_000])
def test_components_against_all_pairs(spark, chunk):
    """Chains of edits: a component is all that links reach, hot components split into cells too."""
    rng = random.Random(22)
    texts = [prose(rng, 80)]
    for _ in range(25):
        texts.append(edited(rng, texts[-1], 1))
    texts += [prose(rng, rng.randint(1, 90)) for _ in range(20)] + ["One TWO", "one  two"]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if jaccard(texts[i], texts[j]) >= 0.8:
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    got = nearcopies.near_copies(frame(spark, list(enumerate(texts))), chunk=chunk).orderBy("doc_id").collect()
    assert [r.component_id for r in got] == label


def test_chain_of_a_thousand(spark):
    """Each text is 0.5 like the next: shared keys chain them into one candidate component, no two are linked."""
    rng = random.Random(25)
    lines = [prose(rng, 30) for _ in range(1001)]
    texts = [(k, lines[k] + " " + lines[k + 1]) for k in range(1000)]
    texts += [(2000, edited(rng, texts[500][1], 1)), (2001, edited(rng, texts[7][1], 1))]
    near = {2000: 500, 2001: 7}
    assert all(jaccard(dict(texts)[a], dict(texts)[b]) >= 0.8 for a, b in near.items())
    got = nearcopies.near_copies(frame(spark, texts), chunk=20_000).collect()
    assert {r.doc_id: r.component_id for r in got} == {k: near.get(k, k) for k, _ in texts}


def test_many_equal_rows(spark):
    """Rows equal in id and text are one before texts meet."""
    rng = random.Random(26)
    text = prose(rng, 80)
    rows = frame(spark, [(5, text)] * 3000 + [(7, edited(rng, text, 1)), (8, prose(rng, 80))])
    got = nearcopies.near_copies(rows).groupBy("doc_id", "component_id").count().orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == [(5, 5, 3000), (7, 5, 1), (8, 8, 1)]


def test_linked_sets_against_all_pairs():
    rng = random.Random(23)
    sets = []
    for _ in range(200):
        own = set(rng.sample(range(60), rng.randint(1, 40))) if not sets or rng.random() < 0.3 else {*rng.choice(sets).tolist(), rng.randint(0, 60)}
        sets.append(np.array(sorted(own), np.uint64))
    a, b = minhash.linked(sets, 80)
    root = list(range(200))
    for i, j in zip(a.tolist(), b.tolist()):
        root = [min(root[i], root[j]) if x in (root[i], root[j]) else x for x in root]
    want = list(range(200))
    for i in range(200):
        for j in range(i):
            x, y = set(sets[i].tolist()), set(sets[j].tolist())
            if len(x & y) >= 0.8 * len(x | y) - 1e-9:
                p, q = want[i], want[j]
                want = [min(p, q) if x in (p, q) else x for x in want]
    assert root == want


def test_deduplicate_edges(spark):
    rng = random.Random(24)
    a, b = prose(rng, 200), prose(rng, 200)
    docs = frame(spark, [(5, a), (3, a), (3, a), (7, b), (None, b), (8, None), (9, ""), (None, prose(rng, 150))])
    out = nearcopies.deduplicate(docs)
    assert out.columns == docs.columns
    assert sorted(str(r.doc_id) for r in out.collect()) == ["3", "7", "8", "None"]
    assert nearcopies.deduplicate(docs.where(F.lit(False))).count() == 0
