"""Operators against plain recomputation, many hits in one text, and columns that have the names operators use inside."""

import math
import random
from collections import Counter

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

import corpus_pipeline
from lociform.llm import chat, common, compression, licenses, maxent, mixing, pii, rules, simhash, toxicity
from tests.llm.test_operators import EDGES, corpus, frame, labelled, prose, words

CLASHES = ("_text", "_key", "_found", "_spans", "_quality", "_built", "_strict", "row", "key", "spans", "size", "copies", "target", "quality_score", "component_id", "label")


def clashing(df):
    for c in CLASHES:
        df = df.withColumn(c, F.lit(f"own {c}"))
    return df


def test_running_sums(spark):
    rng = random.Random(1)
    lists = [[rng.randint(-5, 9) for _ in range(n)] for n in (0, 1, 2, 255, 256, 257, 1000)]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(lists)], "k int, x array<int>")
    sums = {r.k: r.s for r in common.running(df, {"s": F.col("x")}).collect()}
    tops = {r.k: r.s for r in common.running(df, {"s": F.col("x")}, greatest=True).collect()}
    for k, x in enumerate(lists):
        assert sums[k] == [sum(x[:i]) for i in range(len(x))]
        assert tops[k] == [max(x[:i], default=-(1 << 62)) for i in range(len(x))]


# ---- 1 mixing


def test_mixing_sizes_and_targets(spark):
    docs = corpus(80)
    source = lambda k: None if k is None else f"s{k % 5}"
    got = mixing.mix(frame(spark, docs, source)).collect()
    sizes = {}
    for k, t in docs:
        sizes[source(k)] = sizes.get(source(k), 0) + len(words(t))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (1, 2, 3)[n % 3] for n, s in enumerate(order)}
    target, capped = {}, set()
    while True:
        free = [s for s in order if s not in capped]
        left = sum(sizes.values()) - sum(3 * sizes[s] for s in capped)
        target = {s: 3.0 * sizes[s] if s in capped else left * weight[s] / sum(weight[x] for x in free) for s in order}
        over = {s for s in free if target[s] > 3 * sizes[s]}
        if not over:
            break
        capped |= over
    assert sorted((str(r.doc_id), r["size"]) for r in got) == sorted((str(k), len(words(t))) for k, t in docs)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source])
    # rates are those of the dual's solution: of larger documents no smaller share where lambda > 0, no larger one where < 0
    for s in order:
        mine = [r for r in got if r.source == s and r["size"] > 0]
        assert sum(r.taken for r in mine) == pytest.approx(target[s], abs=max(r["size"] for r in mine))


# ---- 2 licences


def brute_licences(text):
    own = [(n, licenses.words_of(t)) for n, t in licenses.TEMPLATES]
    w, found = licenses.words_of(text or ""), []
    pairs = lambda x: set(zip(x, x[1:]))
    for name, t in own:
        for a in range(len(w)):
            part = w[a : a + len(t)]
            if len(part) > 1 and (part[0], part[1]) in pairs(t):
                both = len(pairs(part) & pairs(t))
                dice = 2 * both / (len(pairs(part)) + len(pairs(t)))
                if dice >= 0.8:
                    found.append((both + dice / 2, dice, name, a, a + len(t)))
    beaten = lambda m: any(o[2] != m[2] and o[3] < m[4] and m[3] < o[4] and (o[0] > m[0] or o[0] == m[0] and o[2] < m[2]) for o in found)
    best = {}
    for m in found:
        if not beaten(m):
            best[m[2]] = max(best.get(m[2], 0), round(m[1], 6))
    return best


def test_licences_against_brute_force(spark):
    rng = random.Random(2)
    texts = [(k, t) for k, t in enumerate(EDGES)]
    for name, t in licenses.TEMPLATES:
        w = t.split()
        edited = " ".join(x if rng.random() > 0.03 else prose(rng, 1) for x in w)
        commented = "\n".join(f" * {' '.join(w[a : a + 9])}" for a in range(0, len(w), 9))
        texts += [(len(texts) + n, x) for n, x in enumerate((f"{prose(rng, 30)} {t} {prose(rng, 30)}", f"/*\n{commented}\n */ code", edited, " ".join([t] * 3)))]
    texts += [(900, "Released under the MIT License. " * 30), (901, prose(rng, 20_000) + " licensed under cc by 4.0. " + prose(rng, 20_000)), (None, "Licensed under CC BY 4.0.")]
    texts += [texts[20], texts[20]]
    got = {(r.doc_id, r.license): r.dice for r in licenses.scan(clashing(frame(spark, texts))).collect()}
    want = {(k, n): d for k, t in texts for n, d in brute_licences(t).items()}
    assert got == want
    for k, (name, t) in enumerate(licenses.TEMPLATES):
        assert any(n == name for n in brute_licences(t)), t


# ---- 3 compression, 4 rules, 8 toxicity


def test_compressed_sizes(spark):
    docs, labels, _ = labelled(spark)
    model = compression.fit(docs, labels)
    for text in (b"", None, b"abc", prose(random.Random(3), 3000).encode()):
        sizes = []
        for content in (model.good, model.bad):
            packer = zstandard.ZstdCompressor(level=compression.LEVEL, dict_data=zstandard.ZstdCompressionDict(content), write_content_size=False, write_checksum=False)
            sizes.append(sum(len(packer.compress(text[a : a + 1024])) for a in range(0, len(text or b""), 1024)))
        want = [(sizes[1] - sizes[0]) / len(text), min(sizes) / len(text)] if text else [0, 0]
        assert model.sizes([text])[0].tolist() == pytest.approx(want)


def test_samples_are_bounded_by_rows(spark):
    docs = frame(spark, [(1, f"text {k}") for k in range(500)] + [(2, "other")])
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int")
    got = common.labelled_sample(docs, labels, "quality", 10, 4, -1).collect()
    assert sorted((r.doc_id, r.text, r.label) for r in got) == [(1, "text 0", 1), (2, "other", 0)]


def test_trees_walked_one_by_one(spark):
    docs, labels, _ = labelled(spark)
    m = rules.fit(docs, labels)
    x = np.random.default_rng(4).random((40, len(rules.FEATURES))) * 3

    def walk(row, node):
        while m.left[node] != node:
            node = int(m.left[node] if row[m.feature[node]] <= m.threshold[node] else m.right[node])
        return m.value[node]

    assert m.scores(x) == pytest.approx([1 / (1 + math.exp(-(m.start + sum(walk(row, int(r)) for r in m.roots)))) for row in x])


def test_toxicity_counts_and_ratios(spark):
    docs, labels, _ = labelled(spark, toxic=True)
    rows = [(r.text, r.label) for r in common.labelled_sample(docs, labels, "toxic", 1000).collect()]
    counts, n = toxicity.class_counts(spark.createDataFrame(rows, "text string, label int").repartition(3), toxicity.BITS)
    plain = [Counter(), Counter()]
    for text, label in rows:
        plain[label].update({int(g) for h in toxicity.grams(text) for g in h})
    assert n.tolist() == [sum(1 for _, y in rows if y == k) for k in (0, 1)]
    for k in (0, 1):
        assert {int(b): int(counts[k, b]) for b in np.flatnonzero(counts[k])} == dict(plain[k])
    r = toxicity.ratios(counts, n, 5, 5.0, 4000)
    for b in np.flatnonzero(r)[:50]:
        assert r[b] == pytest.approx(math.log((plain[1][b] + 1) / (n[1] + 2)) - math.log((plain[0][b] + 1) / (n[0] + 2)))


# ---- 5 language model


def test_language_model_scores_position_by_position():
    rng = np.random.default_rng(5)
    w = maxent.Weights(rng.normal(0, 0.3, (maxent.ROWS + 1, maxent.CLASSES)).astype(np.float32), rng.normal(0, 0.3, (maxent.ROWS + maxent.HEAD // maxent.WIDTH, maxent.WIDTH)).astype(np.float32))
    texts = [np.array([3, 2050, 70, 5, 2079, 0], np.int16), np.array([2047], np.int16)]
    codes, context, classes, in_head, inner = maxent.prepared(texts)
    p, q = maxent.factors(w, codes, context, classes, in_head, inner)
    at = 0
    for text in texts:
        for k, code in enumerate(text.tolist()):
            scores = sum(w.by_class[r].astype(float) for r in maxent.context_rows(text)[k]) + w.by_class[-1]
            own = np.exp(scores) / np.exp(scores).sum()
            kind = code // maxent.WIDTH if code < maxent.HEAD else code - maxent.HEAD + maxent.HEAD // maxent.WIDTH
            assert classes[at] == kind and p[at, kind] == pytest.approx(own[kind], rel=1e-3)
            if code < maxent.HEAD:
                inside = sum(w.by_token[r].astype(float) for r in maxent.token_rows(text, np.full(len(text), kind))[k])
                assert q[in_head.tolist().index(at), code % maxent.WIDTH] == pytest.approx((np.exp(inside) / np.exp(inside).sum())[code % maxent.WIDTH], rel=1e-3)
            at += 1


# ---- 6 personal data, 7 chat


def test_many_hits_in_one_text(spark):
    rng = random.Random(6)
    kinds = ["4539148803436467", "1.2.3.4", "a.b@c.org", "+49 30 1234567", "12 34"]
    told = [rng.choice(kinds) for _ in range(6000)]
    text = "é " + " x ".join(told) + " ﻿ (212) 555-0199 end"
    docs = clashing(frame(spark, [(1, text), (2, "server fade:dead:beef:cafe:fade:dead:beef:cafe end")]))
    got = {r.doc_id: r.spans for r in pii.detect(docs, ["doc_id"]).collect()}
    assert len(got[1]) >= sum(t != "12 34" for t in told) and (got[2][0]["start"], got[2][0]["end"]) == (7, 46)
    for s in got[1]:
        assert text[s["start"] : s["end"]] in kinds + ["(212) 555-0199"]
    clean = {r.doc_id: r for r in pii.redact(docs).collect()}
    for hit, name in zip(kinds, ("<CARD>", "<IP>", "<EMAIL>", "<PHONE>")):
        text = text.replace(hit, name)
    assert clean[1].text == text.replace("(212) 555-0199", "<PHONE>") and clean[1]["_spans"] == "own _spans" and clean[1]["_text"] == "own _text"


def test_long_and_repeated_turns(spark):
    rng = random.Random(7)
    long = prose(rng, 30_000) + " </s>"
    rows = [(1, k, ("user", "assistant")[k % 2], f"[INST] {k}") for k in range(3000)] + [(2, 0, "assistant", long), (2, 0, "assistant", long), (None, 5, "user", "x")]
    df = clashing(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).withColumn("answer", F.lit(1))
    made = chat.format_chats(chat.turn_rows(df))
    got = {r.conv_id: r for r in chat.digests(made).collect()}
    assert got[1].n_turns == 3000 and got[1].loss_chars == sum(len(f"[INST] {k}") for k in range(1, 3000, 2))
    assert got[2].n_turns == 2 and got[2].loss_chars == 2 * len(long) and got[None].loss_chars == 0


# ---- names


def test_columns_of_any_name_stay(spark, tmp_path):
    rng = random.Random(8)
    a = prose(rng, 80)
    docs = clashing(frame(spark, [(3, a), (1, a), (2, prose(rng, 60)), (None, None)]))
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, prose(rng, 20))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert sorted(str(r.doc_id) for r in simhash.deduplicate(docs).collect()) == ["1", "2", "None"]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns[: len(docs.columns)] == docs.columns, name
        for r in out.collect():
            assert all(r[c] == f"own {c}" for c in CLASHES), name
    assert out.columns[len(docs.columns) :] == ["size_", "source_size", "target_", "copies_", "taken"]


# ---- 1 mixing: rates of the dual's solution, and many equal rows


def rates_by_hand(sizes, target, most=3):
    """Copies that entropy balancing gives to each size on average: min(most, exp(lambda * size / mean))."""
    mean = sum(sizes) / len(sizes)
    low, high = -60.0, 60.0
    rate = lambda lam, s: min(most, math.exp(min(30.0, lam * s / mean)))
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if sum(rate(middle, s) * s for s in sizes) < target else (low, middle)
    return lambda s: rate(low, s)


def test_copies_follow_the_rates_of_the_dual(spark):
    rng = random.Random(51)
    docs = [(k, " ".join(["w"] * rng.choice([1, 2, 5, 9, 20, 50, 120, 300])), f"s{k % 3}") for k in range(1500)]
    df = spark.createDataFrame([(k, t, "en", s, 1) for k, t, s in docs], "doc_id long, text string, lang string, source string, n_chars int")
    got = mixing.mix(df).collect()
    off = total = 0
    for source in ("s0", "s1", "s2"):
        own = [r for r in got if r.source == source]
        rate = rates_by_hand([r["size"] for r in own], own[0].target)
        for s in {r["size"] for r in own}:
            copies = [r.copies for r in own if r["size"] == s]
            total += 1
            off += abs(sum(copies) - len(copies) * rate(s)) > 1.01
            assert max(copies) - min(copies) <= 1
    # only the smallest documents of a source take up what rounding leaves
    assert off <= 6 and total == 24


def test_many_equal_rows_are_dealt_by_count(spark, monkeypatch):
    monkeypatch.setattr(mixing, "PART", 700)
    equal = spark.range(20_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("a b c").alias("text"), F.lit("s0").alias("source"))
    other = spark.range(2000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x "), (F.col("id") % 7).cast("int")).alias("text"), F.concat(F.lit("s"), F.col("id") % 3).alias("source"))
    mixed = mixing.mix(equal.unionByName(other))
    # no task of the last step holds more than a few pieces of the equal rows
    sizes = mixed.withColumn("p", F.spark_partition_id()).groupBy("p").count().agg(F.max("count")).first()[0]
    assert sizes < 11_000
    got = Counter((r.doc_id, r.source, r["size"], r.copies) for r in mixed.collect())
    assert sum(got.values()) == 22_000 and sum(n for k, n in got.items() if k[0] is None) == 20_000
    assert len({k[3] for k in got if k[0] is None}) <= 2
    again = Counter((r.doc_id, r.source, r["size"], r.copies) for r in mixing.mix(other.unionByName(equal).repartition(5)).collect())
    assert got == again
    by = {}
    for r in mixed.groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target")).collect():
        by[r.source] = abs(r.taken - r.target) / r.target
    assert max(by.values()) < 0.01
