"""Each operator against brute force or held-out labels, and its edge cases."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lociform.llm import chat, compression, decontamination, licenses, maxent, mixing, pii, rules, simhash, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, fp long, score double, label int, size int"
EDGES = [None, "", " \n\t", "word", "a b c d e f g h " * 400, "x" * 30_000, "naïve café déjà vu " * 3]


def prose(rng, n):
    return " ".join("".join(rng.choice("bcdfgl") + rng.choice("aeiou") for _ in range(rng.randint(1, 3))) for _ in range(n))


def frame(spark, texts, source=lambda k: f"s{(k or 0) % 3}"):
    """Documents with repeated and null ids, null sources and columns whose names operators use themselves."""
    return spark.createDataFrame([(k, t, "en", source(k), len(t or ""), "x", 1, 0.5, 1, 3) for k, t in texts], SCHEMA)


def corpus(n=60):
    rng = random.Random(3)
    texts = list(enumerate(prose(rng, rng.randint(5, 120)) for _ in range(n)))
    return texts + [(n + k, t) for k, t in enumerate(EDGES)] + [texts[0], (None, texts[1][1]), (None, None)]


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


# ---- 1 mixing


def test_mixing_meets_targets(spark):
    got = mixing.mix(frame(spark, corpus(), lambda k: None if k is None else f"s{k % 4}")).collect()
    assert len(got) == len(corpus())
    by = {}
    for r in got:
        assert r["size"] * 3 >= r.taken and r.taken == r.copies * r["size"]
        by.setdefault(r.source, []).append(r)
    total = sum(r["size"] for r in got)
    assert sum(rows[0].target for rows in by.values()) == pytest.approx(total)
    for rows in by.values():
        assert sum(r["size"] for r in rows) == rows[0].source_size
        assert rows[0].target <= 3 * rows[0].source_size + 1e-6
        assert abs(sum(r.taken for r in rows) - rows[0].target) <= max(200, 0.1 * rows[0].target)
    again = mixing.mix(frame(spark, corpus(), lambda k: None if k is None else f"s{k % 4}").repartition(3)).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))


def test_mixing_empty(spark):
    assert mixing.mix(frame(spark, [])).count() == 0


# ---- 2 licences


def test_licences(spark):
    texts = [(1, "Some text.\nLicensed under the Apache License, Version 2.0.\nMore."), (2, "released UNDER the mit license"), (3, "the license is not named"), (4, None), (5, ""), (None, "Released under the MIT License.")]
    got = {(r.doc_id, r.license) for r in licenses.scan(frame(spark, texts)).collect()}
    assert got == {(1, "Apache-2.0"), (2, "MIT"), (None, "MIT")}
    assert licenses.scan(frame(spark, [])).count() == 0


def test_telling_words_are_necessary():
    for _, text in licenses.TEMPLATES:
        own = licenses.bigrams_of(text)
        telling = licenses.telling_words(own, 0.8)
        left = [b for b in own if not telling & set(b.split())]
        assert len(left) < len(own) * 0.8 / 1.2


# ---- 3 compression, 4 rules, 8 toxicity


def labelled(spark, toxic=False):
    rng = random.Random(4)
    texts, labels = [], []
    for k in range(400):
        bad = rng.random() < 0.4
        t = prose(rng, rng.randint(25, 80))
        if bad and toxic:
            t = t.replace(" ", " scum ", 2)
        elif bad:
            t = "\n".join(["###$$ " + t[:60] + " |||"] * 5)
        texts.append((k, t))
        labels.append((k, int(not bad), int(bad)))
    labels += [(5, 1, 0), (None, 1, 0), (9, None, None)]
    return frame(spark, texts + [(1000 + k, t) for k, t in enumerate(EDGES)]), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), {k: q for k, q, _ in labels[:400]}


def test_compression_scores(spark):
    docs, labels, truth = labelled(spark)
    model = compression.fit(docs, labels)
    got = {r.doc_id: r["_q"] for r in compression.score(docs, model, docs.columns, out_col="_q").collect()}
    assert len(got) == 400 + len(EDGES) and all(0 <= s <= 1 for s in got.values())
    assert np.mean([(got[k] >= 0.5) == bool(q) for k, q in truth.items()]) > 0.9
    blank = compression.fit(docs, labels.where("doc_id < 0"))
    assert all(r.score == pytest.approx(0.5) for r in compression.score(docs, blank, ["doc_id"]).collect())
    assert compression.score(docs.limit(0), model, ["doc_id"]).count() == 0


def brute_repeats(w, width=8):
    seen, cover = {}, set()
    for k in range(len(w) - width + 1):
        seen.setdefault(tuple(w[k : k + width]), []).append(k)
    for at in seen.values():
        if len(at) > 1:
            cover.update(x for a in at for x in range(a, a + width))
    return len(cover)


def test_rules_statistics_against_brute_force():
    rng = random.Random(5)
    for t in [*EDGES, "a b\n a b\n\na b\n a b", *(" ".join(rng.choice("ab#|é") for _ in range(n)) for n in (7, 8, 9, 40, 300))]:
        w = words(t)
        lines = [x for x in (t or "").split("\n") if words(x)]
        expected = [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), brute_repeats(w)]
        assert rules.statistics(t.encode() if t is not None else None)[0] == expected


def test_rules_trees(spark):
    docs, labels, truth = labelled(spark)
    model = rules.fit(docs, labels)
    got = {r.doc_id: r for r in rules.judge(docs, model, ["doc_id"]).collect()}
    assert np.mean([got[k].kept == bool(q) for k, q in truth.items()]) > 0.95
    assert all(r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) and not (r.base_failed and r.kept) for r in got.values())
    # a monotone feature never raises the score
    x = np.tile(np.random.default_rng(0).random((50, len(rules.FEATURES))), (2, 1))
    for f, (_, sign) in enumerate(rules.FEATURES):
        if sign:
            y = x.copy()
            y[:, f] += 5
            assert (model.scores(y) <= model.scores(x) + 1e-12).all()
    assert rules.fit(docs, labels.where("doc_id < 0")) is None
    assert rules.judge(docs.limit(0), None, ["doc_id"]).count() == 0


def test_toxicity(spark):
    docs, labels, truth = labelled(spark, toxic=True)
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model, ["doc_id"]).collect()}
    assert np.mean([(got[k] >= 0.3) != bool(q) for k, q in truth.items()]) > 0.95
    blank = toxicity.fit(docs, labels.where("doc_id < 0"))
    assert all(r.score == pytest.approx(0.5) for r in toxicity.score(docs, blank, ["doc_id"]).collect())
    assert toxicity.score(docs.limit(0), model, ["doc_id"]).count() == 0


# ---- 5 language model


def test_language_model(spark):
    texts = [(k, t) for k, t in corpus(150)]
    docs = frame(spark, texts)
    held = F.col("doc_id") % 5 == 1
    got = maxent.score(docs, held).collect()
    assert len(got) == len(texts)
    count = {}
    for k, t in texts:
        if k is None or k % 5 != 1:
            for w in maxent.tokens(t.encode() if t is not None else None):
                count[w] = count.get(w, 0) + 1
    total, norm = sum(count.values()), np.log10(sum(count.values()) + 0.5 * (len(count) + 1))
    want = sorted((-1 if k is None else k, round(sum(np.log10(count.get(w, 0) + 0.5) - norm for w in maxent.tokens(t.encode() if t is not None else None)), 5)) for k, t in texts)
    assert sorted((-1 if r.doc_id is None else r.doc_id, round(r.base_score, 5)) for r in got) == want
    assert {r.train_tokens for r in got} == {total}
    assert all(r.score < 0 for r in got)


def test_language_model_sums_to_one():
    rng = np.random.default_rng(0)
    w = maxent.Weights(rng.normal(0, 0.3, (maxent.ROWS + 1, maxent.CLASSES)).astype(np.float32), rng.normal(0, 0.3, (maxent.ROWS + 32, maxent.WIDTH)).astype(np.float32))
    codes, context, classes, in_head, inner = maxent.prepared([np.array([3, 2050, 70, 5, 2079], np.int16)])
    p, q = maxent.factors(w, codes, context, classes, in_head, inner)
    assert np.allclose(p.sum(axis=1), 1, atol=1e-5) and np.allclose(q.sum(axis=1), 1, atol=1e-5)


def test_gradient_sums_against_brute_force():
    rng = np.random.default_rng(1)
    rows, g = rng.integers(0, 9, (200, 3)), rng.normal(size=(200, 4)).astype(np.float32)
    which, sums = maxent.summed_by(rows, g)
    for r, s in zip(which, sums):
        assert np.allclose(s, sum(g[i] * (rows[i] == r).sum() for i in range(200)), atol=1e-4)


# ---- 6 personal data


def brute_pii(t):
    t = t or ""

    def luhn(d):
        return sum((v := int(c)) if k % 2 == 0 else (v := int(c) * 2) - 9 * (v > 9) for k, c in enumerate(reversed(d))) % 10 == 0

    only = lambda h: re.sub("[^0-9]", "", h)
    kinds = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda h: True), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda h: all(int(p) <= 255 for p in h.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda h: 16 <= len(only(h)) <= 19 and luhn(only(h))), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda h: 8 <= len(only(h)) <= 15),
    )
    return [(k, m.start(), m.end()) for k, p, ok in kinds for m in re.finditer(p, t) if ok(m.group())]


PII_TEXTS = [
    *EDGES, "mail a.b@c.de_x@y.org and 1.2.3.4.5.6.7.8 é 300.1.1.1", "card 4539 1488 0343 6467, 4539148803436467 and 4539148803436468", "+1 (269) 555-3296 4539148803436467 end", "+49 30 1234567. +1",
    "1 " * 3000, "a@" * 500, "1." * 800, "00000000000000000001.2.3.4 x", "jane (at) example (dot) com or call (212) 555-0199", "@", "5@5.5",
]


def test_pii_base_spans_against_brute_force(spark):
    found = pii.detect(frame(spark, list(enumerate(PII_TEXTS))), ["doc_id"])
    got = {r.doc_id: r for r in found.select("doc_id", pii.listed(F.col("base")).alias("base"), pii.listed(F.col("spans")).alias("spans")).collect()}
    for k, t in enumerate(PII_TEXTS):
        base = [f"{a}:{s}:{e}" for a, s, e in brute_pii(t)]
        assert got[k].base == ",".join(base), t
        assert set(base) <= set(got[k].spans.split(",")) | {""}


def test_pii_redaction(spark):
    docs = frame(spark, [(1, "write a@b.org now"), (2, None), (3, ""), (4, "é 1.2.3.4 and a@b.org"), (None, "clean"), (4, "clean")])
    out = pii.redact(docs)
    assert out.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in out.collect()) == [(0, "clean"), (1, "write <EMAIL> now"), (2, ""), (3, ""), (4, "clean"), (4, "é <IP> and <EMAIL>")]
    assert pii.redact(docs.limit(0)).count() == 0


# ---- 7 chat


def test_chat_round_trip(spark):
    texts = ["</s>[INST] ok", "a\\lb\\e <|im_end|>\n<|im_start|>user\n", "", None, "plain\nlines", "<<SYS>> \\"]
    rows = [(c, t, ("user", "assistant", None)[t % 3], x) for c in range(3) for t, x in enumerate(texts)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("rows", F.lit(1))
    made = chat.format_chats(chat.turn_rows(df))
    got = {r.conv_id: r for r in chat.digests(made).collect()}
    whole = "".join(f"{('user', 'assistant', '')[t % 3]}\n{x or ''}\n" for t, x in enumerate(texts))
    loss = "".join(x or "" for t, x in enumerate(texts) if t % 3 == 1)
    for c in range(3):
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_sha256) == (len(texts), hashlib.sha256(whole.encode()).hexdigest(), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.digests(chat.format_chats(chat.turn_rows(df.limit(0)))).count() == 0


def test_chat_layouts(spark):
    rows = ['{"prompt":"p","response":"r"}', '{"messages":[{"role":"user","content":"u"},{"role":"assistant","content":"a"}]}', '{"instruction":"i","input":"","output":"o"}', '{"odd":1}', "not json", None]
    got = [r.t and [tuple(x) for x in r.t] for r in spark.createDataFrame([(x,) for x in rows], "r string").select(chat.canonical_turns(F.col("r")).alias("t")).collect()]
    assert got == [[("user", "p"), ("assistant", "r")], [("user", "u"), ("assistant", "a")], [("user", "i"), ("assistant", "o")], None, None, None]


# ---- 9 decontamination


def test_decontamination_finds_copies_and_paraphrases(spark):
    rng = random.Random(6)
    items = [(k, prose(rng, rng.randint(12, 40)) + ". " + prose(rng, 6) + ".") for k in range(12)] + [(90, None), (91, "")]
    shuffled = items[3][1].split()
    near = " ".join(w for k, w in enumerate(shuffled) if k % 6 != 5)
    texts = [(100 + k, f"{prose(rng, 200)}\n{t.upper() if k % 2 else t}\n{prose(rng, 150)}") for k, (_, t) in enumerate(items[:12])]
    clean = [(200 + k, prose(rng, 300)) for k in range(30)]
    docs = frame(spark, texts + clean + [(300, prose(rng, 50) + " " + near + " " + prose(rng, 50)), (None, items[0][1]), *((400 + k, t) for k, t in enumerate(EDGES))])
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.matches(docs, bench).collect()}
    assert got == {(100 + k, k) for k in range(12)} | {(300, 3), (None, 0)}
    left = {r.doc_id for r in decontamination.decontaminate(docs, bench).collect()}
    assert left == {k for k, _ in clean} | {400 + k for k in range(len(EDGES))}
    assert decontamination.matches(docs.limit(0), bench).count() == 0
    assert decontamination.matches(docs, bench.limit(0)).count() == 0


def test_common_subsequence_against_table():
    rng = random.Random(7)
    for _ in range(30):
        a, b = ([rng.randint(0, 5) for _ in range(rng.randint(0, 20))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert decontamination.common_subsequence(a, b) == t[-1][-1]


# ---- 10 simhash


def brute_simhash(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(x).encode(), 42) for x in ([w[k : k + 4] for k in range(len(w) - 3)] if len(w) >= 4 else [w])]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, prints, radius=4):
    root = list(range(len(ids)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for k, i in enumerate(ids):
        r = find(k)
        least[r] = i if least.get(r) is None else least[r] if i is None else min(least[r], i)
    return [least[find(k)] for k in range(len(ids))]


def test_simhash_against_brute_force(spark):
    rng = random.Random(8)
    texts = corpus(40)
    long = prose(rng, 400)
    texts += [(500 + k, long + " extra" * (k % 3)) for k in range(20)] + [(600, "One TWO"), (601, "one two")]
    got = simhash.near_duplicates(frame(spark, texts)).collect()
    prints = [brute_simhash(t) for _, t in texts]
    want = sorted((str(k), f"{p:016x}", str(c)) for (k, _), p, c in zip(texts, prints, brute_components([k for k, _ in texts], prints)))
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == want
    assert simhash.near_duplicates(frame(spark, [])).count() == 0


@pytest.mark.parametrize("chunk", [8, 16384])
def test_simhash_links_in_blocks(spark, chunk):
    rng = random.Random(9)
    base = [rng.getrandbits(64) for _ in range(6)]
    fps = list({b ^ sum(1 << x for x in rng.sample(range(64), rng.randint(0, 6))) for b in base for _ in range(40)})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    edges = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), 4, chunk)
    roots = {r.node: r.root for r in simhash.components(edges).collect()}
    got = [roots.get(x, x) for x in signed]
    want = brute_components(list(range(len(fps))), fps)
    assert len(set(zip(got, want))) == len(set(got)) == len(set(want))


def test_deduplicate_keeps_one_of_each(spark):
    rng = random.Random(10)
    a, b = prose(rng, 200), prose(rng, 200)
    docs = frame(spark, [(5, a), (3, a), (3, a), (7, b), (None, b), (8, None), (9, ""), (None, prose(rng, 150))])
    out = simhash.deduplicate(docs)
    assert out.columns == docs.columns
    assert sorted(str(r.doc_id) for r in out.collect()) == ["3", "7", "8", "None"]
