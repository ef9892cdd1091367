"""Paraphrases that replace content words, against an exhaustive search by the word rule."""

import random

from lociform.llm import decontamination
from tests.llm.test_operators import frame, prose


def obeys(item, window):
    """The operator's word rule on one window."""
    words = decontamination.words_of(item.encode())
    answer = decontamination.words_of(decontamination.answer_of(item).encode())
    code = {w: k for k, w in enumerate(dict.fromkeys(words + window))}
    covered = decontamination.common_subsequence([code[w] for w in words], [code[w] for w in window]) / len(words)
    answered = sum(w in set(window) for w in answer) / len(answer)
    return covered >= 0.7 or covered >= 0.5 and answered >= 0.6


def exhaustive(item, text):
    """Whether any window of one and a half times the item, at every word, obeys the rule."""
    words, n = decontamination.words_of(text.encode()), len(item.split()) * 3 // 2
    return any(obeys(item, words[k : k + n]) for k in range(max(1, len(words) - n + 1)))


def test_recall_of_paraphrases(spark):
    rng = random.Random(31)
    common = prose(rng, 30).split()

    def mixed(n, part=0.55):
        return " ".join(rng.choice(common) if rng.random() < part else prose(rng, 1) + prose(rng, 1) for _ in range(n))

    items = [(k, mixed(rng.randint(18, 45)) + ". " + mixed(6) + ".") for k in range(60)]
    texts, foreign = [], [prose(rng, 1) + prose(rng, 1) for _ in range(400)]
    for k, item in items:
        body, answer = (x.split() for x in item.rstrip(".").split(". "))
        rare = [n for n, w in enumerate(body) if w not in common]
        for part in (0.2, 0.3, 0.45):
            m = round(part * (len(body) + len(answer)))
            for choice in ("random", "rarest"):
                for source in ("new words", "words of others"):
                    pick = set(rng.sample(range(len(body)), m) if choice == "random" else rng.sample(rare, min(m, len(rare))))
                    other = lambda: f"zz{rng.randint(0, 10**6)}" if source == "new words" else rng.choice(foreign + common * 5)  # noqa: B023, E731
                    copy = [other() if n in pick else w for n, w in enumerate(body)]
                    texts.append((len(texts), k, (part, choice, source), f"{mixed(60)}\n{' '.join(copy)}. {' '.join(answer)}.\n{mixed(60)}"))
    clean = [(10_000 + k, mixed(150)) for k in range(100)]
    wanted = {(d, k): kind for d, k, kind, t in texts if exhaustive(items[k][1], t)}
    assert len(wanted) > 500
    docs = frame(spark, [(d, t) for d, _, _, t in texts] + clean)
    got = {(r.doc_id, r.item_id) for r in decontamination.matches(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    # every kind of paraphrase on its own
    share = {kind: sum(p in got for p in wanted if wanted[p] == kind) / sum(x == kind for x in wanted.values()) for kind in set(wanted.values())}
    assert len(share) == 12 and min(share.values()) >= 0.9, share
    # without an item in it a text is found only where the exhaustive search finds one
    flagged = {d for d, _ in got if d >= 10_000}
    assert all(any(obeys(t, decontamination.words_of(text.encode())) for _, t in items) for d, text in clean if d in flagged)
