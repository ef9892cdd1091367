"""The latent space of the benchmark's index is that of all documents, not of some of them."""

import random

import numpy as np
import pytest

from lociform.llm import decontamination
from tests.llm.test_operators import frame


@pytest.mark.parametrize("by_moments", [True, False])
def test_space_of_all_windows(spark, monkeypatch, by_moments):
    rng = random.Random(41)
    words = [f"w{k}" for k in range(24)]
    items = [(k, " ".join(rng.choice(words) for _ in range(12))) for k in range(20)]
    # the later texts have another company of words
    texts = [" ".join(rng.choice(words[k % 7 :]) if rng.random() < 0.7 else "other" for _ in range(rng.randint(5, 110))) for k in range(4500)]
    texts += [None, "", "other"]
    monkeypatch.setattr(decontamination, "MOMENT_WORDS", 4096 if by_moments else 1, raising=False)
    index = decontamination.fit(frame(spark, list(enumerate(texts))), items)
    # the moments of all passages, one by one
    total = np.zeros((25, 25))
    windows = [(t or "").split()[a : a + 48] for t in texts for a in range(0, len((t or "").split()), 48)]
    for passage in windows + [t.split() for _, t in items]:
        v = np.zeros(25)
        for w in passage:
            number = index.ids.get(w.encode(), 0)
            v[number] += index.idf[number]
        if v.any():
            total += np.outer(v, v) / (v @ v)
    # all directions are kept here, so that the whitened vectors give the inverse
    own = index.vectors[1:].astype(float) / index.idf[1:, None]
    off = np.abs(own @ own.T @ total[1:, 1:] - np.eye(24)).max()
    assert off < 2e-3, (off, np.linalg.cond(total[1:, 1:]))
