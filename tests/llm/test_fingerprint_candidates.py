"""Pairs that share no MinHash key are still met by their fingerprints."""

import random

from lociform.llm import minhash, nearcopies, simhash
from tests.llm.test_operators import frame, prose


def test_fingerprints_meet_what_keys_miss(spark):
    # a seed whose pair of 24 and 30 shingles shares no key and lies within 4 bits
    rng = random.Random(135588)
    words = [f"{rng.getrandbits(32):x}" for _ in range(34)]
    a, b = " ".join(words[:28]), " ".join(words)
    sets = [minhash.shingles(t.encode()) for t in (a, b)]
    assert len(set(sets[0].tolist()) & set(sets[1].tolist())) * 100 >= 80 * len(set(sets[0].tolist()) | set(sets[1].tolist()))
    assert not (minhash.bands(sets[0]) == minhash.bands(sets[1])).any()
    assert (simhash.simhash(a.encode()) ^ simhash.simhash(b.encode())).bit_count() <= 4
    # a set of one shingle in two texts, null and empty texts, and what is alone
    texts = [(1, prose(rng, 60)), (5, a), (9, b), (11, None), (12, ""), (13, "same same same same same same"), (14, "same same same same same same same same"), (15, "one two")]
    want = {1: 1, 5: 5, 9: 5, 11: 11, 12: 11, 13: 13, 14: 13, 15: 15}
    got = nearcopies.near_copies(frame(spark, texts)).collect()
    assert {r.doc_id: r.component_id for r in got} == want
