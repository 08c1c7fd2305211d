"""Greedy dedup over a chain of fingerprints longer than any fixed number of rounds."""

import random

from noticelake.operators import simhash


def far(a, b):
    return ((a ^ b) & (2**64 - 1)).bit_count()


def chain_of(n):
    """Fingerprints within the radius of their neighbours in the chain only."""
    rng = random.Random(1)
    chain = [rng.getrandbits(62) | 1]
    while len(chain) < n:
        x = chain[-1]
        for b in rng.sample(range(62), 3):
            x ^= 1 << b
        if x and all(far(x, y) > simhash.RADIUS for y in chain[:-1]):
            chain.append(x)
    return chain


def test_every_second_link_of_a_chain_is_kept(spark):
    rows = list(enumerate(chain_of(104)))
    got = simhash.keep_first(spark.createDataFrame(rows, "id long, simhash long")).collect()
    assert {r.id: r.kept for r in got} == {i: i % 2 == 0 for i, _ in rows}
