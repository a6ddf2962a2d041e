"""The chance that the odd sketch refuses a true link, from its exact distribution."""

from math import comb

import numpy as np

from tallyhouse.llm import neardup


def test_the_sketch_misses_no_more_than_the_bands():
    bits, samples, s = neardup.SKETCH_BITS, neardup.HASHES, neardup.PERCENT / 100
    limit, k = neardup.most_flips(neardup.REFUSED_BELOW), np.arange(neardup.SKETCH_BITS + 1)
    odd = np.zeros(bits + 1)
    odd[0] = 1.0
    miss = 0.0
    for differing in range(301):  # each flips two bits; more than 300 of 600 do not occur at 0.75
        miss += comb(samples, differing) * (1 - s) ** differing * s ** (samples - differing) * odd[limit + 1 :].sum()
        for _ in range(2):
            after = np.zeros(bits + 1)
            after[1:] += (odd * (bits - k) / bits)[:-1]
            after[:-1] += (odd * k / bits)[1:]
            odd = after
    assert miss <= (1 - s**neardup.ROWS) ** neardup.BANDS
