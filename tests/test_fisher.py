"""Fisher's test against sums of whole numbers."""

import math
import random

import pytest

from tessera.functions.stats import fisher_exact_2x2


def test_against_whole_numbers():
    rng = random.Random(1)
    for _ in range(200):
        (a, b), (c, d) = table = [[rng.randrange(60) for _ in range(2)] for _ in range(2)]
        row, column, total = a + b, a + c, a + b + c + d
        ways = {k: math.comb(column, k) * math.comb(total - column, row - k) for k in range(max(0, row + column - total), min(row, column) + 1)}
        want = sum(w for w in ways.values() if w <= ways[a]) / math.comb(total, row)
        assert fisher_exact_2x2(table) == pytest.approx(want, rel=1e-9, abs=1e-12)
