"""Components that are not closed within the rounds are an error, never a result; chunks of links don't change them."""

import random

import numpy as np
import pytest

from tessera.llm import components


def test_unclosed_components_raise(spark):
    with pytest.raises(RuntimeError, match="1 rounds"):
        components.connected_components(spark.createDataFrame([(k, k + 1) for k in range(30)], "a long, b long"), limit=1, chunk=4)


def test_chunks_do_not_matter(spark):
    rng = random.Random(3)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(300, k) for k in range(301, 340)] + [(400 + k, 401 + k) for k in range(30)] + [(500, 500)]
    frame = spark.createDataFrame(links, "a long, b long").repartition(3)
    whole, dealt = ({tuple(r) for r in components.connected_components(frame, chunk=size).collect()} for size in (10_000, 16))
    assert whole == dealt and all(a >= b for a, b in whole) and 500 not in {a for a, _ in whole}
    assert components.connected_components(frame.limit(0)).count() == 0


def test_local_roots():
    ids, roots = components.local_roots(np.array([5, 4, 9, 8]), np.array([4, 3, 8, 9]))
    assert dict(zip(ids.tolist(), roots.tolist(), strict=True)) == {3: 3, 4: 3, 5: 3, 8: 8, 9: 8}
