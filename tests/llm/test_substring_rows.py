"""Rows that repeat a doc_id, with the same text or another one, are each judged against smaller ids."""

import random

from tessera.llm import substrings


def test_repeated_ids(spark):
    rng = random.Random(8)
    passage = [" ".join(f"p{j}x{rng.randrange(50)}" for _ in range(40)) for j in range(3)]
    other = [" ".join(f"o{rng.randrange(5000)}" for _ in range(n)) for n in (30, 90, 7, 200)]
    rows = [
        (1, f"{other[0]} {passage[0]}"),
        (5, f"{passage[0]} {other[1]}"),
        (5, f"{other[3]} {passage[0]} {passage[1]}"),
        (5, other[2]),
        (5, f"{passage[0]} {other[1]}"),
        (5, None),
        (7, f"{passage[1]} {other[2]} {passage[0]}"),
        (7, f"{passage[1]} {other[2]} {passage[0]}"),
        (9, f"{passage[2]} {passage[2]}"),
        (9, passage[2]),
        (2, ""),
    ]
    for files in (1, 4):
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(files)
        assert sorted(map(tuple, substrings.deduplicate(docs).collect())) == sorted(substrings.brute_force(rows))
        assert substrings.remove_repeats(docs).count() == len(rows)
