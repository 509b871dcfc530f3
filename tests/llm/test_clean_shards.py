"""Cutting benchmark passages must not depend on how many automata the items are dealt to."""

import itertools

from tessera.llm import decontaminate

W = [f"w{k}" for k in range(60)]
OVERLAP = [(1, " ".join(W[0:12])), (2, " ".join(W[7:20]))]
HALVES = [(3, " ".join(W[30:42])), (4, " ".join(W[42:54]))]
REST = " ".join(f"r{k}" for k in range(40))


def test_shards_and_order_do_not_matter(spark):
    rows = [
        (1, f"{' '.join(W[0:20])} {REST}", 0, "x"),
        (2, f"{' '.join(W[30:54])} r0 r1 r2 r3 r4 r5", 0, "y"),
        (2, f"{REST}. {' '.join(W[7:20])}", 0, "z"),
        (3, None, 7, "x"),
        (4, f"{REST} {' '.join(W[0:6])} {' '.join(W[30:42])} {' '.join(W[6:12])}", 0, "x"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars int, hits string")
    texts = {1: f" {REST}", 2: f"{REST}. ", 3: None, 4: f"{REST} {' '.join(W[0:6])}  {' '.join(W[6:12])}"}
    for items in itertools.permutations([*OVERLAP, HALVES[0]]):
        bench = spark.createDataFrame([*items, HALVES[1]], "item_id long, text string").coalesce(1)
        for shard in (400_000, 12):
            out = decontaminate.clean(docs, bench, shard_words=shard)
            assert out.columns == docs.columns
            found = out.collect()
            assert len(found) == 4 and {r.doc_id: r.text for r in found} == texts
            assert all(r.n_chars == (7 if r.text is None else len(r.text)) for r in found)


def test_hits_are_per_row_whatever_the_shards(spark):
    rows = [(2, " ".join(W[0:20])), (2, REST), (2, f"x {' '.join(W[30:54])}"), (3, None), (2, " ".join(W[0:20]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([*OVERLAP, *HALVES], "item_id long, text string").coalesce(1)
    want = sorted([(2, 20, [0], [20], [1, 2]), (2, 40, [], [], []), (2, 25, [1], [25], [3, 4]), (3, 0, [], [], []), (2, 20, [0], [20], [1, 2])])
    for shard in (400_000, 12):
        found = decontaminate.find_hits(docs, bench, shard_words=shard)
        assert sorted(tuple(r) for r in found.collect()) == want
