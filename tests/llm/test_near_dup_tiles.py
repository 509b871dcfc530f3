"""Buckets of several components: every pair across them meets in some tile, however outsiders are dealt."""

import random

import pyarrow as pa
import pytest

from tessera.llm import near_dups


def texts(seed=1):
    """Groups whose members share a long passage without being near copies, and pairs of near copies among them."""
    rng, rows = random.Random(seed), []
    for group in range(3):
        passage = [f"p{group}x{k}" for k in range(120)]
        for k in range(45):
            own = [f"g{group}m{k}w{j}" for j in range(20 + group * 12)]
            rows.append(" ".join(passage + own))
            if k % 9 == 0:
                rows.append(" ".join([*passage, *own, "tail"]))
    rng.shuffle(rows)
    return dict(enumerate(rows))


@pytest.mark.parametrize(("tile", "depth"), [(512, 12), (8, 12), (8, 1), (8, 0), (3, 2)])
def test_outsiders_meet(spark, monkeypatch, tile, depth):
    monkeypatch.setattr(near_dups, "TILE", tile)
    monkeypatch.setattr(near_dups, "DEPTH", depth)
    rows = texts()
    want = near_dups.brute_force(rows)
    docs = spark.createDataFrame(list(rows.items()), "doc_id long, text string").repartition(3)
    assert {r.doc_id: tuple(r)[1:] for r in near_dups.components(docs).collect()} == want


def test_rows_without_a_frame_estimate_take_the_sessions_partitions(spark):
    from tessera.llm.shared import buckets

    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert buckets(docs.repartition(2)) == buckets(spark.createDataFrame(docs.rdd, docs.schema)) == 4


def test_repeated_ids_and_five_word_shingles(spark):
    body = " ".join(f"w{k}" for k in range(100))
    rows = [(3, body), (7, body), (7, "other words"), (9, "other words"), (9, "other words"), (5, f"{body} x"), (1, None), (2, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for shingle in (2, 5):
        found = sorted((r.doc_id, r.n_shingles, r.component_id) for r in near_dups.components(docs, shingle).collect())
        n = 101 - shingle
        assert found == sorted([(3, n, 3), (7, n, 3), (7, 1, 7), (9, 1, 7), (9, 1, 7), (5, n + 1, 3), (1, 0, 1), (2, 0, 2)])


def test_links_between_roots_are_found_once():
    import numpy as np

    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[k * 10 :], rng.integers(0, 1 << 63, 10 * k, dtype=np.uint64)])) for k in range(6)]
    registers = near_dups.sketch(sets)
    shared = (registers[0] == registers).reshape(6, near_dups.BANDS, near_dups.ROWS).all(axis=2)
    for k in (1, 2):
        rows = [
            {"bucket": 1, "tile_a": 0, "tile_b": b, "side": s, "band": int(shared[k].argmax()), "used": 0, "id": i, "n": len(sets[i]), "root": i, "deep": 0, "registers": registers[i].tobytes(), "elements": sets[i].tobytes()}
            for b, other in ((0, 0), (1, 1))
            for s, i in ((0, 0), (other, k))
        ]
        batch = pa.RecordBatch.from_pylist(rows)
        want = [{"a": 0, "b": k}] if near_dups.linked(sets[0], sets[k]) else []
        assert [x for b in near_dups._confirm_tiles(iter([batch])) for x in b.to_pylist()] == 2 * want
        assert sum(b.num_rows for b in near_dups._screen_tiles(iter([batch]))) == 4
