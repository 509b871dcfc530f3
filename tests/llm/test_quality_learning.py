"""The updates against a plain version with dictionaries, and what is learnt against labels that were held out."""

import math
import os
import random
import zlib

import numpy as np
import pytest

from tessera.llm import quality

FOLDER = os.environ.get("SPARK_GRAFT_SF_DIR", "/root/testdata/sf0.1").rsplit("/", 1)[0] + "/sf0.01"


def test_features_are_shares_of_each_family():
    texts = [b"One one TWO, three3", b"", b"x", "é ü é".encode()]
    for text, (index, value) in zip(texts, quality.sparse(texts), strict=True):
        want = {}
        for features, doc, count in quality._grams([text]):
            for f in features.tolist():
                want[f] = want.get(f, 0) + 1 / count[0]
            assert len(features) == count[0] and not doc.any()
        assert dict(zip(index.tolist(), value.tolist(), strict=True)) == pytest.approx(want)


def test_updates_against_a_plain_version():
    rng = random.Random(4)
    examples = [(np.array(sorted(rng.sample(range(60), 9))), np.array([rng.random() for _ in range(9)], dtype=np.float32)) for _ in range(80)]
    labels = [int(x[0][0] < 6) for x in examples]
    z, n = {}, {}

    def weight(k):
        if abs(z.get(k, 0.0)) <= quality.L1:
            return 0.0
        return -(z[k] - math.copysign(quality.L1, z[k])) / ((quality.BETA + math.sqrt(n[k])) / quality.ALPHA + quality.L2)

    good = sum(labels)
    scale = {1: 1.0, 0: math.sqrt(good / (len(labels) - good))}
    order = np.random.default_rng(7)
    for _ in range(quality.EPOCHS):
        for k in order.permutation(len(examples)).tolist():
            row = [*zip(examples[k][0].tolist(), examples[k][1].tolist(), strict=True), (1 << quality.BITS, 1.0)]
            old = {j: weight(j) for j, _ in row}
            chance = 1 / (1 + math.exp(-sum(old[j] * v for j, v in row)))
            for j, v in row:
                slope = (chance - labels[k]) * scale[labels[k]] * v
                z[j] = z.get(j, 0.0) + slope - (math.sqrt(n.get(j, 0.0) + slope * slope) - math.sqrt(n.get(j, 0.0))) / quality.ALPHA * old[j]
                n[j] = n.get(j, 0.0) + slope * slope
    found = quality.fit(examples, labels)
    assert {int(k) for k in np.flatnonzero(found)} <= set(z)
    for k in z:
        assert found[k] == pytest.approx(weight(k), rel=1e-3, abs=1e-4)


def test_scores_are_sparse_dot_products():
    rng = np.random.default_rng(2)
    weights = rng.normal(size=(1 << quality.BITS) + 1).astype(np.float32)
    texts = [b"some words and some MORE", b"", b"a"]
    for text, score, (index, value) in zip(texts, quality.scores(texts, weights), quality.sparse(texts), strict=True):
        assert score == pytest.approx(1 / (1 + math.exp(-(float(weights[index] @ value) + weights[-1]))), rel=1e-4), text


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the given tables")
def test_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    scored = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    truth = {r.doc_id: r.quality for r in labels.where("quality is not null").collect()}
    held = [d for d in truth if d in scored and zlib.crc32(str(d).encode()) % 3 == 1]
    assert all(scored[d].held_out for d in held) and len(scored) == docs.select("doc_id").distinct().count()
    good, bad = ([scored[d].score for d in held if truth[d] == k] for k in (1, 0))
    wins = sum((g > b) + 0.5 * (g == b) for g in good for b in bad)
    assert wins / (len(good) * len(bad)) > 0.9
    assert sum(scored[d].predicted == truth[d] for d in held) / len(held) > 0.85
