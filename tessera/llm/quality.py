"""Quality classifier: hashed word n-gram logistic regression, trained by FTRL-proximal updates.

Each text is seen as three streams of words: the words in lower case, their outlines (``Aa.``), and
outlines in which a word equal to the one before is marked as a repeat.  The n-grams of all streams are
hashed into ``2**BITS`` weights; a feature's value is its share of the n-grams of its family, so a score
is one sparse dot product and does not depend on the text's length.

Training reads labels of the documents whose ``crc32(doc_id) mod 3`` is not 1, at most ``MAX_EXAMPLES`` of them (the smallest
by a hash of doc_id) and of these, in that order, whole texts of at most ``MAX_BYTES`` in all: the two
documented bounds of what one task learns from.  Scoring streams over all whole texts.  Null and empty texts get the score of the bias alone.  Repeated documents get equal scores.
Labels are merged per doc_id (a document is good only if all its labels say so); null labels are ignored.
Without any usable labels every score is 0.5.  Other columns are never read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import arrow_schema, chunks, text_columns
from tessera.llm.words import NOT_SPACE, U64, Words, mix

BITS = 18
#: Bounds of the labelled sample that training may use: documents, and bytes of their texts.
MAX_EXAMPLES, MAX_BYTES = 8_000, 64 << 20
EPOCHS = 3
ALPHA, BETA, L1, L2 = 2.0, 1.0, 0.002, 0.01
#: (stream, n) of each family of features.
FAMILIES = (("word", 1), ("word", 2), ("outline", 1), ("outline", 2), ("outline", 3), ("repeat", 1), ("repeat", 2))
_REPEAT = U64(0x6A09E667F3BCC909)


def _grams(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each family: the hashed feature of each place, the text of each place, and places per text."""
    outlines = Words(texts, NOT_SPACE, lower=False)
    lower = Words(texts, NOT_SPACE, lower=True).hash
    shape = outlines.shape
    same = np.zeros(len(outlines), dtype=bool)
    same[1:] = (lower[1:] == lower[:-1]) & (outlines.doc[1:] == outlines.doc[:-1])
    streams = {"word": lower, "outline": shape, "repeat": np.where(same, _REPEAT, shape)}
    for k, (stream, n) in enumerate(FAMILIES):
        h = streams[stream]
        size = max(len(h) - n + 1, 0)
        acc = h[:size] + U64(k * 0x51ED270B + 1)
        for j in range(1, n):
            acc = acc * U64(0x9E3779B97F4A7C15) + h[j : size + j]
        ok = outlines.valid(n)[:size]
        doc = outlines.doc[:size][ok]
        yield (mix(acc[ok]) >> U64(64 - BITS)).astype(np.int64), doc, np.bincount(doc, minlength=len(texts))


def sparse(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Indexes and values of each text's features."""
    ids: list[list[np.ndarray]] = [[] for _ in texts]
    values: list[list[np.ndarray]] = [[] for _ in texts]
    for features, _, count in _grams(texts):
        at = np.concatenate(([0], np.cumsum(count)))
        for d in range(len(texts)):
            index, times = np.unique(features[at[d] : at[d + 1]], return_counts=True)
            ids[d].append(index)
            values[d].append(times / max(count[d], 1))
    out = []
    for i, v in zip(ids, values, strict=True):
        index, where = np.unique(np.concatenate(i), return_inverse=True)
        out.append((index.astype(np.int32), np.bincount(where, np.concatenate(v), len(index)).astype(np.float32)))
    return out


class Ftrl:
    """Follow-the-regularised-leader (proximal) logistic regression over sparse features and a bias."""

    def __init__(self) -> None:
        self.z = np.zeros((1 << BITS) + 1)
        self.n = np.zeros((1 << BITS) + 1)

    def weights(self, index: np.ndarray | slice) -> np.ndarray:
        z = self.z[index]
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(self.n[index])) / ALPHA + L2))

    def learn(self, index: np.ndarray, value: np.ndarray, label: int, weight: float) -> None:
        index, value = np.append(index, 1 << BITS), np.append(value, np.float32(1))
        w = self.weights(index)
        chance = 1 / (1 + math.exp(-max(-35.0, min(35.0, float(w @ value)))))
        slope = (chance - label) * weight * value
        self.z[index] += slope - (np.sqrt(self.n[index] + slope * slope) - np.sqrt(self.n[index])) / ALPHA * w
        self.n[index] += slope * slope


def fit(examples: list[tuple[np.ndarray, np.ndarray]], labels: list[int]) -> np.ndarray:
    """Weights, bias last.  The rarer label weighs more, by the square root of the ratio of counts."""
    model = Ftrl()
    good = sum(labels)
    scale = {1: 1.0, 0: math.sqrt(max(good, 1) / max(len(labels) - good, 1))}
    order = np.random.default_rng(7)
    for _ in range(EPOCHS):
        for k in order.permutation(len(examples)).tolist():
            model.learn(*examples[k], labels[k], scale[labels[k]])
    return model.weights(slice(None)).astype(np.float32)


def scores(texts: list[bytes], weights: np.ndarray) -> np.ndarray:
    total = np.full(len(texts), float(weights[-1]))
    for features, doc, count in _grams(texts):
        total += np.bincount(doc, weights[features], len(texts)) / np.maximum(count, 1)
    return 1 / (1 + np.exp(-np.clip(total, -35, 35)))


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


_MODEL, _MODEL_ARROW = arrow_schema("weights binary")
_SCORED, _SCORED_ARROW = arrow_schema("doc_id long, score double")


def train(docs: DataFrame, labels: DataFrame, max_examples: int = MAX_EXAMPLES) -> np.ndarray:
    """Fit on a bounded sample of labelled documents, in one task; returns the weights to the driver (1 MB)."""
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
        .where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"))
        .withColumn("rank", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)))
    )
    count = known.count()
    if count > max_examples:
        known = known.where(F.col("rank") < int((1 << 30) * min(1.0, 1.3 * max_examples / count + 1e-4)))
    sample = known.orderBy("rank", "doc_id").limit(max_examples)
    rows = (
        text_columns(docs)
        .join(F.broadcast(sample), "doc_id")
        .repartition(1)
        .sortWithinPartitions("rank", "doc_id")
        .select("text", "quality")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        examples: list[tuple[np.ndarray, np.ndarray]] = []
        marks: list[int] = []
        size = 0
        for batch in chunks(batches, "text"):
            size += pc.sum(pc.binary_length(batch.column("text"))).as_py()
            if size > MAX_BYTES and marks:
                continue
            examples += sparse(batch.column("text").cast(pa.binary()).to_pylist())
            marks += batch.column("quality").to_pylist()
        yield pa.RecordBatch.from_arrays([pa.array([fit(examples, marks).tobytes()])], schema=_MODEL_ARROW)

    found = rows.mapInArrow(run, _MODEL).collect()
    return np.frombuffer(found[0][0], dtype=np.float32) if found else np.zeros((1 << BITS) + 1, dtype=np.float32)


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """doc_id and score of each row's whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores(texts, shared.value))], schema=_SCORED_ARROW)

    return text_columns(docs).mapInArrow(run, _SCORED)


def keep_good(docs: DataFrame, weights: np.ndarray, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more; all columns as they were."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            texts = [t or b"" for t in batch.column(place).cast(pa.binary()).to_pylist()]
            yield batch.filter(pa.array(scores(texts, shared.value) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    return score(docs, train(docs, labels)).select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
