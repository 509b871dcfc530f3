"""Connected components: local forests of bounded chunks of links, then alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import arrow_schema, merged, save

#: Links that one task joins in memory at once (about 30 MB there).
CHUNK = 500_000

_EDGE, _EDGE_ARROW = arrow_schema("u long, v long")


def local_roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of some links and the smallest node that each can reach by them."""
    ids, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = place[: len(a)], place[len(a) :]
    label = np.arange(len(ids))
    while True:
        low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
        open_ = low < high
        if not open_.any():
            return ids, ids[label]
        a, b = a[open_], b[open_]
        np.minimum.at(label, high[open_], low[open_])
        while (label[label] != label).any():
            label = label[label]


def _forests(chunk: int):
    """A star (node, root) for each component of each chunk of links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def close() -> pa.RecordBatch:
            ids, roots = local_roots(*(np.concatenate(x) for x in zip(*held, strict=True)))
            inner = ids != roots
            return pa.RecordBatch.from_arrays([pa.array(ids[inner]), pa.array(roots[inner])], schema=_EDGE_ARROW)

        for batch in batches:
            if batch.num_rows:
                held.append(tuple(batch.column(c).to_numpy(zero_copy_only=False) for c in ("u", "v")))
                size += batch.num_rows
            if size > chunk:
                yield close()
                held, size = [], 0
        if held:
            yield close()

    return run


def connected_components(links: DataFrame, limit: int = 60, chunk: int = CHUNK) -> DataFrame:
    """(id, root) of every node of the links (a, b), a <> b: the smallest id that can be reached.

    Links are first replaced by the spanning stars of chunks of at most ``chunk`` links, which is all there is to do
    where one chunk holds them; the number of tasks is in proportion to the links.  Stars of several chunks are
    closed by large-star and small-star rounds.  There the smallest neighbour is aggregated (partially, before the
    exchange) and written, so the join back is one of two plain exchanges, which adaptive execution splits where a
    node has very many neighbours.  The number of rounds grows with the logarithm of the nodes; each is written,
    so a lost executor never repeats earlier ones.  Nothing is collected but one or two numbers a step.
    An error is raised if the edges still change in the last of ``limit`` rounds.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v")
    tasks = -(-edges.count() // chunk) or 1
    edges, before = save(edges.coalesce(tasks).mapInArrow(_forests(chunk), _EDGE), "cc-forests"), None
    if tasks == 1:
        return edges.select(F.col("u").alias("id"), F.col("v").alias("root")).union(edges.select("v", "v").distinct())
    for _ in range(limit):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Large star: each larger neighbour is tied to the smallest of the neighbourhood.
        least = save(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "cc-least")
        edges = both.join(merged(least), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        edges = save(edges, "cc-large")
        # Small star: each node and its smaller neighbours are tied to the smallest of them.
        least = save(edges.groupBy("u").agg(F.min("v").alias("m")), "cc-least")
        smaller = edges.join(merged(least), "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = save(smaller.union(least.select("u", F.col("m").alias("v"))).distinct(), "cc-small")
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components were not closed after {limit} rounds")
    roots = edges.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("id"), "root")
    return roots.union(edges.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())
