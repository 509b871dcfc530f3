"""Sequence packing as a cutting-stock problem, solved by column generation.

Each document's tokens (ids, then ``END``) are cut into full sequences of ``WIDTH`` tokens and one
remainder.  The histogram of remainders (at most ``WIDTH - 1`` counts, whatever the corpus) goes to the driver, where

1. a linear program picks how often each pattern of lengths is used; new patterns are priced by an
   unbounded-knapsack dynamic program over the duals, until no pattern improves the bound by more than ``GAP``;
2. patterns are rounded down and what is left is packed best-fit decreasing;
3. ranked documents of each length take the slots of the patterns in order.

Ranks come from counts per (block, length) and a prefix sum over blocks, so no length class is gathered in one
task, however many documents share it.  Tokens never leave the tokenising stage: a piece is known by its
start, length and the CRC-32 of its ids.

Null and empty texts are documents of the single id ``END``; repeated rows and doc_ids are documents of their
own; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.shared import arrow_schema, buckets, chunks, save, text_columns

WIDTH, END = 1024, 0
VOCABULARY = "byte_bpe_50k.json"
#: Remainders are rounded up to multiples of this for the linear program, which then has at most 256 rows.
GRAIN = 4
#: Relative distance from the linear program's optimum at which column generation may stop.
GAP = 5e-4
#: Pieces of text whose ids a worker remembers.
REMEMBERED = 600_000

# The vocabulary's own splitting pattern, for texts of ASCII and Latin-1 letters only; others,
# and those that hold an added token, are split by the tokenizer itself.
PLAIN = re.compile(r"[\t-\r -~\u00c0-\u00ff]*")
PARTS = re.compile(
    r"'(?:s|t|re|ve|m|ll|d)| ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+| ?[0-9]+"
    r"| ?[^\sA-Za-z0-9\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+|\s+(?!\S)|\s+"
)
#: A byte that no UTF-8 text has, so no merge of the vocabulary joins it with another sign.
_BREAK = 0xFF

_tokenizers: dict[str | None, object] = {}
_known: dict[str, bytes] = {}
#: The texts of a vocabulary's added tokens, which are found before a text is split into parts.
_added: dict[str | None, tuple[str, ...]] = {}


def tokenizer(path: str | None = None):
    """The tokenizer of a vocabulary file; one for each worker process."""
    if path not in _tokenizers:
        import public_tokenizers
        from tokenizers import Tokenizer

        _known.clear()
        _tokenizers.clear()
        _added.clear()
        _tokenizers[path] = Tokenizer.from_file(path or public_tokenizers.path(VOCABULARY))
        _added[path] = tuple(t.content for t in _tokenizers[path].get_added_tokens_decoder().values())
    return _tokenizers[path]


def _signs() -> dict[int, str]:
    """The sign that stands for each byte in a byte-level vocabulary: itself where it can be printed."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


_SIGNS = _signs()


def _learn(parts: list[str], path: str | None) -> None:
    """Encode parts that were not seen: many at once, with a sign between them that never merges."""
    model = tokenizer(path).model
    mark = model.token_to_id(_SIGNS[_BREAK])
    for k in range(0, len(parts), 500):
        some = parts[k : k + 500]
        joined = b"\xff".join(p.encode() for p in some).decode("latin-1").translate(_SIGNS)
        ids = np.array([t.id for t in model.tokenize(joined)], dtype="<u4")
        cuts = np.flatnonzero(ids == mark).tolist()
        data = ids.tobytes()
        for part, a, b in zip(some, [-1, *cuts], [*cuts, len(ids)], strict=True):
            _known[part] = data[4 * a + 4 : 4 * b]


def token_bytes(texts: list[str], path: str | None = None) -> list[bytes]:
    """Each text's ids as little-endian unsigned 32-bit numbers; parts that were seen are not encoded again."""
    machine = tokenizer(path)
    if len(_known) > REMEMBERED:  # common parts came first
        for part in list(islice(_known, REMEMBERED // 2, None)):
            del _known[part]
    added = _added[path]
    parts = [PARTS.findall(t) if PLAIN.fullmatch(t) and not any(a in t for a in added) else None for t in texts]
    new = {p for some in parts if some for p in some if p not in _known}
    if new:
        _learn(list(new), path)
    get = _known.__getitem__
    return [
        np.array(machine.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() if some is None else b"".join(map(get, some))
        for t, some in zip(texts, parts, strict=True)
    ]


_TOKENS, _TOKENS_ARROW = arrow_schema("doc_id long, doc_tokens long, crcs longs")


def tokenise(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, its tokens with the end, and the CRC-32 of each run of ``WIDTH`` ids (the last may be shorter)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([END], dtype="<u4").tobytes()
        for batch in chunks(batches, "text"):
            ids = [b + end for b in token_bytes(batch.column("text").to_pylist(), path)]
            crcs = [[zlib.crc32(b[k : k + 4 * WIDTH]) for k in range(0, len(b), 4 * WIDTH)] for b in ids]
            columns = [batch.column("doc_id"), pa.array([len(b) // 4 for b in ids], pa.int64()), pa.array(crcs, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, schema=_TOKENS_ARROW)

    return text_columns(docs).mapInArrow(run, _TOKENS)


def knapsack(values: np.ndarray, width: int) -> tuple[float, np.ndarray]:
    """The best value of lengths 1..len(values), repeats allowed, that fit into ``width``; and their counts."""
    best, choice = np.zeros(width + 1), np.zeros(width + 1, dtype=np.int64)
    for room in range(1, width + 1):
        n = min(room, len(values))
        options = values[:n] + best[room - n : room][::-1]
        k = int(options.argmax())
        if options[k] > best[room - 1] + 1e-12:
            best[room], choice[room] = options[k], k + 1
        else:
            best[room] = best[room - 1]
    counts, room = np.zeros(len(values), dtype=np.int64), width
    while room > 0:
        if choice[room]:
            counts[choice[room] - 1] += 1
            room -= choice[room]
        else:
            room -= 1
    return float(best[width]), counts


def generate(demand: np.ndarray, width: int, gap: float = GAP, rounds: int = 6000) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (one a row, counts of lengths 1..width-1) and how often the linear program uses each.

    A revised simplex method with the explicit inverse of the basis; the knapsack prices one new pattern a
    round.  It starts from patterns of one length, and of a length with its complement where that is rarer.
    """
    size = len(demand)
    times = width // np.arange(1, size + 1)
    patterns, inverse = np.diag(times).astype(np.int64), np.diag(1 / times)
    for r in range(1, size + 1):
        other = width - r
        if other != r and (demand[r - 1], r) < (demand[other - 1], other):
            patterns[r - 1] = 0
            patterns[r - 1, [r - 1, other - 1]] = 1
            inverse[r - 1, r - 1], inverse[other - 1, r - 1] = 1, -1 / times[other - 1]
    # Sums and products only, no matrix routines: those start threads of their own in the driver.
    level = np.maximum((inverse * demand).sum(axis=1), 0)
    for _ in range(rounds):
        value, counts = knapsack(np.maximum(inverse.sum(axis=0), 0), width)
        if value <= 1 + gap:
            break
        used = np.flatnonzero(counts)
        direction = (inverse[:, used] * counts[used]).sum(axis=1)
        positive = direction > 1e-9
        if not positive.any():
            break
        ratio = np.full(size, np.inf)
        ratio[positive] = level[positive] / direction[positive]
        out = int(ratio.argmin())
        step = ratio[out]
        level = np.maximum(level - step * direction, 0)
        level[out] = step
        row = inverse[out] / direction[out]
        inverse -= np.outer(direction, row)
        inverse[out] = row
        patterns[out] = counts
    return patterns, level


def best_fit(left: np.ndarray, width: int) -> list[dict[int, int]]:
    """Pack what is left, longest first, each into the fullest sequence that has room; length: times."""
    by_room: dict[int, list[int]] = {}
    out: list[dict[int, int]] = []
    for length in range(len(left), 0, -1):
        for _ in range(int(left[length - 1])):
            room = next((r for r in range(length, width) if by_room.get(r)), None)
            if room is None:
                at, room = len(out), width
                out.append({})
            else:
                at = by_room[room].pop()
            out[at][length] = out[at].get(length, 0) + 1
            by_room.setdefault(room - length, []).append(at)
    return out


def solve(histogram: dict[int, int], width: int = WIDTH // GRAIN, gap: float = GAP) -> list[tuple[dict[int, int], int]]:
    """Patterns (length: times) with how many sequences use each; every length is met exactly.

    Lengths up to ``width``; those of the whole width need no pattern and fill sequences of their own.
    """
    demand = np.array([histogram.get(k, 0) for k in range(1, width)], dtype=np.int64)
    out = [({width: 1}, histogram[width])] if histogram.get(width) else []
    if not demand.any():
        return out
    patterns, level = generate(demand.astype(float), width, gap)
    left = demand.copy()
    for k in np.argsort(-level, kind="stable").tolist():
        used = patterns[k] > 0
        times = min(int(level[k] + 1e-9), int((left[used] // patterns[k][used]).min()))
        if times > 0:
            left -= times * patterns[k]
            out.append(({int(i) + 1: int(patterns[k][i]) for i in np.flatnonzero(used)}, times))
    return out + [(row, 1) for row in best_fit(left, width)]


def slots(plan: list[tuple[dict[int, int], int]]) -> tuple[dict[int, np.ndarray], int]:
    """For each length: (first rank, sequences, first sequence, place) of its places in patterns; and all sequences.

    The documents of ranks ``first .. first + sequences - 1`` take that place, one in each sequence.
    """
    rank: dict[int, int] = {}
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    base = 0
    for pattern, times in plan:
        place = 0
        for length in sorted(pattern, reverse=True):
            for _ in range(pattern[length]):
                out.setdefault(length, []).append((rank.get(length, 0), times, base, place))
                rank[length] = rank.get(length, 0) + times
                place += 1
        base += times
    return {length: np.array(rows, dtype=np.int64) for length, rows in out.items()}, base


_PIECES, _PIECES_ARROW = arrow_schema(
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, place long"
)


def pack(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The pieces of all documents: where each starts in its document, and its sequence and offset there."""
    spark = docs.sparkSession
    tokens = save(tokenise(docs, path), "pack-tokens")
    tokens = tokens.select(
        "*",
        F.pmod(F.xxhash64("doc_id"), F.lit(buckets(docs))).alias("block"),
        F.expr(f"doc_tokens div {WIDTH}").alias("whole"),
        F.ceil((F.col("doc_tokens") % WIDTH) / GRAIN).alias("class"),
    )
    counts = save(tokens.groupBy("block", "class").agg(F.count(F.lit(1)).alias("n"), F.sum("whole").alias("whole")), "pack-counts")
    # One count for each class of lengths: at most WIDTH / GRAIN rows, whatever the corpus.
    histogram = {r[0]: r[1] for r in counts.where("class > 0").groupBy("class").agg(F.sum("n")).collect()}
    table, used = slots(solve(histogram))
    shared = spark.sparkContext.broadcast(table)

    before = Window.partitionBy("class").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ranks = counts.select("block", "class", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rank0"))
    # One row a block (a few MB of text each): how many full sequences come before it.
    blocks = counts.groupBy("block").agg(F.sum("whole").alias("whole"))
    blocks = blocks.select("block", F.coalesce(F.sum("whole").over(earlier), F.lit(0)).alias("whole0"))
    same = Window.partitionBy("block", "class").orderBy("doc_id", "doc_tokens", "crcs")
    own = Window.partitionBy("block").orderBy("class", "doc_id", "doc_tokens", "crcs").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        tokens.withColumn("local", F.row_number().over(same) - 1)
        .withColumn("whole_before", F.coalesce(F.sum("whole").over(own), F.lit(0)))
        .join(ranks, ["block", "class"])
        .join(blocks, "block")
        .select(
            "doc_id",
            "doc_tokens",
            "crcs",
            "class",
            (F.col("rank0") + F.col("local")).alias("rank"),
            (F.col("whole0") + F.col("whole_before") + used).alias("full_id"),
        )
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, size, crcs, kind, rank, full_id in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                whole, rest = divmod(size, WIDTH)
                out += [(doc, k * WIDTH, WIDTH, crcs[k], size, full_id + k, 0) for k in range(whole)]
                if rest:
                    rows = shared.value[kind]
                    first, _, base, place = rows[int(np.searchsorted(rows[:, 0], rank, side="right")) - 1].tolist()
                    out.append((doc, whole * WIDTH, rest, crcs[whole], size, base + rank - first, place))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], schema=_PIECES_ARROW)

    # A sequence has at most WIDTH pieces, so this window's groups are bounded.
    inside = Window.partitionBy("sequence_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    return placed.mapInArrow(run, _PIECES).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", F.coalesce(F.sum("length").over(inside), F.lit(0)).alias("offset")
    )
