"""Benchmark decontamination by a generalised suffix automaton of the normalised test items.

Words are runs of letters and digits (everything beyond ASCII included), A-Z in lower case.  A window is
``WINDOW`` consecutive words of an item; a shorter item that has words is one window.  The automaton of all
items is built on the driver from at most ``SHARD_WORDS`` words and broadcast; a larger benchmark gets several
automata, built and streamed over the documents one after the other, each in a pass of its own whose rows are
written, so that what is broadcast and held stays bounded.  Results don't depend on how items are dealt.

Documents stream through the automaton, which tracks the longest match that ends at each word.  As a match
of two or more words needs each pair of neighbours to occur in the benchmark, runs of such pairs are found
first, by hashes and without Python steps for each word; only those runs are walked, with exact words.

Null and empty texts have no words; items without words have no windows; an empty benchmark hits nothing;
repeated items and documents count as often as they are there; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.shared import arrow_schema, chunks, save, settle, text_columns
from tessera.llm.words import ALPHANUMERIC, U64, Words

WINDOW = 10
#: Bound of the words in one automaton (about 600 bytes each in a worker).
SHARD_WORDS = 400_000
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def normalise(text: str | None) -> list[bytes]:
    return WORD.findall((text or "").encode().lower())


class Automaton:
    """All substrings of the items' word sequences."""

    def __init__(self, items: list[tuple[int, list[bytes]]], window: int = WINDOW) -> None:
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        sequences = []
        for item, words in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]
            sequences.append((item, ids))
            last = 0
            for c in ids:
                last = self._extend(last, c)
        self._ends(sequences)
        self._tables([w for _, w in items])

    def _extend(self, last: int, c: int) -> int:
        """Append c after the state ``last``; a transition that exists is reused or its target cloned."""
        following = self.next[last].get(c)
        if following is not None:
            return following if self.length[following] == self.length[last] + 1 else self._clone(last, c, following)
        state = self._state(self.length[last] + 1, {})
        at = last
        while at >= 0 and c not in self.next[at]:
            self.next[at][c] = state
            at = self.link[at]
        if at < 0:
            self.link[state] = 0
        else:
            target = self.next[at][c]
            self.link[state] = target if self.length[target] == self.length[at] + 1 else self._clone(at, c, target)
        return state

    def _state(self, length: int, transitions: dict[int, int]) -> int:
        self.next.append(transitions)
        self.length.append(length)
        self.link.append(0)
        return len(self.next) - 1

    def _clone(self, at: int, c: int, target: int) -> int:
        copy = self._state(self.length[at] + 1, dict(self.next[target]))
        self.link[copy] = self.link[target]
        self.link[target] = copy
        while at >= 0 and self.next[at].get(c) == target:
            self.next[at][c] = copy
            at = self.link[at]
        return copy

    def _ends(self, sequences: list[tuple[int, list[int]]]) -> None:
        """For each state: the state that holds its last ``window`` words, and the windows that end in it."""
        size, w = len(self.next), self.window
        order = sorted(range(1, size), key=self.length.__getitem__)
        self.holder = [-1] * size
        for s in order:
            if self.length[s] >= w:
                up = self.link[s]
                self.holder[s] = s if self.length[up] < w else self.holder[up]
        self.items: dict[int, set[int]] = {}
        own: dict[int, list[tuple[int, int]]] = {}
        for item, ids in sequences:
            state = 0
            for k, c in enumerate(ids):
                state = self.next[state][c]
                if k + 1 >= w:
                    self.items.setdefault(self.holder[state], set()).add(item)
            if 0 < len(ids) < w:
                own.setdefault(state, []).append((len(ids), item))
        #: Short items that are suffixes of what a state holds.
        self.short: list[tuple[tuple[int, int], ...]] = [()] * size
        for s in order:
            self.short[s] = (*own.get(s, ()), *self.short[self.link[s]])

    def _tables(self, items: list[list[bytes]]) -> None:
        """Hash tables of the pairs of neighbours, and of single words that are items."""
        shortest = min((len(x) for x in items if x), default=self.window)
        self.least = min(shortest, self.window)
        words = Words([b" ".join(x) for x in items] or [b""], ALPHANUMERIC, lower=True)
        pairs = words.rolling(2)[words.valid(2)]
        self.bits = max(16, (64 * len(pairs)).bit_length())
        self.pairs = np.zeros(1 << self.bits, dtype=bool)
        self.pairs[pairs >> U64(64 - self.bits)] = True
        self.singles = np.unique(words.hash[words.first[:-1][words.counts == 1]]) if len(words) else np.zeros(0, dtype=U64)

    def walk(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """The spans of the windows that occur in a sequence of words, and their items."""
        spans, found = [], set()
        state = length = 0
        get, links, lengths, w = self.vocabulary.get, self.link, self.length, self.window
        for k, word in enumerate(words):
            c = get(word, -1)
            while state and c not in self.next[state]:
                state = links[state]
                length = lengths[state]
            state = self.next[state].get(c, 0)
            length = length + 1 if state else 0
            if length >= w:
                spans.append((k - w + 1, k + 1))
                # The window's state: the match may be shorter than what its state holds at most.
                found |= self.items.get(self.holder[state], set())
            for size, item in self.short[state]:
                if size <= length:
                    spans.append((k - size + 1, k + 1))
                    found.add(item)
        return spans, found

    def hits(self, block: Words) -> tuple[np.ndarray, dict[int, set[int]]]:
        """Which words of a block are hit, and the items found in each of its texts."""
        hit = np.zeros(len(block), dtype=bool)
        items: dict[int, set[int]] = {}
        if not len(block) or not self.vocabulary:
            return hit, items
        pair = self.pairs[block.rolling(2) >> U64(64 - self.bits)] & block.valid(2)
        edges = np.diff(pair.astype(np.int8), prepend=0, append=0)
        begins, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1) + 1
        long = ends - begins >= max(self.least, 2)
        runs = list(zip(begins[long].tolist(), ends[long].tolist(), strict=True))
        if len(self.singles):
            alone = np.flatnonzero(np.isin(block.hash, self.singles))
            runs += [(k, k + 1) for k in alone.tolist()]
        for begin, end in runs:
            spans, found = self.walk([block.word(k) for k in range(begin, end)])
            if found:
                for a, b in spans:
                    hit[begin + a : begin + b] = True
                items.setdefault(int(block.doc[begin]), set()).update(found)
        return hit, items


def automata(benchmark: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS) -> Iterator[Automaton]:
    """Automata of at most ``shard_words`` words each (one item at least), read item by item."""
    items, size = [], 0
    for row in benchmark.select(F.col("item_id").cast("long"), F.col("text")).toLocalIterator():
        words = normalise(row[1])
        if items and size + len(words) > shard_words:
            yield Automaton(items, window)
            items, size = [], 0
        items.append((row[0], words))
        size += len(words)
    yield Automaton(items, window)


_FOUND, _FOUND_ARROW = arrow_schema("doc_id long, text string, starts longs, ends longs, items longs")
_HITS, _HITS_ARROW = arrow_schema("doc_id long, n_words long, starts longs, ends longs, items longs")


def _hits_of(batch: pa.RecordBatch, machine: Automaton) -> pa.RecordBatch:
    """One row a document, with what earlier automata have found and what this one does."""
    block = Words(batch.column("text").cast(pa.binary()).to_pylist(), ALPHANUMERIC, lower=True)
    columns = [batch.column(c).to_pylist() if c in batch.schema.names else [[] for _ in block.counts] for c in ("starts", "ends", "items")]
    hit, found = machine.hits(block)
    for d, ids in found.items():
        own = hit[block.first[d] : block.first[d + 1]]
        for x, y in zip(columns[0][d], columns[1][d], strict=True):
            own[x:y] = True
        begins, ends = _edges(own)
        columns[0][d], columns[1][d], columns[2][d] = begins.tolist(), ends.tolist(), sorted(ids.union(columns[2][d]))
    lists = [pa.array(x, pa.list_(pa.int64())) for x in columns]
    return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(block.counts, pa.int64()), *lists], schema=_HITS_ARROW)


def _passes(docs: DataFrame, benchmark: DataFrame, window: int, shard_words: int, early: Callable, late: Callable) -> DataFrame:
    """All automata over the rows, one after the other: ``early`` makes the step of each but the last, ``late`` of that.

    Rows are written between automata, so that no worker holds two and the driver builds one at a time.
    """
    context, rows, waiting = settle(docs.sparkSession).sparkContext, docs, None
    for machine in automata(benchmark, window, shard_words):
        if waiting is not None:
            rows = save(early(rows, waiting), "benchmark-pass")
            waiting.unpersist()
        waiting = context.broadcast(machine)
    return late(rows, waiting)


def find_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS) -> DataFrame:
    """doc_id, n_words, the hit spans (word indexes starts and ends) and the items found, of every row of ``docs``."""

    def run(shared, schema: pa.Schema):
        def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in chunks(batches, "text"):
                found = _hits_of(batch, shared.value)
                yield found if schema is _HITS_ARROW else pa.RecordBatch.from_arrays([batch.column("text") if f.name == "text" else found.column(f.name) for f in schema], schema=schema)

        return step

    return _passes(
        text_columns(docs), benchmark, window, shard_words, lambda rows, m: rows.mapInArrow(run(m, _FOUND_ARROW), _FOUND), lambda rows, m: rows.mapInArrow(run(m, _HITS_ARROW), _HITS)
    )


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The report: words, hit words, items and their digest, and whether a document is contaminated."""
    n_hit = F.aggregate(F.zip_with("starts", "ends", lambda a, b: b - a), F.lit(0).cast("long"), lambda s, x: s + x)
    names = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return find_hits(docs, benchmark).select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.encode(names, "UTF-8"), 256).alias("items_sha256"),
        (F.size("items") > 0).alias("contaminated"),
    )


def _all_hits(block: Words, machine: Automaton, earlier: list[list[int]] | None) -> np.ndarray:
    """Which words of a block are hit by an automaton, or were by earlier ones (starts and ends in turn)."""
    hit, _ = machine.hits(block)
    for d, spans in enumerate(earlier or ()):
        for a, b in zip(spans[::2], spans[1::2], strict=True):
            hit[block.first[d] + a : block.first[d] + b] = True
    return hit


def _edges(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.diff(hit.astype(np.int8), prepend=0, append=0)
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def clean(
    docs: DataFrame, benchmark: DataFrame, max_coverage: float = 0.5, max_span: int | None = None, shard_words: int = SHARD_WORDS
) -> DataFrame:
    """The columns of ``docs`` without benchmark passages: hit spans are cut from the texts.

    A document with more than ``max_coverage`` of its words hit, or with a hit span longer than ``max_span``
    words, goes as a whole.  ``n_chars`` is set anew where there is such a column.  Several automata all read the original
    text and hand their spans on with the rows; the last one's pass cuts and judges, once, so the result doesn't depend on
    how items are dealt.
    """
    place, width = docs.columns.index("text"), len(docs.columns)
    name = "hits"
    while name in {c.lower() for c in docs.columns}:
        name += "_"

    def read(batch: pa.RecordBatch, shared) -> tuple[list[bytes], Words, np.ndarray]:
        texts = [t or b"" for t in batch.column(place).cast(pa.binary()).to_pylist()]
        block = Words(texts, ALPHANUMERIC, lower=True)
        earlier = batch.column(width).to_pylist() if batch.num_columns > width else None
        return texts, block, _all_hits(block, shared.value, earlier)

    def mark(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in chunks(batches, "text"):
                _, block, hit = read(batch, shared)
                spans: list[list[int]] = [[] for _ in block.counts]
                for d in np.unique(block.doc[hit]).tolist():
                    spans[d] = np.stack(_edges(hit[block.first[d] : block.first[d + 1]]), axis=1).ravel().tolist()
                field = pa.field(name, pa.list_(pa.int64()))
                schema = pa.schema([*list(batch.schema)[:width], field])
                yield pa.RecordBatch.from_arrays([*batch.columns[:width], pa.array(spans, field.type)], schema=schema)

        return run

    def cut(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in chunks(batches, "text"):
                texts, block, hit = read(batch, shared)
                columns, schema = [*batch.columns[:width]], pa.schema(list(batch.schema)[:width])
                found = set(np.unique(block.doc[hit]).tolist())
                if not found:
                    yield pa.RecordBatch.from_arrays(columns, schema=schema)
                    continue
                keep, new = np.ones(len(texts), dtype=bool), batch.column(place).to_pylist()
                for d in found:
                    a, b = block.first[d], block.first[d + 1]
                    begins, ends = _edges(hit[a:b])
                    if hit[a:b].sum() > max_coverage * (b - a) or max_span and (ends - begins).max() > max_span:
                        keep[d] = False
                    origin, at, parts = block.offsets[d], 0, []
                    for x, y in zip(begins.tolist(), ends.tolist(), strict=True):
                        parts.append(texts[d][at : block.starts[a + x] - origin])
                        at = block.ends[a + y - 1] - origin
                    new[d] = b"".join([*parts, texts[d][at:]]).decode()
                columns[place] = pa.array(new, schema.field(place).type)
                if "n_chars" in schema.names:
                    k = schema.names.index("n_chars")
                    old = columns[k].to_pylist()
                    columns[k] = pa.array([len(new[d]) if d in found else n for d, n in enumerate(old)], schema.field(k).type)
                yield pa.RecordBatch.from_arrays(columns, schema=schema).filter(pa.array(keep))

        return run

    marked = T.StructType([*docs.schema.fields, T.StructField(name, T.ArrayType(T.LongType()))])
    return _passes(docs, benchmark, WINDOW, shard_words, lambda rows, m: rows.mapInArrow(mark(m), marked), lambda rows, m: rows.mapInArrow(cut(m), docs.schema))
