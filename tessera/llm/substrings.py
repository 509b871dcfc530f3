"""Substring deduplication by fixed-block anchors.

A window is ``WINDOW`` = 13 consecutive words of one document.  A word goes if it lies in a window whose words
also start in a document with a smaller doc_id.  Reference blocks are the non-overlapping ``BLOCK`` = 7 words from
each multiple of 7 in every document; every window of 13 words holds one whole block of its document.

1. *Index and probe.*  Each task hashes all rolling 7-word windows of its texts.  Windows that several of its
   documents share are settled there and only the smallest document's goes on, so a passage that a
   third of all documents have costs one entry a task.  Entries are 8 bytes (40 bits of hash beyond the
   bucket, the place, and whether it is an anchor), dealt by hash; a bucket keeps the hashes that have an anchor
   and stand in two places, and replies to those places.
2. *Extend.*  Only windows of 13 words around a hit are hashed in full (96 bits and the bucket), reduced per
   task in the same way, and dealt by hash; a window repeats where its document isn't the smallest of its hash.
   Neighbouring repeated windows join to maximal repeats.
3. *Remove.*  Each document meets its own list of repeated windows.

Null and empty texts have no words; a document of fewer than 13 words is never touched.  Rows that repeat a doc_id count
as one document's texts: each row, told from the others by its text's hash, is judged against smaller ids and gives one
row.  Other columns are ignored; an empty table gives an empty result.  Texts must come from a source that reads the same rows again in the same order
when a task is repeated, as files do.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import arrow_schema, buckets, chunks, merged, save, text_columns
from tessera.llm.words import NOT_SPACE, U64, Words, mix

WINDOW = 13
BLOCK = (WINDOW + 1) // 2
#: Words of a task's texts that one row of entries can address.
SPAN = 1 << 23

_ENTRY, _ENTRY_ARROW = arrow_schema("bucket long, chunk long, base long, kind int, payload binary, ids longs, parts longs, firsts longs")
_REPLY, _REPLY_ARROW = arrow_schema("chunk long, base long, kind int, payload binary, ids longs, parts longs, firsts longs")
_FLAGS, _FLAGS_ARROW = arrow_schema("doc_id long, part long, flags binary")
_FULL, _FULL_ARROW = arrow_schema("bucket long, ids longs, parts longs, counts longs, high binary, low binary, places binary, repeats binary")
_START, _START_ARROW = arrow_schema("doc_id long, part long, starts binary")
_BLOCK_ROWS, _BLOCK_ARROW = arrow_schema("block long, ids longs, parts longs, counts longs, starts binary")
_RESULT, _RESULT_ARROW = arrow_schema("doc_id long, n_words long, n_removed long, kept_sha256 string")
#: Kinds of rows in the first exchange.
ENTRIES, PLACES, DOCUMENTS = 0, 1, 2


def _by_id(batch: pa.RecordBatch) -> pa.RecordBatch:
    return batch.take(pc.sort_indices(batch.column("doc_id")))


def _bucket(hashes: np.ndarray, n: int) -> np.ndarray:
    return ((hashes >> U64(40)).astype(np.int64) * n) >> 24


def _groups(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first index of each run of equal keys, and the run of each index."""
    fresh = np.ones(len(sorted_keys), dtype=bool)
    fresh[1:] = sorted_keys[1:] != sorted_keys[:-1]
    return np.flatnonzero(fresh), np.cumsum(fresh) - 1


def _repeat(rows: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """The doc_id and part of each window that rows list by counts."""
    counts = np.array([c for r in rows for c in r["counts"]], dtype=np.int64)
    return tuple(np.repeat(np.array([i for r in rows for i in r[name]], dtype=np.int64), counts) for name in ("ids", "parts"))


def _texts(doc: np.ndarray, part: np.ndarray) -> np.ndarray:
    """The first index of each run of equal doc_id and part."""
    fresh = np.ones(len(doc), dtype=bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | (part[1:] != part[:-1])
    return np.flatnonzero(fresh)


def _parted(docs: DataFrame) -> DataFrame:
    """The key, the text's hash and the text."""
    texts = text_columns(docs)
    return texts.select("doc_id", F.xxhash64("text").alias("part"), "text")


def _slices(keys: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Runs of equal values of a sorted array."""
    first, _ = _groups(keys)
    for a, b in zip(first.tolist(), [*first[1:].tolist(), len(keys)], strict=True):
        yield int(keys[a]), slice(a, b)


def _rows(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _probe(n: int):
    """Entries of all rolling windows, one row for each bucket; places settled here; and what the places mean."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            batch = _by_id(batch)
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            block = Words(batch.column("text").cast(pa.binary()).to_pylist(), NOT_SPACE, lower=False)
            # Equal ids are one document: only where ids differ is a window shared.
            owner = np.cumsum(np.concatenate(([0], ids[1:] != ids[:-1])))[block.doc] if len(block) else block.doc
            at = np.flatnonzero(block.valid(BLOCK) & (np.repeat(block.counts, block.counts) >= WINDOW))
            if not len(at):
                continue
            hashes = block.rolling(BLOCK)[at]
            anchor = block.place()[at] % BLOCK == 0
            order = np.argsort(hashes, kind="stable")
            hashes, at, anchor = hashes[order], at[order], anchor[order]
            first, run_of = _groups(hashes)
            last = np.append(first[1:], len(hashes)) - 1
            anchored = np.maximum.reduceat(anchor, first)
            shared = owner[at[first]] != owner[at[last]]
            chunk = int(np.frombuffer(hashlib.blake2b(ids.tobytes() + block.first.tobytes(), digest_size=8).digest(), dtype=np.int64)[0])
            bucket = _bucket(hashes[first], n)
            out = []
            for base in range(0, len(block), SPAN):
                mine = (at[first] >= base) & (at[first] < base + SPAN)
                entry = ((hashes[first] & U64((1 << 40) - 1)) << U64(24)) | ((at[first] - base).astype(U64) << U64(1)) | anchored.astype(U64)
                entry, own = entry[mine], bucket[mine]
                out += [(b, chunk, base, ENTRIES, entry[s].tobytes(), [], [], []) for b, s in _slices(own)]
            settled = np.sort(at[shared[run_of]])
            home = chunk % n
            if len(settled):
                out.append((home, chunk, 0, PLACES, settled.astype(np.int64).tobytes(), [], [], []))
            out.append((home, chunk, 0, DOCUMENTS, b"", ids.tolist(), batch.column("part").to_pylist(), block.first.tolist()))
            yield _rows(_ENTRY_ARROW, out)

    return run


def _grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, list[dict]]]:
    """Rows of a partition that is sorted by ``key``, one group at a time."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and held[0][key] != row[key]:
                yield held[0][key], held
                held = []
            held.append(row)
    if held:
        yield held[0][key], held


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each bucket: the places of the hashes that have an anchor and stand in two tasks' texts."""
    for _, rows in _grouped(batches, "bucket"):
        out = [(r["chunk"], r["base"], r["kind"], r["payload"], r["ids"], r["parts"], r["firsts"]) for r in rows if r["kind"] != ENTRIES]
        rows = [r for r in rows if r["kind"] == ENTRIES]
        if len(rows) > 1:
            entries = np.frombuffer(b"".join(r["payload"] for r in rows), dtype=U64)
            source = np.repeat(np.arange(len(rows)), [len(r["payload"]) // 8 for r in rows])
            order = np.argsort(entries)
            entries, source = entries[order], source[order]
            first, run_of = _groups(entries >> U64(24))
            anchored = np.maximum.reduceat(entries & U64(1), first) > 0
            several = np.diff(np.append(first, len(entries))) > 1
            hit = (anchored & several)[run_of]
            source, places = source[hit], ((entries[hit] >> U64(1)) & U64(SPAN - 1)).astype(np.int64)
            order = np.argsort(source, kind="stable")
            source, places = source[order], places[order]
            if len(source):
                out += [(rows[k]["chunk"], rows[k]["base"], PLACES, (places[s] + rows[k]["base"]).tobytes(), [], [], []) for k, s in _slices(source)]
        if out:
            yield _rows(_REPLY_ARROW, out)


def _to_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places in a task's texts become places in documents."""
    for _, rows in _grouped(batches, "chunk"):
        table = next((r for r in rows if r["kind"] == DOCUMENTS), None)
        places = [np.frombuffer(r["payload"], dtype=np.int64) for r in rows if r["kind"] == PLACES]
        if table is None or not places:
            continue
        places, first = np.unique(np.concatenate(places)), np.array(table["firsts"])
        doc = np.searchsorted(first, places, side="right") - 1
        out = []
        for d, s in _slices(doc):
            size = int(first[d + 1] - first[d])
            flags = np.zeros(size, dtype=bool)
            flags[places[s] - first[d]] = True
            out.append((table["ids"][d], table["parts"][d], size.to_bytes(8, "little") + np.packbits(flags).tobytes()))
        yield _rows(_FLAGS_ARROW, out)


def _merge_flags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each text, from what its copies in several tasks were told; rows are sorted by doc_id and part."""
    key, flags = None, b""
    for batch in batches:
        out = []
        for doc, part, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if key == (doc, part):
                both = np.frombuffer(flags, dtype=np.uint8, offset=8) | np.frombuffer(data, dtype=np.uint8, offset=8)
                flags = flags[:8] + both.tobytes()
                continue
            if key is not None:
                out.append((*key, flags))
            key, flags = (doc, part), data
        if out:
            yield _rows(_FLAGS_ARROW, out)
    if key is not None:
        yield _rows(_FLAGS_ARROW, [(*key, flags)])


def _extend(n: int):
    """Full windows around hits: one row for each bucket, with what could be settled here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            batch = _by_id(batch)
            ids, parts = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "part"))
            block = Words(batch.column("text").cast(pa.binary()).to_pylist(), NOT_SPACE, lower=False)
            near = np.zeros(len(block) + WINDOW, dtype=bool)
            for d, data in enumerate(batch.column("flags").to_pylist()):
                a, size = block.first[d], block.counts[d]
                near[a : a + size] |= np.unpackbits(np.frombuffer(data, dtype=np.uint8, offset=8), count=size).astype(bool)
            # A document told one place of each hash; its other places of that hash are hits as well.
            short = block.rolling(BLOCK)
            near[: len(block)] = np.isin(short, np.unique(short[near[: len(block)]])) & block.valid(BLOCK)
            wanted = near[: len(block)].copy()
            for k in range(1, WINDOW - BLOCK + 1):
                wanted |= near[k : len(block) + k]
            at = np.flatnonzero(wanted & block.valid(WINDOW))
            if not len(at):
                continue
            high = block.rolling(WINDOW)[at]
            low = (block.rolling(WINDOW, seed=2)[at] >> U64(32)).astype(np.uint32)
            order = np.lexsort((at, low, high))
            high, low, at = high[order], low[order], at[order]
            fresh = np.ones(len(at), dtype=bool)
            fresh[1:] = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
            first = np.flatnonzero(fresh)
            run_of = np.cumsum(fresh) - 1
            doc, place = block.doc[at], block.place()[at]
            smallest = ids[doc[first]][run_of]
            later = ids[doc] > smallest
            # A document that is the smallest here sends each of its windows of a hash: all fall together.
            keep = ~later
            bucket = _bucket(high, n)
            out = []
            for b, s in _slices(bucket):
                k, r = np.flatnonzero(keep[s]) + s.start, np.flatnonzero(later[s]) + s.start
                k = k[np.argsort(at[k], kind="stable")]
                owners, counts = np.unique(doc[k], return_counts=True)
                repeats = np.stack([ids[doc[r]], parts[doc[r]], place[r]]).astype(np.int64)
                out.append((b, ids[owners].tolist(), parts[owners].tolist(), counts.tolist(), high[k].tobytes(), low[k].tobytes(), place[k].astype(np.uint32).tobytes(), repeats.tobytes()))
            yield _rows(_FULL_ARROW, out)

    return run


def _repeated(n: int):
    """The windows whose words start in a smaller document too: one row for each block of documents."""

    def later(rows: list[dict]) -> list[np.ndarray]:
        high = np.frombuffer(b"".join(r["high"] for r in rows), dtype=U64)
        low = np.frombuffer(b"".join(r["low"] for r in rows), dtype=np.uint32)
        place = np.frombuffer(b"".join(r["places"] for r in rows), dtype=np.uint32).astype(np.int64)
        doc, part = _repeat(rows)
        order = np.lexsort((doc, low, high))
        high, low, place, doc, part = high[order], low[order], place[order], doc[order], part[order]
        fresh = np.ones(len(high), dtype=bool)
        fresh[1:] = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
        found = doc > doc[np.flatnonzero(fresh)][np.cumsum(fresh) - 1] if len(doc) else np.zeros(0, dtype=bool)
        settled = np.concatenate([np.frombuffer(r["repeats"], dtype=np.int64).reshape(3, -1) for r in rows], axis=1)
        return [np.concatenate([x[found], y]) for x, y in zip((doc, part, place), settled, strict=True)]

    def rows_of(waiting: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        doc, part, place = (np.concatenate(x) for x in zip(*waiting, strict=True))
        if not len(doc):
            return
        block = (mix(doc) % U64(n)).astype(np.int64)
        order = np.lexsort((place, part, doc, block))
        doc, part, place, block = doc[order], part[order], place[order], block[order]
        out = []
        for b, s in _slices(block):
            first = _texts(doc[s], part[s])
            counts = np.diff(np.append(first, len(doc[s])))
            out.append((b, doc[s][first].tolist(), part[s][first].tolist(), counts.tolist(), place[s].astype(np.uint32).tobytes()))
        yield _rows(_BLOCK_ARROW, out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = [], 0
        for _, rows in _grouped(batches, "bucket"):
            waiting.append(later(rows))
            size += len(waiting[-1][0])
            if size > 2_000_000:
                yield from rows_of(waiting)
                waiting, size = [], 0
        if waiting:
            yield from rows_of(waiting)

    return run


def _by_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All repeated windows of each document of a block."""
    for _, rows in _grouped(batches, "block"):
        doc, part = _repeat(rows)
        place = np.frombuffer(b"".join(r["starts"] for r in rows), dtype=np.uint32)
        order = np.lexsort((part, doc))
        doc, part, place = doc[order], part[order], place[order]
        first = _texts(doc, part)
        cuts = zip(first.tolist(), [*first[1:].tolist(), len(doc)], strict=True)
        yield _rows(_START_ARROW, [(int(doc[a]), int(part[a]), np.unique(place[a:b]).tobytes()) for a, b in cuts])


def repeated_windows(docs: DataFrame) -> DataFrame:
    """doc_id, part and starts (unsigned 32-bit word indexes) of each text: the windows that repeat a smaller document's."""
    n = buckets(docs)
    texts = _parted(docs)
    dealt = texts.mapInArrow(_probe(4 * n), _ENTRY).repartition(n, "bucket").sortWithinPartitions("bucket")
    replies = dealt.mapInArrow(_answer, _REPLY).repartition(n, "chunk").sortWithinPartitions("chunk")
    told = replies.mapInArrow(_to_documents, _FLAGS).repartition(n, "doc_id").sortWithinPartitions("doc_id", "part")
    flags = save(told.mapInArrow(_merge_flags, _FLAGS), "anchor-hits")
    full = texts.join(merged(flags), ["doc_id", "part"]).mapInArrow(_extend(4 * n), _FULL).repartition(n, "bucket").sortWithinPartitions("bucket")
    blocks = full.mapInArrow(_repeated(n), _BLOCK_ROWS).repartition(n, "block").sortWithinPartitions("block")
    return save(blocks.mapInArrow(_by_document, _START), "anchor-repeats")


def _cover(size: int, starts: bytes) -> np.ndarray:
    places = np.frombuffer(starts, dtype=np.uint32).astype(np.int64)
    places = places[places + WINDOW <= size]
    edge = np.zeros(size + 1, dtype=np.int64)
    np.add.at(edge, places, 1)
    np.add.at(edge, places + WINDOW, -1)
    return np.cumsum(edge[:size]) > 0


def remaining_words(text: bytes, starts: bytes | None) -> tuple[int, list[bytes]]:
    """The number of words and those that stay."""
    words = text.split()
    if not starts or not words:
        return len(words), words
    gone = _cover(len(words), starts)
    return len(words), [w for w, g in zip(words, gone.tolist(), strict=True) if not g]


def deduplicate(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and the digest of the words that stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            out = []
            for doc, text, starts in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "starts")), strict=True):
                size, kept = remaining_words(text.encode(), starts)
                out.append((doc, size, size - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
            yield _rows(_RESULT_ARROW, out)

    return _parted(docs).join(merged(repeated_windows(docs)), ["doc_id", "part"], "left").mapInArrow(run, _RESULT)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id and the text of the words that stay, joined by one space."""
    schema, arrow = arrow_schema("doc_id long, text string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            rows = zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "starts")), strict=True)
            yield _rows(arrow, [(doc, b" ".join(remaining_words(text.encode(), starts)[1]).decode()) for doc, text, starts in rows])

    return _parted(docs).join(merged(repeated_windows(docs)), ["doc_id", "part"], "left").mapInArrow(run, schema)


def brute_force(rows: list[tuple[int, str | None]]) -> list[tuple[int, int, int, str]]:
    """The same rows by a dictionary of all windows; for tests."""
    first: dict[tuple[bytes, ...], int] = {}
    words = [(d, (t or "").encode().split()) for d, t in rows]
    for d, w in sorted(words, key=lambda x: x[0]):
        for k in range(len(w) - WINDOW + 1):
            first.setdefault(tuple(w[k : k + WINDOW]), d)
    out = []
    for d, w in words:
        gone = [False] * len(w)
        for k in range(len(w) - WINDOW + 1):
            if first[tuple(w[k : k + WINDOW])] < d:
                gone[k : k + WINDOW] = [True] * WINDOW
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        out.append((d, len(w), len(w) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return out
