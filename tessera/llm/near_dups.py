"""Near-duplicate detection with SetSketch registers.

A document's set holds its distinct word shingles (A-Z in lower case; with fewer words, the whole sequence as one), as
64-bit hashes.  Register k is the truncated exponential rank ``floor(1 - log_B(x_k))`` of the smallest of the elements'
k-th exponential variates, so registers merge by maximum and are locality-sensitive.

1. Documents of equal sets are one *class*, represented by its smallest doc_id (hashes of whole sets, 128 bits).
2. ``BANDS`` bands of ``ROWS`` registers deal representatives into buckets.  Two sets of Jaccard similarity 0.8 share
   no bucket with probability (1 - 0.8**ROWS) ** BANDS, below 1e-9.
3. In each bucket all are compared with the smallest one (a star, never all pairs), on full sets: first with the
   smallest of a document's centres, then with the others as far as components still differ.
4. A bucket that still holds several components has a *main* one, the largest, and *outsiders*.  Where there are at
   most ``TILE`` outsiders they meet each other and parts of at most ``TILE`` members of the main component, so rows grow
   with the bucket.  A bucket of more outsiders is dealt again by further bands (``BRANCHES`` of them, so that two
   sets of similarity 0.8 part everywhere with probability below 2e-4 at any depth), level by level, down to
   buckets of few outsiders.  Buckets that no band is left for are compared in full, tile by tile.
5. In a tile, the registers' joint likelihood estimates the similarity; pairs not clearly below 0.8 are confirmed on
   the full sets, and links are closed to components.

No bucket, group or component is ever gathered in one task or on the driver: counts are pre-aggregated, members of a
centre are salted by the size of their buckets, and joins back are between written tables, which adaptive execution
can split.  A tile holds at most about ``TILE`` rows and ``TILE_ELEMENTS`` elements a side.

Null and empty texts have an empty set and link with nothing; repeated rows are members of one class.  A doc_id on
rows of different texts is one node: every row has its own n_shingles and the component of its text's class, and
classes of the same smallest doc_id are tied.  Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.components import connected_components
from tessera.llm.shared import arrow_schema, buckets, chunks, merged, save, text_columns
from tessera.llm.words import NOT_SPACE, U64, Words, mix

SHINGLE = 2
BANDS, ROWS = 40, 4
REGISTERS = BANDS * ROWS
#: Base of the registers' scale, rate of the variates, and the largest register.
B, RATE, TOP = 1.001, 20.0, 65_535
#: A pair whose estimate is below this (five deviations under 0.8) isn't confirmed on full sets.
LEAST_ESTIMATE = 0.62
#: Members of a centre that are confirmed together; rows and elements of a tile's side.
STAR, TILE, TILE_ELEMENTS = 64, 512, 4_000_000
#: Further bands by which a bucket of many outsiders is dealt again, and how often at most.
BRANCHES, DEPTH = 3, 12

_FACTORS = mix(np.arange(1, REGISTERS + 1).astype(U64)) | U64(1)
_SHIFTS = mix(np.arange(1001, REGISTERS + 1001).astype(U64))
_GRID = np.linspace(0, 1, 101)

_SKETCH, _SKETCH_ARROW = arrow_schema("doc_id long, n long, key1 long, key2 long, registers binary")
_BAND, _BAND_ARROW = arrow_schema("bucket long, band int, id long, n long")
_SETS, _SETS_ARROW = arrow_schema("id long, elements binary")
_REST, _REST_ARROW = arrow_schema("bucket long, band int, used long, id long, n long, root long, deep long, registers binary")
_TILE, _TILE_ARROW = arrow_schema("bucket long, tile_a int, tile_b int, side int, band int, used long, id long, n long, root long, deep long, registers binary")
_LINK, _LINK_ARROW = arrow_schema("a long, b long")


def shingle_sets(texts: list[bytes], shingle: int = SHINGLE) -> list[np.ndarray]:
    """Each text's set of shingle hashes, sorted."""
    block = Words(texts, NOT_SPACE, lower=True)
    h, ok = block.rolling(shingle), block.valid(shingle)
    short = {k: block.rolling(k) for k in np.unique(block.counts[(block.counts > 0) & (block.counts < shingle)]).tolist()}
    out = []
    for a, b in zip(block.first[:-1].tolist(), block.first[1:].tolist(), strict=True):
        out.append(np.unique(h[a:b][ok[a:b]]) if b - a >= shingle else short[b - a][a : a + 1] if b > a else h[:0])
    return out


def sketch(sets: list[np.ndarray]) -> np.ndarray:
    """Registers of sets that aren't empty, one row each."""
    elements = np.concatenate(sets)
    cuts = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1]))
    least = np.empty((len(sets), REGISTERS), dtype=U64)
    for k in range(REGISTERS):
        least[:, k] = np.minimum.reduceat(elements * _FACTORS[k] + _SHIFTS[k], cuts)
    variates = -np.log1p(-np.minimum(least.astype(np.float64) / 2.0**64, 1 - 2.0**-53)) / RATE
    ranks = np.floor(1 - np.log(np.maximum(variates, 1e-300)) / math.log(B)) + TOP // 4
    return np.clip(ranks, 0, TOP).astype(np.uint16)


def band_keys(registers: np.ndarray) -> np.ndarray:
    """A 64-bit bucket for each band of each row."""
    parts = registers.reshape(len(registers), BANDS, ROWS).astype(U64)
    acc = np.broadcast_to(np.arange(BANDS, dtype=U64) + U64(77), parts.shape[:2]).copy()
    for k in range(ROWS):
        acc = mix(acc * U64(0x9E3779B97F4A7C15) + parts[:, :, k])
    return acc.view(np.int64)


def estimate(one: np.ndarray, many: np.ndarray, n_one: int, n_many: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity from the counts of larger, smaller and equal registers and the sizes."""
    larger, smaller = (one > many).sum(axis=1), (one < many).sum(axis=1)
    equal = many.shape[1] - larger - smaller
    u = (n_one / (n_one + n_many))[:, None]
    v = 1 - u

    def chance(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(x, 1e-12, 1) * (B - 1) / B) / math.log(B)

    above, below = chance(u - v * _GRID), chance(v - u * _GRID)
    total = larger[:, None] * np.log(above) + smaller[:, None] * np.log(below) + equal[:, None] * np.log(np.maximum(1 - above - below, 1e-12))
    total[_GRID[None, :] > np.minimum(u / v, v / u) + 1e-9] = -np.inf
    return _GRID[total.argmax(axis=1)]


def linked(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether 100 * intersection >= 80 * union, on full sets."""
    if 100 * min(len(x), len(y)) < 80 * max(len(x), len(y)):
        return False
    both = np.concatenate([x, y])
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= 80 * (len(both) - shared)


def sketches(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, the set's size, its 128-bit key and its registers (none for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            sets = shingle_sets(batch.column("text").cast(pa.binary()).to_pylist(), shingle)
            keys = np.array([np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), dtype=np.int64) for s in sets])
            full = [s for s in sets if len(s)]
            rows = iter(sketch(full) if full else ())
            columns = [
                batch.column("doc_id"),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array(keys[:, 0]),
                pa.array(keys[:, 1]),
                pa.array([next(rows).tobytes() if len(s) else None for s in sets], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, schema=_SKETCH_ARROW)

    return text_columns(docs).mapInArrow(run, _SKETCH)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint16).reshape(-1, REGISTERS)


def _numbers(batch: pa.RecordBatch, *names: str) -> Iterator[np.ndarray]:
    return (batch.column(c).to_numpy(zero_copy_only=False) for c in names)


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        ids, sizes = _numbers(batch, "id", "n")
        columns = [band_keys(_matrix(batch.column("registers"))).ravel(), np.tile(np.arange(BANDS, dtype=np.int32), len(ids)), np.repeat(ids, BANDS), np.repeat(sizes, BANDS)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=_BAND_ARROW)


def _deal_again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row once for each of ``BRANCHES`` bands that its bucket hasn't used, in a bucket of that band's registers."""
    for batch in batches:
        if not batch.num_rows:
            continue
        bucket, band, used = _numbers(batch, "bucket", "band", "used")
        used = used | (np.int64(1) << band.astype(np.int64))
        keys = band_keys(_matrix(batch.column("registers"))).view(U64)
        # The order of bands depends on the bucket alone, so that all its members take the same.
        order = mix(bucket.view(U64)[:, None] + np.arange(1, BANDS + 1, dtype=U64)[None, :]) >> U64(1)
        order[(used[:, None] >> np.arange(BANDS)) & 1 == 1] = U64(1) << U64(63)
        for k in range(BRANCHES):
            pick = np.argpartition(order, k, axis=1)[:, k]
            row = np.flatnonzero(np.take_along_axis(order, pick[:, None], 1)[:, 0] < U64(1) << U64(63))
            if len(row):
                part, pick = batch.take(pa.array(row)), pick[row]
                fresh = mix(mix(bucket.view(U64)[row]) + keys[row, pick]).view(np.int64)
                part = part.set_column(part.schema.get_field_index("bucket"), "bucket", pa.array(fresh))
                part = part.set_column(part.schema.get_field_index("used"), "used", pa.array(used[row] | (np.int64(1) << pick.astype(np.int64))))
                yield pa.RecordBatch.from_arrays([part.column(f.name) for f in _REST_ARROW], schema=_REST_ARROW)


def _set_rows(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            sets = shingle_sets(batch.column("text").cast(pa.binary()).to_pylist(), shingle)
            columns = [batch.column("doc_id"), pa.array([s.tobytes() for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, schema=_SETS_ARROW)

    return run


def _registers(rows: list[dict]) -> np.ndarray:
    return np.frombuffer(b"".join(r["registers"] for r in rows), dtype=np.uint16).reshape(len(rows), REGISTERS)


def _elements(row: dict) -> np.ndarray:
    return np.frombuffer(row["elements"], dtype=U64)


def _groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[list[dict]]:
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and any(held[0][k] != row[k] for k in keys):
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _confirm_stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (center, salt, role): the centre's own rows, then its members, one by one."""
    of, centers = None, []
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if row["role"] == 0:
                centers = [*(centers if of == (row["center"], row["salt"]) else []), _elements(row)]
                of = (row["center"], row["salt"])
            elif any(linked(x, _elements(row)) for x in centers):
                out.append((row["center"], row["id"]))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], schema=_LINK_ARROW)


def _meeting(mine: np.ndarray, row: dict, theirs: np.ndarray) -> np.ndarray:
    """The rows that meet ``row`` here and nowhere else; bands are compared as one number each.

    Two documents that share a bucket of few outsiders meet in the first such bucket; others meet wherever they are
    dealt together again.  ``deep`` tells the bands of a document whose buckets are dealt again.
    """
    shared = mine.view(U64) == theirs.view(U64)
    if row["deep"]:
        shared &= (row["deep"] >> np.arange(BANDS)) & 1 == 0
    if row["used"]:
        return np.flatnonzero(~shared.any(axis=1))
    return np.flatnonzero(shared.argmax(axis=1) == row["band"])


def _tiles(batches: Iterator[pa.RecordBatch], estimated: bool) -> Iterator[tuple[list[dict], list[dict], list[list[int]]]]:
    """Near rows and other rows of each tile, and for each near row the others that may be linked, likeliest first.

    Near rows are outsiders.  In the first tile of each part of them they also meet each other.  A pair may be linked if
    sizes allow it, half of the registers are equal, components differ and, if asked for, its estimate allows it.
    """
    for rows in _groups(batches, ("bucket", "tile_a", "tile_b")):
        near = [r for r in rows if r["side"] == 0]
        if not near:
            continue
        far = [*(near if rows[0]["tile_b"] == 0 else []), *(r for r in rows if r["side"] == 1)]
        theirs, sizes = _registers(far), np.array([r["n"] for r in far])
        roots = np.array([r["root"] for r in far])
        found = []
        for k, (row, mine) in enumerate(zip(near, _registers(near), strict=True)):
            fits = (100 * np.minimum(sizes, row["n"]) >= 80 * np.maximum(sizes, row["n"])) & (roots != row["root"])
            if rows[0]["tile_b"] == 0:
                fits[: k + 1] = False
            at = np.flatnonzero(fits)
            if len(at):
                at = at[_meeting(mine, row, theirs[at])]
            if len(at):
                equal = (mine == theirs[at]).sum(axis=1)
                at, equal = at[equal >= REGISTERS // 2], equal[equal >= REGISTERS // 2]
                at = at[np.argsort(-equal, kind="stable")]
            if len(at) and estimated:
                at = at[estimate(mine, theirs[at], row["n"], sizes[at]) >= LEAST_ESTIMATE]
            found.append(at.tolist())
        yield near, far, found


def _screen_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each tile that are part of a pair that may be linked."""
    for near, far, found in _tiles(batches, True):
        wanted = {id(r): r for r, at in zip(near, found, strict=True) if at} | {id(far[k]): far[k] for at in found for k in at}
        if wanted:
            rows = wanted.values()
            yield pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in rows], f.type) for f in _TILE_ARROW], schema=_TILE_ARROW)


def _confirm_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between components, on full sets; once two components are linked, their other pairs are passed over."""
    for near, far, found in _tiles(batches, False):
        parent: dict[int, int] = {}

        def find(x: int, parent=parent) -> int:
            while parent.setdefault(x, x) != x:
                x = parent[x]
            return x

        out = []
        for row, at in zip(near, found, strict=True):
            for other in (far[k] for k in at):
                if find(row["root"]) != find(other["root"]) and linked(_elements(row), _elements(other)):
                    parent[find(row["root"])] = find(other["root"])
                    out.append((row["root"], other["root"]))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], schema=_LINK_ARROW)


def _confirmed(pairs: DataFrame, sets: DataFrame, n: int) -> DataFrame:
    """The pairs (center, id) that are linked: each centre's set goes once to each part of its members that has any."""
    salt = F.pmod(F.xxhash64("id"), F.ceil(F.col("size") / STAR)).alias("salt")
    both = F.array(F.struct(F.col("center").alias("id"), F.lit(0).alias("role")), F.struct("id", F.lit(1).alias("role")))
    rows = pairs.select("center", salt, F.explode(both).alias("row")).select("center", "salt", "row.id", "row.role").distinct()
    rows = rows.join(merged(sets), "id")
    rows = rows.repartition(n, "center", "salt").sortWithinPartitions("center", "salt", "role")
    return rows.mapInArrow(_confirm_stars, _LINK)


def _mixed(rows: DataFrame) -> DataFrame:
    """Buckets of several components: the largest one, and the rows and elements in it (far) and outside (near)."""
    parts = rows.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("elements"))
    main = F.max(F.struct("rows", "root", "elements")).alias("main")
    found = parts.groupBy("bucket").agg(main, F.sum("rows").alias("rows"), F.sum("elements").alias("elements"), F.count(F.lit(1)).alias("parts"))
    return found.where("parts > 1").select(
        "bucket",
        F.col("main.root").alias("main"),
        F.col("main.rows").alias("n_far"),
        F.col("main.elements").alias("e_far"),
        (F.col("rows") - F.col("main.rows")).alias("n_near"),
        (F.col("elements") - F.col("main.elements")).alias("e_near"),
    )


def _deal_tiles(rest: DataFrame) -> DataFrame:
    """The tiles of mixed buckets: each part of the outsiders with each part of the main component, and with later parts."""

    def parts(side: str) -> Column:
        return F.ceil(F.greatest(F.col(f"n_{side}") / TILE, F.col(f"e_{side}") / TILE_ELEMENTS)).cast("int")

    far, near_parts, far_parts = F.col("root") == F.col("main"), parts("near"), parts("far")
    rest = rest.withColumn("part", F.pmod(F.xxhash64("id"), F.when(far, far_parts).otherwise(near_parts)).cast("int"))
    none = F.array().cast("array<struct<side:int,tile_a:int,tile_b:int>>")

    def places(low: Column, high: Column, make: Callable[[Column], tuple[int, Column, Column]]) -> Column:
        spots = F.transform(F.sequence(low, high), lambda k: F.struct(*(x.alias(c) for c, x in zip(("side", "tile_a", "tile_b"), map(F.lit, make(k)), strict=True))))
        return F.when(low <= high, spots).otherwise(none)

    zero, part = F.lit(0), F.col("part")
    with_main = places(zero, far_parts - 1, lambda k: (0, part, k))
    with_later = places(part + 1, near_parts - 1, lambda k: (0, part, -1 - k))
    with_earlier = places(zero, part - 1, lambda k: (1, k, -1 - part))
    of_main = places(zero, near_parts - 1, lambda k: (1, k, part))
    spot = F.explode(F.when(far, of_main).otherwise(F.concat(with_main, with_later, with_earlier))).alias("spot")
    tiles = rest.select(*(c for c in rest.columns if c != "part"), spot)
    return tiles.select(*(F.col(f"spot.{f.name}" if f.name in ("side", "tile_a", "tile_b") else f.name).alias(f.name) for f in _TILE))


def _outsiders(members: DataFrame, classes: DataFrame, sets: DataFrame, roots: DataFrame, n: int) -> DataFrame | None:
    """Links (a, b) between the roots of components that stars left apart; None if no pair needs to be confirmed."""
    # A bucket of two was its own star.
    labelled = members.where("size > 2").join(merged(roots), "id", "left")
    labelled = labelled.select("bucket", "band", "id", "n", F.coalesce("root", "id").alias("root"))
    sizes = ["main", "n_near", "e_near", "n_far", "e_far"]
    rest = save(labelled.join(merged(_mixed(labelled)), "bucket"), "nd-mixed")
    many = F.col("n_near") > TILE
    again = not rest.where(many).isEmpty()
    known = rest.join(merged(classes.select("id", "registers")), "id")
    if again:
        bands = rest.where(many).groupBy("id").agg(F.bit_or(F.expr("shiftleft(1L, band)")).alias("deep"))
        known = known.join(merged(bands), "id", "left").withColumn("deep", F.coalesce("deep", F.lit(0).cast("long")))
    else:
        known = known.withColumn("deep", F.lit(0).cast("long"))
    rest = known.withColumn("used", F.lit(0).cast("long")).select(*_REST.fieldNames(), *sizes)
    rest, level = save(rest, "nd-rest") if again else rest, 0
    ready = [rest.where(~many)]
    while again and level < DEPTH:
        level += 1
        dealt = save(rest.where(many).select(*_REST.fieldNames()).mapInArrow(_deal_again, _REST), "nd-dealt")
        rest = save(dealt.join(merged(_mixed(dealt)), "bucket").select(*_REST.fieldNames(), *sizes), "nd-rest")
        again = not rest.where(many).isEmpty()
        ready.append(rest.where(~many))
    if again:
        ready.append(rest.where(many))
    tiles = _deal_tiles(reduce(DataFrame.unionByName, ready))
    tile = ["bucket", "tile_a", "tile_b"]
    # Registers alone tell which rows of which tiles may have a link; only those get their full sets.
    tiles = save(tiles.repartition(n, *tile).sortWithinPartitions(*tile, "side").mapInArrow(_screen_tiles, _TILE), "nd-tiles")
    if tiles.isEmpty():
        return None
    tiles = tiles.join(merged(sets), "id").repartition(n, *tile).sortWithinPartitions(*tile, "side")
    return save(tiles.mapInArrow(_confirm_tiles, _LINK), "nd-extra-links")


def components(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document."""
    n, keys = buckets(docs), ["key1", "key2"]
    found = save(sketches(docs, shingle), "nd-sketches")
    first = F.min(F.struct("doc_id", "n", "registers")).alias("first")
    classes = found.where("n > 0").groupBy(*keys).agg(first, F.count(F.lit(1)).alias("copies"))
    classes = save(classes.select(*keys, "copies", F.col("first.doc_id").alias("id"), "first.n", "first.registers"), "nd-classes")

    def bands() -> DataFrame:
        return classes.select("id", "n", "registers").mapInArrow(_bands, _BAND)

    grouped = bands().groupBy("bucket").agg(F.min(F.struct("id", "n")).alias("center"), F.count(F.lit(1)).alias("size"))
    members = bands().join(merged(grouped.where("size > 1")), "bucket").select("bucket", "band", "id", "n", F.col("center.id").alias("center"), F.col("center.n").alias("center_n"), "size")
    members = save(members, "nd-members")

    fits = (F.col("id") != F.col("center")) & (F.least("n", "center_n") * 100 >= F.greatest("n", "center_n") * 80)
    stars = members.groupBy("id").agg(F.array_sort(F.collect_set(F.when(fits, F.col("center")))).alias("centers"), F.max("size").alias("size"))
    stars = save(stars, "nd-stars")
    wanted = text_columns(docs).join(merged(stars.select(F.col("id").alias("doc_id"))), "doc_id", "left_semi")
    sets = save(wanted.mapInArrow(_set_rows(shingle), _SETS), "nd-sets")
    # Each member meets the smallest of all its centres first; the other centres only where that left a difference.
    pairs = stars.where(F.size("centers") > 0)
    links = save(_confirmed(pairs.select("id", F.col("centers")[0].alias("center"), "size"), sets, n), "nd-links")
    roots = connected_components(links)
    second = pairs.where(F.size("centers") > 1).select("id", "size", F.explode(F.expr("slice(centers, 2, size(centers))")).alias("center"))
    for key in ("id", "center"):
        named = roots.select(F.col("id").alias(key), F.col("root").alias(f"{key}_root"))
        second = second.join(merged(named), key, "left").withColumn(f"{key}_root", F.coalesce(f"{key}_root", key))
    links = save(_confirmed(second.where("id_root <> center_root"), sets, n), "nd-second-links")
    roots = connected_components(roots.select(F.col("id").alias("a"), F.col("root").alias("b")).union(links))

    of_class = classes.select(*keys, "copies", "id").join(merged(roots), "id", "left").withColumn("root", F.coalesce("root", "id"))
    more = _outsiders(members, classes, sets, roots, n)
    if more is not None:
        named = connected_components(more).select(F.col("id").alias("root"), F.col("root").alias("top"))
        of_class = of_class.join(merged(named), "root", "left").withColumn("root", F.coalesce("top", "root"))
    of_class = of_class.where("copies > 1 or root < id").select(*keys, "root")
    component = F.coalesce("root", "doc_id")
    return found.select("doc_id", "n", *keys).join(merged(of_class), keys, "left").select(
        "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), (component == F.col("doc_id")).alias("kept")
    )


def keep_one(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """The rows of ``docs`` whose document is the smallest of its component; all columns as they were."""
    names = components(docs, shingle).where("kept").select(F.col("doc_id").alias("__kept"))
    return docs.join(names.distinct(), docs["doc_id"] == F.col("__kept"), "left_semi")


def brute_force(texts: dict[int, str | None], shingle: int = SHINGLE) -> dict[int, tuple[int, int, bool]]:
    """The same result from all pairs of sets; for tests."""
    sets = {d: set(s.tolist()) for d, s in zip(texts, shingle_sets([(t or "").encode() for t in texts.values()], shingle), strict=True)}
    root = {d: d for d in sets}

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * min(len(x), len(y)) >= 80 * max(len(x), len(y)) and 100 * len(x & y) >= 80 * len(x | y):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {d: (len(sets[d]), find(d), find(d) == d) for d in ids}
