"""MinHash near-duplicates by a multi-index Hamming join, confirmed on full sets.

A text's set is its distinct five-word shingles. Its signature has
``chunks * chunk_size`` b-bit MinHash values; the distance of two signatures is
the number of places that differ. By pigeonhole, signatures at most
``chunks * (errors + 1) - 1`` apart agree on some chunk but for ``errors``
places, so each chunk is indexed under every choice of ``errors`` places left
out: all pairs under that distance share a key. With 8 chunks of 4 and one
error, that is 15 of 32. Most pairs further apart share a key too, and whatever
shares a key is compared: a pair at a similarity of 0.75 shares none about 2
times in 100,000 (0.2617 to the 8th), the only way to miss it.

Pairs are not listed within a bucket. First each member is compared with its
bucket's most central document and the links form components. Members outside
the bucket's largest component are then compared with a member of it, another in
each bucket. In buckets that still hold two components or more, members of
different components are compared inside tasks, and only edges that join
components leave the task. A task takes a bucket whole up to ``BLOCK_ROWS`` rows
and ``BLOCK_SHINGLES`` shingles; a larger bucket is dealt into blocks of that
size, and each pair of blocks is a group of its own. So groups of copies cost a
comparison a member and yet no link between different components is lost. Every
pair is confirmed on the two full shingle sets, whatever the distance of its
signatures.

Texts with equal sets are one class from the start, so exact copies never meet.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plover.llm import buckets
from plover.llm.graph import Forest, connected_components
from plover.llm.words import WordHashes, mixed, plain_words, shingle_set
from plover.session import materialize

#: A table of ids with at most so many rows (16 bytes each) is broadcast.
BROADCAST_ROWS = 1_000_000
#: What a task holds of a bucket: rows of about 100 bytes, then their shingles of 8 bytes.
BLOCK_ROWS = 1_024
BLOCK_SHINGLES = 2_000_000
#: Sets of so many rows are laid side by side to count what they share.
TILE = 128


def _permutations(size: int) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(20240901)
    return draw.integers(0, 2**63, size, dtype=np.uint64) * 2 + 1, draw.integers(0, 2**63, size, dtype=np.uint64)


def _signature(shingles: np.ndarray, times: np.ndarray, plus: np.ndarray) -> bytes:
    least = np.full(len(times), np.uint64(2**64 - 1))
    for at in range(0, len(shingles), 512):  # keeps the products within the cache
        part = shingles[at : at + 512]
        np.minimum(least, (part[None, :] * times[:, None] + plus[:, None]).min(axis=1), out=least)
    return (mixed(least) >> np.uint64(48)).astype("<u2").tobytes()


def _sketch(width: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, (times, plus) = WordHashes(), _permutations(size)
        for batch in batches:
            counts, keys, signatures = [], [], []
            for text in batch.column(1):
                shingles = shingle_set(hashes.of(plain_words(text.as_py())), width)
                counts.append(len(shingles))
                keys.append(hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None)
                signatures.append(_signature(shingles, times, plus) if len(shingles) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(keys, pa.binary()), pa.array(signatures, pa.binary())],
                ["id", "n", "set_key", "signature"],
            )

    return run


def _shingles(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                sets = [shingle_set(hashes.of(plain_words(text.as_py())), width).view(np.int64) for text in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], ["id", "shingles"])

    return run


def _chunk_keys(chunks: int, chunk_size: int) -> F.Column:
    """For one error: a key for each chunk and each of its places left out."""
    keys = []
    for c in range(chunks):
        for o in range(chunk_size):
            before = F.substring("signature", 2 * chunk_size * c + 1, 2 * o)
            after = F.substring("signature", 2 * (chunk_size * c + o + 1) + 1, 2 * (chunk_size - o - 1))
            keys.append(F.xxhash64(F.lit(c * chunk_size + o), before, after))
    return F.array(*keys)


def _crossing(group: pa.Table, size: int, chunk_size: int, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of groups to confirm: of different components and not too unequal in size.

    Rows of a key's largest component aren't compared with each other. A pair
    that shares several keys counts under the first only, which its two
    signatures tell.
    """
    comp, n, slot, keys, block = (group.column(c).to_numpy() for c in ("component", "n", "slot", "pair_key", "block"))
    alone, inner = (group.column(c).to_numpy(zero_copy_only=False) for c in ("alone", "inner"))
    signatures = np.frombuffer(b"".join(group.column("signature").to_pylist()), "<u2").reshape(-1, size)
    for i, j in buckets.group_pairs(keys, block, alone, inner):
        small, large = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
        keep = (comp[i] != comp[j]) & (100 * small >= percent * large)
        i, j = i[keep], j[keep]
        equal = (signatures[i] == signatures[j]).reshape(len(i), size // chunk_size, chunk_size)
        wrong = chunk_size - equal.sum(axis=2)
        chunk = (wrong <= 1).argmax(axis=1)
        left_out = equal[np.arange(len(i)), chunk].argmin(axis=1)
        keep = chunk * chunk_size + left_out == slot[i]
        if keep.any():
            yield i[keep], j[keep]


def _survivors(size: int, chunk_size: int, percent: int):
    """The rows of each group that are in some pair to confirm."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in buckets.whole_groups(batches):
            hit = np.zeros(group.num_rows, bool)
            for i, j in _crossing(group, size, chunk_size, percent):
                hit[i] = hit[j] = True
            yield from group.filter(pa.array(hit)).to_batches()

    return run


def _overlaps(sets: list[np.ndarray], rows: np.ndarray, wide: int = 20_000) -> np.ndarray:
    """Sizes of the intersections of every two of the chosen sets."""
    where = np.repeat(np.arange(len(rows)), [len(sets[r]) for r in rows])
    _, column, times = np.unique(np.concatenate([sets[r] for r in rows]), return_inverse=True, return_counts=True)
    keep = times[column] > 1  # others add nothing to an intersection
    _, column = np.unique(column[keep], return_inverse=True)
    where, out = where[keep], np.zeros((len(rows), len(rows)), np.float32)
    for at in range(0, int(column.max(initial=-1)) + 1, wide):
        some = (column >= at) & (column < at + wide)
        held = np.zeros((len(rows), wide), np.float32)
        held[where[some], column[some] - at] = 1
        out += held @ held.T
    return out


def _tiles(i: np.ndarray, j: np.ndarray) -> Iterator[np.ndarray]:
    """Places of the pairs (i, j), a tile of ``TILE`` rows by ``TILE`` rows at a time."""
    rows, place = np.unique(np.r_[i, j], return_inverse=True)
    across = -(-len(rows) // TILE)
    tile = place[: len(i)] // TILE * across + place[len(i) :] // TILE
    order = np.argsort(tile, kind="stable")
    yield from np.split(order, np.flatnonzero(np.diff(tile[order])) + 1)


def _cross_links(size: int, chunk_size: int, percent: int):
    """Edges that join what is linked among the pairs to confirm, by their full sets.

    Pairs whose components have met in the task already are passed by.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for many in buckets.whole_groups(batches, rows=512):
            joined = Forest()
            pairs = list(_crossing(many, size, chunk_size, percent))
            if not pairs:
                continue
            i, j = (np.concatenate(x) for x in zip(*pairs, strict=True))
            sets = [x.values.to_numpy() for x in many.column("shingles").combine_chunks()]
            comp, n = many.column("component").to_numpy(), many.column("n").to_numpy()
            for tile in _tiles(i, j):
                apart = [joined.find(a) != joined.find(b) for a, b in zip(comp[i[tile]].tolist(), comp[j[tile]].tolist(), strict=True)]
                x, y = i[tile][apart], j[tile][apart]
                if not len(x):
                    continue
                rows, place = np.unique(np.r_[x, y], return_inverse=True)
                common = _overlaps(sets, rows)[place[: len(x)], place[len(x) :]].astype(np.int64)
                keep = 100 * common >= percent * (n[x] + n[y] - common)
                for a, b in zip(comp[x[keep]].tolist(), comp[y[keep]].tolist(), strict=True):
                    joined.join(a, b)
            nodes, roots = joined.edges()
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(roots, pa.int64())], ["a", "b"])

    return run


def _main_components(placed: DataFrame) -> DataFrame:
    """Per key that holds two components or more: the largest one, its rows and shingles and those of all."""
    parts = placed.groupBy(F.col("key").alias("k"), F.col("component").alias("c")).agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("shingles"))
    keys = parts.groupBy("k").agg(F.sum("rows").alias("all_rows"), F.sum("shingles").alias("all_shingles"), F.max(F.struct("rows", "c", "shingles")).alias("top"), F.count(F.lit(1)).alias("parts"))
    return keys.filter("parts > 1").select("k", F.col("top.c").alias("main"), F.col("top.rows").alias("main_rows"), F.col("top.shingles").alias("main_shingles"), "all_rows", "all_shingles")


def _second_stars(placed: DataFrame) -> DataFrame:
    """Members outside a key's largest component with one member of it, drawn by hash anew for each key."""
    rows = placed.join(_main_components(placed), F.col("key") == F.col("k"))
    inside = rows.filter("component = main").groupBy(F.col("key").alias("p_key")).agg(F.min_by("id", F.xxhash64("key", "id")).alias("pivot"))
    met = rows.filter("component <> main").select("key", "id").join(inside, F.col("key") == F.col("p_key"))
    return met.select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b")).distinct()


def _cross_blocks(placed: DataFrame, block_rows: int = BLOCK_ROWS, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """Rows of keys that hold two components or more, once for each pair of blocks to compare.

    In each key, the component with the most members needs no comparison with
    itself: its blocks meet only those of the others, and the others' blocks
    meet all. So the cost follows the members outside the largest component. A
    key of one block is one group.
    """
    blocks = lambda rows, shingles: F.greatest(F.ceil(rows / block_rows), F.ceil(shingles / block_shingles)).cast("int")
    top = _main_components(placed).withColumn("single", blocks(F.col("all_rows"), F.col("all_shingles")) == 1)
    keys = top.select(
        "k", "main", F.when(F.col("single"), 0).otherwise(blocks(F.col("main_rows"), F.col("main_shingles"))).alias("inner_blocks"),
        F.when(F.col("single"), 1).otherwise(blocks(F.col("all_rows") - F.col("main_rows"), F.col("all_shingles") - F.col("main_shingles"))).alias("outer_blocks"),
    )
    rows = placed.join(keys, F.col("key") == F.col("k")).withColumn("inner", F.col("component") == F.col("main"))
    spread, apart = F.xxhash64("id"), F.col("inner") & (F.col("inner_blocks") > 0)
    rows = rows.withColumn("block", F.when(apart, F.col("outer_blocks") + F.pmod(spread, F.greatest("inner_blocks", F.lit(1)))).otherwise(F.pmod(spread, F.col("outer_blocks"))).cast("int"))
    others = F.when(apart, F.col("outer_blocks")).otherwise(F.col("outer_blocks") + F.col("inner_blocks"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), others - 1)))
    rows = rows.withColumn("pair_key", F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other"))).withColumn("alone", F.col("block") == F.col("other"))
    return rows.select("id", "component", "slot", "pair_key", "block", "alone", "inner")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are similar on their full sets."""
    one = sets.select(F.col("id").alias("a"), F.col("shingles").alias("x"))
    two = sets.select(F.col("id").alias("b"), F.col("shingles").alias("y"))
    met = pairs.join(one, "a").join(two, "b")
    common = F.size(F.array_intersect("x", "y"))
    return met.filter(100 * common >= percent * (F.size("x") + F.size("y") - common)).select("a", "b")


def near_duplicates(
    docs: DataFrame,
    percent: int = 75,
    width: int = 5,
    chunks: int = 8,
    chunk_size: int = 4,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Per document row: doc_id, n_shingles, component_id, kept.

    Texts are linked if their sets' intersection is at least ``percent``
    hundredths of the union. ``component_id`` is the least document reachable
    by links, ``kept`` marks that document. A null, empty or blank text has no
    set and is a component of its own. Rows that repeat a document with the same
    id and text count once each. Other columns are ignored.
    """
    size = chunks * chunk_size
    named = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sketch = materialize(named.mapInArrow(_sketch(width, size), "id long, n long, set_key binary, signature binary"), "sketch")
    classes = sketch.filter("set_key is not null").groupBy("set_key").agg(F.min("id").alias("id"), F.min("n").alias("n"), F.min("signature").alias("signature"))
    classes = materialize(classes, "classes")

    keyed = classes.select("id", "n", F.posexplode(_chunk_keys(chunks, chunk_size)).alias("slot", "key"))
    crowded = keyed.groupBy(F.col("key").alias("k")).agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    shared = materialize(keyed.join(crowded, F.col("key") == F.col("k")).select("key", "slot", "id", "n", "members"), "shared")
    # The most central member: the one whose keys are shared the most.
    central = shared.groupBy(F.col("id").alias("c_id")).agg(F.sum("members").alias("central"))
    ranked = shared.join(central, F.col("id") == F.col("c_id"))
    pivots = ranked.groupBy(F.col("key").alias("k")).agg(F.max(F.struct("central", (-F.col("id")).alias("minus"))).alias("top")).select("k", (-F.col("top.minus")).alias("pivot"))
    stars = shared.join(pivots, F.col("key") == F.col("k")).filter("id <> pivot").select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b")).distinct()

    part = classes.select(F.col("id").alias("part_id"), "n", "signature")
    one = part.select(F.col("part_id").alias("a"), F.col("n").alias("n1"))
    two = part.select(F.col("part_id").alias("b"), F.col("n").alias("n2"))
    unlike = 100 * F.least("n1", "n2") < percent * F.greatest("n1", "n2")

    involved = materialize(shared.select("id").distinct(), "involved")
    chosen = F.broadcast(involved) if involved.count() <= BROADCAST_ROWS else involved
    sets = materialize(named.join(chosen, "id", "left_semi").dropDuplicates(["id"]).mapInArrow(_shingles(width), "id long, shingles array<long>"), "sets")

    def confirmed(pairs: DataFrame) -> DataFrame:
        near = pairs.join(one, "a").join(two, "b").filter(~unlike).select("a", "b")
        return materialize(_confirmed(near, sets, percent), "links")

    def placed_by(joined: DataFrame) -> DataFrame:
        rows = shared.join(joined, F.col("id") == F.col("node"), "left").select("key", "slot", "id", "n", F.coalesce("component", "id").alias("component"))
        return materialize(rows, "placed")

    links = confirmed(stars)
    links = links.unionByName(confirmed(_second_stars(placed_by(connected_components(links)))))
    placed = placed_by(connected_components(links))
    blocks = _cross_blocks(placed).join(part, F.col("id") == F.col("part_id")).drop("part_id")
    blocks = blocks.repartition("pair_key").sortWithinPartitions("pair_key")
    how = (size, chunk_size, percent)
    survivors = materialize(blocks.mapInArrow(_survivors(*how), blocks.schema), "survivors")
    dressed = survivors.join(sets.withColumnRenamed("id", "s_id"), F.col("id") == F.col("s_id")).drop("s_id")
    dressed = dressed.repartition("pair_key").sortWithinPartitions("pair_key")
    more = materialize(dressed.mapInArrow(_cross_links(*how), "a long, b long"), "more")
    joined = connected_components(links.unionByName(more))

    labels = joined.select(F.col("node").alias("class"), F.col("component"))
    by_class = classes.select("set_key", F.col("id").alias("class")).join(labels, "class", "left")
    by_class = by_class.select(F.col("set_key").alias("class_key"), F.coalesce("component", "class").alias("component"))
    out = sketch.join(by_class, F.col("set_key") == F.col("class_key"), "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), (F.col("id") == component).alias("kept"))
