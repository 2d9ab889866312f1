"""Product codes of vectors, learned in whole numbers with partial-distance search.

Components become whole numbers, vectors are cut into equal parts, and each
part is replaced by the number of the nearest entry of its position's codebook.
The search is exact: dimensions are taken in descending variance of the
codebook, a row of tasks' numpy arrays at a time, and an entry is dropped for
the rows where its distance so far strictly exceeds the best complete distance.
A tie can't be dropped so, and goes to the lower index.

Each round reads the whole table where it lies and shuffles counts and sums of
each task's parts, (parts x entries x dimensions) numbers; the driver holds the
codebooks, as large as 16 vectors. Nothing else is collected or broadcast.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plover.session import materialize

#: Rows that a task compares at a time.
ROWS = 8_192


@dataclass(frozen=True)
class Coding:
    """``scale``: components become floor(scale * x)."""

    scale: int = 4096
    parts: int = 8
    entries: int = 16
    rounds: int = 6


def nearest(rows: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the nearest entry of ``book`` for each row; whole numbers."""
    n = len(rows)
    order = np.argsort(-book.astype(np.float64).var(axis=0), kind="stable")
    rows, book = np.ascontiguousarray(rows[:, order].T), book[:, order]
    if not len(order):
        return np.zeros(n, np.int64), np.zeros(n, np.int64)
    # The entry that is nearest in the first dimension gives each row its first complete distance.
    index = np.argmin(np.abs(rows[0][:, None] - book[None, :, 0]), axis=1)
    best = ((rows - book[index].T) ** 2).sum(axis=0)
    for k, entry in enumerate(book):
        alive = np.flatnonzero(index != k)
        so_far = np.zeros(len(alive), np.int64)
        for d, value in enumerate(entry):
            so_far += (rows[d][alive] - value) ** 2
            keep = so_far <= best[alive]
            if not keep.all():
                alive, so_far = alive[keep], so_far[keep]
            if not len(alive):
                break
        better = (so_far < best[alive]) | (k < index[alive])
        alive, so_far = alive[better], so_far[better]
        index[alive], best[alive] = k, so_far
    return index, best


def _whole(batch: pa.RecordBatch, column: int, width: int) -> np.ndarray:
    found = batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    if width and len(found) and width * (2 * float(np.abs(found.astype(np.float64)).max())) ** 2 >= 2.0**62:
        raise ValueError("components too large: squared distances would not fit a long")
    return found


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            yield batch.slice(start, ROWS)


def _sums(books: np.ndarray):
    """(part, entry, place, count, total) of a task's rows."""
    parts, entries, wide = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, totals = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, wide), np.int64)
        for batch in _blocks(batches):
            rows = _whole(batch, 0, parts * wide)
            for p in range(parts):
                part = rows[:, p * wide : (p + 1) * wide]
                index, _ = nearest(part, books[p])
                counts[p] += np.bincount(index, minlength=entries)
                np.add.at(totals[p], index, part)
        p, e, w = (x.ravel() for x in np.indices(totals.shape))
        some = counts[p, e] > 0
        p, e, w = p[some], e[some], w[some]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (p, e, w, counts[p, e], totals[p, e, w])], ["part", "entry", "place", "count", "total"])

    return run


def _codes(books: np.ndarray):
    parts, _, wide = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _blocks(batches):
            rows = _whole(batch, 2, parts * wide)
            found = [nearest(rows[:, p * wide : (p + 1) * wide], books[p]) for p in range(parts)]
            codes = np.stack([index for index, _ in found], axis=1)
            error = sum(distance for _, distance in found)
            text = ["".join(f"{x:02x}" for x in row) for row in codes.tolist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array(error, pa.int64())], ["id", "label", "code", "error"])

    return run


def vector_codes(vectors: DataFrame, how: Coding = Coding(), id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Per kept vector: id, code, error, label_error, codebooks_sha256.

    A vector that is null or holds a null or non-finite component is dropped;
    so is one whose length is not that of the kept vectors' smallest id (the
    shortest there) or no positive multiple of ``parts``. The codebooks start
    with the parts of the smallest ids, ascending, vectors of one id by their
    components, rows without an id last; with fewer vectors than entries they
    have an entry for each. Ids may repeat and repeated rows come out each;
    labels that are null count as one label. No kept vector, no rows. Other
    columns are ignored. Raises ValueError where squared distances would pass a
    long.
    """
    if how.entries > 256:
        raise ValueError("an index has two hex digits")
    named = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = named.filter("vector is not null and size(vector) > 0").filter(F.size("vector") % how.parts == 0).filter(finite)
    whole = usable.select("id", "label", F.transform("vector", lambda x: F.floor(x * how.scale).cast("long")).alias("vector"))
    shortest = whole.orderBy(F.col("id").asc_nulls_last(), F.size("vector")).select(F.size("vector")).first()
    if shortest is None:
        return whole.select("id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256")).limit(0)
    whole = materialize(whole.filter(F.size("vector") == shortest[0]), "whole")
    first = [r["vector"] for r in whole.orderBy(F.col("id").asc_nulls_last(), "vector").limit(how.entries).select("vector").collect()]
    books = np.array(first, np.int64).reshape(len(first), how.parts, -1).transpose(1, 0, 2).copy()
    for _ in range(how.rounds):
        sums = whole.select("vector").mapInArrow(_sums(books), "part long, entry long, place long, count long, total long")
        sums = sums.groupBy("part", "entry", "place").agg(F.sum("count").alias("count"), F.sum("total").alias("total")).toArrow()
        part, entry, place, count, total = (sums.column(c).to_numpy() for c in ("part", "entry", "place", "count", "total"))
        books[part, entry, place] = total // count
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    kind = whole.schema["id"].dataType.simpleString()
    label = whole.schema["label"].dataType.simpleString()
    coded = materialize(whole.mapInArrow(_codes(books), f"id {kind}, label {label}, code string, error long"), "codes")
    by_label = materialize(coded.groupBy(F.col("label").alias("l")).agg(F.sum("error").alias("label_error")), "errors")
    return coded.join(by_label, F.col("label").eqNullSafe(F.col("l"))).select("id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
