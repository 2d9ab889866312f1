"""Pairs of rows that share a bucket, however large the bucket.

A bucket is dealt by hash into blocks of about ``BLOCK`` rows, and each pair of
blocks becomes a group of its own, so no task meets a whole hot bucket. Groups
are compared in numpy; only rows that a comparison keeps leave the task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 128


def block_pairs(rows: DataFrame, keys: list[str], item: str, block: int = BLOCK) -> DataFrame:
    """Rows of buckets with two rows or more, once for each pair of blocks.

    Adds ``pair_key`` (the group) and ``block``; within a group, rows of
    different blocks are compared, and rows of one block where the group is of
    that block alone. Sorted by ``pair_key`` within partitions.
    """
    sizes = rows.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.count(F.lit(1)).alias("_rows")).filter("_rows > 1")
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    on = same[0]
    for x in same[1:]:
        on = on & x
    joined = rows.join(sizes, on).drop(*[f"_{k}" for k in keys])
    joined = joined.withColumn("n_blocks", F.ceil(F.col("_rows") / block).cast("int"))
    joined = joined.withColumn("block", F.pmod(F.xxhash64(item), F.col("n_blocks")).cast("int"))
    joined = joined.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    pair = F.xxhash64(*keys, F.least("block", "other"), F.greatest("block", "other"))
    joined = joined.withColumn("pair_key", pair).withColumn("alone", F.col("block") == F.col("other"))
    return joined.drop("_rows", "n_blocks", "other").repartition("pair_key").sortWithinPartitions("pair_key")


def whole_groups(batches: Iterator[pa.RecordBatch], key: str = "pair_key", rows: int = 20_000) -> Iterator[pa.Table]:
    """Tables that end where a group ends; the input is sorted by ``key``."""
    held: list[pa.Table] = []
    count = 0
    for batch in batches:
        held.append(pa.Table.from_batches([batch]))
        count += batch.num_rows
        if count < rows:
            continue
        both = pa.concat_tables(held).combine_chunks()
        values = both.column(key).to_numpy()
        cut = int(np.searchsorted(values, values[-1], "left"))
        if cut:
            yield both.slice(0, cut)
        held = [both.slice(cut)]
        count = both.num_rows - cut
    if count:
        yield pa.concat_tables(held).combine_chunks()


def group_pairs(keys: np.ndarray, block: np.ndarray, alone: np.ndarray, inner: np.ndarray | None = None, small: int = 64) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs i < j of rows to compare; two rows that are both ``inner`` aren't compared.

    Groups of up to ``small`` rows are taken side by side, larger ones row by
    row against all that follow, so no array is much longer than ``keys``.
    """
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    lengths = np.diff(np.r_[starts, len(keys)])
    inner = np.zeros(len(keys), bool) if inner is None else inner
    wanted = lambda i, j: ((block[i] != block[j]) | alone[i]) & ~(inner[i] & inner[j])
    left = np.repeat(starts + lengths, lengths) - np.arange(len(keys)) - 1
    left[np.repeat(lengths > small, lengths)] = 0
    for step in range(1, min(int(lengths.max(initial=0)), small)):
        i = np.flatnonzero(left >= step)
        j = i + step
        keep = wanted(i, j)
        if keep.any():
            yield i[keep], j[keep]
    for at, end in zip(starts[lengths > small].tolist(), (starts + lengths)[lengths > small].tolist(), strict=True):
        outer, held = np.flatnonzero(~inner[at:end]) + at, np.flatnonzero(inner[at:end]) + at
        some = max(1, 200_000 // (end - at))
        for first in range(0, len(outer), some):
            i = np.repeat(outer[first : first + some], len(outer) + len(held))
            j = np.tile(np.r_[outer, held], len(i) // (len(outer) + len(held)))
            keep = (inner[j] | (i < j)) & wanted(i, j)
            if keep.any():
                yield np.minimum(i[keep], j[keep]), np.maximum(i[keep], j[keep])
