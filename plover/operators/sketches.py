"""Stored sketches: distinct counts and quantiles that merge across batches without their rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: 2 ** LOG_K places of a distinct sketch: a relative standard error of about 0.8 %; and the size of a quantile sketch: a rank error of about 1.3 %.
LOG_K, K = 14, 200


def sketched(batch: DataFrame, by: Sequence[str], distinct: str, value: str) -> DataFrame:
    """Per group of a batch: rows, a sketch of the distinct ``distinct`` and one of the values, small binaries to store.

    Nulls don't count; a group without values has null sketches there.
    """
    return batch.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"), F.hll_sketch_agg(F.col(distinct), F.lit(LOG_K)).alias("distinct_sketch"), F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(K)).alias("value_sketch")
    )


def merged(stored: DataFrame, by: Sequence[str]) -> DataFrame:
    """Sketches of several batches as one per group; ``by`` may be coarser than the batches'."""
    return stored.groupBy(*by).agg(F.sum("rows").alias("rows"), F.hll_union_agg("distinct_sketch").alias("distinct_sketch"), F.kll_merge_agg_double("value_sketch").alias("value_sketch"))


def distinct_estimate() -> Column:
    return F.hll_sketch_estimate("distinct_sketch")


def quantile_estimate(share: float) -> Column:
    return F.kll_sketch_get_quantile_double(F.col("value_sketch"), F.lit(share))
