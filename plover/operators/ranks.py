"""Ranks and running totals over a whole table, without a task that sees all rows.

Rows are dealt to partitions by ranges of the order and written; each partition
is then numbered on its own, and what came before it is added from a table with
one row per partition.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plover.session import materialize


def running(df: DataFrame, order: list[Column | str], sums: dict[str, Column] | None = None, maxes: dict[str, Column] | None = None, dealt: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Adds running sums and maxima in ``order``, which must tell all rows apart; ``df`` keeps its columns.

    ``dealt`` changes the rows once they are dealt by ranges, before they are
    written; it groups them by ``_r_part`` and ``order`` where these don't tell
    the rows of ``df`` apart, which needs no shuffle. Columns whose names begin
    with ``_r`` are used inside.
    """
    sums, maxes = sums or {}, maxes or {}
    parts = df.repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *order)
    parts = parts.withColumn("_r_part", F.spark_partition_id())
    parts = materialize(parts if dealt is None else dealt(parts), "ranges")
    before = Window.orderBy("_r_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    totals = parts.groupBy(F.col("_r_part").alias("_r_key")).agg(*[F.sum(c).alias(f"_r_{k}") for k, c in sums.items()], *[F.max(c).alias(f"_r_{k}") for k, c in maxes.items()])
    totals = totals.withColumnRenamed("_r_key", "_r_part")
    offsets = totals.select(
        F.col("_r_part").alias("_r_key"), *[F.coalesce(F.sum(f"_r_{k}").over(before), F.lit(0)).alias(f"_r_{k}") for k in sums], *[F.max(f"_r_{k}").over(before).alias(f"_r_{k}") for k in maxes]
    )
    upto = Window.partitionBy("_r_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = parts.join(F.broadcast(offsets), F.col("_r_part") == F.col("_r_key"))
    out = out.withColumns({k: F.sum(c).over(upto) + F.col(f"_r_{k}") for k, c in sums.items()} | {k: F.greatest(F.max(c).over(upto), F.col(f"_r_{k}")) for k, c in maxes.items()})
    return out.drop("_r_part", "_r_key", *[f"_r_{k}" for k in (*sums, *maxes)])


def row_number(df: DataFrame, order: list[Column | str], out: str = "place") -> DataFrame:
    """Adds the row's number in ``order``, from 1."""
    return running(df, order, {out: F.lit(1).cast("long")})


def with_totals(df: DataFrame, *totals: Column, of: DataFrame | None = None) -> DataFrame:
    """Each row beside aggregates over all rows (of ``of`` if given), which are one row."""
    return df.crossJoin(F.broadcast((df if of is None else of).agg(*totals)))


def by_value(df: DataFrame, value: str, counts: dict[str, Column]) -> DataFrame:
    """A row per distinct value: its sums, and under ``below_<name>`` the sums of all smaller values."""
    groups = df.groupBy(value).agg(*[F.sum(c).alias(k) for k, c in counts.items()])
    upto = running(groups, [value], {f"below_{k}": F.col(k) for k in counts})
    return reduce(lambda out, k: out.withColumn(f"below_{k}", F.col(f"below_{k}") - F.col(k)), counts, upto)
