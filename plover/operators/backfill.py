"""Backfill windows, newest first, split where a source would cap their results.

Windows are counted back from the end and halved as often as needed. The counts
of all halves come from one aggregate, in which each day's count goes to the
window and the halves that hold it; a half exists if the part above it was over
the cap. So there is no search loop, and a day costs as many rows as there are
levels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def capped_windows(found: DataFrame, keys: DataFrame, by: str, day: str, start: str, end: str, cap: int, least_days: int = 2, levels: int = 5) -> DataFrame:
    """Per key of ``keys``: windows (first_day, last_day, n, capped) that cover ``start`` to ``end``, newest at place 1.

    Windows have ``least_days * 2 ** levels`` days and are halved while they
    hold more than ``cap`` rows of ``found``, down to ``least_days``; one that is
    still over the cap then is marked ``capped``. The oldest window may be
    shorter. Rows outside the period or without a key don't count; a key without
    rows has whole windows of 0.
    """
    last, first = F.to_date(F.lit(end)), F.to_date(F.lit(start))
    size = least_days * 2**levels
    ago = F.datediff(last, F.col("_day"))
    days = found.select(F.col(by).alias("_key"), F.col(day).cast("date").alias("_day")).filter(F.col("_day").between(first, last) & F.col("_key").isNotNull())
    days = days.groupBy("_key", "_day").agg(F.count(F.lit(1)).alias("_n"))
    halves = F.array(*[F.struct(F.lit(k).alias("level"), F.floor(ago / (size >> k)).alias("node")) for k in range(levels + 1)])
    counts = days.select("_key", "_n", F.explode(halves).alias("h")).groupBy("_key", F.col("h.level").alias("level"), F.col("h.node").alias("node")).agg(F.sum("_n").alias("n"))
    over = counts.filter(F.col("n") > cap).filter(F.col("level") < levels)
    whole = keys.select(F.col(by).alias("_key")).filter("_key is not null").distinct()
    whole = whole.select("_key", F.lit(0).alias("level"), F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.datediff(last, first) / size))).alias("node"))
    parts = over.select("_key", (F.col("level") + 1).alias("level"), F.explode(F.array(2 * F.col("node"), 2 * F.col("node") + 1)).alias("node"))
    every = whole.unionByName(parts)
    counted = counts.select(F.col("_key").alias("c_key"), F.col("level").alias("c_level"), F.col("node").alias("c_node"), "n")
    met = every.join(counted, (F.col("_key") == F.col("c_key")) & (F.col("level") == F.col("c_level")) & (F.col("node") == F.col("c_node")), "left").withColumn("n", F.coalesce("n", F.lit(0)))
    kept = met.filter((F.col("n") <= cap) | (F.col("level") == levels))
    span = F.expr(f"shiftright({size}, level)")
    newest = F.date_sub(last, (F.col("node") * span).cast("int"))
    dated = kept.select("_key", newest.alias("last_day"), F.greatest(F.date_sub(newest, span - 1), first).alias("first_day"), "n", (F.col("n") > cap).alias("capped")).filter(F.col("last_day") >= first)
    return dated.select(F.col("_key").alias(by), "first_day", "last_day", "n", "capped")
