"""Exact quantiles by selection over counts of ranges, in which no task sees a group's values.

A sketch per group brackets each quantile between two values; its size is fixed
and it is merged like any partial aggregate. One more pass counts the values
below the bracket and, by distinct value, those within, a few in ten thousand of
the rows. The quantile's ranks are then found among running counts of the
bracket, dealt by ranges. A bracket that misses its ranks is widened to the
whole range, so the result doesn't rest on the sketch. Groups are counted first:
if the largest is small, each is gathered and sorted instead.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plover.operators import ranks
from plover.operators.joins import checked_broadcast
from plover.session import materialize

#: Groups of at most so many values are gathered, each in one buffer of bounded size.
GATHERED = 200_000

#: Ranks of the sketch are right to a share of one in so many rows.
ACCURACY = 10_000


def _same(by: Sequence[str], prefix: str) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"{prefix}{c}")) for c in by])


def _brackets(long: DataFrame, keys: list[str], shares: Sequence[float]) -> DataFrame:
    """Per key and share: ranks wanted (from 0), and values at or beyond them on both sides."""
    reach = 3 / ACCURACY
    marks = [p for s in shares for p in (max(s - reach, 0.0), min(s + reach, 1.0))]
    sketch = F.approx_percentile("_value", F.array(*[F.lit(float(p)) for p in marks]), F.lit(ACCURACY))
    found = long.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min("_value").alias("_min"), F.max("_value").alias("_max"), sketch.alias("_marks"))
    wanted = [
        F.struct(
            F.lit(k).alias("share"), (F.lit(float(s)) * (F.col("_n") - 1)).alias("at"),
            F.when(F.lit(s - reach <= 0), F.col("_min")).otherwise(F.col("_marks")[2 * k]).alias("low"), F.when(F.lit(s + reach >= 1), F.col("_max")).otherwise(F.col("_marks")[2 * k + 1]).alias("high"),
        )
        for k, s in enumerate(shares)
    ]
    return found.select(*keys, "_min", "_max", F.explode(F.array(*wanted)).alias("w")).select(*keys, "_min", "_max", "w.*")


def _counts(long: DataFrame, brackets: DataFrame, keys: list[str]) -> DataFrame:
    """Per key and share: values within the bracket with their counts; null for all that lie below it."""
    sides = brackets.select(*[F.col(k).alias(f"_b_{k}") for k in keys], F.struct("share", "low", "high").alias("_b"))
    sides = sides.groupBy(*[f"_b_{k}" for k in keys]).agg(F.collect_list("_b").alias("_sides"))  # an entry a share
    met = long.join(checked_broadcast(sides), _same(keys, "_b_"))
    close = F.filter(F.transform("_sides", lambda b: F.struct(b["share"].alias("share"), F.when(F.col("_value") >= b["low"], F.col("_value")).alias("value"), (F.col("_value") <= b["high"]).alias("near"))), lambda b: b["near"])
    rows = met.select(*keys, F.explode(close).alias("b"))
    return rows.groupBy(*keys, F.col("b.share").alias("share"), F.col("b.value").alias("value")).agg(F.count(F.lit(1)).alias("count"))


def quantiles(df: DataFrame, values: Sequence[str], shares: Sequence[float], by: Sequence[str] = (), aggregates: Sequence[Column] = ()) -> DataFrame:
    """Per group of ``by``: ``n_<value>``, ``q_<value>``, an array of the quantiles at ``shares``, and other ``aggregates``.

    Quantiles interpolate linearly between ranks, as a percentile does. Nulls
    don't count; a group without values has a count of 0 and null quantiles,
    null keys make a group, and an empty table gives no groups (one row where
    ``by`` is empty). ``df`` is read several times, so write it first if it is
    costly. Column names that begin with ``_`` and ``share`` are used inside.
    """
    by = list(by)
    most = df.groupBy(*by).agg(*[F.count(v).alias(f"n_{v}") for v in values]).agg(F.greatest(F.lit(0), *[F.max(f"n_{v}") for v in values])).first()[0]
    if most <= GATHERED:
        wanted = F.array(*[F.lit(float(s)) for s in shares])
        exact = [x for v in values for x in (F.count(v).alias(f"n_{v}"), F.percentile(F.col(v).cast("double"), wanted).alias(f"q_{v}"))]
        return df.groupBy(*by).agg(*exact, *aggregates)
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("name"), F.col(v).cast("double").alias("value")) for k, v in enumerate(values)]))
    source = df.select(*by, pairs.alias("_p")).select(*by, F.col("_p.name").alias("_name"), F.col("_p.value").alias("_value"))
    long, keys = source.filter("_value is not null"), [*by, "_name"]
    brackets = materialize(_brackets(long, keys, shares), "brackets")
    counts = materialize(_counts(long, brackets, keys), "bracket-counts")

    def placed(counts: DataFrame) -> DataFrame:
        """Each bracket's values with the ranks that they take, and the ranks wanted."""
        upto = ranks.running(counts, [*keys, "share", F.col("value").asc_nulls_first()], {"_upto": F.col("count")})
        start = upto.groupBy(*[F.col(k).alias(f"_s_{k}") for k in (*keys, "share")]).agg(F.min(F.col("_upto") - F.col("count")).alias("_start"))
        upto = upto.join(start, _same([*keys, "share"], "_s_")).select(*keys, "share", "value", (F.col("_upto") - F.col("_start")).alias("_upto"), "count")
        return upto.join(brackets.select(*[F.col(k).alias(f"_w_{k}") for k in (*keys, "share")], "at"), _same([*keys, "share"], "_w_")).select(*keys, "share", "value", "_upto", "count", "at")

    def read(rows: DataFrame) -> DataFrame:
        first = F.col("_upto") - F.col("count")
        value_at = lambda rank: F.max(F.when((first <= rank) & (rank < F.col("_upto")), F.col("value")))
        low, high = F.floor("at"), F.ceil("at")
        return rows.groupBy(*keys, "share").agg(value_at(low).alias("_low"), value_at(high).alias("_high"), (F.first("at") - F.floor(F.first("at"))).alias("_part"))

    found = materialize(read(placed(counts)), "quantiles")
    missed = found.filter("_low is null or _high is null").select(*keys, "share")
    if missed.limit(1).count():
        wide = brackets.join(missed.select(*[F.col(k).alias(f"_m_{k}") for k in (*keys, "share")]), _same([*keys, "share"], "_m_"), "left_semi")
        wide = wide.withColumns({"low": F.col("_min"), "high": F.col("_max")})
        found = found.filter("_low is not null and _high is not null").unionByName(read(placed(_counts(long, wide, keys))))
    got = found.withColumn("_q", F.col("_low") + F.col("_part") * (F.col("_high") - F.col("_low")))
    at = lambda k, s: F.max(F.when((F.col("_name") == k) & (F.col("share") == s), F.col("_q")))
    wide = got.groupBy(*[F.col(c).alias(f"_g_{c}") for c in by]).agg(*[F.array(*[at(k, s) for s in range(len(shares))]).alias(f"q_{v}") for k, v in enumerate(values)])
    base = df.groupBy(*by).agg(*[F.count(v).alias(f"n_{v}") for v in values], *aggregates)
    met = base.join(wide, _same(by, "_g_"), "left") if by else base.crossJoin(F.broadcast(wide))
    return met.drop(*[f"_g_{c}" for c in by])
