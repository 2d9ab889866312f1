"""Domain tables derived from the input tables: prices, benchmark, members, facts, filings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plover.operators.timeseries import numbered


def _cents(c: str) -> F.Column:
    return F.round(F.col(c) * 100).cast("long").cast("double")


def unit_prices(lineitem: DataFrame) -> DataFrame:
    """(symbol, day, c, hi, lo, volume): unit prices of each supplier's days, in whole cents."""
    unit = F.floor(_cents("l_extendedprice") / F.col("l_quantity")).cast("double")
    return lineitem.groupBy(F.col("l_suppkey").alias("symbol"), F.col("l_shipdate").cast("date").alias("day")).agg(
        F.floor(F.sum(_cents("l_extendedprice")) / F.sum("l_quantity")).cast("double").alias("c"), F.max(unit).alias("hi"), F.min(unit).alias("lo"), F.sum("l_quantity").cast("double").alias("volume")
    )


def prices(lineitem: DataFrame, window: int = 60) -> DataFrame:
    """A smooth price series per supplier: the mean of its last ``window`` daily unit prices, in whole cents."""
    units = unit_prices(lineitem)
    mean = F.floor(F.avg("c").over(Window.partitionBy("symbol").orderBy("day").rowsBetween(-(window - 1), 0))).cast("double")
    out = units.withColumn("close", mean)
    return numbered(out.select("symbol", "day", "close", F.greatest("hi", "close").alias("high"), F.least("lo", "close").alias("low"), "volume"))


def benchmark_prices(lineitem: DataFrame) -> DataFrame:
    """(market, day, index_close): one series over all suppliers."""
    return lineitem.groupBy(F.col("l_shipdate").cast("date").alias("day")).agg(F.floor(F.sum(_cents("l_extendedprice")) / F.sum("l_quantity")).cast("double").alias("index_close")).withColumn("market", F.lit(1))


_CENTS = "round(l_extendedprice*100)::BIGINT::DOUBLE"
PRICES_SQL = f"""
unit AS (SELECT l_suppkey AS symbol, CAST(l_shipdate AS DATE) AS day, floor(sum({_CENTS})/sum(l_quantity)) AS c,
    max(floor({_CENTS}/l_quantity)) AS hi, min(floor({_CENTS}/l_quantity)) AS lo, CAST(sum(l_quantity) AS DOUBLE) AS volume
    FROM lineitem GROUP BY 1, 2),
smooth AS (SELECT symbol, day, floor(avg(c) OVER (PARTITION BY symbol ORDER BY day ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)) AS close, hi, lo, volume FROM unit),
px AS (SELECT symbol, day, close, greatest(hi, close) AS high, least(lo, close) AS low, volume, row_number() OVER (PARTITION BY symbol ORDER BY day) AS i FROM smooth)
"""
BENCHMARK_SQL = f"bench AS (SELECT CAST(l_shipdate AS DATE) AS day, floor(sum({_CENTS})/sum(l_quantity)) AS index_close FROM lineitem GROUP BY 1)"
