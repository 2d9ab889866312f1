"""State kept in tables: upserts, ledgers, cooldowns, merges, outboxes and budgets."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plover.session import scratch_path


def upsert(old: DataFrame, new: DataFrame, keys: list[str], rules: dict[str, str]) -> DataFrame:
    """Rows of both tables; where a key is in both, each column follows its rule.

    Rules: ``new``, ``old``, ``fill`` (old unless null), ``min``, ``max``, ``longest``.
    """
    a, b = old.alias("a"), new.alias("b")
    on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    met = a.join(b, on, "full")
    out = [F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in keys]
    for c, rule in rules.items():
        was, now = F.col(f"a.{c}"), F.col(f"b.{c}")
        value = {
            "new": F.coalesce(now, was), "old": F.coalesce(was, now), "fill": F.coalesce(was, now), "min": F.least(was, now), "max": F.greatest(was, now),
            "longest": F.when(F.coalesce(F.length(now), F.lit(-1)) > F.coalesce(F.length(was), F.lit(-1)), now).otherwise(was),
        }[rule]
        out.append(value.alias(c))
    return met.select(*out)


def insert_or_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return old.unionByName(new.join(old.select(*keys), keys, "left_anti"))


def latest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row per key: the first by ``order``."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(window)).filter("_n = 1").drop("_n")


def seen_times(observations: DataFrame, keys: list[str], at: str) -> DataFrame:
    """First and last time that each key was seen, and how often."""
    return observations.groupBy(*keys).agg(F.min(at).alias("first_seen"), F.max(at).alias("last_seen"), F.count(F.lit(1)).alias("observations"))


def corroborated(events: DataFrame, key: str, at: str, source: str, title: str, minutes: int, trusted: Column, sources: int = 2, titles: int = 2) -> DataFrame:
    """Windows with a trusted source, or so many sources and titles: the grounds for an alert."""
    grouped = events.withColumn("_trusted", trusted).groupBy(key, F.window(at, f"{minutes} minutes").alias("w"))
    out = grouped.agg(F.countDistinct(source).alias("sources"), F.countDistinct(title).alias("titles"), F.max("_trusted").alias("trusted"), F.count(F.lit(1)).alias("n"))
    out = out.filter(F.col("trusted") | ((F.col("sources") >= sources) & (F.col("titles") >= titles)))
    reason = F.when(F.col("trusted"), "trusted_source").otherwise("independent_sources")
    return out.select(key, F.col("w.start").alias("window_start"), "sources", "titles", "n", reason.alias("reason"))


def exponential_cooldown(runs: DataFrame, by: str, at: str, failed: Column, base: int, most: int) -> DataFrame:
    """Wait after each run: base times two to the failures in a row, capped; zero after a success."""
    order = Window.partitionBy(by).orderBy(at)
    marked = runs.withColumn("_f", failed.cast("int")).withColumn("_run", F.sum(1 - F.col("_f")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    streak = F.sum("_f").over(Window.partitionBy(by, "_run").orderBy(at).rowsBetween(Window.unboundedPreceding, 0))
    marked = marked.withColumn("failures", streak)
    wait = F.when(F.col("failures") > 0, F.least(F.lit(float(most)), base * F.pow(F.lit(2.0), F.col("failures") - 1))).otherwise(0.0)
    return marked.withColumn("wait", wait).drop("_f", "_run")


def merge_records(records: DataFrame, key: Column, source: str, order: list[Column]) -> DataFrame:
    """One row per key: sources, the longest abstract, the first title and latest update."""
    return records.withColumn("merge_key", key).groupBy("merge_key").agg(
        F.array_sort(F.collect_set(source)).alias("sources"), F.max_by("abstract", F.struct(F.length("abstract"), "abstract")).alias("abstract"),
        F.min_by("title", F.struct(*order)).alias("title"), F.max("updated_at").alias("updated_at"), F.count(F.lit(1)).alias("records"),
    )


def pending(queue: DataFrame, delivered: DataFrame, baseline: DataFrame, key: str) -> DataFrame:
    """Rows of an outbox still to send: neither delivered nor known before the first run."""
    return queue.join(delivered.select(key), key, "left_anti").join(baseline.select(key), key, "left_anti")


def within_budget(rows: DataFrame, order: list[str], cost: str, budget: float, by: list[str]) -> DataFrame:
    """Marks rows while the running cost stays within the budget; once over it, all later rows stop."""
    running = F.sum(cost).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    marked = rows.withColumn("spent", running)
    stopped = F.max((F.col("spent") > budget).cast("int")).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("allowed", stopped == 0)


def status_changes(snapshots: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """Rows whose value differs from the key's previous snapshot."""
    before = F.lag(value).over(Window.partitionBy(key).orderBy(at))
    return snapshots.withColumn("previous", before).filter(~F.col(value).eqNullSafe(F.col("previous")))


def newer_rows(known: DataFrame, rows: DataFrame, key: str, at: str) -> DataFrame:
    """Rows after the last known time of their key, or all of a key that isn't known; adds last_known."""
    last = known.groupBy(F.col(key).alias("_k")).agg(F.max(at).alias("last_known"))
    met = rows.join(last, F.col(key).eqNullSafe(F.col("_k")), "left").drop("_k")
    return met.filter(F.col("last_known").isNull() | (F.col(at) > F.col("last_known")))


def cached(requests: DataFrame, cache: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Requests with ``value`` of the cache where all keys agree, and whether it was there; the last by value of repeats."""
    known = cache.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys]).agg(F.max(value).alias(value), F.lit(True).alias("_hit"))
    met = requests.join(known, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys], "left")
    return met.select(*requests.columns, value, F.coalesce("_hit", F.lit(False)).alias("cached"))


def fingerprint(settings: dict) -> str:
    """The first hex digits of the hash of the settings, whatever their order."""
    return hashlib.sha256(json.dumps(settings, sort_keys=True).encode()).hexdigest()[:24]


def new_stage(spark: SparkSession, name: str) -> str:
    """A path for staged windows in the shared folder."""
    return scratch_path(spark, name)


def stage(windows: DataFrame, window: str, settings: str, path: str) -> str:
    """Write windows under the fingerprint of their settings; a window that is staged again is replaced whole."""
    rows = windows.withColumn("settings", F.lit(settings)).withColumn("_window", F.col(window).cast("string"))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_window").parquet(path)
    return path


def staged_windows(spark: SparkSession, path: str, settings: str) -> DataFrame:
    """The windows that were staged under these settings."""
    return spark.read.parquet(path).filter(F.col("settings") == settings).drop("settings", "_window")
