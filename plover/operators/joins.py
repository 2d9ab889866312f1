"""Joins: with status, by cascading keys, as-of, in bands, point-in-time and with margins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plover.operators import ranks


#: A table with at most so many rows is broadcast.
BROADCAST_ROWS = 100_000


def checked_broadcast(small: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """The table, marked for broadcast if its rows, counted up to ``most``, are that few."""
    return F.broadcast(small) if small.limit(most + 1).count() <= most else small


def status_join(left: DataFrame, right: DataFrame, key: str, valid: Column, left_name: Column | None = None, right_name: Column | None = None) -> DataFrame:
    """Left join that says how it went: join_status, right_count and name_check.

    Rows with several matches stay and are flagged ``duplicate_match``. Names
    agree if one contains the other.
    """
    counts = right.groupBy(key).agg(F.count(F.lit(1)).alias("right_count"))
    met = left.join(right, key, "left").join(counts, key, "left")
    status = F.when(~valid | F.col(key).isNull(), "invalid_key").when(F.col("right_count").isNull(), "not_found").when(F.col("right_count") > 1, "duplicate_match").otherwise("matched")
    met = met.withColumn("join_status", status)
    if left_name is None or right_name is None:
        return met
    agree = left_name.contains(right_name) | right_name.contains(left_name)
    check = F.when(left_name.isNull() | right_name.isNull(), "not_checked").when(agree, "ok").otherwise("name_mismatch")
    return met.withColumn("name_check", check)


def unique_by(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """One row per key: the first by ``order``."""
    numbered = df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return numbered.filter("_n = 1").drop("_n")


def only_unambiguous(df: DataFrame, key: str) -> DataFrame:
    """The rows whose key occurs once."""
    once = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter("_n = 1").select(key)
    return df.join(once, key, "left_semi")


def cascade_join(left: DataFrame, steps: list[tuple[str, str, DataFrame, str]], value: str) -> DataFrame:
    """Left joins tried in turn: the first step with a match gives ``value`` and its name.

    Each step is (name, left key, right side with unique keys, right key).
    """
    out = left
    for k, (_, left_key, right, right_key) in enumerate(steps):
        side = right.select(F.col(right_key).alias(f"_k{k}"), F.col(value).alias(f"_v{k}"))
        out = out.join(side, F.col(left_key) == F.col(f"_k{k}"), "left")
    found = [F.col(f"_v{k}") for k in range(len(steps))]
    method = F.coalesce(*[F.when(v.isNotNull(), F.lit(name)) for v, (name, *_) in zip(found, steps, strict=True)])
    return out.withColumn(value, F.coalesce(*found)).withColumn("match_method", method).drop(*[f"_k{k}" for k in range(len(steps))], *[f"_v{k}" for k in range(len(steps))])


def asof_join(left: DataFrame, right: DataFrame, by: str, left_time: str, right_time: str, values: list[str], direction: str = "backward", tolerance_days: int | None = None) -> DataFrame:
    """Each left row with the last right row on or before its time (or the first on or after).

    One union and one window by (``by``, time), so it shuffles each side once
    and has no range join. Adds ``values`` and ``asof_time``. Right rows with equal times: the last by
    ``values`` counts.
    """
    back = direction == "backward"
    row = F.struct(F.col(right_time).alias("asof_time"), *values)
    left_rows = left.withColumn("_side", F.lit(1)).withColumn("_time", F.col(left_time)).withColumn("_row", F.lit(None).cast(right.select(row.alias("r")).schema["r"].dataType))
    right_rows = right.select(F.col(by), F.lit(0).alias("_side"), F.col(right_time).alias("_time"), row.alias("_row"))
    both = left_rows.unionByName(right_rows, allowMissingColumns=True)
    if back:
        order = Window.partitionBy(by).orderBy(F.col("_time").asc(), F.col("_side").asc(), F.col("_row").asc())
    else:
        order = Window.partitionBy(by).orderBy(F.col("_time").desc(), F.col("_side").asc(), F.col("_row").asc())
    near = F.last("_row", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    met = both.withColumn("_near", near).filter("_side = 1")
    if tolerance_days is not None:
        gap = F.abs(F.datediff(F.col(left_time), F.col("_near.asof_time")))
        met = met.withColumn("_near", F.when(gap <= tolerance_days, F.col("_near")))
    return met.select(*left.columns, *[F.col(f"_near.{v}").alias(v) for v in values], F.col("_near.asof_time").alias("asof_time"))


def asof_dated(left: DataFrame, right: DataFrame, left_day: str, right_day: str, values: list[str], direction: str = "backward") -> DataFrame:
    """As-of join with one series that has no key: by distinct dates, which are few, then an equi-join.

    So a single series doesn't gather all left rows in one task. ``left`` has no columns that begin with ``_d``.
    """
    days = left.select(F.col(left_day).alias("_d_day")).distinct().withColumn("_d_one", F.lit(1))
    known = right.select(F.lit(1).alias("_d_one"), F.col(right_day).alias("_d_at"), *values)
    met = asof_join(days, known, "_d_one", "_d_day", "_d_at", values, direction).drop("_d_one", "asof_time")
    return left.join(met, F.col(left_day) == F.col("_d_day"), "left").drop("_d_day")


def band_join(left: DataFrame, right: DataFrame, by: str, left_time: str, right_time: str, days: int, how: str = "inner") -> DataFrame:
    """Rows of equal ``by`` at most ``days`` apart, through buckets as wide as the band.

    The left side looks into three buckets, so it stays an equi-join.
    """
    bucket = lambda c: F.floor(F.datediff(F.col(c), F.lit("1970-01-01").cast("date")) / days)
    one = left.withColumn("_b", F.explode(F.sequence(bucket(left_time) - 1, bucket(left_time) + 1)))
    two = right.withColumn("_b", bucket(right_time)).withColumnRenamed(by, "_by")
    on = (F.col(by) == F.col("_by")) & (one["_b"] == two["_b"]) & (F.abs(F.datediff(F.col(left_time), F.col(right_time))) <= days)
    met = one.join(two, on, how)
    if how in ("left_semi", "left_anti"):
        return met.drop("_b").distinct()
    return met.drop("_b", "_by")


def best_with_margin(candidates: DataFrame, key: str, candidate: str, score: str, least: float, margin: float) -> DataFrame:
    """Per key: its best candidate if it scores ``least`` and leads the next by ``margin``."""
    best = candidates.groupBy(key, candidate).agg(F.max(score).alias("_s"))
    order = Window.partitionBy(key).orderBy(F.col("_s").desc(), F.col(candidate))
    top = best.withColumn("_next", F.lead("_s").over(order)).withColumn("_n", F.row_number().over(order)).filter("_n = 1")
    second = F.coalesce("_next", F.lit(0.0))
    status = F.when(F.col("_s") < least, "not_found").when(F.col("_s") - second < margin, "ambiguous").otherwise("matched")
    return top.select(key, status.alias("match_status"), F.col("_s").alias("best_score"), second.alias("second_score"), F.when(status == "matched", F.col(candidate)).alias(candidate))


def sweep_join(left: DataFrame, right: DataFrame, by: str, left_time: str, right_time: str, rank: list[str], values: list[str], tie: str) -> DataFrame:
    """Each left row with the greatest right row, by ``rank``, of those at or before its time.

    One sweep over both sides in the order of (``by``, time): the running
    maximum of a struct that begins with ``by`` holds the best row of the key so
    far, or one of a smaller key where there is none yet. Rows are dealt by
    ranges of that order and each range starts from the maximum of those before
    it, so a key of any size is spread over tasks and no pairs are made. ``tie``
    tells left rows of one key and time apart. Adds ``values``, null where
    nothing is known or the key is null; other columns keep their values.
    """
    best = F.struct(F.col(by).alias("by"), *[F.col(c).alias(f"r{k}") for k, c in enumerate(rank)], *[F.col(c).alias(f"v{k}") for k, c in enumerate(values)])
    facts = right.filter(F.col(by).isNotNull()).select(F.col(by).alias("_by"), F.col(right_time).alias("_time"), F.lit(0).alias("_side"), best.alias("_best"))
    rows = left.select(F.struct(*left.columns).alias("_row"), F.col(by).alias("_by"), F.col(left_time).alias("_time"), F.lit(1).alias("_side"), F.col(tie).alias("_tie"))
    both = rows.unionByName(facts, allowMissingColumns=True)
    swept = ranks.running(both, ["_by", "_time", "_side", "_tie"], maxes={"_found": F.col("_best")}).filter("_side = 1")
    known = F.col("_found.by") == F.col("_by")
    return swept.select("_row.*", *[F.when(known, F.col(f"_found.v{k}")).alias(c) for k, c in enumerate(values)])


def point_in_time(events: DataFrame, facts: DataFrame, by: str, event_time: str, rank: list[str], values: list[str]) -> DataFrame:
    """Per event row the best fact that was known: filed and ended by the event's date.

    ``facts`` has filed and end, and counts from the later of the two; ``rank``
    orders what is known, the greatest counts. Events need a column event_id.
    """
    known = facts.withColumn("_known", F.greatest("filed", "end"))
    return sweep_join(events, known, by, event_time, "_known", rank, values, "event_id")


def peer_groups(members: DataFrame, fine: str, coarse: str, least: int) -> DataFrame:
    """Adds peer_group: the fine group if it has ``least`` members, else the coarse one."""
    sizes = members.groupBy(fine).agg(F.count(F.lit(1)).alias("_n"))
    met = members.join(sizes, fine)
    return met.withColumn("peer_group", F.when(F.col("_n") >= least, F.concat(F.lit("fine:"), F.col(fine))).otherwise(F.concat(F.lit("coarse:"), F.col(coarse)))).drop("_n")


def median_of_others(members: DataFrame, group: str, key: str, value: str) -> DataFrame:
    """Adds peers and others_median: how many others the member's group has, and the median of their values.

    Without the member, the middle of n sorted values moves by one place at
    most, so its rank and four values around the middle are enough and no pair
    of members is made. Null values aren't counted; ties are ranked by ``key``.
    """
    known = members.filter(F.col(value).isNotNull())
    ranked = ranks.running(known.select(group, key, value), [group, value, key], {"_all": F.lit(1).cast("long")})
    sizes = ranked.groupBy(F.col(group).alias("_g")).agg(F.count(F.lit(1)).alias("_n"), F.min("_all").alias("_first"))
    ranked = ranked.join(sizes, F.col(group) == F.col("_g")).withColumn("_k", F.col("_all") - F.col("_first") + 1)
    half = F.floor(F.col("_n") / 2)
    near = ranked.filter(F.col("_k").between(half - 1, half + 2)).groupBy(F.col("_g").alias("_h")).agg(F.map_from_entries(F.collect_list(F.struct("_k", value))).alias("_mid"))
    met = ranked.join(near, F.col("_g") == F.col("_h"))
    others = F.col("_n") - 1
    at = lambda place: F.try_element_at("_mid", (place + F.when(F.col("_k") <= place, 1).otherwise(0)).cast("long"))
    median = (at(F.floor((others + 1) / 2)) + at(F.floor(others / 2) + 1)) / 2
    out = met.select(F.col(key).alias("_key"), others.alias("peers"), F.when(others > 0, median).alias("others_median"))
    return members.join(out, F.col(key) == F.col("_key"), "left").drop("_key")
